"""The audit log, profiles and files written from tables."""

import json
import os
import threading

import pytest

from docdelta.sources import audit, files, render
from docdelta.sources.profiles import Profiles


def records(spark, n, mark="x"):
    return spark.createDataFrame([("open", f"u{k}", f"2024-01-01T00:00:{k:02d}", f"f{k}.docx", mark, None, "é" * 50) for k in range(n)], files.AUDIT_SCHEMA)


def test_audit_log(spark, tmp_path):
    """Files of a bounded size, of which the newest stay; a batch once; nothing of a task that fails."""
    spark.dataSource.register(audit.AuditLog)
    folder = str(tmp_path / "log")
    put = lambda df, batch, **more: df.write.format("audit_log").mode("append").options(batch=batch, **more).save(folder)
    put(records(spark, 40).repartition(3), "1", maxbytes=1000)
    first = sorted(os.listdir(folder))
    assert 2 <= len(first) <= 6 and all(f.endswith("-1.jsonl") for f in first)  # five full ones beside the newest
    assert all(json.loads(line)["action"] == "x" for f in first for line in open(os.path.join(folder, f), encoding="utf-8"))
    put(records(spark, 40), "1", maxbytes=1000)
    assert sorted(os.listdir(folder)) == first
    put(records(spark, 4, "y"), "2")
    rows = files.read_audit(spark, folder).collect()
    assert {r.user_id for r in rows if r.action == "y"} == {"u0", "u1", "u2", "u3"} and {r.action for r in rows} == {"x", "y"}

    @__import__("pyspark").sql.functions.udf("string")
    def fails(x):
        if x == "u3":
            raise ValueError("lost")
        return x

    before = sorted(os.listdir(folder))
    with pytest.raises(Exception, match="lost"):
        put(records(spark, 4, "z").withColumn("user_id", fails("user_id")), "3")
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == before
    assert "z" not in {r.action for r in files.read_audit(spark, folder).collect()}


def test_profiles(spark, tmp_path):
    store = Profiles(spark, f"file://{tmp_path}/profiles")
    assert store.active() is None and store.table().count() == 0
    assert store.save("a/b", {"industry": "general", "amount_keywords": ["价"], "comparison_thresholds": {"t": 0.5}}) == 1
    assert store.save("a/b", {"industry": "labor"}) == 2 and store.load("a/b")["industry"] == "labor"
    assert store.clone("a/b", "c") == 1 and store.load("c")["industry"] == "labor"
    store.activate("a/b")
    store.activate("c")
    assert store.active()["name"] == "c" and [r.name for r in store.table().collect()] == ["a/b", "c"]
    store.delete("c")
    assert store.active() is None and [r.name for r in store.table().collect()] == ["a/b"]
    with pytest.raises(KeyError):
        store.activate("c")
    assert store.save("c", {"industry": "again"}) == 3 and store.active()["industry"] == "again"


def test_profiles_of_two_writers(spark, tmp_path):
    """No version is lost and none is written twice."""
    store, taken = Profiles(spark, f"file://{tmp_path}/profiles"), []
    write = lambda who: taken.extend(store.save("p", {"industry": f"{who}-{k}"}) for k in range(5))
    writers = [threading.Thread(target=write, args=(w,)) for w in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(taken) == list(range(1, 11)) and store.load("p")["industry"] in {"0-4", "1-4"}


def test_workbooks(spark):
    """Hidden sheets, merged ranges, ragged rows, signs that XML has for itself."""
    xml = render.sheet_xml([(1, 1, "a<b>&"), (1, 28, " wide "), (3, 2, "x")], ["B3:C4"])
    content = render.workbook([("一'\"", False, xml), ("h", True, xml)])
    cells = {(s, r, c): v for s, r, c, v in files.xlsx_cells(content)}
    assert cells["一'\"", 1, 1] == "a<b>&" and cells["一'\"", 1, 28] == " wide " and cells["一'\"", 2, 5] == ""
    assert all(cells["一'\"", r, c] == "x" for r in (3, 4) for c in (2, 3)) and len(cells) == 4 * 28
    assert {s for s, *_ in files.xlsx_cells(content, hidden=True)} == {"一'\"", "h"}
    assert [render.column_name(k) for k in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]
    empty = render.workbook([("e", False, render.sheet_xml([]))])
    assert list(files.xlsx_cells(empty)) == []
