"""Reports, trail, defaults and health beyond what the SQL twins reach."""

import json

from pyspark.sql import functions as F

from docdelta.operators import report, store, tokens

ITEMS = [(1, "amounts_digits", "missing_in_pdf", "100", "high", 0.5), (1, "dates", "missing_in_pdf", "2024-01-01", "medium", 0.9), (1, "numbers", "extra_in_pdf", "7<8", "low", 0.9), (1, "numbers", "matched", "5", "low", 0.2), (2, "numbers", "matched", "5", "low", 0.9)]


def items(spark):
    return spark.createDataFrame(ITEMS, "pair_id bigint, family string, direction string, raw string, risk string, confidence double")


def test_full_json(spark):
    files = spark.createDataFrame([(1, "w.docx", "p.pdf", "2024-01-01"), (2, "x.docx", "y.pdf", "2024-01-02")], "pair_id bigint, word_file string, pdf_file string, at string")
    out = {r.pair_id: json.loads(r.payload) for r in report.full_json(items(spark), files).collect()}
    assert out[1]["metadata"] == {"timestamp": "2024-01-01", "word_file": "w.docx", "pdf_file": "p.pdf"}
    assert out[1]["summary"] == {"total_diffs": 3, "has_critical_diff": True} and out[2]["summary"] == {"total_diffs": 0, "has_critical_diff": False}
    assert out[1]["low_confidence_items"] == ["100", "5"] and out[2]["low_confidence_items"] == []
    assert out[1]["details"]["missing_in_pdf"] == [{"family": "amounts_digits", "raw": "100"}, {"family": "dates", "raw": "2024-01-01"}]
    assert out[1]["details"]["matched"] == [{"family": "numbers", "raw": "5"}]


def test_html_report(spark):
    texts = spark.createDataFrame([(1, "a < b", None), (2, "x", "y"), (3, None, "only")], "pair_id bigint, word string, pdf string")
    out = {r.pair_id: r.html for r in report.html_report(items(spark), texts).collect()}
    assert "差异总数: 3" in out[1] and "存在金额差异: 是" in out[1] and "a &lt; b" in out[1]
    assert out[1].count("<tr>") == 2 and out[1].index("金额数字") < out[1].index("日期</td>") and "7" not in out[1].split("<table>")[1].split("</table>")[0]
    assert "差异总数: 0" in out[2] and "存在金额差异: 否" in out[3] and out[3].endswith("<div>only</div>\n</body></html>")


def test_trail(spark):
    rows = [(f"T{k:02d}", ["completed", "failed", "processing", "pending"][k % 4], k) for k in range(23)]
    trail = spark.createDataFrame(rows, "task_id string, status string, at int")
    one = store.trail_summary(trail, "at", "task_id").first()
    assert (one.total_operations, one.completed, one.failed, one.in_progress) == (23, 6, 6, 6)
    assert one.recent == [f"T{k:02d}" for k in range(13, 23)]
    lines = [json.loads(r.value) for r in store.export_trail(trail, "at", "task_id").collect()]
    assert [x["task_id"] for x in lines] == [r[0] for r in rows] and {x["total_records"] for x in lines} == {23}
    empty = store.trail_summary(trail.limit(0), "at", "task_id").first()
    assert empty.total_operations == 0 and empty.recent == []


def test_defaults_progress_health(spark):
    rules = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "name string, is_default int")
    assert {r.name: r.is_default for r in store.set_default(rules, "name", "b").collect()} == {"a": 0, "b": 1, "c": 0}
    assert {r.name: r.is_default for r in store.set_default(rules, "name", "x").collect()} == {"a": 1, "b": 0, "c": 1}
    assert store.progress(spark.createDataFrame([], "status string")).first().percent == 100
    parts = lambda *up: spark.createDataFrame([("ocr", True, up[0]), ("word", True, up[1]), ("llm", False, up[2])], "name string, critical boolean, available boolean")
    status = lambda every, *up: store.health(parts(*up), every).first().status
    assert [status(False, True, False, True), status(False, False, False, True), status(False, True, True, True)] == ["degraded", "unhealthy", "healthy"]
    assert [status(True, True, False, True), status(True, True, True, False), status(True, True, True, True)] == ["unhealthy", "degraded", "healthy"]


def test_keywords_that_are_almost_there(spark):
    """One wrong character in four: the certainty is lowered by the likeness, or shared with the neighbour's."""
    rows = [(1, 1, 0, "质量标淮", 0.8, 0, 0, 60, 20), (1, 1, 1, "工期 30天", 0.5, 0, 100, 60, 120), (1, 1, 2, "工朝", 0.9, 0, 200, 30, 220), (1, 1, 3, "安全文明施工贵", 0.7, 0, 300, 60, 320), (1, 1, 4, "一百元", 0.9, 70, 300, 99, 320)]
    table = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    out = {r.keyword: (r.value, round(r.confidence, 4)) for r in tokens.keyword_hits(table, "construction").collect()}
    assert out == {"质量标准": ("", 0.6), "工期": ("30天", 0.5), "安全文明施工费": ("一百元", 0.8)}
    again = spark.createDataFrame([(1, 1, 0, "质量标淮", 0.8, 0, 0, 60, 20), (1, 1, 1, "质量标准：甲", 0.59, 0, 100, 60, 120), (1, 1, 2, "质量标佳", 0.7, 0, 200, 60, 220)], table.schema)
    got = tokens.keyword_hits(again, "construction").first()
    assert (got.value, round(got.confidence, 4)) == ("", 0.525)  # the last one's claim, before it is lowered, beats 0.6
    assert tokens.keyword_hits(table.where(F.lit(False)), "construction").count() == 0
