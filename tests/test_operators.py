import difflib
import random
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docdelta.functions import text as T
from docdelta.operators import mask, report, sheets, store, textdiff, tokens
from docdelta.sources import files
from docdelta.streaming import state


@pytest.mark.parametrize(
    "text,token,gone",
    [
        ("联系人：张三，电话13800138000", "***PHONE***", "13800138000"), ("电话：010-12345678", "***PHONE***", "010-12345678"), ("邮箱：test@example.com", "***EMAIL***", "test@"),
        ("身份证号 110101199001011234", "***ID_CARD***", "1101011990"), ("卡 6222021234567890123 号", "***BANK_ACCOUNT***", "6222021"), ("seal B621JE12345 x", "***SEAL***", "B621JE"), ("0000000000000000", "0000000000000000", "***"), ("", "", "***"),
    ],
)
def test_masks(spark, text, token, gone):
    row = spark.createDataFrame([(text,)], "t string").select(mask.mask_all(F.col("t")).alias("m")).first().m
    assert token in row.masked and gone not in row.masked
    assert (row["items"] == []) == (token == text)


def test_mask_options(spark):
    row = spark.createDataFrame([("a@b.com 13800138000",)], "t string").select(mask.mask_all(F.col("t"), {"phones": False}).alias("m")).first().m
    assert row.masked == "***EMAIL*** 13800138000" and [i.type for i in row["items"]] == ["emails"]


def test_text_diff(spark):
    pairs = [("甲方", "甲乙双方"), ("合同条款", "合同条款。"), ("付款100元\n\n于 明天", "付款200元\r\n于 明天"), ("", "x"), ("same", "same"), (None, None)]
    for a, b in [p for p in pairs if p[0] is not None]:
        ops = textdiff.edits(a, b)
        assert "".join(t for o, t in ops if o <= 0) == a and "".join(t for o, t in ops if o >= 0) == b
    rows = textdiff.diff(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair_id bigint, word string, pdf string"))
    sums = {r.pair_id: r for r in textdiff.summary(rows).collect()}
    assert set(sums) == {0, 1, 2, 3} and all(r.total_changes == r.insertions + r.deletions for r in sums.values())
    assert not sums[1].has_risk and sums[2].has_risk


def test_diff_classes(spark):
    cases = {"100000": "high/number", "违约金": "high/keyword", "，。；：！": "low/text", "  ...  ": "low/text", "普通文本内容": "medium/text"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.classify_diff(F.col("t")).alias("c")).collect()
    assert {r.t: f"{r.c.risk}/{r.c.category}" for r in rows} == cases


def test_column_match():
    assert sheets.match_columns(["名称", "数量", "单价x"], ["单价y", "名 称", "别的"], ["名称", "数量", "单价x"], ["单价y", "名称", "别的"]) == [(0, 1), (1, 0), (2, 2)]
    assert sheets.header_ratio("amount", "amounts") == difflib.SequenceMatcher(None, "amount", "amounts").ratio()


def test_sheets(spark):
    def book(name, rows):
        return [(name, "S", r, c, h, v) for r, row in rows.items() for c, (h, v) in enumerate(zip(["编号", "金额", "日期"], row), 1)]

    cells = spark.createDataFrame(
        book("a", {2: ("k1", "100.001", "2024-01-15"), 3: ("k2", "1000", ""), 4: ("k2", "5", ""), 5: ("gone", "7", "long text row here")})
        + book("b", {2: ("k2", "2000", ""), 3: ("k1", "100.002", "2024-01-16"), 4: ("k2", "5", ""), 6: ("new", "7", "long text row here")}),
        "book string, sheet string, row bigint, col int, header string, value string",
    )
    diffs = {(r.row, r.col): (r.category, r.risk) for r in sheets.cell_differences(cells, 1).collect()}
    assert diffs == {(3, 2): ("number", "high"), (2, 3): ("date", "high")}
    assert {(r.type, r.row) for r in sheets.row_changes(cells, 1).collect()} == {("row_deleted", 5), ("row_added", 6)}
    assert [(r.row_a, r.row_b) for r in sheets.moved_rows(cells, 1).collect()] == [(5, 6)]
    stats = sheets.sheet_stats(cells, 1).first()
    assert (stats.added, stats.deleted, stats.modified, stats.has_high) == (1, 1, 2, True)


def book_of(spark, books):
    rows = [(name, sheet, r, c, h, v) for name, sheet, heads, body in books for r, row in body.items() for c, (h, v) in enumerate(zip(heads, row), 1)]
    return spark.createDataFrame(rows, "book string, sheet string, row bigint, col int, header string, value string")


def test_rows_of_books_with_other_column_orders(spark):
    """Equal books whose second has its columns elsewhere: nothing differs."""
    a = {k: (f"k{k}", str(k * 10), "x") for k in range(2, 9)}
    cells = book_of(spark, [("a", "S", ["编号", "金额", "备注"], a), ("b", "S", ["金额", "备 注", "编号"], {k: (v[1], v[2], v[0]) for k, v in a.items()})])
    assert {(r.row_a, r.row_b) for r in sheets.match_rows(cells, 1).collect()} == {(k, k) for k in a}
    assert sheets.cell_differences(cells, 1).count() == 0 and sheets.row_changes(cells, 1).count() == 0
    assert {(r.row_a, r.row_b, r.how) for r in sheets.match_rows_auto(cells).collect()} == {(k, k, "key") for k in a}


def test_composite_and_missing_keys(spark):
    heads = ["编号", "分编号", "金额"]
    cells = book_of(spark, [
        ("a", "S", heads, {2: ("1", "a", "5"), 3: ("1", "b", "6"), 4: ("1", "b", "7"), 5: ("", "\u3000", "8"), 6: ("", "", ""), 7: (" 2 ", "", "9")}),
        ("b", "S", heads, {2: ("1", "b", "6"), 3: ("1", "a", "5"), 4: ("2", "", "9"), 5: ("", "", "0"), 6: ("", "c", "1")}),
    ])
    got = {(r.row_a, r.row_b) for r in sheets.match_rows(cells, [1, 2]).collect()}
    assert got == {(2, 3), (3, 2), (4, None), (5, None), (7, 4), (None, 6)}


def test_rows_by_position_without_keys(spark):
    """No key column, or one without a partner: rows of one number that hold something."""
    cells = book_of(spark, [
        ("a", "S", ["名称", "值"], {2: ("x", "1"), 3: ("", "0"), 4: ("y", "2")}), ("b", "S", ["名称", "值"], {2: ("z", "1"), 3: ("q", "1"), 4: ("y", "2")}),
        ("a", "T", ["编号", "值"], {2: ("k1", "0%")}), ("b", "T", ["编号", "值"], {2: ("k9", "¥0")}),
    ])
    got = {(r.sheet, r.row_a, r.row_b, r.how) for r in sheets.match_rows_auto(cells).collect()}
    assert got == {("S", 2, 2, "position"), ("S", None, 3, "position"), ("S", 4, 4, "position"), ("T", 2, 2, "position")}
    assert {(r.sheet, r.row) for r in sheets.by_position(cells).collect()} == {("S", 2), ("S", 4), ("T", 2)}


def greedy_moves(gone, new):
    """(row_a, row_b) of the moves: each deleted row in order takes the most alike free added row above the limit."""
    out, taken = [], set()
    for a, x in sorted(gone.items()):
        best, hit = 0.6, None
        for b, y in sorted(new.items()):
            if b not in taken and (r := difflib.SequenceMatcher(None, x, y).ratio()) > best:
                best, hit = r, b
        if hit is not None:
            taken.add(hit)
            out.append((a, hit))
    return out


def test_moved_rows_are_those_of_the_greedy_loop(spark):
    draw = random.Random(11)
    books, wanted = [], {}
    for sheet in range(5):
        words = [f"{draw.choice(['合同', '金额', 'row', 'x'])}{k}" for k in range(12)]
        side = lambda mark, first: {first + k: (f"{mark}{k}", " ".join(draw.choice(words) for _ in range(draw.randrange(1, 9)))) for k in range(draw.randrange(5, 30))}  # noqa: E731, B023
        a, b = side("p", 2), side("q", 40)
        books += [("a", f"S{sheet}", ["编号", "备注"], {1: ("same", "same"), **a}), ("b", f"S{sheet}", ["编号", "备注"], {1: ("same", "same"), **b})]
        wanted[f"S{sheet}"] = greedy_moves(*({k: " ".join(v) for k, v in x.items()} for x in (a, b)))
    cells = book_of(spark, books).repartition(3)
    got = {}
    for r in sheets.moved_rows(cells).collect():
        got.setdefault(r.sheet, []).append((r.row_a, r.row_b))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in wanted.items() if v}
    n = sum(map(len, wanted.values()))
    with_moves = sheets.differences(cells, moves=True).groupBy("type").count().collect()
    assert n and {r["type"]: r["count"] for r in with_moves}["row_moved"] == n
    before = sheets.differences(cells).count()
    assert sheets.differences(cells, moves=True).count() == before - n
    assert sum(r.added + r.deleted + r.modified for r in sheets.sheet_stats(cells).collect()) == before


def test_sheets_without_keys_end_to_end(spark):
    """Rows pair by position: changed cells, not deleted and added rows. Cells that stand twice count once; a cell that one
    side lacks is empty there; sheets of one book have no differences of their own."""
    heads = ["名称", "金额"]
    cells = book_of(spark, [("a", "S", heads, {2: ("x", "1"), 3: ("y", "2"), 4: ("z", "3")}), ("b", "S", heads, {2: ("x", "1"), 3: ("w", "2"), 4: ("z", "9")}), ("a", "only", heads, {2: ("x", "1")})])
    cells = cells.unionByName(cells.where("row = 3")).where("not (book = 'b' and row = 2 and col = 2)")
    assert sorted((r.type, r.row, r.col, r.value_a, r.value_b) for r in sheets.differences(cells).collect()) == [("cell_changed", 2, 2, "1", ""), ("cell_changed", 3, 1, "y", "w"), ("cell_changed", 4, 2, "3", "9")]
    assert sheets.row_changes(cells).count() == 0 and sheets.moved_rows(cells).count() == 0
    assert {(r.sheet, r.status, r.differences, r.critical) for r in sheets.workbook_summary(cells).collect()} == {("S", "matched", 3, True), ("only", "only_in_a", 2, True)}


@pytest.mark.parametrize("few", [sheets.FEW_SHEETS, 0])
def test_many_sheets(spark, monkeypatch, few):
    monkeypatch.setattr(sheets, "FEW_SHEETS", few)
    cells = book_of(spark, [(b, f"S{k}", ["编号", "值"], {2: ("k", f"{b if k % 3 == 0 else k}"), 3: ("", "0"), 4: ("", "")}) for k in range(30) for b in "ab"])
    assert sorted(r.sheet for r in sheets.cell_differences(cells).collect()) == sorted(f"S{k}" for k in range(0, 30, 3))
    assert sheets.differences(cells.limit(0)).count() == 0


def test_headers_and_texts(spark):
    cells = book_of(spark, [("a", "S", ["p", "q"], {1: ("", "0"), 2: (" ", "v"), 3: ("w", "")}), ("a", "R", ["p", "q"], {1: ("", "")})])
    assert {(r.sheet, r.col): r.header for r in sheets.infer_headers(cells).collect()} == {("S", 1): " ", ("S", 2): "v", ("R", 1): "列1", ("R", 2): "列2"}
    assert sheets.book_text(cells.where("sheet = 'S'")).first().full_text == "=== 工作表: S ===\n行1: q: 0\n行2: p:   | q: v\n行3: p: w"


def test_tokens(spark):
    rows = [(0, "合同编号：HT-2024-001", 0.95, 10, 20, 200, 40), (1, "甲方：深圳市XX科技有限公司", 0.92, 10, 50, 250, 70), (2, "包干费用为¥900000.00元", 0.88, 10, 120, 220, 140), (3, "工期：180天", 0.91, 10, 160, 130, 180), (4, "违约金50000元", 0.75, 10, 220, 150, 240), (5, "5%", 0.65, 10, 260, 50, 280)]
    table = spark.createDataFrame([(1, 1, *r) for r in rows], "doc_id bigint, page int, ord int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    text = tokens.full_text(table).first().text
    assert text.startswith("--- 第 1 页 ---\n合同编号") and text.count("\n") == 6
    assert [r.ord for r in tokens.low_confidence(table, 0.8).collect()] == [4, 5]
    fields = {r.keyword: r.value for r in tokens.keyword_hits(table, "construction").collect()}
    assert fields == {"工期": "180天"}
    boosted = {r.ord: r.confidence for r in tokens.boost(table, tokens.full_text(table)).collect()}
    assert boosted[4] == pytest.approx(0.9) and boosted[0] == 0.95
    fixed = spark.createDataFrame([(1, 1, 0, "己经拔款", 0.7), (1, 1, 1, "3未元", 0.5), (1, 1, 2, "己经", 0.9)], "doc_id bigint, page int, ord int, text string, confidence double")
    assert [(r.text, r.post_corrected) for r in tokens.correct(fixed).orderBy("ord").collect()] == [("已经拨款", True), ("3末元", True), ("己经", False)]


def test_report_helpers(spark):
    row = spark.createDataFrame([("甲方付违约金和违约金", ["违约金", "甲方", "没有"])], "t string, w array<string>").select(
        report.segments(F.col("t"), F.col("w"), "delete").alias("s"), report.highlight(F.col("t"), F.col("w")).alias("h"), report.snippet(F.col("t"), F.lit("违约金"), 1).alias("x")).first()
    assert [(s.mode, s.text) for s in row.s] == [("delete", "甲方"), ("normal", "付"), ("delete", "违约金"), ("normal", "和违约金")]
    assert row.h.count("<span") == 2 and row.x == "付违约金和"


def test_store(spark):
    table = spark.createDataFrame([("a", "pending", 1, None), ("b", "failed", 0, "t")], "task_id string, status string, is_active int, completed_at string")
    assert {r.status for r in store.upsert(table, table.where("task_id = 'a'").withColumn("status", F.lit("x")), "task_id").collect()} == {"x", "failed"}
    assert store.update_status(table, "task_id", "a", "completed", F.lit("now")).where("task_id = 'a'").first().completed_at == "now"
    assert [r.is_active for r in store.toggle(table, "task_id", "a").orderBy("task_id").collect()] == [0, 0]
    assert store.order_by(table, "task_id; DROP").columns == table.columns and store.order_by(table, "task_id DESC").first().task_id == "b"
    assert store.progress(table).first().percent == 0.0


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = _zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>一</w:t></w:r><w:del><w:r><w:t>删</w:t></w:r></w:del><w:ins><w:r><w:t>二</w:t></w:r></w:ins></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
S, R = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = _zip({
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="表1" r:id="r1"/><sheet name="h" state="hidden" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>项目A</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>',
})


def test_files(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "broken.docx": b"PK\x03\x04" + b"0" * 40, "c.pdf": b"hello, no pdf at all here", "n.txt": b"x" * 30}.items():
        (tmp_path / name).write_bytes(data)
    found = files.binary(spark, str(tmp_path))
    docs = {r.path[-6:]: r for r in files.read_docx(found.where("path like '%docx'")).collect()}
    assert docs["a.docx"].full_text == "一二\na b" and docs["n.docx"].error
    assert {(r.row, r.col): r.value for r in files.read_xlsx(found.where("path like '%xlsx'")).collect()} == {(1, 1): "项目A", (1, 2): "5", (2, 1): "项目A", (2, 2): "x"}
    found = found.unionByName(spark.createDataFrame([("x/e.png", None, 0, bytearray())], found.schema))  # the source skips files without bytes
    checks = {r.path.rsplit("/", 1)[1]: (r.is_valid, r.errors, r.warnings) for r in files.validate(found).collect()}
    assert checks["a.docx"][0] and checks["e.png"][1] == ["empty"] and checks["c.pdf"][2] == ["unknown type"] and checks["n.txt"][1] == ["extension"]


def test_names_and_texts(spark):
    rows = spark.createDataFrame([("../../etc/passwd",), ("a<b>:c.txt",), ("CON.txt",), (" .x. ",), ("",), (None,)], "t string").select(T.safe_filename(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["passwd", "a_b__c.txt", "_CON.txt", "x", "untitled", "untitled"]
    assert spark.createDataFrame([("a\x00b​c\td",)], "t string").select(T.sanitise(F.col("t")).alias("t")).first().t == "abc\td"
    verdict = spark.createDataFrame([('```json\n{"analysis": "ok", "confidence": 0.5}\n```',), ("no json",)], "t string").select(T.parse_verdict(F.col("t")).alias("v")).collect()
    assert verdict[0].v.analysis == "ok" and verdict[1].v.summary == "解析失败"


def test_rate_limit(spark, tmp_path):
    times = [("a", 0.1 * k) for k in range(8)] + [("a", 2.0 + k) for k in range(40)] + [("b", 5.0)]
    kept, wanted = [], []
    for c, t in times[:-1]:
        ok, kept = state.admit([t], kept)
        wanted.append((c, t, ok[0]))
    assert [x[2] for x in wanted[:8]] == [True] * 5 + [False] * 3 and sum(x[2] for x in wanted) == 30
    wanted.append(("b", 5.0, True))
    table = spark.createDataFrame(times, "client string, at double")
    assert sorted(map(tuple, state.rate_limit_batch(table).collect())) == sorted(wanted)
    table.coalesce(1).write.json(str(tmp_path / "in"))
    stream = state.rate_limit(spark.readStream.schema("client string, at double").json(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(25)  # batches without data go on while clients can time out
    run.stop()
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(wanted)


def test_hourly_stream(spark, tmp_path):
    table = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,k*20,0) AS logged_at, 'view' AS event_type FROM (SELECT explode(sequence(0, 9)) AS k)")
    table.write.parquet(str(tmp_path / "in"))
    stream = state.hourly_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, state.hourly_counts(table).collect()))


def test_trail(spark):
    steps = spark.createDataFrame([(1, "started", 1, {"a": "1", "b": "1"}), (1, "completed", 2, {"b": "2"}), (2, "started", 1, {})], "operation_id bigint, step string, at int, details map<string,string>")
    assert {r.operation_id: (r.status, r.details) for r in state.trail(steps).collect()} == {1: ("completed", {"a": "1", "b": "2"}), 2: ("started", {})}


def test_plans_have_no_cross_join(spark, sf):
    from docdelta.plans.queries import QUERIES

    for name in ("agg_01_contract_summary", "fn_36_cell_diffs", "jn_16_adjacent"):
        assert not re.search("CartesianProduct", QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()), name


def test_sessions_of_the_rate_limiter(spark):
    """Busy clients, idle minutes and gaps of exactly a minute, against a plain loop."""
    draw = random.Random(4)
    rows, wanted = [], []
    for client in "abc":
        at, kept = 0.0, []
        for _ in range(400):
            at = round(at + draw.choice([0.1, 0.2, 0.5, 3.0, 60.0, 61.5]), 3) if client != "c" else round(at + 0.7, 3)
            kept = [t for t in kept if at - t < 60]
            ok = not (len(kept) >= 5 and at - kept[0] < 1.0) and len(kept) < 30
            kept += [at] * ok
            rows.append((client, at))
            wanted.append((client, at, ok))
    table = spark.createDataFrame(rows, "client string, at double").repartition(4)
    assert sorted(map(tuple, state.rate_limit_batch(table).collect())) == sorted(wanted)


def test_expiry_on_a_stream(spark, tmp_path):
    """Tasks expire as the watermark passes them, live again when they change, and are told once; a restart goes on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    steps = [[("a", "pending", "10:00:00"), ("b", "pending", "10:00:00")], [("a", "running", "10:30:00")], [("c", "pending", "11:40:00")], [("b", "running", "12:00:00")], [("z", "pending", "14:00:00")], [("z", "done", "14:00:01")]]
    changes = [(t, s, f"2024-01-01 {at}") for step in steps for t, s, at in step]
    schema = "task_id string, status string, changed_at timestamp"

    def run(k):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("task_id", "status", "changed_at"), (t, s, f"2024-01-01 {at}")))) for t, s, at in steps[k]))
        stream = state.expiries(spark.readStream.schema(schema).json(str(folder)), 3600, "1 minute")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    try:
        for k in range(len(steps)):  # each a restart of the query
            run(k)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.task_id, r.status, r.last_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    table = spark.createDataFrame(changes, "task_id string, status string, at string").select("task_id", "status", F.col("at").cast("timestamp").alias("changed_at"))
    wanted = state.expiries_batch(table, 3600, F.lit("2024-01-01 13:59:01").cast("timestamp"))
    assert got == sorted((r.task_id, r.status, r.last_ms) for r in wanted.collect()) and [t for t, *_ in got] == ["a", "b", "b", "c"]
