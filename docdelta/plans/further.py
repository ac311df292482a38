"""More queries, each with its SQL twin beside it: service functions, scalar functions, store, stateful roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import extract, report, service, sheets, store, tokens
from ..sources import files, render
from ..streaming import state
from . import corpus
from .oracle import _AUD, _CELLNUM, _FIELDS, _RISK, ALL, C, ITEMS, NUMBERS, ORACLES, q, with_
from .queries import QUERIES, _docs, _items, _table, fn_73_text_diff

SECRET = "docdelta-keys"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pad(mask: int) -> str:
    return "from_hex('" + bytes(x ^ mask for x in SECRET.encode().ljust(64, b"\0")).hex() + "')"


_HASH = f"sha256({_pad(0x5C)} || from_hex(sha256({_pad(0x36)} || encode({{}}))))"
_KEYS = f"keys AS (SELECT c_custkey AS key_id, {_HASH.format(chr(39) + 'key-' + chr(39) + ' || c_custkey')} AS key_hash, CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'analyst' ELSE 'viewer' END AS role, c_name AS label, CAST(c_custkey % 5 <> 0 AS INTEGER) AS is_active FROM customer)"


def _keys(spark, sf_dir):
    role = F.when(F.col("c_custkey") % 3 == 0, "admin").when(F.col("c_custkey") % 3 == 1, "analyst").otherwise("viewer")
    key = service.key_hash(F.concat(F.lit("key-"), F.col("c_custkey")), SECRET)
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), key.alias("key_hash"), role.alias("role"), F.col("c_name").alias("label"), (F.col("c_custkey") % 5 != 0).cast("int").alias("is_active"))


@query(with_(_KEYS) + "SELECT key_id, key_hash FROM keys")
def fn_65_key_hash(spark, sf_dir):
    return _keys(spark, sf_dir).select("key_id", "key_hash")


@query(with_(_KEYS) + "SELECT key_id, count(*) AS requests, max(ts) AS last_used_at FROM events JOIN keys ON user_id = key_id WHERE is_active = 1 GROUP BY key_id")
def jn_18_key_lookup(spark, sf_dir):
    requests = _table(spark, sf_dir, "events").select(F.concat(F.lit("key-"), F.col("user_id")).alias("api_key"), F.col("ts").alias("at"))
    return service.key_usage(requests, _keys(spark, sf_dir), SECRET)


@query(with_(_KEYS) + "SELECT key_id, role, label FROM keys WHERE is_active = 1 AND role IN ('admin', 'analyst')")
def flt_09_allowed(spark, sf_dir):
    roles = spark.createDataFrame(list(vocab.ROLE_PERMISSIONS.items()), "role string, permissions array<string>")
    return store.allowed(_keys(spark, sf_dir), roles, "export")


@query(with_(_KEYS) + "SELECT key_id, CASE WHEN key_id = 7 THEN 1 - is_active ELSE is_active END AS is_active FROM keys")
def snk_13_toggle(spark, sf_dir):
    return store.toggle(_keys(spark, sf_dir).select("key_id", "is_active"), "key_id", 7)


@query("SELECT c_custkey AS key_id, 'h' || c_custkey AS key_hash, CASE WHEN c_custkey % 2 = 0 THEN 'viewer' ELSE 'admin' END AS role, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS label, c_custkey % 5 <> 1 AS is_active FROM customer")
def src_18_migrate(spark, sf_dir):
    c = F.col("c_custkey")
    key = F.struct(c.alias("key_id"), F.concat(F.lit("h"), c).alias("key_hash"), F.when(c % 2 != 0, "admin").alias("role"), F.when(c % 3 != 0, F.col("c_name")).alias("label"), F.when(c % 5 == 1, F.lit(False)).alias("is_active"))
    return store.migrate(_table(spark, sf_dir, "customer").select(F.array(key).alias("keys")))


@query(f"SELECT event_id, CASE c WHEN 401 THEN {q(service.HTTP_MESSAGES[401])} WHEN 403 THEN {q(service.HTTP_MESSAGES[403])} WHEN 429 THEN {q(service.HTTP_MESSAGES[429])} ELSE CASE WHEN c >= 500 THEN {q(service.SERVER_MESSAGE)} ELSE '请求失败（HTTP ' || c || '）' END END AS message FROM (SELECT event_id, 400 + event_id % 120 AS c FROM events)")
def fn_67_http_messages(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", service.http_message(400 + F.col("event_id") % 120).alias("message"))


@query("SELECT event_id, '[E' || user_id || '][' || upper(event_type) || '] ' || props || CASE WHEN event_id % 2 = 0 THEN ' (可恢复)' ELSE '' END AS line FROM events")
def fn_72_error_lines(spark, sf_dir):
    line = service.error_text(F.concat(F.lit("E"), F.col("user_id")), F.col("event_type"), F.col("props"), F.col("event_id") % 2 == 0)
    return _table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("SELECT event_id, 'event=' || event_type || ' user=' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' id=' || event_id END AS line FROM events")
def fn_70_log_lines(spark, sf_dir):
    line = service.log_fields(event=F.col("event_type"), user=F.col("user_id"), id=F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return _table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("SELECT n_nationkey, CAST(coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, 0.7) AS DOUBLE) AS header, CAST(0.6 AS DOUBLE) AS row FROM nation")
def fn_69_profile(spark, sf_dir):
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("header"), F.col("n_nationkey").cast("double"))).otherwise(F.create_map(F.lit("unknown"), F.lit(1.0)))
    return _table(spark, sf_dir, "nation").select("n_nationkey", service.override({"header": 0.7, "row": 0.6}, own).alias("t")).select("n_nationkey", "t.header", "t.row")


@query("SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS ord, 'w' || i AS word, 'p' || i AS pdf FROM (SELECT *, unnest(range(1, least(w, p) + 1)) AS i FROM (SELECT n_nationkey, n_nationkey % 13 AS w, n_regionkey + 9 AS p FROM nation)) WHERE least(w, p) BETWEEN 1 AND 10")
def jn_17_zip(spark, sf_dir):
    named = lambda prefix, n: F.transform(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(prefix), i))
    lists = _table(spark, sf_dir, "nation").select("n_nationkey", named("w", F.col("n_nationkey") % 13).alias("ws"), named("p", F.col("n_regionkey") + 9).alias("ps"))
    return service.zip_pairs(lists, "n_nationkey", "ws", "ps")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND text <> '' THEN string_split(text, ' ')[1] WHEN turn % 2 = 0 THEN role ELSE NULL END AS first_word FROM conversations")
def src_08_fallback(spark, sf_dir):
    a = F.when((F.col("turn") % 3 != 0) & (F.col("text") != ""), F.split("text", " ", -1)).otherwise(F.array().cast("array<string>"))
    b = F.when(F.col("turn") % 2 == 0, F.array("role"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(service.first_result(a, b), F.lit(0)).alias("first_word"))


@query(with_(corpus.DUCK_TOKENS) + "SELECT doc_id, max(page) AS pages FROM tokens GROUP BY doc_id")
def src_05_page_count(spark, sf_dir):
    return corpus.tokens(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("pages"))


@query("SELECT o_orderkey // 16 AS image_id, CASE WHEN var_pop(CAST(o_totalprice AS BIGINT) % 256) > 800 OR 600 + (o_orderkey // 16) % 400 < 800 THEN 'sauvola' ELSE 'otsu' END AS method FROM (SELECT o_orderkey, CASE WHEN (o_orderkey // 16) % 3 = 0 THEN floor(o_totalprice / 16) ELSE floor(o_totalprice) % 50 END AS o_totalprice FROM orders) GROUP BY o_orderkey // 16")
def agg_17_binarisation(spark, sf_dir):
    image = F.floor(F.col("o_orderkey") / 16)
    mean = F.when(image % 3 == 0, F.floor(F.col("o_totalprice") / 16)).otherwise(F.floor("o_totalprice") % 50) % 256
    return service.binarisation(_table(spark, sf_dir, "orders").select(image.alias("image_id"), (600 + image % 400).alias("width"), F.lit(2000).alias("height"), mean.alias("mean")))


@query("SELECT user_id AS client, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 5000 RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS offered FROM events")
def win_09_offered_load(spark, sf_dir):
    return service.offered_load(_table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 5000).alias("us")))


@query(with_(C, NUMBERS) + """, n AS (SELECT pair_id, raw, side, row_number() OVER (PARTITION BY pair_id, raw, side) AS k FROM numbers)
SELECT coalesce(w.pair_id, p.pair_id) AS pair_id, coalesce(w.raw, p.raw) AS raw, coalesce(w.k, p.k) AS k, CASE WHEN p.k IS NULL THEN 'missing_in_pdf' WHEN w.k IS NULL THEN 'extra_in_pdf' ELSE 'matched' END AS status
FROM (SELECT * FROM n WHERE side = 'word') w FULL JOIN (SELECT * FROM n WHERE side = 'pdf') p ON w.pair_id = p.pair_id AND w.raw = p.raw AND w.k = p.k""")
def jn_11_bags(spark, sf_dir):
    return service.match_bags(extract.numbers(_docs(spark, sf_dir)), "raw")


@query(with_(*ALL) + f"SELECT pair_id, family, direction, raw, {_RISK} AS risk FROM sections WHERE direction <> 'matched' AND family IN ('numbers', 'amounts_digits') AND {_RISK} = 'high'")
def flt_02_filter(spark, sf_dir):
    return service.filter_items(_items(spark, sf_dir).where("direction <> 'matched'"), "high", "数字").select("pair_id", "family", "direction", "raw", "risk")


@query(with_(*ALL) + "SELECT pair_id, family, count(*) FILTER (direction = 'matched') AS matched_count, coalesce(string_agg(raw, '|' ORDER BY raw) FILTER (direction <> 'matched'), '') AS diffs, bool_or(direction <> 'matched') AS has_diff FROM sections WHERE family <> 'percentages' GROUP BY pair_id, family")
def flt_07_slim(spark, sf_dir):
    return service.slim(_items(spark, sf_dir).where("family <> 'percentages'")).withColumn("diffs", F.array_join("diffs", "|"))


@query()
def fn_59_prompts(spark, sf_dir):
    text = lambda side: F.max(F.when(F.col("side") == side, F.col("text")))
    pairs = _docs(spark, sf_dir).groupBy("pair_id").agg(text("word").alias("word"), text("pdf").alias("pdf"))
    diffs = _items(spark, sf_dir).where("direction <> 'matched'").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "family", "raw"))).alias("diffs"))
    return pairs.join(diffs, "pair_id", "left").select("pair_id", service.prompt(F.col("word"), F.col("pdf"), F.coalesce("diffs", F.array().cast("array<string>"))).alias("prompt"))


# Scalar functions.
@query("SELECT p_partkey, lower(regexp_replace(p_type || p_brand || '_' || p_name, '[^a-zA-Z0-9_]', '', 'g')) AS keyword FROM part")
def fn_04_keywords(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.keyword(F.concat("p_type", "p_brand", F.lit("_"), "p_name")).alias("keyword"))


@query(r"SELECT p_partkey, lower(replace(replace(p_type || p_brand || p_name, ' ', ''), '-', '')) AS header FROM part")
def fn_05_headers(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", T.header(F.concat(F.lit("["), "p_type", F.lit("]（"), "p_brand", F.lit("）_：·"), "p_name")).alias("header"))


@query(with_(corpus.DUCK_SHEETS) + r"SELECT book, sheet, row, col, trim(regexp_replace(value, '\s+', ' ', 'g')) AS text FROM cells")
def fn_06_cells(spark, sf_dir):
    return corpus.sheet_cells(spark, sf_dir).select("book", "sheet", "row", "col", T.cell(F.col("value")).alias("text"))


@query(with_(C) + "SELECT pair_id, side, unnest(regexp_extract_all(text, '[一-鿿]{2,}')) AS run FROM docs")
def fn_07_han_runs(spark, sf_dir):
    return _docs(spark, sf_dir).select("pair_id", "side", F.explode(T.han_runs(F.col("text"))).alias("run"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS norm FROM orders")
def fn_30_dates(spark, sf_dir):
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).when(F.col("o_orderkey") % 3 == 1, F.concat_ws("/", y, m, d)).otherwise(F.concat_ws(".", y, m, d))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.normalise_date(written).alias("norm"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")
def fn_31_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.number(F.format_number("o_totalprice", 2)).alias("value"))


@query(with_(corpus.DUCK_SHEETS) + f"SELECT book, sheet, row, col, {_CELLNUM('value')} AS number FROM cells")
def fn_32_cell_numbers(spark, sf_dir):
    return corpus.sheet_cells(spark, sf_dir).select("book", "sheet", "row", "col", T.cell_number(F.col("value")).alias("number"))


@query(with_(corpus.DUCK_SHEETS) + r"SELECT book, sheet, row, col, regexp_full_match(trim(value), '[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}[日号]?|[0-9]{4}年\s*[0-9]{1,2}月\s*[0-9]{1,2}日|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}') AS date_like FROM cells")
def fn_34_date_like(spark, sf_dir):
    return corpus.sheet_cells(spark, sf_dir).select("book", "sheet", "row", "col", T.looks_like_date(F.col("value")).alias("date_like"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ' end' ELSE string_split(o_orderpriority, ' ')[1] END AS value FROM orders")
def fn_43_value_after(spark, sf_dir):
    line = F.concat(F.lit("x 级别"), F.when(F.col("o_orderkey") % 2 == 0, " : ").otherwise("  "), "o_orderpriority", F.lit(" end"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.value_after(F.lit("级别"), line).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '_con.txt' WHEN p_partkey % 10 = 1 THEN 'untitled' ELSE replace(p_name || '_' || p_brand || '.txt', '|', '_') END AS name FROM part")
def fn_54_filenames(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 10 == 0, "../a/con.txt").when(F.col("p_partkey") % 10 == 1, " .. ").otherwise(F.concat(F.lit("/etc/ ."), "p_name", F.lit("?"), "p_brand", F.lit(".txt. ")))
    return _table(spark, sf_dir, "part").select("p_partkey", T.safe_filename(name).alias("name"))


@query("SELECT doc_id, CASE WHEN position('the' IN text) = 0 THEN '' ELSE substr(text, greatest(position('the' IN text) - 30, 1), 33 + position('the' IN text) - greatest(position('the' IN text) - 30, 1)) END AS snippet FROM documents")
def fn_57_snippets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", report.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'no {json ' || event_type END AS analysis, CASE WHEN event_id % 2 = 0 THEN 's' ELSE '解析失败' END AS summary, CAST(CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM events")
def fn_58_verdicts(spark, sf_dir):
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('```json\n{"analysis": "'), "event_type", F.lit('", "summary": "s", "confidence": 0.5}\n```'))).otherwise(F.concat(F.lit("no {json "), "event_type"))
    return _table(spark, sf_dir, "events").select("event_id", T.parse_verdict(answer).alias("v")).select("event_id", "v.analysis", "v.summary", "v.confidence")


@query("SELECT 'f' || event_id || CASE event_id % 4 WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' ELSE '.pdf' END AS path, event_id % 4 = 0 AS is_valid, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'type mismatch' WHEN 2 THEN 'extension' ELSE 'empty' END AS errors, CASE WHEN event_id % 4 = 3 THEN 'unknown type' ELSE '' END AS warnings FROM events")
def fn_64_validation(spark, sf_dir):
    k = F.col("event_id") % 4
    content = F.when(k < 3, F.concat(F.lit(b"%PDF-1.4 "), F.encode(F.rpad("event_type", 40, " "), "UTF-8"))).otherwise(F.lit(b""))
    made = _table(spark, sf_dir, "events").select(F.concat(F.lit("f"), "event_id", F.when(k == 1, ".docx").when(k == 2, ".exe").otherwise(".pdf")).alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("bigint"))
    return files.validate(made).select("path", "is_valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


# Tokens and images.
@query(with_(corpus.DUCK_TOKENS) + "SELECT doc_id, page, ord, CASE WHEN confidence < 0.6 AND ord % 2 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN confidence < 0.6 AND ord % 2 = 0 THEN confidence + 0.25 ELSE confidence END AS confidence FROM tokens")
def fn_49_reread(spark, sf_dir):
    found = corpus.tokens(spark, sf_dir)
    again = found.where("confidence < 0.6 and ord % 2 = 0").withColumn("try", F.explode(F.array(F.lit(0), F.lit(1))))
    tries = again.select("doc_id", "page", "ord", F.when(F.col("try") == 1, F.concat("text", F.lit("!"))).otherwise("?").alias("new_text"), (F.col("confidence") + F.when(F.col("try") == 1, 0.25).otherwise(0.0)).alias("score"))
    return tokens.merge_reread(found, tries).select("doc_id", "page", "ord", "text", "confidence")


@query("SELECT event_id, CASE WHEN a = '' AND c * 0.4 + (1 - b) * 0.35 + (1 - n) * 0.25 < 0.4 THEN 'full_preprocess' ELSE a END AS actions FROM (SELECT *, concat_ws('|', CASE WHEN c < 0.3 THEN 'contrast_enhance' END, CASE WHEN b > 0.6 THEN 'sharpen' END, CASE WHEN n > 0.5 THEN 'denoise' END) AS a FROM (SELECT event_id, (event_id % 10)::DOUBLE / 10 AS c, (event_id // 10 % 10)::DOUBLE / 10 AS b, (event_id // 100 % 10)::DOUBLE / 10 AS n FROM events))")
def fn_50_quality(spark, sf_dir):
    tenth = lambda by: F.floor(F.col("event_id") / by) % 10 / 10
    images = _table(spark, sf_dir, "events").select("event_id", tenth(1).alias("contrast"), tenth(10).alias("blur"), tenth(100).alias("noise"))
    return tokens.quality_actions(images).select("event_id", F.array_join("actions", "|").alias("actions"))


@query(with_(corpus.DUCK_TOKENS) + "SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, x1, ord) AS place FROM tokens")
def srt_06_reading_order(spark, sf_dir):
    from pyspark.sql import Window

    return corpus.tokens(spark, sf_dir).select("doc_id", "page", "ord", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y1", "x1", "ord")).cast("bigint").alias("place"))


# Store and state.
@query(with_(_AUD) + "SELECT id, event_type, logged_at, (SELECT count(*) FROM audit) AS total FROM audit ORDER BY logged_at, id LIMIT 100")
def srt_03_audit_page(spark, sf_dir):
    log = corpus.audit(spark, sf_dir)
    first = store.page(log.select("id", "event_type", "logged_at"), [F.col("logged_at"), F.col("id")], 100)
    return first.select("*", log.agg(F.count("*").alias("n")).scalar().alias("total"))


@query("SELECT n_name, n_nationkey FROM nation")
def srt_04_order_by(spark, sf_dir):
    return store.order_by(_table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_name DESC")


@query(with_(corpus.DUCK_TASKS) + "SELECT task_id, status, created_at FROM tasks ORDER BY created_at DESC, task_id LIMIT 1000")
def srt_09_newest(spark, sf_dir):
    return store.page(corpus.tasks(spark, sf_dir).select("task_id", "status", "created_at"), [F.desc("created_at"), F.col("task_id")], 1000)


@query(with_(corpus.DUCK_TASKS) + "SELECT task_id, status FROM tasks WHERE status <> 'failed'")
def snk_14_delete(spark, sf_dir):
    return corpus.tasks(spark, sf_dir).where("status <> 'failed'").select("task_id", "status")


@query("SELECT count(*) FILTER (s_suppkey % 7 = 0) AS need, count(*) FILTER (s_suppkey % 7 = 0 AND s_acctbal > 0) AS have, count(*) FILTER (NOT s_acctbal > 0) AS gone, CASE WHEN count(*) FILTER (s_suppkey % 7 = 0) > 0 AND count(*) FILTER (s_suppkey % 7 = 0 AND s_acctbal > 0) = 0 THEN 'unhealthy' WHEN count(*) FILTER (NOT s_acctbal > 0) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM supplier")
def agg_11_health(spark, sf_dir):
    return store.health(_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 7 == 0).alias("critical"), (F.col("s_acctbal") > 0).alias("available")))


@query(with_(corpus.DUCK_TASKS) + "SELECT task_id, created_at FROM tasks WHERE created_at >= (SELECT max(created_at) - INTERVAL 1 HOUR FROM tasks)")
def str_02_ttl(spark, sf_dir):
    table = corpus.tasks(spark, sf_dir).select("task_id", "created_at")
    return store.expire(table, "created_at", table.agg(F.max("created_at") - F.expr("interval 3600 seconds")).scalar())


@query("SELECT event_id // 100 AS batch_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1")
def str_03_progress(spark, sf_dir):
    number = F.floor(F.substring("task_id", 2, 20).cast("bigint") / 100)
    return state.batch_progress(corpus.tasks(spark, sf_dir).withColumn("batch_id", number))


@query("SELECT event_id // 5 AS operation_id, arg_max(event_type, event_id) AS status, arg_max(props, event_id) AS last, max(event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY 1")
def str_06_trail(spark, sf_dir):
    steps = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("operation_id"), F.col("event_type").alias("step"), F.col("event_id").alias("at"), F.create_map(F.lit("last"), F.col("props"), F.concat(F.lit("at-"), "event_type"), F.col("event_id").cast("string")).alias("details"))
    return state.trail(steps).select("operation_id", "status", F.try_element_at("details", F.lit("last")).alias("last"), F.try_element_at("details", F.lit("at-click")).cast("bigint").alias("click"))


@query(with_(corpus.DUCK_SHEETS) + "SELECT sheet, in_a, in_b, CASE WHEN in_a AND in_b THEN 'matched' WHEN in_a THEN 'only_in_a' ELSE 'only_in_b' END AS status, CAST(row_number() OVER (ORDER BY NOT in_a, CASE WHEN in_a THEN no_a ELSE no_b END, sheet) AS INTEGER) AS place FROM (SELECT sheet, bool_or(book = 'a') AS in_a, bool_or(book = 'b') AS in_b, min(sheet_no) FILTER (book = 'a') AS no_a, min(sheet_no) FILTER (book = 'b') AS no_b FROM cells GROUP BY sheet)")
def jn_07_sheets(spark, sf_dir):
    return sheets.sheet_presence(corpus.sheet_cells(spark, sf_dir))


# Files written from the tables and read again.
@query(with_(corpus.DUCK_SHEETS) + """, placed AS (
  SELECT book || '-' || split_part(sheet, '-', 2) AS path, sheet, dense_rank() OVER (PARTITION BY book, sheet ORDER BY row) + 1 AS row, col, value FROM cells WHERE sheet NOT LIKE 'S6-%'
  UNION ALL SELECT DISTINCT book || '-' || split_part(sheet, '-', 2), sheet, 1, col, header FROM cells WHERE sheet NOT LIKE 'S6-%')
SELECT path, sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value FROM placed""")
def src_10_xlsx(spark, sf_dir):
    """Workbooks of eight sheets, one of them hidden; their empty cells are not in the files."""
    cells = corpus.sheet_cells(spark, sf_dir).withColumn("book", F.concat_ws("-", "book", F.substring_index("sheet", "-", -1)))
    rows = cells.withColumn("row", (F.dense_rank().over(Window.partitionBy("book", "sheet").orderBy("row")) + 1).cast("bigint"))
    heads = cells.select("book", "sheet", "sheet_no", F.lit(1).cast("bigint").alias("row"), "col", F.col("header").alias("value")).distinct()
    every = rows.select(*heads.columns).unionByName(heads).withColumn("hidden", F.startswith("sheet", F.lit("S6-")))
    return files.read_xlsx(render.render_workbooks(every).withColumnRenamed("book", "path"))


@query(with_(C) + """SELECT pair_id || '.docx' AS path, raw_text || chr(10) || '编号 HT-' || pair_id || chr(10) || '备注 ' AS full_text, CAST(len(string_split(raw_text, chr(10))) AS INTEGER) AS n_paragraphs FROM contracts WHERE side = 'word'""")
def src_01_docx(spark, sf_dir):
    """Word files with what tracked changes deleted in every third paragraph, and a table."""
    contracts = corpus.contracts(spark, sf_dir).where("side = 'word'")
    run = lambda text, gone: F.struct(text.alias("text"), F.lit(gone).alias("deleted"))
    paragraph = lambda line, k: F.when(k % 3 == 2, F.array(run(F.lit("删除<甲>"), True), run(line, False))).otherwise(F.array(run(line, False)))
    rows = F.array(F.array(F.lit("编号"), F.concat(F.lit("HT-"), "pair_id")), F.array(F.lit("备注"), F.lit("")))
    docs = contracts.select(F.concat("pair_id", F.lit(".docx")).alias("path"), F.transform(F.split("text", "\n", -1), paragraph).alias("paragraphs"), rows.alias("rows"))
    return files.read_docx(render.render_documents(docs)).select("path", "full_text", F.size("paragraphs").alias("n_paragraphs"))


_KINDS = "CASE event_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' ELSE '.tiff.pdf' END"


@query(f"SELECT event_id, 'in/' || event_id || {_KINDS} AS path FROM events WHERE event_id % 4 < 2")
def src_09_images(spark, sf_dir):
    return files.images(_table(spark, sf_dir, "events").select("event_id", F.expr(f"'in/' || event_id || {_KINDS}").alias("path")))


_TWO_WORDS = "[string_split(text, ' ')[2], string_split(text, ' ')[5]]"
_MARKED = f"list_reduce({_TWO_WORDS}, lambda a, t: CASE WHEN t <> '' AND strpos(a, t) > 0 THEN left(a, strpos(a, t) - 1) || chr(57344) || '1' || t || chr(57344) || '0' || substr(a, strpos(a, t) + length(t)) ELSE a END, text)"


@query(f"SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS n, CASE WHEN starts_with(unnest(p), '1') THEN 'hit' ELSE 'normal' END AS mode, substr(unnest(p), 2) AS text FROM (SELECT doc_id, list_filter(string_split('0' || {_MARKED}, chr(57344)), lambda x: length(x) > 1) AS p FROM documents)")
def fn_55_segments(spark, sf_dir):
    words = F.split("text", " ", -1)
    found = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(report.segments(F.col("text"), F.array(F.get(words, 1), F.get(words, 4)), "hit")).alias("n", "s"))
    return found.select("doc_id", "n", "s.mode", "s.text")


@query()
def snk_09_cards(spark, sf_dir):
    return report.html_cards(fn_73_text_diff(spark, sf_dir))


@query(with_(*ITEMS) + "SELECT pair_id, family, count(*) AS n FROM detailed WHERE direction <> 'matched' GROUP BY pair_id, family")
def snk_05_summary(spark, sf_dir):
    return report.difference_tables(_items(spark, sf_dir))["summary"]


@query("WITH " + corpus.DUCK_TASKS + """, t AS (SELECT CAST(user_id AS VARCHAR) AS task_id, status, epoch_us(created_at) // 1000 AS ms FROM tasks),
s AS (SELECT *, coalesce(lead(ms) OVER (PARTITION BY task_id ORDER BY ms, status), (SELECT max(ms) FROM t) + 86400000) AS after FROM t)
SELECT task_id, status, ms AS last_ms, ms + 21600000 AS expired_ms FROM s WHERE after - ms >= 21600000""")
def str_02_expiries(spark, sf_dir):
    changes = corpus.tasks(spark, sf_dir).select(F.col("user_id").alias("task_id"), "status", F.col("created_at").cast("timestamp").alias("changed_at"))
    return state.expiries_batch(changes, 6 * 3600, changes.agg(F.max("changed_at") + F.expr("interval 1 day")).scalar())


@query(ORACLES["jn_15_construction_fields"].replace(_FIELDS("construction"), _FIELDS("general")))
def jn_15_general_fields(spark, sf_dir):
    return tokens.keyword_hits(corpus.tokens(spark, sf_dir), "general")


@query(ORACLES["jn_15_construction_fields"].replace(_FIELDS("construction"), _FIELDS("procurement")))
def jn_15_procurement_fields(spark, sf_dir):
    return tokens.keyword_hits(corpus.tokens(spark, sf_dir), "procurement")


@query(ORACLES["jn_15_construction_fields"].replace(_FIELDS("construction"), _FIELDS("labor")))
def jn_15_labor_fields(spark, sf_dir):
    return tokens.keyword_hits(corpus.tokens(spark, sf_dir), "labor")
