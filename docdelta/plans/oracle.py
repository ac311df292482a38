"""SQL twins of the queries, for the comparison with another engine."""

from __future__ import annotations

import re

from ..functions import vocab as V
from .corpus import DUCK_CONTRACTS, DUCK_SHEETS, DUCK_TASKS, DUCK_TOKENS

NUM = V.NUMBER
_HAN = "[一-鿿]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def spans(rx: str, groups: int = 0, src: str = "docs", keys: str = "pair_id, side") -> str:
    """Rows (keys, text, n, raw, st, en, g1...) of all matches: pieces and matches give the places by running sums."""
    g = "".join(f", regexp_extract_all(text, {q(rx)}, {k}) AS g{k}" for k in range(1, groups + 1))
    lists = "".join(f", unnest(g{k}) AS g{k}" for k in range(1, groups + 1))
    names = "".join(f", g{k}" for k in range(1, groups + 1))
    return f"""(SELECT *, st + length(raw) AS en FROM (
      SELECT {keys}, text, n, raw{names}, CAST(sum(length(piece) + length(raw)) OVER (PARTITION BY {keys} ORDER BY n) - length(raw) AS BIGINT) AS st
      FROM (SELECT {keys}, text, unnest(range(len(m))) AS n, unnest(m) AS raw, unnest(p[1:len(m)]) AS piece{lists} FROM (SELECT {keys}, text, regexp_extract_all(text, {q(rx)}) AS m, string_split_regex(text, {q(rx)}) AS p{g} FROM {src}))))"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def around(left: int, right: int) -> str:
    return strip(f"substr(text, greatest(st - {left}, 0) + 1, en + {right} - greatest(st - {left}, 0))")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


C = DUCK_CONTRACTS
_PREV, _NEXT, _NEXT2 = "CASE WHEN st > 0 THEN substr(text, st, 1) ELSE '' END", "substr(text, en + 1, 1)", "substr(text, en + 1, 2)"
_VAL = "CAST(replace(raw, ',', '') AS DOUBLE)"
_LEN = "length(translate(raw, ',.', ''))"
_PART, _WHOLE = "CASE WHEN contains(raw, '.') THEN split_part(raw, '.', 2) ELSE '' END", "replace(split_part(raw, '.', 1), ',', '')"
NUMBERS = f"""numbers AS (SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY n) - 1 AS INTEGER) AS ord, raw, {_VAL} AS value, {around(30, 30)} AS context
  FROM (SELECT *, {_PREV} AS prev, {_NEXT} AS nxt, {_NEXT2} AS nx2, {_PART} AS part, {_WHOLE} AS whole FROM {spans(NUM)})
  WHERE {_LEN} BETWEEN 3 AND 12 AND NOT regexp_matches(prev || nxt, '[A-Za-z]') AND NOT ({_VAL} = 1.0 AND contains(raw, '.'))
    AND NOT (prev = '第' AND regexp_matches(nx2, '[条款项]')) AND prev NOT IN ('附', '图', '表', '章', '节', '号') AND NOT (nxt IN ('号', '条') AND prev IN ('第', '条'))
    AND NOT (length(part) = 1 AND length(whole) <= 2 AND {_VAL} < 10))"""


def norm_date(x: str) -> str:
    flat = f"regexp_replace(regexp_replace(regexp_replace({x}, '[年/.月]', '-', 'g'), '[日号]', '', 'g'), '^-+|-+$', '', 'g')"
    z = lambda p: f"CASE WHEN length({p}) < 2 THEN lpad({p}, 2, '0') ELSE {p} END"
    return f"CASE WHEN len(string_split({flat}, '-')) = 3 THEN split_part({flat}, '-', 1) || '-' || {z(f'split_part({flat}, {q(chr(45))}, 2)')} || '-' || {z(f'split_part({flat}, {q(chr(45))}, 3)')} END"


DATES = (
    "dates AS (SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY shape, n) - 1 AS INTEGER) AS ord, raw, norm FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side, norm ORDER BY shape, n) AS r FROM ("
    + " UNION ALL ".join(f"SELECT pair_id, side, {k} AS shape, n, raw, {norm_date('raw')} AS norm FROM {spans(p)}" for k, p in enumerate(V.DATE_PATTERNS))
    + ") WHERE norm IS NOT NULL) WHERE r = 1)"
)
AMOUNT_WORDS = f"""amount_words AS (SELECT pair_id, side, CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY n) - 1 AS INTEGER) AS ord, raw FROM {spans(V.AMOUNT_WORDS)}
  WHERE length(raw) >= 4 AND regexp_matches(raw, '[元圆]') AND NOT starts_with(raw, '零') AND NOT contains(raw, '零零零') AND regexp_matches(raw, '[壹贰叁肆伍陆柒捌玖拾佰仟万亿]'))"""
PERCENTAGES = f"percentages AS (SELECT pair_id, side, CAST(n AS INTEGER) AS ord, raw, CAST(g1 AS DOUBLE) / 100 AS value FROM {spans(chr(40) + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?)%', 1)})"

_KW = "|".join(re.escape(k) for k in V.AMOUNT_KEYWORDS)
_SHAPES = [rf"({_KW})\s*为\s*[¥＄$]?\s*({NUM})\s*元", rf"(人民币)\s*({NUM})\s*元", rf"(RMB)\s*({NUM})", rf"({_KW})\s*({NUM})\s*元", rf"([¥＄$])\s*({NUM})", rf"({_KW})\s*[:：]?\s+({NUM})"]
_HEAD = strip("substr(text, greatest(st - 30, 0) + 1, st - greatest(st - 30, 0))")
_LABEL = f"coalesce(nullif(regexp_extract({_HEAD}, '({_HAN}*(?:费用|金额|总价|总额|合计|包干){_HAN}*)$', 1), ''), nullif(regexp_extract({_HEAD}, '({_HAN}+)$', 1), ''), g1)"
_STRUCT = "STRUCT(shape INTEGER, st BIGINT, en BIGINT, raw VARCHAR, keyword VARCHAR, context VARCHAR)"
AMOUNTS = (
    f"cand AS (SELECT pair_id, side, list(CAST({{'shape': shape, 'st': st, 'en': en, 'raw': g2, 'keyword': keyword, 'context': context}} AS {_STRUCT}) ORDER BY shape, n) AS cs FROM ("
    + " UNION ALL ".join(f"SELECT pair_id, side, {k} AS shape, n, st, en, g2, {_LABEL if k == 4 else 'g1'} AS keyword, {around(50 if k == 4 else 30, 20)} AS context FROM {spans(p, 2)}" for k, p in enumerate(_SHAPES))
    + f""") WHERE length(translate(g2, ',.', '')) BETWEEN 3 AND 12 AND CAST(translate(g2, ',.', '') AS DOUBLE) >= 100 GROUP BY pair_id, side),
  kept AS (SELECT pair_id, side, list_reduce(cs, lambda a, s: CASE WHEN len(list_filter(a, lambda k: s.st < k.en AND s.en > k.st)) > 0 THEN a ELSE list_append(a, s) END, CAST([] AS {_STRUCT}[])) AS ks FROM cand),
  amounts AS (SELECT pair_id, side, CAST(i - 1 AS INTEGER) AS ord, ks[i].shape AS shape, ks[i].raw AS raw, CAST(replace(ks[i].raw, ',', '') AS DOUBLE) AS value, ks[i].keyword AS keyword, ks[i].context AS context FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM kept))"""
)


def set_match(table: str, value: str) -> str:
    return f"""SELECT pair_id, CASE WHEN side = 'pdf' THEN 'extra_in_pdf' WHEN ({value} IN (SELECT {value} FROM {table} o WHERE o.pair_id = t.pair_id AND o.side = 'pdf')) THEN 'matched' ELSE 'missing_in_pdf' END AS direction, ord, {value} AS value
      FROM {table} t WHERE side = 'word' OR NOT EXISTS (SELECT 1 FROM {table} o WHERE o.pair_id = t.pair_id AND o.side = 'word' AND o.{value} = t.{value})"""


TOLERANCE = """SELECT w.pair_id, CASE WHEN min(p.ord) IS NULL THEN 'missing_in_pdf' ELSE 'matched' END AS direction, w.ord, w.value, arg_min(p.value, p.ord) AS other
  FROM percentages w LEFT JOIN percentages p ON w.pair_id = p.pair_id AND p.side = 'pdf' AND abs(w.value - p.value) < 0.001 WHERE w.side = 'word' GROUP BY w.pair_id, w.ord, w.value
  UNION ALL SELECT pair_id, 'extra_in_pdf', ord, value, NULL FROM percentages p WHERE side = 'pdf' AND NOT EXISTS (SELECT 1 FROM percentages w WHERE w.pair_id = p.pair_id AND w.side = 'word' AND abs(w.value - p.value) < 0.001)"""


def greedy(table: str, extra: str, kinds: str, accept: str) -> str:
    """The first free item that fits, folded over the word items of a pair."""
    item = f"STRUCT(ord INTEGER, raw VARCHAR, value DOUBLE, {kinds})"
    out = "STRUCT(direction VARCHAR, ord INTEGER, raw VARCHAR, other VARCHAR)"
    hit = f"list_filter(a.free, lambda o: {accept})[1]"
    side = lambda s: f"coalesce(list(CAST({{'ord': ord, 'raw': raw, 'value': value, {extra}}} AS {item}) ORDER BY ord) FILTER (side = '{s}'), CAST([] AS {item}[]))"
    return f"""SELECT pair_id, u.direction AS direction, u.ord AS ord, u.raw AS raw, u.other AS other FROM (
      SELECT pair_id, unnest(list_concat(r.out, list_transform(r.free, lambda f: CAST({{'direction': 'extra_in_pdf', 'ord': f.ord, 'raw': f.raw, 'other': NULL}} AS {out})))) AS u FROM (
        SELECT pair_id, list_reduce(w, lambda a, x: list_transform([{hit}], lambda h: CASE WHEN h IS NULL
            THEN {{'free': a.free, 'out': list_append(a.out, CAST({{'direction': 'missing_in_pdf', 'ord': x.ord, 'raw': x.raw, 'other': NULL}} AS {out}))}}
            ELSE {{'free': list_filter(a.free, lambda f: f.ord <> h.ord), 'out': list_append(a.out, CAST({{'direction': 'matched', 'ord': x.ord, 'raw': x.raw, 'other': h.raw}} AS {out}))}} END)[1],
          {{'free': p, 'out': CAST([] AS {out}[])}}) AS r
        FROM (SELECT pair_id, {side('word')} AS w, {side('pdf')} AS p FROM {table} GROUP BY pair_id)))"""


_CLOSE = "abs(x.value - o.value) <= greatest(0.00001 * greatest(abs(x.value), abs(o.value)), 0.01)"
MATCH_NUMBERS = greedy("numbers", f"'runs': regexp_extract_all(context, '{_HAN}{{2,}}')", "runs VARCHAR[]", f"x.value = o.value OR ({_CLOSE} AND list_has_any(x.runs, o.runs))")
_BARE = lambda x: f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_一-鿿]', '', 'g'))"
MATCH_AMOUNTS = greedy("amounts", f"'kw': {_BARE('keyword')}, 'ctx': list_filter({words(V.AMOUNT_CONTEXT)}, lambda k: contains({_BARE('context')}, k))", "kw VARCHAR, ctx VARCHAR[]", f"(x.kw <> '' AND x.kw = o.kw AND {_CLOSE}) OR (x.value = o.value AND list_has_any(x.ctx, o.ctx))")

SECTIONS = f"""sections AS (
  SELECT pair_id, 'numbers' AS family, direction, raw FROM ({MATCH_NUMBERS}) UNION ALL SELECT pair_id, 'dates', direction, value FROM ({set_match('dates', 'norm')})
  UNION ALL SELECT pair_id, 'amounts_words', direction, value FROM ({set_match('amount_words', 'raw')}) UNION ALL SELECT pair_id, 'amounts_digits', direction, raw FROM ({MATCH_AMOUNTS})
  UNION ALL SELECT pair_id, 'percentages', direction, CAST(value AS VARCHAR) FROM ({TOLERANCE}))"""
ALL = (C, NUMBERS, DATES, AMOUNT_WORDS, AMOUNTS, PERCENTAGES, SECTIONS)
_LEGAL = " UNION ALL ".join(f"SELECT pair_id, side, {i} AS k, {q(c)} AS category, n, raw, {around(40, 40)} AS context FROM {spans(w)}" for i, (c, w) in enumerate((c, w) for c, ws in V.LEGAL_TERMS.items() for w in ws))
_TERMS = " UNION ALL ".join(f"SELECT pair_id, side, {i} AS k, {q(c)} AS term_type, n, raw, regexp_replace(g1, '^[.,;；:： ]+|[.,;；:： ]+$', '', 'g') AS norm FROM {spans(w + r'\s*[:：]?\s*([^' + chr(92) + 'n' + chr(92) + r'r。；;\.]{1,60})', 1)}" for i, (c, w) in enumerate((c, w) for c, ws in V.DURATION_TERMS.items() for w in ws))
_PARTIES = [rf"({V.PARTY})\s*[）)]?\s*[:：]\s*({V.ORGANISATION})", rf"({V.PARTY})[（(]\s*({V.ORGANISATION})[）)]", rf"({V.PARTY})\s+({V.ORGANISATION})"]
_PARTY_ROWS = " UNION ALL ".join(f"SELECT pair_id, side, {k} AS shape, n, raw, g1 AS party, {strip('g2')} AS name FROM {spans(p, 2)}" for k, p in enumerate(_PARTIES))
_ORD = "CAST(row_number() OVER (PARTITION BY pair_id, side ORDER BY {}) - 1 AS INTEGER) AS ord"
_RISK = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.FAMILY_RISK.items()) + " END"
_CLASS = f"CASE WHEN regexp_matches(line, '[0-9]') THEN 'high/number' WHEN regexp_matches(line, {q('|'.join(V.DIFF_LEGAL_WORDS))}) THEN 'high/keyword' WHEN regexp_matches(line, '^[\\s_]*[^\\p{{L}}\\p{{N}}]+$') THEN 'low/text' ELSE 'medium/text' END"

# Sheets.
_CELLNUM = lambda x: f"CASE WHEN ends_with(trim({x}), '%') THEN TRY_CAST(regexp_replace(replace(trim({x}), ',', ''), '[¥￥$€%]', '', 'g') AS DOUBLE) / 100 ELSE TRY_CAST(regexp_replace(replace(trim({x}), ',', ''), '[¥￥$€]', '', 'g') AS DOUBLE) END"
_CELL = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_HAS = lambda x, ws: f"regexp_matches(lower({x}), {q('|'.join(ws))})"
_DATEISH = lambda x: f"regexp_matches(trim({x}), '^(?:\\d{{4}}[-/.年]\\d{{1,2}}[-/.月]\\d{{1,2}}[日号]?|\\d{{4}}年\\s*\\d{{1,2}}月\\s*\\d{{1,2}}日|\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{2,4}})$')"
_NORM_HEADER = lambda x: f"lower(regexp_replace({x}, '[\\s\\-_·•:：()（）\\[\\]【】]', '', 'g'))"
_COLUMNS = f"""heads AS (SELECT DISTINCT book, sheet, col, header FROM cells),
  cmap AS MATERIALIZED (SELECT a.sheet, a.col AS col_a, b.col AS col_b, a.header AS name FROM heads a JOIN heads b ON a.book = 'a' AND b.book = 'b' AND a.sheet = b.sheet AND {_NORM_HEADER('a.header')} = {_NORM_HEADER('b.header')})"""
_HELD = lambda x: f"({x} <> '' AND NOT regexp_matches({x}, '{V.ZERO}'))"
_KEYED = _COLUMNS + """,
  keyed AS (SELECT c.book, c.sheet, c.row, trim(c.value) AS key, row_number() OVER (PARTITION BY c.book, c.sheet, trim(c.value) ORDER BY c.row) AS nth FROM cells c JOIN cmap m ON c.sheet = m.sheet AND @KEY AND c.col = CASE WHEN c.book = 'a' THEN m.col_a ELSE m.col_b END WHERE trim(c.value) <> ''),
  met AS MATERIALIZED (SELECT sheet, max(row) FILTER (book = 'a') AS row_a, max(row) FILTER (book = 'b') AS row_b FROM keyed GROUP BY sheet, key, nth),
  both_books AS (SELECT sheet FROM cells GROUP BY sheet HAVING count(DISTINCT book) = 2),
  held AS (SELECT DISTINCT book, sheet, row FROM cells JOIN both_books USING (sheet) WHERE @HELD),
  bare AS (SELECT h.* FROM held h LEFT JOIN keyed k ON k.book = h.book AND k.sheet = h.sheet AND k.row = h.row WHERE k.row IS NULL),
  alone AS (SELECT sheet, CASE WHEN book = 'a' THEN row END AS row_a, CASE WHEN book = 'b' THEN row END AS row_b FROM bare)""".replace("@HELD", _HELD("value"))
#: The given first column as the key, or what JN-12 chooses: a key column whose rows find partners, else the rows' numbers.
_BY_KEY = _KEYED.replace("@KEY", "m.col_a = 1") + ", pairs AS MATERIALIZED (SELECT * FROM met UNION ALL SELECT * FROM alone)"
_MATCH = f"kcols AS (SELECT sheet, col FROM cells WHERE book = 'a' AND value <> '' AND {_HAS('header', [w.lower() for w in V.ID_HEADERS])} GROUP BY sheet, col HAVING count(DISTINCT value) / count(*) >= 0.8), " + _KEYED.replace("@KEY", "EXISTS (SELECT 1 FROM kcols k WHERE k.sheet = m.sheet AND k.col = m.col_a)") + """,
  works AS (SELECT DISTINCT sheet FROM met WHERE row_a IS NOT NULL AND row_b IS NOT NULL),
  placed AS (SELECT sheet, row, max(CASE WHEN book = 'a' THEN row END) AS row_a, max(CASE WHEN book = 'b' THEN row END) AS row_b FROM held WHERE sheet NOT IN (SELECT sheet FROM works) GROUP BY sheet, row),
  pairs AS MATERIALIZED (SELECT sheet, row_a, row_b, 'key' AS how FROM met WHERE sheet IN (SELECT sheet FROM works) UNION ALL SELECT sheet, row_a, row_b, 'key' FROM alone WHERE sheet IN (SELECT sheet FROM works) UNION ALL SELECT sheet, row_a, row_b, 'position' FROM placed)"""
_DIFFS = f"""ca AS MATERIALIZED (SELECT c.sheet, c.row, c.col, c.header, c.value, m.col_b FROM cells c JOIN cmap m ON c.book = 'a' AND m.sheet = c.sheet AND m.col_a = c.col),
  pa AS MATERIALIZED (SELECT a.*, p.row_b FROM pairs p JOIN ca a ON a.sheet = p.sheet AND a.row = p.row_a),
  pb AS MATERIALIZED (SELECT a.sheet, a.row AS row_a, a.col, a.header, a.value AS value_a, b.value AS value_b FROM pa a JOIN (SELECT sheet || '/' || row || '/' || col AS spot, value FROM cells WHERE book = 'b') b ON a.sheet || '/' || a.row_b || '/' || a.col_b = b.spot),
  diffs AS (SELECT *, CASE WHEN category = 'date' OR (category = 'number' AND {_HAS('col_name', V.FINANCIAL_HEADERS)}) THEN 'high' ELSE 'medium' END AS risk FROM (
    SELECT sheet, row_a AS row, col, header AS col_name, value_a, value_b,
      CASE WHEN {_HAS('header', V.DATE_HEADERS)} AND ({_DATEISH('value_a')} OR {_DATEISH('value_b')}) THEN 'date'
        WHEN ({_CELLNUM('value_a')}) IS NOT NULL AND ({_CELLNUM('value_b')}) IS NOT NULL THEN 'number'
        WHEN (({_CELLNUM('value_a')}) IS NOT NULL OR ({_CELLNUM('value_b')}) IS NOT NULL) AND {_HAS('header', V.FINANCIAL_HEADERS)} THEN 'number'
        WHEN starts_with(value_a, '=') OR starts_with(value_b, '=') THEN 'formula' ELSE 'text' END AS category
    FROM pb
    WHERE {_CELL('value_a')} <> {_CELL('value_b')} AND NOT coalesce(abs(({_CELLNUM('value_a')}) - ({_CELLNUM('value_b')})) <= 0.01, false)))"""
_LONE = "lone AS (SELECT sheet, CASE WHEN row_b IS NULL THEN 'row_deleted' ELSE 'row_added' END AS type, coalesce(row_a, row_b) AS row FROM pairs WHERE row_a IS NULL OR row_b IS NULL)"
S = (DUCK_SHEETS, _MATCH, _DIFFS, _LONE)
_STATS = "stats AS (SELECT sheet, count(*) FILTER (type = 'row_added') AS added, count(*) FILTER (type = 'row_deleted') AS deleted, count(*) FILTER (type = 'cell_changed') AS modified, bool_or(risk = 'high') AS has_high FROM (SELECT sheet, 'cell_changed' AS type, risk FROM diffs UNION ALL SELECT sheet, type, 'medium' FROM lone) GROUP BY sheet)"

# Tokens.
_LINES = """tol AS (SELECT doc_id, greatest(coalesce(avg(CASE WHEN y2 > y1 THEN y2 - y1 END), 20) * 0.5, 8) AS tolerance FROM tokens GROUP BY doc_id),
  stepped AS (SELECT t.*, CASE WHEN abs(y1 - lag(y1) OVER (PARTITION BY t.doc_id, page ORDER BY y1, ord)) > tolerance THEN 1 ELSE 0 END AS step FROM tokens t JOIN tol ON t.doc_id = tol.doc_id),
  lined AS (SELECT *, CAST(sum(step) OVER (PARTITION BY doc_id, page ORDER BY y1, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM stepped)"""
_LINE_TEXT = """gaps AS (SELECT *, lead(x1) OVER w - x2 AS gap, row_number() OVER w AS rank, count(*) OVER (PARTITION BY doc_id, page, line) AS k FROM lined WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x1, ord)),
  turned AS (SELECT *, CASE WHEN k >= 3 AND sum(CASE WHEN gap < -5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line) > (k - 1) * 0.6 THEN -rank ELSE rank END AS place FROM gaps),
  glued AS (SELECT doc_id, page, line, place, CASE WHEN lag(x2) OVER v IS NULL OR x1 - lag(x2) OVER v < greatest((lag(x2) OVER v - lag(x1) OVER v) / greatest(length(lag(text) OVER v), 1), 5) * 1.5 THEN '' ELSE ' ' END || text AS piece
    FROM turned WINDOW v AS (PARTITION BY doc_id, page, line ORDER BY place)),
  ltext AS (SELECT doc_id, page, line, string_agg(piece, '' ORDER BY place) AS text FROM glued GROUP BY doc_id, page, line)"""
_PAGES = "pages_ AS (SELECT doc_id, page, '--- 第 ' || page || ' 页 ---' || chr(10) || string_agg(text, chr(10) ORDER BY line) AS body FROM ltext GROUP BY doc_id, page), whole AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page) AS text FROM pages_ GROUP BY doc_id)"
_ADJ = """adj AS (SELECT doc_id, page, ord, arg_min(v, k) AS value, arg_min(c, k) AS value_confidence FROM (
    SELECT a.doc_id, a.page, a.ord, b.text AS v, b.confidence AS c, row_number() OVER (PARTITION BY a.doc_id, a.page, a.ord ORDER BY b.x1 - a.x2, b.y1, b.x1, b.ord) AS k
    FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord WHERE abs(b.y1 - a.y1) <= greatest((a.y2 - a.y1) * 0.5, 10) AND b.x1 - a.x2 >= 0 AND b.x1 - a.x2 < (a.y2 - a.y1) * 3) GROUP BY doc_id, page, ord)"""
T = (DUCK_TOKENS, _LINES, _LINE_TEXT, _PAGES)
_BK = q("|".join(re.escape(w) for w in V.BOOST_AMOUNT_WORDS))
_POS = "position(t.text IN w.text) - 1"
_BOOST = f"""SELECT t.doc_id, t.page, t.ord, t.text, CASE WHEN t.confidence < 0.8 AND r > 0 THEN least(t.confidence + r, 0.95) ELSE t.confidence END AS confidence FROM (
  SELECT t.*, greatest(
    CASE WHEN regexp_matches(t.text, {_BK}) OR regexp_matches(t.text, {q(V.BOOST_AMOUNT)}) THEN 0.15::DOUBLE ELSE 0 END,
    CASE WHEN {_POS} >= 0 AND (regexp_matches(substr(w.text, greatest({_POS} - 10, 0) + 1, {_POS} - greatest({_POS} - 10, 0)), {_BK}) OR regexp_matches(substr(w.text, {_POS} + length(t.text) + 1, 10), {_BK})) THEN 0.1::DOUBLE ELSE 0 END,
    CASE WHEN regexp_matches(t.text, '[年月日]') OR regexp_matches(t.text, {q(V.BOOST_DATE)}) THEN 0.15::DOUBLE ELSE 0 END,
    CASE WHEN {_POS} >= 0 AND regexp_matches(substr(w.text, greatest({_POS} - 15, 0) + 1, {_POS} + length(t.text) + 15 - greatest({_POS} - 15, 0)), {q(V.BOOST_DATE)}) THEN 0.1::DOUBLE ELSE 0 END,
    CASE WHEN regexp_matches(t.text, {q(V.BOOST_NUMBER)}) THEN 0.1::DOUBLE ELSE 0 END,
    CASE WHEN regexp_matches(t.text, {q(V.BOOST_PERCENT)}) THEN 0.1::DOUBLE ELSE 0 END) AS r
  FROM tokens t JOIN whole w ON t.doc_id = w.doc_id) t"""
_KW_G = words(V.INDUSTRY_KEYWORDS["general"] + V.INDUSTRY_KEYWORDS["construction"] + V.INDUSTRY_KEYWORDS["leasing"])
_OWN = strip("CASE WHEN regexp_extract(text, keyword || '" + chr(92) + "s*[：:=＝]" + chr(92) + "s*(.+)', 1) <> '' THEN regexp_extract(text, keyword || '" + chr(92) + "s*[：:=＝]" + chr(92) + "s*(.+)', 1) ELSE regexp_extract(text, keyword || '" + chr(92) + "s+(" + chr(92) + "S+)', 1) END")
#: The other engine's edit distance counts bytes: for it, the characters that matter become single bytes that occur nowhere.
_BYTES = [chr(k) for k in (*range(1, 9), *range(14, 32), *b"~`^|{}<>#*+;[]")]


def _single(x: str, industry: str) -> str:
    signs = sorted(set("".join(V.INDUSTRY_KEYWORDS[industry]) + "淮眼"))
    assert len(signs) <= len(_BYTES)
    return f"translate({x}, {q(''.join(signs))}, {q(''.join(_BYTES[: len(signs)]))})"


_BEST = "STRUCT(sure DOUBLE, value VARCHAR, claim DOUBLE)"
_FIELDS = lambda industry: f"""SELECT doc_id, keyword, b.value AS value, round_even(b.sure, 4) AS confidence FROM (
  SELECT doc_id, keyword, list_reduce(hits, lambda a, h: CASE WHEN h.claim > a.sure THEN h ELSE a END, CAST({{'sure': 0, 'value': NULL, 'claim': 0}} AS {_BEST})) AS b FROM (
    SELECT doc_id, keyword, list(CAST({{'sure': sure, 'value': value, 'claim': CASE WHEN holds THEN sure ELSE confidence END}} AS {_BEST}) ORDER BY page, y1, x1, ord) AS hits FROM (
      SELECT t.doc_id, keyword, t.page, t.y1, t.x1, t.ord, holds, t.confidence, CASE WHEN own <> '' THEN own ELSE coalesce(a.value, '') END AS value,
        CASE WHEN own = '' AND a.value_confidence > 0 THEN (t.confidence + a.value_confidence) / 2 ELSE t.confidence * likeness END AS sure
      FROM (SELECT *, {_OWN} AS own FROM (
          SELECT *, contains(text, keyword) AS holds, CASE WHEN contains(text, keyword) THEN 1 ELSE 1 - levenshtein({_single('text', industry)}, {_single('keyword', industry)})::DOUBLE / greatest(length(text), length(keyword)) END AS likeness
          FROM (SELECT *, unnest({words(V.INDUSTRY_KEYWORDS[industry])}) AS keyword FROM tokens)) WHERE likeness >= 0.7) t
      LEFT JOIN adj a ON a.doc_id = t.doc_id AND a.page = t.page AND a.ord = t.ord) GROUP BY doc_id, keyword)) WHERE b.value IS NOT NULL"""  # noqa: E731

_AUD = "audit AS (SELECT event_id AS id, event_type, user_id, props AS details_json, ts AS logged_at, value FROM events)"
_MERGED = "ranges AS (SELECT book, sheet, row AS r0, row AS r1, 5 AS c0, 6 AS c1 FROM cells WHERE col = 1 AND row % 4 = 0)"

ORACLES: dict[str, str] = {
    "fn_73_sides": with_(C) + "SELECT pair_id, max(line) FILTER (side = 'word') AS word, max(line) FILTER (side = 'pdf') AS pdf FROM (SELECT pair_id, side, array_to_string(list_filter(list_transform(string_split(regexp_replace(raw_text, '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS line FROM contracts) GROUP BY pair_id",
    "fn_10_numbers": with_(C, NUMBERS) + "SELECT * FROM numbers",
    "fn_11_dates": with_(C, DATES) + "SELECT * FROM dates",
    "fn_12_amount_words": with_(C, AMOUNT_WORDS) + "SELECT * FROM amount_words",
    "fn_13_amounts": with_(C, AMOUNTS) + "SELECT * FROM amounts",
    "fn_14_percentages": with_(C, PERCENTAGES) + "SELECT * FROM percentages",
    "fn_15_parties": with_(C) + f"SELECT pair_id, side, {_ORD.format('shape, n')}, raw, party, name FROM ({_PARTY_ROWS}) r WHERE shape < 2 OR NOT EXISTS (SELECT 1 FROM ({_PARTY_ROWS}) e WHERE e.pair_id = r.pair_id AND e.side = r.side AND e.party = r.party AND e.name = r.name AND (e.shape, e.n) < (r.shape, r.n))",
    "fn_16_contract_numbers": with_(C) + f"SELECT pair_id, side, CAST(n AS INTEGER) AS ord, 0 AS shape, rtrim(raw, '.') AS raw, rtrim(g1, '.') AS norm FROM {spans('合同编号' + chr(92) + 's*[:：]' + chr(92) + 's*([A-Za-z0-9' + chr(92) + '-_./]+)', 1)} WHERE length(rtrim(g1, '.')) >= 2",
    "fn_17_clauses": with_(C) + f"SELECT pair_id, side, CAST(n AS INTEGER) AS ord, raw, CASE WHEN contains(g1, '章') THEN '章' WHEN contains(g1, '节') THEN '节' ELSE '条' END AS clause_type, regexp_replace(g1, '[第条章节]', '', 'g') AS clause_num, {strip('g2')} AS title FROM {spans('(第[一二三四五六七八九十百千万' + chr(92) + 'd]+[条章节])' + chr(92) + 's*([^' + chr(92) + 'n' + chr(92) + 'r,，。.;；]{1,50})', 2)}",
    "fn_18_legal_terms": with_(C) + f"SELECT pair_id, side, {_ORD.format('length(raw) DESC, k, n')}, raw, category, context FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side, category, left(context, 20) ORDER BY length(raw) DESC, k, n) AS r FROM ({_LEGAL})) WHERE r = 1",
    "fn_19_contacts": with_(C) + f"""SELECT pair_id, side, {_ORD.format('shape, n')}, kind, raw, norm FROM (
      SELECT pair_id, side, 0 AS shape, n, 'mobile' AS kind, raw, raw AS norm FROM {spans('[0-9]+')} WHERE regexp_full_match(raw, '1[3-9][0-9]{{9}}')
      UNION ALL SELECT pair_id, side, 1, n, 'landline', raw, replace(raw, ' ', '-') FROM {spans('[0-9]+[- ][0-9]+')} WHERE regexp_full_match(raw, '[0-9]{{3,4}}[- ][0-9]{{7,8}}')
      UNION ALL SELECT pair_id, side, 2, n, 'email', raw, lower(raw) FROM {spans('[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+' + chr(92) + '.[a-zA-Z]{2,}')} WHERE NOT regexp_matches(raw, '^[0-9]+@[0-9]+'))""",
    "fn_19d_durations": with_(C) + f"SELECT pair_id, side, {_ORD.format('k, n')}, raw, term_type, norm FROM ({_TERMS}) WHERE norm <> ''",
    "jn_01_dates": with_(C, DATES) + set_match("dates", "norm"),
    "jn_02_amount_words": with_(C, AMOUNT_WORDS) + set_match("amount_words", "raw"),
    "jn_03_percentages": with_(C, PERCENTAGES) + TOLERANCE,
    "jn_04_numbers": with_(C, NUMBERS) + MATCH_NUMBERS,
    "jn_05_amounts": with_(C, AMOUNTS) + MATCH_AMOUNTS,
    "agg_01_contract_summary": with_(*ALL) + "SELECT pair_id, family, missing, extra, CAST(sum(missing + extra) OVER (PARTITION BY pair_id) AS BIGINT) AS total_diffs, bool_or(family IN ('amounts_words', 'amounts_digits')) OVER (PARTITION BY pair_id) AS has_critical_diff FROM (SELECT pair_id, family, count(*) FILTER (direction = 'missing_in_pdf') AS missing, count(*) FILTER (direction = 'extra_in_pdf') AS extra FROM sections GROUP BY pair_id, family) WHERE missing + extra > 0",
    "set_04_diff_items": with_(*ALL) + f"SELECT pair_id, family, direction, raw, {_RISK} AS risk FROM sections WHERE direction <> 'matched' AND family <> 'percentages'",
    "agg_02_risk_statistics": with_(*ALL) + f"SELECT pair_id, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low, count(*) FILTER (direction = 'missing_in_pdf') AS missing, count(*) FILTER (direction = 'extra_in_pdf') AS extra, count(*) AS total FROM (SELECT *, {_RISK} AS risk FROM sections WHERE direction <> 'matched') GROUP BY pair_id",
    "agg_09_kpi": with_(*ALL) + "SELECT count(*) FILTER (direction = 'matched') AS matched, count(*) FILTER (direction = 'missing_in_pdf' AND family IN ('amounts_digits', 'amounts_words')) AS amount_missing, count(*) FILTER (direction = 'missing_in_pdf' AND family IN ('dates', 'numbers')) AS other_missing FROM sections",
    "fn_38_diff_classes": with_(C) + f"""SELECT pair_id, side, CAST(i - 1 AS INTEGER) AS n, line, split_part({_CLASS}, '/', 1) AS risk, split_part({_CLASS}, '/', 2) AS category FROM (SELECT pair_id, side, l[i] AS line, i FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT pair_id, side, string_split(text, chr(10)) AS l FROM docs)))""",
    "agg_03_line_diff": with_(C) + f"""SELECT pair_id, count(*) AS total, count(*) FILTER (side = 'pdf') AS insertions, count(*) FILTER (side = 'word') AS deletions, bool_or({_CLASS} LIKE 'high%') AS has_risk FROM (
      SELECT pair_id, line, min(side) AS side FROM (SELECT DISTINCT pair_id, side, unnest(string_split(text, chr(10))) AS line FROM docs) GROUP BY pair_id, line HAVING count(*) = 1) GROUP BY pair_id""",
    "jn_09_row_match": with_(DUCK_SHEETS, _BY_KEY) + "SELECT * FROM pairs",
    "jn_08_columns": with_(DUCK_SHEETS, _COLUMNS) + "SELECT * FROM cmap",
    "jn_10_positions": with_(DUCK_SHEETS) + f"SELECT sheet, row FROM cells WHERE {_HELD('value')} GROUP BY sheet, row HAVING count(DISTINCT book) = 2",
    "jn_12_row_match": with_(DUCK_SHEETS, _MATCH) + "SELECT * FROM pairs",
    "jn_14_row_changes": with_(*S) + "SELECT * FROM lone",
    "fn_36_cell_diffs": with_(*S) + "SELECT sheet, row, col, col_name, value_a, value_b, category, risk FROM diffs",
    "agg_04_sheet_stats": with_(*S, _STATS) + "SELECT * FROM stats",
    "agg_05_workbook": with_(*S, _STATS) + "SELECT c.sheet, CASE WHEN n = 2 THEN 'matched' ELSE 'only_in_' || book END AS status, CASE WHEN n = 2 THEN coalesce(added + deleted + modified, 0) ELSE nrows + 1 END AS differences, n = 1 OR coalesce(has_high, false) AS critical FROM (SELECT sheet, count(DISTINCT book) AS n, min(book) AS book, count(DISTINCT row) AS nrows FROM cells GROUP BY sheet) c LEFT JOIN stats s ON s.sheet = c.sheet",
    "agg_06_key_columns": with_(DUCK_SHEETS) + f"SELECT sheet, col, header, count(*) AS n, count(DISTINCT value) AS n_distinct, {_HAS('header', [w.lower() for w in V.ID_HEADERS])} AND count(DISTINCT value) / count(*) >= 0.8 AS is_key FROM cells WHERE book = 'a' AND value <> '' GROUP BY sheet, col, header",
    "src_12_headers": with_(DUCK_SHEETS) + f"SELECT c.book, c.sheet, c.col, CASE WHEN value = '' THEN '列' || c.col ELSE value END AS header FROM cells c JOIN (SELECT book, sheet, min(row) AS row FROM cells WHERE {_HELD('value')} GROUP BY book, sheet) f ON c.book = f.book AND c.sheet = f.sheet AND c.row = f.row",
    "src_13_merged": with_(DUCK_SHEETS, _MERGED) + "SELECT c.book, c.sheet, c.row, c.col, coalesce(f.value, c.value) AS value FROM cells c LEFT JOIN ranges r ON c.book = r.book AND c.sheet = r.sheet AND c.row = r.r0 AND c.col BETWEEN r.c0 AND r.c1 LEFT JOIN cells f ON f.book = r.book AND f.sheet = r.sheet AND f.row = r.r0 AND f.col = r.c0",
    "src_14_book_text": with_(DUCK_SHEETS) + "SELECT book, string_agg('=== 工作表: ' || sheet || ' ===' || chr(10) || body, chr(10) || chr(10) ORDER BY no) AS full_text FROM (SELECT book || '-' || split_part(sheet, '-', 2) AS book, sheet, min(no) AS no, string_agg(line, chr(10) ORDER BY row) AS body FROM (SELECT book, sheet, min(sheet_no) AS no, row, '行' || row || ': ' || string_agg(header || ': ' || value, ' | ' ORDER BY col) AS line FROM cells WHERE value <> '' GROUP BY book, sheet, row) GROUP BY book, sheet) GROUP BY book",
    "src_14_row_text": with_(DUCK_SHEETS) + "SELECT book, sheet, row, '行' || row || ': ' || string_agg(header || ': ' || value, ' | ' ORDER BY col) AS line FROM cells WHERE value <> '' GROUP BY book, sheet, row",
    "flt_01_low_confidence": with_(DUCK_TOKENS) + "SELECT doc_id, page, ord, text, confidence FROM tokens WHERE confidence < 0.5",
    "agg_07_line_tolerance": with_(DUCK_TOKENS, _LINES) + "SELECT * FROM tol",
    "win_01_lines": with_(DUCK_TOKENS, _LINES) + "SELECT doc_id, page, ord, line FROM lined",
    "win_03_line_texts": with_(*T) + "SELECT * FROM ltext",
    "win_04_full_text": with_(*T) + "SELECT * FROM whole",
    "fn_46_boost": with_(*T) + _BOOST,
    "jn_16_adjacent": with_(DUCK_TOKENS, _ADJ) + "SELECT * FROM adj",
    "jn_15_construction_fields": with_(DUCK_TOKENS, _ADJ) + _FIELDS("construction"),
    "jn_15_leasing_fields": with_(DUCK_TOKENS, _ADJ) + _FIELDS("leasing"),
    "fn_02_diff_normalise": "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents",
    "fn_03_squeeze": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents",
    "fn_08_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages",
    "fn_24_numbers": "SELECT doc_id, unnest(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?')) AS raw FROM documents",
    "fn_53_sanitise": "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS text FROM documents",
    "fn_42_similarity": "SELECT a.n_nationkey AS a, b.n_nationkey AS b, 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "srt_01_task_page": with_(DUCK_TASKS) + "SELECT task_id, status, created_at FROM tasks ORDER BY created_at DESC, task_id LIMIT 50 OFFSET 20",
    "srt_02_newest_logs": with_(_AUD) + "SELECT id, event_type, logged_at FROM audit ORDER BY logged_at DESC, id LIMIT 100",
    "flt_03_equal": with_(DUCK_TASKS) + "SELECT task_id, status, user_id FROM tasks WHERE status = 'failed' AND word_file = 'w7.docx'",
    "flt_04_audit_window": with_(_AUD) + "SELECT id, event_type, user_id, logged_at FROM audit WHERE logged_at BETWEEN (SELECT min(logged_at) + INTERVAL 1 DAY FROM audit) AND (SELECT min(logged_at) + INTERVAL 5 DAY FROM audit) AND event_type = 'click'",
    "agg_08_progress": with_(DUCK_TASKS) + "SELECT user_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, round_even(count(*) FILTER (status = 'completed') / count(*) * 100, 1) AS percent FROM tasks GROUP BY user_id",
    "agg_10_trail": with_(DUCK_TASKS) + "SELECT count(*) AS total_operations, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS in_progress, (SELECT string_agg(task_id, ',' ORDER BY created_at, task_id) FROM (SELECT * FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 10)) AS recent FROM tasks",
    "win_07_history": with_(DUCK_TASKS) + "SELECT task_id, user_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id) AS r FROM tasks) WHERE r <= 10",
    "str_05_latest": with_(DUCK_TASKS) + "SELECT user_id, arg_max(status, (created_at, status, task_id)) AS status, arg_max(task_id, (created_at, status, task_id)) AS task_id FROM tasks GROUP BY user_id",
    "str_07_expiry": with_(DUCK_TASKS) + "SELECT task_id, created_at FROM tasks WHERE created_at >= (SELECT max(created_at) - INTERVAL 7 DAY FROM tasks)",
    "snk_12_upsert": with_(DUCK_TASKS) + "SELECT task_id, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status FROM tasks",
    "str_04_hourly": with_(_AUD) + "SELECT date_trunc('hour', logged_at) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM audit GROUP BY 1, 2",
    "set_01_sheet_names": "SELECT DISTINCT n_name AS name FROM nation UNION SELECT r_name FROM region",
    "fn_52_mask_counts": "SELECT count(*) FILTER (len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) > 0) AS docs_with_email, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}'))) AS BIGINT) AS emails FROM documents",
    "win_05_difference_ids": with_(*ALL) + "SELECT pair_id, CAST(count(*) AS INTEGER) AS last_id FROM sections WHERE direction <> 'matched' GROUP BY pair_id",
    "snk_08_sheet_report": with_(*S) + "SELECT left(sheet, 31) AS tab, row, col, col_name, value_a, value_b, CASE risk WHEN 'high' THEN '高风险' ELSE '中风险' END AS risk, category, CASE risk WHEN 'high' THEN 'D32F2F' ELSE 'F57C00' END AS colour FROM diffs",
}
_NORMS = {
    "numbers": ("fn_10_numbers", "raw"), "dates": ("fn_11_dates", "norm"), "amounts_words": ("fn_12_amount_words", "raw"), "amounts_digits": ("fn_13_amounts", "raw"), "percentages": ("fn_14_percentages", "raw"),
    "party_names": ("fn_15_parties", "name"), "contract_numbers": ("fn_16_contract_numbers", "norm"), "clauses": ("fn_17_clauses", "title"), "legal_terms": ("fn_18_legal_terms", "category"), "contact_info": ("fn_19_contacts", "norm"), "terms": ("fn_19d_durations", "norm"),
}
ORACLES["fn_23_extract_all"] = " UNION ALL ".join(f"SELECT side, '{family}' AS family, count(*) AS n, count(DISTINCT {norm}) AS n_distinct FROM ({ORACLES[name]}) GROUP BY side" for family, (name, norm) in _NORMS.items())
_LABELS = lambda x, labels: f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in labels.items()) + f" ELSE {x} END"
_PLACE = "list_position(['amounts_words', 'amounts_digits', 'dates', 'numbers', 'percentages'], family)"

# Reports: items with what belongs to them.
_ON = "ON t.pair_id = m.pair_id AND t.ord = m.ord AND t.side = CASE WHEN m.direction = 'extra_in_pdf' THEN 'pdf' ELSE 'word' END"
DETAILED = f"""detailed AS (
  SELECT m.pair_id, 'numbers' AS family, m.direction, m.ord, m.raw, t.context AS detail FROM ({MATCH_NUMBERS}) m JOIN numbers t {_ON}
  UNION ALL SELECT m.pair_id, 'dates', m.direction, m.ord, m.value, t.raw FROM ({set_match('dates', 'norm')}) m JOIN dates t {_ON}
  UNION ALL SELECT pair_id, 'amounts_words', direction, ord, value, NULL FROM ({set_match('amount_words', 'raw')})
  UNION ALL SELECT m.pair_id, 'amounts_digits', m.direction, m.ord, m.raw, t.keyword FROM ({MATCH_AMOUNTS}) m JOIN amounts t {_ON}
  UNION ALL SELECT m.pair_id, 'percentages', m.direction, m.ord, CAST(m.value AS VARCHAR), t.raw FROM ({TOLERANCE}) m JOIN percentages t {_ON}),
  files AS (SELECT o_orderkey AS pair_id, 'in/w' || o_orderkey || '.docx' AS word_file, 'in/p' || o_orderkey || '.pdf' AS pdf_file, o_orderdate AS made FROM orders)"""
ITEMS = (C, NUMBERS, DATES, AMOUNT_WORDS, AMOUNTS, PERCENTAGES, DETAILED)
_CRITICAL = "coalesce(bool_or(direction <> 'matched' AND family IN ('amounts_words', 'amounts_digits')), false)"
_REPORTED = [("numbers", "数字", "个"), ("dates", "日期", "个"), ("amounts_words", "大写金额", "个"), ("amounts_digits", "金额数字", "对"), ("percentages", "百分比", "个")]


def _report_line(family: str, side: str) -> str:
    return {
        "numbers": "raw || ' (上下文: ...' || detail || '...)'", "dates": f"'{side}: ' || detail || ' -> 标准化: ' || raw", "amounts_words": f"'{side}: ' || raw",
        "amounts_digits": f"'{side}: ' || detail || ' = ' || raw", "percentages": f"'{side}: ' || detail",
    }[family]


_WAYS = {"missing_in_pdf": ("缺失", "Word"), "extra_in_pdf": ("多出", "PDF")}
_LISTED = ", ".join(
    f"count(*) FILTER (family = '{f}' AND direction = 'matched') AS {f}_matched, "
    + ", ".join(f"string_agg('   * ' || {_report_line(f, side)}, chr(10) ORDER BY ord, {_report_line(f, side)}) FILTER (family = '{f}' AND direction = '{way}') AS {f}_{way}" for way, (_, side) in _WAYS.items())
    for f, *_ in _REPORTED
)


def _section(family: str, name: str, unit: str) -> str:
    parts = [f"'[DIFF] 扫描件{verb}{'金额' if family == 'amounts_digits' else name}:' || chr(10) || {family}_{way}" for way, (verb, _) in _WAYS.items()]
    same = f"'[OK] 所有{name}一致（共 ' || {family}_matched || ' {unit}）'"
    return f"'--- {name}比对 ---', CASE WHEN coalesce({', '.join(parts)}) IS NULL THEN {same} ELSE concat_ws(chr(10), {', '.join(parts)}) END, ''"


ORACLES["snk_01_text_report"] = with_(*ITEMS, "words AS" + DUCK_TOKENS.split("words AS", 1)[1]) + f"""
SELECT pair_id, concat_ws(chr(10), repeat('=', 60), '合同扫描件比对报告', repeat('=', 60), '比对时间: ' || strftime(made, '%Y-%m-%d %H:%M:%S'), 'Word 文档: w' || pair_id || '.docx', '扫描 PDF: p' || pair_id || '.pdf', '',
  '--- 比对摘要 ---', CASE WHEN n = 0 THEN '[OK] 所有关键字段一致，未发现差异' ELSE '[WARN] 发现 ' || n || ' 处差异' END, CASE WHEN critical THEN '[!!] 存在金额相关差异，请重点核查！' END, '', {', '.join(_section(*x) for x in _REPORTED)},
  CASE WHEN low IS NOT NULL THEN '--- 低置信度字段（需人工复核）---' || chr(10) || low || chr(10) END, repeat('=', 60), '总结: 发现 ' || n || ' 处差异', CASE WHEN critical THEN '建议: 金额相关差异需重点人工核查' END,
  CASE WHEN low IS NOT NULL THEN '另有 ' || n_low || ' 处低置信度字段需复核' END, repeat('=', 60)) AS report
FROM (SELECT f.pair_id, any_value(made) AS made, count(*) FILTER (direction <> 'matched') AS n, {_CRITICAL} AS critical, {_LISTED} FROM files f LEFT JOIN detailed d ON d.pair_id = f.pair_id GROUP BY f.pair_id) s
LEFT JOIN (SELECT doc_id, count(*) AS n_low, string_agg(line, chr(10) ORDER BY line) AS low FROM (SELECT doc_id, '   • "' || text || '" (置信度: ' || format('{{:.2f}}', confidence) || ', 页码: ' || page || ')' AS line FROM tokens WHERE confidence < 0.5) GROUP BY doc_id) l ON l.doc_id = s.pair_id"""

_RAWS = lambda f, way: f"coalesce(list(raw ORDER BY raw) FILTER (family = '{f}' AND direction = '{way}'), CAST([] AS VARCHAR[]))"
_DETAILS = ", ".join(f"'{f}': {{'matched': {_RAWS(f, 'matched')}, 'missing_in_pdf': {_RAWS(f, 'missing_in_pdf')}, 'extra_in_pdf': {_RAWS(f, 'extra_in_pdf')}, 'has_diff': coalesce(bool_or(family = '{f}' AND direction <> 'matched'), false)}}" for f, *_ in _REPORTED)
ORACLES["snk_02_full_json"] = with_(*ITEMS) + f"""SELECT f.pair_id, CAST(to_json({{'metadata': {{'timestamp': CAST(any_value(made) AS VARCHAR), 'word_file': any_value(word_file), 'pdf_file': any_value(pdf_file)}},
  'summary': {{'total_diffs': count(*) FILTER (direction <> 'matched'), 'has_critical_diff': {_CRITICAL}}}, 'details': {{{_DETAILS}}}, 'low_confidence_items': CAST([] AS VARCHAR[])}}) AS VARCHAR) AS payload
FROM files f LEFT JOIN detailed d ON d.pair_id = f.pair_id GROUP BY f.pair_id"""

_NUMBERED = f"""numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY {_PLACE}, list_position(['missing_in_pdf', 'extra_in_pdf'], direction), ord, raw) AS INTEGER) AS id, {_RISK} AS risk FROM detailed WHERE direction <> 'matched')"""
ORACLES["win_05_difference_ids"] = with_(*ITEMS, _NUMBERED) + "SELECT pair_id, id, family, direction, ord, raw FROM numbered"
_N = lambda column, values: "'{' || " + " || ',' || ".join(f"""'"{v}":' || count(*) FILTER ({column} = '{v}')""" for v in values) + " || '}'"
ORACLES["snk_03_json"] = with_(*ITEMS, _NUMBERED) + f"""SELECT n.pair_id, '{{"schema_version":"2.0","differences":' || to_json(list({{'id': id, 'category': family, 'category_label': {_LABELS('family', V.FAMILY_LABELS)}, 'risk_level': risk, 'direction': direction,
    'direction_label': {_LABELS('direction', V.DIRECTION_LABELS)}, 'value': CASE WHEN family IN ('dates', 'percentages') THEN detail ELSE raw END, 'keyword': CASE WHEN family = 'amounts_digits' THEN detail ELSE '' END,
    'context': CASE WHEN family = 'numbers' THEN detail ELSE '' END, 'normalized_value': CASE WHEN family = 'dates' THEN raw ELSE '' END}} ORDER BY id)) || ',"statistics":{{"total_differences":' || count(*) || ',"by_risk_level":' || {_N('risk', ['high', 'medium', 'low'])}
  || ',"by_category":' || any_value(c.categories) || ',"by_direction":' || {_N('direction', ['missing_in_pdf', 'extra_in_pdf'])} || '}}}}' AS payload
FROM numbered n JOIN (SELECT pair_id, '{{' || string_agg('"' || family || '":' || k, ',' ORDER BY list_position({words(list(V.FAMILY_LABELS))}, family)) || '}}' AS categories FROM (SELECT pair_id, family, count(*) AS k FROM numbered GROUP BY pair_id, family) GROUP BY pair_id) c ON c.pair_id = n.pair_id
GROUP BY n.pair_id"""


def _escaped(x: str) -> str:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {q(sign)}, '{code}')"
    return x


_SHOWN = "CASE WHEN family = 'dates' THEN detail ELSE raw END"
_LOST = "direction = 'missing_in_pdf' AND family IN ('amounts_digits', 'dates', 'numbers')"
_LOST_PLACE = "list_position(['amounts_digits', 'dates', 'numbers'], family)"
ORACLES["snk_11_html_report"] = with_(*ITEMS) + f"""
SELECT pair_id, '<!DOCTYPE html>' || chr(10) || '<html lang="zh-CN"><head><meta charset="UTF-8"><title>合同比对报告</title></head><body>' || chr(10) || '<h1>合同比对报告</h1>' || chr(10) || '<p>差异总数: ' || n || '</p>' || chr(10) || '<p>存在金额差异: ' || CASE WHEN critical THEN '是' ELSE '否' END
  || '</p>' || chr(10) || '<p>差异类型: ' || kinds || '</p>' || chr(10) || '<h2>差异明细</h2>' || chr(10) || '<table>' || chr(10) || '<tr><th>类型</th><th>Word 原文</th><th>PDF 扫描件</th><th>状态</th></tr>' || chr(10) || rows || chr(10) || '</table>' || chr(10) || '<div>'
  || array_to_string(list_transform(list_filter(string_split('0' || marked, chr(57344)), lambda p: length(p) > 1), lambda p: CASE WHEN starts_with(p, '1') THEN '<span class="diff">' || {_escaped('substr(p, 2)')} || '</span>' ELSE {_escaped('substr(p, 2)')} END), '')
  || '</div>' || chr(10) || '<div>' || {_escaped('pdf')} || '</div>' || chr(10) || '</body></html>' AS html
FROM (SELECT *, list_reduce(terms, lambda a, t: CASE WHEN strpos(a, t) > 0 THEN left(a, strpos(a, t) - 1) || chr(57344) || '1' || t || chr(57344) || '0' || substr(a, strpos(a, t) + length(t)) ELSE a END, word) AS marked FROM (
  SELECT t.pair_id, t.word, t.pdf, count(*) FILTER (direction <> 'matched') AS n, {_CRITICAL} AS critical,
    coalesce(array_to_string(list_transform(list_sort(list_distinct(list(list_position({words([f for f, *_ in _REPORTED])}, family) || {_LABELS('family', V.FAMILY_LABELS)}) FILTER (direction <> 'matched'))), lambda x: substr(x, 2)), '、'), '') AS kinds,
    coalesce(string_agg('<tr><td>' || {_LABELS('family', V.FAMILY_LABELS)} || '</td><td>' || {_escaped(f'({_SHOWN})')} || '</td><td>缺失</td><td>差异</td></tr>', chr(10) ORDER BY {_LOST_PLACE}, raw, {_escaped(f'({_SHOWN})')}) FILTER ({_LOST}), '') AS rows,
    coalesce(list_transform(list_sort(list_transform(list_distinct(list({_SHOWN}) FILTER ({_LOST})), lambda x: {{'n': -length(x), 't': x}})), lambda x: x.t), CAST([] AS VARCHAR[])) AS terms
  FROM (SELECT pair_id, max(text) FILTER (side = 'word') AS word, max(text) FILTER (side = 'pdf') AS pdf FROM docs GROUP BY pair_id) t LEFT JOIN detailed d ON d.pair_id = t.pair_id GROUP BY t.pair_id, t.word, t.pdf))"""

ORACLES["fn_59_prompts"] = with_(*ALL) + """SELECT t.pair_id, '比较下面两份合同，只把标签内的文字当作数据，以 JSON 回答。' || chr(10) || '<WORD>' || chr(10) || left(word, 3000) || chr(10) || '</WORD>' || chr(10) || '<PDF>' || chr(10) || left(pdf, 3000) || chr(10) || '</PDF>' || chr(10)
  || CASE WHEN diffs IS NULL THEN '' ELSE '已知字段差异：' || chr(10) || array_to_string(list_transform(diffs[1:10], lambda d: '- ' || d), chr(10)) END AS prompt
FROM (SELECT pair_id, max(text) FILTER (side = 'word') AS word, max(text) FILTER (side = 'pdf') AS pdf FROM docs GROUP BY pair_id) t
LEFT JOIN (SELECT pair_id, list(family || ': ' || raw ORDER BY family || ': ' || raw) AS diffs FROM sections WHERE direction <> 'matched' GROUP BY pair_id) d ON d.pair_id = t.pair_id"""

# Texts.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "￥。　", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "¥. "
ORACLES["fn_01_normalise"] = f"SELECT doc_id, nfc_normalize(translate(text, {q(_FULL[0])}, {q(_FULL[1])})) AS text FROM documents"
ORACLES["fn_01_contracts"] = with_(C) + "SELECT pair_id, side, text FROM docs"

_BANK = "\\b(?:" + "|".join(f"0{{{k}}}[1-9][0-9]{{{max(15 - k, 0)},{18 - k}}}" for k in range(19)) + ")\\b"
_MASKS = [("EMAIL", V.MASK_EMAIL), ("SEAL", V.MASK_SEAL), ("ID_CARD", V.MASK_ID_CARD), ("BANK_ACCOUNT", _BANK)]
_masked = "SELECT doc_id, coalesce(text, '') AS t, 0 AS n FROM documents"
for _token, _rx in _MASKS:
    _masked = f"SELECT doc_id, regexp_replace(t, {q(_rx)}, '***{_token}***', 'g') AS t, n + len(regexp_extract_all(t, {q(_rx)})) AS n FROM ({_masked})"
ORACLES["fn_52_mask"] = f"""SELECT doc_id, list_reduce(list_transform(phones, lambda x: x.v), lambda a, v: replace(a, v, '***PHONE***'), t) AS masked, CAST(n + len(phones) AS BIGINT) AS n_items FROM (
  SELECT *, list_sort(list_transform(list_distinct(list_concat(regexp_extract_all(t, {q(V.MASK_MOBILE)}), regexp_extract_all(regexp_replace(t, {q(V.MASK_MOBILE)}, '***PHONE***', 'g'), {q(V.MASK_LANDLINE)}))), lambda v: {{'n': -length(v), 'v': v}})) AS phones FROM ({_masked}))"""

_SWAP = {a: b for pair in V.LOOK_ALIKES for a, b in (pair, pair[::-1])}
_TWIN = f"translate(c, {q(''.join(_SWAP))}, {q(''.join(_SWAP.values()))})"
_fixed = "text"
for _wrong, _right in V.PHRASE_FIXES.items():
    _fixed = f"replace({_fixed}, {q(_wrong)}, {q(_right)})" if _wrong != _right else _fixed
_near = "substr(d.o, greatest(length(d.o) - 3, 0) + 1, 3) || substr(d.all, length(d.o) + 2, 3)"
_beside = "substr(d.o, greatest(length(d.o), 1), 1) || '|' || substr(d.all, length(d.o) + 2, 1)"
ORACLES["fn_47_post_correct"] = "WITH " + DUCK_TOKENS + f""", p AS (SELECT *, confidence >= 0.85 OR length(text) < 2 AS plain, {_fixed} AS phrases, regexp_matches(text, {q('|'.join(V.PHRASE_FIXES))}) AS direct FROM tokens),
s AS (SELECT *, CASE WHEN plain THEN text WHEN confidence < 0.6 THEN list_reduce(string_split(phrases, ''), lambda d, c: {{'o': d.o || CASE WHEN {_TWIN} <> c AND (regexp_matches({_near}, {q('|'.join(w.replace('$', chr(92) + '$') for w in V.CORRECTION_WORDS))}) OR regexp_matches({_beside}, '[0-9]')) THEN {_TWIN} ELSE c END, 'all': d.all}}, {{'o': '', 'all': phrases}}).o ELSE phrases END AS fresh FROM p)
SELECT doc_id, page, ord, fresh AS text, CASE WHEN plain THEN false ELSE direct OR fresh <> phrases END AS post_corrected FROM s"""

# Logs and limits.
ORACLES["snk_16_trail_export"] = "WITH " + DUCK_TASKS + """, r AS (SELECT *, row_number() OVER (ORDER BY task_id DESC, status DESC) = 1 AS last FROM tasks)
SELECT '{"exported_at":"2024-01-01T00:00:00","total_records":' || count(*) || ',"records":[' AS value FROM tasks UNION ALL SELECT ']}'
UNION ALL SELECT CAST(to_json({'task_id': task_id, 'status': status, 'user_id': user_id}) AS VARCHAR) || CASE WHEN last THEN '' ELSE ',' END FROM r"""
_KEPT = "list_filter(a.kept, lambda t: x - t < 60)"
ORACLES["str_01_rate_limit"] = "WITH " + _AUD + f""", r AS (SELECT CAST(user_id AS VARCHAR) AS client, list(CAST(epoch_us(logged_at) AS DOUBLE) / 1e6 / 20000 ORDER BY logged_at) AS times FROM audit GROUP BY user_id)
SELECT client, u.t AS "at", u.ok AS admitted FROM (SELECT client, unnest(list_reduce(times, lambda a, x: list_transform([{_KEPT}], lambda k: list_transform([NOT (len(k) >= 5 AND x - k[1] < 1.0) AND len(k) < 30], lambda ok:
  {{'kept': CASE WHEN ok THEN list_append(k, x) ELSE k END, 'out': list_append(a.out, {{'t': x, 'ok': ok}})}})[1])[1], {{'kept': CAST([] AS DOUBLE[]), 'out': CAST([] AS STRUCT(t DOUBLE, ok BOOLEAN)[])}}).out) AS u FROM r)"""
