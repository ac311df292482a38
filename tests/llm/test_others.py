import bisect
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docdelta.llm import attribution, chat, language, maxscore, pii, secrets

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# Top-k.
def brute_top(rows, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in good:
        if q % 100 == 0:
            scored = sorted((-int(x[: min(len(x), len(y))] @ y[: min(len(x), len(y))]), i) for i, y in good if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_top_k(spark, monkeypatch):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=8).astype("f4").tolist()) for i in range(700)]
    rows += [(800 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(901, None), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, []), (906, [3.0]), (None, [9.0] * 8), (1000, [-1.0] * 8), (1100, [0.0] * 8)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score int, rank string").repartition(5)
    monkeypatch.setattr(maxscore, "VECTOR_BLOCK", 64)
    for cells in (2**24, 700):
        monkeypatch.setattr(maxscore, "SHARD_CELLS", cells)
        got = [tuple(r) for r in maxscore.top_k(table, F.col("vec_id") % 100 == 0).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_top(rows, 10)
    few = table.where("vec_id in (0, 1, 2)")
    assert maxscore.top_k(few, F.col("vec_id") % 100 == 0).count() == 2
    assert maxscore.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# Attribution.
def test_token_counts(spark, odd, empty):
    library = Tokenizer.from_file(BYTES)
    rows = attribution.attribute_tokens(odd.where("doc_id <> 2"), BYTES, fields=("source", "text")).collect()
    for d in odd.where("doc_id <> 2 and doc_id <> 7").collect():
        text = f"{d.source}\n\n{d.text or ''}"
        starts = [0] + [3 + x for x in [0] + [m.end() for m in re.finditer("\n", d.text or "")]]
        counts = [0] * len(starts)
        for a, _ in library.encode(text, add_special_tokens=False).offsets:
            counts[bisect.bisect_right(starts, a) - 1] += 1
        mine = sorted((r.start, r.n_tokens) for r in rows if r.doc_id == d.doc_id)
        assert mine == list(zip(starts, counts)), d.doc_id
    whole = {7: len(library.encode("s\n\n" + odd.where("doc_id = 7").first().text, add_special_tokens=False).ids)}
    assert sum(r.n_tokens for r in rows if r.doc_id == 7) == whole[7]
    assert attribution.attribute_tokens(empty, BYTES).count() == 0


# Secrets.
def brute_base(t):
    found = []
    rx = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end(), "assign") for m in re.finditer(rx, t, re.ASCII | re.IGNORECASE) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secrets(spark, odd, empty):
    keys = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]
    texts = [f"see token = '{k}' here" for k in keys[:30]] + [f"AKIA{hashlib.md5(k.encode()).hexdigest().upper()[:16]} x" for k in keys]
    texts += ["token=token=abcdefghijkl", "token = secret: abcdefabcdefabcdef", "API_KEY: 'Zz-9.='", "ſecret=abcdefabcdefabcdef", "deadbeefdeadbeef0", "", None, f"stray {keys[40].upper()[:20]}A9 end", "an ordinary-sentence with well-known-words only1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert ",".join(s for s in rows[i].spans.split(",") if not s.startswith("model")) == base
    assert rows[len(texts) - 1].n_model == 0
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(empty).count() == 0


def test_automaton_likelihood():
    """A format's own strings are likelier than others; probabilities of a state sum to 1."""
    import random

    rng = random.Random(5)
    make = lambda: "K" + "".join(rng.choice("0123456789abcdef") for _ in range(20))
    a = secrets.Automaton([secrets.symbols(make()) for _ in range(300)])
    for node in a.nodes[:1]:
        assert node.ends + sum(e[0] for e in node.next.values()) == node.visits
    own = sum(a.score(secrets.symbols(make())) for _ in range(50)) / 50
    assert own > a.score(secrets.symbols("ordinary-words-here9")) + 1


def test_model_spans_by_brute_force(spark):
    """Unlabelled tokens of the labelled formats, found and scored one by one; words, numbers and addresses are none."""
    rng = np.random.default_rng(4)
    make = lambda n, alphabet: "".join(rng.choice(list(alphabet), n))
    hexes, keys = [make(40, "0123456789abcdef") for _ in range(40)], ["ghp_" + make(60, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)]
    texts = [f"token: {k} and secret={h}." for k, h in zip(keys[:40], hexes)] + [f"found {k}. Then password='{h}', {k}" for k, h in zip(keys[40:], hexes)]
    texts += ["10.20.30.40 aaaaaaaaaaaaaaaaa mail9.example.com 1234567890123 an-ordinary-hyphened-word 2024-01-02T03:04:05", "= " * 30 + keys[50], ("ab12" * 4 + " ") * 300 + keys[41]]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, spans string, base int")
    values = {}
    for t in texts:
        for _, _, kind, v in secrets.base_spans(t):
            values.setdefault(kind, set()).add(v)
    formats = secrets.Formats.learn({k: sorted(v) for k, v in values.items()})  # all of them: fewer than the sample
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    found = 0
    for k, t in enumerate(texts):
        base = [(s, e) for s, e, *_ in secrets.base_spans(t)]
        wanted = set()
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t):
            start, end = m.start(), m.end()
            while t[start:end].startswith("."):
                start += 1
            while t[start:end].endswith("."):
                end -= 1
            if end - start >= 12 and not any(s < end and start < e for s, e in base) and any(a.score(secrets.symbols(t[start:end])) >= least for a, least in formats.automata):
                wanted.add((start, end))
        mine = {tuple(map(int, s.split(":")[1:])) for s in got[k].spans.split(",") if s.startswith("model")}
        assert mine == wanted and got[k].n_model == len(wanted), t
        found += len(wanted)
    assert found >= 30 and got[len(texts) - 3].n_model == 0


def test_long_credentials_are_learned_whole():
    """Formats that differ after their 48th character stay apart."""
    rng = np.random.default_rng(8)
    long = lambda: "k" * 50 + "".join(rng.choice(list("0123456789"), 30))
    formats = secrets.Formats.learn({"assign": [long() for _ in range(50)]})
    assert formats.is_secret(long()) and not formats.is_secret("k" * 50) and not formats.is_secret("k" * 50 + "x" * 30)


def test_candidates_in_linear_time():
    """100,000 tokens among as many spans."""
    text = ("0123456789abcdef plain-token-1 " * 100_000)
    taken = secrets.base_spans(text)
    assert len(taken) == 100_000 and len(secrets.candidates(text, taken)) == 100_000


# Chats.
def test_chats(spark):
    def conv(i, turns):
        return [(i, k, r, t, 9) for k, (r, t) in enumerate(turns)]

    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    rows = conv(1, a[:2]) + conv(2, a) + conv(3, a) + conv(4, [("user", "hi"), ("user", "hello")]) + conv(5, [("user", None)]) + conv(6, [(None, "")]) + conv(7, a[:1]) + conv(8, [("user", "x")] * 2)
    rows += [(9, k, "user", f"t{k}", 9) for k in range(600)] + [(10, k, "user", f"t{k}", 9) for k in range(599)] + [(None, 0, "user", "lost", 9)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pos int").repartition(7)
    out = chat.format_chats(turns).collect()
    assert {r.conv_id for r in out} == {2, 4, 5, 6, 8, 9, None}
    whole = {i: "".join(r.rendered for r in sorted((r for r in out if r.conv_id == i), key=lambda r: r.part)) for i in (2, 9)}
    assert whole[2] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)
    assert whole[9] == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(600))
    assert sorted(r.part for r in out if r.conv_id == 9) == [0, 1, 2]
    assert chat.format_chats(turns.limit(0)).count() == 0


def brute_chats(rows):
    """{conv: (turns, rendered)} of the maximal conversations, by comparing all pairs."""
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, role, text))
    said = {c: [(r, t) for _, r, t in sorted(v, key=key)] for c, v in by.items()}
    keep = {}
    for c, v in said.items():
        if any(len(o) > len(v) and o[: len(v)] == v for o in said.values()):
            continue
        same = [o for o, w in said.items() if w == v and o is not None]
        if c == (min(same) if same else None):
            keep[c] = (len(v), "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in v))
    return keep


@pytest.mark.parametrize("ranges", [1, 13])
def test_chats_by_brute_force(spark, ranges):
    """Few words, so that prefixes, ties and copies abound; a conversation with a third of all turns; very long turns."""
    rng = np.random.default_rng(ranges)
    rows = []
    for c in range(120):
        n = int(rng.integers(1, 7))
        rows += [(c, int(rng.integers(0, 4)) if c % 5 == 0 else k, str(rng.choice(["user", "assistant"])) if c % 7 else None, str(rng.choice(["a", "b"])) if k % 6 != 5 else None) for k in range(n)]
    rows += [(1000, k, "user", f"t{k}") for k in range(300)] + [(1001, k, "user", f"t{k}") for k in range(290)] + [(None, 0, "user", "a"), (None, None, "user", "b")]
    rows += [(2000, k, "user", "long " * 40_000 + str(k)) for k in range(3)] + [(2001, k, "user", "long " * 40_000 + str(k)) for k in range(2)]
    rows = [(*r, "x", 5) for r in rows]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, rendered string, range int").repartition(5)
        got = {}
        for r in sorted(chat.format_chats(turns).collect(), key=lambda r: r.part):
            n, text = got.get(r.conv_id, (0, ""))
            got[r.conv_id] = (r.n_turns, text + r.rendered)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_chats(rows)


# Language.
def test_language(spark, sf, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.learn(docs.where(~language.held_out(docs.doc_id)))
    rows = language.identify(docs, learned, keep=("doc_id", "lang")).where(language.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language.identify(odd, learned, keep=("doc_id", "score"), names=("a", "b", "c")).collect()}
    assert {i for i, r in got.items() if r.a == "und"} == {3, 4, 5} and got[1].a == "en"
    assert language.identify(empty, learned).count() == 0
    assert {language.judge(t, [("a", c[1]) for c in learned.compressors()][:1])[0] for t in ("x", "yes " * 9000)} == {"a"}
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def brute_language(text, dictionaries, with_margin=False):
    """The smallest sum of compressed sizes, piece by piece, with a new compressor each time."""
    import zstandard

    if text is None or not any(c.isalpha() for c in text):
        return "und"
    words = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
    sums = {}
    for lang, data in dictionaries.content.items():
        for piece in language.pieces(words):
            for d in (piece, piece + b" " + piece):
                made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sums[lang] = sums.get(lang, 0) + len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(d))
    best = min(sums, key=lambda k: (sums[k], k))
    second = sorted(sums.values())[1]
    return (best, (second - sums[best]) / second) if with_margin else best


def test_language_by_brute_force(spark):
    """Every text's language, short and long, from the same dictionaries; the dictionaries from the labelled fold alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    learned = language.learn(docs.where(docs.doc_id.isNotNull() & ~language.held_out(docs.doc_id)))
    by = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and r.text:
            by.setdefault(r.lang, set()).add(language.letters(r.text[:3000]))
    for lang, data in learned.content.items():
        assert sum(part in data for part in by[lang]) >= min(len(by[lang]), 30)  # 40 texts, some of them copies
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, learned, keep=("doc_id",)).collect()}
    assert got == {r.doc_id: brute_language(r.text, learned) for r in rows}


def test_every_language_is_learned(spark):
    """A hundred languages, each with words of its own."""
    rows = [(k * 10 + j, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (i * 7 + j) % 26)}{chr(97 + i % 26)}o" for i in range(60)), f"l{k:03d}") for k in range(100) for j in range(3)]
    learned = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(learned.content) == 100
    judged = [language.judge(t, learned.compressors())[0] for _, t, _ in rows[::30]]
    assert judged == [lang for *_, lang in rows[::30]]


# Personal data.
PRIVATE = [
    "Mr. John Smith and Mrs. Anna Miller met; Mr. John Smith called +1 (743) 555-3824 or +17435553824.",
    "mail Foo.Bar12@Mail.Example.com, foo.bar12@mail.example.com and x@y.co; card 4111 1111 1111 1111 / 4111111111111111; ip 10.2.3.4",
    "SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 Госпожа Мария Иванова", None, "", "clean text 2.0. and 1.2.3 v 12.5%",
]


def test_surrogates(spark, odd, empty):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(PRIVATE)] + [(9, PRIVATE[1], "x", 7)], "doc_id bigint, text string, kind string, pos int")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, "key", count_col="n").collect()}
    assert out[3].text is None and out[4].text == "" and out[5].text == PRIVATE[5] and out[1].text == out[9].text
    for secret in ("John", "Smith", "Miller", "743", "Foo", "4111", "10.2.3.4", "123-45-6789", "3704", "Иванова"):
        assert all(secret not in (r.text or "") for r in out.values()), secret
    first = re.fullmatch(r"Mr\. (\w+ \w+) and Mrs\. (\w+) \w+ met; Mr\. (\w+ \w+) called (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1\d{10})\.", out[0].text)
    assert first[1] == first[3] and re.sub(r"\D", "", first[4]) == re.sub(r"\D", "", first[5])
    assert first[1].split()[0] in pii.NAMES["latin", "m"] and first[2] in pii.NAMES["latin", "f"]
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) / (\d{16});", out[1].text)
    digits = [int(c) for c in cards[2][::-1]]
    assert cards[1].replace(" ", "") == cards[2] and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    mails = re.findall(r"\S+@\S+?(?=[,; ])", out[1].text)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1] and re.search("[А-Я]", out[2].text[-12:])
    assert pii.pseudonymise(odd, "key").columns == odd.columns and pii.pseudonymise(odd, "key").count() == odd.count()
    assert pii.pseudonymise(empty, "key").count() == 0
    assert {r.text for r in pii.pseudonymise(docs, "other").collect()} != {r.text for r in out.values()}


def test_surrogates_stay_distinct(spark):
    """More entities than a small space of draws has room for without collisions."""
    entities = spark.createDataFrame([("ip", f"1.1.{a}.{b}") for a in range(40) for b in range(40)] + [("email", f"{chr(97 + k)}@b.co") for k in range(26)], "kind string, entity string")
    rows = pii.assign(entities, "k").collect()
    assert len(rows) == len({(r.kind, r.surrogate) for r in rows}) == 1626
    originals = {(r.kind, r.entity) for r in rows}
    assert not any((r.kind, r.surrogate) in originals for r in rows)


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in sorted(pii.pseudonymise(docs, key).collect(), key=lambda r: r.doc_id)]


def test_full_formats_get_longer_surrogates(spark):
    """Every address of a format is an entity: what is written is distinct, and nobody's."""
    mails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    out = replaced(spark, mails)
    assert len(set(out)) == 676 and not set(out) & set(mails)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.co", m) for m in out)


def test_written_surrogates_by_brute_force(spark):
    """Whatever the writing, equal entities have equal replacements, different ones different, and none is an original."""
    rng = np.random.default_rng(11)
    kinds = {
        "phone": [f"+1 ({a}) 555-{b:04d}" for a, b in zip(rng.integers(200, 999, 60), rng.integers(0, 9999, 60))],
        "ssn": [f"{a}-{b:02d}-{c:04d}" for a, b, c in zip(rng.integers(100, 899, 60), rng.integers(1, 99, 60), rng.integers(1, 9999, 60))],
        "ip": [f"10.0.{a}.{b}" for a in range(6) for b in range(10)],
        "surname": [f"Mr. {w}" for w in (f"{x}{y}" for x in ("Stone", "Wood", "Hill", "Lake", "Field", "Brook") for y in ("er", "man", "son", "ton", "ley", "by", "wick", "worth", "ham", "ford"))],
    }
    for values in kinds.values():
        out = replaced(spark, [f"see {v}, again {v} end" for v in values])
        pairs = [re.fullmatch(r"see (.+), again (.+) end", t).groups() for t in out]
        assert all(a == b for a, b in pairs)
        new = {a for a, _ in pairs}
        assert len(new) == len(set(values)) and not new & set(values)


def test_people_keep_gender_and_coreference(spark):
    out = replaced(spark, [
        "Mrs. Alex Stone met Mr. Alex Stone; Dr Alex Wood came.", "Mr. Alex Wood", "Dr Anna Weiss spoke. Weiss left, and Anna Weiss returned with ANNA WEISS.",
        "My name is Peter Parker, contact Mr John Smith-Jones.", "Mr. Smith and John Smith", "Госпожа Анна Иванова и господин. Господин Иванов", "Prof. Dr. Clara Weiss", "An ordinary Stone of Alex",
    ])
    her, him, other = re.fullmatch(r"Mrs\. (\w+ \w+) met Mr\. (\w+ \w+); Dr (\w+ \w+) came\.", out[0]).groups()
    female = {n for n in pii.NAMES["latin", "f"]}
    assert her.split()[1] == him.split()[1] and her.split()[0] in female and him.split()[0] in pii.NAMES["latin", "m"]
    assert out[1] == f"Mr. {other}" and other.split()[0] == him.split()[0]
    full, last, again, loud = re.fullmatch(r"Dr (\w+ \w+) spoke\. (\w+) left, and (\w+ \w+) returned with (\w+ \w+)\.", out[2]).groups()
    assert again == full and last == full.split()[1] and loud == full.upper() and full.split()[0] in female
    assert out[6] == f"Prof. Dr. {out[6].split()[2]} {last}"
    assert not re.search("Peter|Parker|John|Smith|Jones", out[3]) and out[3].startswith("My name is ")
    smith = re.fullmatch(r"Mr\. (\w+) and \w+ (\w+)", out[4])
    assert smith[1] == smith[2]
    assert re.fullmatch(r"Госпожа \w+ \w+ова и господин\. Господин \w+ов", out[5]) and "Иванов" not in out[5]
    assert out[7] == "An ordinary Stone of Alex"


def test_surrogates_pass_any_columns_through(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.example.com", "m", "k", "p", 5)], "doc_id bigint, text string, __mentions string, __key string, `put new` string, row int")
    got = pii.pseudonymise(docs, "k", count_col="n").first()
    assert got[0] == 1 and "a.b" not in got[1] and tuple(got[2:]) == ("m", "k", "p", 5, 1)
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


def test_native_surrogates(spark, odd):
    plan = pii.pseudonymise(odd, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)


# Pipeline.
def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "pii", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert {r.doc_id for r in rows} <= before and len(rows) == len({r.doc_id for r in rows})
        before, docs = {r.doc_id for r in rows}, spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == before


def test_pipeline_by_brute_force(spark, sf):
    """Each stage on the rows that the one before kept, held against plain code."""
    import duckdb

    from docdelta.llm.queries import ORACLES

    from .test_overlap import brute_groups

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {i for i, kept in con.sql(f"SELECT doc_id, kept FROM ({ORACLES['op5_quality']})").fetchall() if kept}
    rows = stages["quality"](spark, docs, sf).collect()
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == good
    for r in rows:
        lines = iter(before[r.doc_id].split("\n"))
        assert all(any(x == y for y in lines) for x in r.text.split("\n")) and r.n_chars == len(r.text)
    docs = spark.createDataFrame(rows, docs.schema)

    learned = language.learn(docs.where(~language.held_out(docs.doc_id)))
    clear = {r.doc_id for r in rows if (found := brute_language(r.text, learned, True)) != "und" and found[1] >= language.MARGIN}
    rows = stages["language"](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == clear
    docs = spark.createDataFrame(rows, docs.schema)

    first = {group for _, group in brute_groups([(r.doc_id, r.text) for r in rows])}
    rows = stages["near_duplicates"](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == first
    docs = spark.createDataFrame(rows, docs.schema)

    private = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]*\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b(?:\d{1,3}\.){3}\d{1,3}\b|(?<![\w.-])\d{13,19}(?!\w)")
    seen = {m for r in rows for m in private.findall(r.text)}
    after = {r.doc_id: r.text for r in stages["pii"](spark, docs, sf).collect()}
    assert seen and not seen & {m for t in after.values() for m in private.findall(t)}
    swapped = {}
    for r in rows:
        old, new = private.split(r.text), private.split(after[r.doc_id])
        assert old == new
        for a, b in zip(private.findall(r.text), private.findall(after[r.doc_id])):
            assert swapped.setdefault(a, b) == b
    assert len(set(swapped.values())) == len(swapped)
    docs = spark.createDataFrame([(i, t) for i, t in after.items()], "doc_id bigint, text string")

    library = Tokenizer.from_file(BYTES)
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    packed, filled = {}, {}
    for r in stages["packing"](spark, docs, sf).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert packed == lengths
    for places in filled.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(filled) <= -(-sum(lengths.values()) // 2048) + 1


def test_stages_on_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns, name
        assert stage(spark, odd, "").count() <= odd.count(), name
        assert stage(spark, empty, "").count() == 0, name


def test_surrogates_in_endless_domains(spark):
    """50,000 one-letter labels are no address; they neither exhaust the stack nor hide the entities around them."""
    text = "mail a.b@c.example.com or x@" + "a." * 50_000 + "com and +1 (743) 555-3824"
    out = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first().text
    assert "a.b@c.example.com" not in out and "555-3824" not in out and "x@a.a.a" in out and len(out) == len(text)


def test_ordinary_tokens_are_no_secrets():
    """Credentials that look like random passwords: held-out ones are found, long words and names of programs are not."""
    draw = random.Random(12)
    password = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(draw.randrange(12, 21)))
    parts = ["get", "set", "element", "By", "Id", "document", "window", "Listener", "add", "inner", "Html", "style", "on", "load", "content", "Value", "http", "index", "re", "tion", "ment", "con"]
    ordinary = lambda: ("".join(draw.choice(parts) for _ in range(draw.randrange(3, 7))) + draw.choice(["", "", "", "2", "_id", ".js", "-10"])).ljust(12, "s")
    formats = secrets.Formats.learn({"assign": [password() for _ in range(200)]}, [ordinary() for _ in range(1000)])
    held_out, others = [password() for _ in range(1000)], [ordinary() for _ in range(5000)]
    assert sum(map(formats.is_secret, held_out)) >= 900
    assert sum(map(formats.is_secret, others)) < 50
    alone = secrets.Formats(formats.automata)
    assert sum(map(alone.is_secret, others)) > 1000  # without the automaton of ordinary tokens


def test_formats_find_what_the_patterns_miss(spark):
    """Tokens of a labelled format that stand without their label."""
    draw = random.Random(13)
    made = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    words = ["responsibilities", "internationalisation", "getElementById", "characteristically", "misunderstandings"]
    rows = [(k, f"token = {made()}", None) for k in range(60)]
    for k in range(100, 160):
        planted, text = made(), " ".join(draw.choice(words) + draw.choice(["", "s", "ed"]) for _ in range(30))
        rows.append((k, f"{text} {planted} {text}", (len(text) + 1, len(text) + 25)))
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    hits = sum(f"model:{a}:{b}" in found[k].spans for k, _, span in rows if span for a, b in [span])
    assert hits >= 54 and sum(found[k].n_model for k, *_ in rows) <= hits + 1
