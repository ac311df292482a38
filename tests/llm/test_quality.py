import re
from collections import Counter

from docdelta.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for y in w for x in y), dup, len(rep), failed


CLEAN = "\n".join("The " + " ".join(f"w{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k * k + 3 * j) % 26)}{j}" for j in range(9)) + " ends here." for k in range(12))


def test_counts_by_brute_force(spark, odd, empty):
    rows = quality.assess(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality.assess(empty).count() == 0


def test_repeats(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f", "x a b c d e y a b c d e z a b c d e", "a b c d", "p q r s t u " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.assess(docs).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_lines(spark):
    texts = {
        1: CLEAN, 2: CLEAN + "\nAll rights reserved.\nHome | About | News | Contact", 3: " ".join(f"word{k}***" for k in range(60)),
        4: " ".join(f"SHOUT{chr(65 + k % 26)}{chr(65 + k // 26)}!!" for k in range(60)), 5: "\n".join(" | ".join(f"item{k}{j}" for j in range(8)) for k in range(9)),
        6: "Skip to content\n" + CLEAN, 7: "100 % of A & B",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in quality.assess(docs, cleaned=True).collect()}
    assert {k: r.kept for k, r in rows.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}
    assert rows[2].cleaned == CLEAN and rows[1].cleaned == CLEAN and rows[6].cleaned == CLEAN
    assert (rows[1].n_lines_removed, rows[2].n_lines_removed) == (0, 2)


def test_native(spark, odd):
    plan = quality.assess(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_stage(spark, odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 2] or 7 in [r.doc_id for r in kept.collect()]


def test_long_lines_of_capitals_take_linear_time(spark):
    """One word of 400,000 capitals is no shouting; four words of capitals are, wherever they begin."""
    texts = ["A" * 400_000, "AB" + "1" * 400_000, "A BC 1 DE, FG: HI. ", "AB CD EF GH", "1ÄÖ ÜÄ ÖÜ ÄÖ !"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_lines_removed for r in quality.assess(docs).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1}


def test_line_rules(spark):
    """Each rule on a line of its own, and its neighbours that stay."""
    long = " ".join(f"word{k}" for k in range(40))
    fail = [
        long, long + "\v" * 3, "Contents ........ 5", "what!!!! no", "Home | About | News | Contact", "Start » Shop » Shoes » Red", "Home About News Contact", "Impressum Datenschutz Kontakt",
        "menu", "Log in", "SOME WORDS ARE LOUD!", "All rights reserved", "© 2024 Example Ltd", "Copyright 2019 " + "x" * 20, "Alle Rechte vorbehalten.", "read more", "This work is licensed under the GNU General Public License, version 3.",
        "Privacy policy, terms of use and cookie settings, " * 20,
    ]
    stay = [
        long + ".", long.replace(" word9 ", "; word9 "), "He said: wait... what", "one › two › three", "home is where the heart is", "The Great War ended.", "NASA and ESA met.",
        "Readers of the privacy policy " + long + ".", "a", "中文的句子", "x" * 500, "he had all rights of his own reserved for later use in the long winter of that year, said the old man.",
    ]
    docs = spark.createDataFrame([(k, line + "\n" + CLEAN) for k, line in enumerate(fail + stay)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in quality.assess(docs, cleaned=True).collect()}
    for k, line in enumerate(fail + stay):
        assert (rows[k].n_lines_removed, rows[k].cleaned) == ((1, CLEAN) if k < len(fail) else (0, line + "\n" + CLEAN)), line
        assert rows[k].kept or k < len(fail)


def test_rules_take_linear_time(spark):
    """Endless lines of capitalised words, separators, marks and phrases."""
    texts = ["Ab " * 200_000, "A-" * 200_000, "|" * 300_000, "." * 300_000, "© " * 200_000, "a b " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_lines_removed for r in quality.assess(docs).collect()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1}


def test_every_phrase_has_a_part():
    assert all(any(part in phrase for part in quality.PHRASE_PARTS) for phrase in quality.PHRASES)
