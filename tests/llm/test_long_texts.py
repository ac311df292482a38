from docdelta.llm import language


def test_margin_does_not_shrink_with_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    compressors = language.learn(docs.where(~language.held_out(docs.doc_id))).compressors()
    words = " ".join(r.text for r in docs.where("lang = 'en'").where(language.held_out(docs.doc_id)).select("text").limit(2000).collect())
    lang, _, short = language.judge(words[:20_000], compressors)
    found, _, long = language.judge((words * (6_000_000 // len(words) + 1))[:6_000_000], compressors)
    assert (lang, found) == ("en", "en")
    assert long >= language.MARGIN and long > 0.5 * short


def test_pieces_hold_the_whole_text():
    for data in (b"", b"ab", b"word " * 9000, "дом ".encode() * 7000, ("я" * 40_000).encode(), b"x" * 100_000):
        parts = language.pieces(data)
        assert b"".join(parts) == data
        assert all(len(p) < 2 * language.PIECE for p in parts)
        assert all(p.decode("utf-8") is not None for p in parts)
