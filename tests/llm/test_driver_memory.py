"""What the driver holds while the pipeline runs."""

import gc
import weakref

import public_tokenizers

from docdelta.llm import bpe, components, overlap, packing


def test_small_joins_of_a_loop_build_no_tables_in_the_driver(spark):
    edges = spark.sql("SELECT * FROM VALUES (2L, 1L), (3L, 2L), (5L, 4L) AS t (u, v)")
    sets = spark.sql("SELECT key, 2L AS size, array(1L, 2L) AS shingles FROM VALUES (1L), (2L), (3L), (4L), (5L) AS t (key)")
    for table in (components._small_star(components._large_star(edges)), overlap._verified(edges, sets)):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in overlap._verified(edges, sets).collect()) == [(2, 1), (3, 2), (5, 4)]


def test_the_driver_keeps_no_token_model(spark, monkeypatch):
    monkeypatch.setattr(bpe, "_MODELS", {})
    made = []
    build = bpe.BpeModel.__init__
    monkeypatch.setattr(bpe.BpeModel, "__init__", lambda self, *a, **k: made.append(weakref.ref(self)) or build(self, *a, **k))
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)
    gc.collect()
    assert pieces.columns and made and made[0]() is None
