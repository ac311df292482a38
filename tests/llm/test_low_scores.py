import numpy as np
import pytest
from pyspark.sql import functions as F

from docdelta.llm import maxscore


@pytest.mark.parametrize("query", [[1.0, 1.0], [0.0, 0.0], [0.0005, 0.0], []])
def test_top_k_with_scores_up_to_zero(spark, monkeypatch, query):
    """Later blocks hold the better vectors, without one positive contribution, and the smaller ids among ties."""
    monkeypatch.setattr(maxscore, "VECTOR_BLOCK", 16)
    rows = [(1000 - i, [-50.0 + 0.5 * i, -50.0 + 0.25 * i]) for i in range(96) if (1000 - i) % 100] + [(2000, query)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    q = np.floor(1024 * np.array([*query, 0.0, 0.0][:2]))
    wanted = sorted((-int(np.floor(1024 * np.array(v)) @ q), i) for i, v in rows if i != 2000)[:10]
    got = maxscore.top_k(table, F.col("vec_id") == 2000).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(k + 1, i, -s) for k, (s, i) in enumerate(wanted)]


@pytest.mark.parametrize("shift", [-9.0, 0.0, 9.0])
def test_top_k_over_blocks_and_shards(spark, monkeypatch, shift):
    """All-negative, mixed and all-positive vectors with ties, over several blocks and shards."""
    monkeypatch.setattr(maxscore, "VECTOR_BLOCK", 32)
    monkeypatch.setattr(maxscore, "SHARD_CELLS", 600)
    random = np.random.default_rng(5)
    rows = [(i, (np.round(random.normal(size=6)) + shift).tolist()) for i in range(1500)]
    x = np.floor(1024 * np.array([v for _, v in rows]))
    wanted = set()
    for q in range(0, 1500, 100):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:10]
        wanted |= {(q, r + 1, int(i), int(score[i])) for r, i in enumerate(order)}
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert {tuple(r) for r in maxscore.top_k(table, F.col("vec_id") % 100 == 0).collect()} == wanted


def test_blocks_are_bounded_by_their_widest_vector(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "BLOCK_CELLS", 50)
    rows = [(i, [float(i % 7)] * (40 if i % 9 == 0 else 2)) for i in range(1, 60)] + [(100, [1.0] * 30)]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 100, k=60).collect()
    wanted = sorted((-int(1024 * 1024 * (i % 7)) * min(30, len(v)), i) for i, v in rows if i != 100)
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, -s) for s, i in wanted]
