"""Batches in tiles: the sieve against brute force, how often vectors travel, and plans without broadcasts of vectors."""

import tracemalloc

import numpy as np
import pytest

from tessavec.operators import graph, search


def brute(qid, q, ids, x, k, exclude_self):
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    s = np.round((q[:, None, :].astype(float) * x[None].astype(float)).sum(axis=2), 6)
    if exclude_self:
        s = np.where(qid[:, None] == ids[None], -np.inf, s)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return ids[top], np.take_along_axis(s, top, axis=1)


def vectors(kind, n, rng):
    x = rng.normal(size=(n, 8))
    match kind:
        case "copies":
            return x[rng.integers(0, max(1, n // 40), n)].astype("f4")
        case "whole numbers":
            return rng.integers(-1, 2, (n, 8)).astype("f4")
        case "zeros":
            return np.zeros((n, 8), "f4")
        case "lengths":
            return x * 10.0 ** rng.integers(-3, 4, (n, 1))
        case "huge":
            return x * 1e20
    return x.astype("f4")


@pytest.mark.parametrize("kind", ["normal", "copies", "whole numbers", "zeros", "lengths", "huge"])
def test_the_sieve_loses_nothing(kind, monkeypatch):
    rng = np.random.default_rng(8)
    for pairs in (1 << 15, 50):
        monkeypatch.setattr(search, "PAIRS", pairs)
        for asked, n, k, itself in ((90, 500, 5, True), (60, 300, 150, False), (5, 7, 9, True), (3, 1, 2, True)):
            x, ids = vectors(kind, n, rng), rng.permutation(3 * n)[:n].astype("i8")
            some = rng.integers(0, n, asked)
            got = search.nearest(ids[some], x[some], ids, x, k, itself, rows=32, columns=100)
            want = brute(ids[some], x[some], ids, x, k, itself)
            there = np.isfinite(want[1])
            assert (np.isfinite(got[1]) == there).all() and (got[0] == want[0])[there].all()
            assert np.allclose(got[1][there], want[1][there], rtol=1e-12, atol=2e-6)


def test_a_vector_travels_once_for_each_bounded_tile():
    """600,000 rows had 1,172 blocks of queries, each with a copy of every row."""
    q, b, most_q, most_b = search.tiles_of(600_000, 600_000, 64)
    assert (q, b) == (19, 19) and most_q * 64 * 8 == most_b * 64 * 8 == 16 << 20
    q, b, *_ = search.tiles_of(50_000, 50_000, 64)
    assert q * b >= 64
    assert search.tiles_of(0, 0, 64)[:2] == (1, 1)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8_000, 16)).astype("f4")
    tracemalloc.start()
    search.nearest(np.arange(8_000), x, np.arange(8_000), x, 8, True)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20  # all scores of the tile in double are 512 MB
    tracemalloc.stop()


def graph_rows(spark, n=400):
    x = np.random.default_rng(2).normal(size=(n, 4))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, vector array<float>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_of_a_batch_are_not_joined(spark):
    """the blocks of queries, a copy for each block of rows, were broadcast through the driver."""
    rows = graph_rows(spark)
    found = search.batch_topk(rows.withColumnRenamed("ord", "qid"), rows, 3, 4)
    assert "Join" not in plan(found) and found.count() == 1200


def test_layout_changes_no_result(spark):
    rows = graph_rows(spark)
    asks = rows.withColumnRenamed("ord", "qid")
    one, many = (sorted(map(tuple, search.batch_topk(asks, rows, 3, 4, True, b, b).collect())) for b in (None, 37))
    assert one == many and len(one) == 1200
    assert search.batch_topk(asks, rows.limit(0), 3, 4).count() == search.batch_topk(asks.limit(0), rows, 3, 4).count() == search.batch_topk(asks, rows, 0, 4).count() == 0


def test_pruning_computes_the_edges_once(spark):
    """the edges and their reverse were two copies of the whole comparison."""
    pruned = graph.prune(graph.knn_graph(graph_rows(spark), 3, 4), 3)
    optimized = pruned._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in optimized
    edges = {(r.src, r.dst) for r in graph.knn_graph(graph_rows(spark), 3, 4).collect()}
    kept = {}
    for r in pruned.collect():
        assert (r.src, r.dst) in edges or (r.dst, r.src) in edges
        kept.setdefault(r.src, []).append((r.rank, -r.score, r.dst))
    assert len(kept) == 400 and all([e[0] for e in sorted(v)] == list(range(1, 4)) and [e[1:] for e in sorted(v)] == sorted(e[1:] for e in v) for v in kept.values())


def test_deleted_nodes_leave_a_graph_compared_in_tiles(spark):
    """one comparison in cogrouped tiles; the neighbours are chosen before the deletions, as in the SQL."""
    rows = graph_rows(spark)
    left = graph.without_nodes(graph.knn_graph(rows, 3, 4), rows.where("ord % 7 = 0"))
    assert left._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    want = {(r.src, r.rank, r.dst) for r in graph.knn_graph(rows, 3, 4).collect() if r.src % 7 and r.dst % 7}
    assert {(r.src, r.rank, r.dst) for r in left.collect()} == want and want
