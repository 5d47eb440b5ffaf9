"""The layered index in shards: memory of a worker, and levels that have a node alone in its shard."""

import heapq
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessavec.operators import ann
from tessavec.operators.search import batch_topk


def layered_rows(spark, n):
    x = np.random.default_rng(3).normal(size=(n, 8))
    return spark.createDataFrame([(i, str(i), [float(v) for v in r]) for i, r in enumerate(x)], "ord long, id string, vector array<float>")


def test_linking_a_shard_holds_few_scores():
    """a shard of 6,000 rows held 1,024 x 6,000 scores three times over; the places are those of whole rows of scores."""
    x = np.random.default_rng(7).normal(size=(6000, 8))
    tracemalloc.start()
    found = ann.link(x, 4)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    s = x @ x[:50].T
    s[np.arange(50), np.arange(50)] = -np.inf
    assert (np.argmax(s, axis=0) == found[:50, 0]).all()


def test_shards_are_read_one_by_one(spark):
    """all shards of a file came in one batch."""
    index = ann.build_index(layered_rows(spark, 600), 8, m=4, shard_rows=100)
    for df in (index.neighbours(), index.nodes(), index.stats()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")
    assert index.nodes().count() == 600 and index.neighbours().where("level = 0").select("src").distinct().count() == 600


def test_nodes_alone_on_a_level_of_their_shard_have_neighbours(spark, tmp_path):
    """they were missing from the figures, as no other node of their level was in their shard."""
    rows = layered_rows(spark, 800)
    index = ann.build_index(rows, 8, m=4, shard_rows=60)
    tops = {r.ord: r.level for r in index.nodes().collect()}
    want = {k: n if k == 0 or n > 1 else 0 for k in range(5) for n in [sum(t >= k for t in tops.values())]}
    assert {r.level: r.nodes for r in index.stats().collect()} == want and want[3]
    assert index.bridges.count()
    shard = {r.ord: r.shard for r in index.nodes().collect()}
    x = {r.ord: np.array(r.vector) for r in rows.collect()}
    for src, level in {(r.src, r.level) for r in index.bridges.collect()}:
        found = [r.dst for r in sorted(index.bridges.where((F.col("src") == src) & (F.col("level") == level)).collect(), key=lambda r: r.rank)][:4]
        others = [o for o in tops if o != src and tops[o] >= level]
        assert all(shard[o] != shard[src] for o in others) and found == sorted(others, key=lambda o: (-round(float(x[o] @ x[src]), 6), o))[:4]
        if level == 3:
            break
    index.save(f"{tmp_path}/i")
    again = ann.LayeredIndex.load(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, again.neighbours().collect())) == sorted(map(tuple, index.neighbours().collect()))
    left = again.unlinked(rows.where("ord % 2 = 0")).neighbours().cache()
    assert left.where("src % 2 = 0 or dst % 2 = 0").count() == 0
    assert left.groupBy("level", "src").agg((F.max("rank") - F.count("*")).alias("gap")).where("gap <> 0").count() == 0


def test_each_query_is_answered_whatever_the_shards(spark):
    """building for recall takes the bounded steps; with every cell asked and a wide beam all true neighbours are found."""
    rows = layered_rows(spark, 600)
    asks = rows.where("ord % 20 = 0").select(F.col("ord").alias("qid"), "vector")
    index = ann.build_index(rows, 8, m=12, shard_rows=100)
    found = ann.ann_topk(asks, index, 5, ef=100, probes=len(index.centroids))
    assert ann.recall(found, batch_topk(asks, rows, 5, 8)).first().recall == 1.0


def test_vectors_compared_are_counted_over_all_shards(spark):
    """only those of one shard were counted."""
    rows = layered_rows(spark, 600)
    asks = rows.where("ord % 20 = 0").select(F.col("ord").alias("qid"), "vector")
    index = ann.build_index(rows, 8, m=12, shard_rows=100)
    found = ann.ann_topk(asks, index, 5, ef=600, probes=len(index.centroids), query_block=8)
    counts = found.groupBy("qid").agg(F.count("*").alias("n"), F.min("scored").alias("low"), F.max("scored").alias("high")).collect()
    assert len(counts) == 30 and all(r.n == 5 and r.low == r.high > 500 for r in counts)


def test_a_search_is_tuned_to_its_recall(spark):
    """a beam of 50 in a quarter of the cells finds too few of the neighbours of vectors without structure."""
    x = np.random.default_rng(9).normal(size=(2000, 32))
    rows = spark.createDataFrame([(i, str(i), [float(v) for v in r]) for i, r in enumerate(x)], "ord long, id string, vector array<float>")
    asks = rows.where("ord % 20 = 0").select(F.col("ord").alias("qid"), "vector")
    index, truth = ann.build_index(rows, 32, m=6, shard_rows=250), batch_topk(asks, rows, 5, 32).cache()
    how = ann.tuned(index, rows, 5, 32)
    assert ann.recall(ann.ann_topk(asks, index, 5), truth).first().recall < 0.8
    assert ann.recall(ann.ann_topk(asks, index, 5, **how), truth).first().recall >= 0.9


def one_beam(g, q, ef):
    """Of one query, a beam with heaps: (ordinals by score, vectors compared)."""
    at = g.entry
    start = float(g.x[at] @ q)
    todo, found, seen = [(-start, at)], [(start, at)], {at}
    while todo:
        s, node = heapq.heappop(todo)
        if len(found) >= ef and -s < found[0][0]:
            break
        for n in g.links[0, node].tolist():
            if n >= 0 and n not in seen:
                seen.add(n)
                t = float(g.x[n] @ q)
                if len(found) < ef or t > found[0][0]:
                    heapq.heappush(todo, (-t, n))
                    heapq.heappush(found, (t, n))
                    if len(found) > ef:
                        heapq.heappop(found)
    return [int(g.ords[n]) for _, n in sorted(found, reverse=True)], len(seen)


def test_beams_of_a_block_hold_little_and_find_what_single_ones_do():
    """queries went one by one through Python lists; now a block at once, within bounds, and dead nodes stay out."""
    n, m = 4000, 12
    x = np.random.default_rng(5).normal(size=(n, 8))
    for dead in (np.zeros(n, bool), np.arange(n) % 3 == 0):
        links = np.concatenate([ann.link(x, m)[None], np.full((1, n, m), -1, np.int32)])
        links[0][dead] = -1
        links[0][np.isin(links[0], np.flatnonzero(dead))] = -1
        g = ann._Graph({"ords": (np.arange(n) * 10).astype("<i8").tobytes(), "levels": np.zeros(n, "<i4").tobytes(), "dead": dead.astype("u1").tobytes(), "x": x.tobytes(), "links": links.astype("<i4").tobytes()}, 2)
        q = x[: ann.BEAMS]
        ords, s, compared = g.search(q, 5, 20)
        for i in range(len(q)):
            want, seen = one_beam(g, q[i], 20)
            assert ords[i].tolist() == want[:5] and compared[i] == seen
        assert not dead[ords // 10].any() and np.allclose(s, np.einsum("ijk,ik->ij", x[ords // 10], q), atol=2e-6)
        tracemalloc.start()
        wide, _, compared = g.search(q, 5, 400)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
        tracemalloc.stop()
        assert not dead[wide // 10].any() and (compared < n).all()


def test_equal_rows_are_reached_and_lead_out():
    """more than ``m`` equal rows were linked among themselves alone."""
    x = np.random.default_rng(11).normal(size=(600, 8))
    x[100:400:3] = x[100]
    links = ann.link(x, 6)[None]
    g = ann._Graph({"ords": np.arange(600).astype("<i8").tobytes(), "levels": np.zeros(600, "<i4").tobytes(), "dead": bytes(600), "x": x.tobytes(), "links": links.astype("<i4").tobytes()}, 1)
    ords, _, _ = g.search(x[[100, 250]], 5, 50)
    assert ords.tolist() == [[100, 103, 106, 109, 112]] * 2
    seen, todo = {397}, [397]  # from the last of the 100 equal rows to others
    while todo:
        new = set(links[0, todo.pop()].tolist()) - seen - {-1}
        seen |= new
        todo += new
    assert seen >= set(range(100, 400, 3)) and len(seen) > 200
