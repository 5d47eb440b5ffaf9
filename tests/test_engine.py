"""Edge cases of the engine: ties, bad vectors, duplicates, deletions, cut metadata, null JSON, storage, streams."""

import itertools
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessavec.config import CollectionConfig
from tessavec.functions.vector import truncated_utf8
from tessavec.operators import ann, graph, mutate, search
from tessavec.operators.collection import Collection, empty_id_filled, from_rows, opaque, postings, where_indexed
from tessavec.operators.typed import TypedCollection
from tessavec.plans.predicate import field, lookups
from tessavec.sources import cli
from tessavec.sources import store
from tessavec.sources.shared import release
from tessavec.sources.store import create, load, save
from tessavec.streaming.ingest import ingest

ROWS = "ord long, id string, vector array<float>, metadata string, deleted boolean"
BATCH = "id string, vector array<float>, metadata string, batch_ord long"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, "a", [1.0, 0.0], '{"k": 1}', False), (1, "b", [0.0, 1.0], '{"k": 2}', False), (2, "c", [1.0, 0.0], "{}", False), (3, "d", [0.0, 0.0], "null", False), (4, "e", [2.0, 0.0], '{"k": 1}', True)]
    return Collection(spark.createDataFrame(rows, ROWS), CollectionConfig(2))


def ids(df):
    return [r.id for r in df.collect()]


def test_ties_go_to_the_smaller_ordinal(small):
    assert ids(search.exact_topk(small.live(), [1.0, 0.0], 3)) == ["a", "c", "b"]
    assert ids(search.exact_topk(small.live(), [1.0, 0.0], 0)) == [] and ids(search.exact_topk(small.live(), [1.0, 0.0], -1)) == []
    assert len(ids(search.exact_topk(small.live(), [1.0, 0.0], 99))) == 4


def test_zero_vectors_score_zero_under_cosine(small):
    found = {r.id: r.score for r in search.exact_topk(small.live(), [3.0, 4.0], 9, None, "cosine").collect()}
    assert found == {"a": 0.6, "b": 0.8, "c": 0.6, "d": 0.0}


def test_post_filter_may_return_fewer(small):
    rows = small.live()
    assert ids(search.hybrid_post(rows, [1.0, 0.0], F.col("id") == "b", 1, 2)) == []
    assert ids(search.exact_topk(rows, [1.0, 0.0], 1, F.col("id") == "b")) == ["b"]


def test_bad_vectors_raise(spark):
    for v in ([1.0], [1.0, float("nan")], [1.0, float("inf")], [1.0, None], None):
        df = spark.createDataFrame([(0, "a", v, "{}")], "ord long, id string, vector array<float>, metadata string")
        with pytest.raises(Exception, match="2 finite components"):
            from_rows(df, CollectionConfig(2)).rows.collect()


def test_cosine_keeps_unit_vectors(spark):
    df = spark.createDataFrame([(0, "a", [3.0, 4.0], "{}"), (1, "b", [0.0, 0.0], "{}")], "ord long, id string, vector array<float>, metadata string")
    got = {r.id: r.vector for r in from_rows(df, CollectionConfig(2, "cosine")).rows.collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 0.0]}


def test_insert_is_idempotent_and_first_wins(spark, small):
    batch = spark.createDataFrame([("a", [9.0, 9.0], "new", 0), ("f", [1.0, 1.0], "first", 1), ("f", [2.0, 2.0], "second", 2), ("e", [1.0, 1.0], "again", 3)], BATCH)
    got = {r.ord: (r.id, r.metadata) for r in mutate.insert(small, batch).live().collect()}
    assert got[0] == ("a", '{"k": 1}') and got[5] == ("f", "first") and got[6] == ("e", "again") and len(got) == 6
    full = Collection(small.rows, CollectionConfig(2, max_count=5))
    with pytest.raises(ValueError, match="full"):
        mutate.insert(full, batch)
    assert mutate.insert(full, batch.where("id = 'a'")).rows.count() == 5


def test_update_moves_the_row_and_keeps_metadata(spark, small):
    new = spark.createDataFrame([("a", [5.0, 5.0], None), ("b", None, "m"), ("zz", [1.0, 1.0], None), ("e", [1.0, 1.0], None)], "id string, vector array<float>, metadata string")
    got = sorted((r.ord, r.id, r.metadata) for r in mutate.update(small, new).live().collect())
    assert got == [(1, "b", "m"), (2, "c", "{}"), (3, "d", "null"), (5, "a", '{"k": 1}')]
    assert sorted(ids(mutate.update(small, new).get_by_id("a"))) == ["a"]


def test_repeated_updates_of_one_id_count_as_one(spark, small):
    new = spark.createDataFrame([("a", None, '{"k": 9}', 1), ("a", [0.0, 5.0], None, 0), ("a", [0.0, 3.0], '{"k": 8}', 0), ("b", None, "{}", 3), ("b", None, None, 4)], BATCH)
    got = {r.id: (r.ord, r.metadata) for r in mutate.update(small, new).live().collect()}
    assert got == {"a": (5, '{"k": 9}'), "b": (1, "{}"), "c": (2, "{}"), "d": (3, "null")}
    got = [(r.id, r.metadata) for r in mutate.update_metadata(small, new.drop("batch_ord")).live().orderBy("ord").collect()]
    assert got == [("a", '{"k": 9}'), ("b", "{}"), ("c", "{}"), ("d", "null")]


def test_delete_everything_then_vacuum_and_sync(spark, small):
    empty = mutate.delete(small, small.rows)
    assert ids(search.exact_topk(empty.live(), [1.0, 0.0])) == [] and empty.counts().first().live_count == 0
    assert mutate.vacuum(empty).rows.count() == 0
    assert sorted(r.ord for r in mutate.vacuum(small).rows.collect()) == [0, 1, 2, 3]
    assert sorted(ids(mutate.sync_from(empty, small).live())) == ["a", "b", "c", "d"]


def test_numbering_is_gapless_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("k"))
    got = mutate.numbered(df, 10, "k").collect()
    assert sorted((r.k, r.ord) for r in got) == [(i, i + 10) for i in range(5000)]


def test_metadata_is_cut_at_bytes(spark):
    got = spark.createDataFrame([("aé" * 3,), ("abc",), (None,)], "m string").select(truncated_utf8(F.col("m"), 5).alias("m")).collect()
    assert [r.m for r in got] == ["aéa�", "abc", None]


def test_predicates_have_two_values(spark):
    rows = [(i, str(i), None, m, False) for i, m in enumerate(['{"p": 5, "s": "xy"}', "{}", '{"p": null}', "null", "", "oops", '{"p": 200}'])]
    c = TypedCollection(Collection(spark.createDataFrame(rows, ROWS), CollectionConfig(2)), "p int, s string")
    assert ids(c.where(field("p") < 100)) == ["0"]
    assert ids(c.where(~(field("p") < 100))) == ["1", "2", "6"]
    assert ids(c.where(field("p") != 5)) == ["1", "2", "6"]
    assert ids(c.where(field("p") == None)) == ["1", "2"]  # noqa: E711
    assert ids(c.where(field("s").contains("x") | (field("p") > 100))) == ["0", "6"]
    assert ids(c.where(field("p") < 100, max_results=0)) == []
    defaults = TypedCollection(c.collection, c.schema, (), {"p": 0})
    assert ids(defaults.where(field("p") < 100)) == ["0", "1", "2"]


def test_index_routing():
    indexed = ("brand", "kind")
    assert lookups((field("brand") == "x") & (field("kind") == 1), indexed) == [("brand", "x"), ("kind", 1)]
    for p in (field("brand") != "x", field("price") == 1, (field("brand") == "x") & (field("price") < 2), (field("brand") == "x") | (field("kind") == 1), field("brand") == None):  # noqa: E711
        assert lookups(p, indexed) is None


def test_contradictory_and_empty_lookups(spark):
    c = Collection(spark.createDataFrame([(0, "a", None, "m", False, 1), (1, "b", None, "m", False, None)], ROWS + ", label int"), CollectionConfig(2))
    assert ids(where_indexed(c, [("label", 1), ("label", 2)])) == [] and ids(where_indexed(c, [])) == [] and ids(where_indexed(c, [("label", 1)])) == ["a"]


def test_batch_and_beam_agree_with_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, vector array<double>")
    asks = rows.where("ord < 40").withColumnRenamed("ord", "qid")
    exact = search.batch_topk(asks, rows, 5, 8, query_block=16, base_block=64)
    s = np.round(x[:40] @ x.T, 6)
    want = {(q, int(o)) for q in range(40) for o in np.argsort(-s[q], kind="stable")[:5]}
    assert {(r.qid, r.ord) for r in exact.collect()} == want
    assert graph.knn_graph(rows, 3, 8).count() == 900


def test_store_and_cli(spark, tmp_path):
    path = f"{tmp_path}/c"
    cli.main(["init", "--path", path, "--dim", "2"], spark)
    cli.main(["add", "--path", path, "--vector", "1,0", "--metadata", "m", "--id", "a"], spark)
    cli.main(["add", "--path", path, "--vector", "0,1", "--id", "b"], spark)
    assert cli.main(["search", "--path", path, "--vector", "2,1", "--top", "1"], spark) == ["ID: a, Score: 2.0000, Meta: m"]
    found = load(spark, path)
    assert found.healthy() and found.config.max_count == 10_000
    save(mutate.delete(found, found.rows.where("id = 'a'")), path)
    assert ids(load(spark, path).live()) == ["b"]
    assert not Collection(found.rows, CollectionConfig(0)).healthy()


def test_partitioned_collections_filter_within_their_beam(spark):
    rows = spark.createDataFrame([(i, [float(i % 10)], i % 2) for i in range(40)], "ord long, vector array<float>, odd int")
    got = search.partitioned_topk(rows, [1.0], 3, 10, F.col("odd") == 0, 2).collect()
    assert [(r.part, r.ord) for r in got] == [(0, 8), (1, 18), (2, 28)]


def test_missing_ids_are_filled(spark):
    got = empty_id_filled(spark.createDataFrame([(None,), ("a",)], "id string")).collect()
    assert got[1].id == "a" and len(got[0].id) == 36


def test_stream(spark, tmp_path):
    path = f"{tmp_path}/s"
    create(spark, path, CollectionConfig(2))
    counter = itertools.count()
    for batch in ([("a", [1.0, 0.0], "1")], [("a", [9.0, 9.0], "2"), ("b", [0.0, 1.0], "3")]):
        spark.createDataFrame(batch, "id string, vector array<float>, metadata string").coalesce(1).write.parquet(f"{tmp_path}/in/{next(counter)}")
        stream = spark.readStream.schema("id string, vector array<float>, metadata string").parquet(f"{tmp_path}/in/*")
        query = ingest(stream, path, f"{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
    assert sorted((r.id, r.metadata) for r in load(spark, path).live().collect()) == [("a", "1"), ("b", "3")]


def test_wrong_query_vectors_raise(spark, small):
    for bad in ([1.0, float("nan")], [], [float("inf"), 0.0], [None, 1.0]):
        with pytest.raises(ValueError, match="finite components"):
            search.exact_topk(small.live(), bad, 1)
    with pytest.raises(Exception, match="another length"):
        search.exact_topk(small.live(), [1.0, 0.0, 0.0], 1).collect()
    with pytest.raises(ValueError, match="needs 2 components"):
        TypedCollection(small, "k int").search([1.0])
    with pytest.raises(Exception, match="2 components"):
        search.batch_topk(spark.createDataFrame([(0, [1.0])], "qid long, vector array<float>"), small.live(), 1, 2).collect()
    with pytest.raises(ValueError, match="distance"):
        search.exact_topk(small.live(), [1.0, 0.0], 1, None, "other")


def test_every_write_cuts_metadata(spark, small):
    c = Collection(small.rows, CollectionConfig(2, metadata_max_bytes=8))
    new = spark.createDataFrame([("a", [5.0, 5.0], "é" * 10, 0), ("b", None, "x" * 20, 1), ("n", [1.0, 1.0], "y" * 20, 2)], BATCH)
    assert {r.id: r.metadata for r in mutate.update(c, new).live().collect()} == {"a": "éééé", "b": "x" * 8, "c": "{}", "d": "null"}
    assert {r.metadata for r in mutate.update_metadata(c, new.where("id <> 'n'")).live().where("id in ('a', 'b')").collect()} == {"éééé", "x" * 8}
    assert mutate.insert(c, new).live().where("id = 'n'").first().metadata == "y" * 8


def test_typed_mutations(spark, small):
    config = CollectionConfig(2, indexed={"k": "int", "maker": "string"}, paths={"maker": "$.by.name"})
    c = TypedCollection(from_rows(small.rows, config), "k int, by struct<name: string>", ("k", "maker"))
    items = "id string, vector array<float>, item struct<k: int, by: struct<name: string>>, batch_ord long"
    more = c.add(spark.createDataFrame([("n", [1.0, 1.0], (7, ("m",)), 0), (None, [3.0, 0.0], (7, None), 1)], items))
    assert len(more.where(field("k") == 7).collect()) == 2 and ids(more.where(field("maker") == "m")) == ["n"]
    assert more.mode(field("maker") == "m") == "pre"
    new = more.update(spark.createDataFrame([("n", [0.0, 9.0], (8, None), 0), ("a", None, (9, ("m",)), 1), ("b", [4.0, 4.0], None, 2)], items))
    found = {r.id: (r.item.k, r.score) for r in new.search([0.0, 1.0], k=3).collect()}
    assert found == {"n": (8, 9.0), "b": (2, 4.0), "a": (9, 0.0)} or found["n"] == (8, 9.0) and found["b"] == (2, 4.0)
    assert ids(new.where(field("k") == 7)) != ["n"] and ids(new.where(field("maker") == "m")) == ["a"]
    items_only = new.update_items(spark.createDataFrame([("n", (1, None))], "id string, item struct<k: int, by: struct<name: string>>"))
    assert "n" in ids(items_only.where(field("k") == 1))
    assert "n" not in ids(items_only.delete(spark.createDataFrame([("n",)], "id string")).where(field("k") >= 0))


def test_postings_and_python_predicates(spark):
    rows = spark.createDataFrame([(0, "x", ["a", "b", None, "a"], "m0"), (1, None, None, "m1"), (2, "x", [], "m2")], "ord long, kind string, tags array<string>, metadata string")
    want = [("kind", "x", 0), ("kind", "x", 2), ("tag", "a", 0), ("tag", "b", 0)]
    assert sorted(map(tuple, postings(rows, {"kind": F.col("kind"), "tag": F.col("tags")}).collect())) == want
    assert [r.ord for r in rows.where(opaque(lambda m: m.endswith("1"))).collect()] == [1]
    assert [r.ord for r in rows.where(opaque(lambda k, o: k == "x" and o > 0, "kind", "ord")).collect()] == [2]


def test_release_removes_what_mutations_kept(spark, small):
    release(spark)
    c = mutate.insert(small, spark.createDataFrame([("n", [1.0, 1.0], "m", 0)], BATCH))
    assert c.rows.count() == 6
    assert c.close() == 1 and release(spark) == 0


def test_appends_write_their_own_rows_only(spark, tmp_path):
    path = f"{tmp_path}/c"
    create(spark, path, CollectionConfig(2, partition_size=2, max_count=6))
    with pytest.raises(FileExistsError):
        create(spark, path, CollectionConfig(2))
    batch = lambda *names: spark.createDataFrame([(n, [1.0, 0.0], n, k) for k, n in enumerate(names)], BATCH)
    store.append(spark, path, batch("a", "b", "c"))
    before = load(spark, path)
    store.append(spark, path, batch("b", "d", "e"))
    version = store.read_version(spark, path)
    assert spark.read.parquet(f"{path}/{version.data[-1]}").count() == 2
    assert sorted((r.ord, r.id, r.part) for r in load(spark, path).rows.collect()) == [(0, "a", 0), (1, "b", 0), (2, "c", 1), (3, "d", 1), (4, "e", 2)]
    store.delete(spark, path, batch("a", "zz"))
    assert sorted(ids(load(spark, path).live())) == ["b", "c", "d", "e"] and sorted(ids(load(spark, path, 2).live())) == ["a", "b", "c", "d", "e"]
    assert sorted(ids(before.rows)) == ["a", "b", "c"]  # an open reader keeps its version
    store.append(spark, path, batch("a"))
    with pytest.raises(ValueError, match="full"):
        store.append(spark, path, batch("f"))
    store.compact(spark, path)
    assert len(store.clean(spark, path, 1, 0)) == 4 and len(store.versions(spark, path)) == 1
    assert sorted((r.ord, r.id) for r in load(spark, path).live().collect()) == [(1, "b"), (2, "c"), (3, "d"), (4, "e"), (5, "a")]


def test_writers_at_once_lose_nothing_and_readers_never_fail(spark, tmp_path):
    path, rounds = f"{tmp_path}/c", 4
    create(spark, path, CollectionConfig(2))
    seen: list[int] = []
    done = threading.Event()

    def write(who):
        for k in range(rounds):
            store.append(spark, path, spark.createDataFrame([(f"{who}{k}", [1.0, 0.0], "m", 0)], BATCH))

    def read():
        while not done.is_set():
            seen.append(load(spark, path).rows.count())

    reader = threading.Thread(target=read)
    reader.start()
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, "xy"))
    done.set()
    reader.join()
    rows = load(spark, path).rows.collect()
    assert sorted(r.id for r in rows) == sorted(f"{w}{k}" for w in "xy" for k in range(rounds))
    assert sorted(r.ord for r in rows) == list(range(2 * rounds)) and seen == sorted(seen)


def test_stored_collection_of_parts_answers_by_part(spark, tmp_path):
    path = f"{tmp_path}/p"
    create(spark, path, CollectionConfig(1, partition_size=10))
    store.append(spark, path, spark.createDataFrame([(str(i), [float(i % 10)], "m", i) for i in range(35)], BATCH))
    got = load(spark, path)
    assert {(r.part, r["count"]) for r in got.rows.groupBy("part").count().collect()} == {(0, 10), (1, 10), (2, 10), (3, 5)}
    assert "part" in str(got.rows.where("part = 3")._jdf.queryExecution().executedPlan()) and got.rows.where("part = 3").count() == 5
    assert [(r.part, r.ord) for r in search.partitioned_topk(got.live(), [1.0], 3, 10).collect()] == [(0, 9), (1, 19), (2, 29)]


def test_layered_index_is_built_once_stored_and_descended(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, str(i), [float(v) for v in r]) for i, r in enumerate(x)], "ord long, id string, vector array<double>")
    asks = rows.where("ord % 60 = 0").withColumnRenamed("ord", "qid")
    exact = search.batch_topk(asks, rows, 5, 16).cache()
    ann.build_index(rows, 16, m=12, shard_rows=500).save(f"{tmp_path}/index")
    index = ann.LayeredIndex.load(spark, f"{tmp_path}/index")
    assert ann.LayeredIndex.exists(spark, f"{tmp_path}/index") and index.shards.count() >= 6
    found = ann.ann_topk(asks, index, 5, ef=40, probes=4, query_block=8).cache()
    assert ann.recall(found, exact).first().recall >= 0.9
    assert 0 < found.agg(F.max("scored")).first()[0] < 1500  # in one shard, of 3,000 rows
    levels = {r.level: r["count"] for r in index.nodes().groupBy("level").count().collect()}
    assert sum(levels.values()) == 3000 and 100 < sum(n for k, n in levels.items() if k) < 420
    edges = index.neighbours().cache()
    assert edges.groupBy("level", "src").count().agg(F.max("count")).first()[0] == 12 and edges.where("src = dst").count() == 0
    gone = rows.where("ord % 2 = 0").select("ord")
    left = index.unlinked(gone)
    assert left.neighbours().where("src % 2 = 0 or dst % 2 = 0").count() == 0 and left.stats().where("level = 0").first().nodes == 1500
    assert ann.ann_topk(asks, left, 5, ef=40, probes=4).where("ord % 2 = 0").count() == 0
    none = ann.build_index(rows.limit(0), 16)
    assert ann.ann_topk(asks, none, 5).count() == 0
