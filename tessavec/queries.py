"""One query per operator over the test tables, each with the SQL that gives the same rows.

``embeddings`` is the collection: vec_id is ordinal and id, label the indexed field. Rows whose vec_id 7
divides stand for deleted ones where a query is about deletions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CollectionConfig
from .functions.vector import l2_normalize, norm, score, truncated_utf8
from .operators import ann, graph, mutate, search
from .operators.collection import Collection, first_match, inverted_index, opaque, postings, promote, where, where_indexed
from .operators.typed import TypedCollection, serialize
from .plans.predicate import field
from .sources.shared import settled

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"), (F.col("vec_id") % 7 == 0).alias("deleted"), "label")


def _all(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(_rows(spark, sf_dir).withColumn("deleted", F.lit(False)), CollectionConfig(DIM, indexed={"label": "int"}))


def _some(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(_rows(spark, sf_dir), CollectionConfig(DIM, indexed={"label": "int"}))


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector: one row."""
    return _table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SC = f"SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings"
_SCALED = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings"


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def scan_live(spark, sf_dir):
    return _some(spark, sf_dir).live().select(F.col("ord").alias("vec_id"), "label")


@query("SELECT vec_id::VARCHAR AS id, '{\"label\":' || label || '}' AS metadata FROM embeddings WHERE vec_id = 42")
def get_by_id(spark, sf_dir):
    return _all(spark, sf_dir).get_by_id("42").select("id", "metadata")


@query("SELECT count(*) AS allocated_count, count(*) FILTER (vec_id % 7 = 0) AS deleted_count, count(*) FILTER (vec_id % 7 <> 0) AS live_count FROM embeddings")
def count_stats(spark, sf_dir):
    return _some(spark, sf_dir).counts()


@query(f"SELECT vec_id, score FROM ({_SC})")
def dot_scores(spark, sf_dir):
    return _rows(spark, sf_dir).select(F.col("ord").alias("vec_id"), score(F.col("vector"), _vector(spark, sf_dir)).alias("score"))


def _scaled(spark, sf_dir):
    by = 1 + F.col("ord") % 5
    return _rows(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * by))


@query(f"""WITH s AS ({_SCALED}), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM s)
SELECT vec_id, round(l, 6) AS length, round(v[1] / l, 6) AS first_component, round(list_sum(list_transform(v, lambda x: x / l)), 6) AS component_sum FROM n""")
def normalize(spark, sf_dir):
    rows = _scaled(spark, sf_dir).withColumn("unit", l2_normalize(F.col("vector")))
    total = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x)
    return rows.select(F.col("ord").alias("vec_id"), F.round(norm(F.col("vector")), 6).alias("length"), F.round(F.col("unit")[0], 6).alias("first_component"), F.round(total, 6).alias("component_sum"))


@query(f"""SELECT vec_id, round(list_dot_product(v, {_Q}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({_Q}, {_Q}))), 6) AS score
FROM ({_SCALED}) ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(spark, sf_dir):
    return search.exact_topk(_scaled(spark, sf_dir), _vector(spark, sf_dir), 10, None, "cosine").select(F.col("ord").alias("vec_id"), "score")


def _hits(df: DataFrame) -> DataFrame:
    return df.select(F.col("ord").alias("vec_id"), "score")


@query(f"SELECT vec_id, score FROM ({_SC}) ORDER BY score DESC, vec_id LIMIT 5")
def exact_topk(spark, sf_dir):
    return _hits(search.exact_topk(_rows(spark, sf_dir), _vector(spark, sf_dir), 5))


@query(f"SELECT vec_id, score FROM ({_SC}) WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 5")
def exact_topk_filtered(spark, sf_dir):
    return _hits(search.exact_topk(_rows(spark, sf_dir), _vector(spark, sf_dir), 5, F.col("label").isin(1, 3, 5)))


@query(f"SELECT vec_id, score FROM ({_SC}) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def prefilter_topk(spark, sf_dir):
    return _hits(search.exact_topk(_rows(spark, sf_dir), _vector(spark, sf_dir), 5, F.col("label") == 3))


@query(f"SELECT vec_id, score FROM (SELECT * FROM ({_SC}) ORDER BY score DESC, vec_id LIMIT 50) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def hybrid_post(spark, sf_dir):
    return _hits(search.hybrid_post(_rows(spark, sf_dir), _vector(spark, sf_dir), F.col("label") == 3, 5, 50))


_PART = f"SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, vec_id) AS r FROM (SELECT *, vec_id // 128 AS part FROM ({_SC}))"


@query(f"SELECT vec_id, part, score FROM ({_PART}) WHERE r <= 5 ORDER BY score DESC, vec_id LIMIT 5")
def partitioned_topk(spark, sf_dir):
    return search.partitioned_topk(_rows(spark, sf_dir), _vector(spark, sf_dir), 5, 128).select(F.col("ord").alias("vec_id"), "part", "score")


@query(f"""SELECT vec_id, part, score FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, vec_id) AS p FROM ({_PART}) WHERE r <= 50 AND label = 3)
WHERE p <= 5 ORDER BY score DESC, vec_id LIMIT 5""")
def partitioned_hybrid(spark, sf_dir):
    return search.partitioned_topk(_rows(spark, sf_dir), _vector(spark, sf_dir), 5, 128, F.col("label") == 3, 50).select(F.col("ord").alias("vec_id"), "part", "score")


@query("SELECT vec_id // 128 AS part, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings GROUP BY 1")
def partition_layout(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy(search.partition_of(128).alias("part")).agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


_PAIRS = "SELECT a.vec_id AS qid, b.vec_id AS vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b"
_BATCH = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({_PAIRS} WHERE a.vec_id % 20 = 0)"


def _asking(spark, sf_dir):
    """The stated query set: every row whose id 20 divides."""
    return _rows(spark, sf_dir).where(F.col("ord") % 20 == 0).select(F.col("ord").alias("qid"), "vector")


@query(f"SELECT qid, vec_id, score, rank FROM ({_BATCH}) WHERE rank <= 5")
def batch_topk(spark, sf_dir):
    found = search.batch_topk(_asking(spark, sf_dir), _rows(spark, sf_dir), 5, DIM)
    return found.select("qid", F.col("ord").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


_KNN = f"SELECT qid AS src, vec_id AS dst, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM ({_PAIRS} WHERE a.vec_id <> b.vec_id) QUALIFY rank <= 8"


def _knn(spark, sf_dir):
    edges = graph.knn_graph(_rows(spark, sf_dir), 8, DIM)
    return edges.withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT src, rank, dst, score FROM ({_KNN})")
def knn_graph(spark, sf_dir):
    return _knn(spark, sf_dir)


_PRUNED = f"""SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank
FROM (SELECT src, dst, score FROM ({_KNN}) UNION SELECT dst, src, score FROM ({_KNN})) QUALIFY rank <= 8"""


@query(f"SELECT src, rank, dst, score FROM ({_PRUNED})")
def knn_pruned(spark, sf_dir):
    return graph.prune(_knn(spark, sf_dir), 8).select("src", F.col("rank").cast("long").alias("rank"), "dst", "score")


@query(f"SELECT src, rank, dst, score FROM ({_KNN}) WHERE src % 7 <> 0 AND dst % 7 <> 0")
def graph_after_delete(spark, sf_dir):
    return graph.without_nodes(_knn(spark, sf_dir), _rows(spark, sf_dir).where("deleted").select("ord"))


@query("SELECT min(vec_id) AS entry FROM embeddings WHERE vec_id % 7 <> 0")
def entry_point(spark, sf_dir):
    return graph.entry_point(_rows(spark, sf_dir))


def _level(id_sql: str) -> str:
    """The level of an id at 32 neighbours a node: drawn from the first 52 bits of its MD5."""
    return f"least(floor(-ln((('0x' || substr(md5({id_sql}), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0) / ln(32)), 4)::INT"


@query(f"SELECT {_level('vec_id::VARCHAR')} AS level, count(*) AS nodes FROM embeddings GROUP BY 1")
def level_histogram(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy(graph.level_of(F.col("id"), 32, 5).alias("level")).agg(F.count("*").alias("nodes"))


@query(f"""WITH n AS (SELECT {_level('vec_id::VARCHAR')} AS top FROM embeddings WHERE vec_id % 7 <> 0),
c AS (SELECT level, (SELECT count(*) FROM n WHERE top >= level) AS nodes FROM range(5) r(level))
SELECT level::INT AS level, CASE WHEN level = 0 OR nodes > 1 THEN nodes ELSE 0 END AS nodes FROM c""")
def graph_stats(spark, sf_dir):
    """Of a layered index over the live rows: at level 0 all nodes, above it those that have neighbours."""
    return ann.build_index(_rows(spark, sf_dir).where("not deleted"), DIM).stats()


@query()
def graph_neighbours(spark, sf_dir):
    """All edges of a layered index from which the deleted rows were unlinked."""
    index = ann.build_index(_rows(spark, sf_dir), DIM)
    return index.unlinked(_rows(spark, sf_dir).where("deleted")).neighbours()


@query()
def ann_recall(spark, sf_dir):
    """Of each query: its true neighbours among those that a layered index finds, and how many vectors it was compared with."""
    asking, rows = _asking(spark, sf_dir), _rows(spark, sf_dir)
    index = ann.build_index(rows, DIM, m=12)
    found = settled(ann.ann_topk(asking, index, 5, **ann.tuned(index, rows, 5, DIM)))
    scored = found.groupBy("qid").agg(F.max("scored").alias("scored"))
    return ann.hits(found, search.batch_topk(asking, rows, 5, DIM)).join(scored, "qid")


def _events(spark, sf_dir) -> Collection:
    e = _table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.col("props").alias("metadata"), F.lit(False).alias("deleted"), "event_type")
    return Collection(rows, CollectionConfig(DIM))


@query("""SELECT event_id::VARCHAR AS id, props AS metadata FROM events WHERE contains(props, '"k": 8') ORDER BY event_id LIMIT 100""")
def where_metadata(spark, sf_dir):
    return where(_events(spark, sf_dir), F.col("metadata").contains('"k": 8'))


def _docs(spark, sf_dir) -> Collection:
    d = _table(spark, sf_dir, "documents")
    return Collection(d.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.col("text").alias("metadata"), F.lit(False).alias("deleted"), "lang", "source"), CollectionConfig(DIM))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 100", name="where_indexed")
def where_indexed_one(spark, sf_dir):
    return where_indexed(_docs(spark, sf_dir), [("lang", "de")]).select("id")


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE lang = 'de' AND source = 'src0' ORDER BY doc_id LIMIT 100")
def where_indexed_and(spark, sf_dir):
    return where_indexed(_docs(spark, sf_dir), [("lang", "de"), ("source", "src0")]).select("id")


@query("SELECT event_id::VARCHAR AS id, props AS metadata FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 1", name="first_match")
def first_match_event(spark, sf_dir):
    return first_match(_events(spark, sf_dir), F.col("event_type") == "purchase")


def _typed_events(spark, sf_dir) -> TypedCollection:
    return TypedCollection(_events(spark, sf_dir), "k int", ("event_type",), {"k": 0})


_K = "coalesce(json_extract_string(props, '$.k')::INT, 0)"


def _item_k(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("item.k").alias("k"))


@query(f"SELECT event_id::VARCHAR AS id, {_K} AS k FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100")
def typed_where_eq(spark, sf_dir):
    return _item_k(_typed_events(spark, sf_dir).where(field("event_type") == "click"))


@query(f"SELECT event_id::VARCHAR AS id, {_K} AS k FROM events WHERE {_K} < 10 AND NOT {_K} = 3 ORDER BY event_id LIMIT 100")
def typed_where_range(spark, sf_dir):
    return _item_k(_typed_events(spark, sf_dir).where((field("k") < 10) & ~(field("k") == 3)))


@query(f"SELECT event_id::VARCHAR AS id, {_K} AS k FROM events WHERE contains(event_type, 'ur') ORDER BY event_id LIMIT 100")
def typed_where_contains(spark, sf_dir):
    return _item_k(_typed_events(spark, sf_dir).where(field("event_type").contains("ur")))


def _typed(spark, sf_dir) -> TypedCollection:
    return TypedCollection(_all(spark, sf_dir), "label int", ("label",))


def _item_label(df: DataFrame) -> DataFrame:
    return df.select("id", "score", F.col("item.label").alias("label"))


@query(f"SELECT vec_id::VARCHAR AS id, score, label FROM ({_SC}) ORDER BY score DESC, vec_id LIMIT 5")
def typed_topk(spark, sf_dir):
    return _item_label(_typed(spark, sf_dir).search(_vector(spark, sf_dir)))


@query(f"SELECT vec_id::VARCHAR AS id, score, label FROM ({_SC}) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def typed_hybrid_eq(spark, sf_dir):
    return _item_label(_typed(spark, sf_dir).search(_vector(spark, sf_dir), field("label") == 3))


@query(f"SELECT vec_id::VARCHAR AS id, score, label FROM (SELECT * FROM ({_SC}) ORDER BY score DESC, vec_id LIMIT 50) WHERE label > 6 ORDER BY score DESC, vec_id LIMIT 5")
def typed_hybrid_range(spark, sf_dir):
    return _item_label(_typed(spark, sf_dir).search(_vector(spark, sf_dir), field("label") > 6))


@query("SELECT part.p_partkey AS key, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part")
def typed_roundtrip(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", serialize(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))).alias("metadata"))
    return p.select(F.col("p_partkey").alias("key"), F.from_json("metadata", "brand string, size int, price double").alias("i")).select("key", "i.*")


def _items(spark, sf_dir) -> TypedCollection:
    """Of the events: k from the JSON and, as an indexed field, its parity."""
    e = _events(spark, sf_dir).rows.select("ord", "id", F.array(F.col("ord").cast("float")).alias("vector"), "metadata", "deleted")
    config = CollectionConfig(1, indexed={"k": "int"})
    return TypedCollection(Collection(promote(e, config), config), "k int", ("k",))


_IDS = "SELECT event_id::VARCHAR AS id, json_extract_string(props, '$.k')::INT AS k, event_id FROM events"


@query(f"""SELECT id, k FROM ({_IDS}) WHERE k = 8 UNION ALL SELECT 'new' || id, 8 FROM ({_IDS}) WHERE event_id % 50 = 0""")
def typed_add(spark, sf_dir):
    """Added items are found by their indexed field; ids that are known already change nothing."""
    c = _items(spark, sf_dir)
    item = F.struct(F.lit(8).alias("k")).alias("item")
    some = c.collection.rows.where(F.col("ord") % 50 == 0)
    new = some.select(F.concat(F.lit("new"), "id").alias("id"), "vector", item, F.col("ord").alias("batch_ord"))
    known = some.select("id", "vector", item, F.col("ord").alias("batch_ord"))
    return c.add(new.unionByName(known)).where(field("k") == 8, 1 << 30).select("id", F.col("item.k").alias("k"))


@query(f"""SELECT id, CASE WHEN event_id % 3 = 0 THEN k + 1000 ELSE k END AS k, CASE WHEN event_id % 6 = 0 THEN -1.0 ELSE event_id::DOUBLE END AS score
FROM ({_IDS}) WHERE k > 20 OR event_id % 3 = 0""")
def typed_update(spark, sf_dir):
    """Every third item changes, and of those every second has a new vector too."""
    c = _items(spark, sf_dir)
    rows = c.rows().where(F.col("ord") % 3 == 0)
    vector = F.when(F.col("ord") % 2 == 0, F.array(F.lit(-1.0).cast("float")))
    new = rows.select("id", vector.alias("vector"), F.struct((F.col("item.k") + 1000).alias("k")).alias("item"))
    return c.update(new).search([1.0], field("k") > 20, 1 << 30, mode="pre").select("id", F.col("item.k").alias("k"), "score")


@query(f"SELECT id, k FROM ({_IDS}) WHERE k % 2 = 1 AND event_id % 4 <> 0")
def typed_delete(spark, sf_dir):
    """Deleted items are no longer found, here by a Python function of the item's field."""
    c = _items(spark, sf_dir)
    left = c.delete(c.collection.rows.where(F.col("ord") % 4 == 0).select("id"))
    return left.rows().where(opaque(lambda k: k is not None and k % 2 == 1, "k")).select("id", "k")


@query("SELECT page_id, octet_length(encode(html)) <= 512 AS whole, CASE WHEN octet_length(encode(html)) = length(html) THEN sha256(left(html, 512)) END AS ascii_sha256 FROM pages")
def metadata_truncate(spark, sf_dir):
    """Texts of ASCII alone are cut alike by bytes and characters; the tests cover cut characters."""
    html = F.col("html")
    cut = truncated_utf8(html, 512)
    return _table(spark, sf_dir, "pages").select("page_id", (cut == html).alias("whole"), F.when(F.octet_length(html) == F.length(html), F.sha2(cut, 256)).alias("ascii_sha256"))


@query("SELECT vec_id AS ord, vec_id::VARCHAR AS id, label, vec_id % 7 = 0 AS deleted FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id), vec_id::VARCHAR, label, false FROM embeddings WHERE vec_id % 7 = 0")
def insert_dedup(spark, sf_dir):
    c = _some(spark, sf_dir)
    batch = c.rows.select("id", "vector", "metadata", F.col("ord").alias("batch_ord"))
    twice = batch.unionByName(batch.withColumn("batch_ord", F.col("batch_ord") + 1_000_000_000))
    return mutate.insert(c, twice).rows.select("ord", "id", "label", "deleted")


@query("SELECT vec_id AS ord, vec_id % 3 = 0 AS deleted FROM embeddings")
def delete_one(spark, sf_dir):
    c = _all(spark, sf_dir)
    return mutate.delete(c, c.rows.where(F.col("ord") % 3 == 0)).rows.select("ord", "deleted")


@query("SELECT vec_id AS ord, CASE WHEN vec_id % 3 = 0 AND vec_id % 7 <> 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def update_metadata(spark, sf_dir):
    c = _some(spark, sf_dir)
    new = c.rows.where(F.col("ord") % 3 == 0).select("id", F.to_json(F.struct((F.col("label") + 100).alias("label"))).alias("metadata"))
    return mutate.update_metadata(c, new).rows.select("ord", "label")


@query("""SELECT vec_id AS ord, CASE WHEN vec_id % 7 = 0 OR vec_id % 3 <> 0 THEN '{"label":' || label || '}' ELSE left('vector ' || vec_id || ' of label ' || label, 12) END AS metadata FROM embeddings""")
def update_truncated(spark, sf_dir):
    """New metadata over the limit of 12 bytes is cut like that of an insert."""
    rows = _rows(spark, sf_dir)
    c = Collection(rows, CollectionConfig(DIM, metadata_max_bytes=12))
    new = rows.where(F.col("ord") % 3 == 0).select("id", F.format_string("vector %d of label %d", "ord", "label").alias("metadata"))
    return mutate.update_metadata(c, new).rows.select("ord", "metadata")


@query("""SELECT vec_id AS ord, vec_id // 200 AS part FROM embeddings
UNION ALL SELECT o, o // 200 FROM (SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY doc_id) AS o FROM documents)""")
def partition_insert(spark, sf_dir):
    """Rows go to the last part until it is full, then to a new one."""
    rows, config = _rows(spark, sf_dir).drop("label"), CollectionConfig(DIM, partition_size=200)
    c = mutate.with_part(rows, Collection(rows, config))
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    batch = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), zero.alias("vector"), F.col("lang").alias("metadata"), F.col("doc_id").alias("batch_ord"))
    return mutate.insert(Collection(c, config), batch).rows.select("ord", "part")


_MOVED = "SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id) AS ord, vec_id::VARCHAR AS id, {label} AS label, false AS deleted, round(-embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 7 <> 0"
_KEPT = "SELECT vec_id AS ord, vec_id::VARCHAR AS id, {label} AS label, vec_id % 7 = 0 OR vec_id % 3 = 0 AS deleted, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings"


def _updated(spark, sf_dir, metadata) -> DataFrame:
    c = _some(spark, sf_dir)
    new = c.rows.where(F.col("ord") % 3 == 0).select("id", F.transform("vector", lambda x: -x).alias("vector"), metadata.alias("metadata"))
    return mutate.update(c, new).rows.select("ord", "id", "label", "deleted", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query(_KEPT.format(label="label") + " UNION ALL " + _MOVED.format(label="label"))
def update_vector(spark, sf_dir):
    return _updated(spark, sf_dir, F.lit(None).cast("string"))


@query(_KEPT.format(label="label") + " UNION ALL " + _MOVED.format(label="label + 100"))
def update_both(spark, sf_dir):
    return _updated(spark, sf_dir, F.to_json(F.struct((F.col("label") + 100).alias("label"))))


@query("SELECT label::VARCHAR AS id, max(vec_id) AS ord FROM embeddings GROUP BY label")
def latest_by_id(spark, sf_dir):
    return mutate.latest_by_id(_rows(spark, sf_dir).select(F.col("label").cast("string").alias("id"), "ord", "metadata")).select("id", "ord")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 7 <> 0")
def vacuum(spark, sf_dir):
    return mutate.vacuum(_some(spark, sf_dir)).rows.select("ord", "id")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def sync_new_rows(spark, sf_dir):
    source = _docs(spark, sf_dir)
    known = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit(False).alias("deleted"))
    return mutate.missing_rows(source, Collection(known, source.config)).select(F.col("ord").alias("doc_id"), "lang")


@query("SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id::VARCHAR, label FROM embeddings WHERE vec_id % 7 = 0")
def sync_union(spark, sf_dir):
    return mutate.sync_from(_some(spark, sf_dir), _all(spark, sf_dir)).live().select("id", "label")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n, min(doc_id) AS lowest FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents WHERE source IS NOT NULL GROUP BY source", name="inverted_index")
def inverted_index_fields(spark, sf_dir):
    return inverted_index(_docs(spark, sf_dir).rows, ("lang", "source"))


@query("""SELECT 'lang' AS field, lang AS value, doc_id AS ord FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT DISTINCT 'word', w, doc_id FROM (SELECT doc_id, unnest(string_split(source, 'r')) AS w FROM documents) WHERE w IS NOT NULL""", name="postings")
def postings_of(spark, sf_dir):
    """The posting lists of a column and of an extractor that gives several values a row."""
    return postings(_docs(spark, sf_dir).rows, {"lang": F.col("lang"), "word": F.split("source", "r")})
