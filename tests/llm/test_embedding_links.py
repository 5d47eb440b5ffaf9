"""Embedding near-dedup at ties, with repeated ids, several blocks and rare lengths, against all pairs and SQL."""

import duckdb
import numpy as np

from tessavec.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>"


def found(frame):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in dedup.near_duplicates(frame).collect())


def by_sql(frame):
    embeddings = frame.toPandas()  # noqa: F841  DuckDB reads it by name
    return sorted(tuple(r) for r in duckdb.sql("SELECT vec_id, n_links, component_id, kept FROM (" + dedup.OP1_SQL + ")").fetchall())


def tied_pairs(n, dim=64):
    """Pairs of vectors whose cosine is 0.9 up to rounding."""
    rng = np.random.default_rng(8)
    out = []
    for _ in range(n):
        x = rng.normal(size=dim)
        y = rng.normal(size=dim)
        y -= (y @ x) / (x @ x) * x
        y *= np.sqrt((1 / 0.81 - 1) * (x @ x) / (y @ y))
        out += [x, x + y]
    return [v.astype("f4").tolist() for v in out]


def test_ties_are_decided_in_double_precision(spark):
    exact = [[9.0, 0.0, 0.0], [9.0, 3.0, float(np.sqrt(10.0))], [10.0, 0.0, 0.0], [0.0, 4.0, 3.0], [0.0, 4.0, -3.0]]
    rows = list(enumerate(tied_pairs(150) + [v + [0.0] * 61 for v in exact]))
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame) == by_sql(frame)


def test_rows_of_one_id_are_one_node(spark):
    x, y, near_y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(3, x), (5, x), (5, y), (9, near_y), (5, None), (None, x), (None, None), (7, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "mine", i) for i, r in enumerate(rows)], SCHEMA + ", raw string, `a.b` int")
    assert [r.component_id for r in dedup.near_duplicates(frame).where("vec_id in (3, 5, 9)").collect()] == [3] * 5
    want = [(3, 1, 3, True), (5, 0, 3, False), (5, 1, 3, False), (5, 1, 3, False), (7, 0, 7, True), (7, 0, 7, True), (9, 1, 3, False)]
    assert sorted(r for r in map(tuple, dedup.near_duplicates(frame).where("vec_id is not null").collect())) == want
    kept = dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r.vec_id or 0, r["a.b"]) for r in kept.collect()) == [(0, 5), (0, 6), (3, 0), (7, 7), (7, 8)]


def test_blocks_slices_and_rare_lengths(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    x = [(b + rng.normal(size=12) * 0.25).tolist() for b in base for _ in range(6)]
    x += [[1.0 + k / 1e4, *[0.0] * 11] for k in range(200)]  # one direction, no two vectors equal
    for n in range(1, 9):
        x += [rng.normal(size=n).tolist() for _ in range(12 + n)]
    order = rng.permutation(len(x))
    rows = [(int(i), x[i]) for i in order]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in unit}
    root = {i: i for i in unit}
    for _ in range(60):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in root}
    want = sorted((i, len(links[i]), root[i], root[i] == i) for i in unit)
    assert found(frame) == want
    monkeypatch.setattr(dedup, "FEWEST", 40)
    monkeypatch.setattr(dedup, "rows_of_block", lambda dim: 50)
    monkeypatch.setattr(dedup, "SAMPLE_BYTES", 4000)
    assert found(frame) == want


def test_prefiltered_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    x = dedup.unit(rng.normal(size=(50, 24)) + 2 * rng.normal(size=(1, 24)))
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    turned = (x @ basis).astype("f4")
    i, j = dedup.linked(x, x, turned, turned, 0.9, True)
    want = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and len(want)


def test_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "`my.id` long, `my.vec` array<double>")
    got = dedup.near_duplicates(frame, "my.id", "my.vec").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert [r["my.id"] for r in dedup.drop_near_duplicates(frame, "my.id", "my.vec").collect()] == [1]
