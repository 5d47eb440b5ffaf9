"""Exact, hybrid, partitioned and batch top-k. Ranks are by score descending, then ordinal ascending."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions.vector import SCORE_DIGITS, score


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), F.col("ord").asc()).limit(max(0, k))


def exact_topk(rows: DataFrame, query: Sequence[float], k: int = 5, predicate: Column | None = None, distance: str = "dot") -> DataFrame:
    """``rows`` with their score, the best ``k``; a predicate applies before scoring, so it is exact."""
    if predicate is not None:
        rows = rows.where(predicate)
    return _ranked(rows.withColumn("score", score(F.col("vector"), query, distance)), k)


def hybrid_post(rows: DataFrame, query: Sequence[float], predicate: Column, k: int = 5, ef: int = 50, distance: str = "dot") -> DataFrame:
    """Ranks first, keeps a beam of max(k, ef), then filters; may return fewer than ``k``."""
    return _ranked(exact_topk(rows, query, max(k, ef), None, distance).where(predicate), k)


def partition_of(size: int) -> Column:
    """The part that a row belongs to: parts roll over after ``size`` rows."""
    return F.floor(F.col("ord") / size).cast("long")


def partitioned_topk(rows: DataFrame, query: Sequence[float], k: int, size: int, predicate: Column | None = None, ef: int = 50, distance: str = "dot") -> DataFrame:
    """Best of every part, then best of those. With a predicate each part has a beam of its own before it filters."""
    window = Window.partitionBy("part").orderBy(F.col("score").desc(), F.col("ord").asc())
    scored = rows.withColumn("score", score(F.col("vector"), query, distance)).withColumn("part", partition_of(size))
    scored = scored.withColumn("__place", F.row_number().over(window))
    if predicate is None:
        return _ranked(scored.where(F.col("__place") <= k).drop("__place"), k)
    beam = scored.where(F.col("__place") <= max(k, ef)).where(predicate)
    return _ranked(beam.withColumn("__place", F.row_number().over(window)).where(F.col("__place") <= k).drop("__place"), k)


#: Bytes of a packed row of vectors in double precision, and packed rows on a side of a tile; pairs that a tile scores at once.
CHUNK_BYTES, TILE_CHUNKS, PAIRS = 1 << 21, 8, 1 << 15


def _packed(rows: DataFrame, key: str, dim: int, per_tile: int, n: int, tiles: int, name: str) -> DataFrame:
    """Rows (tile, ids, x) of ``n`` vectors in ``tiles`` tiles, a few rows a tile; x has the vectors' own precision."""
    chunks = tiles * max(1, -(-n // (tiles * min(per_tile, max(1, CHUNK_BYTES // (8 * dim))))))
    single = rows.schema["vector"].dataType.elementType == FloatType()
    kind = "<f4" if single else "<f8"

    def pack(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        if v.null_count or len(v.values) != dim * len(v) or set(pc.list_value_length(v).to_pylist()) - {dim}:
            raise ValueError(f"every vector needs {dim} components")
        x = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
        if not np.isfinite(x).all():
            raise ValueError("every vector needs finite components")
        tile = table.column("chunk")[0].as_py() % tiles
        return pa.table({name: pa.array([tile], pa.int32()), "ids": pa.array([table.column("key").to_numpy().astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    vector = F.col("vector") if single else F.col("vector").cast("array<double>")
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"), F.col(key).cast("long").alias("key"), vector.alias("v"))
    return dealt.groupBy("chunk").applyInArrow(pack, f"{name} int, ids binary, x binary")


def tiles_of(asked: int, n: int, dim: int, query_block: int | None = None, base_block: int | None = None) -> tuple[int, int, int, int]:
    """(tiles of the queries, of the rows, most vectors in each): about 64 products at least where there are enough vectors, of bounded size."""
    least = max(1, CHUNK_BYTES // (8 * dim))
    most_q, most_b = query_block or TILE_CHUNKS * least, base_block or TILE_CHUNKS * least
    b = max(1, -(-n // most_b), min(8, -(-n // least)))
    return max(1, -(-asked // most_q), min(-(-64 // b), -(-asked // least))), b, most_q, most_b


def nearest(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool = False, rows: int = 512, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the best ``k`` of ``x`` for every row of ``q``, best first; missing ones score -inf.

    Products in single precision, with a bound of their error, sieve out what can't be among the best; the rest is scored in double.
    """
    order = np.argsort(ids, kind="stable")  # ids ascend, so a later row needs a higher score to displace one
    ids, x, q = ids[order], x[order].astype("<f8"), q.astype("<f8")
    k = max(0, min(k, len(ids)))
    out_s, out_i = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
    if not k or not len(q):
        return out_i, out_s
    q_length, x_length = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (q, x))
    most = x_length.max()
    kind = np.float32 if max(most, 1) * max(q_length.max(), 1) < 1e30 else np.float64
    bound = lambda of: q_length * most * (x.shape[1] + 4) * np.finfo(of).eps
    slack, fine = bound(kind), bound(np.float64)
    qs, xs = q.astype(kind), x.astype(kind)
    first, last = (np.searchsorted(ids, qid, side) for side in ("left", "right"))
    same = int((last - first).max()) if exclude_self else 0

    def product(a: int, b: int, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = q[a : a + rows] @ x[b : b + columns].T
        for j in range(same):
            at = first[a : a + rows] + j
            mine = np.flatnonzero((at < last[a : a + rows]) & (at >= b) & (at < b + s.shape[1]))
            s[mine, at[mine] - b] = -np.inf
        return s

    def floor(s: np.ndarray) -> np.ndarray:
        """Of each row, a score that ``k`` of its scores reach."""
        groups = min(s.shape[1], 8 * k)
        if groups < k:
            return np.full(len(s), -np.inf)
        each = s.shape[1] // groups
        tops = s[:, : groups * each].reshape(len(s), groups, each).max(axis=2)
        return np.partition(tops, groups - k, axis=1)[:, groups - k]

    def hits(s: np.ndarray, worst: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = worst - slack
        if np.isneginf(worst).any():
            least = np.where(np.isneginf(worst), floor(s) - 2 * slack - 10.0**-SCORE_DIGITS, least)
        r, c = np.divmod(np.flatnonzero(s >= least.astype(s.dtype)[:, None]), s.shape[1])
        there = s[r, c] > -np.inf
        return r[there], c[there]

    for a in range(0, len(q), rows):
        for b in range(0, len(x), columns):
            worst = out_s[a : a + rows, -1]
            r, c = hits(product(a, b, qs, xs), worst, slack[a : a + rows])
            if len(r) > PAIRS:  # many alike: a second sieve in double leaves out those that only tie
                s = product(a, b, q, x)
                r, c = hits(s, worst, fine[a : a + rows])
                beats = np.round(s[r, c] + fine[a + r], SCORE_DIGITS) > worst[r]
                r, c = r[beats], c[beats]
            v = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[a + r[i : i + PAIRS]], x[b + c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS))])
            v = np.round(v, SCORE_DIGITS)
            better = v > worst[r]
            r, c, v = r[better], c[better], v[better]
            if not len(r):
                continue
            changed = np.unique(r)
            of = np.concatenate([np.repeat(changed, k), r])
            s, i = np.concatenate([out_s[a + changed].ravel(), v]), np.concatenate([out_i[a + changed].ravel(), ids[b + c]])
            order = np.lexsort((i, -s, of))
            of = of[order]
            order = order[np.arange(len(of)) - np.searchsorted(of, of) < k]
            out_s[a + changed], out_i[a + changed] = s[order].reshape(-1, k), i[order].reshape(-1, k)
    return out_i, out_s


def batch_topk(queries: DataFrame, base: DataFrame, k: int, dim: int, exclude_self: bool = False, query_block: int | None = None, base_block: int | None = None) -> DataFrame:
    """(qid, ord, score, rank) of the best ``k`` rows of ``base`` for every query; queries have qid and vector.

    Tiles of queries meet tiles of rows, of bounded size, in one task each: a vector travels once for every tile of the other
    side. A tile gives at most ``k`` rows a query, which a window merges. Comparing all pairs stays quadratic in time.
    """
    asked, n = queries.count(), base.count()
    q_tiles, b_tiles, most_q, most_b = tiles_of(asked, n, dim, query_block, base_block)
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = _packed(queries, "qid", dim, most_q, asked, q_tiles, "q_tile").withColumn("b_tile", every(b_tiles))
    right = _packed(base, "ord", dim, most_b, n, b_tiles, "b_tile").withColumn("q_tile", every(q_tiles))
    precision = ["<f4" if d.schema["vector"].dataType.elementType == FloatType() else "<f8" for d in (queries, base)]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "ord": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        whole = lambda table, c, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(c)])
        qid, ids = whole(left, "ids", "<i8"), whole(right, "ids", "<i8")
        q, x = whole(left, "x", precision[0]).reshape(len(qid), -1), whole(right, "x", precision[1]).reshape(len(ids), -1)
        found, s = nearest(qid, q, ids, x, k, exclude_self)
        keep = np.isfinite(s)
        return pa.table({"qid": np.repeat(qid, s.shape[1])[keep.ravel()], "ord": found[keep], "score": s[keep]})

    met = left.groupBy("q_tile", "b_tile").cogroup(right.groupBy("q_tile", "b_tile")).applyInArrow(best, "qid long, ord long, score double")
    window = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("ord").asc())
    return met.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= max(0, k))
