"""Embedding near-dedup: exact cosine links by PCA-ordered tiled comparison.

1. Valid vectors are scaled by a power of two, which changes no cosine; equal ones collapse to a class.
2. The second-moment matrix of all vectors gives an orthogonal basis, ordered by energy. In that basis the
   leading components hold most of every product. Vectors of rare lengths keep the order of their components.
3. Splits at medians of the leading components, fitted on a bounded sample, deal the vectors into blocks of bounded
   size. A vector travels only to the blocks whose box of leading components it can reach, and every pair of
   blocks that may hold a link is one task.
4. In a task, tiles of the two blocks accumulate leading components first. What the rest can add is bounded by
   the product of the suffix norms (Cauchy-Schwarz); rows and columns that cannot reach the threshold leave, and
   the comparison stops when none is left. This runs in single precision with a margin above its error; pairs
   within the margin are decided by the cosine of the given vectors in double precision.
Tasks return link counts and a spanning forest of their links, never the links themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, hot_join, quoted, stored, without, without_ids
from .components import connected_components

#: Rows of a tile; leading components that blocks are split and boxed by; bytes of a block's vectors at most.
TILE, LEAD, BLOCK_BYTES = 1024, 8, 32 << 20
#: Lengths that get a basis and splits of their own (the most frequent ones, up to ``MAX_DIM``); their blocks at most.
BASES, MAX_DIM, MAX_BLOCKS = 4, 2048, 1024
#: Vectors that the splits are fitted on: so many bytes of the sample at most, as expected by hash.
SAMPLE_BYTES, FEWEST = 4 << 20, 1024
OUTPUT = ("n_links", "component_id", "kept")


def scaled_rows(column: pa.Array) -> dict[int, np.ndarray]:
    """Row number -> the vector in double precision with its largest component in [0.5, 1), of the valid rows.

    The factor is a power of two, so that components keep all their digits and sums cannot overflow.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    out: dict[int, np.ndarray] = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        x = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        top = np.abs(x).max(axis=1)
        fine = np.isfinite(x).all(axis=1) & (top > 0)
        x = np.ldexp(x[fine], -np.frexp(top[fine])[1][:, None])
        out.update(zip(rows[fine].tolist(), x + 0.0, strict=True))  # + 0.0: no negative zeros
    return out


def _raw(x: np.ndarray) -> bytes:
    """The components, in 4 bytes each where those hold them exactly; the first byte says which."""
    narrow = x.astype("<f4")
    return b"4" + narrow.tobytes() if (narrow == x).all() else b"8" + x.astype("<f8").tobytes()


def _length(raw: bytes) -> int:
    return (len(raw) - 1) // int(raw[:1])


def _matrix(raws: list[bytes]) -> np.ndarray:
    """Rows of equal length in double precision."""
    if all(r[:1] == b"4" for r in raws):
        return np.frombuffer(b"".join(r[1:] for r in raws), "<f4").reshape(len(raws), -1).astype(float)
    return np.array([np.frombuffer(r[1:], f"<f{int(r[:1])}") for r in raws], float)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keyed(batches):
    for batch in batches:
        rows = scaled_rows(batch.column(1))
        raw = [_raw(rows[k]) if k in rows else None for k in range(batch.num_rows)]
        keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        dims = pa.array([None if r is None else _length(r) for r in raw], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), dims, pa.array(raw, pa.binary())], names=["vec_id", "key", "dim", "raw"])


def _sum_moments(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m, "<f8") for m in table.column("m").to_pylist())
    return pa.table({"dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})


def pca_bases(classes: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """For each of the few ``dims`` an orthogonal basis ordered by energy, from all vectors; a matrix each reaches the driver."""

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for dim in {_length(r) for r in raws}:
                x = unit(_matrix([r for r in raws if _length(r) == dim]))
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "m": pa.array([m.tobytes()], pa.binary())})

    kind = "dim int, m binary"
    parts = classes.where(F.col("dim").isin(dims)).select("raw").mapInArrow(frugal(moments), kind)
    by_slot = parts.withColumn("slot", F.spark_partition_id() % 16).groupBy("dim", "slot").applyInArrow(_sum_moments, kind)
    sums = by_slot.groupBy("dim").applyInArrow(_sum_moments, kind).collect()  # at most BASES matrices
    return {r.dim: np.linalg.eigh(np.frombuffer(r.m, "<f8").reshape(r.dim, r.dim))[1][:, ::-1].copy() for r in sums}


@dataclass
class Splits:
    """A tree of splits of the leading components: each node is (component, value, left, right) or a leaf's number."""

    nodes: list
    leaves: int

    @staticmethod
    def fit(lead: np.ndarray, leaves: int) -> Splits:
        """Into so many leaves of about equal share of the sample, along the component of greatest spread."""
        nodes, number = [None], 0
        todo = [(0, lead, leaves)]
        while todo:
            at, rows, want = todo.pop()
            if want <= 1 or len(rows) < 2:
                nodes[at], number = number, number + 1
                continue
            c, part = int(np.ptp(rows, axis=0).argmax()), want // 2
            cut = float(np.quantile(rows[:, c], part / want))
            left = rows[:, c] <= cut
            if left.all() or not left.any():
                nodes[at], number = number, number + 1
                continue
            nodes[at] = (c, cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[left], part), (len(nodes) + 1, rows[~left], want - part)]
            nodes += [None, None]
        return Splits(nodes, number)

    def leaf(self, lead: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(lead), np.int64), [(0, np.arange(len(lead)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            else:
                left = lead[rows, node[0]] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


@dataclass
class Plan:
    """For one length: basis, splits, and of every leaf its box (low, high, largest suffix norm) and number of slices."""

    basis: np.ndarray
    splits: Splits
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    slices: np.ndarray | None = None

    def lead(self, x: np.ndarray) -> np.ndarray:
        return x @ self.basis[:, :LEAD]

    def reach(self, lead: np.ndarray, width: float) -> np.ndarray:
        """(rows, leaves): whether the leaf's box holds a point within ``width`` of the row's leading components."""
        gap = np.zeros((len(lead), len(self.low)))
        for c in range(lead.shape[1]):
            x = lead[:, c, None]
            gap += np.maximum(0, np.maximum(self.low[:, c] - x, x - self.high[:, c])) ** 2
        return gap <= width * width


def compare(a: np.ndarray, b: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of the rows of ``a`` and ``b`` whose product may reach the threshold, by a margin of ``slack``.

    Columns are in order of energy; components come in growing steps, and rows and columns without a pair
    that can still reach the threshold leave after each.
    """
    dim, at, step = a.shape[1], 0, max(8, a.shape[1] // 4)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    tails = [np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (a, b)]
    p, least = np.zeros((len(a), len(b)), a.dtype), a.dtype.type(threshold - slack)
    while at < dim and len(rows) and len(cols):
        upto = min(dim, at + step)
        p += a[rows, at:upto] @ b[cols, at:upto].T
        at, step = upto, step * 2
        if at == dim:
            break
        can = p >= least - np.outer(tails[0][rows, at], tails[1][cols, at])
        keep_rows, keep_cols = can.any(axis=1), can.any(axis=0)
        if not (keep_rows.all() and keep_cols.all()):
            p, rows, cols = p[np.ix_(keep_rows, keep_cols)], rows[keep_rows], cols[keep_cols]
    i, j = np.nonzero(p >= least)
    return rows[i], cols[j], p[i, j]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed in the order of the components."""
    total = lambda z: np.cumsum(z, axis=1)[:, -1]
    return total(x * y) / np.sqrt(total(x * x) * total(y * y))


def linked(x: np.ndarray, y: np.ndarray, turned_x: np.ndarray, turned_y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the linked rows of two tiles; ``same``: of one tile, i < j only."""
    slack = 2e-7 * (x.shape[1] + 8)
    i, j, p = compare(turned_x, turned_y, threshold, slack)
    if same:
        once = i < j
        i, j, p = i[once], j[once], p[once]
    fine = p >= threshold + slack
    close = np.flatnonzero(~fine)
    for a in range(0, len(close), 1 << 14):
        k = close[a : a + (1 << 14)]
        fine[k] = cosine(x[i[k]], y[j[k]]) >= threshold
    return i[fine], j[fine]


def spanning(ids_a: np.ndarray, ids_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its local component), for the nodes of the links that aren't that smallest one."""
    nodes, places = np.unique(np.concatenate([ids_a[i], ids_b[j]]), return_inverse=True)
    x, y = places[: len(i)], places[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, new[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _plans(classes: DataFrame) -> dict[int, Plan]:
    """A plan for each of the most frequent lengths."""
    often = classes.where(F.col("dim") <= MAX_DIM).groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(BASES).collect()
    counts = {r.dim: r.n for r in often}
    bases = pca_bases(classes, list(counts)) if counts else {}
    plans, cores = {}, classes.sparkSession.sparkContext.defaultParallelism
    for dim, n in counts.items():
        most = max(1, SAMPLE_BYTES // (4 * dim))
        step = max(1, n // most)
        of_dim = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("no"), F.lit(step)) == 0))
        few = [bytes(r.raw) for r in of_dim.select("raw").limit(2 * most).collect()]  # about ``most`` rows
        lead = unit(_matrix(few)) @ bases[dim][:, :LEAD] if few else np.zeros((0, min(dim, LEAD)))
        plans[dim] = Plan(bases[dim], Splits.fit(lead, wanted_blocks(n, dim, cores)))
    return plans


def rows_of_block(dim: int) -> int:
    return max(TILE, BLOCK_BYTES // (4 * dim))


def wanted_blocks(n: int, dim: int, cores: int) -> int:
    """As many as memory asks for; for little data enough pairs of blocks to keep all cores busy."""
    busy = min(int(np.ceil(np.sqrt(4 * cores))), -(-n // FEWEST))
    return max(1, min(MAX_BLOCKS, max(busy, -(-n // rows_of_block(dim)))))


def _measure(plans: dict[int, Plan]):
    """Of each task: rows and box of every leaf it saw."""

    def run(batches):
        seen: dict = {}
        for batch in batches:
            for dim, rows, x in _by_length(batch.column(0).to_pylist(), plans):
                lead = plans[dim].lead(x)
                leaf = plans[dim].splits.leaf(lead)
                for k in np.unique(leaf).tolist():
                    mine = lead[leaf == k]
                    n, low, high = seen.get((dim, k), (0, np.inf, -np.inf))
                    seen[dim, k] = n + len(mine), np.minimum(low, mine.min(axis=0)), np.maximum(high, mine.max(axis=0))
        rows = [{"dim": d, "leaf": k, "n": n, "low": low.tolist(), "high": high.tolist()} for (d, k), (n, low, high) in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dim", pa.int32()), ("leaf", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    return run


def _by_length(raws: list[bytes], plans: dict[int, Plan] | None = None):
    """(dim, rows, unit vectors) of the lengths that occur, or of those with a plan."""
    dims = np.array([_length(r) for r in raws], np.int64)
    for dim in np.unique(dims).tolist():
        if plans is None or dim in plans:
            rows = np.flatnonzero(dims == dim)
            yield dim, rows, unit(_matrix([raws[k] for k in rows.tolist()]))


def _boxes(classes: DataFrame, plans: dict[int, Plan]) -> None:
    """Fills in the boxes and slices of all leaves, of which there are at most MAX_BLOCKS a plan."""
    kind = "dim int, leaf long, n long, low array<double>, high array<double>"
    parts = classes.where(F.col("dim").isin(list(plans))).select("raw").mapInArrow(frugal(_measure(plans)), kind)
    edge = lambda f, c: [f(F.get(c, F.lit(k))).alias(f"{c}{k}") for k in range(LEAD)]
    found = parts.groupBy("dim", "leaf").agg(F.sum("n").alias("n"), *edge(F.min, "low"), *edge(F.max, "high")).collect()
    for dim, plan in plans.items():
        lead, n = min(dim, LEAD), plan.splits.leaves
        plan.low, plan.high, plan.slices = np.full((n, lead), np.inf), np.full((n, lead), -np.inf), np.ones(n, np.int64)
        for r in found:
            if r.dim == dim:
                plan.low[r.leaf], plan.high[r.leaf] = [[r[f"{c}{k}"] for k in range(lead)] for c in ("low", "high")]
                plan.slices[r.leaf] = -(-r.n // rows_of_block(dim))


_TRIP = "dim int, a long, b long, block long, ids binary, sizes binary, raws array<binary>"


def _travel(plans: dict[int, Plan], width: float):
    """Sends each vector to the pairs of blocks where it may meet a partner: one packed row a pair and batch.

    A block is (leaf, slice), numbered over all leaves. Vectors without a plan have one leaf and ``slices`` slices.
    """

    def run(batches):
        firsts = {d: np.concatenate([[0], np.cumsum(p.slices)]) for d, p in plans.items()}
        for batch in batches:
            no, size, raws = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            slices = batch.column(3).to_numpy()
            out: list[tuple] = []
            for dim, rows, x in _by_length(raws):
                deal = (no[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                plan = plans.get(dim)
                if plan is None:
                    n = slices[rows]
                    block = (deal % n.astype(np.uint64)).astype(np.int64)
                    row, other = np.nonzero(np.ones((len(rows), int(n[0])), bool))
                else:
                    lead = plan.lead(x)
                    leaf, first = plan.splits.leaf(lead), firsts[dim]
                    block = first[leaf] + (deal % plan.slices[leaf].astype(np.uint64)).astype(np.int64)
                    can = np.repeat(plan.reach(lead, width), plan.slices, axis=1)
                    row, other = np.nonzero(can)
                a, b = np.minimum(block[row], other), np.maximum(block[row], other)
                order = np.lexsort((block[row], b, a))
                row, a, b = row[order], a[order], b[order]
                other_than_last = [np.diff(c, prepend=-1) != 0 for c in (a, b, block[row])]
                new = np.flatnonzero(np.any(other_than_last, axis=0))
                for mine in np.split(np.arange(len(row)), new[1:]) if len(row) else []:
                    k = rows[row[mine]]
                    where = (dim, int(a[mine[0]]), int(b[mine[0]]), int(block[row[mine[0]]]))
                    out.append((*where, no[k].astype("<i8").tobytes(), size[k].astype("<i8").tobytes(), [raws[i] for i in k.tolist()]))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            for at in range(0, len(out), 64):
                columns = zip(*out[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["dim", "a", "b", "block", "ids", "sizes", "raws"])

    return run


_MET = pa.schema([("no", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


class _Block:
    """The vectors of a block that came to a task, in the order of their leading components, as tiles."""

    def __init__(self, table: pa.Table, basis: np.ndarray | None) -> None:
        join = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8")
        x = _matrix([r for part in table.column("raws").to_pylist() for r in part])
        ids = join("ids")
        turned = unit(x) if basis is None else unit(x) @ basis
        order = np.lexsort((ids, *np.floor(turned[:, :3] * 8).T[::-1])) if len(ids) else np.zeros(0, np.int64)
        self.ids, self.sizes, self.turned = ids[order], join("sizes")[order], turned[order].astype("f4")
        narrow = x.astype("f4")
        self.x = (narrow if (narrow == x).all() else x)[order]
        self.links = np.zeros(len(ids), np.int64)

    def tiles(self):
        return [slice(a, min(a + TILE, len(self.ids))) for a in range(0, len(self.ids), TILE)]


def _meet(plans: dict[int, Plan], threshold: float):
    bases = {d: p.basis for d, p in plans.items()}

    def run(table: pa.Table) -> pa.Table:
        one = lambda c: table.column(c)[0].as_py()
        dim, a, b = one("dim"), one("a"), one("b")
        parts = {k: table.filter(pc.equal(table.column("block"), k)) for k in {a, b}}
        if not all(p.num_rows for p in parts.values()):
            return _MET.empty_table()
        sides = {k: _Block(p, bases.get(dim)) for k, p in parts.items()}
        left, right = sides[a], sides[b]
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for k, s in enumerate(left.tiles()):
            for t in right.tiles()[k if a == b else 0 :]:
                same = a == b and s == t
                x, y = left.x[s].astype(float), right.x[t].astype(float)
                i, j = linked(x, y, left.turned[s], right.turned[t], threshold, same)
                if len(i):
                    i, j = i + s.start, j + t.start
                    left.links += np.bincount(i, right.sizes[j], len(left.ids)).astype(np.int64)
                    right.links += np.bincount(j, left.sizes[i], len(right.ids)).astype(np.int64)
                    near.append(spanning(left.ids, right.ids, i, j))
        nodes, roots = (np.concatenate([n[k] for n in near]) if near else np.zeros(0, np.int64) for k in (0, 1))
        if len(nodes):  # one forest of the task instead of one a pair of tiles
            nodes, roots = spanning(nodes, roots, np.arange(len(nodes)), np.arange(len(nodes)))
        counted = [(s.ids[s.links > 0], s.links[s.links > 0]) for s in sides.values()]
        no, n = (np.concatenate([c[k] for c in counted]) for k in (0, 1))
        none = np.arange(len(no) + len(roots)) < len(no)
        root = pa.array(np.concatenate([np.zeros(len(no), np.int64), roots]), pa.int64(), mask=none)
        no, n = np.concatenate([no, nodes]), np.concatenate([n, np.zeros(len(nodes), np.int64)])
        return pa.Table.from_arrays([pa.array(no, pa.int64()), pa.array(n, pa.int64()), root], schema=_MET)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links counts the other rows whose vector has a cosine >= threshold with this one's, component_id is the
    smallest id reachable by links, itself included, and kept says whether that is the row's own. The cosine is that
    of the given vectors in double precision, summed in the order of their components; a cosine equal to the threshold
    links. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows
    with a null id and vectors of different length. Rows with one id are one node: what any of them links with is
    connected, and they are kept or not together. ``threshold`` is above 0.
    """
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("vector"))
    rows = stored(rows.mapInArrow(frugal(_keyed), "vec_id long, key binary, dim int, raw binary"), "vectors")
    usable = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    grouped = rows.where(usable).groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.any_value("dim").alias("dim"), F.any_value("raw").alias("raw"))
    classes = stored(grouped.withColumn("no", F.monotonically_increasing_id()), "classes")
    plans = _plans(classes)
    _boxes(classes, plans)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    planned = classes.where(F.col("dim").isin(list(plans))).withColumn("slices", F.lit(1).cast("long"))
    others = classes.where(~F.col("dim").isin(list(plans)))
    per_block = F.greatest(F.lit(TILE), F.expr(f"{BLOCK_BYTES} div (4 * dim)"))
    rare = others.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / per_block).cast("long").alias("slices"))
    columns = ("no", "size", "raw", "slices")
    travellers = planned.select(*columns).unionByName(others.join(rare, "dim").select(*columns))
    trips = travellers.mapInArrow(frugal(_travel(plans, width), 4096), _TRIP)
    met = stored(trips.groupBy("dim", "a", "b").applyInArrow(_meet(plans, threshold), "no long, n long, root long"), "met")

    counts = met.groupBy("no").agg(F.sum("n").alias("links"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n")
    told = stored(classes.select("key", "no", "low", "size").join(counts, "no", "left").select("key", "no", "low", "size", n_links), "told")
    of_row = stored(hot_join(rows.where(usable).select("vec_id", "key"), told, "key").select("vec_id", "key", "no", "n"), "rows")
    edges = met.where("root is not null").select(F.col("no").alias("a"), F.col("root").alias("b"))
    roots = connected_components(edges.unionByName(_same_id(of_row)))
    members = stored(told.join(roots, F.col("no") == F.col("node"), "left").select("key", "low", "size", F.coalesce("root", "no").alias("root")), "members")
    lowest = members.groupBy("root").agg(F.min("low").alias("component"))
    answers = stored(members.join(lowest, "root").select("key", "size", "component"), "answers")
    found = stored(hot_join(of_row.select("vec_id", "key", "n"), answers, "key").select("vec_id", "n", "component"), "found")
    return _with_invalid(found, rows.where(~usable).select("vec_id")).select(
        F.col("vec_id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("vec_id")).alias("kept")
    )


def _same_id(of_row: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that an id occurs in."""
    several = of_row.groupBy("vec_id").agg(F.min("no").alias("first"), F.max("no").alias("last")).where("first < last")
    return of_row.join(several.select("vec_id", "first"), "vec_id").where("no > first").select(F.col("no").alias("a"), F.col("first").alias("b")).distinct()


def _with_invalid(found: DataFrame, invalid: DataFrame) -> DataFrame:
    """Adds the rows whose vector links with nothing: alone, or in the component of valid rows of the same id."""
    of_id = found.groupBy("vec_id").agg(F.min("component").alias("component"))
    named = invalid.where("vec_id is not null").join(of_id, "vec_id", "left")
    nothing = F.lit(0).cast("long").alias("n")
    named = named.select("vec_id", nothing, F.coalesce("component", "vec_id").alias("component"))
    nameless = invalid.where("vec_id is null").select("vec_id", nothing, F.lit(None).cast("long").alias("component"))
    return found.unionByName(named).unionByName(nameless)


def drop_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """The rows whose id stands for their component, with all their columns; rows with a null id stay."""
    found = near_duplicates(vectors, id_col, vector_col, threshold)
    gone = stored(found.where("not kept").select(F.col(f"`{id_col}`").alias("gone")).distinct(), "gone")
    return without_ids(vectors, id_col, gone)


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(without(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), *OUTPUT))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = e.vec_id
"""
