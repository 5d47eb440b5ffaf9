"""Approximate search over a layered neighbour graph that is built once, stored and descended.

Rows are dealt into cells around centroids, which are fitted on a bounded sample, and cells into shards of bounded size.
Each shard is one row: its ordinals, levels, vectors and, for every level, an adjacency list of ``m`` places. A query goes
to the shards of the cells nearest to it, climbs greedily from the entry point of the top level down to level 1, and
searches level 0 with a beam. Exact search is the default elsewhere; this is opt-in.

Levels are drawn over all rows, so a node may be alone on a level of its shard: its neighbours there are the nearest nodes of
that level in other shards. These edges are a table of their own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import SCORE_DIGITS
from ..sources.shared import file_system, settled
from .graph import level_of
from .search import batch_topk

_SHARD = "shard int, cell int, n long, ords binary, levels binary, dead binary, x binary, links binary"
_EDGE = "shard int, level int, src long, rank int, dst long"
_NAMES = ("shard", "cell", "n", "ords", "levels", "dead", "x", "links")
_KINDS = {"ords": "<i8", "levels": "<i4", "dead": "u1", "x": "<f8", "links": "<i4"}
#: Bytes of scores that linking a shard holds at once.
LINK_BYTES = 1 << 24
#: Cells and rows of the sample that their centroids are fitted on, at most.
MOST_CELLS, SAMPLE = 1024, 20_000
#: Queries that a shard searches at once; sampled queries that a search is tuned on, and the recall asked of them.
BEAMS, ASKED, TARGET = 128, 512, 0.92
#: Of the recall, what a beam wider by half must gain for wider ones to be tried.
LEAST_GAIN = 0.002
#: Nodes of an upper level that a query may be compared with for its start, at most.
STARTS = 256


@dataclass(frozen=True)
class LayeredIndex:
    """``shards``: one row a shard. ``centroids``: of the cells. At most ``m`` neighbours a node and level.

    ``bridges``: edges from nodes that are alone on a level of their shard, if there are several shards.
    """

    shards: DataFrame
    centroids: np.ndarray
    m: int
    levels: int
    bridges: DataFrame | None = None

    def save(self, path: str) -> None:
        """Writes the shards and what belongs to them into a new folder."""
        spark = self.shards.sparkSession
        self.shards.write.parquet(f"{path}/shards")
        about = {"m": self.m, "levels": self.levels, "centroids": self.centroids.tolist()}
        if self.bridges is not None:
            self.bridges.write.parquet(f"{path}/bridges")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LayeredIndex:
        about = json.loads(spark.read.schema("about string").parquet(f"{path}/about").first()[0])
        shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
        fs, at = file_system(spark, f"{path}/bridges/_SUCCESS")
        bridges = spark.read.schema(_EDGE).parquet(f"{path}/bridges") if fs.exists(at) else None
        return LayeredIndex(shards, np.array(about["centroids"], float), about["m"], about["levels"], bridges)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        fs, at = file_system(spark, f"{path}/about/_SUCCESS")
        return fs.exists(at)

    def _each(self, run, schema: str, *columns: str) -> DataFrame:
        """``run`` of every shard on its own, so that a worker holds one shard, given as arrays of the columns by name."""

        def one(table: pa.Table) -> pa.Table:
            return run(table.column("shard")[0].as_py(), **{c: np.frombuffer(table.column(c)[0].as_buffer(), _KINDS[c]) for c in columns})

        return self.shards.select("shard", *columns).groupBy("shard").applyInArrow(one, schema)

    def neighbours(self) -> DataFrame:
        """(shard, level, src, rank, dst) of all edges; rank 1 is the nearest."""
        levels = self.levels

        def run(shard: int, ords: np.ndarray, links: np.ndarray) -> pa.Table:
            links = links.reshape(levels, len(ords), -1)
            level, src, place = np.nonzero(links >= 0)
            columns = (np.full(len(src), shard, np.int32), level.astype(np.int32), ords[src], (place + 1).astype(np.int32), ords[links[level, src, place]])
            return pa.table(list(columns), names=["shard", "level", "src", "rank", "dst"])

        edges = self._each(run, _EDGE, "ords", "links")
        return edges if self.bridges is None else edges.unionByName(self.bridges)

    def nodes(self) -> DataFrame:
        """(shard, ord, level, dead) of all nodes."""

        def run(shard: int, ords: np.ndarray, levels: np.ndarray, dead: np.ndarray) -> pa.Table:
            return pa.table([np.full(len(ords), shard, np.int32), ords, levels, pa.array(dead.astype(bool))], names=["shard", "ord", "level", "dead"])

        return self._each(run, "shard int, ord long, level int, dead boolean", "ords", "levels", "dead")

    def stats(self) -> DataFrame:
        """(level, nodes): live nodes that have neighbours there; at level 0 all live ones."""
        levels = self.levels

        def run(shard: int, dead: np.ndarray, links: np.ndarray) -> pa.Table:
            linked = (links.reshape(levels, len(dead), -1)[:, :, 0] >= 0) & (dead == 0)
            counts = [int((dead == 0).sum()), *linked[1:].sum(axis=1).tolist()]
            return pa.table([pa.array(range(levels), pa.int32()), pa.array(counts, pa.int64())], names=["level", "nodes"])

        counts = self._each(run, "level int, nodes long", "dead", "links")
        if self.bridges is not None:
            counts = counts.unionByName(self.bridges.select("level", "src").distinct().select("level", F.lit(1).cast("long").alias("nodes")))
        return counts.groupBy("level").agg(F.sum("nodes").alias("nodes"))

    def unlinked(self, gone: DataFrame) -> LayeredIndex:
        """The index without the nodes ``gone`` (column ord): they are neither returned nor passed through any more."""
        levels = self.levels
        where = self.nodes().join(gone.select("ord").distinct(), "ord").select(F.col("shard").alias("in_shard"), "ord")

        def bury(shard: pa.Table, dead: pa.Table) -> pa.Table:
            if not shard.num_rows or not dead.num_rows:
                return shard
            g = _Graph({c: shard.column(c)[0].as_py() for c in _NAMES}, levels)
            g.dead = g.dead | np.isin(g.ords, dead.column("ord").to_numpy())
            g.links[np.isin(g.links, np.flatnonzero(g.dead))] = -1
            g.links[:, g.dead] = -1
            g.links = np.take_along_axis(g.links, np.argsort(g.links < 0, axis=2, kind="stable"), axis=2)
            return g.table(shard.column("shard")[0].as_py(), shard.column("cell")[0].as_py())

        shards = self.shards.groupBy("shard").cogroup(where.groupBy("in_shard")).applyInArrow(bury, _SHARD)
        bridges = self.bridges
        if bridges is not None:
            dead = gone.select(F.col("ord").alias("__gone")).distinct()
            bridges = bridges.join(dead, F.col("src") == F.col("__gone"), "left_anti").join(dead, F.col("dst") == F.col("__gone"), "left_anti")
            bridges = settled(bridges.withColumn("rank", F.row_number().over(Window.partitionBy("level", "src").orderBy("rank"))))
        return LayeredIndex(settled(shards), self.centroids, self.m, self.levels, bridges)


class _Graph:
    """A shard in memory: ``links[level, node]`` are the places of its neighbours, nearest first, then -1."""

    def __init__(self, row: dict, levels: int) -> None:
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.ords, self.levels, self.dead = read("ords", "<i8"), read("levels", "<i4"), read("dead", "u1").astype(bool)
        n = len(self.ords)
        self.x, self.links = read("x", "<f8").reshape(n, -1), read("links", "<i4").reshape(levels, n, -1).copy()
        live = np.flatnonzero(~self.dead)
        self.entry = int(live[np.lexsort((self.ords[live], -self.levels[live]))[0]]) if len(live) else -1

    def table(self, shard: int, cell: int) -> pa.Table:
        packed = [self.ords.astype("<i8"), self.levels.astype("<i4"), self.dead.astype("u1"), self.x.astype("<f8"), self.links.astype("<i4")]
        head = [pa.array([shard], pa.int32()), pa.array([cell], pa.int32()), pa.array([len(self.ords)], pa.int64())]
        return pa.Table.from_arrays([*head, *[pa.array([p.tobytes()], pa.binary()) for p in packed]], names=list(_NAMES))

    def greedy(self, q: np.ndarray, level: int, at: np.ndarray, compared: np.ndarray) -> None:
        """Climbs, for each query from its node in ``at``, to a node that none of its neighbours of the level beats."""
        best = np.einsum("ij,ij->i", self.x[at], q)
        compared += 1
        on = np.arange(len(q))
        while len(on):
            around = self.links[level, at[on]]
            there = around >= 0
            compared[on] += there.sum(axis=1)
            s = np.where(there, np.einsum("ijk,ik->ij", self.x[around], q[on]), -np.inf)
            place = s.argmax(axis=1)
            top = s[np.arange(len(on)), place]
            up = top > best[on]
            on, place, top, around = on[up], place[up], top[up], around[up]
            at[on], best[on] = around[np.arange(len(on)), place], top

    def beams(self, q: np.ndarray, at: np.ndarray, ef: int, compared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) of the ``ef`` best that a beam of each query from its node reaches at level 0, in no order; missing ones score -inf.

        The beams go on in step: each expands the best nodes that it holds and hasn't expanded yet, a few at once, until there are none.
        """
        on = np.arange(len(q))
        kind = np.float32 if max(1, np.abs(self.x).max()) * max(1, np.abs(q).max()) < 1e30 else np.float64
        x, q = self.x.astype(kind), q.astype(kind)
        n, step = len(self.ords), 1 + ef // 32
        held, score, todo = np.zeros((len(q), ef), np.int32), np.full((len(q), ef), -np.inf, kind), np.full((len(q), ef), -np.inf, kind)
        held[:, 0], score[:, 0] = at, np.einsum("ij,ij->i", x[at], q)
        todo[:, 0] = score[:, 0]
        compared += 1
        seen, last = np.zeros(len(q) * n, bool), np.empty(len(q) * n, np.int32)
        seen[on * n + at] = True
        while True:
            best = np.argpartition(todo[on], ef - step, axis=1)[:, ef - step :]
            going = todo[on[:, None], best] > -np.inf
            on, best, going = on[going.any(axis=1)], best[going.any(axis=1)], going[going.any(axis=1)]
            if not len(on):
                return held, score
            around = np.where(going[:, :, None], self.links[0, held[on[:, None], best]], -1).reshape(len(on), -1)
            todo[on[:, None], best] = -np.inf
            at = on[:, None] * n + around
            r, c = np.nonzero((around >= 0) & ~seen[at])
            flat = at[r, c]
            last[flat] = np.arange(len(flat))
            once = last[flat] == np.arange(len(flat))  # nodes that are expanded at once may share neighbours
            r, c = r[once], c[once]
            seen[flat] = True
            s = np.einsum("ij,ij->i", x[around[r, c]], q[on[r]])
            compared += np.bincount(on[r], minlength=len(q))
            more = np.full(around.shape, -np.inf, kind)
            more[r, c] = np.where(s > score[on].min(axis=1)[r], s, -np.inf)  # what only ties displaces none
            both = np.concatenate([score[on], more], axis=1)
            keep = np.argpartition(both, both.shape[1] - ef, axis=1)[:, -ef:]
            take = lambda x, y: np.take_along_axis(np.concatenate([x[on], y], axis=1), keep, axis=1)
            held[on], todo[on], score[on] = take(held, around), take(todo, more), np.take_along_axis(both, keep, axis=1)

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ordinals, scores, compared) of queries: the best ``k`` of their beams of ``ef``, best first, and how many vectors each was compared with."""
        compared = np.zeros(len(q), np.int64)
        ef = min(ef, len(self.ords))
        if self.entry < 0 or ef < 1:
            return np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0)), compared
        at, top = np.full(len(q), self.entry), int(self.levels[self.entry])
        counts = [int((~self.dead & (self.levels >= level)).sum()) for level in range(1, top + 1)]
        fits = [level for level, n in enumerate(counts, 1) if n <= STARTS]
        if fits:  # a single start may lie among near copies, whose links all stay among them
            top, nodes = fits[0], np.flatnonzero(~self.dead & (self.levels >= fits[0]))
            at = nodes[(q @ self.x[nodes].T).argmax(axis=1)]
            compared += len(nodes)
        for level in range(top, 0, -1):
            self.greedy(q, level, at, compared)
        nodes, s = self.beams(q, at, ef, compared)
        s = np.where(s > -np.inf, np.round(np.stack([self.x[v] @ one for v, one in zip(nodes, q, strict=True)]), SCORE_DIGITS), -np.inf)
        ords = self.ords[nodes]
        best = np.lexsort((ords, -s), axis=1)[:, :k]
        return np.take_along_axis(ords, best, axis=1), np.take_along_axis(s, best, axis=1), compared


def link(x: np.ndarray, m: int, block: int | None = None) -> np.ndarray:
    """Places of at most ``m`` neighbours of each row, best first: its ``m`` nearest and those it is nearest to, evicting the worst.

    Of equal rows only the first is linked so. They form a chain, in which each has the next one and the one before, and then
    the first one's neighbours; else more than ``m`` of them would be linked among themselves alone.
    """
    if m > 2 and len(x) > 1:
        _, first, group = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        if len(first) < len(x):
            return _chained(link(x[first], m, block), first, group, m)
    n, near = len(x), min(m, len(x) - 1)
    out = np.full((n, m), -1, np.int32)
    if near < 1:
        return out
    block = block or max(1, LINK_BYTES // (8 * n))
    top, score = np.empty((n, near), np.int32), np.empty((n, near))
    for a in range(0, n, block):
        s = x[a : a + block] @ x.T
        np.negative(s, out=s)
        s[np.arange(len(s)), np.arange(a, a + len(s))] = np.inf
        part = np.argpartition(s, near - 1, axis=1)[:, :near]
        top[a : a + block], score[a : a + block] = part, -np.take_along_axis(s, part, axis=1)
    src, dst, s = np.repeat(np.arange(n, dtype=np.int32), near), top.ravel(), score.ravel()
    src, dst, s = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([s, s])
    _, once = np.unique(src.astype(np.int64) * n + dst, return_index=True)
    src, dst, s = src[once], dst[once], s[once]
    order = np.lexsort((dst, -s, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    keep = place < m
    out[src[keep], place[keep]] = dst[keep]
    return out


def _chained(found: np.ndarray, first: np.ndarray, group: np.ndarray, m: int) -> np.ndarray:
    """The links of all rows, from those of the ``first`` of each group of equal ones."""
    out = np.where(found >= 0, first[found], -1).astype(np.int32)[group]
    order = np.argsort(group, kind="stable").astype(np.int32)
    same = group[order][1:] == group[order][:-1]
    chain = np.full((len(group), 2), -1, np.int32)
    chain[order[:-1][same], 0] = order[1:][same]
    chain[order[1:][same], 1] = order[:-1][same]
    out = np.concatenate([chain, out], axis=1)
    return np.take_along_axis(out, np.argsort(out < 0, axis=1, kind="stable"), axis=1)[:, :m]


def _centroids(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """Means of the cells' vectors over a sample of at most about ``SAMPLE`` rows, after a few rounds of reassignment."""
    step = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("ord"), F.lit(step)) == 0).select(F.col("vector").cast("array<double>")).limit(2 * SAMPLE)
    x = np.array([r[0] for r in sample.collect()], float)
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(6):
        mine = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        count = np.bincount(mine, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cell_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _bridges(index: LayeredIndex, dealt: DataFrame, dim: int) -> DataFrame | None:
    """Edges from the nodes that are alone on a level above 0 of their shard to the nearest of the level in other shards."""
    there = index.nodes().select("shard", "ord", F.explode(F.sequence(F.lit(0), "level")).alias("level")).where("level > 0")
    alone = settled(there.groupBy("shard", "level").agg(F.count("*").alias("n"), F.min("ord").alias("qid")).where("n = 1").drop("n"))
    edges = None
    for level in sorted(r.level for r in alone.select("level").distinct().collect()):
        nodes = settled(dealt.where(F.col("level") >= level).select("ord", F.col("v").alias("vector")))
        mine = alone.where(F.col("level") == level).join(nodes, F.col("qid") == F.col("ord")).select("qid", "vector")
        found = batch_topk(mine, nodes, index.m, dim, exclude_self=True).join(alone.where(F.col("level") == level), "qid")
        found = found.select("shard", "level", F.col("qid").alias("src"), "rank", F.col("ord").alias("dst"))
        edges = found if edges is None else edges.unionByName(found)
    return None if edges is None else settled(edges)


def build_index(rows: DataFrame, dim: int, m: int = 32, levels: int = 5, shard_rows: int = 16_384) -> LayeredIndex:
    """Of rows (ord, id, vector): levels are drawn from the ids, and each level of a shard is linked on its own."""
    n = rows.count()
    if not n:
        return LayeredIndex(rows.sparkSession.createDataFrame([], _SHARD), np.zeros((1, dim)), m, levels)
    cells = min(MOST_CELLS, -(-n // shard_rows))
    centres = _centroids(rows, n, cells) if cells > 1 else np.zeros((1, dim))

    def deal(batches):
        for batch in batches:
            x = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_cell_of(x, centres).astype(np.int32))], names=["ord", "level", "v", "cell"])

    plain = rows.select(F.col("ord").cast("long").alias("ord"), level_of(F.col("id"), m, levels).alias("level"), F.col("vector").cast("array<double>").alias("v"))
    dealt = settled(plain.mapInArrow(deal, "ord long, level int, v array<double>, cell int")) if cells > 1 else plain.withColumn("cell", F.lit(0))
    counts = {r.cell: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most MOST_CELLS
    slices = [max(1, -(-counts.get(c, 0) // shard_rows)) for c in range(cells)]
    first = np.concatenate([[0], np.cumsum(slices)]).tolist()
    lookup = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)
    shard = lookup(first[:-1]) + F.pmod(F.xxhash64("ord"), lookup(slices)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("ord").to_numpy(), kind="stable")))
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        level = table.column("level").to_numpy()
        links = np.full((levels, len(x), m), -1, np.int32)
        for k in range(levels):
            nodes = np.flatnonzero(level >= k)
            found = link(x[nodes], m)
            links[k, nodes] = np.where(found >= 0, nodes[found], -1)
        row = {"ords": table.column("ord").to_numpy().tobytes(), "levels": level.astype("<i4").tobytes(), "dead": bytes(len(x)), "x": x.tobytes(), "links": links.tobytes()}
        return _Graph(row, levels).table(table.column("shard")[0].as_py(), table.column("cell")[0].as_py())

    shards = dealt.withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(build, _SHARD)
    index = LayeredIndex(settled(shards), centres, m, levels)
    return replace(index, bridges=_bridges(index, dealt, dim)) if sum(slices) > 1 else index


def ann_topk(queries: DataFrame, index: LayeredIndex, k: int, ef: int = 50, probes: int | None = None, query_block: int = 8192) -> DataFrame:
    """(qid, ord, score, rank, scored): the best ``k`` that beams of max(k, ef) find in the shards of the nearest cells.

    ``probes`` cells are asked (a quarter by default). ``scored`` counts the vectors compared with the query, over all its shards.
    A task has a shard and at most about ``query_block`` queries, and searches ``BEAMS`` of them at once.
    """
    centres, levels = index.centroids, index.levels
    cells = len(centres)
    probes = max(1, min(cells, -(-cells // 4) if probes is None else probes))

    def route(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            near = np.argsort(-(x @ centres.T - 0.5 * (centres * centres).sum(axis=1)), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(near.ravel().astype(np.int32))], names=["qid", "v", "cell"])

    asking = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("v"))
    asked = asking.mapInArrow(route, "qid long, v array<double>, cell int").join(index.shards.select("shard", "cell"), "cell")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
    graphs = index.shards.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    asked = asked.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block"), "qid", "v")

    def answer(shard: pa.Table, asks: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if shard.num_rows and asks.num_rows:
            g = _Graph({c: shard.column(c)[0].as_py() for c in _NAMES}, levels)
            qids, q = asks.column("qid").to_numpy(), _matrix(asks.column("v").combine_chunks())
            for a in range(0, len(q), BEAMS):
                ords, s, compared = g.search(q[a : a + BEAMS], k, max(k, ef))
                first = np.zeros(s.shape, np.int64)
                first[:, :1] = compared[:, None]  # once for each query, so that they can be summed
                there = s > -np.inf
                out = [np.concatenate([x, y]) for x, y in zip(out, (np.repeat(qids[a : a + BEAMS], there.sum(axis=1)), ords[there], s[there], first[there]), strict=True)]
        return pa.table(out, names=["qid", "ord", "score", "in_shard"])

    met = graphs.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "to_block")).applyInArrow(answer, "qid long, ord long, score double, in_shard long")
    window = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("ord").asc())
    met = met.withColumn("rank", F.row_number().over(window)).withColumn("scored", F.sum("in_shard").over(Window.partitionBy("qid")))
    return met.where(F.col("rank") <= max(0, k)).drop("in_shard")


def tuned(index: LayeredIndex, rows: DataFrame, k: int, dim: int, target: float = TARGET) -> dict[str, int]:
    """``ef`` and ``probes`` with which about ``ASKED`` sampled rows (ord, vector) find ``target`` of their true ``k`` nearest.

    The recall is measured against brute force, from a beam of 50 in a quarter of the cells on, wider by half and in twice the
    cells each time. A beam as wide as a shard ends it, or one in all cells that finds hardly more than the one before: what
    isn't reached then, no wider one reaches.
    """
    n, cells = rows.count(), len(index.centroids)
    sampled = F.pmod(F.xxhash64("ord", F.lit(1)), F.lit(max(1, n // ASKED))) == 0
    asking = settled(rows.where(sampled).select(F.col("ord").alias("qid"), "vector"))
    truth = settled(batch_topk(asking, rows, k, dim).select("qid", "ord"))
    most = index.shards.agg(F.max("n")).first()[0] or 0
    ef, probes, before, whole = max(k, 50), max(1, -(-cells // 4)), -1.0, False
    while True:
        share = recall(ann_topk(asking, index, k, ef, probes), truth).first()[0] or 0.0
        if share >= target or (probes == cells and (ef >= most or (whole and share - before < LEAST_GAIN))):
            return {"ef": ef, "probes": probes}
        before, whole = share, probes == cells
        ef, probes = ef + ef // 2, min(cells, 2 * probes)


def hits(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, hits, asked): how many of each query's true neighbours were found."""
    hit = truth.select("qid", "ord").join(found.select("qid", "ord", F.lit(1).alias("hit")), ["qid", "ord"], "left")
    return hit.groupBy("qid").agg(F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("hits"), F.count("*").alias("asked"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true (qid, ord) that were found."""
    return hits(found, truth).agg((F.sum("hits") / F.sum("asked")).alias("recall"))
