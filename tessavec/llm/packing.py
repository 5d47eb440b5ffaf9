"""Best-fit packing by a grouping genetic algorithm on distributed islands.

Documents longer than a sequence are cut; whole pieces fill a sequence each. The shorter ones are dealt at
random into blocks of about ``block`` pieces. Several islands evolve a population over each block: crossover
injects whole well-filled bins of one parent into a copy of the other, bins that then hold a document twice
are dissolved, and the displaced documents are best-fitted. Between epochs each island's elite migrates to
the next island of its block. A block is a row, so the work spreads over as many tasks as there are blocks
and islands, and no task holds more than a block. The emptiest bins of all blocks are pooled and packed again.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import frugal, quoted, stored, without
from .tokens import encoder


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only longer documents are cut; the first piece takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [0] * bool(first) + list(range(first, n, capacity))
    return [(s, first if k == 0 and first else capacity) for k, s in enumerate(starts)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every whole text.

    Null counts as empty, which is the end id alone. ``uid`` names the piece: the task and its place there.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    schema = T.StructType([T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in ("uid", "doc_id", "piece", "start", "length", "ids_crc32")] + [T.StructField("ids", T.BinaryType())] * with_ids)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    tail = int(end_id).to_bytes(width, "little")

    def run(batches):
        encode, uid = encoder(path, width).encode, TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text) + tail, f"<u{width}").astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    out.append((uid, doc_id, k, start, n, zlib.crc32(raw), *[raw] * with_ids))
                    uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")).mapInArrow(frugal(run), schema)


class Packing:
    """Bins of one individual while it is built: the free space of each bin, found by a bit set."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def open(self, items: list[int]) -> None:
        free = self.capacity - sum(map(self.sizes.__getitem__, items))
        self.bins.append(list(items))
        self.free.append(free)
        self._note(len(self.bins) - 1, free)

    def _note(self, b: int, free: int) -> None:
        if free:
            self.by_free[free].append(b)
            self.bits |= 1 << free

    def fit(self, items: list[int]) -> None:
        """Best fit: each item into the bin with the least free space that holds it, else into a new bin."""
        sizes, by_free = self.sizes, self.by_free
        for i in items:
            s = sizes[i]
            room = self.bits >> s
            if not room:
                self.open([i])
                continue
            free = s + (room & -room).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                self.bits ^= 1 << free
            self.bins[b].append(i)
            self.free[b] = free - s
            self._note(b, free - s)


    def swap_in(self, loose: list[int]) -> list[int]:
        """Trades one item of a bin that isn't full for a loose one that fills it exactly; the items that are loose then.

        Those are smaller than before, and so easier to place.
        """
        by_size: dict[int, list[int]] = {}
        for i in loose:
            by_size.setdefault(self.sizes[i], []).append(i)
        for b in range(len(self.bins)):
            free = self.free[b]
            if not free:
                continue
            for k, i in enumerate(self.bins[b]):
                if found := by_size.get(self.sizes[i] + free):
                    self.bins[b][k] = found.pop()
                    by_size.setdefault(self.sizes[i], []).append(i)
                    places = self.by_free[free]
                    places.remove(b)
                    if not places:
                        self.bits ^= 1 << free
                    self.free[b] = 0
                    break
        return [i for same in by_size.values() for i in same]


def fills(bins: list[list[int]], sizes: list[int]) -> list[int]:
    size = sizes.__getitem__
    return [sum(map(size, b)) for b in bins]


def fitness(bins: list[list[int]], sizes: list[int]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones (sum of squared fills); smaller is better."""
    return len(bins), -sum(x * x for x in fills(bins, sizes))


def _largest_first(items, sizes: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i], i))


def first_population(sizes: list[int], capacity: int, n: int, rng: np.random.Generator) -> list[list[list[int]]]:
    out = []
    for k in range(n):
        noise = rng.uniform(1 - 0.15 * (k > 0), 1, len(sizes)) if k else np.ones(len(sizes))
        p = Packing(sizes, capacity)
        p.fit(np.lexsort((np.arange(len(sizes)), -np.array(sizes) * noise)).tolist())
        out.append(p.bins)
    return out


def gather_space(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Trades items between bins that aren't full so that one becomes full and the other's space grows, then empties the emptiest.

    An item of a bin with ``free`` space goes for one of another bin that is larger by ``free``. The total space stays;
    as it gathers in fewer bins, the items of the emptiest bin find room in them.
    """
    free = [capacity - n for n in fills(bins, sizes)]
    bins = [list(x) for x in bins]
    home: dict[int, dict[int, int]] = {}  # size -> item -> bin, of the bins that aren't full
    for b, f in enumerate(free):
        if f:
            for i in bins[b]:
                home.setdefault(sizes[i], {})[i] = b
    for b in sorted((b for b, f in enumerate(free) if f), key=free.__getitem__):
        if not 0 < free[b]:
            continue
        best = max(((free[c], i, j, c) for i in bins[b] for j, c in home.get(sizes[i] + free[b], {}).items() if c != b and free[c]), default=None)
        if best is None:
            continue
        _, i, j, c = best
        bins[b][bins[b].index(i)], bins[c][bins[c].index(j)] = j, i
        free[c] += free[b]
        free[b] = 0
        home[sizes[i]][i] = c
        for x in bins[b]:
            home[sizes[x]].pop(x, None)
    last = max(range(len(bins)), key=free.__getitem__)
    rest = Packing(sizes, capacity)
    for b, x in enumerate(bins):
        if b != last:
            rest.open(x)
    rest.fit(_largest_first(bins[last], sizes))
    return rest.bins


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Injects well-filled whole bins of ``b`` into ``a``; bins of ``a`` with their items dissolve, and so do some that aren't full.

    The displaced items first fill bins exactly by trades, then the rest is best-fitted and space gathered.
    """
    filled = fills(b, sizes)
    take = [x for x, n in zip(b, filled, strict=True) if n == capacity and rng.random() < 0.35]
    if not take:
        take = [b[int(np.argmax(filled))]]
    moved = {i for x in take for i in x}
    child, displaced = Packing(sizes, capacity), []
    for x in take:
        child.open(x)
    for x, n in zip(a, fills(a, sizes), strict=True):
        if not moved.isdisjoint(x):
            displaced += [i for i in x if i not in moved]
        elif n < capacity and rng.random() < 0.3:
            displaced += x
        else:
            child.open(x)
    child.fit(_largest_first(child.swap_in(displaced), sizes))
    return gather_space(child.bins, sizes, capacity)


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolves the emptiest bin, a third of the others that aren't full and a few full ones, and places their items anew."""
    filled = fills(a, sizes)
    last = int(np.argmin(filled))
    child, loose = Packing(sizes, capacity), []
    for k, x in enumerate(a):
        if k == last or rng.random() < (0.35 if filled[k] < capacity else 0.02):
            loose += x
        else:
            child.open(x)
    child.fit(_largest_first(child.swap_in(loose), sizes))
    return gather_space(child.bins, sizes, capacity)


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, generations: int, rng: np.random.Generator) -> list[list[list[int]]]:
    """Best individual first. Stops as soon as one needs no more bins than the total asks for."""
    rated = lambda bins: (fitness(bins, sizes), bins)
    population = sorted(map(rated, population))
    least = -(-sum(sizes) // capacity)
    for _ in range(generations):
        if len(population[0][1]) <= least:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False).tolist()) if len(population) > 1 else (0, 0)
        child = crossover(population[i][1], population[j][1], sizes, capacity, rng)
        population = sorted([*population, rated(child), rated(mutate(child, sizes, capacity, rng))])[: len(population)]
    return [bins for _, bins in population]


def _to_bytes(bins: list[list[int]], n: int) -> bytes:
    where = np.zeros(n, "<u4")
    for k, x in enumerate(bins):
        where[x] = k
    return where.tobytes()


def _from_bytes(blob: bytes) -> list[list[int]]:
    where = np.frombuffer(blob, "<u4")
    order = np.argsort(where, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)] if len(where) else []


_STATE = "block long, island int, uids array<long>, sizes array<int>, population array<binary>, bins int"


def _epoch(capacity: int, members: int, generations: int, epoch: int):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rng = np.random.default_rng([r["block"], r["island"], epoch])
                order = np.argsort(r["uids"])  # the order in which rows were gathered doesn't matter
                uids, sizes = np.array(r["uids"], np.int64)[order].tolist(), np.array(r["sizes"])[order].tolist()
                population = [_from_bytes(x) for x in [*r["population"], *([r["elite"]] if r.get("elite") else [])]] or first_population(sizes, capacity, members, rng)
                best = evolve(population, sizes, capacity, generations, rng)[:members]
                out.append({"block": r["block"], "island": r["island"], "uids": uids, "sizes": sizes, "population": [_to_bytes(x, len(uids)) for x in best], "bins": len(best[0])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())), ("bins", pa.int32())]))

    return run


_PLACES = "uid long, size int, sequence_id long, offset long"


def _places(capacity: int, level: int, last: bool):
    """The pieces of each block with their places; those of the emptiest bins, a quarter at most, wait for the next level."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                where, sizes = np.frombuffer(r["best"], "<u4").astype(np.int64), np.array(r["sizes"], np.int64)
                filled = np.bincount(where, sizes).astype(np.int64)
                emptiest = np.argsort(filled, kind="stable")[: 0 if last else max(1, len(filled) // 4)]
                waits = np.isin(where, emptiest[filled[emptiest] < capacity])
                order = np.argsort(where, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.flatnonzero(np.diff(where[order], prepend=-1))
                offset = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(order))))
                name = (((level << 36) + r["block"]) * (1 << 16) + where[order]) * 2 + 1
                uids, sizes, waits = np.array(r["uids"], np.int64)[order], sizes[order].astype(np.int32), waits[order]
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(sizes), pa.array(name, mask=waits), pa.array(offset, mask=waits)], names=["uid", "size", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 1024, block: int = 4096, islands: int = 2, members: int = 4, epochs: int = 2, generations: int = 6) -> DataFrame:
    """The pieces with sequence_id (long) and offset (long); every piece once, no sequence over ``capacity``.

    ``pieces`` has uid (unique) and length (1 to ``capacity``) and may have any other columns; sequence_id and offset
    are replaced. What a block leaves in its emptiest bins, a quarter of them at most, is pooled over all blocks and packed
    again, until one block holds all that is left; so blocks cost no sequences of their own.
    """
    pieces = stored(without(pieces, "sequence_id", "offset"), "pieces")
    short = pieces.where(F.col("length") < capacity)
    todo, placed, level = short.select("uid", F.col("length").cast("int").alias("size")), [], 0
    while True:
        blocks = max(1, -(-todo.count() // block))
        best = _evolved(todo, blocks, level, capacity, islands, members, epochs, generations)
        found = stored(best.mapInArrow(_places(capacity, level, blocks == 1), _PLACES), f"places{level}")
        placed.append(found.where("sequence_id is not null"))
        if blocks == 1:
            break
        todo, level = found.where("sequence_id is null").select("uid", "size"), level + 1
    every = functools.reduce(DataFrame.unionByName, placed).select("uid", "sequence_id", "offset")
    whole = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid") * 2, "offset": F.lit(0).cast("long")})
    return whole.unionByName(short.join(every, "uid"))


def _evolved(todo: DataFrame, blocks: int, level: int, capacity: int, islands: int, members: int, epochs: int, generations: int) -> DataFrame:
    """(block, uids, sizes, best) after the islands of every block have evolved; ``best`` is the bin of each piece."""
    deal = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")
    gathered = todo.groupBy(deal).agg(F.collect_list(F.struct("uid", "size")).alias("x"))  # about ``block`` pieces each
    each = F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")
    none = F.expr("cast(array() as array<binary>)").alias("population")
    state = gathered.select("block", each, F.col("x.uid").alias("uids"), F.col("x.size").alias("sizes"), none, F.lit(0).alias("bins"))
    state = state.repartition("block", "island")
    for epoch in range(epochs):
        if epoch:  # migration: the elite of each island goes to the next one of its block
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["block", "island"])
        state = stored(state.mapInArrow(_epoch(capacity, members, generations, epoch + epochs * level), _STATE), f"islands{epoch}")
    winner = state.groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return state.join(winner, ["block", "island"], "left_semi").select("block", "uids", "sizes", F.col("population")[0].alias("best"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("uid")
