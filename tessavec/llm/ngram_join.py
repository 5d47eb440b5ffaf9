"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes, and the groups of linked documents.

1. Chunks of documents hash their word shingles to sets; equal sets of a chunk collapse. Each chunk sends the
   sorted hashes to hash-range buckets as packed arrays; a hash that very many documents of the chunk share is
   sent as one count. A bucket adds up document frequencies and answers with those of 2 and more; all other
   shingles belong to one document only and can match nothing.
2. A document that could overlap enough with some partner (its shared shingles are at least 0.75 of its set)
   is a candidate. Equal sets collapse to one class over the whole corpus.
3. With all shingles in one global order, rarest first, two sets that overlap in o shingles share at least l of
   the first n - o + l. Each candidate chooses the l (1 to 4) of least estimated cost: the postings its prefix
   touches plus the verifications, at most postings / l. A pair must share min(l_a, l_b) prefix shingles before
   its whole sets are intersected.
4. Within a posting list every document is first tested against the list's smallest document, which is linear
   in the list. Linked documents form components; only documents of different components are then compared, in
   tiles, so a large group of near copies never expands into its pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal, hot_join, parts_for, quoted, stored, without_ids
from .components import connected_components
from .tokens import Cache

CHUNK_CHARS, CHUNK_DOCS, IN_CHUNK_HOT = 4 << 20, 60_000, 64
_COLUMNS = ("chunk", "bucket", "a", "b", "c", "d", "e")
_ROWS = "chunk string, bucket int, a binary, b binary, c binary, d binary, e binary"
_MULTIPLIERS = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") | 1 for k in range(8)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int = 5, cache: int = 400_000) -> None:
        self.k, self.known = words, Cache(cache)

    def _word(self, word: bytes) -> int:
        h = self.known.get(word)
        return self.known.put(word, xxhash.xxh64_intdigest(word)) if h is None else h

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII blanks only
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        got = list(map(self.known.early.get, words))
        if None in got:
            got = [self._word(w) if h is None else h for w, h in zip(words, got, strict=True)]
        w = np.array(got, np.uint64)
        k = min(n, self.k)
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(3) + w[i : n - k + 1 + i] * _MULTIPLIERS[i % 8]
        return np.unique(_mix(h))


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(blob[-8:], "little")
    return np.frombuffer(pa.decompress(blob[:-8], decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _pack_sorted(cells: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, their upper bytes apart, which are mostly small."""
    steps = np.diff(cells, prepend=cells[:1] if len(cells) else np.uint64(0))
    head = int(cells[0]).to_bytes(8, "little") if len(cells) else bytes(8)
    low, high = _pack(steps.astype("<u4")), _pack((steps >> np.uint64(32)).astype("<u4").view("u1").reshape(-1, 4).T.ravel())
    return head + len(low).to_bytes(4, "little") + low + high


def _unpack_sorted(blob: bytes) -> np.ndarray:
    at = 12 + int.from_bytes(blob[8:12], "little")
    low, planes = _unpack(blob[12:at], "<u4"), _unpack(blob[at:], "u1")
    high = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel() if len(planes) else low
    steps = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(int.from_bytes(blob[:8], "little"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_COLUMNS)


def _chunk_rows(name: str, ids: list, sets: list[np.ndarray], buckets: int):
    """The chunk's documents, and for each bucket its hashes: entries (cell, set number), and counted hot cells.

    Cells are the hashes; a bucket holds a range of them.
    """
    signs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    first: dict[bytes, int] = {}
    rep = np.array([first.setdefault(s, k) for k, s in enumerate(signs)], np.int64)
    own = np.flatnonzero(rep == np.arange(len(sets)))
    cells = np.concatenate([sets[k] for k in own]) if len(own) else np.zeros(0, np.uint64)
    of = np.repeat(own, [len(sets[k]) for k in own]).astype("<u2")
    order = np.argsort(cells, kind="stable")
    cells, of = cells[order], of[order]
    starts = np.flatnonzero(np.diff(cells, prepend=~cells[:1])) if len(cells) else np.zeros(0, np.int64)
    runs = np.diff(np.append(starts, len(cells)))
    hot = np.repeat(runs >= IN_CHUNK_HOT, runs)
    known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is not None for i in ids], "u1").tobytes()
    yield name, -1, known, np.array([len(s) for s in sets], "<i4").tobytes() + rep.astype("<i4").tobytes(), b"".join(signs), _pack_sorted(cells[hot]), _pack(of[hot])
    edges = np.array([((b << 64) + buckets - 1) // buckets for b in range(1, buckets)], np.uint64)
    hot_cells, hot_runs = cells[starts[runs >= IN_CHUNK_HOT]], runs[runs >= IN_CHUNK_HOT]
    cells, of = cells[~hot], of[~hot]
    at, hot_at = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (cells, hot_cells))
    for b in range(buckets):
        x, y = slice(at[b], at[b + 1]), slice(hot_at[b], hot_at[b + 1])
        if x.stop > x.start or y.stop > y.start:
            yield name, b, _pack_sorted(cells[x]), _pack(of[x]), None, _pack_sorted(hot_cells[y]), _pack(hot_runs[y].astype("<i8"))


def _rows_of(table: pa.Table) -> list[tuple]:
    return [r for batch in table.to_batches() for r in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True)]


def _frequencies(table: pa.Table) -> pa.Table:
    """Of a bucket: to each chunk its entries whose cell has a document frequency of 2 or more, with that frequency."""
    rows = _rows_of(table)
    cells, hot = [_unpack_sorted(r[2]) for r in rows], [_unpack_sorted(r[5]) for r in rows]
    every = np.concatenate([*cells, *hot])
    counts = np.concatenate([np.ones(sum(map(len, cells)), np.int64), *[_unpack(r[6], "<i8") for r in rows]])
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    values, total = every[starts], np.add.reduceat(counts[order], starts)
    values, total = values[total > 1], total[total > 1]
    out = []
    for r, mine, mine_hot in zip(rows, cells, hot, strict=True):
        at = np.minimum(np.searchsorted(values, mine), max(len(values) - 1, 0))
        keep = values[at] == mine if len(values) else np.zeros(len(mine), bool)
        df = total[np.searchsorted(values, mine_hot)] if len(mine_hot) else np.zeros(0, np.int64)
        if keep.any() or len(mine_hot):
            mine_df = total[at[keep]] if keep.any() else df[:0]
            out.append((r[0], r[1], _pack_sorted(mine[keep]), _pack(_unpack(r[3], "<u2")[keep]), _pack(mine_df.astype("<i8")), r[5], _pack(df.astype("<i8"))))
    return pa.Table.from_batches([_batch(out)] if out else [], _batch([("", 0, *[b""] * 5)]).schema)


def least_overlap(n, percent: int):
    """Shingles that a set of n shares at least with any partner of that similarity."""
    return -(-percent * n // 100)


def choose_l(df: np.ndarray, single: int, n: int, percent: int, most: int = 4) -> tuple[int, int]:
    """(l, shared shingles in the prefix) of least estimated cost. ``df``: frequencies of the shared ones, ascending."""
    need = least_overlap(n, percent)
    postings, best = np.cumsum(df), None
    for l in range(1, min(most, need) + 1):  # noqa: E741
        length = min(n - need + l - single, len(df))
        if length <= 0:
            continue
        touched = int(postings[length - 1])
        cost = touched + touched / l * n / 8  # an intersection costs about n / 8 postings
        if best is None or cost < best[0]:
            best = (cost, l, length)
    return best[1:] if best else (1, 0)


_DOCS = "doc_id long, n int, sign binary, uid string, l int, prefix array<long>, shingles array<long>"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sign", pa.binary()), ("uid", pa.string()), ("l", pa.int32()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])


def _documents(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a chunk: a row per document; candidates have their shared shingles, in the global order, and their prefix."""
        rows = _rows_of(table)
        me = next(r for r in rows if r[1] < 0)
        answers = [r for r in rows if r[1] >= 0]
        count = len(me[2]) // 9
        ids, there = np.frombuffer(me[2][: 8 * count], "<i8").tolist(), np.frombuffer(me[2][8 * count :], "u1").tolist()
        n, rep = np.frombuffer(me[3][: 4 * count], "<i4"), np.frombuffer(me[3][4 * count :], "<i4")
        signs = [me[4][16 * k : 16 * k + 16] for k in range(count)]
        cells, of = [_unpack_sorted(r[2]) for r in answers], [_unpack(r[3], "<u2") for r in answers]
        dfs = [_unpack(r[4], "<i8") for r in answers]
        hot_cells, hot_of = _unpack_sorted(me[5]), _unpack(me[6], "<u2")
        if len(hot_cells):
            named = np.concatenate([_unpack_sorted(r[5]) for r in answers])
            its_df = np.concatenate([_unpack(r[6], "<i8") for r in answers])
            order = np.argsort(named)
            cells.append(hot_cells)
            of.append(hot_of)
            dfs.append(its_df[order][np.searchsorted(named[order], hot_cells)])
        empty = np.zeros(0, np.int64)
        cells, of, dfs = (np.concatenate(x) if x else empty for x in (cells, of, dfs))
        order = np.lexsort((cells, dfs, of))
        cells, of, dfs = cells[order].astype(np.int64), of[order], dfs[order]
        at = np.searchsorted(of, np.arange(count + 1))
        chosen: list = [None] * count
        for k in range(count):
            shared = int(at[k + 1] - at[k])
            if rep[k] == k and n[k] and shared >= least_overlap(int(n[k]), percent):
                l, length = choose_l(dfs[at[k] : at[k + 1]], int(n[k]) - shared, int(n[k]), percent)  # noqa: E741
                mine = cells[at[k] : at[k + 1]]
                chosen[k] = (f"{me[0]}:{k}", l, mine[:length], mine)
        return pa.Table.from_arrays([pa.array([i if t else None for i, t in zip(ids, there, strict=True)], pa.int64()), pa.array(n, pa.int32()), pa.array(signs, pa.binary()), *[pa.array([c and c[j] for c in chosen], _DOCS_ARROW.field(3 + j).type) for j in range(4)]], schema=_DOCS_ARROW)

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b): those whose prefixes share enough shingles and whose sets are similar enough."""
    side = lambda s: sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "l", "prefix", "shingles")])
    both = pairs.join(side("a"), F.col("a") == F.col("cid_a")).join(side("b"), F.col("b") == F.col("cid_b"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    enough = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("l_a", "l_b")
    return both.where(F.when(fits, F.when(enough, common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).otherwise(False)).otherwise(False)).select("a", "b")


def link_sets(sets: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """(node, root) of the classes that have links. ``sets``: cid, n, l, prefix, shingles; one row a class.

    In each round every posting list with several components takes as its head the document with the smallest
    share of shingles of its own that has not been one yet, mostly the text the others were made from, and tests
    all documents of other components against it. After ``rounds`` the documents of one component
    meet those of the others in tiles, but for lists whose places show that they can't overlap enough.
    """
    own = F.col("n") - F.size("shingles")
    facts = ("cell", "place", "cid", "n", "l", "own")  # place: among the shared shingles, in the global order
    live = stored(sets.select("cid", "n", "l", own.alias("own"), F.posexplode("prefix").alias("place", "cell")).select(*facts, F.col("cid").alias("root")), "postings")
    tried = found = used = roots = None
    for k in range(rounds):
        open_cells = stored(live.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell"), "open")
        live = stored(live.join(open_cells, "cell", "left_semi"), "live")
        fresh = live if used is None else live.join(used, "cid", "left_anti")
        heads = stored(fresh.groupBy("cell").agg(F.min_by(F.struct("cid", "root"), F.struct(F.round(1000 * F.col("own") / F.col("n")).alias("share"), "cid")).alias("h")).select("cell", F.col("h.cid").alias("head"), F.col("h.root").alias("head_root")), "heads")
        pairs = live.join(heads, "cell").where(F.col("root") != F.col("head_root")).select(F.least("cid", "head").alias("a"), F.greatest("cid", "head").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        more = stored(_verify(pairs, sets, percent), "links")
        tried, found = (pairs, more) if tried is None else (tried.unionByName(pairs), found.unionByName(more))
        heads = heads.select(F.col("head").alias("cid")).distinct()
        used = stored(heads if used is None else used.unionByName(heads).distinct(), "used")
        if k and more.isEmpty():
            break
        roots = connected_components(found)
        live = stored(live.select(*facts).join(roots, F.col("cid") == F.col("node"), "left").select(*facts, F.coalesce("root", "cid").alias("root")), "live")
    open_cells = stored(live.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell"), "open")
    live = stored(live.join(open_cells, "cell", "left_semi"), "live")
    more = stored(_attach(live, sets, percent), "links")
    return roots if more.isEmpty() else connected_components(found.unionByName(more))


def _attach(live: DataFrame, sets: DataFrame, percent: int, tile: int = 256, block: int = 1024) -> DataFrame:
    """Links (a, b) between components that share posting lists; one for a document and a tile of the other component.

    The documents of the smaller component go to the larger one, whose documents are dealt into tiles of about
    ``tile``; about ``block`` documents meet a tile at once. So a group of near copies is met as tiles, not as pairs.
    """
    members = live.select("cid", "root").distinct()
    sizes = stored(members.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    left = F.col("n") - F.col("own") - F.col("place")  # shared shingles from this one on
    lists = live.groupBy("cell", "root").agg(F.max("place").alias("most_before"), F.max(left).alias("most_left"), F.min("n").alias("least_n"))
    lists = stored(lists.join(sizes, "root").select("cell", F.col("root").alias("other"), F.col("size").alias("other_size"), "most_before", "most_left", "least_n"), "lists")
    can_share = F.least("place", "most_before") + F.least(left, F.col("most_left"))
    order = lambda size, root: F.struct(F.col(size).alias("x"), F.col(root).alias("y"))
    asks = live.join(sizes, "root").join(lists, "cell").where((order("size", "root") < order("other_size", "other")) & (can_share * (100 + percent) >= (F.col("n") + F.col("least_n")) * percent))
    asks = stored(asks.select("cid", F.col("other").alias("root")).distinct(), "asks")
    plan = asks.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(sizes, "root")
    plan = stored(plan.select("root", "blocks", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "plan")
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.join(plan, "root").select("root", deal("tiles").alias("tile"), every("blocks").alias("block"), "cid", F.lit(True).alias("member"))
    asking = asks.join(plan, "root").select("root", every("tiles").alias("tile"), deal("blocks").alias("block"), "cid", F.lit(False).alias("member"))
    rows = own.unionByName(asking).join(sets.select("cid", "n", "shingles"), "cid")
    return rows.groupBy("root", "tile", "block").applyInArrow(_compare_tile(percent), "a long, b long")


def _compare_tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
        member = table.column("member").to_numpy(zero_copy_only=False)
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        mine, asking = np.flatnonzero(member), np.flatnonzero(~member)
        mine = mine[np.argsort(cid[mine])]  # the first link found is then the one to the smallest id
        cells = np.concatenate([sets[k] for k in mine]) if len(mine) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(mine)), [len(sets[k]) for k in mine])
        order = np.argsort(cells, kind="stable")
        of, (values, starts) = of[order], np.unique(cells[order], return_index=True)
        ends = np.append(starts[1:], len(cells))
        a, b = [], []
        for k in asking.tolist():
            at = np.minimum(np.searchsorted(values, sets[k]), len(values) - 1)
            at = at[values[at] == sets[k]]
            common = np.zeros(len(mine), np.int64)
            for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
                common[of[s:e]] += 1
            hit = np.flatnonzero(100 * common >= percent * (n[mine] + n[k] - common))
            if len(hit):
                a.append(cid[k])
                b.append(cid[mine[hit[0]]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id reachable by links of that similarity, itself included.

    A-Z is lower-cased, words are runs of characters other than ASCII blanks; a text with fewer words is one
    shingle; one without words, or null, has none and links with nothing. Rows with the same id are one node.
    A row with a null id keeps its count, has a null component and links with nothing. ``docs`` must give the
    same rows in the same partitions when read again, as tables do; store it first where it doesn't.
    """
    buckets = parts_for(docs, text_col)

    def shingle(batches):
        sets_of, part, number = Shingler(words), TaskContext.get().partitionId(), 0
        ids, sets, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                sets.append(sets_of.hashes(text))
                held += len(text or "") + 16
                if held >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield _batch(list(_chunk_rows(f"{part}-{number}", ids, sets, buckets)))
                    ids, sets, held, number = [], [], 0, number + 1
        if ids:
            yield _batch(list(_chunk_rows(f"{part}-{number}", ids, sets, buckets)))

    def answer(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                bucket = one.column(1)[0].as_py()
                if bucket < 0:  # a chunk's own row passes through
                    yield one
                else:
                    held.setdefault(bucket, []).append(one)
        for rows in held.values():  # one, but where Spark has put partitions together
            yield from _frequencies(pa.Table.from_batches(rows)).to_batches()

    chunks = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).alias("t")).mapInArrow(frugal(shingle), _ROWS)
    # A chunk's own row travels with its requests, so both come from one run of the task; each bucket is a partition.
    to = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("chunk"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    answers = stored(chunks.repartitionById(buckets, to).mapInArrow(answer, _ROWS), "frequencies")
    found = stored(answers.groupBy("chunk").applyInArrow(_documents(percent), _DOCS), "documents")

    usable = found.where("n > 0 and doc_id is not null")
    classes = stored(usable.groupBy("sign").agg(F.min("doc_id").alias("cid"), F.count("*").alias("size")), "classes")
    candidates = found.where("uid is not null").select("sign", "uid")
    one = stored(candidates.groupBy("sign").agg(F.min("uid").alias("uid")).join(classes, "sign").select("uid", "cid"), "one")
    sets = stored(found.where("uid is not null").select("uid", "n", "l", "prefix", "shingles").join(one, "uid").drop("uid"), "sets")
    roots = link_sets(sets, percent)
    joined = stored(classes.join(roots, F.col("cid") == F.col("node"), "left").select("sign", "size", F.coalesce("root", "cid").alias("component")), "roots")
    named = hot_join(usable.select("doc_id", "n", "sign"), joined, "sign").select("doc_id", "n", "component")
    lone = found.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = named.unionByName(lone)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that a document of smaller id stands for; rows with a null id stay."""
    groups = jaccard_components(docs, id_col, text_col, **options)
    gone = stored(groups.where(F.col("component_id") != quoted(id_col)).select(quoted(id_col).alias("gone")).distinct(), "gone")
    return without_ids(docs, id_col, gone)


def brute_force(rows: list[tuple[int, str | None]], words: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """id -> (set size, component) by comparing all pairs of true shingle sets; for tests."""

    def shingles(text):
        w = (text or "").encode("utf-8", "replace").lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for m in by.values() for k, a in enumerate(m) for b in m[k + 1 :]}
    for a, b in pairs:
        c = len(sets[a] & sets[b])
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c) and (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
