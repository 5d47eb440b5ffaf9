"""Byte-level BPE over the corpus: every distinct word is encoded once, and identifiers join back by position.

1. Each chunk of documents is split into pre-tokens. The chunk keeps its sequence of local word numbers (the
   positions), and sends each of its distinct words once to the word's bucket: words are pre-aggregated before
   they shuffle, so a word that fills a third of the corpus is one entry a chunk.
2. Each bucket encodes its distinct words once and sends the identifiers back to the chunks that asked.
3. The chunk puts the identifiers in the places of its sequence. Step 1 wrote the sequences as a table bucketed
   by chunk, so only the answers shuffle here.
Chunk names are random, so what step 1 wrote is kept in the shared store and never computed twice.
"""

from __future__ import annotations

import base64
import functools
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import frugal, parts_for, quoted, stored_by, with_columns_of, without
from .charclass import split_as_tiktoken
from .tokens import merge

CHUNK_CHARS = 8 << 20
_ZSTD = pa.Codec("zstd", compression_level=3)
_CHUNKS = "chunk string, bucket int, ids binary, counts binary, body binary"


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes of each identifier; at most as long as the vocabulary."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class _Pairs(dict):
    """(a, b) -> (rank, a + b), found in the rank table when first asked for; bounded."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def get(self, pair, default=None):
        rank = self.ranks.get(joined := pair[0] + pair[1])
        return default if rank is None else (rank, joined)

    def __contains__(self, pair) -> bool:
        return pair[0] + pair[1] in self.ranks

    def __getitem__(self, pair):
        return self.get(pair)


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    return {token: rank for rank, token in enumerate(token_bytes(path)) if token}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return [ranks[s] for s in merge([word[i : i + 1] for i in range(len(word))], _Pairs(ranks))]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _squeezed(raw: bytes) -> bytes:
    return _ZSTD.compress(raw, asbytes=True) + len(raw).to_bytes(8, "little")


def _spread(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[:-8], int.from_bytes(blob[-8:], "little"), asbytes=True)


def _packed(values: np.ndarray) -> bytes:
    """Non-negative numbers under 2**32 as byte planes, each compressed alone."""
    top = int(values.max()) if len(values) else 0
    planes = values.astype("<u4").view("u1").reshape(-1, 4).T
    return b"".join(len(z).to_bytes(4, "little") + z for z in (_squeezed(planes[k].tobytes()) for k in range(max(1, (top.bit_length() + 7) // 8))))


def _unpacked(blob: bytes) -> np.ndarray:
    planes, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        planes.append(np.frombuffer(_spread(blob[at + 4 : at + 4 + n]), "u1"))
        at += 4 + n
    out = planes[0].astype("<u4")
    for k, p in enumerate(planes[1:], 1):
        out |= p.astype("<u4") << np.uint32(8 * k)
    return out


class _Chunk:
    """Documents of a chunk while it is read: their word numbers, and the distinct words in order of appearance."""

    def __init__(self) -> None:
        self.numbers, self.ids, self.seqs, self.chars = _Numbers(), [], [], 0

    def add(self, doc_id, words: list[str], chars: int) -> None:
        self.ids.append(doc_id)
        self.seqs.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.chars += chars + 16

    def rows(self, buckets: int):
        """The chunk's sequence, and for each bucket the chunk's distinct words that belong there."""
        name = uuid.uuid4().hex
        known = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes() + np.array([i is not None for i in self.ids], "u1").tobytes()
        words, seq = [w.encode("utf-8", "replace") for w in self.numbers], np.concatenate(self.seqs)
        often = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), np.uint32)
        rank[often] = np.arange(len(words), dtype=np.uint32)
        words = [words[k] for k in often.tolist()]
        yield name, -1, known, np.array([len(s) for s in self.seqs], "<i8").tobytes(), _packed(rank[seq])
        to = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
            mine = [words[k] for k in part.tolist()]
            yield name, int(to[part[0]]), _packed(np.diff(part, prepend=0)), _packed(np.array([len(w) for w in mine])), _squeezed(b"".join(mine))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "bucket", "ids", "counts", "body"])


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) of every row: the identifiers as little-endian unsigned 32-bit integers in a binary.

    Null and empty texts have none. Rows keep their identity by position, so ids may be null or repeat.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    buckets = parts_for(docs, text_col)

    def split_up(batches):
        split, chunk = functools.partial(split_as_tiktoken, regex.compile(pattern)), _Chunk()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk.add(i, split(text or ""), len(text or ""))
                if chunk.chars >= CHUNK_CHARS:
                    yield _batch(list(chunk.rows(buckets)))
                    chunk = _Chunk()
        if chunk.ids:
            yield _batch(list(chunk.rows(buckets)))

    chunks = docs.select(quoted(id_col).cast("long").alias("i"), quoted(text_col).alias("t")).mapInArrow(frugal(split_up), _CHUNKS)
    chunks = stored_by(chunks, "chunk", buckets, "words")

    def encode_bucket(table: pa.Table) -> pa.Table:
        ranks, known, out = _ranks(path), {}, []
        for batch in table.to_batches():
            for chunk, numbers, counts, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "counts", "body")), strict=True):
                at, flat, sizes, body = 0, [], [], _spread(body)
                for n in _unpacked(counts).tolist():
                    word = body[at : at + n]
                    at += n
                    if (ids := known.get(word)) is None:
                        ids = known[word] = encode_word(word, ranks)
                    flat += ids
                    sizes.append(len(ids))
                out.append((chunk, 0, numbers, _packed(np.array(sizes, np.int64)), _packed(np.array(flat, np.int64))))
        return pa.Table.from_batches([_batch(out)])

    answers = chunks.where("bucket >= 0").groupBy("bucket").applyInArrow(encode_bucket, _CHUNKS)

    def reassemble(own: pa.Table, told: pa.Table) -> pa.Table:
        known, counts, seq = own.column("ids")[0].as_py(), np.frombuffer(own.column("counts")[0].as_py(), "<i8"), _unpacked(own.column("body")[0].as_py())
        parts = [(np.cumsum(_unpacked(i), dtype=np.int64), _unpacked(n), _unpacked(x)) for i, n, x in zip(*(told.column(c).to_pylist() for c in ("ids", "counts", "body")), strict=True)]
        n_words = sum(len(p[0]) for p in parts)
        size, at = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        flat, base = np.concatenate([p[2] for p in parts]).astype("<u4") if parts else np.zeros(0, "<u4"), 0
        for numbers, sizes, ids in parts:
            size[numbers] = sizes
            at[numbers] = base + np.cumsum(sizes.astype(np.int64)) - sizes
            base += len(ids)
        n = len(counts)
        ids, out, first = np.frombuffer(known[: 8 * n], "<i8").tolist(), [], 0
        there = np.frombuffer(known[8 * n :], "u1").tolist()
        for count in counts.tolist():
            words = seq[first : first + count]
            first += count
            sizes = size[words]
            total = int(sizes.sum())
            places = np.repeat(at[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
            out.append(flat[places].tobytes())
        return pa.table({id_col: pa.array([i if t else None for i, t in zip(ids, there, strict=True)], pa.int64()), "ids": pa.array(out, pa.binary())})

    return chunks.where("bucket < 0").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(reassemble, f"`{id_col}` long, ids binary")


@functools.lru_cache(maxsize=4)
def _token_table(path: str) -> pa.LargeBinaryArray:
    return pa.array(token_bytes(path), pa.large_binary())


def _joined(ids: list[bytes | None], table: pa.LargeBinaryArray) -> pa.Array:
    """Of each row the bytes of its identifiers: one join of all their tokens with the table by identifier, in place order."""
    counts = np.array([len(x or b"") // 4 for x in ids], np.int64)
    found = table.take(pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<u4")))
    ends = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1, found.offset * 8)
    at = ends[np.concatenate([[0], np.cumsum(counts)])] - ends[0]
    body = found.buffers()[2] if len(found) else pa.py_buffer(b"")
    body = body.slice(int(ends[0]), int(ends[-1] - ends[0])) if len(found) else body
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at.astype("<i8").tobytes()), body]).cast(pa.binary())


def bpe_decode(tokens: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's identifiers; null has none. A column named as the output is replaced.

    The tokens of a batch of rows join the token-byte table by identifier. The table has one row an identifier and is as
    large as the vocabulary, so every worker has all of it, and tokens stay where they are and in their order.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = without(tokens, out)
    where = tokens.columns.index(ids_col)

    def run(batches):
        table = _token_table(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _joined(batch.column(where).to_pylist(), table)], names=[*batch.schema.names, out])

    return with_columns_of(tokens, run, {out: T.BinaryType()}, 256)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    done = bpe_decode(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
