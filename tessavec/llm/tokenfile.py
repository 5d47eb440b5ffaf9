"""Token identifiers as Arrow stream files of equal-length sequences, and reading them back.

Rows are range-partitioned by id, so that shard k holds smaller ids than shard k + 1. Each task writes one
shard: ``shard-k.arrow``, record batches of ``ids: fixed_size_list<uint>[length]`` and ``mask:
fixed_size_list<bool>[length]``, and ``shard-k.docs.arrow``, the place of each document. Within a shard the
identifiers follow each other without gaps; only its last sequence is padded, which the mask shows. All
batches but the last have the same number of sequences, hence the same byte layout, and a reader maps the
file and takes views of any sequence and its mask without copying.

Files are written under a name of the attempt's own and then moved, so lost or repeated tasks leave whole
shards. Paths go through pyarrow's file systems; the folder must be one that all executors share.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, new_path, parts_for, qualified, quoted
from .tokens import encoder

DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location with its scheme (see ``qualified``); one without is the local disk's."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one shard; ``add`` takes a document's identifiers in order."""

    def __init__(self, folder: str, shard: int, length: int, width: int, per_batch: int) -> None:
        self.fs, folder = open_fs(folder)
        self.fs.create_dir(folder)
        self.final, own = f"{folder}/shard-{shard:06d}", uuid.uuid4().hex
        self.temp = f"{folder}/_attempt-{shard:06d}-{own}"
        self.kind, self.length, self.full = np.dtype(f"<u{width}"), length, length * per_batch
        item = pa.uint16() if width == 2 else pa.uint32()
        self.item = item
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = [self.fs.open_output_stream(self.temp + end) for end in (".arrow", ".docs.arrow")]
        self.seqs = pa.ipc.new_stream(self.out[0], self.schema)
        self.index = pa.ipc.new_stream(self.out[1], DOCS)
        self.parts: list[bytes] = []
        self.held = self.n_tokens = self.n_docs = 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.parts.append(ids)
        self.held += n
        self.n_tokens += n
        self.n_docs += 1
        if self.held >= self.full:
            self._flush(last=False)
        if len(self.docs) >= 4096:
            self._flush_docs()

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.kind)
        whole = len(ids) // self.full * self.full
        for a in range(0, whole, self.full):
            self._batch(ids[a : a + self.full], self.full)
        rest = ids[whole:]
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
            rest = rest[:0]
        self.parts, self.held = [rest.tobytes()], len(rest)

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        lists = lambda values: pa.FixedSizeListArray.from_arrays(values, self.length)
        self.seqs.write_batch(pa.record_batch([lists(pa.array(ids, self.item)), lists(pa.array(np.arange(len(ids)) < valid))], schema=self.schema))

    def _flush_docs(self) -> None:
        if self.docs:
            self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=DOCS))
            self.docs = []

    def close(self) -> tuple[int, int]:
        self._flush(last=True)
        self._flush_docs()
        for w, o, end in zip((self.seqs, self.index), self.out, (".arrow", ".docs.arrow"), strict=True):
            w.close()
            o.close()
            self.fs.move(self.temp + end, self.final + end)
        return self.n_docs, self.n_tokens


class ShardReader:
    """Zero-copy views into a shard: sequence ``i`` is ``ids(i)``, its validity ``mask(i)``."""

    def __init__(self, folder: str, shard: int) -> None:
        self.fs, folder = open_fs(folder)
        self.path = f"{folder}/shard-{shard:06d}"
        self.batches = self._open(".arrow").read_all().to_batches()  # of a mapped file: views only
        self.per_batch = self.batches[0].num_rows if self.batches else 0

    def _open(self, end: str) -> pa.ipc.RecordBatchStreamReader:
        path = self.path + end
        local = isinstance(self.fs, fs.LocalFileSystem)
        return pa.ipc.open_stream(pa.memory_map(path) if local else self.fs.open_input_file(path).read_buffer())

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def ids(self, i: int) -> np.ndarray:
        return self.batches[i // self.per_batch].column(0)[i % self.per_batch].values.to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """A view of the packed bits; NumPy, which has no bits, would need a copy."""
        return self.batches[i // self.per_batch].column(1)[i % self.per_batch].values

    def documents(self):
        """(doc_id, start in the shard, n_tokens) and the identifiers of every document, as arrays in pieces."""
        arrays = [b.column(0).flatten().to_numpy() for b in self.batches]
        ends = np.cumsum([len(a) for a in arrays])
        for batch in self._open(".docs.arrow"):
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces, at = [], start
                while at < start + n:
                    k = int(np.searchsorted(ends, at, side="right"))
                    first = int(ends[k]) - len(arrays[k])
                    upto = min(start + n, int(ends[k]))
                    pieces.append(arrays[k][at - first : upto - first])
                    at = upto
                yield doc_id, start, n, pieces


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: one (shard, documents, tokens) per shard, in id order."""

    folder: str
    shards: tuple[tuple[int, int, int], ...]

    def bases(self) -> list[int]:
        return [0, *np.cumsum([n for _, _, n in self.shards]).tolist()]


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, length: int = 2048, per_batch: int = 64) -> TokenFiles:
    """Encodes every whole text, appends ``end_id`` and writes the shards. Null and empty texts are the end id alone.

    Null ids come first; rows that share an id follow in the order of their texts. ``folder`` is resolved as Spark
    does. The number of shards follows the size of the texts.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    tail = int(end_id).to_bytes(width, "little")
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    rows = rows.repartitionByRange(parts_for(rows, "text"), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        writer, encode = None, encoder(path, width).encode
        shard = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None:
                writer = ShardWriter(folder, shard, length, width, per_batch)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer.add(doc_id, encode(text) + tail)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    written = rows.mapInArrow(frugal(run), "shard long, n_docs long, n_tokens long").collect()  # one row a shard
    return TokenFiles(folder, tuple(sorted((r.shard, r.n_docs, r.n_tokens) for r in written)))


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 of every document, from the files."""
    shards, bases, folder = [s for s, _, _ in files.shards], files.bases(), files.folder

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                places = ShardReader(folder, shards[k]).documents()
                while out := [_digest(bases[k], *place) for place in itertools.islice(places, 4096)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)


def _digest(base: int, doc_id, start: int, n: int, pieces: list) -> tuple:
    crc = 0
    for p in pieces:
        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
    return doc_id, base + start, n, crc


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, new_path(spark, "tokens")))
