"""Exact deduplication by a two-pass Bloom filter, with DataFrame functions only.

Pass 1 counts one 8-byte hash of each text, after partial counts in every task, and enters the hashes that occur
again into a Bloom filter of two bits each. Pass 2 tests every row: a row with a bit that isn't set is certainly
unique and passes straight through; only the others shuffle, to be grouped by the SHA-256 of the normalised text,
so a false positive of the filter costs a little shuffle and never a wrong result.

The filter has ``bits_per_hash`` bits for each hash that occurs again, and is broadcast. Where that exceeds
``max_filter_bits`` (default 2**30 bits, 128 MB) the hashes are split into ranges with a filter of that size each,
and the rows of a range, stored apart, meet the filter of their range alone. So no filter fills up or outgrows its
bound, whatever the input's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, hot_join, hot_keys, quoted, stored

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text), 256))


def _hash(digest: Column) -> Column:
    return F.xxhash64(digest)


def _range_of(h: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), h), F.lit(ranges)).cast("int") if ranges > 1 else F.lit(0)


def _bits_of(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]


def filter_shape(repeats: int, bits_per_hash: int, max_filter_bits: int) -> tuple[int, int]:
    """(bits of one filter, number of ranges) for so many hashes; bits are a power of two and a whole 4 KB block at least."""
    most = max(1 << 15, 1 << (max_filter_bits.bit_length() - 1))
    want = max(repeats * bits_per_hash, 1)
    if want <= most:
        return max(1 << 15, 1 << (want - 1).bit_length()), 1
    return most, -(-want // most)


def repeated_hashes(digests: DataFrame) -> DataFrame:
    """Pass 1: the hashes of two or more rows (column h)."""
    return digests.groupBy(_hash(F.col("digest")).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")


def bloom_filters(hashes: DataFrame, bits: int, ranges: int) -> DataFrame:
    """(range, bucket, bitmap): of every range at most bits / 32768 rows of 4 KB."""
    cells = hashes.select(_range_of(F.col("h"), ranges).alias("range"), F.explode(F.array(*_bits_of(F.col("h"), bits))).alias("cell"))
    bucket = F.bitmap_bucket_number("cell").alias("bucket")
    return cells.groupBy("range", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def _tested(rows: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Pass 2 on one range: adds ``maybe``, true where both bits of the row's hash are set. ``blocks`` is one filter."""
    out = rows.withColumns({f"cell{k}": c for k, c in enumerate(_bits_of(_hash(F.col("digest")), bits))})
    found = F.lit(True)
    for k in (0, 1):
        part = F.broadcast(blocks.select(F.col("bucket").alias(f"bucket{k}"), F.col("bitmap").alias(f"bitmap{k}")))
        out = out.join(part, F.bitmap_bucket_number(f"cell{k}") == F.col(f"bucket{k}"), "left")
        byte = F.expr(f"substring(bitmap{k}, cast(bitmap_bit_position(cell{k}) div 8 as int) + 1, 1)")
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        place = F.expr(f"cast(bitmap_bit_position(cell{k}) % 8 as int)")
        found = found & (F.call_function("shiftright", value, place).bitwiseAND(1) == 1)
    return out.select(*rows.columns, F.coalesce(found, F.lit(False)).alias("maybe"))


class RepeatFilter:
    """The filters of all ranges over rows that have a column ``digest``."""

    def __init__(self, keys: DataFrame, bits_per_hash: int, max_filter_bits: int) -> None:
        hashes = stored(repeated_hashes(keys), "repeats")
        self.bits, self.ranges = filter_shape(hashes.count(), bits_per_hash, max_filter_bits)
        self.blocks = stored(bloom_filters(hashes, self.bits, self.ranges), "filters")

    def mark(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``maybe``. With several ranges the rows are stored by range first, without a shuffle."""
        if self.ranges == 1:
            return _tested(rows, self.blocks, self.bits)
        dealt = stored(rows.withColumn("range", _range_of(_hash(F.col("digest")), self.ranges)), "ranges", "range")
        parts = [_tested(dealt.where(F.col("range") == r).select(*rows.columns), self.blocks.where(F.col("range") == r), self.bits) for r in range(self.ranges)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _groups(maybe: DataFrame) -> DataFrame:
    """Of rows (digest, id): largest id and size of every digest. Partial results meet, not rows."""
    return maybe.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("size"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stored(docs.select(quoted(id_col).alias("id"), text_digest(quoted(text_col)).alias("digest")), "digests")


def annotate_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_hash: int = 16, max_filter_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row
    with the largest id stays. A row with a null id stays only where all rows of its group have none; rows
    that repeat the kept id with the same text are all marked kept (``drop_duplicates`` keeps one of them).
    Columns may have any names; an empty table gives an empty one.
    """
    keys = _keys(docs, id_col, text_col)
    marked = RepeatFilter(keys, bits_per_hash, max_filter_bits).mark(keys)
    hexed = F.lower(F.hex("digest")).alias("text_sha256")
    alone = marked.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    maybe = stored(marked.where("maybe").select("id", "digest"), "maybe")
    found = hot_join(maybe, stored(_groups(maybe), "groups"), "digest")
    several = found.select("id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("keep").eqNullSafe(F.col("id")).alias("kept"), hexed)
    return alone.unionByName(several).withColumnRenamed("id", id_col)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_hash: int = 16, max_filter_bits: int = 1 << 30) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names. Only possible repeats shuffle; the rest pass through.

    Rows that repeat id and text (also a null id) leave one row. Of the few texts that very many rows have, the rows
    that go are dropped before anything shuffles.
    """
    keys = _keys(docs, id_col, text_col)
    repeats = RepeatFilter(keys, bits_per_hash, max_filter_bits)
    groups = stored(_groups(repeats.mark(keys).where("maybe")), "groups")
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("id"), text_digest(quoted(text_col)).alias("digest"))
    marked = repeats.mark(packed)
    maybe, hot = marked.where("maybe"), hot_keys(groups, "size")
    if hot is not None:
        known = F.broadcast(hot.select("digest", F.col("keep").alias("hot_keep"), F.lit(True).alias("hot")))
        maybe = maybe.join(known, "digest", "left").where(F.col("hot").isNull() | F.col("hot_keep").eqNullSafe(F.col("id")))
    kept = maybe.join(groups, "digest").where(F.col("keep").eqNullSafe(F.col("id"))).dropDuplicates(["id", "digest"])
    return marked.where("not maybe").select("row.*").unionByName(kept.select("row.*"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return annotate_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
