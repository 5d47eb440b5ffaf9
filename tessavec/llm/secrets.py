"""Secret scans: one pass of a combined deterministic automaton over the bytes of each text.

The rules are compiled whole, by subset construction and minimisation, into one table of transitions. The pass marks
every byte where a rule's beginning is complete and every byte where the whole rule may end. Since the last part of a
rule repeats, its end marks follow each other, and a match goes on to the last of them. Where it starts is read by the
backward automaton of the beginnings. Matches are then taken leftmost first and without overlap within a kind, and the
least lengths apply. The least length of ``hex`` is part of the automaton, as expanded states; those of the others are
checked on the spans, since a match that is too short still takes its characters.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import with_columns_of, without
from .automaton import Dfa


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?"""
#: kind: (beginning, what may follow it, least length of the value or, without a value, of the match)
RULES: dict[str, tuple[str, str, int]] = {
    "assign": (_ASSIGN + "[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.=-]*", 6),
    "access": ("AKIA[A-Z0-9]", "[A-Z0-9]*", 20),
    "hex": ("[0-9a-f]{24}", "[0-9a-f]*", 24),
    "github": ("gh[opsu]_[A-Za-z0-9]", "[A-Za-z0-9]*", 34),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 1),
}
BASE = ("assign", "access", "hex")
KINDS = tuple(RULES)
#: Kinds whose least length is that of their value, which starts with the last character of the beginning.
_VALUED = {KINDS.index("assign")}
_LEAST = [least for _, _, least in RULES.values()]


@functools.cache
def combined() -> Dfa:
    """The beginnings of all rules, and all rules whole."""
    return Dfa([first.encode() for first, _, _ in RULES.values()] + [(first + more).encode() for first, more, _ in RULES.values()])


@functools.cache
def beginnings() -> Dfa:
    """The beginnings of all rules, read backward."""
    return Dfa([first.encode() for first, _, _ in RULES.values()], backward=True)


def spans_of(data: bytes, starts: np.ndarray, places: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, first byte, kind number, end) of the texts that begin at ``starts`` in ``data``, from the marks of a pass.

    Per text ordered by start, then kind; leftmost and non-overlapping per kind, too short ones dropped.
    """
    out, back = [], beginnings()
    for k in range(len(KINDS)):
        begun, ends = places[bits >> k & 1 == 1], places[bits >> k + len(KINDS) & 1 == 1]
        lasts = ends[np.append(np.diff(ends) != 1, True)] if len(ends) else ends
        texts, lasts = np.searchsorted(starts, begun, side="right") - 1, lasts[np.searchsorted(lasts, begun)]
        free = 0
        for text, first, last in zip(texts.tolist(), begun.tolist(), lasts.tolist(), strict=True):
            # what starts left of free lies in the last match, which took it or dropped it
            if first >= free and (start := back.longest(data, first, k)) >= free:
                free = last + 1
                if free - (first if k in _VALUED else start) >= _LEAST[k]:
                    out.append((text, start, k, free))
    return sorted(out)


def find_spans(texts: list[str | None], dfa: Dfa) -> dict[int, list[tuple[int, int, int]]]:
    """(start, kind number, end) in code points of the texts that have any, by place in the list."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw)
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for text, start, kind, end in spans_of(data, starts, *dfa.scan(np.frombuffer(data, np.uint8))):
        found.setdefault(text, []).append((start - int(starts[text]), kind, end - int(starts[text])))
    for d, spans in found.items():
        if len(raw[d]) > len(texts[d]):  # code points before a byte: bytes that don't continue one
            before = np.cumsum(np.frombuffer(raw[d], np.uint8) & 0xC0 != 0x80, dtype=np.int64)
            found[d] = [(int(before[s]) - 1, kind, int(before[e - 1])) for s, kind, e in spans]
    return found


def _slices(texts: list[str | None], limit: int = 8 << 20):
    """Ranges of the list with about ``limit`` characters each."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """Adds an array of (start, kind, end), ordered by start, then kind as listed; code points, end exclusive.

    Null and empty texts have no spans. A column named as the output is replaced.
    """
    docs = without(docs, out)
    dfa, where = combined(), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            spans: list[list] = []
            for a, b in _slices(texts):
                found = find_spans(texts[a:b], dfa)
                spans += [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in found.get(i, ())] for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS_ARROW)], names=[*batch.schema.names, out])

    return with_columns_of(docs, run, {out: _SPANS})


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span of every kind replaced by ``mask``; overlapping spans become one mask.

    All rows and columns stay; texts without a secret are untouched.
    """
    dfa, where = combined(), docs.columns.index(text_col)

    def clean(text: str, spans) -> str:
        parts, at = [], 0
        for s, _, e in spans:
            if s >= at:
                parts += [text[at:s], mask]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for a, b in _slices(texts):
                for i, spans in find_spans(texts[a:b], dfa).items():
                    texts[a + i] = clean(texts[a + i], spans)
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    return with_columns_of(docs, run, {})


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, said), ",")
    found = scan_secrets(docs).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
