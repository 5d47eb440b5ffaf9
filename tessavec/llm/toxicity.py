"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(severity > k) = sigmoid(w.x - cut_k): one weight vector for all grades, with ordered cuts. The features are
the words and word beginnings of a text, hashed, with log1p(count) as their value. The labels are 0/1, so the
grades of toxic training texts come from how often the strongest toxic markers occur in them, cut at the
terciles: 0 clean, 1 to 3 mild to severe. The output is the expected severity, the sum of P(severity > k).

The model is fitted on at most ``sample`` labelled rows (default 6,000, a third of them toxic, those with
the lowest hash of the id); everything else, the scoring of whole texts, covers all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import frugal, quoted, with_columns_of, without
from .tokens import Cache

BITS, START, GRADES, LIKELY = 20, 5, 3, 0.35
_STRIP = ".,;:!?\"'()[]{}<>*#$%&-_=+/\\|~`^@"


def word_features(piece: str) -> tuple[int, ...]:
    """Hashed features of one blank-delimited piece: the word, and its beginning if the word is longer."""
    word = piece.strip(_STRIP).lower()
    if not word:
        return ()
    mask = (1 << BITS) - 1
    own = zlib.crc32(word.encode("utf-8", "replace")) & mask
    return (own,) if len(word) <= START else (own, zlib.crc32(b"^" + word[:START].encode("utf-8", "replace")) & mask)


def text_features(text: str | None) -> Counter:
    return Counter(f for p in (text or "").split() for f in word_features(p))


@dataclass(frozen=True)
class SeverityModel:
    """Selected features, their shared weights and the ordered cuts."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z[:, None] - self.cuts).sum(axis=1)

    def toxic(self, z: np.ndarray) -> np.ndarray:
        """Where P(severity > 0) exceeds ``LIKELY``: below even odds, as missed texts weigh more here than lost ones."""
        return z > self.cuts[0] + np.log(LIKELY / (1 - LIKELY))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def nothing_toxic() -> SeverityModel:
    """The model of a corpus without labels of both kinds: all texts have severity near 0."""
    return SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.array([30.0, 31.0, 32.0]))


def fit(
    rows: np.ndarray, found: np.ndarray, counts: np.ndarray, toxic: np.ndarray, n_features: int = 128, steps: int = 1500, penalty: float = 0.06, least: float = 3.5
) -> SeverityModel:
    """Fits on (row, feature, count) triples and the 0/1 label of each row; deterministic. ``penalty`` is shared by all rows.

    Features are those whose number of toxic rows is the most standard deviations off what chance gives, ``least`` or more:
    chance features have small weights, but in a very long text their counts would outweigh its markers.
    """
    n_toxic = int(toxic.sum())
    if not n_toxic or n_toxic == len(toxic) or not len(found):
        return nothing_toxic()
    names, place = np.unique(found, return_inverse=True)
    with_it = np.bincount(place)
    in_toxic = np.bincount(place, toxic[rows].astype(float))
    odds = np.log((in_toxic + 0.1) / (n_toxic + 1)) - np.log((with_it - in_toxic + 0.1) / (len(toxic) - n_toxic + 1))
    expected = with_it * (n_toxic / len(toxic))
    strength = np.where(with_it >= 3, np.abs(in_toxic - expected) / np.sqrt(expected + 0.5), -1.0)
    chosen = np.lexsort((names, -strength))[:n_features]
    chosen = chosen[strength[chosen] >= least]
    column = np.full(len(names), -1)
    column[chosen] = np.arange(len(chosen))
    at = column[place]
    keep = at >= 0
    x = np.zeros((len(toxic), len(chosen)), np.float32)
    x[rows[keep], at[keep]] = np.log1p(counts[keep])
    marks = ((odds > 3) & (in_toxic >= 3))[place] & keep
    hits = np.bincount(rows[marks], counts[marks], len(toxic))
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + (hits[:, None] > cuts).sum(axis=1), 0)
    return _fit_cumulative(x, grade, names[chosen].astype(np.int64), steps, penalty / len(toxic))


def _fit_cumulative(x: np.ndarray, grade: np.ndarray, features: np.ndarray, steps: int, l2: float) -> SeverityModel:
    """Maximum likelihood of P(y = k) = F(c_k - z) - F(c_{k-1} - z) by Adam; gaps between the cuts stay positive."""
    w, first, gaps = np.zeros(x.shape[1]), 1.0, np.zeros(GRADES - 1)
    m = v = np.zeros(x.shape[1] + GRADES)
    for step in range(1, steps + 1):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        z = x @ w.astype(np.float32)
        above = _sigmoid(z[:, None] - cuts)  # P(y > k)
        bounds = np.column_stack([np.ones(len(z)), above, np.zeros(len(z))])
        rows = np.arange(len(z))
        p = np.maximum(bounds[rows, grade] - bounds[rows, grade + 1], 1e-9)
        slope = np.column_stack([np.zeros(len(z)), above * (1 - above), np.zeros(len(z))])
        upper, lower = slope[rows, grade] / p, slope[rows, grade + 1] / p
        dz = -(upper - lower) / len(z)
        dcut = np.array([((grade == k + 1) * upper - (grade == k) * lower).sum() for k in range(GRADES)]) / len(z)
        g = np.concatenate([x.T @ dz.astype(np.float32) + l2 * w, [dcut.sum()], [dcut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[: len(w)], first - move[len(w)], gaps - move[len(w) + 1 :]
    return SeverityModel(features, w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def fit_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000) -> SeverityModel:
    """Fits on at most ``sample`` labelled rows. Rows without a label of 0 or 1, or without a document, don't count."""
    said = labels.where(quoted(id_col).isNotNull() & quoted(label_col).isin(0, 1)).groupBy(quoted(id_col).alias("__id")).agg(F.max(label_col).alias("__toxic"))
    lowest = lambda t, n: said.where(F.col("__toxic") == t).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = F.broadcast(lowest(0, sample * 2 // 3).unionByName(lowest(1, sample // 3)))  # at most ``sample`` rows of two numbers
    rows = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text")).join(chosen, "__id")

    def count(batches):
        for batch in batches:
            ids, texts, toxic = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("__id", "__text", "__toxic"))
            found = [text_features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array([np.array(list(c), "<i4").tobytes() for c in found], pa.binary()), pa.array([np.array(list(c.values()), "<i4").tobytes() for c in found], pa.binary())], names=["i", "t", "f", "n"])

    got = sorted(rows.mapInArrow(frugal(count), "i long, t int, f binary, n binary").collect(), key=lambda r: (r.i, r.f))
    join = lambda parts: np.frombuffer(b"".join(parts), "<i4").astype(np.int64)
    rows_of = np.repeat(np.arange(len(got)), [len(r.f) // 4 for r in got])
    return fit(rows_of, join(r.f for r in got), join(r.n for r in got), np.array([r.t for r in got], np.int64))


class Scorer:
    """w.x of whole texts; a piece's selected features are looked up once while it is in the cache."""

    def __init__(self, model: SeverityModel, cache: int = 300_000) -> None:
        self.weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
        self.known = Cache(cache)

    def features(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        return self.known.put(piece, tuple(f for f in word_features(piece) if f in self.weight)) if found is None else found

    def score(self, text: str | None) -> float:
        pieces = (text or "").split()
        got = list(map(self.known.early.get, pieces))
        counts: Counter = Counter()
        for k, fs in enumerate(got):
            if fs is None:
                fs = self.features(pieces[k])
            if fs:
                counts.update(fs)
        return sum(self.weight[f] * np.log1p(n) for f, n in sorted(counts.items()))


def score_toxicity(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """Adds severity (expected grade, 0 to 3) and toxic; columns so named are replaced. Null and empty texts are clean."""
    docs = without(docs, "severity", "toxic")
    where = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            z = np.fromiter(map(scorer.score, texts), np.float64, len(texts))
            empty = np.array([not (t or "").strip() for t in texts], bool)
            severity = np.where(empty, 0.0, np.round(model.severity(z), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity), pa.array(model.toxic(z) & ~empty)], names=[*batch.schema.names, "severity", "toxic"])

    return with_columns_of(docs, run, {"severity": T.DoubleType(), "toxic": T.BooleanType()})


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", "severity", "toxic", (~F.col("toxic")).alias("kept"))
