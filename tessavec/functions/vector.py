"""Vector expressions. Components may be FLOAT; sums are in DOUBLE, as FLOAT sums depend on their order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector in DOUBLE; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def checked_query(values: Sequence[float], dim: int | None = None) -> list[float]:
    """The components of a query vector; raises where one isn't finite or the length isn't ``dim``."""
    found = [float("nan") if x is None else float(x) for x in values]
    if not found or not all(map(math.isfinite, found)):
        raise ValueError("a query vector needs finite components")
    if dim is not None and len(found) != dim:
        raise ValueError(f"a query vector needs {dim} components, not {len(found)}")
    return found


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(x) for x in checked_query(values)])


def score(vector: Column, query: Sequence[float] | Column, distance: str = "dot") -> Column:
    """Higher is better; rounded so that ties are ties in every engine. Null for a null vector.

    A vector of another length than the query raises when the row is read.
    """
    if distance not in ("dot", "cosine"):
        raise ValueError(f"unknown distance: {distance}")
    q = query if isinstance(query, Column) else vector_literal(query)
    found = F.round(dot(vector, q) if distance == "dot" else cosine(vector, q), SCORE_DIGITS)
    wrong = F.raise_error(F.lit("the query vector has another length than the vectors")).cast("double")
    return F.when(F.size(vector) == F.size(q), found).when(vector.isNotNull(), wrong)


def truncated_utf8(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes; a character cut in two becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))


def is_valid_vector(v: Column, dim: int) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & fine, F.lit(False))
