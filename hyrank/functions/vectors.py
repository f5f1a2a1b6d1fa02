"""Vector column expressions (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_squares(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column | str) -> Column:
    """v / ||v|| as array<double>; a zero, empty or null vector gives null."""
    v = _c(v)
    norm = F.sqrt(sum_squares(v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def normalize_tokens(m: Column | str) -> Column:
    """Normalise every token vector of a multivector; drops zero tokens."""
    m = _c(m)
    normed = F.transform(m, lambda t: l2_normalize(t))
    return F.filter(normed, lambda t: t.isNotNull())


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def token_size(df: DataFrame, col: str) -> Column:
    """Dimension of a row's first token vector, packed (binary, float32) or not."""
    first = F.get(F.col(col), 0)
    packed = isinstance(df.schema[col].dataType.elementType, T.BinaryType)
    return (F.length(first) / 4).cast("int") if packed else F.size(first)


def has_dim(v: Column | str, dim: int) -> Column:
    return F.coalesce(F.size(_c(v)) == F.lit(dim), F.lit(False))


def all_tokens_dim(m: Column | str, dim: int) -> Column:
    m = _c(m)
    return F.coalesce((F.size(m) > 0) & F.forall(m, lambda t: F.size(t) == F.lit(dim)), F.lit(False))
