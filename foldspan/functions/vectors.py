"""Row-wise expressions on value vectors, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def legal(q="q", mask="mask") -> Column:
    """``array<struct<action, q>>`` of entries that are allowed and finite."""
    pairs = F.transform(F.arrays_zip(_c(q).alias("q"), _c(mask).alias("m")), lambda x, i: F.struct(i.cast("int").alias("action"), x["q"].alias("q"), x["m"].alias("m")))
    return F.transform(
        F.filter(pairs, lambda x: x["m"] & x["q"].isNotNull() & ~F.isnan(x["q"]) & (F.abs(x["q"]) < float("inf"))),
        lambda x: F.struct(x["action"].alias("action"), x["q"].alias("q")),
    )


def ranked(pairs) -> Column:
    """Legal entries by descending value; ties to the lower action."""
    by = F.transform(_c(pairs), lambda x: F.struct((-x["q"]).alias("k"), x["action"].alias("action")))
    return F.transform(F.array_sort(by), lambda x: F.struct(x["action"].alias("action"), (-x["k"]).alias("q")))


def values(pairs) -> Column:
    return F.transform(_c(pairs), lambda x: x["q"])


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def mean(v) -> Column:
    return F.when(F.size(_c(v)) > 0, total(v) / F.size(_c(v)))


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v, least: float = 1e-12) -> Column:
    """Scaled to length 1; vectors shorter than ``least`` become zeros."""
    n = norm(v)
    return F.transform(_c(v), lambda x: F.when(n > least, x.cast("double") / n).otherwise(0.0))


def cosine(a, b) -> Column:
    """Null where one of the vectors has no direction."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-24, dot(a, b) / n)


def softmax(v) -> Column:
    """Shifted by the largest value; for finite entries."""
    top = F.array_max(_c(v))
    e = F.transform(_c(v), lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def log_sum_exp(v) -> Column:
    top = F.array_max(_c(v))
    return top + F.ln(total(F.transform(_c(v), lambda x: F.exp(x - top))))


def entropy(p) -> Column:
    return -total(F.transform(_c(p), lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def all_close(a, b, rtol: float = 1e-5, atol: float = 1e-6) -> Column:
    return F.forall(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda x: x)


def best_alternative(pairs, action) -> Column:
    """The best legal entry other than ``action``; null if there is none."""
    return F.get(ranked(F.filter(_c(pairs), lambda x: x["action"] != _c(action))), F.lit(0))


def centred(g) -> Column:
    """A vector over legal entries without its common part: ``(common, centred norm)``."""
    n = F.size(_c(g))
    m = total(g) / n
    rest = F.transform(_c(g), lambda x: x - m)
    return F.when(n > 0, F.struct((m * F.sqrt(n.cast("double"))).alias("common"), norm(rest).alias("centred_norm")))


def adam_alignment(grad, mean, square, eps: float = 1e-8) -> Column:
    """Cosines of a gradient with Adam's mean and with its step ``mean / (sqrt(square) + eps)``."""
    step = F.zip_with(_c(mean), _c(square), lambda m, s: m / (F.sqrt(s) + eps))
    cos = lambda a, b: F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))
    return F.struct(cos(grad, mean).alias("mean"), cos(grad, step).alias("step"))
