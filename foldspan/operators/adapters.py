"""Pluggable preparation of rows: named adapters of three steps, and encoders named by module.

An adapter turns rows into what a consumer reads: ``rows`` picks them, ``extras``
adds columns, ``finish`` settles types.  Each step is a ``DataFrame -> DataFrame``
function, so Catalyst sees one plan.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.functions import actions as A
from foldspan.functions import buckets as B

Step = Callable[[DataFrame], DataFrame]


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Adapter:
    rows: Step = _same
    extras: Step = _same
    finish: Step = _same


_KNOWN: dict[str, Adapter] = {}


def register(name: str, adapter: Adapter) -> None:
    """Makes an adapter known by name; a name that is taken raises."""
    if name in _KNOWN:
        raise ValueError(f"adapter {name} is registered")
    _KNOWN[name] = adapter


def names() -> list[str]:
    return sorted(_KNOWN)


def adapted(df: DataFrame, name: str) -> DataFrame:
    """Rows prepared by the adapter of that name; an unknown name raises."""
    if name not in _KNOWN:
        raise KeyError(f"no adapter {name}; there are {', '.join(names())}")
    a = _KNOWN[name]
    return df.transform(a.rows).transform(a.extras).transform(a.finish)


def encoder(path: str) -> Callable:
    """The function named ``module:function`` (or ``module``, for its ``encode``)."""
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function or "encode")


def _legal(df: DataFrame) -> DataFrame:
    """Rows whose action the mask allows; others, and rows without either, are dropped."""
    return df.where(F.coalesce(F.get("mask", F.col("action")), F.lit(False)))


def _targets(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.coalesce(B.clip(B.finite("target")), F.lit(0.0)))


def _turned(df: DataFrame) -> DataFrame:
    """The rows once as they are and once with the first two suits changed places."""
    moved = df.withColumns({"action": A.permute_action("action", (1, 0, 2)), "mask": A.permute_suits("mask", (1, 0, 2)), "turned": F.lit(1)})
    return df.withColumn("turned", F.lit(0)).unionByName(moved)


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({"action": F.col("action").cast("smallint"), "value": F.col("value").cast("float")})


register("policy", Adapter(_legal, _same, lambda df: df.withColumn("action", F.col("action").cast("smallint"))))
register("value", Adapter(_legal, _targets, _typed))
register("augmented", Adapter(_legal, lambda df: _turned(_targets(df)), _typed))
