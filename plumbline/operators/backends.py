"""Registries of exchangeable parts: feature and mask backends, value functions, progress hooks.

A backend is a Python function over a pandas Series of rows, a name, and whether
it can run here.  Names are closed: an unknown one is an error, never another
backend in silence; one that can't run here is passed over with a warning.
"""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Backend:
    run: Callable[[pd.Series], pd.Series]
    returns: str
    needs: tuple[str, ...] = ()  # modules without which it can't run

    def ready(self) -> bool:
        return all(importlib.util.find_spec(m) is not None for m in self.needs)


FEATURES: dict[str, Backend] = {}
MASKS: dict[str, Backend] = {}


def register(registry: dict[str, Backend], name: str, returns: str, needs: tuple[str, ...] = ()):
    """Put a function of a Series under a name; users add their own the same way."""

    def put(f):
        registry[name] = Backend(f, returns, needs)
        return f

    return put


def available(registry: dict[str, Backend], wanted: list[str]) -> tuple[str, list[str]]:
    """(the first of the wanted backends that can run, those passed over)."""
    passed = []
    for name in wanted:
        if name not in registry:
            raise ValueError(f"no backend {name}; there are {', '.join(sorted(registry))}")
        if registry[name].ready():
            if passed:
                warnings.warn(f"{', '.join(passed)} can't run here; {name} is used", stacklevel=2)
            return name, passed
        passed.append(name)
    raise ValueError(f"none of {', '.join(wanted)} can run here")


def create(registry: dict[str, Backend], name: str):
    """The backend as a pandas UDF."""
    if name not in registry:
        raise ValueError(f"no backend {name}; there are {', '.join(sorted(registry))}")
    f = registry[name].run

    def run(x: pd.Series) -> pd.Series:
        return f(x)

    return F.pandas_udf(run, registry[name].returns)


@register(MASKS, "none", "double")
def keep_all(x: pd.Series) -> pd.Series:
    return pd.Series(1.0, index=x.index)


@register(MASKS, "threshold", "double")
def at_least_zero(x: pd.Series) -> pd.Series:
    return (x >= 0).astype(float)


@register(MASKS, "network", "double", needs=("torch",))
def network(x: pd.Series) -> pd.Series:
    raise RuntimeError("the network's weights are not part of this package")


@register(FEATURES, "identity", "double")
def identity(x: pd.Series) -> pd.Series:
    return x.astype(float)


def measure(df: DataFrame, value_fn: Callable[[DataFrame], tuple[Column, Column]]) -> DataFrame:
    """`df` with value and sigma by any function that gives the two as Columns."""
    value, sigma = value_fn(df)
    return df.withColumn("value", value).withColumn("sigma_value", sigma)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """(`df`, what tells its metrics once it has run), without a pass of their own."""
    from pyspark.sql import Observation

    o = Observation()
    return df.observe(o, *[m.alias(k) for k, m in metrics.items()]), lambda: o.get
