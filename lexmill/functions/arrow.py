"""Plain Python functions over values as Arrow-batched column functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def column(f: Callable, returns: str) -> Callable:
    """f(value, ...) as a column function; a row with a null in the first argument gives null."""
    if returns.startswith("struct<"):  # a struct would have to come as a frame
        many = column(lambda *v: [x] if (x := f(*v)) is not None else [], f"array<{returns}>")
        return lambda *c: F.get(many(*c), F.lit(0))

    @F.pandas_udf(returns)
    def run(*args: pd.Series) -> pd.Series:
        first = args[0]
        return pd.Series([None if v is None else f(v, *rest) for v, *rest in zip(first, *args[1:], strict=True)], index=first.index, dtype=object)

    return run
