"""Lookups by key: as an expression, or as calls that run at the same time within each Arrow batch."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier by id; any other id has 1.0.
REGION_MULTIPLIERS = {1: 1.5, 4: 1.5, 5: 0.8, 6: 0.8, 8: 1.5}


def region_multiplier(key: Column | str) -> Column:
    """Multiplier of an id, 1.0 for an unknown one, null for null.  The table is fixed and small, so it is a map literal."""
    key = F.col(key) if isinstance(key, str) else key
    cells = [F.lit(x) for k, v in REGION_MULTIPLIERS.items() for x in (k, v)]
    known = F.create_map(*cells)
    return F.when(key.isNotNull(), F.coalesce(F.try_element_at(known, key.cast("int")), F.lit(1.0)))


def async_lookup(call: Callable[[int], Awaitable[float]]):
    """A column function that awaits ``call`` for all keys of a batch together.

    It is volatile: neither results nor calls are kept, so every row of every query calls anew.  Null keys give null
    without a call.  A synchronous ``call`` is refused.
    """
    if not asyncio.iscoroutinefunction(call):
        raise TypeError("async_lookup needs an async function")

    def run(keys: pd.Series) -> pd.Series:
        async def all_of() -> list:
            async def one(k):
                return None if pd.isna(k) else await call(int(k))

            return await asyncio.gather(*map(one, keys))

        return pd.Series(asyncio.run(all_of()), dtype="float64")

    return F.pandas_udf(run, "double").asNondeterministic()
