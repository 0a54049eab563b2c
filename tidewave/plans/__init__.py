"""The registered queries: each applies operators to the given tables, beside the SQL it must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bands, events, groups, statistics, windows

FLAGSHIP = "w1_fixed_window_crest"
MODULES = (windows, statistics, bands, events, groups)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.O.items()}
