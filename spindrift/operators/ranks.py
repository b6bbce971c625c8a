"""Values at ranks and exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .scans import lookup, running


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, name...) for each group: the number of its values and the value at each rank, from 1, which ``ranks`` gives by n.

    Equal values are counted first; the distinct ones are dealt by ranges over
    the cluster with running counts, so a group may be the whole table, and a
    task holds a part of it. Null values don't count, groups of nothing else are
    left out, null keys are a group.
    """
    key = [F.col(f"`{k}`") for k in keys]
    by = df.where(F.col(value).isNotNull()).select(F.struct(*key).alias("_rk_key"), F.col(value).alias("_rk_v")).groupBy("_rk_key", "_rk_v").agg(F.count("*").alias("_rk_c"))
    up = cut(running(by, ["_rk_key"], ["_rk_v"], sums={"_rk_upto": F.col("_rk_c")}), "ranks")
    sizes = up.groupBy("_rk_key").agg(F.sum("_rk_c").alias("_rk_n"))
    rows, n = lookup(up, sizes, "_rk_key"), F.col("_rk_n")
    picks = [F.min(F.when(F.col("_rk_upto") >= f(n), F.col("_rk_v"))).alias(name) for name, f in ranks.items()]
    out = rows.groupBy("_rk_key").agg(F.max(n).alias("n"), *picks)
    return out.select(*[F.col(f"_rk_key.`{k}`").alias(k) for k in keys], "n", *ranks)


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, name...): exact percentiles of each group, between two values in proportion."""
    place = lambda n, p: (n - 1) * F.lit(float(p))
    ranks = {}
    for name, p in shares.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor(place(n, p)) + 1
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil(place(n, p)) + 1
    got, out = at_ranks(df, keys, value, ranks), []
    for name, p in shares.items():
        h = place(F.col("n"), p)
        part = h - F.floor(h)
        out.append(((1 - part) * F.col(f"_lo_{name}") + part * F.col(f"_hi_{name}")).alias(name))
    return got.select(*[F.col(f"`{k}`") for k in keys], "n", *out)
