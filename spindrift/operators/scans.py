"""Running sums, neighbours and lookups where one key may hold much of a table: nothing here gathers a key in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut, drop

#: Rows of a block where places are known.
BLOCK = 4096
#: Keys with more than one in so many rows are heavy, so there are no more than so many of them.
HEAVY = 1 << 16
#: A key of fewer rows is never heavy: a task has room for them.
LEAST = 1000


def scan(df: DataFrame, keys: list[str], block: str, order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums, the values of the row before and the last values that weren't null (sums and lasts with this row), in each group of ``keys``.

    ``block`` splits a group into consecutive parts of bounded size; ``order``
    tells the rows of a part apart, ascending. A part's sums and its last row go
    on to the parts after it as one edge row, so a window never sees more than a
    part of a group, or a row for each part. Null keys are a group, null values
    add nothing, a group's first row has null before it, and empty tables give
    none. df is read twice: hand in a written table. Columns of names that begin
    with ``_scan_`` are taken.
    """
    sums, lags, lasts = sums or {}, lags or {}, lasts or {}
    at, part = [F.col(f"`{k}`") for k in keys], F.col(f"`{block}`")
    by = [F.col(f"`{o}`") for o in order]
    src = df.select("*", *[c.alias(f"_scan_s_{n}") for n, c in sums.items()], *[c.alias(f"_scan_k_{n}") for n, c in lasts.items()], F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in lags.items()]).alias("_scan_l"))
    newest = [F.max_by(f"_scan_k_{n}", F.when(F.col(f"_scan_k_{n}").isNotNull(), F.struct(*by))).alias(f"_scan_k_{n}") for n in lasts]
    ends = src.groupBy(*at, part).agg(*[F.sum(f"_scan_s_{n}").alias(f"_scan_s_{n}") for n in sums], *newest, F.max_by("_scan_l", F.struct(*by)).alias("_scan_l"))
    parts = Window.partitionBy(*at).orderBy(part)
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    edge = ends.select(*at, part, *[F.sum(f"_scan_s_{n}").over(before).alias(f"_scan_s_{n}") for n in sums], *[F.last(f"_scan_k_{n}", ignorenulls=True).over(before).alias(f"_scan_k_{n}") for n in lasts], F.lag("_scan_l").over(parts).alias("_scan_l")).where("_scan_l is not null")
    both = src.withColumn("_scan_real", F.lit(True)).unionByName(edge.withColumn("_scan_real", F.lit(False)), allowMissingColumns=True)
    rows = Window.partitionBy(*at, part).orderBy("_scan_real", *by)
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    made = [F.coalesce(F.sum(f"_scan_s_{n}").over(upto), F.lit(0)).alias(n) for n in sums]
    made += [F.last(f"_scan_k_{n}", ignorenulls=True).over(upto).alias(n) for n in lasts]
    before_it = F.lag("_scan_l").over(rows).alias("_scan_b") if lags else F.lit(None).alias("_scan_b")
    out = both.select(*[F.col(f"`{c}`") for c in df.columns], "_scan_real", *made, before_it).where("_scan_real")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *sums, *lasts, *[F.col(f"_scan_b.`{n}`").alias(n) for n in lags])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, place: str | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """``scan`` over rows in the order of ``order`` (nulls first), for groups of any size; ``place`` names a column for the place in the group, from 0.

    Rows are dealt by ranges of keys and order, so a large group lies in several
    sorted partitions, its parts. Rows alike in ``order`` go one after another as
    they come.
    """
    cols = [f"`{c}`" for c in (*keys, *order)]
    t = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_scan_m", F.monotonically_increasing_id()), "ranges")
    src = t.withColumn("_scan_p", F.shiftright("_scan_m", 33))
    out = scan(src, keys, "_scan_p", ["_scan_m"], (sums or {}) | ({place: F.lit(1)} if place else {}), lags, lasts)
    out = out.withColumn(place, F.col(f"`{place}`") - 1) if place else out
    return out.drop("_scan_m", "_scan_p")


def by_place(df: DataFrame, keys: list[str], place: str, sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """``scan`` where a column holds each row's place in its group, from 0: parts of ``block`` rows, no sort of the table."""
    src = df.withColumn("_scan_p", F.floor(F.col(f"`{place}`") / block))
    return scan(src, keys, "_scan_p", [place], sums, lags).drop("_scan_p")


def lookup(big: DataFrame, small: DataFrame, on: str, how: str = "inner", heavy: int = HEAVY, least: int = LEAST, counts: DataFrame | None = None) -> DataFrame:
    """big joined with small, which has one row a key. A key that holds much of big is not one task.

    Keys with more than ``least`` rows and more than one in ``heavy`` rows of big
    number at most ``heavy``: their rows of small are broadcast, a table of a
    proven bound. The others are joined by a shuffle, in which no key has many
    rows. ``how`` is inner or left; null keys match nothing. big is read three
    times: hand in a written table, or ``counts`` (key, n) of its rows, which spare two.
    """
    if counts is None:
        counts = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n"))
        total = big.count()
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0
    many = counts.withColumnRenamed("n", "_scan_n").where((F.col("_scan_n") > least) & (F.col("_scan_n") * heavy > total)).select(on)
    hot = cut(many, "heavy")
    if not hot.limit(1).count():
        drop(hot)
        return big.join(small, on, how)
    mine = F.broadcast(small.join(F.broadcast(hot), on, "left_semi"))
    dealt = big.join(F.broadcast(hot), on, "left_semi").join(mine, on, how)
    rest = big.join(F.broadcast(hot), on, "left_anti").join(small, on, how)
    return dealt.unionByName(rest)
