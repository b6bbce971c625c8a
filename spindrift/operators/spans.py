"""Joins in time: the last row at or before a moment, and overlapping periods. No key's rows meet each other in one task, nor pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from .scans import running


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, tie: str, inner: bool = False, name: str = "found") -> DataFrame:
    """left with a struct ``name`` of the row of right that is current: the last of its keys with ``since`` <= ``at``; of equal moments that of the greatest ``tie``.

    Both sides are dealt by ranges of keys and time together, sorted, and each
    sorted part hands its last row of right on to the next (``scans.running``),
    so a key may hold most rows of either side, and no row is compared with all
    others of its key. Rows of left without a moment or a key have no such row:
    null, or left out if ``inner``. Rows of right without one are never current;
    repeated rows of left come as often as they occur. Columns of names that
    begin with ``_scan_`` or ``_as_`` are taken.
    """
    ok = lambda c: [F.col(f"`{x}`").isNotNull() for x in (*keys, c)]

    def all_of(conds):
        out = conds[0]
        for c in conds[1:]:
            out = out & c
        return out

    key = lambda df: [F.col(f"`{k}`").alias(f"_as_{i}") for i, k in enumerate(keys)]
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kind = right.select(whole(right).alias("r")).schema["r"].dataType
    a = left.where(all_of(ok(at))).select(*key(left), F.col(f"`{at}`").alias("_as_t"), F.lit(1).alias("_as_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_as_tie"), whole(left).alias("_as_l"), F.lit(None).cast(kind).alias("_as_r"))
    b = right.where(all_of(ok(since))).select(*key(right), F.col(f"`{since}`").alias("_as_t"), F.lit(0).alias("_as_side"), F.col(f"`{tie}`").alias("_as_tie"), F.lit(None).cast(left.select(whole(left).alias("l")).schema["l"].dataType).alias("_as_l"), whole(right).alias("_as_r"))
    names = [f"_as_{i}" for i in range(len(keys))]
    rows = running(b.unionByName(a), names, ["_as_t", "_as_side", "_as_tie"], lasts={"_as_now": F.col("_as_r")}).where("_as_side = 1")
    out = rows.select(*[F.col(f"_as_l.`{c}`").alias(c) for c in left.columns], F.col("_as_now").alias(name))
    if inner:
        return out.where(F.col(name).isNotNull())
    rest = left.where(~F.coalesce(all_of(ok(at)), F.lit(False))).withColumn(name, F.lit(None).cast(kind))
    return out.unionByName(rest)


def pieces(start, end, levels: int):
    """The period [start, end) as an array of (level, node): the node covers the moments of node * 2^level to (node + 1) * 2^level, no two of them share one. At most two a level."""

    def level(i):
        size = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        lo, hi = F.call_function("shiftright", start + size - 1, i), F.call_function("shiftright", end, i)
        after = lo + F.pmod(lo, F.lit(2))
        first = F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), F.struct(i.alias("level"), lo.alias("node")))
        last = F.when((after < hi) & (F.pmod(hi, F.lit(2)) == 1), F.struct(i.alias("level"), (hi - 1).alias("node")))
        return F.array(first, last)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level)), lambda x: x.isNotNull())


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(a, b): structs of the rows of a and b with equal keys whose periods [start, end), in whole numbers, share a moment; each pair once.

    Two periods share a moment if one begins within the other. A period is cut
    into at most two nodes a level of a binary tree over the moments, a beginning
    lies in one node of each level, so they meet by equality on the node: every
    two rows that meet are a result, a long period costs no more than twice the
    levels, and neither a key nor a node makes rows that aren't results. A node
    with very many results is a skewed join of unlike sides, which adaptive
    execution splits. Empty, reversed and null periods share nothing, null keys
    are no keys. Columns of names that begin with ``_sp_`` are taken.
    """

    def side(df, name):
        ok = F.col(f"`{start}`") < F.col(f"`{end}`")
        for k in keys:
            ok = ok & F.col(f"`{k}`").isNotNull()
        cols = [F.col(f"`{k}`").alias(f"_sp_{i}") for i, k in enumerate(keys)]
        return df.where(ok).select(*cols, F.col(f"`{start}`").cast("long").alias("_sp_s"), F.col(f"`{end}`").cast("long").alias("_sp_e"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))

    x, y = tables.cut(side(a, "a"), "periods"), tables.cut(side(b, "b"), "periods")
    names = [f"_sp_{i}" for i in range(len(keys))]

    def met(inside, around, one, other, own_start):
        """Rows of ``inside`` that begin within those of ``around`` (after their start unless ``own_start``)."""
        longest = around.agg(F.max(F.col("_sp_e") - F.col("_sp_s"))).first()[0]
        if longest is None:
            return inside.crossJoin(around.select(other).limit(0)).select("a", "b") if one == "a" else around.crossJoin(inside.select(one).limit(0)).select("a", "b")
        levels = int(longest).bit_length()
        begin = F.col("_sp_s") if own_start else F.col("_sp_s") + 1
        cover = around.select(*names, F.explode(pieces(begin, F.col("_sp_e"), levels)).alias("_sp_n"), other).select(*names, "_sp_n.*", other)
        used = F.broadcast(cover.select("level").distinct())  # 64 at most
        points = inside.select(*names, "_sp_s", one, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).join(used, "level", "left_semi")
        points = points.withColumn("node", F.expr("shiftright(_sp_s, level)")).drop("_sp_s")
        return cover.join(points, [*names, "level", "node"]).select("a", "b")

    return met(x, y, "a", "b", True).unionByName(met(y, x, "b", "a", False))
