"""Mixing sources to target weights by repetition rates [relational only]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: Sources whose rates are broadcast; with more they are joined by a shuffle.
SOURCES = 100_000
MOST = 2


def word_count(col):
    """Number of runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.expr(f"regexp_count({col}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) rows to (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes by weight; none gets over ``most`` times its size, and
    what is cut off goes to the others by weight until none is above. In closed
    form: by ascending size / weight, a source is full if the rest, dealt among
    it and the later ones, fills it. Every statistic is a sum over all rows, one
    row per source; the tables with one row per source are as small as the
    number of sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rn") - 1) % len(weights) + 1)
    by = by.selectExpr("source", "source_size", "row_number() over (order by source is null, source) as rn").withColumn("weight", w.cast("double"))
    by = by.withColumn("most", (F.col("source_size") * most).cast("double"))
    over = "over (order by most / weight, rn rows between unbounded preceding and 1 preceding)"
    by = by.selectExpr("*", f"coalesce(sum(most) {over}, 0d) as below", f"coalesce(sum(weight) {over}, 0d) as light", "sum(weight) over () as heavy", f"sum(source_size) over () * {share}d as budget")
    by = by.withColumn("full", F.expr("(budget - below) * weight >= most * (heavy - light)"))
    by = by.selectExpr("*", "coalesce(sum(case when full then most end) over (), 0d) as given", "coalesce(sum(case when not full then weight end) over (), 0d) as left_weight")
    return by.selectExpr("source", "source_size", "case when full then most else weight * (budget - given) / left_weight end as target")


def _small(t: DataFrame) -> DataFrame:
    """The table of sources, written; broadcast if its counted rows allow it, so that texts and hot sources aren't shuffled."""
    t = cut(t, "sources")
    return F.broadcast(t) if t.count() <= SOURCES else t


def draw(id_col: str, text_col: str, seed: str = SEED):
    """A number in [0, 1) from a hash of the seed, the id and the text: reruns agree, and unlike texts under one id (or none) draw apart."""
    part = lambda c: F.coalesce(c, F.lit(""))
    mark = F.concat(F.lit(seed + ":"), part(F.col(f"`{id_col}`").cast("string")), F.lit(":"), F.md5(part(F.col(f"`{text_col}`"))))
    return F.conv(F.substring(F.md5(mark), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of docs.

    copies is floor(rate) plus one with probability equal to the fraction, rate
    being target / source_size (0 for a source without words). Null texts have
    no words, null sources are a source of their own, rows that repeat are
    mixed like any other row, those of one id and text alike. Empty tables give
    none.
    """
    sized = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(f"`{text_col}`").alias("size"), draw(id_col, text_col).alias("draw")), "sizes")
    t = _small(targets(sized).withColumnRenamed("source", "its"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = sized.join(t, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("rate", rate)
    return out.withColumn("copies", (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixed corpus: every row of docs as often as ``rates`` says, with the columns of docs, whatever their names."""
    mine = free(docs.columns, "_mix")
    t = targets(docs.select(F.col(f"`{source_col}`").alias("source"), word_count(f"`{text_col}`").alias("size")))
    t = t.select(F.struct(F.col("source").alias("s"), (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).alias("rate")).alias(mine))
    full = docs.join(_small(t), F.col(f"`{source_col}`").eqNullSafe(F.col(f"{mine}.s")))
    rate = F.col(f"{mine}.rate")
    n = (F.floor(rate) + (draw(id_col, text_col) < rate - F.floor(rate)).cast("int")).cast("int")
    return full.withColumn(mine, F.array_repeat(F.lit(0), n)).withColumn(mine, F.explode(mine)).drop(mine)


def mix_report(docs: DataFrame) -> DataFrame:
    r = rates(docs)
    return r.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
with s as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(coalesce(text, '')) as mark from documents),
b as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source collate "C") as rn from s group by source),
w as (select *, ([5.0, 2.0, 1.0])[((rn - 1) % 3 + 1)::int]::double as weight, (source_size * 2)::double as most from b),
c as (select *, coalesce(sum(most) over p, 0)::double as below, coalesce(sum(weight) over p, 0)::double as light, (sum(weight) over ())::double as heavy, (sum(source_size) over ())::double * 1.5::double as budget
  from w window p as (order by most / weight, rn rows between unbounded preceding and 1 preceding)),
f as (select *, (budget - below) * weight >= most * (heavy - light) as full_up from c),
g as (select *, coalesce(sum(case when full_up then most end) over (), 0)::double as given, coalesce(sum(case when not full_up then weight end) over (), 0)::double as left_weight from f),
t as (select source, source_size, case when full_up then most else weight * (budget - given) / left_weight end as target from g),
r as (select doc_id, mark, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate from s join t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || mark), 1, 12))::bigint::double / 281474976710656.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from r
"""
