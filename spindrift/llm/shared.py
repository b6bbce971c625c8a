"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..tables import cut, drop, folder

__all__ = ["arrow", "attach", "components", "cut", "drop", "folder", "free"]

#: Bytes of an Arrow batch on its way to Python and back. Spark's own bound is 64 MB, of which JVM and worker hold several copies for each core.
BATCH = 4 << 20
#: Parts into which a node's edges are dealt when they meet its least neighbour.
SALTS = 8


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, on workers that have this package and free what a task leaves. ``run`` gets its columns by place: under their names, dots in them would fail."""
    spark, limit = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    ship(spark)
    if spark.conf.get(limit, "67108864b") in ("67108864b", "67108864", "64m"):  # a user's own bound stands
        spark.conf.set(limit, f"{BATCH}b")

    def tidy(batches):
        from .kernel import release

        try:
            yield from run(batches)
        finally:
            release()

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(tidy, schema)


def free(taken, name: str) -> str:
    """name, with underscores behind it until no column of ``taken`` is called so (letter case aside)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the m of their u from ``least`` (u, m), a row a node. Each node's edges are dealt to ``SALTS`` tasks by v, so no hub is one task."""
    each = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    return edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(each, ["u", "_s"]).drop("_s")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the least node it reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step
    keeps the number of rows linear in the edges, a hub's rows are spread by the
    adaptive join, and every round is written to the shared folder. Ends at the
    fixed point, found by a count and a checksum; ``rounds`` only guards against
    a fault and raises.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        n, check = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == seen or not n:
            break
        seen = (n, check)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _met(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _met(large, least).select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        new = cut(small.distinct(), "edges")
        drop(e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select("v", "v").toDF("node", "label").distinct())


def attach(docs: DataFrame, text_col: str, make, kind: str, keep: list[str] | None = None, name: str = "found") -> DataFrame:
    """``keep`` columns of docs (all by default) and a struct ``name`` of type ``kind`` made from each whole text.

    Where docs keep a column of that name, the struct is called ``free(keep, name)``.

    ``make()`` runs once a task and returns a function from an Arrow string
    column, in pieces of bounded size, to a struct column. Narrow: no shuffle.
    """
    keep = docs.columns if keep is None else keep
    name = free(keep, name)
    cols = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{text_col}`").alias(free([*keep, name], "_text_"))]
    src = docs.select(*cols)
    schema = docs.select(*cols[:-1], F.lit(None).cast(kind).alias(name)).schema
    names, at = [*keep, name], len(keep)

    def run(batches):
        import pyarrow as pa

        from .kernel import pieces

        f = make()
        for b in batches:
            for p in pieces(b, at):
                yield pa.RecordBatch.from_arrays([*p.columns[:at], f(p.column(at))], names=names)

    return arrow(src, run, schema)
