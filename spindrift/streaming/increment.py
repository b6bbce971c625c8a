"""Counts of a lexical index kept up to date from a stream of added, changed and deleted items, in any order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators import postings

CHANGE = "item long, seq long, text string, gone boolean"
MARK = "struct<seq:bigint,gone:boolean,hash:bigint>"
FORWARD = f"item long, mark {MARK}, dl long, terms map<string,bigint>, batch long"
DELTA = "term string, df long, dl long, batch long"


def _latest(rows: DataFrame, *columns: str) -> DataFrame:
    """Each item's row of the greatest mark."""
    return rows.groupBy("item").agg(F.max("mark").alias("mark"), F.max_by(F.struct(*columns), "mark").alias("v")).select("item", "mark", *[f"v.{c}" for c in columns])


@dataclass
class Increment:
    """An index's forward lists and signed counts in a folder, a piece for each batch; generations are written by ``compact``.

    A change (item, seq, text, gone) replaces what has a lesser seq; of equal
    seqs a deletion wins, then the greater hash of the text, so that the state
    doesn't depend on the order or the repetition of batches. Deletions stay as
    marks, since older changes may come later. Rows without an item or a seq are
    no changes; a null text is an empty one.
    """

    spark: SparkSession
    path: str

    def _generation(self) -> int:
        """The newest generation that is complete; 0, which may be empty, at first."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            return 0
        done = [s.getPath() for s in fs.listStatus(at)]
        return max([int(p.getName()[4:]) for p in done if p.getName().startswith("gen-") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "delta/batch=-1/_SUCCESS"))], default=0)

    def _read(self, name: str, schema: str, generation: int | None = None) -> DataFrame:
        from pyspark.errors import AnalysisException

        g = self._generation() if generation is None else generation
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/gen-{g}/{name}").parquet(f"{self.path}/gen-{g}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch of changes. One that is applied again, as after a failure, replaces its own pieces and nothing else.

        Only the items of the batch are looked up: their marks and old terms, by
        a join on the item; counts change by the difference.
        """
        mark = F.struct(F.col("seq"), F.coalesce("gone", F.lit(False)).alias("gone"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
        new = changes.where("item is not null and seq is not null").select("item", mark.alias("mark"), F.when(F.coalesce("gone", F.lit(False)), "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
        new = tables.cut(_latest(new, "text"), "changes")
        g = self._generation()
        old = _latest(self._read("forward", FORWARD, g).where(F.col("batch") < batch).join(new.select("item"), "item", "left_semi"), "dl", "terms")
        old = old.select("item", F.col("mark").alias("old_mark"), F.col("dl").alias("old_dl"), F.col("terms").alias("old_terms"))
        live = new.join(old, "item", "left").where("old_mark is null or mark > old_mark")
        counts = postings.token_counts(new, "item", "text").groupBy("item").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("terms"))
        live = live.join(counts, "item", "left").withColumn("dl", F.coalesce("dl", F.lit(0)).cast("long")).withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,bigint>")))
        live = tables.cut(live.drop("text"), "live")
        top = f"{self.path}/gen-{g}"
        live.select("item", "mark", "dl", "terms").write.mode("overwrite").parquet(f"{top}/forward/batch={batch}")
        there, was = (~F.col("mark.gone")).cast("long"), F.coalesce((~F.col("old_mark.gone")).cast("long"), F.lit(0))
        plus = live.select(F.explode(F.map_keys("terms")).alias("term"), F.lit(1).cast("long").alias("df"), F.lit(0).cast("long").alias("dl"))
        minus = live.where("old_terms is not null").select(F.explode(F.map_keys("old_terms")).alias("term"), F.lit(-1).cast("long").alias("df"), F.lit(0).cast("long").alias("dl"))
        whole = live.select(F.lit(None).cast("string").alias("term"), (there - was).alias("df"), (F.col("dl") - F.coalesce("old_dl", F.lit(0))).alias("dl"))
        delta = plus.unionByName(minus).unionByName(whole).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df <> 0 or dl <> 0")
        delta.write.mode("overwrite").parquet(f"{top}/delta/batch={batch}")
        tables.drop(new, live)

    def compact(self, upto: int) -> None:
        """One piece, numbered -1, of all pieces up to a batch that is applied: a new generation, complete when its counts are written."""
        g = self._generation()
        fwd, delta = self._read("forward", FORWARD, g), self._read("delta", DELTA, g)
        if extra := fwd.where(F.col("batch") > upto).limit(1).count():
            raise ValueError(f"batches after {upto} are applied already ({extra})")
        top = f"{self.path}/gen-{g + 1}"
        _latest(fwd, "dl", "terms").repartitionByRange("item").sortWithinPartitions("item").write.mode("overwrite").parquet(f"{top}/forward/batch=-1")
        delta.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).where("df <> 0 or dl <> 0").write.mode("overwrite").parquet(f"{top}/delta/batch=-1")

    def terms(self) -> DataFrame:
        """(term, df) of the items that there are."""
        return self._read("delta", DELTA).where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def size(self) -> tuple[int, float]:
        """Items and mean number of tokens."""
        r = self._read("delta", DELTA).where("term is null").agg(F.sum("df").alias("n"), F.sum("dl").alias("dl")).first()
        return (r.n or 0, ((r.dl or 0) / r.n if r.n else 0) or 1.0)

    def idf(self, epsilon: float = 0.25) -> DataFrame:
        """(term, df, idf), from the kept counts alone."""
        raw = self.terms().withColumn("raw", postings._raw(self.size()[0]))
        low = (raw.agg(F.avg("raw")).first()[0] or 0.0) * epsilon
        return raw.select("term", "df", F.when(F.col("raw") < 0, low).otherwise(F.col("raw")).alias("idf"))

    def _live(self) -> DataFrame:
        return _latest(self._read("forward", FORWARD), "dl", "terms").where("not mark.gone")

    def counts(self) -> DataFrame:
        """(item, dl, term, tf) as ``postings.token_counts`` gives them of the items that there are."""
        return self._live().select("item", "dl", F.explode("terms").alias("term", "tf"))

    def lengths(self) -> DataFrame:
        return self._live().select("item", "dl")

    def index(self, path: str, version: str = "", **kw) -> postings.Postings:
        """A searchable index of the present state, without a look at any text."""
        return postings.Postings.build(self.counts(), self.lengths(), path, version, **kw)

    def follow(self, changes: DataFrame, checkpoint: str):
        """Start a query that applies a stream of changes batch by batch and ends when it has seen all. The checkpoint numbers the batches, so each counts once."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
