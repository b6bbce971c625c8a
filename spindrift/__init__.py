"""Document retrieval and retrieval evaluation on Spark DataFrames."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile


#: Bytes of an Arrow batch on its way to Python and back. Spark's own bounds are 64 MB and 10,000 rows, of which a worker of each core holds several copies.
BATCH = 4 << 20


def ship(spark) -> None:
    """Send this package to the executors, once a context, so that it need not be installed there; keep the session's Arrow batches small, unless the user has set a bound."""
    sc, limit = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, "67108864b") in ("67108864b", "67108864", "64m"):
        spark.conf.set(limit, f"{BATCH}b")
    if getattr(sc, "_spindrift_sent", False):
        return
    top = pathlib.Path(__file__).resolve().parent
    to = pathlib.Path(tempfile.mkdtemp(prefix="spindrift-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._spindrift_sent = True


def read(spark, path: str):
    """A Parquet table. One that Spark would read in fewer tasks than it has cores (a small file of one row group) is dealt over all of them."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
