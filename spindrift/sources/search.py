"""Search results as a data source: type, dates and links are filtered and counted where the results are, one task for each span of dates.

    search.register(spark)
    spark.read.format("spindrift_search").option("path", folder).load().where("document_type = 'en' and published_date >= '2024-03-01'")

``path`` is a folder that ``store`` wrote (results by month), ``api`` a search
service that filters, orders and counts itself; ``count`` keeps the source's own
oldest results of all that the pushed filters leave.
"""

from __future__ import annotations

import datetime
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

NAME = "spindrift_search"
SCHEMA = "document_type string, published_date string, public_timestamp string, link string, title string"
COLUMNS = tuple(x.split()[0] for x in SCHEMA.split(", "))
FIRST, LAST = "0001-01-01", "9999-12-31"
#: Results asked for at once, and tasks of a service.
PAGE, SPLITS = 500, 4


@dataclass
class Wanted:
    """What the pushed filters leave: dates from ``after`` to ``before``, some types (None: all), beginnings of links, columns that aren't null."""

    after: str = FIRST
    before: str = LAST
    kinds: tuple | None = None
    prefixes: tuple = ()
    present: tuple = ()

    def take(self, f) -> bool:
        """Whether the source applies a filter in full."""
        at = getattr(f, "attribute", None)
        if at == ("published_date",) and isinstance(getattr(f, "value", None), str) and len(f.value) == 10:
            if isinstance(f, (GreaterThanOrEqual, EqualTo)):
                self.after = max(self.after, f.value)
            if isinstance(f, (LessThanOrEqual, EqualTo)):
                self.before = min(self.before, f.value)
            if isinstance(f, GreaterThan):
                self.after = max(self.after, _day(f.value, 1))
            if isinstance(f, LessThan):
                self.before = min(self.before, _day(f.value, -1))
            return isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))
        if at == ("document_type",) and isinstance(f, (EqualTo, In)):
            new = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.kinds = tuple(sorted(new if self.kinds is None else new & set(self.kinds)))
            return True
        if at == ("link",) and isinstance(f, StringStartsWith):
            self.prefixes = (*self.prefixes, f.value)
            return True
        if isinstance(f, IsNotNull) and len(at) == 1 and at[0] in COLUMNS:
            self.present = (*self.present, at[0])
            return True
        return False


def _day(text: str, days: int) -> str:
    """The day before or after; days beyond the calendar's ends are no days."""
    try:
        return (datetime.date.fromisoformat(text) + datetime.timedelta(days)).isoformat()
    except (ValueError, OverflowError):
        return text + "~" if days > 0 else ""


@dataclass
class Span(InputPartition):
    after: str
    before: str
    files: tuple = ()

    def __post_init__(self):
        super().__init__((self.after, self.before))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.wanted, self.count = Wanted(), int(options["count"]) if options.get("count") else None

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                self.count = None  # rows that Spark drops later must not use up the count
                yield f


class Stored(_Reader):
    """Results that ``store`` wrote: folders of other months aren't opened, row groups of other types and dates aren't read."""

    def __init__(self, options):
        super().__init__(options)
        self.path = options["path"]

    def partitions(self):
        from pyarrow import fs

        w = self.wanted
        if w.after > w.before:
            return [Span(FIRST, FIRST)]
        system, top = _filesystem(self.path)
        out = []
        for d in sorted(system.get_file_info(fs.FileSelector(top)), key=lambda x: x.path):
            month = d.base_name.removeprefix("month=")
            if d.type == fs.FileType.Directory and month != d.base_name and w.after[:7] <= month <= w.before[:7]:
                files = tuple(x.path for x in system.get_file_info(fs.FileSelector(d.path)) if x.base_name.endswith(".parquet"))
                out.append(Span(max(w.after, month + "-01"), min(w.before, month + "-31"), files))
        return out or [Span(FIRST, FIRST)]

    def read(self, partition):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if not partition.files:
            return
        day = pc.field("published_date")
        ok = (day >= self.wanted.after) & (day <= self.wanted.before)
        if self.wanted.kinds is not None:
            ok &= pc.field("document_type").isin(list(self.wanted.kinds))
        for c in self.wanted.present:
            ok &= pc.field(c).is_valid()
        for p in self.wanted.prefixes:
            ok &= pc.starts_with(pc.field("link"), p)
        rows = ds.dataset(list(partition.files), filesystem=_filesystem(self.path)[0], format="parquet")
        if self.count is None:
            yield from rows.to_batches(columns=list(COLUMNS), filter=ok)
            return
        import pyarrow as pa

        best = None
        for b in rows.to_batches(columns=list(COLUMNS), filter=ok):
            t = pa.Table.from_batches([b])
            t = t if best is None else pa.concat_tables([best, t])
            best = t.sort_by([("published_date", "ascending"), ("link", "ascending")]).slice(0, self.count)
        yield from best.to_batches() if best is not None else ()


class Service(_Reader):
    """A search service over HTTP: each task asks for its own span of dates, page by page."""

    def __init__(self, options):
        super().__init__(options)
        self.api, self.splits = options["api"], int(options.get("splits", SPLITS))

    def partitions(self):
        a, b = self.wanted.after, self.wanted.before
        if a > b:
            return [Span(LAST, FIRST)]
        try:
            first, last = datetime.date.fromisoformat(a), datetime.date.fromisoformat(b)
        except ValueError:
            return [Span(a, b)]
        days = (last - first).days + 1
        n = max(1, min(self.splits, days))
        edges = [first + datetime.timedelta(days * i // n) for i in range(n)]
        ends = [*(e - datetime.timedelta(1) for e in edges[1:]), last]
        return [Span(x.isoformat(), y.isoformat()) for x, y in zip(edges, ends, strict=True)]

    def read(self, partition):
        import json
        from urllib.parse import urlencode
        from urllib.request import urlopen

        import pyarrow as pa

        if partition.after > partition.before:
            return
        given, start = 0, 0
        while self.count is None or given < self.count:
            size = PAGE if self.count is None else min(PAGE, self.count - given)
            ask = [("filter_public_timestamp", f"from:{partition.after},to:{partition.before}"), ("order", "public_timestamp"), ("count", size), ("start", start), ("fields", "title,link,public_timestamp,content_store_document_type")]
            ask += [("filter_content_store_document_type", k) for k in self.wanted.kinds or ()]
            with urlopen(f"{self.api}?{urlencode(ask)}", timeout=30) as f:
                found = json.load(f).get("results", [])
            start += len(found)
            rows = []
            for r in found:
                stamp, link = r.get("public_timestamp") or "", r.get("link") or ""
                kind = r.get("content_store_document_type")
                # services answer roughly: what a pushed filter excludes is left out here
                if "document_type" in self.wanted.present and kind is None:
                    continue
                if partition.after <= stamp[:10] <= partition.before and all(link.startswith(p) for p in self.wanted.prefixes) and (self.wanted.kinds is None or kind in self.wanted.kinds):
                    rows.append((kind, stamp[:10], stamp, link, (r.get("title") or "").strip()))
            given += len(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(COLUMNS))
            if len(found) < size:
                return


class Search(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        if self.options.get("path"):
            return Stored(self.options)
        if self.options.get("api"):
            return Service(self.options)
        raise ValueError("give the option path or api")


def register(spark: SparkSession) -> None:
    """Make the source known to a session, filters pushed down to it. The classes travel by value, so executors need no package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Search)


def store(results: DataFrame, path: str) -> str:
    """Write results (SCHEMA) by month, each sorted by date and link; what has no date of 10 signs is left out."""
    rows = results.select(*COLUMNS).where(F.length("published_date") == 10).withColumn("month", F.left("published_date", F.lit(7)))
    rows.repartitionByRange("month", "published_date", "link").sortWithinPartitions("month", "published_date", "link").write.mode("overwrite").partitionBy("month").parquet(path)
    return path


def oldest(spark: SparkSession, where, count: int, **options) -> DataFrame:
    """The ``count`` oldest results of a source that satisfy ``where``; ties go by link. Each task hands over ``count`` at most."""
    rows = spark.read.format(NAME).options(**options, count=str(count)).load().where(where)
    return rows.orderBy("published_date", "link").limit(count)
