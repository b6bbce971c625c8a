"""A page's sections as a table function, called by name from SQL: one row a section."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

ROWS = "section int, heading string, text string, n_words int"


class Sections:
    """sections(html, container): the sections that top-level h2 elements begin within the first element ``container`` (null: the usual ones).

    Section 0 has title, summary and what stands before the first heading; its
    heading is the title. Sections without text are left out, and so are pages
    without the container, null and empty ones.
    """

    def eval(self, html: str, container: str) -> Iterator:
        from ..sources.corpus import BODY, parse_page

        page = parse_page(html, (container,) if container else BODY)
        if page["body"] is None:
            return
        for i, text in enumerate(page["sections"]):
            if text:
                yield i, page["title"] if i == 0 else text.split("\n", 1)[0], text, len(text.split())


def register(spark: SparkSession, name: str = "sections") -> str:
    """Make the function known to a session's SQL; Arrow carries its rows."""
    ship(spark)
    spark.udtf.register(name, F.udtf(Sections, returnType=ROWS, useArrow=True))
    return name


def of(pages: DataFrame, html: str = "html", container: str | None = None, name: str = "sections") -> DataFrame:
    """The rows of pages joined sideways with their sections."""
    spark = pages.sparkSession
    register(spark, name)
    return spark.sql(f"select p.*, s.* from {{pages}} p, lateral {name}(p.`{html}`, {{container}}) s", pages=pages, container=container or "")
