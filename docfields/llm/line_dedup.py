"""Line dedup by site-relative frequency.

A line is boilerplate of a site if it stands on at least ``min_pages`` pages of the site and on more than
``ratio`` of them. Pages are counted per site and line digest, combined on the map side, so neither a hot site nor
a line on every page gathers in one task. A page has few lines and a boilerplate line a fixed share of all pages,
so a site has at most (lines per page / ratio) such lines; they form one small row per site. That table is
stored, so the planner knows its size: it broadcasts a small one and otherwise shuffles, splitting hot sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import NO_GAP, stored

RATIO = 0.02
MIN_PAGES = 5


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _is_blank(line: Column) -> Column:
    return ~line.rlike(NO_GAP)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def host(url: Column) -> Column:
    """The lower-case host of an address, null without one."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def boilerplate(
    pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """One row per site with boilerplate: site, drops (digests). ``pages`` has the columns site and text.

    ``copies_once`` counts pages of a site with the same text as one page. Copies meet on the map side as digests of
    their lines, so a hot text is one row a task.
    """
    if copies_once:
        return _boilerplate_of_texts(pages, ratio, min_pages)
    totals = pages.groupBy("site").agg(F.count("*").alias("pages_of_site")).withColumnRenamed("site", "total_site")
    distinct = F.array_distinct(F.filter(lines(F.col("text")), lambda line: ~_is_blank(line)))
    counted = (
        pages.select("site", F.explode(F.transform(distinct, _digest)).alias("line"))
        .groupBy("site", "line").agg(F.count("*").alias("pages_with_line"))
        .filter(F.col("pages_with_line") >= min_pages)
    )
    return _frequent(counted, totals, ratio)


def _boilerplate_of_texts(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    distinct = F.array_distinct(F.filter(lines(F.col("text")), lambda line: ~_is_blank(line)))
    texts = pages.select("site", _digest(F.col("text")).alias("page"), F.transform(distinct, _digest).alias("lines"))
    totals = texts.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages_of_site"))
    counted = (
        texts.dropDuplicates(["site", "page"]).select("site", F.explode("lines").alias("line"))
        .groupBy("site", "line").agg(F.count("*").alias("pages_with_line"))
        .filter(F.col("pages_with_line") >= min_pages)
    )
    return _frequent(counted, totals.withColumnRenamed("site", "total_site"), ratio)


def _frequent(counted: DataFrame, totals: DataFrame, ratio: float) -> DataFrame:
    return (
        counted.join(totals, F.col("site").eqNullSafe(F.col("total_site")))
        .filter(F.col("pages_with_line") > ratio * F.col("pages_of_site"))
        .groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("drops"))
    )


def drop_boilerplate(
    documents: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    into: str = "cleaned", copies_once: bool = False,
) -> DataFrame:
    """All rows and columns of ``documents`` plus a last column named by ``into``: struct(text, n_lines, n_dropped).

    ``site`` is an expression over the columns of ``documents``; rows with a null site form one site. Blank lines
    stay. A null text counts as a page without lines and stays null; a text may become empty. Repeated rows are
    pages of their own, unless ``copies_once`` counts each text of a site once: then copies alone make no line
    boilerplate. Without rows the result is empty. No input column but one named like ``into`` is in the way.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    packed = documents.select(
        F.struct(*columns).alias("packed"), site.cast("string").alias("site"), F.col(f"`{text}`").alias("text")
    )
    found = stored(boilerplate(packed.select("site", "text"), ratio, min_pages, copies_once), "boilerplate")
    split = packed.join(
        found.withColumnRenamed("site", "dropping_site"), F.col("site").eqNullSafe(F.col("dropping_site")), "left"
    ).select("packed", "text", "drops", lines(F.col("text")).alias("all_lines"))
    left = F.when(F.col("drops").isNull(), F.col("all_lines")).otherwise(
        F.filter("all_lines", lambda line: _is_blank(line) | ~F.array_contains(F.col("drops"), _digest(line)))
    )
    rows = split.select("packed", "text", "drops", "all_lines", left.alias("left_lines"))
    n_lines, n_left = F.size("all_lines").cast("long"), F.size("left_lines").cast("long")
    # A text without a dropped line is passed on as it is.
    new_text = F.when(n_lines == n_left, F.col("text")).otherwise(F.array_join("left_lines", "\n"))
    cleaned = F.struct(
        new_text.alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        (n_lines - n_left).alias("n_dropped"),
    )
    return rows.select(*[F.col(f"packed.`{c}`") for c in documents.columns], cleaned.alias(into))
