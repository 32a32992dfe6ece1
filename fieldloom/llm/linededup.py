"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line is boilerplate on a host if it is on more than one
distinct page (``min_pages``) and on more than ``ratio`` of the host's distinct pages.
Such lines are dropped from every page of the host. Exact copies of a page count once,
in both numbers. A page that loses every line that isn't blank has an empty text.

Hot hosts: pages and lines are pre-aggregated by (host, line, page) before counting, so
neither a host nor a line gathers its rows in one task. A host's dropped lines are at
most its mean lines per page divided by ``ratio``, whatever the number of pages; one row
per host holds their 64-bit hashes, and is joined to the pages. As that table is written
first, Spark broadcasts it where its measured size allows, and else splits hot hosts in
the sort-merge join.

Defined results: a null text stays null and isn't a page; an empty text stays empty;
blank lines aren't counted and stay; a null host is a host of its own; repeated rows
are treated alike; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _full(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate(docs: DataFrame, ratio: float = 0.05, min_pages: int = 2, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``host`` and ``gone``, the hashes of the host's boilerplate lines."""
    pages = docs.where(F.col(text_col).isNotNull()).select(F.col(host_col).alias("host"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("page"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _full), lambda x: F.xxhash64(x)))).alias("line"))
    often = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= min_pages)
    totals = totals.withColumnRenamed("host", "h")
    bad = often.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("on") > F.lit(float(ratio)) * F.col("pages"))
    return bad.groupBy("host").agg(F.collect_list("line").alias("gone"))


def drop_lines(docs: DataFrame, ratio: float = 0.05, min_pages: int = 2, host_col: str = "source", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` as a struct column, the rewritten text and the number of dropped lines."""
    gone = cut(boilerplate(docs, ratio, min_pages, host_col, text_col), "lines").withColumnRenamed("host", "_h")
    rows = docs.select(F.struct("*").alias("_row"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    rows = rows.join(gone, F.col("_host").eqNullSafe(F.col("_h")), "left")
    kept = F.when(F.col("gone").isNotNull(), F.filter(_lines(F.col("_text")), lambda x: ~_full(x) | ~F.array_contains(F.col("gone"), F.xxhash64(x))))
    rows = rows.withColumn("_kept", kept)
    dropped = F.when(F.col("_kept").isNotNull(), F.size(_lines(F.col("_text"))) - F.size("_kept")).otherwise(0)
    rows = rows.withColumn("_dropped", dropped.cast("long"))
    left = F.when(F.exists("_kept", _full), F.array_join("_kept", "\n")).otherwise(F.lit(""))
    return rows.select("_row", F.when(F.col("_dropped") > 0, left).otherwise(F.col("_text")).alias("_text"), "_dropped"), "_text", "_dropped"


def without_boilerplate(docs: DataFrame, ratio: float = 0.05, min_pages: int = 2, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, boilerplate lines dropped from the text."""
    rows, text, _ = drop_lines(docs, ratio, min_pages, host_col, text_col)
    return rows.select(*[F.col(text).alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])


SQL = """
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (SELECT source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
often AS (SELECT source, line, count(*) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY source, line),
gone AS (SELECT o.source, list(line) AS gone FROM often o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source
  WHERE n >= 2 AND n > 0.05::DOUBLE * pages GROUP BY o.source),
cut AS (SELECT d.doc_id, d.source, d.text, CASE WHEN g.gone IS NOT NULL THEN list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT list_contains(g.gone, x)) END AS kept
  FROM documents d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source),
sure AS (SELECT *, coalesce(len(string_split(text, chr(10))) - len(kept), 0) AS dropped FROM cut)
SELECT doc_id, source, CASE WHEN dropped = 0 THEN text WHEN len(list_filter(kept, lambda x: trim(x, ' ') <> '')) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
  dropped::BIGINT AS lines_dropped
FROM sure
"""
