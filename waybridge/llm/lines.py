"""Boilerplate lines by their frequency among the pages of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybridge.llm.common import read
from waybridge.session import materialized

#: share of a host's pages above which a line is boilerplate
RATIO = 0.05
#: pages a line must stand on before its share says anything
MIN_PAGES = 10


def _cut(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _names(line: Column) -> Column:
    """96 bits that name a line; short enough to travel in place of the text."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("x"), F.hash(bare).alias("y"))


def boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """(host, line, pages, host_pages): lines on more than ``ratio`` of their host's pages.

    A line is trimmed of blanks; blank lines are none.  A page counts a line once.  Every
    row is a page, repeated rows too, unless ``copies`` is false: then rows of a host with the
    same list of lines are one page, so that copies of one text do not make each
    other boilerplate.  Rows with a null text count as pages without lines,
    and a null host is a host of its own.  A host has fewer than (mean lines per page) / ratio
    such lines, however many pages it has.
    """
    names = F.array_distinct(
        F.transform(F.filter(_cut(F.col(text_col)), lambda l: F.trim(l) != ""), _names)
    )
    pages = docs.select(F.col(host_col).alias("host"), names.alias("lines"))
    if not copies:
        pages = materialized(pages.distinct(), "pages")
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (
        pages.select("host", F.explode_outer("lines").alias("line"))
        .filter(F.col("line").isNotNull())
        .groupBy("host", "line")
        .agg(F.count("*").alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    same = counts["host"].eqNullSafe(totals["host"])
    return (
        counts.join(totals, same)
        .filter(F.col("pages") > ratio * F.col("host_pages"))
        .select(counts["host"], "line", "pages", "host_pages")
    )


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """All rows and columns, with the boilerplate lines of the host taken out of the text.

    Adds ``lines`` and ``dropped_lines`` (0 for a null text, which stays null); other lines
    keep their order and blanks.  Texts are not shuffled while the lists of
    all hosts are small enough for the optimizer to copy them; beyond, hosts meet
    their lists by a join that adaptive execution splits where one host is large.
    """
    found = boilerplate(docs, host_col, text_col, ratio, min_pages, copies)
    lists = materialized(
        found.groupBy("host").agg(F.collect_set("line").alias("_drop")), "boilerplate"
    ).withColumnRenamed("host", "_host")
    joined = docs.join(lists, docs[host_col].eqNullSafe(lists["_host"]), "left")
    lines = F.col("_lines")
    kept = F.filter(lines, lambda l: ~F.array_contains(F.col("_drop"), _names(l)) | (F.trim(l) == ""))
    clean = (
        joined.withColumn("_lines", F.coalesce(_cut(F.col(text_col)), F.array().cast("array<string>")))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), lines).otherwise(kept))
        .withColumn("lines", F.size("_lines"))
        .withColumn("dropped_lines", F.size("_lines") - F.size("_kept"))
        .withColumn(
            text_col,
            F.when(F.col("dropped_lines") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text_col)),
        )
    )
    return clean.select(*docs.columns, "lines", "dropped_lines")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lines", "dropped_lines", "text"
    )


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": f"""
with l as (
  select rowid_, d.doc_id, d.source, d.text, u.line, u.pos
  from (select row_number() over () as rowid_, * from documents) d,
       unnest(string_split(d.text, chr(10))) with ordinality as u(line, pos)),
seen as (select distinct rowid_, source, trim(line, ' ') as line from l where trim(line, ' ') <> ''),
n as (select source, line, count(*) as pages from seen group by all),
t as (select source, count(*) as host_pages from documents group by all),
bad as (select n.source, n.line from n join t on n.source is not distinct from t.source
        where pages >= {MIN_PAGES} and pages > {RATIO}::double * host_pages)
select l.doc_id, l.source, cast(count(*) as integer) as lines,
       cast(count(bad.line) as integer) as dropped_lines,
       coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where bad.line is null), '') as text
from l left join bad on l.source is not distinct from bad.source and trim(l.line, ' ') = bad.line
group by l.rowid_, l.doc_id, l.source
"""
}
