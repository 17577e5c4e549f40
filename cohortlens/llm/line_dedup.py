"""Line dedup by site-relative frequency.

Pages are grouped by host. For each line the pages of the host that contain it are counted and divided by
the host's page total; lines above the boilerplate ratio are dropped. Lines are compared after trimming
spaces.

Defined results: a null text stays null and counts as a page; blank lines are never counted or dropped; a
line occurring twice on a page counts once; a line on fewer than ``min_pages`` pages is kept whatever its
ratio; a page on which every line that is not blank would go is a copy rather than boilerplate, and keeps
all its lines; rows without a host belong to no site and stay as they are; repeated rows are pages of
their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh
from cohortlens.session import cut_lineage

RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line: two seeded 64-bit hashes."""
    trimmed = F.trim(line)
    return F.struct(
        F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(7), trimmed).alias("b")
    )


def _listed(text: Column) -> Column:
    return F.filter(_lines(text), lambda line: F.trim(line) != "")


def boilerplate(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines.

    A host's list holds at most (lines per page) / ratio keys, however many pages it has. Page counts are
    added up before the shuffle, so a line on a third of all pages is one row per task.
    """
    sites = pages.filter(F.col(host).isNotNull()).select(
        F.col(host).alias("host"), F.col(text).alias("text")
    )
    totals = sites.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        sites.select(
            "host", F.explode(F.array_distinct(F.transform(_listed(F.col("text")), _key))).alias("line")
        )
        .groupBy("host", "line.a", "line.b")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    return (
        counts.join(totals, "host")
        .filter(F.col("n") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set(F.struct("a", "b")).alias("lines"))
    )


def marked(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> tuple[DataFrame, str]:
    """``pages`` with one more column, the kept lines, and its name.

    The lists of boilerplate lines are written once, so their size is known: Spark broadcasts them when
    they are small and else joins by host, splitting hosts with many pages.
    """
    listed = cut_lineage(boilerplate(pages, host, text, ratio, min_pages))
    site, lines, kept = (fresh(pages, n) for n in ("_site", "_lines", "_kept"))
    listed = listed.select(F.col("host").alias(site), F.col("lines").alias(lines))
    every = _lines(F.col(text))
    left = F.filter(
        every, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(lines), _key(line))
    )
    emptied = ~F.exists(left, lambda line: F.trim(line) != "")
    out = pages.join(listed, F.col(host) == F.col(site), "left").withColumn(
        kept, F.when(F.col(lines).isNull() | emptied, every).otherwise(left)
    )
    return out.select(*pages.columns, kept), kept


def drop_lines(pages: DataFrame, n_chars: str | None = None, **options) -> DataFrame:
    """``pages`` with their text without boilerplate lines; ``n_chars`` names a length column to renew."""
    out, kept = marked(pages, **options)
    text = options.get("text", "text")
    clean = F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))
    new = {text: clean} | ({n_chars: F.length(clean).cast("long")} if n_chars else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in pages.columns])


def report(pages: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per page: its lines, the dropped ones, and length and digest of what is left."""
    out, kept = marked(pages, text=text, **options)
    clean = F.when(F.col(text).isNotNull(), F.array_join(kept, "\n"))
    lines = F.coalesce(F.size(_lines(F.col(text))), F.lit(0))
    lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(lines)
    left = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(kept))
    return out.select(
        key,
        lines.cast("long").alias("n_lines"),
        (lines - left).cast("long").alias("n_dropped"),
        F.coalesce(F.length(clean), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2(clean, 256).alias("text_sha256"),
    )


SQL = f"""
WITH pages AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines, row_number() OVER () AS page FROM documents
), listed AS (
  SELECT page, source, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM pages
), totals AS (
  SELECT source, count(*) AS pages FROM pages WHERE source IS NOT NULL GROUP BY source
), common AS (
  SELECT source, line FROM (
    SELECT source, trim(line) AS line, count(DISTINCT page) AS n
    FROM listed WHERE source IS NOT NULL AND trim(line) <> '' GROUP BY 1, 2
  ) JOIN totals USING (source)
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages
), judged AS (
  SELECT l.page, l.pos, l.line, c.line IS NOT NULL AS common,
         bool_or(c.line IS NULL AND trim(l.line) <> '') OVER (PARTITION BY l.page) AS some_left
  FROM listed l LEFT JOIN common c ON c.source = l.source AND c.line = trim(l.line)
), cleaned AS (
  SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE common AND some_left) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (common AND some_left)) AS clean
  FROM judged GROUP BY page
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(coalesce(length(clean), 0) AS BIGINT) AS n_chars, sha256(clean) AS text_sha256
FROM pages LEFT JOIN cleaned USING (page)
"""
