"""Line deduplication relative to the site, with DataFrame functions only.

Pages are grouped by host; a line that stands on more than a given share of a host's pages is
boilerplate there and goes. Page counts are summed before the shuffle, so a host with most of
the pages is one row a task. The lines to drop of one host are few by arithmetic: each takes
more than ratio of the pages, so there are at most (mean lines of a page) / ratio.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

# Patterns that both Java and RE2 read alike. What is not shown, tags that end a line, other tags, the host of a URL.
HIDDEN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
BREAKS = r"(?i)</?(p|div|li|ul|ol|br|h[1-6]|title|head|body|article|section|nav|footer|header|table|tr|td|th)( [^>]*)?/?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"

#: What hides the rest up to its end mark; by themselves, and the last end mark of each. A beginning behind the last end is no hidden part, and Java would search the whole rest of the page from each of them.
ENDS = ((r"<(!--)", r"(?s)\A(.*-->)"), (r"(?i)<(script)", r"(?is)\A(.*</script>)"), (r"(?i)<(style)", r"(?is)\A(.*</style>)"))
SHIELD = "\ue000"

BROADCAST_BYTES = 32 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shielded(html: Column, begins: str, ends: str) -> Column:
    def cut(x: Column) -> Column:
        return _let(F.length(F.regexp_extract(x, ends, 1)), lambda n: F.concat(F.substring(x, F.lit(1), n), F.regexp_replace(F.substring(x, n + 1, F.length(x)), begins, f"<{SHIELD}$1")))

    return _let(html, lambda x: F.when(x.rlike(begins), cut(x)).otherwise(x))


def _shown(html: Column) -> Column:
    """html without hidden parts, in linear time: beginnings without an end are shielded, so that each one searched from finds its end, and shown again after."""
    for begins, ends in ENDS:
        html = _shielded(html, begins, ends)
    return F.replace(F.regexp_replace(html, HIDDEN, " "), F.lit(f"<{SHIELD}"), F.lit("<"))


def _untagged(text: Column) -> Column:
    """text without tags, and with line breaks for those that end a line. Behind the last > no tag ends, and none is searched for."""

    def cut(x: Column, n: Column) -> Column:
        return F.concat(F.regexp_replace(F.regexp_replace(F.substring(x, F.lit(1), n), BREAKS, "\n"), TAG, ""), F.substring(x, n + 1, F.length(x)))

    return _let(text, lambda x: _let(F.length(F.regexp_extract(x, r"(?s)\A(.*>)", 1)), lambda n: cut(x, n)))


def _begins_after(text: Column, begins: str, ends: str) -> Column:
    """Whether begins stands behind the last ends."""
    return F.contains(F.substring_index(text, ends, -1), F.lit(begins))


def page_lines(pages: DataFrame) -> DataFrame:
    """pages, html in place of which lines stand: the trimmed lines that are not empty, in order; none for null. A comment, script or style that does not end hides nothing. U+E000 right after a < is dropped. Time is linear in the page; what that takes is done only where something has no end."""
    kept = [c for c in pages.columns if c != "html"]
    html, text = F.col("html"), F.col("text")
    rows = pages.select(*kept, F.replace(F.coalesce(html, F.lit("")), F.lit(f"<{SHIELD}"), F.lit("<")).alias("html"), F.lower("html").alias("low"))
    endless = _begins_after(html, "<!--", "-->") | _begins_after(F.col("low"), "<script", "</script>") | _begins_after(F.col("low"), "<style", "</style>")
    rows = rows.select(*kept, F.when(endless, _shown(html)).otherwise(F.regexp_replace(html, HIDDEN, " ")).alias("text"))
    plain = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    rows = rows.select(*kept, F.when(_begins_after(text, "<", ">"), _untagged(text)).otherwise(plain).alias("text"))
    return rows.select(*kept, F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\u00a0"))), lambda x: x != "").alias("lines"))


def drop_site_lines(pages: DataFrame, ratio_percent: int = 20, least_pages: int = 3) -> DataFrame:
    """One row per row of pages: page_id, host, n_lines, n_dropped, text.

    A line goes if 100 * pages of the host that hold it > ratio_percent * pages of the host, and
    at least least_pages hold it. A page counts once for a line it repeats, and all its
    repeats go. A line at exactly the ratio stays. A page whose url is null or names no host belongs to no site and stays whole. Null
    html has no lines. Repeated rows are pages of their own. Other columns are not read.
    """
    host = F.lower(F.nullif(F.regexp_extract("url", HOST, 2), F.lit("")))
    lines = staged(pages.sparkSession, page_lines(pages.select("page_id", host.alias("host"), F.col("html").cast("string").alias("html"))), "lines")
    sized = lines.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = lines.where("host is not null").select("host", F.explode(F.array_distinct("lines")).alias("line"))
    held = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= least_pages)
    drop = held.join(sized, "host").where(F.col("holding") * 100 > F.col("pages") * ratio_percent)
    drop = drop.groupBy("host").agg(F.collect_list("line").alias("drop"))
    drop = staged(pages.sparkSession, drop, "drop")
    size = drop.agg(F.sum(F.length(F.concat_ws("", "drop")) * 4 + F.size("drop") * 16 + 64)).first()[0] or 0
    # A small table goes to every task; beyond that the pages are dealt by host, and AQE splits a host with many.
    out = lines.join(F.broadcast(drop) if size <= BROADCAST_BYTES else drop, "host", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<string>")))
    out = out.withColumn("rest", F.filter("lines", lambda x: ~F.array_contains("drop", x)))
    n = F.size("lines").cast("long")
    return out.select("page_id", "host", n.alias("n_lines"), (n - F.size("rest")).alias("n_dropped"), F.array_join("rest", "\n").alias("text"))


def op9_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_site_lines(table(spark, sf_dir, "pages"))


OP9_SQL = f"""
WITH l AS (
  SELECT row_number() OVER () AS page, page_id, lower(nullif(regexp_extract(coalesce(url, ''), '{HOST}', 2), '')) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(html, ''), '<{SHIELD}', '<'), '{HIDDEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(160))), lambda x: x <> '') AS lines
  FROM pages),
sized AS (SELECT host, count(*) AS pages FROM l WHERE host IS NOT NULL GROUP BY host),
held AS (SELECT host, line, count(*) AS holding FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l WHERE host IS NOT NULL) GROUP BY ALL),
gone AS (SELECT host, list(line) AS gone FROM held JOIN sized USING (host) WHERE holding >= 3 AND holding * 100 > pages * 20 GROUP BY host),
rest AS (SELECT l.*, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS rest FROM l LEFT JOIN gone USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(rest) AS n_dropped, coalesce(array_to_string(rest, chr(10)), '') AS text FROM rest
"""
