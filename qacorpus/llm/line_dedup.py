"""Line dedup by site-relative frequency (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Elements that begin and end a line of a web page: a fixed list.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def host(url: Column) -> Column:
    """The lower-case host of a URL; empty where there is none, null for null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def page_lines(html: Column) -> Column:
    """The text of a web page, a line per block: comments, scripts, styles, head and tags go, other text stays."""
    for pattern in ("(?is)<!--.*?-->", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<head\b.*?</head>"):
        html = F.regexp_replace(html, pattern, " ")
    html = F.regexp_replace(html, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    html = F.regexp_replace(html, "<[^>]*>", "")
    return F.trim(F.regexp_replace(html, r"[ \t\r]*\n\s*", "\n"))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def drop_lines(docs: DataFrame, site: str | Column, text: str = "text", ratio: float = 0.05, least: int = 3, copies_once: bool = False) -> DataFrame:
    """docs with the boilerplate lines of each site taken out of the text, and their numbers as n_lines and n_dropped.

    A line is boilerplate on a site if more than `ratio` of the site's rows, and at least `least` rows, contain it,
    compared without the white space at its ends (by a 64-bit hash). Repeats within a row count once; blank lines are
    never boilerplate; lines stay in order and as they are. Rows without a site are one site. A null text stays null
    and has no lines, and counts among its site's rows; a row that loses every line has an empty text. Repeated rows
    count each; with `copies_once` equal texts of a site (by their length and a 64-bit hash) are one row in both counts,
    so that copies of a text don't make its lines boilerplate. Columns n_lines and n_dropped of docs are replaced.

    `least` keeps small sites whole: with 1, every line of a site of fewer than 1 / ratio rows would be boilerplate.

    A site has at most its mean number of lines over `ratio` of such lines, however many rows it has, so one array per
    site carries them; counts are summed before they are shuffled, by site and line. Rows of a site with over a thousandth
    of all rows, of which there are at most 1000, are dealt in turn to parts of about that share, copies, null texts and
    all, and each part gets the site's array: no task has all rows of one site. The only broadcast is that of the names
    of such sites with their parts. Columns of docs with the names of this join, which end in `_of_line_dedup`, are lost.
    """
    site = F.coalesce(F.col(site) if isinstance(site, str) else site, F.lit(""))
    docs = docs.drop("n_lines", "n_dropped")
    lines = F.split(F.col(text), "\n")
    hashes = F.array_distinct(F.transform(F.filter(lines, lambda x: _bare(x) != ""), lambda x: F.xxhash64(_bare(x))))
    rows = docs.select(site.alias("site"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("size"), hashes.alias("lines"))
    if copies_once:  # summed per task before the shuffle; a text's row has only the hashes of its lines
        rows = rows.groupBy("site", "text_hash", "size").agg(F.first("lines").alias("lines"))
    per_line = rows.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("with_line"))
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    often = per_line.filter(F.col("with_line") >= least).join(totals, "site").filter(F.col("with_line") > ratio * F.col("total"))
    by_site = stored(often.groupBy("site").agg(F.collect_set("line").alias("often")), "lines")
    sizes = stored(docs.groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("rows")), "sites")  # rows, copies too
    share = (sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] or 1) / 1000
    names = [f"_{x}_of_line_dedup" for x in ("site", "parts", "part", "often")]
    parts = sizes.filter(F.col("rows") > share).select(F.col("site").alias(names[0]), F.ceil(F.col("rows") / share).cast("int").alias(names[1]))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(names[1], F.lit(1)) - 1)).alias(names[2])
    carried = by_site.select(F.col("site").alias(names[0]), F.col("often").alias(names[3])).join(F.broadcast(parts), names[0], "left").select(names[0], every, names[3])
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce(names[1], F.lit(1))).cast("int")
    joined = docs.drop(*names).withColumn(names[0], site).join(F.broadcast(parts), names[0], "left").withColumn(names[2], part).join(carried, [names[0], names[2]], "left")
    kept = F.when(F.col(names[3]).isNull(), lines).otherwise(F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(names[3], F.xxhash64(_bare(x)))))
    return joined.withColumns(
        {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)), "n_dropped": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)), text: F.array_join(kept, "\n")}
    ).drop(*names)


#: What drop_lines() gives for the pages table, for DuckDB.
PAGES_SQL = rf"""
WITH lined AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g'),
      '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r]*\n\s*', chr(10), 'g')) AS text
  FROM pages
), split AS (SELECT page_id, host, string_split(text, chr(10)) AS lines FROM lined),
per_line AS (
  SELECT host, line, count(*) AS with_line
  FROM (SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))) AS line FROM split) GROUP BY 1, 2
), totals AS (SELECT host, count(*) AS total FROM split GROUP BY 1),
often AS (SELECT host, list(line) AS often FROM per_line JOIN totals USING (host) WHERE with_line >= 3 AND with_line > 0.05 * total GROUP BY 1),
kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(often, []), regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS kept
  FROM split LEFT JOIN often USING (host)
)
SELECT page_id, host, len(lines)::INT AS n_lines, (len(lines) - len(kept))::INT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""
