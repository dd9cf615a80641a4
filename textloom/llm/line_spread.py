"""Removal of lines that stand on many sites.

A page's HTML is cut into lines at block tags. A HyperLogLog sketch of the sites is kept for each line hash; sketches
of one line merge by aggregation. Lines whose estimate is near the threshold get an exact distinct count. Lines on
`min_sites` sites or more are boilerplate and go from every page.

Null HTML has no lines and an empty text. A url that is null or has no host belongs to the site ''. A line that a page
or a site repeats counts once for the site, and every copy of it goes. Pages without lines, and repeated rows, are kept.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

MIN_SITES = 8
LOG_K = 12
#: Standard errors of the sketch that count as near.
NEAR = 5
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"


def site(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def lines(html: Column) -> Column:
    """The lines of a page: no scripts, styles or comments; a block tag ends a line; white space is collapsed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"[ \t\r\n\f]+", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCK_TAGS})(?:[ /][^>]*)?>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), " +", " ")
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def spread_lines(pages: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """page_id, site, n_lines, n_removed and text (the kept lines) of every page."""
    keyed = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", site(F.col("url")).alias("site"), lines(F.coalesce("html", F.lit(""))).alias("lines"))
    keyed = storage.materialize(keyed, "page-lines")
    each = keyed.select("row", "site", F.posexplode("lines").alias("pos", "line"))
    hashed = each.select("row", "site", "pos", F.xxhash64(F.trim("line")).alias("hash"))
    # a site's copies of a line are one to its sketch, so they meet before the sketch
    sketches = hashed.groupBy("hash").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
    band = max(1.0, NEAR * min_sites * 1.04 / 2 ** (LOG_K / 2))
    spread = sketches.select("hash", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - band)
    spread = storage.materialize(spread, "line-spread")
    near = spread.where(F.col("sites") <= min_sites + band).select("hash")
    exact = hashed.select("hash", "site").join(near, "hash", "left_semi").groupBy("hash").agg(F.countDistinct("site").alias("sites"))
    boilerplate = spread.where(F.col("sites") > min_sites + band).select("hash").union(exact.where(F.col("sites") >= min_sites).select("hash"))
    removed = hashed.select("row", "pos", "hash").join(boilerplate, "hash").groupBy("row").agg(F.collect_set("pos").alias("removed"))
    every = keyed.join(removed, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda _, i: ~F.array_contains(F.col("removed"), i))
    text = F.array_join(F.transform(kept, lambda x: F.trim(x)), "\n")
    return every.select("page_id", "site", F.size("lines").cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"), text.alias("text"))
