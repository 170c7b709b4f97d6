"""Line deduplication by site-relative frequency, with DataFrame functions only.

For each site, the pages that contain a line are counted and divided by all pages of the site;
lines above a boilerplate ratio are dropped from the site's pages. Only hashes of lines are
shuffled, summed up before the shuffle; the texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, sheltered, spread_join, unsheltered
from textloom.llm.url_filter import host_of

#: Lines on more than this share of a site's pages are boilerplate. The value was set from frequencies
#: measured on ``check_s`` (running text that is only there in copies stands on 0.72 % of a source's
#: pages at most) and holds for pages by host too, where it wasn't fitted;
RATIO = 0.01
#: and on at least so many pages, or on half of them and two where a site has fewer than twice as many.
LEAST_PAGES = 5
#: A site's boilerplate lines are kept in so many lists by hash, of which a line is looked for in one.
SLOTS = 64
BLANKS = " \t\n\x0b\x0c\r"
#: What isn't shown on a page, and where lines of a page end.
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
BREAKS = r"(?i)</?(?:p|div|br|hr|ul|ol|li|dl|dt|dd|h[1-6]|nav|header|footer|main|aside|article|section|title|table|tr|td|th|form|option|pre|blockquote)\b[^>]*>"
TAG = "<[^>]*>"


def page_text(html: Column) -> Column:
    """The lines of a page's text: without comments, scripts and styles, broken at block elements, and without other tags.

    Character references stay as they are. Null html is an empty text.
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAG, "")


def clean_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(key, host, text, n_lines, n_dropped): each page's text without the lines that are boilerplate of its host.

    Null urls and urls without ``://`` have the empty host, which is a site like any other. Null and
    empty html is a page of one empty line, which is never dropped. Repeated rows are pages of their own.
    """
    own = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), page_text(F.col(html)).alias("text"))
    done = drop_boilerplate(own, "host", "text", "key", ratio, least_pages)
    return done.select(F.col("key").alias(key), "host", "text", "n_lines", "n_dropped")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Lines are alike if they agree without the white space around them."""
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def boilerplate_lines(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, line, pages, site_pages) of each boilerplate line, by its hash.

    A site has at most lines-per-page / ratio of them. Blank lines are none.
    """
    own = pages.select(F.col(site).alias("site"), F.col(text).alias("text"))
    filled = F.filter(F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    keys = F.array_distinct(F.transform(filled, lambda x: F.xxhash64(x)))
    counted = own.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 2")
    totals = own.groupBy(F.col("site").alias("_site")).agg(F.count(F.lit(1)).alias("site_pages"))
    joined = counted.join(totals, F.col("site").eqNullSafe(F.col("_site"))).drop("_site")
    least = F.least(F.lit(least_pages), F.greatest(F.lit(2), F.ceil(F.col("site_pages") / 2)))
    return joined.filter((F.col("pages") > F.col("site_pages") * F.lit(ratio)) & (F.col("pages") >= least))


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", key: str = "doc_id", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` without boilerplate lines in ``text``, and with ``n_lines`` and ``n_dropped``.

    Lines end at line feeds and are compared without the white space around them; those that stay
    are joined as they were. A null site is a site of its own. Null texts stay null with no lines;
    a text of boilerplate only becomes empty. A page that repeats a line counts once for it;
    repeated rows are pages of their own. Columns named like the new ones are replaced; all others
    pass through, whatever their names.
    """
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    found = boilerplate_lines(pages, site, text, ratio, least_pages)
    slots = found.groupBy("site", F.pmod("line", F.lit(SLOTS)).alias("slot")).agg(F.collect_list("line").alias("lines"))
    # SLOTS lists a site, empty ones too, so a slot's list is found by its place.
    entries = slots.groupBy("site").agg(F.collect_list(F.struct("slot", "lines")).alias("entries"), F.sum(F.size("lines")).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.flatten(F.transform(F.filter("entries", lambda e: e["slot"] == k), lambda e: e["lines"])))
    lists = cut(entries.select(F.col("site").alias("bad_site"), dense.alias("bad"), "n"))
    n = lists.agg(F.coalesce(F.sum(F.greatest(F.col("n"), F.lit(SLOTS))), F.lit(0))).first()[0]
    packed = sheltered(pages.select(*columns), (text,), site=F.col(site), text=F.col(text), key=F.col(key))
    marked = spread_join(packed, lists.drop("n"), "site", "bad_site", n, F.col("key"), "left")
    keyed = F.transform(lines_of(F.col("text")), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    stays = F.filter(keyed, lambda x: ~F.array_contains(F.element_at(F.col("bad"), (F.pmod(x["key"], F.lit(SLOTS)) + 1).cast("int")), x["key"]))
    kept = F.when(F.col("bad").isNull(), lines_of(F.col("text"))).otherwise(F.transform(stays, lambda x: x["line"]))
    done = marked.withColumn("kept", kept)
    cleaned = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias(text)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines_of(F.col("text")))).cast("long")
    dropped = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines_of(F.col("text"))) - F.size("kept")).cast("long")
    return done.select(*[cleaned if c == text else unsheltered([c])[0] for c in columns], n_lines.alias("n_lines"), dropped.alias("n_dropped"))
