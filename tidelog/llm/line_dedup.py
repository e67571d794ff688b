"""Site-relative line dedup. DataFrame functions only.

Pages are cut into lines at block tags and line ends. Per host, the pages that hold a line are divided by the host's
pages; lines over `ratio` are boilerplate and go from every page of the host. A page passes each line on once, as a
64-bit hash, and counts are combined before the shuffle, so a hot host or line doesn't gather in one task. A host has at
most (its mean lines a page) / ratio boilerplate lines; the pages meet them by a broadcast where all of them are few, by
a join that Spark may split where they aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_ROWS, Scratch

BLOCK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|nav|h[1-6]|header|footer|article|section|aside|main|table|tr|td|th|title|head|body|html|blockquote|pre|form)(?:[ \t\n\r/][^>]*)?>"
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    """Trimmed lines of the visible text; empty ones are left out."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    plain = F.regexp_replace(F.regexp_replace(shown, BLOCK, "\n"), "<[^>]*>", "")
    # White space at either end of a line goes with the line end, so that split leaves trimmed lines.
    return F.filter(F.split(F.regexp_replace(plain, "[ \\t\\r]*\\n[ \\t\\r\\n]*", "\n"), "\n"), lambda x: F.trim(x) != "")


def boilerplate(lines: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """(host, line): hashes of lines over the ratio, of lines (host, hashes: each page's distinct ones)."""
    pages = lines.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    held = lines.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return held.join(pages, "host").filter(F.col("n") > ratio * F.col("pages")).select("host", "line")


def line_dedup(pages: DataFrame, ratio: float = 0.5, least_pages: int = 3) -> DataFrame:
    """(page_id, host, n_lines, n_removed, text), one row for each row of pages; text: the lines left, joined by line ends.

    Null url: the host is empty, one site like any other. Null or empty html: no lines, empty text. Hosts of fewer than
    least_pages pages lose nothing: a ratio over one or two pages says nothing. Repeated rows count as pages. A line at
    the ratio exactly stays. Only page_id, url and html are read.
    """
    scratch = Scratch(pages.sparkSession)
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    hashed = scratch.save(cut.select("host", F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x))).alias("hashes")), "hashes")
    found = scratch.save(boilerplate(hashed, ratio, least_pages), "boilerplate")
    few = found.count() <= BROADCAST_ROWS
    by_host = found.groupBy("host").agg(F.collect_set("line").alias("drop"))
    out = cut.join(F.broadcast(by_host) if few else by_host, "host", "left")
    left = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x))))
    kept = out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), left.alias("left"))
    return kept.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_removed"), F.array_join("left", "\n").alias("text"))


#: Written on its own: tags are told apart by name, not by the patterns above.
ORACLE = r"""
with u as (select page_id, regexp_replace(case when regexp_matches(coalesce(url, ''), '^[a-zA-Z][^:/]*://') then lower(url[instr(url, '://') + 3:]) else '' end, '[/?#].*$', '') as host, coalesce(html, '') as html from pages),
v as (select page_id, host, regexp_replace(regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->', chr(10), 'g'), '<style[\s\S]*?</style>', chr(10), 'gi'), '<script[\s\S]*?</script>', chr(10), 'gi') as html from u),
g as (select page_id, host, html, list_distinct(regexp_extract_all(html, '<[^>]*>')) as tags from v),
b as (select page_id, host, html, list_filter(tags, lambda x: lower(regexp_extract(x, '^</?([a-zA-Z0-9]*)', 1)) in ('p', 'div', 'br', 'hr', 'li', 'ul', 'ol', 'nav', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'header', 'footer', 'article', 'section', 'aside', 'main', 'table', 'tr', 'td', 'th', 'title', 'head', 'body', 'html', 'blockquote', 'pre', 'form')) as blocks from g),
s as (select page_id, host, list_reduce(list_prepend(html, blocks), lambda acc, x: replace(acc, x, chr(10))) as html from b),
t as (select page_id, host, list_transform(string_split(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) as shown from s),
c as (select page_id, host, list_filter(shown, lambda x: x <> '') as lines from t),
p as (select host, count(*) as pages from c group by host having count(*) >= 3),
e as (select host, unnest(list_distinct(lines)) as line from c),
m as (select host, line from e group by host, line having count(*) > 1),
n as (select e.host, e.line, count(*) as n from e join m using (host, line) group by all),
d as (select host, list(line) as gone from n join p using (host) where n > 0.5 * pages group by host),
o as (select page_id, host, lines, case when gone is null then lines else list_filter(lines, lambda x: not list_contains(gone, x)) end as kept from c left join d using (host))
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_removed, coalesce(array_to_string(kept, chr(10)), '') as text from o
"""
