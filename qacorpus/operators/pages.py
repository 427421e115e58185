"""From fetched pages to articles: extraction, language and section checks, links, discovery."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARTICLE, subslug

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Collects the first h1's text and, for each element that a selector (tag, attribute, value) names, the texts
    inside. Nested elements that match are blocks of their own as well."""

    def __init__(self, tag: str, attribute: str | None, value: str | None):
        super().__init__(convert_charrefs=True)
        self.selector = (tag, attribute, value)
        self.path: list[tuple[str, int | None]] = []
        self.blocks: list[list[str]] = []
        self.title: list[str] | None = None
        self.titled = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        name, attribute, value = self.selector
        block = None
        if tag == name and (attribute is None or dict(attrs).get(attribute) == value):
            block = len(self.blocks)
            self.blocks.append([])
        if tag == "h1" and self.title is None:
            self.title = []
        self.path.append((tag, block))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.path) - 1, -1, -1) if self.path[k][0] == tag), None)
        if at is not None:
            del self.path[at:]
        if tag == "h1":
            self.titled = True

    def handle_data(self, data):
        if any(t in ("script", "style") for t, _ in self.path):
            return
        if self.title is not None and not self.titled and any(t == "h1" for t, _ in self.path):
            self.title.append(data)
        text = data.strip()
        if text:
            for _, block in self.path:
                if block is not None:
                    self.blocks[block].append(text)


def read_article(html: str | None, tag: str, attribute: str | None = None, value: str | None = None) -> tuple[str | None, str]:
    reader = _Reader(tag, attribute, value)
    reader.feed(html or "")
    reader.close()
    title = "".join(reader.title).strip() if reader.title is not None else None
    return title, "\n\n".join("\n".join(b) for b in reader.blocks)


def extract_articles(pages: DataFrame, selector: tuple[str, str | None, str | None] = ("div", "data-role", "component-wrapper"), placeholder: str = "(no title)") -> DataFrame:
    """page_id, url, html, title and body: the text of the first h1, and of each selected block a line per text node."""

    def of(batches):
        for batch in batches:
            found = [read_article(h, *selector) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "html": batch["html"], "title": [placeholder if t is None else t for t, _ in found], "body": [b for _, b in found]})

    return pages.select("page_id", "url", "html").mapInPandas(of, "page_id long, url string, html string, title string, body string")


def drop_short_articles(df: DataFrame, min_chars: int = 200) -> DataFrame:
    return df.filter(F.length("body") >= min_chars)


def split_wrong_language(df: DataFrame, marker: str = '"language":"pl-PL"', letters: str = "[ąćęłńóśźżĄĆĘŁŃÓŚŹŻ]") -> tuple[DataFrame, DataFrame]:
    """(kept, reported): pages with the marker in their html, or with one of the letters in title or body, are reported."""
    wrong = F.coalesce(F.contains("html", F.lit(marker)), F.lit(False)) | F.concat_ws(" ", "title", "body").rlike(letters)
    return df.filter(~wrong), df.filter(wrong).select("page_id", "url")


def extract_article_links(pages: DataFrame, pattern: str = ARTICLE) -> DataFrame:
    """page_id, pos and link: distinct targets of `a` elements that are article addresses, in order of appearance."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = F.array_distinct(F.filter(F.transform(hrefs, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))), lambda h: h.rlike(pattern)))
    return pages.select("page_id", F.posexplode(links).alias("pos", "link"))


def extract_path_links(pages: DataFrame, pattern: str, base: str) -> DataFrame:
    """page_id and links: distinct paths in the raw html, sorted, behind a base address."""
    paths = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))))
    return pages.select("page_id", F.transform(paths, lambda p: F.concat(F.lit(base), p)).alias("links"))


def first_category_per_url(df: DataFrame) -> DataFrame:
    """Each url with the first category, in sorted order, that lists it."""
    return df.groupBy("url").agg(F.min("category").alias("category"))


def discover_reachable(edges: DataFrame, seeds: DataFrame, store, rounds: int | None = None) -> DataFrame:
    """(slug, depth) of all that edges (src, dst) lead to from seeds (slug), by rounds of unvisited targets until none is left.

    store(df, name) writes a table to the shared folder and reads it back, so that lineage doesn't grow with rounds.
    With `rounds`, targets that are left after so many fail the call.
    """
    visited = frontier = store(seeds.select("slug").distinct().withColumn("depth", F.lit(0)), "seen")
    for depth in count(1):
        reached = frontier.join(edges, frontier.slug == edges.src).select(F.col("dst").alias("slug")).distinct()
        frontier = store(reached.join(visited, "slug", "left_anti").withColumn("depth", F.lit(depth)), "seen")
        if frontier.isEmpty():
            return visited
        if rounds is not None and depth > rounds:
            raise ValueError(f"more than {rounds} rounds")
        visited = visited.union(frontier)


def assign_section(links: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, unknown, counts) of distinct links by their sub-slug; mapping (subslug, section) is a small table."""
    rows = links.select("url").distinct().withColumn("subslug", subslug(F.col("url"))).join(mapping, "subslug", "left")
    assigned = rows.filter("section is not null")
    return assigned, rows.filter("section is null").drop("section"), assigned.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
