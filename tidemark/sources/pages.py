"""Extraction from HTML pages: links, titles, tables as rows. Pages are parsed in Arrow batches; what isn't plain, by the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, height_cm, parse_of_pair, reach_cm


class _Tables(HTMLParser):
    """Rows of a page's tables; a nested table is set aside from the cell it stands in. Paragraphs and items in a cell are set off by ' | '."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.tables, self.skip = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.stack.append({"table": self.tables, "row": -1, "cells": None, "cell": None, "header": False})
            self.tables += 1
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self.end_row()
                t["row"] += 1
                t["cells"], t["header"] = [], False
            elif tag in ("td", "th") and t["cells"] is not None:
                self.end_cell()
                t["cell"] = []
                t["header"] |= tag == "th"
            elif tag in ("p", "li", "br") and t["cell"]:
                t["cell"].append(" | ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.stack:
            if tag in ("td", "th"):
                self.end_cell()
            elif tag == "tr":
                self.end_row()
            elif tag == "table":
                self.end_row()
                self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"] is not None and not self.skip:
            self.stack[-1]["cell"].append(data)

    def end_cell(self):
        t = self.stack[-1]
        if t["cell"] is not None:
            parts = [" ".join(x.split()) for x in "".join(t["cell"]).split(" | ")]
            t["cells"].append(" | ".join(x for x in parts if x))
            t["cell"] = None

    def end_row(self):
        self.end_cell()
        t = self.stack[-1]
        if t["cells"]:
            self.rows.append({"table": t["table"], "row": t["row"], "header": t["header"], "cells": t["cells"]})
        t["cells"] = None

    def finish(self):
        while self.stack:
            self.end_row()
            self.stack.pop()


#: A text without markup and the tag after it, as most pages have them: quoted attributes, no entity, comment or closed start tag.
_PLAIN = re.compile(r'([^<&]*)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*)[ \t\r\n]*>')
_CODE = re.compile(r"[^<]*(?:<(?![/!])[^<]*)*</(script|style)>", re.IGNORECASE)
#: Elements whose text the standard library's parser doesn't take as markup, by its version.
_RAW = frozenset(("textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"))


def _plain(html: str, p: _Tables) -> bool:
    """Gives p the tags and texts of a page that has only plain ones; False, with p in any state, where the standard library's parser must decide."""
    at, end = 0, len(html)
    start, close, data = p.handle_starttag, p.handle_endtag, p.handle_data
    while m := _PLAIN.match(html, at):
        text, slash, tag, attrs = m.groups()
        tag, at = tag.lower(), m.end()
        if text:
            data(text)
        if slash:
            if attrs:
                return False
            close(tag)
            continue
        if tag in _RAW:
            return False
        start(tag, ())
        if tag in ("script", "style"):
            code = _CODE.match(html, at)
            if not code or code[1].lower() != tag:
                return False
            at = code.end()
            close(tag)
    rest = html[at:end]
    if "<" in rest or "&" in rest:
        return False
    if rest:
        data(rest)
    return True


def tables(html: str | None) -> list[dict]:
    """The rows of a page's tables. Plain pages are read by one expression, a tag at a time; all others by the standard library's parser."""
    p = _Tables()
    if not _plain(html or "", p):
        p = _Tables()
        p.feed(html or "")
        p.close()
    p.finish()
    return p.rows


_ROWS = {"table": pa.int32(), "row": pa.int32(), "header": pa.bool_(), "cells": pa.list_(pa.string())}


def _parsed(pages: DataFrame, id_col: str, html_col: str, pick: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """(id, table, row, header, cells) of the rows that pick takes of each page."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column("html").to_pylist()):
                found = pick(tables(x))
                at += [i] * len(found)
                rows += found
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *[pa.array([r[c] for r in rows], t) for c, t in _ROWS.items()]], ["id", *_ROWS])

    parsed = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, table int, row int, header boolean, cells array<string>")
    return parsed.withColumnRenamed("id", id_col)


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table, row, header, cells): every row of every table; nested tables count on their own. A null page has none."""
    return _parsed(pages, id_col, html_col, lambda rows: rows)


def first_tables(pages: DataFrame, required: list[str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """tables_with_headers(table_rows(pages), required) for pages with unique ids: each page is parsed once, in one task, and only the rows of its table leave it.

    Pages are told apart as rows, not by their ids: of two with one id each has its table, and a page without an id keeps its rows.
    """
    want = {x.strip(" ").lower() for x in required}

    def pick(rows: list[dict]) -> list[dict]:
        heads: dict[int, set] = {}
        for r in rows:
            if r["header"]:
                heads.setdefault(r["table"], set()).update(c.strip(" ").lower() for c in r["cells"])
        first = min((t for t, names in heads.items() if want <= names), default=None)
        return [r for r in rows if r["table"] == first and not r["header"]]

    return _parsed(pages, id_col, html_col, pick)


def tables_with_headers(rows: DataFrame, required: list[str], id_col: str = "page_id") -> DataFrame:
    """The rows of each page's first table whose header has all required names (trimmed, any case)."""
    want = F.array(*[F.lit(x.strip().lower()) for x in required])
    head = rows.filter("header").groupBy(id_col, "table").agg(F.flatten(F.collect_list("cells")).alias("h"))
    names = F.transform("h", lambda x: F.lower(F.trim(x)))
    first = head.filter(F.size(F.array_except(want, names)) == 0).groupBy(id_col).agg(F.min("table").alias("table"))
    return rows.filter("not header").join(first, [id_col, "table"], "left_semi")


def paired(cell: Column) -> Column:
    """Both values of a cell that holds one for each side, padded to two."""
    return F.slice(F.concat(F.split(cell, r" \| "), F.array(F.lit(""), F.lit(""))), 1, 2)


def labelled(text: Column) -> Column:
    """Lines 'label: value' as a map with lower-case labels; of repeated labels the last counts."""
    pairs = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains(":"))
    entry = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))
    items = F.transform(pairs, entry)
    keys = F.array_distinct(F.transform(items, lambda x: x["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(items, lambda x: x["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(last)


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, href, text) of the links, in JVM expressions."""
    found = F.transform(F.regexp_extract_all(html_col, F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), 1), lambda x: F.struct(F.regexp_extract(x, r'href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " ")).alias("text")))
    return pages.select(id_col, F.explode(found).alias("a")).select(id_col, "a.href", "a.text")


def listed_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(url, name, day) of the table rows that hold a link and a date like 'March 2, 1996': each URL once, from its first page and row. JVM expressions."""
    rows = F.regexp_extract_all(html_col, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    row = pages.select(id_col, F.posexplode(rows).alias("_at", "_row"))
    link = r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    day = F.try_to_date(F.nullif(F.regexp_extract("_row", r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1), F.lit("")), "MMMM d, yyyy")
    found = row.select(id_col, "_at", F.regexp_extract("_row", link, 1).alias("url"), clean_text(F.regexp_replace(F.regexp_extract("_row", link, 2), "<[^>]*>", "")).alias("name"), day.alias("day"))
    first = found.filter((F.col("url") != "") & F.col("day").isNotNull()).groupBy("url").agg(F.min(F.struct(id_col, "_at", "name", "day")).alias("f"))
    return first.select("url", "f.name", "f.day")


def listed_contests(rows: DataFrame, fields: list[str], id_col: str = "page_id") -> DataFrame:
    """(id, table, row, fields): table rows with as many cells as there are fields; header rows and others are left out."""
    kept = rows.filter((F.size("cells") == len(fields)) & ~F.col("header"))
    return kept.select(id_col, "table", "row", *[F.col("cells")[i].alias(f) for i, f in enumerate(fields)])


def stat_sides(contests: DataFrame, names: str, stats: list[str], keys: list[str]) -> DataFrame:
    """(keys, side, name, <stat>_made, <stat>_tried): one row for each side of rows whose cells hold a value for each, 'x of y' or a number."""
    parts = [F.struct(F.lit(i).alias("side"), paired(F.col(names))[i].alias("name"), *[x.alias(f"{s}_{k}") for s in stats for k, x in (("made", parse_of_pair(paired(F.col(s))[i])["made"]), ("tried", parse_of_pair(paired(F.col(s))[i])["tried"]))]) for i in (0, 1)]
    return contests.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*")


def profiles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, height_cm, reach_cm, stance, born) from the labelled items of a page's lists; what is missing or malformed is null."""
    items = F.transform(F.regexp_extract_all(html_col, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1), lambda x: clean_text(F.regexp_replace(x, "<[^>]*>", " ")))
    found = pages.select(id_col, labelled(F.array_join(items, "\n")).alias("f"))
    field = lambda k: F.try_element_at("f", F.lit(k))
    born = F.try_to_date(F.nullif(field("dob"), F.lit("")), "MMM d, yyyy")
    return found.select(id_col, height_cm(field("height")).alias("height_cm"), reach_cm(field("reach")).alias("reach_cm"), F.nullif(field("stance"), F.lit("")).alias("stance"), born.alias("born"))
