"""Scraped pages and JSON envelopes as typed rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions.text import bound
from civicframe.functions.text import ascii_digits, c
from civicframe.session import ship_active

SKIPPED = {"script", "style", "head", "noscript", "template"}
CELLS = {"td", "th"}
#: Elements that end a cell or a row that was left open.
ROWS = {"tr", "table", "tbody", "thead", "tfoot"}
PAGE = "title string, text string, rows array<array<string>>, links array<string>, ids array<string>, dates array<struct<rank: int, value: string>>"
#: Where a page states its date, the surest first: properties and names of meta elements, linked data, time elements.
PUBLISHED, NAMED, ITEM, LINKED, TIMED = range(5)


def _linked_dates(text: str) -> list[str]:
    """The dates of publication in linked data, in the order in which they stand; what isn't JSON has none."""
    try:
        open_ = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    out = []
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            out += [v for k, v in x.items() if k == "datePublished" and isinstance(v, str)]
            open_ += reversed([*x.values()])
        elif isinstance(x, list):
            open_ += reversed(x)
    return out


class _Page(HTMLParser):
    """Collects the first h1, the visible text, the cells of every table row, and the links, in one pass; unclosed cells end with their row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.rows, self.links, self.ids, self.dates = [], [], [], [], []
        self.title, self.cell, self.skip, self.in_title = None, None, 0, False
        self.linked = None  # the parts of a script of linked data

    def _end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def _dated(self, tag: str, attrs: dict[str, str]) -> None:
        value = attrs.get("content" if tag == "meta" else "datetime", "")
        if tag == "meta" and value:
            ranks = [r for r, met in ((PUBLISHED, attrs.get("property", "").lower() == "article:published_time"), (NAMED, "date" in attrs.get("name", "").lower()), (ITEM, attrs.get("itemprop", "").lower() == "datepublished")) if met]
            self.dates += [(r, value) for r in ranks[:1]]
        elif tag == "time" and value:
            self.dates.append((TIMED, value))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("meta", "time", "script"):
            own = {k: v or "" for k, v in attrs}
            self._dated(tag, own)
            if tag == "script" and own.get("type", "").lower() == "application/ld+json":
                self.linked = []
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ROWS:
            self._end_cell()
            if tag == "tr":
                self.rows.append([])
        elif tag in CELLS:
            self._end_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = []
        elif tag == "h1" and self.title is None:
            self.title, self.in_title = [], True
        for name, value in attrs:
            if tag == "a" and name == "href" and value:
                self.links.append(value)
            elif name == "id" and value:
                self.ids.append(value)
        self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.linked is not None:
            self.dates += [(LINKED, d) for d in _linked_dates("".join(self.linked))]
            self.linked = None
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in CELLS or tag in ROWS:
            self._end_cell()
        elif tag == "h1":
            self.in_title = False
        self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        if self.linked is not None:
            self.linked.append(data)
        if self.skip:
            return
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)
        if self.in_title:
            self.title.append(data)


def _read(html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end_cell()
    flat = lambda parts: " ".join("".join(parts or []).split())
    return flat(page.title), flat(page.text), [r for r in page.rows if r], page.links, page.ids, [{"rank": r, "value": v} for r, v in page.dates]


def _pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for htmls in batches:
        yield pd.DataFrame([_read(h) for h in htmls], columns=["title", "text", "rows", "links", "ids", "dates"])


def page(html: str | Column) -> Column:
    """struct(title, text, rows, links, ids, dates) of a page by one pass of parser events: white space is one space, null is an empty page."""
    ship_active()
    return F.pandas_udf(_pages, PAGE)(c(html))


def label_values(parsed: Column, labels: Mapping[str, str]) -> Column:
    """map(field, value) of label and value cells: the first of the two cells after a known label that isn't blank, unless a label comes before it; the first value of a field counts."""
    fields = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    label = lambda v: F.trim(F.regexp_replace(v, ":+$", ""))

    def mapped(cells: Column) -> Column:
        def value(i: Column) -> Column:
            first = F.try_element_at(F.filter(F.slice(cells, i + 2, 2), lambda v: v != ""), F.lit(1))
            return F.when(F.try_element_at(fields, label(first)).isNull(), first)

        found = F.transform(cells, lambda v, i: F.struct(F.try_element_at(fields, label(v)).alias("key"), value(i).alias("value")))
        return F.aggregate(
            F.filter(found, lambda e: e["key"].isNotNull() & e["value"].isNotNull()), F.create_map().cast("map<string,string>"),
            lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, F.create_map(e["key"], e["value"]))),
        )

    return bound(F.flatten(parsed["rows"]), mapped)


def table_rows(parsed: Column, header: list[str], least: int = 1) -> Column:
    """array<map(column, cell)> of a table's rows with as many cells as ``header``; rows whose first ``least`` cells are blank, and the header itself, are left out."""
    names = F.array(*(F.lit(h) for h in header))
    whole = F.filter(parsed["rows"], lambda r: (F.size(r) == len(header)) & (r != names) & F.forall(F.slice(r, 1, least), lambda v: v != ""))
    return F.transform(whole, lambda r: F.map_from_arrays(names, r))


def stated_date(text: str | Column) -> Column:
    """The first date of four, two and two digits of either script, zero-padded, or null."""
    form = r"(\d{4})\s*[/.\-।]\s*(\d{1,2})\s*[/.\-।]\s*(\d{1,2})(?!\d)"
    part = lambda i: F.regexp_extract(ascii_digits(text), form, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


#: Words before a date of publication in a text, and the first year that one may have.
DATED, FIRST_YEAR = ("प्रकाशित", "मिति"), 1990


def published(parsed: Column, last_year: int | Column) -> Column:
    """The date on which a page (``page``) says that it was published, or null: the surest statement first, then a dated line of the text.

    Only plausible years count, to ``last_year``: a year of Bikram Sambat read as a Gregorian one is no date. Digits are ASCII ones, for the same reason.
    """
    plausible = lambda d: F.when(F.year(d).between(F.lit(FIRST_YEAR), F.lit(last_year) if isinstance(last_year, int) else last_year), d)
    day = lambda v: plausible(F.coalesce(F.try_to_date(F.substring(F.trim(v), 1, 10), "yyyy-MM-dd"), F.try_to_date(F.trim(v), "MMMM d, yyyy"), F.try_to_date(F.trim(v), "d MMMM yyyy"), F.try_to_date(F.trim(v), "d/M/yyyy")))
    stated = F.filter(F.transform(F.array_sort(F.transform(parsed["dates"], lambda d, i: F.struct(d["rank"].alias("rank"), i.alias("i"), d["value"].alias("value")))), lambda d: day(d["value"])), lambda d: d.isNotNull())
    line = F.regexp_extract(parsed["text"], rf"(?:{'|'.join(DATED)})[:\s]*([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})(?![0-9])", 1)
    return F.coalesce(F.try_element_at(stated, F.lit(1)), plausible(F.try_to_date(F.translate(line, "/", "-"), "yyyy-M-d")))


def press_release(html: str | Column, files: str = r"\.(pdf|docx?)$") -> Column:
    """struct(title, text, date, files) of a press release; a page without text is still a release."""
    p = page(html)
    return F.struct(p["title"].alias("title"), p["text"].alias("text"), F.coalesce(stated_date(p["text"]), stated_date(p["title"])).alias("date"), F.filter(p["links"], lambda u: F.lower(u).rlike(files)).alias("files"))


def entity_records(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep``, prefix, data (JSON), sources (array of url and authority) and problem of lines of JSON.

    The entity is what ``entity_data`` holds, else the envelope itself without its own keys; the prefix stands in either; a document with an ``@id`` needs none.
    Sources may be objects or bare URLs. A line that isn't an object, or has neither prefix nor ``@id``, has a problem and no data.
    """
    x = F.col(column)
    fields = F.from_json(F.when(F.trim(x).startswith("{"), x), "map<string,string>")
    own = F.nullif(F.try_element_at(fields, F.lit("entity_data")), F.lit("{}"))
    rest = F.to_json(F.map_filter(F.from_json(x, "map<string,variant>"), lambda k, _: ~k.isin("entity_prefix", "sources", "entity_data")))
    data = F.coalesce(own, rest)
    prefix = F.coalesce(F.try_element_at(fields, F.lit("entity_prefix")), F.get_json_object(data, "$.entity_prefix"))
    raw = F.from_json(F.try_element_at(fields, F.lit("sources")), "array<string>")
    source = lambda s: F.struct(F.when(s.startswith("{"), F.get_json_object(s, "$.url")).otherwise(s).alias("url"), F.when(s.startswith("{"), F.get_json_object(s, "$.authority")).alias("authority"))
    bad = F.when(fields.isNull(), "not an object").when(F.nullif(prefix, F.lit("")).isNull() & F.get_json_object(data, "$['@id']").isNull(), "neither prefix nor id")
    return lines.select(
        *keep, F.when(bad.isNull(), prefix).alias("prefix"), F.when(bad.isNull(), data).alias("data"), F.transform(F.coalesce(raw, F.array().cast("array<string>")), source).alias("sources"), bad.alias("problem")
    )
