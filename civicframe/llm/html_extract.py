"""Main-text extraction from HTML.

``html.parser`` events become *lines* (runs of text between block boundaries), each with its text length and the number of
tags seen with it. The text-to-tag ratios are smoothed by a Gaussian kernel and split at a threshold; the lines above it are the clusters that
mark where the content is. They decide thrice. An element that looks like boilerplate by its tag, role, class or id (menus, headers, footers, sidebars, notices, adverts,
forms) is left out unless it wraps the page: most of the clustered text is in it; sidebars, footers, adverts, notices of cookies and comments always are left out. The lowest element that holds the clustered text that is left (but for links in passing), or all text in main or in articles
if most is there, and the h1, is the content region. In it every line is kept, short ones too, but for runs of lines below the threshold that are nothing but links.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pylists, ship, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table "
    "tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements whose text isn't shown as text.
NEVER = frozenset("audio button canvas embed head iframe input math noscript object option script select style svg template textarea title video".split())
#: Elements that hold content seldom: the clusters decide.
SELDOM = frozenset("aside dialog fieldset footer form menu nav".split())
DROP_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROP_HINT = frozenset(
    "ad ads adsense advert advertisement advertising advertorial banner billboard breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "notification outbrain pagination paywall popup promo promotion related reply replies respond responses share sharing sidebar "
    "signup skyscraper social sponsor sponsored subscribe subscription taboola teaser toolbar widget".split()
)
#: Hints that also have other meanings: in a name they only ask for a look at the text.
VAGUE = frozenset(
    "banner billboard discussion disclaimer masthead menu navigation notice notices notification promotion related respond "
    "response responses share sharing social sponsor sponsored subscribe subscription teaser toolbar".split()
)
#: What is never content, however much of the text it holds: by tag, by role, and by a name that says nothing else; the last are also other people's articles.
NEVER_CONTENT = frozenset("aside dialog footer".split())
NEVER_ROLE = frozenset("alert alertdialog complementary contentinfo dialog".split())
NEVER_HINT = frozenset("ad ads adsense advert advertisement advertising advertorial comment comments consent cookie cookies disqus footer gdpr newsletter outbrain pagination paywall replies reply taboola".split())
READERS = frozenset("comment comments replies reply".split())
#: Words that leave a hint what it is, as in ad-slot, and words before a hint that say it of the page, as in with-sidebar.
LAYOUT = frozenset("area bar block bottom box button buttons container content group inner item items left link links list outer panel right row section slot top unit wrap wrapper".split())
ABOUT = frozenset("has hide is no not show with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Hinted text of fewer words is never kept.
FEW = 4
#: Menus, footers and their like of fewer words aren't content, even where there is nothing else.
ENOUGH = 25
#: Lines of links alone, one after the other, that make a menu.
MENU = 3
CONTENT = frozenset(("article", "main"))
#: Elements that may be the region: the walk to the region goes down through these only.
CONTAINER = frozenset("html body main article section div table tbody tr td center".split())
#: A start tag of a block ends an open paragraph; these end an open sibling of their own kind.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What stands against an element: a name that may mean boilerplate, what mostly is, what never is content, and what readers wrote.
MAYBE, MOSTLY, NO, READER = range(4)


def _hint(name: str, inside: bool) -> int | None:
    """Of a class or an id: what it says against its element, or None."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    hints = [w for w in words if w in DROP_HINT or w == "header" and not inside]
    if not hints or words[0] in ABOUT:
        return None
    if any(w not in VAGUE for w in hints) and all(w in hints or w in LAYOUT or w.isdigit() for w in words):
        return READER if READERS & set(hints) else NO if NEVER_HINT & set(hints) else MOSTLY
    return MAYBE


class _Lines(HTMLParser):
    """lines: (text, tags, element, never, characters in links). Elements are numbered in order, 0 is the page; of each its tag, its parent and its standing by tag and names."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.tags, self.parents = [""], [0]
        #: Of each element what stands against it.
        self.against: list[int | None] = [None]
        self.inside = [False]  # within main or an article
        self.stack = [0]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self.content: list[int] = []  # places of main and articles
        self.never = 0  # place of the outermost element that isn't shown
        self.parts: list[str] = []
        self.n_tags, self.linked = 0, 0

    def flush(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.lines.append((text, self.n_tags, self.stack[-1], False, self.linked))
            self.n_tags = 0
        self.parts, self.linked = [], 0

    def standing(self, tag: str, attrs: list[tuple[str, str | None]]) -> int | None:
        inside = bool(self.content)
        if tag in NEVER_CONTENT:
            return NO
        found = [MOSTLY] if tag in SELDOM or tag == "header" and not inside else []
        for k, v in attrs:
            if k in ("class", "id"):
                found += [x for name in (v or "").lower().split() if (x := _hint(name, inside)) is not None]
            elif k == "role" and (v or "").lower() in DROP_ROLE:
                found.append(NO if (v or "").lower() in NEVER_ROLE else MOSTLY)
        worst = max(found, default=None)
        if tag in HEADINGS or tag in ("html", "body", "main") or tag == "article" and worst != READER:
            return None
        return worst

    def pop(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.open[tag].pop()
            if self.content and self.content[-1] == len(self.stack):
                self.content.pop()
            if self.never == len(self.stack):
                self.never = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if tag != "br":
                ends = ("p", *SAME.get(tag, ()))
                while len(self.stack) > 1 and self.tags[self.stack[-1]] in ends:
                    self.pop(len(self.stack) - 1)
        self.n_tags += 1
        if tag in VOID:
            return
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and HIDDEN.search(v or "") for k, v in attrs)
        self.parents.append(self.stack[-1])
        self.tags.append(tag)
        self.against.append(None if self.never else self.standing(tag, attrs))
        self.open[tag].append(len(self.stack))
        if (tag in NEVER or hidden) and not self.never:
            self.never = len(self.stack)
        if tag in CONTENT and self.against[-1] is None:
            self.content.append(len(self.stack))
        self.inside.append(bool(self.content))
        self.stack.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end of a start tag means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.n_tags += 1
        if not self.open[tag]:
            return
        place = self.open[tag][-1]
        if self.content and self.content[-1] > place and tag not in ("body", "html", "main", "article"):
            return  # a stray end tag doesn't close the region around it
        self.pop(place)

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.parts.append(data)
            self.linked += len(data.strip()) * bool(self.open["a"])
        elif data.strip():  # a line of its own, so that what isn't shown within a word doesn't part the word
            self.lines.append((data, self.n_tags, 0, True, 0))


def smoothed(ratios: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with the kernel cut at three sigma and renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-((d / sigma) ** 2) / 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d, k in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= d < len(ratios):
                total += k * ratios[d]
                weight += k
        out.append(total / weight)
    return out


def _clusters(lines: list[tuple]) -> tuple[list[float], list[float], float]:
    """The text-to-tag ratios of the lines, the smoothed ones, and the threshold."""
    ratios = [0.0 if never else len(text) / max(1, n) for text, n, _, never, _ in lines]
    smooth = smoothed(ratios)
    return ratios, smooth, sum(smooth) / len(smooth) / 2


def _sums(parents: list[int], lines: Iterable[tuple[int, tuple[float, ...]]], width: int) -> list[list[float]]:
    """Of each element the sums over the lines in it, from (element, values). A parent's number is lower than its children's."""
    out = [[0.0] * width for _ in parents]
    for n, values in lines:
        own = out[n]
        for k, v in enumerate(values):
            own[k] += v
    for n in range(len(parents) - 1, 0, -1):
        up, own = out[parents[n]], out[n]
        for k in range(width):
            up[k] += own[k]
    return out


def _dropped(p: _Lines, smooth: list[float], threshold: float) -> list[bool]:
    """Of each element whether its text is left out, with that of all it holds.

    Asides, footers, dialogs, adverts, notices of cookies and what readers wrote always go. Forms, menus, headers, sidebars by name and other boilerplate go, too, unless one wraps the page: most of the clustered text is in
    it, that isn't mostly links, and it has the h1, main or an article in it, or else no text but links is clustered outside of it and its like. A name that only may mean boilerplate counts if the text has no
    standing: its smoothed ratio is low (inside an article that doesn't matter), it is mostly links or of a few words.
    """
    count = len(p.tags)
    never, listed = [False] * count, [False] * count
    for n in range(1, count):
        up, against = p.parents[n], p.against[n]
        never[n] = never[up] or against in (NO, READER)
        listed[n] = listed[up] or against is not None
    rows = []
    for (text, _, e, hidden, linked), r in zip(p.lines, smooth, strict=True):
        if not hidden and not never[e]:
            clustered = len(text) * (r >= threshold)
            rows.append((e, (len(text), clustered, linked, len(text.split()), p.inside[e], 0.0, clustered * (not listed[e] and 2 * linked < len(text)))))
    own = [(n, (0, 0, 0, 0, 0, 1, 0)) for n in range(1, count) if not never[n] and (p.tags[n] == "h1" or p.tags[n] in CONTENT and p.against[n] is None)]
    sums = _sums(p.parents, [*rows, *own], 7)
    total, rival = sums[0][1], sums[0][6]
    out = [False] * count
    for n in range(1, count):
        out[n] = out[p.parents[n]] or never[n]
        if out[n] or p.against[n] is None:
            continue
        size, clustered, linked, words, content, marks, _ = sums[n]
        low = 2 * clustered < size and not p.inside[n] or 2 * linked > size or words < FEW
        aside = sums[0][4] > 0 and content == 0
        most = 2 * clustered > total and 2 * linked < size and (words >= ENOUGH or p.tags[n] not in SELDOM)
        if p.against[n] == MAYBE:
            out[n] = (aside or not most) and low
        else:
            out[n] = aside or not most or not (marks or rival == 0)
    return out


def extract(html: str | None) -> tuple[str, int, int]:
    """The main text, the number of lines kept and of all lines. Null and empty pages: ("", 0, 0)."""
    if not html:
        return "", 0, 0
    p = _Lines()
    p.feed(html)
    p.close()
    p.flush()
    if not p.lines:
        return "", 0, 0
    ratios, smooth, threshold = _clusters(p.lines)
    out = _dropped(p, smooth, threshold)
    live = [i for i, x in enumerate(p.lines) if not x[3] and not out[x[2]]]
    if not live:
        return "", 0, len(p.lines)
    title, article, main = [False] * len(p.tags), [False] * len(p.tags), [False] * len(p.tags)
    children: dict[int, list[int]] = defaultdict(list)
    for n in range(1, len(p.tags)):
        up = p.parents[n]
        children[up].append(n)
        title[n], main[n] = title[up] or p.tags[n] == "h1", main[up] or p.tags[n] == "main"
        article[n] = article[up] or p.tags[n] in CONTENT
    rows = []
    for i in live:
        text, _, e, _, linked = p.lines[i]
        clustered = smooth[i] >= threshold
        size = len(text) * clustered
        rows.append((e, (size, clustered and (ratios[i] >= threshold or 2 * linked < len(text)), title[e], size * main[e], size * article[e])))
    sums = _sums(p.parents, rows, 5)
    total, at = sums[0][0], 0
    which = 3 if 2 * sums[0][3] >= total else 4
    while p.tags[at] not in CONTENT:
        inner = max((n for n in children[at] if p.tags[n] in CONTAINER | SELDOM and not out[n]), key=lambda n: sums[n][0], default=None)
        if inner is None or sums[inner][0] < 0.5 * total or sums[at][2] and not sums[inner][2]:
            break
        # what is left behind holds no marked line, or all text of main or articles is inside
        if sums[inner][1] < sums[at][1] and (2 * sums[inner][which] < total or sums[inner][which] < sums[at][which]):
            break
        at = inner
    within = [at == 0] * len(p.tags)
    for n in range(1, len(p.tags)):
        within[n] = n == at or within[p.parents[n]]
    kept = [i for i in live if within[p.lines[i][2]]]
    menu = [ratios[i] < threshold and 10 * p.lines[i][4] >= 9 * len(p.lines[i][0].replace(" ", "")) for i in kept]
    texts, k = [], 0
    while k < len(kept):
        end = k
        while end < len(kept) and menu[end]:
            end += 1
        if end - k < MENU or all(smooth[i] >= threshold for i in kept[k:end]):
            end = max(end, k + 1)
            texts += [p.lines[i][0] for i in kept[k:end]]
        k = end
    return " ".join(texts), len(texts), len(p.lines)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        (html,) = pylists(b, "html")
        texts, kept, lines = zip(*map(extract, html), strict=True)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(kept, pa.int32()), pa.array(lines, pa.int32())],
            names=["page_id", "url", "text", "n_chars", "kept_lines", "all_lines"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, kept_lines, all_lines.

    Null or empty html gives text "" and n_chars 0; null ids and urls pass through; repeated rows stay repeated; other
    columns of ``pages`` are ignored. The work is per row, without a shuffle.
    """
    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long, kept_lines int, all_lines int")
