"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and pieces of text. A word scores positive and a tag negative, with weights
that are learned from labelled pages: the log odds of the word or the kind of tag inside the main content
against outside, kept above zero for words and below zero for tags. One scan (Kadane's) finds the contiguous
region with the highest sum. Text in elements that are never content (navigation, site headers and footers,
asides, forms, adverts, notices, comments, scripts, styles) scores nothing and is left out of the region. Such an
element is known by its name or by a whole word of its class, id or role. One that holds the largest article or main
element, or one of half its words, is a wrapper and not left out; so is one with more than half of the page's words if
there is no such element, and a form with more than half of the words of the largest.

Labelled pages are those with exactly one article or main element; of pages with such a tag at most FIT_PAGES are
counted. Inside an article, only blocks are left out for their class, and what is left out does not end the region.

Cases: null and empty pages, and pages without words of content, give an empty text; unclosed elements of the
kinds above are ignored but for script and style, which run to the end; character references are decoded once;
repeated rows come back as they stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks

#: At most so many pages are counted for the weights, drawn by a hash of their ids.
FIT_PAGES = 2000
#: A page with more kinds of tags than HTML has is not counted.
PAGE_KINDS = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is not HTML.
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas"}
_ASIDE = {"nav", "aside", "form", "button", "select", "footer", "header", "dialog", "menu", "figure-nav", "label", "head"}
_WORDS_ASIDE = re.compile(
    r"(?:^|\s)(ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|comment|comments|disqus|respond|replies|sidebar|side-bar|menu|navbar|nav|navigation|breadcrumb|breadcrumbs|"
    r"pagination|pager|related|recommended|share|sharing|social|footer|masthead|widget|toolbar|complementary|search|contentinfo)(?:$|\s)",
    re.I,
)
#: Elements that do not end a line of text.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = {"article", "main"}
#: Elements that group others: only these are left out of an article for their class.
_BLOCKS = set("div section ul ol dl table nav aside form figure iframe details".split())

Token = tuple[str, str, bool]  # kind of tag or "", text, whether it lies aside


def tokens(page: str) -> list[Token]:
    """Tags as (kind, "", aside) and texts as ("", text, aside). A kind is "name" or "/name", with "!" if the
    element is aside, "?" if it is so inside an article or main element."""
    found, at = [], 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            found.append(["", page[at : m.start()], ""])
        at = m.end()
        name = (m[2] or "").lower()
        if name:
            found.append([("/" if m[1] else "") + name, "", m[3] or ""])
            if name in _RAW and not m[1] and not (m[3] or "").endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page) if name in ("script", "style") else at
    if at < len(page):
        found.append(["", page[at:], ""])
    # which elements are closed, and where: by a scan from the end, one list of closing tags for each name
    closed, end, waiting = [False] * len(found), [0] * len(found), defaultdict(list)
    for i in range(len(found) - 1, -1, -1):
        kind = found[i][0]
        if kind[:1] == "/":
            waiting[kind[1:]].append(i)
        elif kind and waiting[kind]:
            end[i] = waiting[kind].pop()
            closed[i] = True
    # how many words stand before each token; the article and main elements that are not small beside the largest one
    words = list(accumulate((len(text.split()) if not kind else 0 for kind, text, _ in found), initial=0))
    within = lambda i: words[end[i]] - words[i]
    large = [i for i, (kind, _, _) in enumerate(found) if kind in _CONTENT and closed[i]]
    most = max(map(within, large), default=words[-1])
    large = [i for i in large if 2 * within(i) >= most]
    out: list[Token] = []
    skip, depth, content, mark = "", 0, 0, "!"
    for i, (kind, text, attributes) in enumerate(found):
        name = kind.lstrip("/")
        if skip:
            if name == skip and kind[0] != "/":
                depth += closed[i]
            elif name == skip:
                depth -= 1
            out.append((kind and kind + mark, text, True))
            if depth == 0:
                skip = ""
            continue
        if name in _CONTENT:
            content += -1 if kind[0] == "/" else 1
        if kind and kind[0] != "/" and closed[i] and name not in _VOID and name not in _CONTENT and name not in ("body", "html"):
            # in an article, only blocks are left out: a paragraph, heading or phrase is its text whatever its class
            aside = name in _ASIDE and not (content > 0 and name in ("header", "label"))
            if not aside and attributes and (content <= 0 or name in _BLOCKS):
                aside = any(_WORDS_ASIDE.search(a or b or c) for _, a, b, c in _ATTRIBUTE.findall(attributes))
            # what holds such an article, or most of the words where none tells (a form: everywhere), is a wrapper
            if aside and bisect(large, i) == bisect(large, end[i]) and not ((name == "form" or not large) and 2 * within(i) > most):
                skip, depth, mark = name, 1, "?" if content > 0 else "!"
                out.append((kind + mark, "", True))
                continue
        out.append((kind, text, False))
    return out


def counts(page: str) -> Counter | None:
    """Of a labelled page: how often words ("") and kinds of tags stand inside and outside the content."""
    found = tokens(page)
    opened = [i for i, t in enumerate(found) if t[0] in _CONTENT]
    shut = [i for i, t in enumerate(found) if t[0].startswith("/") and t[0][1:] in _CONTENT]
    if len(opened) != 1 or len(shut) != 1 or shut[0] < opened[0]:
        return None
    out: Counter = Counter()
    for i, (kind, text, _) in enumerate(found):
        if not kind.endswith("?"):
            inside = opened[0] < i < shut[0]
            out[kind, inside] += 1 if kind else len(text.split())
    return out


#: Without labelled pages.
DEFAULT = {"": 1.0}
_LEAST_TAG, _LEAST_WORD, _MOST = -0.02, 0.5, 6.0


def weights(counted: Counter) -> dict[str, float]:
    """Log odds, smoothed by one."""
    totals = [sum(n for (_, at), n in counted.items() if at == side) for side in (False, True)]
    out = dict(DEFAULT)
    if all(totals):
        for kind in {k for k, _ in counted}:
            odds = math.log((counted[kind, True] + 1) / (totals[1] + 2)) - math.log((counted[kind, False] + 1) / (totals[0] + 2))
            odds = max(-_MOST, min(_MOST, odds))
            out[kind] = max(_LEAST_WORD, odds) if kind == "" else min(_LEAST_TAG, odds)
    return out


def unknown(kind: str) -> float:
    """The weight of a kind of tag that no labelled page has. What is left out of an article does not end it."""
    return 0.0 if kind.endswith("?") else -2.0 if kind.endswith("!") else -0.2


def main_text(page: str | None, weight: dict[str, float]) -> str:
    if not page:
        return ""
    found = tokens(page)
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (kind, text, aside) in enumerate(found):
        total += (0.0 if aside else weight[""] * len(text.split())) if not kind else weight[kind] if kind in weight else unknown(kind)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, region = total, (begin, i + 1)
    parts = []
    for kind, text, aside in found[region[0] : region[1]]:
        if kind:
            if kind.strip("/!?") not in _INLINE:
                parts.append(" ")
        elif not aside:
            parts.append(unescape(text))  # a reference ends with its piece of text
    return " ".join("".join(parts).split())


def fit(pages: DataFrame, bound: int = FIT_PAGES) -> dict[str, float]:
    """Weights from at most ``bound`` labelled rows of ``pages(page_id, html)``. The driver gets the counts of each of
    these, with at most PAGE_KINDS kinds of tags for a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(0).to_pylist():
                sums = counts(page or "")
                if sums and len(sums) <= 2 * PAGE_KINDS:
                    out.append([{"kind": k, "inside": i, "n": n} for (k, i), n in sums.items()])
            yield pa.record_batch([pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])))], ["counts"])

    # only pages that look labelled are read for it: in an order of their ids and texts that is the same in every run
    labelled = pages.where(F.lower("html").rlike("<(article|main)[\\s/>]")).select("page_id", "html").orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(bound)
    sums: Counter = Counter()
    for row in labelled.select("html").mapInArrow(run, "counts array<struct<kind: string, inside: boolean, n: long>>").toLocalIterator():
        sums.update({(x["kind"], x["inside"]): x["n"] for x in row["counts"]})
    return weights(sums)


def extract(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages(page_id, url, html)``."""
    rows = pages.select("page_id", "url", "html")
    weight = fit(pages) if weight is None else weight
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, htmls in chunks(batches, "html"):
            texts = [main_text(h, weight) for h in htmls]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
