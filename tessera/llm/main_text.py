"""Main text of web pages by tag-path ratios.

A page is read into blocks, runs of text between block-level tags, each with its root-to-leaf path of
block tags. For every path the text per block and the punctuation per block are aggregated over the whole
page and fused (their product); the blocks' values are smoothed over their neighbours in page order, and a
path's score is the mean over its blocks. Scores are weighted by what markup says of a path beforehand:
the share of its text that is no link, little for paths within navigation, page headers and footers,
asides, forms, hidden parts and elements whose class, id or role says so, and little for paths outside the
page's articles if those hold most of its text. Paths whose score reaches a threshold, a share of
the page's mean score per character, are content, and so are the other paths of an element that content paths fill (``chosen``);
all blocks of those paths, in page order, are the main text. A path's blocks are taken or left together: short paragraphs, linked sentences and further articles
come with their like.

Every page is read by itself: no shuffle; memory of one slice of pages, or one page if larger.

Defined results: null and empty pages, and pages without content, give an empty text; broken markup is
read as browsers do in the common cases (unclosed paragraphs, items, cells; stray end tags); white space
within a block becomes one space, a line break element is white space; repeated rows are read each, extra
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟،؛]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp svg math object canvas audio video select head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul button label caption legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no article text.
APART = frozenset("nav footer aside form button menu dialog fieldset label legend option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids of regions that hold no article text.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs
    footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    recommendations comment comments commentlist disqus respond reply replies feedback pagination pager widget toolbar masthead copyright""".split())
NEGATIONS = frozenset("no has with without hide not".split())
#: What an open element of the first kind ends at, when one of the second begins.
ENDED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
         "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
KEEPS_P = frozenset("button label option body html".split())
#: What is known of a path beforehand: within a region apart, or outside the articles that hold most text.
APART_WEIGHT, OUTSIDE_WEIGHT = 0.02, 0.05
#: Of the page's mean score per character, the share that a content path reaches.
THRESHOLD = 0.1


class Element:
    __slots__ = ("apart", "article", "header", "path", "tag")

    def __init__(self, tag, path, apart, header, article):
        self.tag, self.path, self.apart, self.header, self.article = tag, path, apart, header, article


class Block(NamedTuple):
    path: str
    text: str
    #: Characters within links, and punctuation marks.
    links: int
    marks: int
    apart: bool
    article: bool


def names_region(value: str) -> bool:
    """Whether a class or id names a region apart: its first or last word does, and it is not negated."""
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        if words and words[0] not in NEGATIONS and (words[0] in NAMES or words[-1] in NAMES):
            return True
    return False


def set_apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in APART or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return bool(attributes) and tag == "article" and any(names_region(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes) if m[1] and m[1].lower() in ("class", "id"))
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if names_region(value) or (not in_article and "header" in value.lower().split()):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order. Paths tell regions apart (!) and articles (*) from others."""
    root = Element("", "", False, False, False)
    stack, out = [root], []
    text: list[str] = []
    links, in_link, where = 0, 0, root

    def flush():
        nonlocal links
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                # Of a header only the headings are content.
                apart = where.apart or (where.header and not any(e.tag in HEADINGS for e in stack))
                out.append(Block(where.path + "!" * apart, whole, min(links, len(whole)), len(PUNCTUATION.findall(whole)), apart, where.article))
            text.clear()
        links = 0

    def close(to: int):
        """Pop elements down to the stack's size ``to``."""
        nonlocal where, in_link
        flush()
        for e in stack[to:]:
            if e.tag == "a":
                in_link -= 1
        del stack[to:]
        where = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and (where.apart or not stack[-1].apart):  # inline parts set apart are no text of their block
            piece = page[at:end]
            text.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag in RAW:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCK or any(e.tag in BLOCK for e in stack[k:]):
                        close(k)
                    else:
                        in_link -= sum(e.tag == "a" for e in stack[k:])
                        del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in RAW:
            if m[3].endswith("/") and tag in ("svg", "math", "object"):
                continue
            found = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|<body[\s>]", re.I).search(page, at)
            if tag == "head" and found and found[0][1] != "/":
                at = found.start()
            else:
                at = found.end() if found else (size if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDED:
                ends, stops = ENDED[tag]
                last = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ends:
                        last = k
                if last is not None:
                    close(last)
            if tag not in KEEPS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in ("td", "th", "table", "div", "article", "section"):
                        break
        if tag in VOID:
            continue
        top = stack[-1]
        article = top.article or tag in ("article", "main")
        apart = top.apart or set_apart(tag, m[3], top.article)
        if tag in BLOCK:
            path = f"{where.path}/{tag}{'!' * (apart and not where.apart)}{'*' * (article and not where.article)}"
            where = Element(tag, path, apart, top.header or tag == "header", article)
            stack.append(where)
        else:
            in_link += tag == "a"
            stack.append(Element(tag, top.path, apart, top.header, article))
    flush()
    return out


def smoothed(scores: np.ndarray) -> np.ndarray:
    """Weighted mean with both neighbours on either side."""
    kernel = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    padded = np.pad(scores, 2)
    weight = np.convolve(np.pad(np.ones(len(scores)), 2), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def scores(found: list[Block]) -> tuple[dict[str, float], float]:
    """The weighted score of every path, and the page's threshold."""
    totals: dict[str, list[float]] = {}
    for b in found:
        t = totals.setdefault(b.path, [0.0, 0.0, 0.0, 0.0, 0.0])
        for k, value in enumerate((len(b.text) - b.links, b.marks, 1, len(b.text))):
            t[k] += value
    ratio = {p: t[0] / t[2] * (1 + t[1] / t[2]) for p, t in totals.items()}
    smooth = smoothed(np.array([ratio[b.path] for b in found]))
    sizes = np.array([len(b.text) for b in found])
    for b, value in zip(found, smooth.tolist(), strict=True):
        totals[b.path][4] += value
    own = sum(len(b.text) for b in found if not b.apart)
    articles = 2 * sum(len(b.text) for b in found if b.article and not b.apart) >= own
    out = {}
    for b in found:
        t = totals[b.path]
        prior = APART_WEIGHT if b.apart else OUTSIDE_WEIGHT if articles and not b.article else 1.0
        out[b.path] = t[4] / t[2] * prior * t[0] / t[3]
    return out, THRESHOLD * float(smooth @ sizes) / float(sizes.sum())


def chosen(found: list[Block], score: dict[str, float], threshold: float) -> set[str]:
    """Content paths: those whose score reaches the threshold, and the others of the regions that these fill.

    A region is the element in which blocks of a path lie (not the whole body, unless an article). Where content
    paths have at least half of a region's text, its headings, items and cells belong to it, whatever their score;
    parts set apart and paths that are mostly links do not.
    """
    out = {p for p, v in score.items() if v >= threshold and v > 0}
    size: dict[str, int] = {}
    links: dict[str, int] = {}
    apart = {b.path for b in found if b.apart}
    for b in found:
        size[b.path] = size.get(b.path, 0) + len(b.text)
        links[b.path] = links.get(b.path, 0) + b.links
    own = [p for p in size if p not in apart]
    regions = {p.rsplit("/", 1)[0] for p in out if p not in apart}
    for region in regions:
        if region.rsplit("/", 1)[-1] in ("", "html", "body"):
            continue
        inside = [p for p in own if p.startswith(region + "/")]
        if 2 * sum(size[p] for p in inside if p in out) >= sum(size[p] for p in inside):
            out |= {p for p in inside if 2 * links[p] < size[p]}
    return out


def main_text(page: str | None) -> str:
    """The page's main text."""
    found = blocks(page) if page else []
    if not found:
        return ""
    paths = chosen(found, *scores(found))
    return " ".join(b.text for b in found if b.path in paths)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    def run(batches):
        for part in C.slices(batches, "html"):
            texts = [main_text(t) for t in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
