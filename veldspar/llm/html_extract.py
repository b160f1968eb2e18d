"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each under a path of block-level tags from the root. For every
distinct path the text length and the punctuation of its blocks are added up and divided by the
number of blocks; link text counts against it. The two ratios are smoothed along the page with a small
Gaussian, fused by their product and weighed up inside an article or main element; paths above a share
of the page's mean are content, wherever they lie, and bring in the headings beside them, in an article also
those that stand in an element of their own beside them.

Excluded parts never count: scripts, styles, heads, menus, headers and footers of the page, sidebars,
forms, and elements whose class, id or role names a notice, advert, menu, sidebar or comments.

Reading is one linear scan of the whole html. Unclosed paragraphs and list items end where the next
begins, unclosed pages at their end, and markup that isn't closed is text.

Defined results: null or empty html gives an empty text; ids and urls may be null or repeat, each
input row gives one output row; an empty table gives an empty one; html of any length and depth is read whole;
columns besides html and those kept are free.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: What stands inside a line of text and ends no block.
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style template iframe textarea title noembed noframes".split())
#: Drawings and formulas stand inside a line; of these only their own text counts.
DRAWN = {"svg": re.compile(r"<text\b[^>]*>(.*?)</text\s*>", re.S | re.I), "math": re.compile(r"<(?:mi|mn|mo|ms|mtext)\b[^>]*>(.*?)</", re.S | re.I)}
SKIPPED = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
#: A start tag of the first ends an open one of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
P_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark a part as not content.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice paywall popup promo promoted promotion related replies respond search share sharing shoutbox sidebar signup social sponsor sponsored subscribe subscription toc toolbar widget".split())
#: Of these a class or id holds only, or with one other word; inside an article the last stands for its heading.
WEAK = frozenset("banner footer masthead promo promotion related replies respond search share sharing social toolbar widget header".split())
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"\shidden(?=[\s/>=])", re.I)


@dataclass
class Block:
    path: int
    above: int
    heading: bool
    text: str
    link: int
    article: bool
    over: int = 0


@dataclass
class Open:
    name: str
    skipped: bool
    article: bool
    path: int


def named_boilerplate(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class, id or role is that of a part that is not content."""
    for name in value.split():
        words = [w.lower() for w in SPLIT.split(name) if w]
        for w in words:
            if w in BOILERPLATE and (w not in WEAK or len(words) <= 2 and not (w == "header" and in_article)):
                return True
    return False


def excluded(name: str, tag: str, in_article: bool) -> bool:
    if name in SKIPPED and not (name == "header" and in_article):
        return True
    if "hidden" in tag.lower() and HIDDEN.search(QUOTED.sub('""', tag)):
        return True
    if "=" not in tag or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(tag):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role") and named_boilerplate(value, in_article):
            return True
        if key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value == "true":
            return True
    return False


def label_of(tag: str) -> str:
    for m in ATTRIBUTE.finditer(tag):
        if m[1].lower() == "class":
            return "." + "-".join((m[2] or m[3] or m[4] or "").split())
    return ""


def read(page: str) -> list[Block]:
    """The blocks of text of a page in order, without excluded parts."""
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # of each name, where in the stack it stands
    paths: dict[tuple[int, str], int] = {}  # a path is numbered by the path above it and its last element
    out: list[Block] = []
    words: list[str] = []
    link, in_link, at = 0, 0, 0

    def end_block():
        nonlocal link
        text = SPACE.sub(" ", entities.unescape("".join(words))).strip()
        if text:
            top, above = stack[-1] if stack else None, stack[-2].path if len(stack) > 1 else 0
            out.append(Block(top.path if top else 0, above, top is not None and top.name[:2] in HEADINGS, text, min(link, len(text)), top is not None and top.article, stack[-3].path if len(stack) > 2 else 0))
        words.clear()
        link = 0

    def add(text: str):
        nonlocal link
        if not (stack and stack[-1].skipped):
            words.append(text)
            if in_link:
                link += len(text)

    def close(k: int):
        end_block()
        for o in stack[k:]:
            places[o.name].pop()
        del stack[k:]

    def last(*names: str) -> int | None:
        """Where the innermost open element of these names stands."""
        return max((places[n][-1] for n in names if places.get(n)), default=None)

    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at, tag = m.end(), m[0]
        if tag.startswith("<![CDATA["):
            continue
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name == "a":
                in_link = 0
            elif name not in INLINE:
                k = last(name)
                if k is not None:
                    close(k)
                elif name == "p":
                    end_block()
            continue
        if name in RAW:
            if not tag.endswith("/>"):
                done = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = done.end() if done else len(page) if name in ("script", "style", "title", "textarea") else at
            continue
        if name in DRAWN:
            if not tag.endswith("/>"):
                done = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                add(" ".join(DRAWN[name].findall(page, at, done.start() if done else len(page))))
                at = done.end() if done else len(page)
            continue
        if name in INLINE:
            if name == "br":
                add(" ")
            elif name == "a":
                in_link = 1
            elif name in ("span", "label", "small") and "=" in tag and not tag.endswith("/>") and excluded(name, tag, False):
                done = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = done.end() if done else at
            continue
        end_block()
        in_link = 0
        if name in P_ENDERS:
            k = last("p", "div", "article", "td", "body")
            if k is not None and stack[k].name == "p":
                close(k)
        for ended in ENDS.get(name, ()):
            k = last(ended, "ul", "ol", "dl", "table", "select")
            if k is not None and stack[k].name == ended:
                close(k)
        if name in VOID or tag.endswith("/>"):
            continue
        above = stack[-1] if stack else None
        inside = above is not None and above.article or name in ("article", "main")
        skip = above is not None and above.skipped or excluded(name, tag, above is not None and above.article)
        step = (above.path if above else 0, name + (label_of(tag) if "class" in tag else ""))
        places.setdefault(name, []).append(len(stack))
        stack.append(Open(name, skip, inside, paths.setdefault(step, len(paths) + 1)))
    if at < len(page):
        add(page[at:])
    end_block()
    return out


#: Weight of a path in an article or main element.
ARTICLE = 4


def smooth(values: list[float], radius: int = 1) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * radius * radius)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        part = [(w, values[i + k]) for k, w in zip(range(-radius, radius + 1), weights, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in part) / sum(w for w, _ in part))
    return out


def content(blocks: list[Block], threshold: float = 0.35) -> list[Block]:
    """The blocks under paths whose fused ratio is high, and the headings beside them."""
    if not blocks:
        return []
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    count: dict[int, int] = {}
    for b in blocks:
        length[b.path] = length.get(b.path, 0) + len(b.text) - b.link
        marks[b.path] = marks.get(b.path, 0) + (len(PUNCTUATION.findall(b.text)) if b.link < len(b.text) else 0)
        count[b.path] = count.get(b.path, 0) + 1
    paths = list(length)
    text = dict(zip(paths, smooth([length[p] / count[p] for p in paths]), strict=True))
    mark = dict(zip(paths, smooth([1 + marks[p] / count[p] for p in paths]), strict=True))
    inside = {b.path for b in blocks if b.article}
    fused = {p: text[p] * mark[p] * (length[p] > 0) * (ARTICLE if p in inside else 1) for p in paths}
    mean = sum(fused[b.path] for b in blocks) / len(blocks)
    keep = {p for p in paths if fused[p] > 0 and fused[p] >= min(threshold * mean, max(fused.values()))}
    tops = {b.above for b in blocks if b.path in keep}
    return [b for b in blocks if b.path in keep or b.heading and (b.above in tops or b.article and b.over in tops)]


def main_text(page: str) -> str:
    return "\n\n".join(b.text for b in content(read(page)))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep and ``text``, the page's main text, empty if none."""

    def run(batches):
        enter("html_extract")
        for b in batches:
            texts = [main_text(h or "") for h in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], [*b.schema.names[1:], "text"])

    src = pages.select(F.col(html_col).alias("__html"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{fields}, text string")
