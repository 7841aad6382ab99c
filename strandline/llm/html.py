"""Main text of web pages by two-pass block rules.

First pass: each block is judged by its stop-word density, length and link
density, unless an element around it says that it isn't main text. Second
pass: blocks that the first left open go by article and main where these hold
most of the good text, else take the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Common words of the four languages, elements that break blocks, elements and names that aren't main text.
STOP_WORDS = frozenset(
    "the of and to a in is it that for on with as be by this are was at from or an not have but which you we he his they i "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette ou mais elle "
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("script style noscript template head title svg iframe object canvas audio video math select textarea button".split())
OUTER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTAINERS = OUTER_TAGS | frozenset("article main section div ul ol dl table td figure details blockquote".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer|header|masthead|topbar|comments?|disqus|replies|respond|share\w*|social|related|recommend\w*|pagination|pager|toolbar|widget\w*|copyright|legal|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# These end at the next of their kind, if not before.
OPEN_ENDED = frozenset("p li dt dd tr th option".split())
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, SHORT, NEAR, WEAK = "good", "bad", "short", "near", "weak"


class Block:
    """A block of text: whether an element (or, in named, only a name) around it says that it isn't main text, and whether it is within article or main."""

    __slots__ = ("inner", "linked", "named", "outer", "parts", "text")

    def __init__(self, outer: bool, inner: bool, named: bool):
        self.outer, self.inner, self.named, self.parts, self.linked, self.text = outer, inner, named, [], 0, ""


class Segmenter(HTMLParser):
    """Blocks of text in page order; character references are decoded by the parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # container or named element, outside of the main text, within article or main, outside by name
        self.silent: list[str] = []
        self.links = 0
        self.paragraph: int | None = None  # elements open around the open paragraph
        self.fresh = True

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections such as <![if ...]> are markup, well formed or not."""
        return self.parse_bogus_comment(i, report)

    def end_paragraph(self) -> None:
        if self.paragraph is not None:
            del self.open[self.paragraph :]
            self.paragraph = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == self.silent[-1] and tag not in VOID_TAGS:
                self.silent.append(tag)
            elif tag in ("body", "article", "main"):  # a head that is never closed
                self.silent.clear()
            else:
                return
        if tag in SILENT_TAGS:
            self.silent.append(tag)
            self.fresh = True
            return
        if tag in BLOCK_TAGS:
            self.fresh = True
            if tag != "br":
                self.end_paragraph()
        if tag in OPEN_ENDED and self.open and self.open[-1][0] == tag:
            self.open.pop()
        if tag == "p":
            self.paragraph = len(self.open)
        if tag == "a":
            self.links = 1
        if tag in VOID_TAGS or tag in ("html", "body"):
            return
        said = dict(attrs)
        names = " ".join(filter(None, (said.get("class"), said.get("id"), said.get("role"), said.get("aria-label"))))
        if tag in HEADINGS:  # a heading named header is one of the text
            names = names.lower().replace("header", "")
        out, named = tag in OUTER_TAGS or "hidden" in said, bool(names and OUTER_NAMES.search(names))
        if tag in CONTAINERS or out or named:
            _, outer, inner, by_name = self.open[-1] if self.open else ("", False, False, False)
            main = tag in ("article", "main") and not outer
            self.open.append((tag, outer or out, (inner or main) and not out, by_name or named))
            self.fresh = True
        elif self.open and self.open[-1][0] == tag:  # of its name within a named one: it has an end of its own
            self.open.append((tag, *self.open[-1][1:]))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in VOID_TAGS or tag in ("svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag in BLOCK_TAGS:
            self.fresh = True
        if tag == "a":
            self.links = 0
            if tag in CONTAINERS or tag == "p":
                self.end_paragraph()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                self.fresh = True
                break
            if self.open[i][0] in CONTAINERS and tag not in CONTAINERS:  # a stray end
                break

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.fresh:
            if not data.strip():
                return
            _, outer, inner, named = self.open[-1] if self.open else ("", False, False, False)
            self.blocks.append(Block(outer, inner and not named, named))
            self.fresh = False
        block = self.blocks[-1]
        block.parts.append(data)
        block.linked += len(data) * self.links


def first_pass(block: Block, low: float = 0.15, high: float = 0.3, short: int = 70, long: int = 200) -> str:
    """good, bad, or open (short, near, and weak: few stop words, but within article or main)."""
    if block.outer or block.named:
        return BAD
    density = block.linked / max(1, sum(map(len, block.parts)))
    if density > 0.2:
        return BAD
    if len(block.text) < short:
        return BAD if block.linked else SHORT
    words = WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= high:
        return GOOD if len(block.text) > long else NEAR
    return NEAR if stops >= low else WEAK if block.inner else BAD


def lean(blocks: list[Block], labels: list[str]) -> list[str]:
    """Open blocks but weak ones are good within article and main and bad elsewhere, if these elements hold an open or good block and at least half of the good text."""
    if not any(b.inner and x != BAD for b, x in zip(blocks, labels, strict=True)):
        return labels
    good = [(b.inner, len(b.text)) for b, x in zip(blocks, labels, strict=True) if x == GOOD]
    if 2 * sum(n for inner, n in good if inner) < sum(n for _, n in good):
        return labels
    return [x if x in (GOOD, BAD, WEAK) else GOOD if b.inner else BAD for b, x in zip(blocks, labels, strict=True)]


def second_pass(labels: list[str]) -> list[bool]:
    """Open blocks inherit: good between good ones, bad between bad ones; else only those near good prose are good."""
    n, out = len(labels), []
    before, after, last = [BAD] * n, [BAD] * n, BAD
    for i, x in enumerate(labels):
        before[i] = last
        last = x if x in (GOOD, BAD) else last
    last = BAD
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = labels[i] if labels[i] in (GOOD, BAD) else last
    for i, x in enumerate(labels):
        near = GOOD in (before[i], after[i])
        both = before[i] == after[i] == GOOD
        out.append(x == GOOD or (x == SHORT and both) or (x == WEAK and near) or (x == NEAR and (near or (BAD not in labels and GOOD not in labels))))
    for kind in (NEAR, WEAK, SHORT):  # a page of open blocks only: the best of them are its text
        out = out if any(out) else [x == kind for x in labels]
    return out


def main_text(html: str | None) -> str:
    """The main text of one whole page; empty if it has none."""
    if not html:
        return ""
    page = Segmenter()
    page.feed(html)
    page.close()
    blocks = []
    for b in page.blocks:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
        if b.text:
            blocks.append(b)
    labels = [first_pass(b) for b in blocks]
    if not any(x in (GOOD, NEAR) for x in labels):  # names that leave no prose don't tell what they seem to
        for b in blocks:
            b.inner, b.named = b.inner or b.named, False
        bare = [first_pass(b) for b in blocks]
        labels = bare if GOOD in bare else labels
    keep = second_pass(lean(blocks, labels))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty page, or one without text, has an empty text. Malformed
    markup is read as browsers do, more or less, and very long pages are read
    whole. Null ids and urls stay; repeated rows each get their row; an empty
    table gives none. Other columns, whatever their names, are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select("page_id", "url", "html")
    kind = picked.schema["page_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
