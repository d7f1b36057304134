"""Main text of web pages by composite text density.

Each page is parsed into a DOM once.  What the page's own tags set apart (head, nav,
header, footer, aside, form, script, style and the like) is left out.  So is a block whose
class or id says so in a word of its own (comments, cookie-notice, sidebar and the like),
but not where it holds an article, a main or a first heading without such a name, or, on a page without these,
half of the page's text: wrappers are called after what they wrap.  Every block of the rest gets the composite density

    C/T * log(C/LC * T/LT) / log(ln(C/nLC * LC + LCb/Cb * C + e))

with C characters, T tags, LC characters and LT tags in links, nLC = C - LC, and
LCb, Cb those of the body.  Formatting tags (b, i, span, ...) count as tags, and their
text as that of the block around them.  A block's density sum adds the densities of
its child blocks; sums of article and main elements weigh LANDMARK times as much.
The subtree of the largest sum is the article, and all of it stays; article elements
beside a chosen one are parts of the same text.  The least density on its path to the
body is the threshold: a block outside with at least two child blocks joins the article
if its density and its density sum reach the threshold (not where an article or main
element was chosen).

Defined results: a null or empty html, or one without text, gives the text "" and
n_chars 0; every row of the input gives one row, repeats included; ties go to the
outer block; other columns are not read; unclosed tags and stray end tags are
repaired as browsers do, a head left open included; a page without a body tag is its
own body; texts of any length are parsed whole, in time in proportion to their length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bindlattice.llm.common import arrow_map, batch, quoted, read

#: Weight of the density sums of elements that are the article by their tag.
LANDMARK = 32.0
_LANDMARKS = frozenset(("article", "main"))

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: For a tag, the open tags that its start ends, and the tags beyond which it does not look.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
_BARRIER = ("html", "body", "table", "td", "th", "caption")
_OF_P = ("p",), (*_BARRIER, "button")
_THROUGH = frozenset("table tr tbody thead tfoot body html".split())
#: Start tags that leave a head open.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noframes noscript script style template".split())
#: Elements that are no part of an article by their tag; a header inside an article is its own.
_APART = frozenset(
    "head nav footer aside form script style textarea title xmp iframe noembed noframes noscript template button select option datalist svg canvas object embed dialog menu input audio video".split()
)
# Words by which a class or an id sets a block apart, and words that may follow them.
_NAMED = frozenset(
    "comments comment respond replies disqus cookie cookies consent sidebar advert advertisement ad ads banner promo sponsored newsletter subscribe share social related breadcrumb breadcrumbs menu navbar".split()
)
_FOLLOWS = frozenset("section list area box block container wrap wrapper widget banner notice bar unit slot thread form popup modal links nav message".split())
_NAMES = re.compile(r"""\s(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)


def _named_apart(tag: str) -> bool:
    """Whether a class or id of a tag is one of the words, alone or before one that may follow."""
    if "=" not in tag:
        return False
    for names in _NAMES.findall(tag):
        for name in "".join(names).lower().split():
            first, *more = re.split("[-_]", name)
            if first in _NAMED and (not more or len(more) == 1 and (more[0] in _FOLLOWS or more[0].isdigit())):
                return True
    return False


def _tags(source: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of each tag, comment or declaration; the name has a slash for end tags and is empty for the latter two.

    One pass: a quote without a partner further on is an ordinary character, and
    without a closing bracket further on there are no more tags.
    """
    at, last = 0, source.rfind(">")
    ends = {q: source.rfind(q) for q in "\"'"}
    bare = False
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        if source.startswith(("<!--", "<![CDATA["), start):
            mark = "-->" if source[start + 3] == "-" else "]]>"
            end = source.find(mark, start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, ""
            continue
        if start > last:
            return
        if source[start + 1] in "!?":
            at = source.find(">", start) + 1
            yield start, at, ""
            continue
        name = _NAME.match(source, start + 1)
        if name is None:
            at = start + 1
            continue
        spot = name.end()
        while not bare:
            stop = _STOP.search(source, spot)
            if stop is None:
                bare = True
            elif stop.group() == ">":
                spot = stop.end()
                break
            else:
                spot = stop.end() if ends[stop.group()] == stop.start() else source.index(stop.group(), stop.end()) + 1
        at = source.find(">", name.end()) + 1 if bare else spot
        yield start, at, name.group().lower()


class _Page:
    """Blocks in page order: parent, tag, and counts of characters and tags, all and in links."""

    def __init__(self) -> None:
        self.parent, self.tag, self.chars, self.tags, self.link_chars, self.link_tags, self.pieces = [-1], ["#root"], [0], [0], [0], [0], []
        self.named: list[int] = []

    def add(self, parent: int, tag: str, in_link: bool, named: bool) -> int:
        if named:
            self.named.append(len(self.tag))
        self.parent.append(parent), self.tag.append(tag), self.chars.append(0), self.tags.append(0)
        self.link_chars.append(0), self.link_tags.append(0)
        self.count(parent, in_link)
        return len(self.tag) - 1

    def count(self, node: int, in_link: bool) -> None:
        self.tags[node] += 1
        self.link_tags[node] += in_link


class _Open:
    """The stack of open elements: block (-1 where left out), tag, in a link, in an article."""

    def __init__(self, page: _Page) -> None:
        self.page = page
        self.stack: list[tuple[int, str, bool, bool]] = [(0, "#root", False, False)]
        self.at: dict[str, list[int]] = defaultdict(list)

    def push(self, entry: tuple[int, str, bool, bool]) -> None:
        self.at[entry[1]].append(len(self.stack))
        self.stack.append(entry)

    def deepest(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close_to(self, depth: int) -> None:
        broken = False
        for entry in self.stack[depth:]:
            broken = broken or entry[1] not in _INLINE
            self.at[entry[1]].pop()
        if broken:
            self.page.pieces.append((max(self.stack[depth - 1][0], 0), " "))
        del self.stack[depth:]

    def leave_head(self) -> None:
        if self.stack[-1][1] == "head":
            self.close_to(len(self.stack) - 1)


def _parse(source: str) -> _Page:
    page = _Page()
    opened = _Open(page)
    stack, pieces = opened.stack, page.pieces

    def text(chunk: str) -> None:
        if not chunk:
            return
        if not chunk.isspace():
            opened.leave_head()
        node, _, link, _ = stack[-1]
        if node >= 0:
            chunk = entities.unescape(chunk) if "&" in chunk else chunk
            pieces.append((node, chunk))
            n = len("".join(chunk.split()))
            page.chars[node] += n
            if link:
                page.link_chars[node] += n

    at = skip = 0
    raw = None
    for start, end, name in _tags(source):
        if start < skip:
            continue
        text(source[at:start])
        at = end
        if not name:
            continue
        if name[0] == "/":
            tag = name[1:]
            depth = opened.at[tag][-1] if opened.at.get(tag) else 0
            if depth and (tag in _THROUGH or depth >= opened.deepest(_BARRIER)):
                opened.close_to(depth)
            continue
        tag = name
        if tag == "body" and opened.at.get("head"):
            opened.close_to(opened.at["head"][0])
        elif tag not in _IN_HEAD:
            opened.leave_head()
        ends, stops = _ENDS.get(tag) or (_OF_P if tag in _CLOSES_P else ((), ()))
        while ends and (depth := opened.deepest(ends)) > opened.deepest(stops):
            opened.close_to(depth)
        node, _, link, article = stack[-1]
        if tag not in _INLINE:
            pieces.append((max(node, 0), " "))
        if tag in _RAW:
            raw = raw or {t: re.compile(rf"</{t}\b[^>]*>?", re.IGNORECASE) for t in _RAW}
            found = raw[tag].search(source, at)
            at = skip = found.end() if found else len(source)
            continue
        if tag in _APART or tag == "header" and not article:
            node = -1
        if tag in _VOID:
            if node >= 0:
                page.count(node, link)
            continue
        link = link or tag == "a"
        if node >= 0:
            if tag in _INLINE:
                page.count(node, link)
            else:
                node = page.add(node, tag, link, _named_apart(source[start:end]))
        if source[end - 2] != "/" or tag in _LANDMARKS or tag in _CLOSES_P or tag in _INLINE or tag == "body":
            opened.push((node, tag, link, article or tag in _LANDMARKS))
    text(source[at:])
    return page


def _densities(page: _Page) -> tuple[int, list[float], list[float]]:
    """The body, and the density and density sum of each block."""
    parent, n = page.parent, len(page.tag)
    chars, tags, link_chars, link_tags = list(page.chars), list(page.tags), list(page.link_chars), list(page.link_tags)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i]
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    ratio = link_chars[body] / max(chars[body], 1)
    density = [0.0] * n
    for i in range(n):
        if chars[i]:
            c, t, lc, lt = chars[i], tags[i] or 1, link_chars[i] or 1, link_tags[i] or 1
            base = math.log(math.log(c / max(c - link_chars[i], 1) * link_chars[i] + ratio * c + math.e))
            density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(base, 1e-2)
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += density[i] * (LANDMARK if page.tag[parent[i]] in _LANDMARKS else 1.0)
    return body, density, total


def _set_apart(page: _Page) -> list[bool]:
    """Blocks that their names set apart; these count no more."""
    parent, n = page.parent, len(page.tag)
    gone = [False] * n
    if not page.named:
        return gone
    chars, holds = list(page.chars), [tag in _LANDMARKS or tag == "h1" for tag in page.tag]
    for i in page.named:
        holds[i] = False  # a comment may be an article of its own
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
        holds[parent[i]] = holds[parent[i]] or holds[i]
    for i in page.named:
        # Where the page says what its article is, a block without it can be as long as it likes.
        gone[i] = not holds[i] and (holds[0] or 2 * chars[i] < chars[0])
    for i in range(1, n):
        gone[i] = gone[i] or gone[parent[i]]
        if gone[i]:
            page.chars[i] = page.tags[i] = page.link_chars[i] = page.link_tags[i] = 0
    return gone


def _content(page: _Page) -> list[bool]:
    """Which blocks are content."""
    parent, n = page.parent, len(page.tag)
    gone = _set_apart(page)
    body, density, total = _densities(page)
    inside, children = [False] * n, [0] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parent[i]]
    for i in range(n - 1, 0, -1):
        children[parent[i]] += 1
    best = max((i for i in range(n) if inside[i]), key=lambda i: (total[i], -i))
    threshold, i, path = density[best], best, {best}
    while i != body:
        i = parent[i]
        path.add(i)
        threshold = min(threshold, density[i])
    marked, landmark = [False] * n, [False] * n
    for i in range(n):
        landmark[i] = page.tag[i] in _LANDMARKS or i > 0 and landmark[parent[i]]
        beside = page.tag[i] == page.tag[best] == "article" and parent[i] == parent[best]
        marked[i] = i == best or beside or i > 0 and marked[parent[i]]
        if inside[i] and i not in path and not marked[i] and not landmark[best] and children[i] > 1:
            marked[i] = min(density[i], total[i]) >= threshold > 0
    return [m and not g for m, g in zip(marked, gone, strict=True)]


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = _parse(source)
    keep = _content(page)
    return " ".join("".join(t for node, t in page.pieces if t == " " or keep[node]).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(s.as_py()) for s in b.column(2)]
        yield batch(page_id=b.column(0), url=b.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array(list(map(len, texts)), pa.int64()))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))
    return arrow_map(rows, _extract, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))
