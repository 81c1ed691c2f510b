"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph earns points for its length and its commas and passes them to
its parent in full, to the grandparent by half and to further ancestors by less. A container's points
are discounted by its link density (characters in links over all characters). The best container is
the article, widened to the ``article`` or ``main`` element that holds it; siblings with a good score
of their own are kept beside it (beside an ``article`` only further ones). A page's only ``article`` (or else ``main``) element is taken however short it
is. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are never part of it.

Text: character references are decoded, white space in a block becomes one blank, blocks are trimmed
and joined by one line feed in page order; nothing else is dropped. Null or blank html gives the empty
text. Broken markup (missing end tags, a cut-off page, stray end tags) is read as browsers do. All work
is iterative, so any depth and length is fine. Rows are kept one for one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import sliced, texts_of

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr img br".split()
)
#: Elements that a start tag of the key closes when they are the innermost of their kind.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}),
}
NEVER = frozenset(
    "head script style noscript template title nav footer aside form button select textarea iframe svg canvas object"
    " embed dialog menu audio video map noframes xmp input math".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Parts of class names and ids that mark what is not the article, and those that mark the article.
STRONG = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising"
    " sponsor sponsored promo cookie cookies consent gdpr comment comments disqus reply replies respond newsletter"
    " subscribe subscription popup modal masthead pager pagination paginator login signup captcha".split()
)
WEAK = frozenset(
    "side widget header banner share sharing social related recommended recommendations notice notification alert"
    " disclaimer copyright legal search toolbar tools rail outbrain taboola teaser toc skip meta bottom top".split()
)
GOOD = frozenset("article body content entry hentry main page post story text blog column".split())
SWITCHES = frozenset("with has no without show hide open wrap wrapper layout theme".split())
EXEMPT = frozenset(["html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_PARAGRAPHS = HEADINGS | {"p", "pre", "li", "td"}
_WHOLE = frozenset(["article", "main"])


def _parts(value: str) -> set[str]:
    return {x.lower() for x in _NAME_PARTS.findall(value)}


def _unwanted(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NEVER:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return tag not in ("html", "body")
    if attributes.get("role", "").lower() in ROLES and tag not in ("html", "body"):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    if not names or tag in ("html", "body", "main"):
        return False
    for name in names.split():
        parts = _parts(name)
        if parts & STRONG and not parts & SWITCHES:
            return True
        if parts & WEAK and not parts & (SWITCHES | GOOD) and tag not in EXEMPT:
            return True
    return False


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for name, double, single, bare, lone in _ATTRIBUTE.findall(raw):
        out.setdefault((name or lone).lower(), html.unescape(double or single or bare))
    return out


class Page:
    """The tree in flat lists (a parent comes before its children) and the texts in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.bad, self.good_name = ["#root"], [-1], [False], [False]
        #: (node, text) or (-1, "") where a block begins or ends.
        self.events: list[tuple[int, str]] = []
        self._open = [0]
        self._read(source)

    def _push(self, tag: str, raw: str) -> None:
        parent = self._open[-1]
        attributes = _attributes(raw) if raw and not raw.isspace() else {}
        bad = self.bad[parent] or _unwanted(tag, attributes)
        if tag == "header" and not bad:  # of a header only the headings of an article count
            bad = not any(self.tags[x] in _WHOLE for x in self._open)
        self.tags.append(tag)
        self.parents.append(parent)
        self.bad.append(bad)
        self.good_name.append(bool(_parts(f"{attributes.get('class', '')} {attributes.get('id', '')}") & GOOD))
        self._open.append(len(self.tags) - 1)

    def _break(self) -> None:
        self.events.append((-1, ""))

    def _pop_to(self, at: int) -> None:
        if any(self.tags[x] not in INLINE for x in self._open[at:]):
            self._break()
        del self._open[at:]

    def _start(self, tag: str, raw: str) -> None:
        tags = self.tags
        if tags[self._open[-1]] == "head" and tag not in IN_HEAD:
            self._pop_to(len(self._open) - 1)
        if tag not in INLINE:
            self._break()
            for at in range(len(self._open) - 1, 0, -1):  # an open paragraph ends at any block
                name = tags[self._open[at]]
                if name == "p":
                    self._pop_to(at)
                    break
                if name not in INLINE:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for at in range(len(self._open) - 1, 0, -1):
                name = tags[self._open[at]]
                if name in stops:
                    break
                if name in ends:
                    self._pop_to(at)
                    if tag in ("td", "th", "li", "option"):
                        break
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.events.append((self._open[-1], " "))
        elif tag not in VOID:
            self._push(tag, raw)

    def _end(self, tag: str) -> None:
        for at in range(len(self._open) - 1, 0, -1):
            name = self.tags[self._open[at]]
            if name == tag:
                self._pop_to(at)
                return
            if tag in INLINE and name not in INLINE:  # inline end tags do not reach over a block
                return
            if tag == "p" and name not in INLINE:
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _MARKUP.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                self.events.append((self._open[-1], html.unescape(source[at:stop])))
            if not found:
                break
            at = found.end()
            slash, tag, raw = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if not tag:
                if found[0].startswith("<![CDATA["):
                    self.events.append((self._open[-1], found[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if slash:
                self._end(tag)
                continue
            closed = raw.endswith("/")
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            self._start(tag, raw)
            if closed and tag in ("svg", "path", "use"):
                self._end(tag)

    # -- scoring ---------------------------------------------------------------------------------

    def text(self) -> str:
        tags, parents, bad = self.tags, self.parents, self.bad
        count = len(tags)
        block, linked = [0] * count, [False] * count
        for node in range(1, count):  # the block that a node's own text belongs to; whether in a link
            up = parents[node]
            block[node] = block[up] if tags[node] in INLINE else node
            linked[node] = linked[up] or tags[node] == "a"
        chars, link_chars, links, commas = [0] * count, [0] * count, [0] * count, [0] * count
        for node, text in self.events:
            if node >= 0 and not bad[node]:
                size = len("".join(text.split()))
                chars[block[node]] += size
                commas[block[node]] += text.count(",") + text.count("，") + text.count("、")
                if linked[node]:
                    link_chars[block[node]] += size
        for node in range(1, count):
            if tags[node] == "a" and not bad[node]:
                links[block[node]] += 1

        points = [0.0] * count
        for node in range(count):
            if block[node] != node or not chars[node]:
                continue
            earned = (1.0 if chars[node] >= 25 else 0.25) + commas[node] + min(chars[node] / 100, 3.0)
            # a paragraph gives to its ancestors; text that stands right in a container counts for it
            up = parents[node] if tags[node] in _PARAGRAPHS else node
            level = 0
            while up >= 0 and level < 6:
                if block[up] == up:
                    points[up] += earned / (1, 2, 6, 9, 12, 15)[level]
                    level += 1
                up = parents[up]
        all_chars, all_links, all_count = chars[:], link_chars[:], links[:]
        for node in range(count - 1, 0, -1):
            if not bad[node]:
                up = parents[node]
                all_chars[up] += all_chars[node]
                all_links[up] += all_links[node]
                all_count[up] += all_count[node]
        density = [all_links[x] / all_chars[x] if all_chars[x] else 0.0 for x in range(count)]
        score = [
            0.0 if bad[x] else (points[x] + (2.0 if points[x] and (tags[x] in _WHOLE or self.good_name[x]) else 0.0)) * (1 - density[x])
            for x in range(count)
        ]
        best = max(range(count), key=lambda x: (score[x], -x))
        if score[best] <= 0:
            best = 0
        top, whole, up = score[best], best, best
        for tag in ("article", "main"):  # the only such element of the page is the article, however short
            only = [x for x in range(1, count) if tags[x] == tag and not bad[x] and all_chars[x]]
            if len(only) == 1 and not self._above(only[0], best):
                whole, top = only[0], score[only[0]]
                up = whole
                break
        while up > 0:
            if tags[up] == "article" or (tags[up] == "main" and tags[whole] != "article"):
                whole = up
                if tags[up] == "article":
                    break
            up = parents[up]

        keep = [False] * count
        keep[whole] = True
        if whole:
            limit = max(10.0, 0.2 * top)
            siblings = [x for x in range(1, count) if parents[x] == parents[whole] and x != whole and not bad[x]]
            before = [x for x in siblings if x < whole]
            for node in siblings:
                is_text = tags[node] == "p" and chars[node] >= 80 and density[node] < 0.25
                title = node in before[-1:] and tags[node] == "h1"
                like = tags[whole] not in _WHOLE or tags[node] == tags[whole]
                if title or (like and (score[node] >= limit or is_text)):
                    keep[node] = True
        for node in range(1, count):
            if keep[parents[node]]:
                keep[node] = True
            if keep[node] and (bad[node] or self._menu(node, whole, all_count, density)):
                keep[node] = False
                bad[node] = True
            if bad[parents[node]]:
                keep[node], bad[node] = False, True
        in_header = [False] * count  # in a header, but not in one of its headings
        for node in range(1, count):
            in_header[node] = (in_header[parents[node]] or tags[node] == "header") and tags[node] not in HEADINGS

        blocks, current = [], []
        for node, text in self.events:
            if node < 0:
                if current:
                    blocks.append(" ".join("".join(current).split()))
                    current = []
            elif keep[node] and not in_header[node]:
                current.append(text)
        if current:
            blocks.append(" ".join("".join(current).split()))
        return "\n".join(filter(None, blocks))

    def _above(self, upper: int, node: int) -> bool:
        while node > upper:
            node = self.parents[node]
        return node == upper

    def _menu(self, node: int, whole: int, links: list[int], density: list[float]) -> bool:
        """A list or box that is nearly all links."""
        return node != whole and self.tags[node] in ("ul", "ol", "div", "section", "table", "dl") and links[node] >= 3 and density[node] >= 0.8


def main_text(source: str | None) -> str:
    return Page(source).text() if source and not source.isspace() else ""


ADDED = (("text", "string"), ("n_chars", "long"))


def extract(df: DataFrame, markup: str = "html") -> DataFrame:
    """All columns of ``df`` except ``markup``, with ``text`` and its length (replacing their like)."""
    kept = [c for c in df.columns if c != markup and c not in dict(ADDED)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{markup}`").alias("__html"))
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in ADDED:
        schema = schema.add(name, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "__html"):
            texts = [main_text(x) for x in texts_of(part, "__html")]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), sizes], schema.names)

    return rows.mapInArrow(run, schema)
