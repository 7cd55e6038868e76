"""Main text of web pages by tree scoring.

A page is read once into a tree of elements and a list of text blocks. Elements that never hold the article (navigation,
footers, scripts, hidden parts) are left out with all they contain. So are forms and anything whose class, id or role names
an advert, menu, notice, comment section and the like, unless such elements hold most of the page's text and no ``article``
or ``main`` outside them has a paragraph: then they wrap the article. An ``article`` that is also called a post, an entry
or the like is never left out. Each remaining block earns one point, one for each comma and one for every
hundred characters; its nearest container gets all of them, the container around that a half, the next a third and so on
up to the eighth container, which gets an eighth (what lies farther out holds the whole page and must not win by depth alone). A
container's points are reduced by the share of its text that lies in links. The best container is the article, together
with siblings that score well for themselves or are real paragraphs. Where it is not itself an ``article`` or ``main``, what
stands beside it in its wrapper belongs to it whatever its tag and length, unless half of its text is links; so do headings,
lists, tables, short paragraphs and well-scoring containers beside the wrappers further out, up to an ``article`` or ``main``.

Blocks are cut at block elements; ``br`` is white space. Lists and sections that are nearly all links are left out.

Nulls: null or empty html gives an empty text. Broken markup is read as far as it goes (open elements end with the page,
an unfinished tag is dropped, unknown references stay as written). Repeated rows stay; an empty table gives an empty result. Pages of
any length are read whole, in time that grows with their length, however many elements are left out or nested. Other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER = frozenset(
    "head script style textarea title noscript iframe noembed noframes template nav footer aside form fieldset button select "
    "option dialog menu svg math canvas object audio video map datalist input label".split()
)
CONTAINERS = frozenset("html body main article section div center td".split())
BLOCKS = frozenset(
    "html body main article section div center td p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th "
    "blockquote pre address figure figcaption header hgroup hr details summary nav footer aside form".split()
)
LISTS = frozenset("ul ol dl table div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in a class, id or role that tell what an element is for.
UNWANTED = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments "
    "complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promos "
    "promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social "
    "sponsor sponsored sponsors subscribe subscription taboola toolbar warning widget widgets".split()
)
WANTED = frozenset("article articlebody content entry main post story text".split())
# Those of them that name sections which may well be longer than the article.
SECTIONS = frozenset(
    "comment comments consent cookie cookies disclaimer discussion disqus gdpr recommended related replies reply respond".split()
)
NOT_ABOUT = frozenset("has no with without".split())

_TOKEN = re.compile(
    r"<(?:!--(?:.*?-->|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|/?[a-zA-Z][^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LINKS_ONLY = 0.7
SIBLING_SHARE = 0.2
PARAGRAPH = 80
MOST, NEARLY_ALL = 1 / 2, 3 / 4  # of the text of a page
REACH = 8  # containers that get points of a block


def _names(text: str) -> list[str]:
    return [w.lower() for w in _NAME_PART.findall(text)]


def _looks(tag: str, attributes: str) -> tuple[bool, frozenset[str], float, bool]:
    """Whether an element is hidden, its unwanted words, the weight of its points, and whether it is a header."""
    weight, header = 2.0 if tag in ("article", "main") else 1.0, tag == "header"
    if not attributes or attributes.isspace():
        return False, frozenset(), weight, header
    words: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            for part in value.split():
                found = _names(part)
                words += [w for before, w in zip(["", *found], found) if before not in NOT_ABOUT]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, frozenset(), weight, header
        elif name == "itemprop" and value.lower() == "articlebody":
            weight *= 2
    wanted = not WANTED.isdisjoint(words)
    if tag in ("html", "body", "main") or (tag == "article" and wanted):
        unwanted = frozenset()
    else:
        unwanted = UNWANTED.intersection(words)
    return False, unwanted, weight * (1.25 if wanted else 1.0), header or ("header" in words and not wanted)


class _Page:
    """Elements in page order (parent, tag, end, weight) and text blocks (element, text, characters inside links)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.end, self.weight = [-1], ["html"], [0], [1.0]
        self.blocks: list[tuple[int, str, int]] = []
        self.pieces: list[tuple[int, list[tuple[str, bool, int]]]] = []  # blocks as read: element, parts
        self.doubted: dict[int, tuple[int, frozenset[str]]] = {}  # left out unless they hold the article: the one around, words
        self.doubts = [-1]
        self.stack, self.open = [0], {"html": 1}
        self.parts: list[tuple[str, bool, int]] = []
        self.skipping = 0  # depth of elements left out
        self._read(source)
        self._break()
        for node in self.stack:
            self.end[node] = len(self.tag)
        self._choose()

    def _block_owner(self) -> int:
        return next(n for n in reversed(self.stack) if self.tag[n] in BLOCKS)

    def _break(self) -> None:
        if self.parts:
            self.pieces.append((self._block_owner(), self.parts))
            self.parts = []

    def _choose(self) -> None:
        """Blocks without those of doubted elements, but for doubted elements that hold most of the text.

        The outermost are judged first, those with the same words together. They stay left out beside an ``article`` or
        ``main`` with a paragraph of text. Sums by group are carried along, so that each element is looked at a few times only.
        """
        kept = self._accepted() if self.doubted else {-1}
        for owner, parts in self.pieces:
            parts = [(p, link) for p, link, doubt in parts if doubt in kept]
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = len(" ".join("".join(p for p, link in parts if link).split()))
                self.blocks.append((owner, text, linked))

    def _accepted(self) -> set[int]:
        """The doubted elements that are kept (and -1 for what lies outside all)."""
        n = len(self.tag)
        own: dict[int, list[tuple[int, int]]] = {d: [] for d in (-1, *self.doubted)}  # element and length of the text directly inside
        inside = dict.fromkeys(own, 0)  # length of all text inside
        for owner, parts in self.pieces:
            for text, link, doubt in parts:
                if not link:
                    own[doubt].append((owner, len(text.strip())))
                    inside[doubt] += len(text.strip())
        children: dict[int, list[int]] = {d: [] for d in own}
        for node, (around, _) in self.doubted.items():
            children[around].append(node)
        for node in reversed(self.doubted):
            inside[self.doubted[node][0]] += inside[node]
        # The outermost article or main around each element, and the number of marks of an article before it.
        landmark, marks = [-1] * n, [0] * (n + 1)
        for node in range(n):
            around = landmark[self.parent[node]] if node else -1
            landmark[node] = around if around >= 0 else node if self.tag[node] in ("article", "main") else -1
            marks[node + 1] = marks[node] + (self.tag[node] in ("article", "main", "h1") and node not in self.doubted)
        accepted: set[int] = set()
        groups: dict[object, list[int]] = {}  # outermost elements still left out, by their words
        sums: dict[object, int] = {}
        largest: list[tuple[int, int, int, object]] = []
        live, in_landmark, found = 0, [0] * n, False

        def accept(nodes: list[int], words: object) -> None:
            nonlocal live, found
            changed, waiting = {}, list(nodes)
            for node in waiting:
                accepted.add(node)
                for owner, size in own[node]:
                    live += size
                    if landmark[owner] >= 0:
                        in_landmark[landmark[owner]] += size
                        found = found or in_landmark[landmark[owner]] >= PARAGRAPH
                for child in children[node]:
                    # The same words again, or nothing else, close around the text.
                    if node >= 0 and (self.doubted[child][1] == words and inside[child] > MOST * inside[node] or inside[child] == inside[node]):
                        waiting.append(child)
                        continue
                    group = self.doubted[child][1] or child
                    groups.setdefault(group, []).append(child)
                    sums[group] = sums.get(group, 0) + inside[child]
                    changed[group] = True
            for group in changed:
                heapq.heappush(largest, (-sums[group], min(groups[group]), len(groups[group]), group))

        accept([-1], None)
        while groups and not found:
            most, _, size, words = heapq.heappop(largest)
            if words not in groups or (-most, size) != (sums[words], len(groups[words])):
                continue  # the group has grown since, or is accepted
            nodes, most = groups[words], -most
            marked = any(marks[self.end[k]] > marks[k] or self.tag[k] == "article" for k in nodes)
            section = isinstance(words, frozenset) and not words.isdisjoint(SECTIONS)
            if not most or live and most <= inside[-1] * (MOST if marked else 1.0 if section else NEARLY_ALL):
                break
            del groups[words], sums[words]
            accept(nodes, words)
        return accepted

    def _text(self, text: str) -> None:
        if text and not self.skipping:
            if "header" in self.open and not any(t in self.open for t in HEADINGS):
                return  # of a header only its headings belong to an article
            self.parts.append((references.unescape(text) if "&" in text else text, "a" in self.open, self.doubts[-1]))

    def _close(self, to: str) -> None:
        """End elements up to the innermost open one of that name."""
        while True:
            node = self.stack.pop()
            tag = self.tag[node]
            if tag in BLOCKS:
                self.stack.append(node)
                self._break()
                self.stack.pop()
            self.end[node] = len(self.tag)
            self.open[tag] -= 1
            if not self.open[tag]:
                del self.open[tag]
            if self.weight[node] < 0:
                self.skipping -= 1
            if self.doubts[-1] == node:
                self.doubts.pop()
            if tag == to:
                return

    def _inside(self, tag: str, bounds: frozenset[str]) -> bool:
        """An open element of that name with none of the bounds within."""
        if tag not in self.open:
            return False
        for node in reversed(self.stack):
            if self.tag[node] == tag:
                return True
            if self.tag[node] in bounds:
                return False
        return False

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._break()
            if "p" in self.open and self._inside("p", CONTAINERS):
                self._close("p")
        for same, bounds in IMPLIED.get(tag, ()):
            if self._inside(same, bounds):
                self._close(same)
        if tag in ("html", "body") and tag in self.open:
            return
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        hidden, words, weight, header = _looks(tag, attributes)
        misplaced = header and not ("article" in self.open or "main" in self.open)
        if hidden or tag in NEVER and tag != "form" or misplaced and tag == "header":
            weight = -1.0
            self.skipping += 1
        elif not self.skipping and (words or misplaced or tag == "form" and "form" not in self.open):
            node = len(self.tag)
            self.doubted[node] = self.doubts[-1], words | {"header"} if misplaced else words
            self.doubts.append(node)
        self.parent.append(self.stack[-1])
        self.stack.append(len(self.tag))
        self.tag.append(tag)
        self.end.append(0)
        self.weight.append(weight)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            token = _TOKEN.search(source, at)
            if token is None:
                self._text(source[at:])
                return
            self._text(source[at : token.start()])
            at, tag = token.end(), token[2]
            if tag is None:
                continue
            tag = tag.lower()
            if token[1]:
                if tag in BLOCKS and tag != "html" and tag != "body":
                    self._break()
                if tag in self.open and tag != "html" and tag != "body":
                    self._close(tag)
            else:
                if tag in RAW:
                    end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else n
                    continue
                self._start(tag, token[3])


IMPLIED = {
    "li": [("li", frozenset({"ul", "ol", "menu"}))],
    "dt": [("dt", frozenset({"dl"})), ("dd", frozenset({"dl"}))],
    "dd": [("dt", frozenset({"dl"})), ("dd", frozenset({"dl"}))],
    "tr": [("tr", frozenset({"table"}))],
    "td": [("td", frozenset({"tr", "table"})), ("th", frozenset({"tr", "table"}))],
    "th": [("td", frozenset({"tr", "table"})), ("th", frozenset({"tr", "table"}))],
    "a": [("a", frozenset({"table"}))],
} | {h: [(other, CONTAINERS) for other in sorted(HEADINGS)] for h in HEADINGS} | {"body": [("head", frozenset())]}


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = _Page(source)
    n, parent, end = len(page.tag), page.parent, page.end
    length, linked, points = [0] * n, [0] * n, [0.0] * n
    for owner, text, links in page.blocks:
        length[owner] += len(text)
        linked[owner] += links
    for node in range(n - 1, 0, -1):
        length[parent[node]] += length[node]
        linked[parent[node]] += linked[node]
    # Lists and sections that are nearly all links are no part of an article.
    menu_end = 0
    menus: list[tuple[int, int]] = []
    for node in range(n):
        if node >= menu_end and page.tag[node] in LISTS and linked[node] > LINKS_ONLY * length[node]:
            menu_end = end[node]
            menus.append((node, menu_end))
    blocks, k = [], 0
    for block in sorted(range(len(page.blocks)), key=lambda b: page.blocks[b][0]):
        owner = page.blocks[block][0]
        while k < len(menus) and menus[k][1] <= owner:
            k += 1
        if not (k < len(menus) and menus[k][0] <= owner):
            blocks.append(block)
    blocks.sort()
    container, outer = [-1] * n, [-1] * n  # the nearest container, the element itself included, and the one around it
    for node in range(n):
        around = container[parent[node]] if node else -1
        container[node], outer[node] = (node, around) if page.tag[node] in CONTAINERS else (around, -1)
    for block in blocks:
        node, text, _ = page.blocks[block]
        earned, node = 1 + text.count(",") + text.count("，") + text.count("、") + len(text) / 100, container[node]
        for share in range(1, REACH + 1):
            if node < 0:
                break
            points[node] += earned / share
            node = outer[node]
    best, most = -1, 0.0
    for node in range(n):
        if points[node]:
            points[node] *= page.weight[node] * (1 - linked[node] / max(1, length[node]))
            if points[node] > most:
                best, most = node, points[node]
    if best < 0:
        return "\n".join(page.blocks[b][1] for b in blocks)
    kept, loose = [False] * n, set()
    kept[best : end[best]] = [True] * (end[best] - best)
    node = best
    while node > 0:
        around, first = parent[node], node == best
        article = page.tag[best] in ("article", "main")
        page_root = page.tag[around] in ("html", "body")
        if not article:
            loose.add(around)  # text that stands directly in the wrapper
        child = around + 1
        while child < end[around]:
            tag, few_links = page.tag[child], 2 * linked[child] <= length[child]
            if child != node and (
                points[child] >= SIBLING_SHARE * most
                or tag == "p" and length[child] >= PARAGRAPH and 4 * linked[child] < length[child]
                or tag in HEADINGS and page.tag[around] in ("article", "main")
                or not article and few_links and (tag not in CONTAINERS or page.tag[around] == "article" or first and not page_root)
            ):
                kept[child : end[child]] = [True] * (end[child] - child)
            child = end[child]
        node = around
        if article or page.tag[node] in ("article", "main"):
            break
    return "\n".join(
        text for owner, text, links in (page.blocks[b] for b in blocks) if kept[owner] or owner in loose and 2 * links <= len(text)
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def work(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
