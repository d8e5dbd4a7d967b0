"""Main text of web pages by tree scoring.

Blocks are the runs of text between the bounds of block elements. A block gives points for its length and commas,
discounted by the share of its text inside links: all of them to its parent container, half to the next, then a
sixth, and so on. The container with the most points, again discounted by link density, is the best; if an
`article` or `main` holds it, that is taken; otherwise it is widened to the common ancestor of all containers outside it
that have a quarter of its points, as an article may be spread over wrapped sections. Its blocks are kept, and those of
the sections beside it or beside one of its ancestors that score themselves.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are never part of
the tree; they are known by element, role, or word in class and id. Buttons and labels are text inside a sentence only.
Articles beside the best one are kept from a quarter of its points on, unless their names are of noise; in an article
a list of links is kept between two paragraphs and dropped at the edge. A form that holds ten times what stands
outside, and a paragraph's points at least, is the page itself. A word alone does not drop an `article` or an
element with itemprop articleBody, nor one that the points show to hold the article: most of the page's points where
layouts use the word too (widget, share, ...), for other words ten times what any container outside has, and for
comments only where no container outside has three points. Where words leave nothing scored, they do not count.

Defined results: null, empty or textless html gives the empty string; `<br>` is white space; white space is that of
Unicode; unclosed and misnested elements are closed as browsers do; repeated rows are extracted each for itself;
nulls in other columns are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<close>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<open>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<torn>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article body center dd details div dl figure html main ol section table tbody td tr ul blockquote".split())
_DROPPED = frozenset(
    "annotation annotation-xml aside canvas datalist dialog footer head iframe input map menu nav noembed noframes "
    "noscript object option script search select style svg template textarea title audio video".split()
)
# Controls are text only inside what reads as a sentence.
_CONTROLS = frozenset("button label".split())
_SENTENCES = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
_FORM_POINTS = 4.0  # a paragraph's worth, from which on a form may hold the article
_DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split()
)
_NOISE = frozenset(
    "ad ads adsense alert advert adverts advertisement advertisements advertising advertorial adbox adslot banner breadcrumb "
    "breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disqus footer gdpr legal "
    "login masthead menu modal nav navbar navigation navmenu newsletter notice notification overlay pager pagination "
    "paywall popup promo promotion recommended related respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
# Words that layouts also give to what holds the article; the others name the kinds that are never part of it.
_VAGUE = frozenset(
    "alert dialog legal modal notice notification overlay paywall popup promo promotion share sharing skip social "
    "subscription teaser widget widgets".split()
)
_REPLIES = frozenset("comment comments commentlist disqus respond".split())
_LAYOUT = frozenset("has no with without".split())
_NAME = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
                  "th": ("tr", "table"), "option": ("select",)}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_P_SCOPE = frozenset("table td th button object template caption html".split())
_SHARE = 0.25  # of the most points, from which on a container is a part of the article wherever it stands


def _words(value: str) -> set[str]:
    """Words of noise in a class or id."""
    found = set()
    for part in value.split():
        words = _NAME.findall(_HUMP.sub(" ", part).lower())
        if _NOISE.intersection(words) and not _LAYOUT.intersection(words):
            found.update(_NOISE.intersection(words))
    return found


def _noise(tag: str, rest: str, inside_article: bool) -> bool | set[str]:
    """Whether an element and all in it are no part of the article, or the words by which it seems so."""
    if tag in _DROPPED:
        return True
    if tag == "header" and not inside_article:
        return True
    found, body = {"form"} if tag == "form" else set(), tag == "article"
    if not rest or tag in ("html", "body", "main"):
        return found
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
        if name == "role" and value.lower() in _DROPPED_ROLES:
            return True
        if name == "itemprop":
            body |= "articlebody" in value.lower().split()
        if name in ("class", "id"):
            found |= _words(value)
    return False if body else found


def _sounds(rest: str) -> bool:
    """Whether class or id hold a word of noise."""
    return any(_words(v) for name, *values in _ATTRIBUTE.findall(rest) if name.lower() in ("class", "id") for v in values)


def _classes(rest: str) -> list[str]:
    return sorted(c for name, *values in _ATTRIBUTE.findall(rest) if name.lower() == "class" for v in values for c in v.split())


class _Page:
    """Elements as parallel lists, and the blocks of text under them."""

    def __init__(self, spared: frozenset[int] | None):
        self.spared = spared  # elements that are kept whatever their name; all for None
        self.named: list[tuple[int, set[str]]] = []  # elements with a name of noise, outside of what is dropped
        self.lost = 0.0  # at least the points of all text dropped by name
        self.tag, self.parent, self.rest = ["#root"], [-1], [""]
        self.stack = [0]
        self.skip: list[int] = []  # open elements that are dropped
        self.links = 0
        self.article = 0
        self.text: list[str] = []
        self.linked = 0
        self.controls = 0
        self.pressed = 0
        self.blocks: list[tuple[int, str, float]] = []  # (block element, text, share inside links)

    def flush(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                body = " ".join(words)
                owner = next(n for n in reversed(self.stack) if n == 0 or self.tag[n] in _BLOCK)
                # A block of nothing but controls is none.
                if self.pressed < len(body.replace(" ", "")):
                    self.blocks.append((owner, body, min(1.0, self.linked / len(body))))
            self.text, self.linked, self.pressed = [], 0, 0

    def pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            tag = self.tag[node]
            self.links -= tag == "a"
            self.controls -= tag in _CONTROLS
            self.article -= tag in ("article", "main")
            if self.skip and self.skip[-1] >= node:
                self.skip = [s for s in self.skip if s < node]
        del self.stack[depth:]

    def _close_open(self, names: tuple[str, ...], stops) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in names:
                self.pop_to(depth)
                return
            if tag in stops:
                return

    def open(self, tag: str, rest: str) -> None:
        if tag in _BLOCK:
            if not self.skip:
                self.flush()
            self._close_open(("p",), _P_SCOPE)
            if tag in _CLOSES_ITSELF:
                self._close_open(_SAME.get(tag, (tag,)), _CLOSES_ITSELF[tag])
            elif tag[0] == "h" and tag[1:].isdigit() and self.tag[self.stack[-1]][0] == "h" and self.tag[self.stack[-1]][1:].isdigit():
                self.pop_to(len(self.stack) - 1)
        elif tag == "a" and self.links:
            self._close_open(("a",), _P_SCOPE)
        elif tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.rest.append(rest)
        if not self.skip and (noise := _noise(tag, rest, self.article > 0)):
            if noise is not True:
                self.named.append((node, noise))
            if noise is True or (self.spared is not None and node not in self.spared):
                self.skip.append(node)
        elif tag in _CONTROLS and not self.skip and not self._in_sentence():
            self.skip.append(node)
        self.stack.append(node)
        self.links += tag == "a"
        self.controls += tag in _CONTROLS
        self.article += tag in ("article", "main")

    def _in_sentence(self) -> bool:
        block = next((self.tag[n] for n in reversed(self.stack) if self.tag[n] in _BLOCK), "")
        return block in _SENTENCES

    def close(self, tag: str) -> None:
        if tag in _BLOCK and not self.skip:
            self.flush()
        scoped = tag not in _BLOCK
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tag[self.stack[depth]]
            if open_tag == tag:
                self.pop_to(depth)
                return
            # An inline end tag does not close the block around it, nor a cell's content its table.
            if (scoped and open_tag in _BLOCK) or (open_tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot")):
                return

    def data(self, raw: str) -> None:
        if raw and not self.skip:
            text = _html.unescape(raw) if "&" in raw else raw
            self.text.append(text)
            if self.links:
                self.linked += len(" ".join(text.split()))
            if self.controls:
                self.pressed += len("".join(text.split()))
        elif raw and self.named and self.skip[0] == self.named[-1][0] and not raw.isspace():
            self.lost += raw.count(",") + (0.0 if self.links else 1 + min(len(raw) / 100, 3.0))


def _parse(source: str, spared: frozenset[int] | None = frozenset()) -> _Page:
    page, at = _Page(spared), 0
    while True:
        found = _TOKEN.search(source, at)
        if found is None:
            page.data(source[at:])
            break
        page.data(source[at : found.start()])
        at = found.end()
        tag = found["open"] or found["torn"]
        if tag:
            tag = tag.lower()
            page.open(tag, found["rest"] or "")
            if tag in _RAW:
                end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                page.close(tag)
        elif found["close"]:
            page.close(found["close"].lower())
    page.flush()
    return page


def _worth(text: str, density: float) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - density)


def _most(page: _Page) -> float:
    """The most points that a container has from its own blocks."""
    own: dict[int, float] = {}
    for node, text, density in page.blocks:
        while node > 0 and page.tag[node] not in _CONTAINERS:
            node = page.parent[node]
        own[node] = own.get(node, 0.0) + _worth(text, density)
    return max(own.values(), default=0.0)


def _judged(source: str) -> _Page:
    """The page without what is noise by name, but for elements whose points show that the article is in them."""
    page = _parse(source)
    kept = sum(_worth(text, density) for _, text, density in page.blocks)
    if page.lost <= min(kept, 10 * _most(page)):
        return page
    # Elements have the same numbers whatever is dropped.
    bare = _parse(source, None)
    named = dict(bare.named)
    held, clear = dict.fromkeys([0, *named], 0.0), dict.fromkeys([0, *named], 0.0)
    groups: dict[str, float] = {}
    for owner, text, density in bare.blocks:
        worth, node, holders, words = _worth(text, density), owner, [0], set()
        while node > 0:
            if node in named:
                holders.append(node)
                words |= named[node]
            node = bare.parent[node]
        for node in holders:
            held[node] += worth
        if words <= _VAGUE:
            for node in holders:
                clear[node] += worth
            for word in words:
                groups[word] = groups.get(word, 0.0) + worth

    def outweighs(node: int, left: float) -> bool:
        """Whether an element with the name of a kind that is no article is one beside so few points elsewhere."""
        if "form" in named[node] and held[node] < _FORM_POINTS:
            return False
        return not named[node] <= _VAGUE and left < min(3.0 if named[node] & _REPLIES else held[node], 0.1 * held[node])

    vague = {n for n, words in named.items() if words <= _VAGUE}
    spared: set[int] = set()
    rival = max([_most(page), *(clear[v] for v in vague)])
    if not any(outweighs(n, rival) for n, _ in page.named):
        spared = {n for n in vague if clear[n] > clear[0] / 2}
        if not spared:
            common = {word for word, worth in groups.items() if worth > clear[0] / 2}
            spared = {n for n in vague if named[n] & common}
        if spared:
            page = _parse(source, frozenset(spared))
    while True:
        left, dropped = _most(page), {n for n, _ in page.named if n not in spared}
        more = {n for n in dropped if outweighs(n, left)}
        if left == 0:
            most = max((held[n] for n in more), default=0.0)
            more = {n for n in dropped & vague if 0 < held[n] >= most} or more
        if not more:
            return page
        more = {n for n in more if held[n] >= _SHARE * max(held[m] for m in more)}
        # What holds nearly all of a spared element is spared with it.
        for node in named:
            outer = bare.parent[node]
            while outer > 0 and outer not in more:
                outer = bare.parent[outer]
            if outer > 0 and held[node] > 0.9 * held[outer]:
                spared.add(node)
        spared |= more
        page = _parse(source, frozenset(spared))


def main_text(source: str | None) -> str:
    """The blocks of the article, one a line."""
    if not source:
        return ""
    page = _judged(source)
    if not page.blocks:
        return ""
    points: dict[int, float] = {}
    chars: dict[int, int] = {}
    linked: dict[int, float] = {}

    for owner, text, density in page.blocks:
        worth = _worth(text, density)
        node = owner
        while node > 0 and page.tag[node] not in _CONTAINERS:
            node = page.parent[node]
        share, level = 1.0, 0
        while node > 0:
            if page.tag[node] in _CONTAINERS:
                points[node] = points.get(node, 0.0) + worth * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
            node = page.parent[node]
        node = owner
        while node > 0:
            chars[node] = chars.get(node, 0) + len(text)
            linked[node] = linked.get(node, 0.0) + len(text) * density
            node = page.parent[node]

    def score(node: int) -> float:
        return points.get(node, 0.0) * (1 - linked[node] / chars[node]) if chars.get(node) else 0.0

    if not points:
        return "\n".join(text for _, text, density in page.blocks if density < 0.5)
    best = max(points, key=lambda n: (score(n), -n))
    least, core, held = score(best), best, False
    node = best
    while node > 0:
        if page.tag[node] in ("article", "main"):
            best, held = node, True
            if page.tag[node] == "article":
                break
        node = page.parent[node]

    def path(node: int) -> list[int]:
        nodes = []
        while node > 0:
            nodes.append(node)
            node = page.parent[node]
        return nodes

    # Parents have smaller numbers, so the common ancestor is reached by climbing from the larger one.
    core = best if held else core
    above = set(path(core))
    if not held:
        for node in points:
            if node not in above and linked[node] < 0.25 * chars[node] and score(node) >= _SHARE * least:
                while node != best:
                    if node > best:
                        node = page.parent[node]
                    else:
                        best = page.parent[best]
    around = {0, *path(best)[1:]} if best else set()
    # The most points of any container in a section: wrappers have less than what they wrap.
    peak: dict[int, float] = {}
    for node in points:
        worth = score(node)
        while node > 0 and peak.get(node, -1.0) < worth:
            peak[node] = worth
            node = page.parent[node]
    whole = held or best == 0 or page.tag[best] == "body"
    bound = max(2.0, 0.05 * least)
    peers = {page.parent[node]: node for node in path(best)}

    def belongs(node: int) -> bool:
        """Whether a section beside the best container or an ancestor of it is article too."""
        if not chars.get(node):
            return False
        dense = linked[node] / chars[node]
        if held and page.tag[best] == page.tag[node] == "article" and page.parent[node] == page.parent[best]:
            # One page may be several articles; comments and teasers are marked up as such too.
            return dense < 0.25 and not _sounds(page.rest[node]) and peak.get(node, 0.0) >= _SHARE * peak[best]
        if whole:
            return False
        if page.tag[node] in ("h1", "h2", "h3"):
            return dense < 0.5
        if page.tag[node] == "p":
            return dense < 0.25
        peer = peers[page.parent[node]]
        alike = page.tag[node] == page.tag[peer] and _classes(page.rest[node]) == _classes(page.rest[peer]) != []
        return dense < 0.25 and (alike or peak.get(node, 0.0) >= bound)

    # Articles inside the best container that are comments or teasers by name or links, if there is text beside them.
    minor = {
        n for n in chars if held and page.tag[n] == "article" and n > best and best in path(n)
        and (linked[n] >= 0.25 * chars[n] or _sounds(page.rest[n]))
    }
    if minor:
        beside = sum(_worth(t, d) for owner, t, d in page.blocks if best in (up := path(owner)) and minor.isdisjoint(up))
        minor = minor if beside >= 3.0 else set()

    chosen: dict[int, bool] = {}
    kept: list[str | None] = []
    waiting: dict[int, str] | None = None  # lists of links since a paragraph of the article; None before the first
    for owner, text, density in page.blocks:
        top, menu, links = owner, False, False
        while top > 0 and top != best and top not in around and page.parent[top] not in around:
            # A list of nothing but links is a menu wherever it stands, and so is a section of links outside the core.
            menu |= page.tag[top] in ("ul", "ol") and linked[top] >= 0.9 * chars[top] and linked[top] > 0
            menu |= top in minor
            links = top not in above and (links or (page.tag[top] in _CONTAINERS and linked[top] >= 0.5 * chars[top]))
            top = page.parent[top]
        if top == best:
            under = not links or core == best
        elif top in around:
            under = not whole and density < 0.25 and _worth(text, density) >= bound
        else:
            menu |= page.tag[top] in ("ul", "ol") and linked[top] >= 0.9 * chars[top] and linked[top] > 0
            if top not in chosen:
                chosen[top] = belongs(top)
            under = chosen[top]
        if under and not menu:
            if top == best and density < 0.25 and _worth(text, density) >= 2:
                # A list of links between two paragraphs is a part of the text; one at the edge is a menu.
                for place, line in (waiting or {}).items():
                    kept[place] = line
                waiting = {}
            kept.append(text)
        elif under and menu and held and top == best and waiting is not None and (not minor or minor.isdisjoint(path(owner))):
            waiting[len(kept)] = text
            kept.append(None)
    return "\n".join(text for text in kept if text is not None)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(source) for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_run, schema)
