"""Page table helpers: readable text and links of one page, run inside Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Elements left out, elements that break lines, elements without content.
OMIT = set("script style nav footer aside svg form noscript template head".split())
BLOCK = set(
    "article main p div h1 h2 h3 h4 h5 h6 li section blockquote br hr td th tr ul ol".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# A new element of the key closes an open element of the value.
CLOSES = {tag: {"p"} for tag in BLOCK - {"br", "li", "td", "th", "tr"} | {"nav", "footer", "aside", "form"}}
CLOSES |= {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}}


class _Page(HTMLParser):
    def __init__(self, reachable: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.reachable = reachable
        self.parts: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def _silent(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def _pop(self) -> None:
        tag, silent = self.open.pop()
        if tag in BLOCK and not silent:
            self.parts.append("\n")

    def _close(self, tags: set[str], within: int = 0) -> None:
        for at in range(len(self.open) - 1, within - 1, -1):
            if self.open[at][0] in tags:
                while len(self.open) > at:
                    self._pop()
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._close(CLOSES.get(tag, set()))
        named = dict(reversed(attrs))
        hidden = "hidden" in named or named.get("aria-hidden") == "true"
        linked = named.get("id") in self.reachable
        silent = self._silent() or tag in OMIT or (hidden and not linked)
        if tag in BLOCK and not silent:
            self.parts.append("\n")
        self.open.append((tag, silent))
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("path", "circle", "rect", "use"):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._close({tag})

    def handle_data(self, data: str) -> None:
        if not self._silent():
            self.parts.append(data)


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[str] = []
        self.hrefs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        href = next((value for name, value in attrs if name == "href"), None)
        if href:
            self.hrefs.append(href)
            if tag == "a":
                self.anchors.append(href)


def page_links(html: str) -> _Links:
    found = _Links()
    found.feed(html)
    found.close()
    return found


def page_text(html: str, fragment: str = "") -> str:
    reachable = {a[1:] for a in page_links(html).anchors if a.startswith("#") and len(a) > 1}
    page = _Page(reachable | ({fragment} if fragment else set()))
    page.feed(html)
    page.close()
    while page.open:
        page._pop()
    text = re.sub(r"[\t \u00a0]+", " ", "".join(page.parts))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def absolute(base: str, href: str) -> str | None:
    try:
        url = urlsplit(urljoin(base, href.strip()))
    except ValueError:
        return None
    keep = "%!$&'()*+,-./:;=@[\\]_|~"
    return urlunsplit(
        (url.scheme, url.netloc.lower(), quote(url.path, safe=keep) or "/", quote(url.query, safe=keep + "?{}`"), url.fragment)
    )


@arrow_udf(T.StringType())
def html_to_text(html: pa.Array, fragment: pa.Array) -> pa.Array:
    pairs = zip(html.to_pylist(), fragment.to_pylist())
    return pa.array([None if h is None else page_text(h, f or "") for h, f in pairs], pa.string())


@arrow_udf(T.ArrayType(T.StringType()))
def extract_links(html: pa.Array, base: pa.Array) -> pa.Array:
    """Every href of the page, resolved against the page address, once each."""
    out = []
    for page, address in zip(html.to_pylist(), base.to_pylist()):
        found = [] if page is None else [absolute(address or "", h) for h in page_links(page).hrefs]
        out.append(list(dict.fromkeys(u for u in found if u)))
    return pa.array(out, pa.list_(pa.string()))
