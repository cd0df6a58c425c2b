"""Main text of web pages by text-to-tag ratios.

The standard library's streaming HTML parser feeds a page's events to a
collector that closes a line of text at every block element and counts the
tags met since the line before. The ratio of characters to tags of each line,
smoothed by a Gaussian, is clustered by a threshold (one standard deviation of
the smoothed ratios): lines above it are content. The content region is the
innermost container that holds most of the content lines' characters (an
``article`` or ``main`` is never left for a part of it), and every line of the
region is returned, short ones too, save those in elements that are
boilerplate: by element name or role; by a class or id of nothing but words
for boilerplate and layout; outside articles by any such word; and inside an
article, where a class has other words, too, by its lines' ratios: lines whose
own or smoothed ratio is below the threshold go, the others are the article's.

Time is linear in a page's length but for closing tags that leave open
elements between: containers know their parent, not their path.

One narrow pass; a page is held by one worker at a time. Defined cases: a null
or empty page, or one without text outside boilerplate, gives an empty text;
malformed mark-up is read as browsers would, as far as the parser does;
repeated pages give repeated rows; other columns are untouched, and a column
named like a result column is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the content lines' characters that the content region holds.
MOST = 0.7
SIGMA = 1.0
# Element names of the HTML standard, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
CONTAINER = frozenset("article body div main section table tbody td tr".split())
DROPPED = frozenset(
    "aside button canvas datalist dialog embed fieldset footer form head iframe input legend menu nav noscript object option "
    "script select style svg template textarea title".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"option", "select", "legend", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
ITEMS = {"li": "ol ul menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial alert author-box banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies copyright disqus feedback footer form gdpr header hidden login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup privacy promo promotion promoted recommended "
    "related replies reply respond response responses share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget".split()
)
#: Words of a class that say nothing of what an element holds.
LAYOUT = frozenset(
    "area bar block bottom box button buttons card cards col column container content entry group grid icon icons inner item items left link links list "
    "main outer panel right row section sm md lg xl slot text title top unit wrap wrapper".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


#: How sure it is that an element is boilerplate.
NO, PERHAPS, YES = 0, 1, 2


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    if tag in DROPPED:
        return YES
    if tag in ("html", "body", "main", "article"):
        return NO
    found = NO
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return YES
        elif name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _SPLIT.split(token) if w}
                if words & BOILERPLATE:
                    if words <= BOILERPLATE | LAYOUT:
                        return YES
                    found = PERHAPS
        elif name == "role":
            if value.lower() in ROLES:
                return YES
        elif (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return YES
    return found


class _Line:
    __slots__ = ("container", "dropped", "ratio", "text")

    def __init__(self, text: str, ratio: float, dropped: int, container: int):
        self.text, self.ratio, self.dropped, self.container = text, ratio, dropped, container


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        #: Open elements that aren't inline: name, whether boilerplate, container.
        self.open: list[tuple[str, int, int]] = [("", NO, 0)]
        self.names: Counter[str] = Counter()  # of the open elements
        #: For each container: the one around it, whether it is an article or main, and whether it is one or in one.
        self.parent, self.whole, self.within = [0], [False], [False]
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                _, dropped, container = self.open[-1]
                self.lines.append(_Line(text, len(text) / max(self.tags, 1), dropped, container))
                self.tags = 0

    def close_to(self, tag: str, within: str = "") -> None:
        """Closes the innermost open tag, unless an element of within is further in."""
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == tag:
                self.flush()
                for gone, *_ in self.open[k:]:
                    self.names[gone] -= 1
                del self.open[k:]
                return
            if name in within.split():
                return

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self.close_to("p", "article aside blockquote body div footer form header main nav section table td")
            if tag in ITEMS:
                self.close_to(tag, ITEMS[tag])
        if tag in VOID:
            return
        around, dropped, container = self.open[-1]
        own = _boilerplate(tag, attrs)
        if own == PERHAPS and not self.within[container]:
            own = YES
        if tag in BLOCK or own:
            if tag == "header":  # an article's own header holds its title
                own = YES
            if dropped and tag in HEADING and around == "header" and self.within[container]:
                dropped = NO
            if tag in CONTAINER:
                self.parent.append(container)
                self.whole.append(tag in ("article", "main"))
                self.within.append(self.whole[-1] or self.within[container])
                container = len(self.parent) - 1
            if own and tag not in BLOCK:
                self.flush()
            self.open.append((tag, max(dropped, own), container))
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        self.close_to(tag)

    def handle_data(self, data) -> None:
        self.text.append(data)


def parsed(html: str) -> _Collector:
    for source in (html, html.replace("<![", "&lt;![")):
        parser = _Collector()
        try:
            parser.feed(source)
            parser.close()
        except AssertionError:  # an unknown marked section
            continue
        break
    parser.flush()
    return parser


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k**2) / (2 * sigma**2)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        some = [(ratios[j], kernel[j - i + reach]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        out.append(sum(r * w for r, w in some) / sum(w for _, w in some))
    return out


def main_text(html: str | None) -> str:
    """The blocks of the page's article, joined by empty lines."""
    page = parsed(html or "")
    lines = page.lines
    if all(x.dropped == YES for x in lines):
        return ""
    smooth = smoothed([x.ratio for x in lines])
    mean = sum(smooth) / len(smooth)
    limit = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    kept = [x for x, s in zip(lines, smooth, strict=True) if x.dropped == NO or (x.dropped == PERHAPS and min(s, x.ratio) >= limit)]
    content = [x for x, s in zip(lines, smooth, strict=True) if s >= limit and x.dropped != YES] or kept
    if not kept:
        return ""
    size = len(page.parent)
    weight, heaviest, inside = [0] * size, [0] * size, [False] * size
    for x in content:
        weight[x.container] += len(x.text)
    for c in range(size - 1, 0, -1):  # a container comes after the one around it
        around = page.parent[c]
        weight[around] += weight[c]
        if not heaviest[around] or weight[c] >= weight[heaviest[around]]:
            heaviest[around] = c
    region = 0
    while (c := heaviest[region]) and weight[c] >= MOST * weight[0]:
        region = c
        if page.whole[c]:
            break
    for c in range(size):
        inside[c] = c == region or (c > 0 and inside[page.parent[c]])
    return "\n\n".join([x.text for x in kept if inside[x.container]])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``text`` and ``n_chars`` in place of the html column."""
    names = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pages.dtypes if c in names), "text string, n_chars bigint"])
    at, keep = pages.columns.index(html), [pages.columns.index(c) for c in names]

    def batches(it):
        for batch in it:
            texts = [main_text(h) for h in batch.column(at).to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *columns], [*names, "text", "n_chars"])

    return pages.mapInArrow(batches, schema)
