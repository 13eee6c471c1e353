"""Main text of web pages: paragraphs pass points up a tree of blocks, and the container with the most points is kept."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

# Element names of the HTML standard, and words that sites use in class and id.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("nav footer aside form button select datalist dialog menu noscript template svg math canvas object audio video head search label fieldset map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre li dd dt td th blockquote address figcaption caption summary".split())
LISTS = frozenset("ul ol dl div section table tbody dir menu".split())
#: An opening tag of the first closes an open element of the second, unless one of the third stands between.
CLOSES = (
    {n: (frozenset({"p"}), frozenset("table td th caption button object html".split())) for n in BLOCKS - frozenset("body html caption td th tr tbody thead tfoot option optgroup".split())}
    | {"a": (frozenset({"a"}), frozenset("table td th caption button object".split()))}
    | {n: (frozenset({"dd", "dt"}), frozenset({"dl"})) for n in ("dd", "dt")}
    | {n: (frozenset({"td", "th"}), frozenset({"table"})) for n in ("td", "th")}
    | {"tr": (frozenset({"tr"}), frozenset({"table"}))}
    | {n: (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"})) for n in ("tbody", "thead", "tfoot")}
)
WALLS = frozenset("html table td th caption button object template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Class and id words of what is never part of an article, and of what is not unless a word of CONTENT stands beside it.
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adbox sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr "
    "comment comments commentlist disqus reply replies respond newsletter subscribe subscription popup modal overlay paywall login signup breadcrumb breadcrumbs pagination pager skip".split()
)
DOUBTFUL = frozenset("sidebar menu nav navbar navigation navigations header footer masthead topbar toolbar notice notices share sharing social related recommended widget widgets rail alert alerts disclaimer copyright".split())
CONTENT = frozenset("article content body main entry post story text".split())
COMMAS = re.compile("[,،、︐﹐，]")

MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<[a-zA-Z/][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

LIVE, DROPPED = 0, 1


class Page:
    """Blocks of a page as a tree, parents before children, and its runs of text in page order."""

    def __init__(self, source: str):
        self.tag, self.up, self.state, self.bonus, self.looks = ["#root"], [-1], [LIVE], [0], [""]
        self.runs: list[tuple[int, str, int, int]] = []  # block, text, characters inside links, links
        self._open: list[tuple[str, int, bool, bool]] = [("#root", 0, False, False)]  # name, block, whether it began one, whether it is mute
        self._count: dict[str, int] = {}
        self._text: list[str] = []
        self._linked = self._links = self._mute = 0
        self._broken = False
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = MARKUP.search(source, at)
            if not m:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            else:
                self._begin(name, m[3])
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    at = stop.start() if stop else end
        self._flush()

    def _say(self, text: str) -> None:
        if self._mute:
            return
        if not text.isspace():
            self._broken = False
        self._text.append(text)
        if self._count.get("a"):
            self._linked += len(text)

    def _flush(self) -> None:
        text = "".join(self._text)
        if text:
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.runs.append((self._open[-1][1], text, min(self._linked, len(text)), self._links))
        self._text, self._linked, self._links, self._broken = [], 0, 0, False

    def _pop(self, to: int) -> None:
        if any(block for _, _, block, _ in self._open[to:]):
            self._flush()
        for name, _, _, mute in self._open[to:]:
            self._count[name] -= 1
            self._mute -= mute
        del self._open[to:]

    def _close(self, name: str) -> None:
        if name == "br":
            return self._begin("br", "")
        if not self._count.get(name):
            return None
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == name:
                return self._pop(i)
            if self._open[i][0] in WALLS and name not in WALLS and name not in ("tr", "tbody", "thead", "tfoot"):
                return None
        return None

    def _begin(self, name: str, attributes: str) -> None:
        if name == "br":
            if self._broken:
                self._flush()
            self._text.append(" ")
            self._broken = True
            return
        if name in CLOSES:
            which, walls = CLOSES[name]
            self._close_open(which, walls)
        if name == "li":
            self._close_open(frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"}))
        state, bonus, looks = self._look(name, attributes)
        block = name in BLOCKS
        if block:
            self._flush()
        if name in VOID:
            return
        node, mute = self._open[-1][1], not block and state == DROPPED
        if block:
            self.tag.append(name)
            self.up.append(node)
            self.state.append(DROPPED if self._mute else state)
            self.bonus.append(bonus)
            self.looks.append(looks)
            node = len(self.tag) - 1
        self._links += name == "a"
        self._mute += mute
        self._open.append((name, node, block, mute))
        self._count[name] = self._count.get(name, 0) + 1

    def _close_open(self, which: frozenset, walls: frozenset) -> None:
        if not any(self._count.get(n) for n in which):
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in which:
                return self._pop(i)
            if self._open[i][0] in walls:
                return

    def _look(self, name: str, attributes: str) -> tuple[int, int, str]:
        main = name in ("article", "main")
        bonus = 25 if main else 0
        state = DROPPED if name in HIDDEN or name in RAW or (name == "header" and not (self._count.get("article") or self._count.get("main"))) else LIVE
        looks = ""
        if "=" in attributes and name not in ("html", "body"):
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            if found.get("role", "").strip().lower() in ROLES:
                state = DROPPED
            looks = f"{found.get('class', '')} {found.get('id', '')}"
            names = {n.lower() for n in NAMES.findall(looks)}
            content = bool(names & CONTENT) or found.get("itemprop") == "articleBody" or found.get("role") == "main"
            if content and not names & JUNK:
                bonus += 25
            if not main and (names & JUNK or (names & DOUBTFUL and not content)):
                state = DROPPED
            elif main and names & JUNK:
                state = DROPPED
        return state, bonus, looks

    def main_text(self) -> str:
        return self._chosen(spare=False) or self._chosen(spare=True)

    def _chosen(self, spare: bool) -> str:
        """spare: dropped blocks stay where they hold an article or main element, as where a menu is never closed."""
        n = len(self.tag)
        holds = [t in ("article", "main") for t in self.tag]
        for v in range(n - 1, 0, -1):
            holds[self.up[v]] |= holds[v]
        live = [True] * n
        for v in range(1, n):
            live[v] = live[self.up[v]] and (self.state[v] == LIVE or (spare and holds[v]))
        size, linked, links, score = [0] * n, [0] * n, [0] * n, [0.0] * n
        for v, text, in_links, many in self.runs:
            if not live[v]:
                continue
            size[v] += len(text)
            linked[v] += in_links
            links[v] += many
            if self.tag[v] in HEADINGS:
                continue
            points = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - in_links / len(text))
            to = self.up[v] if self.tag[v] in PARAGRAPHS else v
            for level in range(6):
                if to < 0:
                    break
                score[to] += points / (1, 2, 6, 9, 12, 15)[level]
                to = self.up[to]
        for v in range(n - 1, 0, -1):
            for part in (size, linked, links):
                part[self.up[v]] += part[v]
        density = [a / b if b else 0.0 for a, b in zip(linked, size, strict=True)]
        total = [(s + b) * (1 - d) if s > 0 and on else 0.0 for s, b, d, on in zip(score, self.bonus, density, live, strict=True)]
        best = max(range(n), key=lambda v: (total[v], -v))
        if total[best] <= 0:
            return ""
        around = best
        while around > 0 and self.tag[around] not in ("article", "main"):
            around = self.up[around]
        parent = self.up[best]
        keep = {best}
        if around > 0:
            best, parent = around, self.up[around]
            keep = {best} | {v for v in range(n) if live[v] and self.up[v] == parent and self.tag[v] == self.tag[best] == "article" and self.looks[v] == self.looks[best] and total[v] >= total[best] / 5}
        elif parent >= 0:
            beside = {v: [] for v in range(n) if live[v] and self.up[v] == parent}
            for v, text, _, _ in self.runs:
                if v in beside:
                    beside[v].append(text)
            keep |= {v for v, texts in beside.items() if total[v] >= max(10.0, total[best] / 5) or (self.tag[v] == "p" and like_prose(" ".join(texts), density[v]))}
        inside = [False] * n
        for v in range(n):
            inside[v] = live[v] and (v in keep or (v > 0 and inside[self.up[v]]))
            if inside[v] and v not in keep and self.tag[v] in LISTS and links[v] >= 3 and density[v] > 0.75:
                inside[v] = False
        title = not any(inside[v] and self.tag[v] == "h1" for v in range(n))
        return "\n".join(t for v, t, _, _ in self.runs if inside[v] or (title and live[v] and self.tag[v] == "h1" and self.up[v] == parent and v < best))


def like_prose(text: str, density: float) -> bool:
    """A paragraph beside the best block belongs to it if it is long and nearly without links, or a sentence without any."""
    return density < 0.25 if len(text) > 80 else density == 0 and bool(re.search(r"[.!?。](\s|$)", text))


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of its html, a block to a line, and its code points.

    Markup is read into a tree of blocks as browsers nest them. Menus, headers, footers, sidebars, notices, adverts, forms and
    comments go by element, role and the words of class and id. Each remaining run of text gives points for its length and its
    commas to the blocks around it, fewer to farther ones; a block's points are discounted by the share of its text in links. The
    block with the most points stays (the article or main element around it, if there is one), with siblings like it; of these
    only lists that are nearly all links go. A page whose every block would go is read again, with those spared that hold an
    article or main element.

    Null and empty html, and pages without a block of prose, give an empty text. Broken markup and texts of any length are read
    whole. Repeated rows stay, an empty table gives an empty result, and other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
