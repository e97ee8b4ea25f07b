"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the text of the blocks inside them, nearest container first. The
scores vote, in Spark, for generalised paths of tags and classes from the body down, a path that many
pages of a host score well wins for the host, and pages are read again with the winning path. A page
without that path uses its own best container. Inside an article or main element the text is all of that
element; elsewhere a list, table or section takes along the text that stands directly beside it.

Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles count in
neither pass; they are told by tag, role, class and id, inline elements too. A header inside an article is
the article's own. A form that holds most of a page's text is none. A container that only its class or id tells is
none either if an article or main that isn't named so itself lies in it, as layouts are often called by what stands beside them; nor
if without such containers the page has no text at all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from hashlib import md5
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import boxed, replaced, stored, unboxed

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_.-]{0,60})")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_CLOSE = {t: re.compile(rf"</{t}(?![a-zA-Z0-9:_.-])", re.I) for t in ("script", "style", "textarea", "noscript", "template", "svg", "math", "iframe", "title", "select", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("article body center dd details div dl figure fieldset li main ol section table tbody td tr ul blockquote".split())
_NOISE_TAGS = frozenset("nav aside footer form menu dialog search button".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of a text rather than containers of a whole one.
_PARTS = frozenset("blockquote dd details dl figure li ol section table tbody td tr ul".split())
_NEVER_NOISE = frozenset("html body article main".split())
# Words that begin or end the class or id of what isn't the article.
_NOISE_WORDS = (
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager toc "
    "header masthead footer colophon copyright sidebar aside widget widgets rail "
    "notice notices cookie cookies consent gdpr popup modal overlay alert "
    "comment comments commentlist respond disqus discussion replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search form"
).split()
_NOISE = re.compile(rf"(?:^(?:{'|'.join(_NOISE_WORDS)})(?:[-_\d].*)?$)|(?:.*[-_](?:{'|'.join(_NOISE_WORDS)})$)")
#: Of these, those that stand for a title inside an article.
_TITLE = re.compile(r"(?:^(?:header|masthead|banner)(?:[-_\d].*)?$)|(?:.*[-_](?:header|masthead|banner)$)")
_LAYOUT = re.compile(r"^(?:has|with|without|no|is)[-_]|[-_](?:has|with|without|no)[-_]")
#: An open element of the first kind ends where one of the second starts.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ENDS_BEFORE = frozenset().union(*_ENDS.values())
_FORM = re.compile(r"<form\b", re.I)
#: Characters of a tag that are looked at before all quotes of the page are; containers that are told apart below one another; characters of a path.
_NEAR, _DEEP, _LONG = 400, 200, 400
_CLEAN, _NOISE_OUTSIDE, _NOISY = 0, 1, 2
_kinds: dict[tuple[str, str], tuple[str, int, bool]] = {}


@dataclass
class Block:
    """One block of text: pieces as they stand in the page, its open containers (outermost first), link characters."""

    inside: tuple[int, ...]
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    form: int = -1

    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def kind(tag: str, attributes: str) -> tuple[str, int, bool]:
    """An element's step in a generalised path, with all its classes, whether it is noise, or noise outside an article, and whether only its name says so.

    Numbers in names become #. An article or main is no noise, but its name may say so.
    """
    key = tag, attributes
    found = _kinds.get(key)
    if found is None:
        given = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
        names = unescape(given.get("class", "")).lower().split()
        ident = unescape(given.get("id", "")).lower().split()
        noise = tag in _NOISE_TAGS or given.get("role", "").lower() in _NOISE_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true"
        noise = noise or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))
        named = [n for n in names + ident if _NOISE.match(n) and not _LAYOUT.search(n)]
        level = _NOISY if noise or any(not _TITLE.match(n) for n in named) else _NOISE_OUTSIDE if named or tag == "header" else _CLEAN
        step = tag + "".join(f".{re.sub(r'[0-9]+', '#', n)}" for n in sorted(set(names)))
        found = step, _CLEAN if tag in _NEVER_NOISE else level, bool(named or tag == "header") and not noise
        if len(_kinds) > 20_000:
            _kinds.clear()
        if len(attributes) < 400:
            _kinds[key] = found
    return found


class _Ends:
    """The ends of all tags of a page: for any place, the first > outside quotes, else the first one; in linear time."""

    def __init__(self, html: str) -> None:
        self.at = [m.start() for m in re.finditer("[>\"']", html)]
        self.end = [-1] * (len(self.at) + 1)
        later: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            c = html[self.at[i]]
            # A quote goes on behind the next one of its kind; without one the tag has no end of this sort.
            self.end[i] = self.at[i] if c == ">" else self.end[later[c] + 1] if c in later else -1
            later[c] = i
        self.html = html

    def of(self, start: int) -> int:
        found = self.end[bisect_left(self.at, start)]
        return found if found >= 0 else self.html.find(">", start)


def _lower_end(path: str, step: str) -> str:
    """A path one step further down; long ones begin with a hash of what was before."""
    return f"{path if len(path) <= _LONG else md5(path.encode('utf-8', 'surrogatepass')).hexdigest()}/{step}"


def read(html: str) -> tuple[list[str], list[Block]]:
    """The paths of a page's containers, by number, and its blocks in order, noise left out."""
    first = _Reader(html, None)
    paths, blocks = first.run()
    layouts = first.holders
    if first.n_named and not layouts and all(b.linked >= sum(map(len, b.parts)) for b in blocks):
        layouts = set(range(first.n_named))
    if layouts:
        paths, blocks = _Reader(html, None, layouts).run()
    if not _FORM.search(html):
        return paths, blocks
    sizes: dict[int, int] = {}
    for b in blocks:
        sizes[b.form] = sizes.get(b.form, 0) + len(b.text())
    return _Reader(html, {n for n, size in sizes.items() if n >= 0 and 2 * size > sum(sizes.values())}, layouts).run()


@dataclass(frozen=True)
class _Open:
    """An open element: its path, whether it is inside noise, inside an article, its containers and its form."""

    tag: str = ""
    path: str = ""
    noisy: bool = False
    article: bool = False
    inside: tuple[int, ...] = ()
    form: int = -1
    named: int = -1  # the number of the innermost container that only its name makes noise


class _Reader:
    """One pass over a page. Only the ``forms`` of these numbers, in order, are no noise, or with None all; and ``layouts``, of the containers that only names make noise.

    Each tag is looked at once and the time grows with the page's length, broken markup included. Containers
    nested deeper than _DEEP count as the one around them.
    """

    def __init__(self, html: str, forms: set[int] | None, layouts: frozenset[int] | set[int] = frozenset()) -> None:
        self.html, self.forms, self.layouts = html, forms, layouts
        self.n_named = 0
        self.around: list[int] = []  # by number of such a container: the next one outwards
        self.holders: set[int] = set()  # those around an article or main of another name
        self.paths: list[str] = []
        self.blocks: list[Block] = []
        self.stack = [_Open()]
        self.open: Counter[str] = Counter()
        self.block: Block | None = None
        self.link = False
        self.n_forms = 0
        self.muted: list | None = None  # inline noise: its tag, how often that is open inside it, the depth of the stack
        self.closers: dict[str, int] = {}
        self.ends: _Ends | None = None

    def text(self, start: int, stop: int) -> None:
        top = self.stack[-1]
        if stop <= start or top.noisy or self.muted:
            return
        piece = self.html[start:stop]
        if self.block is None:
            if piece.isspace():
                return
            self.block = Block(top.inside, top.tag in ("h1", "h2"), form=top.form)
            self.blocks.append(self.block)
        self.block.parts.append(piece)
        if self.link:
            self.block.linked += len(piece)

    def settle(self) -> None:
        self.block, self.link = None, False
        if self.muted and len(self.stack) < self.muted[2]:
            self.muted = None

    def pop(self, size: int) -> None:
        for x in self.stack[size:]:
            self.open[x.tag] -= 1
        del self.stack[size:]

    def close(self, tag: str) -> None:
        if self.muted and tag == self.muted[0]:
            self.muted[1] -= 1
            if not self.muted[1]:
                self.muted = None
        if tag == "a":
            self.link = False
        elif tag in _BLOCKS or tag in _NOISE_TAGS:
            if self.open[tag] > 0:
                self.pop(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))
            self.settle()

    def last_closer(self, tag: str) -> int:
        if tag not in self.closers:
            self.closers[tag] = self.html.lower().rfind(f"</{tag}")
        return self.closers[tag]

    def start(self, tag: str, attributes: str, at: int) -> int:
        """What an opening tag does; returns where to read on."""
        if tag in _CLOSE:
            if not attributes.endswith("/") or tag in ("script", "style"):
                end = _CLOSE[tag].search(self.html, at)
                gt = self.html.find(">", end.end()) if end else -1
                at = gt + 1 if gt >= 0 else len(self.html)
            if tag == "title":
                self.block = None
        elif tag == "br":
            if self.block is not None:
                self.block.parts.append(" ")
        elif tag == "hr":
            self.block = None
        elif tag in _BLOCKS or tag in _NOISE_TAGS:
            self.container(tag, attributes)
        elif tag not in _VOID:
            if self.muted:
                self.muted[1] += tag == self.muted[0]
            elif attributes and kind(tag, attributes)[1] == _NOISY and self.last_closer(tag) >= at:
                self.muted = [tag, 1, len(self.stack)]
            self.link = self.link or tag == "a"
        return at

    def container(self, tag: str, attributes: str) -> None:
        stack = self.stack
        if stack[-1].tag == "p":
            self.pop(len(stack) - 1)
        if tag in _ENDS_BEFORE:
            for i in range(len(stack) - 1, 0, -1):
                if tag in _ENDS.get(stack[i].tag, ()):
                    self.pop(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    break
        above = stack[-1]
        step, level, by_name = kind(tag, attributes)
        form, named = above.form, above.named
        noise = level == _NOISY or (level == _NOISE_OUTSIDE and not above.article)
        if noise and by_name:
            self.around.append(named)
            named, self.n_named = self.n_named, self.n_named + 1
            noise = named not in self.layouts
        if tag in ("article", "main") and not by_name:
            outer = named
            while outer >= 0 and outer not in self.holders:
                self.holders.add(outer)
                outer = self.around[outer]
        if tag == "form":
            if form < 0:
                form, self.n_forms = self.n_forms, self.n_forms + 1
            noise = self.forms is not None and form not in self.forms
        noisy = noise or above.noisy or bool(self.muted)
        path, inside = above.path, above.inside
        if tag in _CONTAINERS and len(inside) < _DEEP:
            path = _lower_end(path, step)
            if not noisy:
                inside = (*inside, len(self.paths))
                self.paths.append(path)
        stack.append(_Open(tag, path, noisy, above.article or tag in ("article", "main"), inside, form, named))
        self.open[tag] += 1
        self.settle()

    def run(self) -> tuple[list[str], list[Block]]:
        html, size, at = self.html, len(self.html), 0
        last = html.rfind(">")
        while at < size:
            lt = html.find("<", at)
            if lt < 0 or lt > last:  # nothing closes a tag any more; a comment takes all the rest
                comment = html.find("<!--", lt) if lt >= 0 else -1
                self.text(at, comment if comment >= 0 else size)
                break
            if html.startswith("<!--", lt):
                self.text(at, lt)
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
                continue
            if html[lt + 1] in "!?":
                self.text(at, lt)
                at = html.find(">", lt) + 1
                continue
            name = _NAME.match(html, lt)
            if name is None:
                self.text(at, lt + 1)
                at = lt + 1
                continue
            self.text(at, lt)
            rest = _REST.match(html, name.end(), name.end() + _NEAR)
            if rest:
                gt = rest.end() - 1
            else:
                self.ends = self.ends or _Ends(html)
                gt = self.ends.of(name.end())
            tag, at = name[2].lower(), gt + 1
            if name[1]:
                self.close(tag)
            else:
                at = self.start(tag, html[name.end() : gt].strip(), at)
        return self.paths, self.blocks


def scored(html: str, decay: float = 0.75) -> dict[str, float]:
    """Points of each container path: of each block the text that isn't linked, less for containers further out."""
    paths, blocks = read(html)
    points: dict[str, float] = {}
    for b in blocks:
        own = max(0.0, len(b.text()) - 2.0 * b.linked)
        for number in reversed(b.inside):
            points[paths[number]] = points.get(paths[number], 0.0) + own
            own *= decay
            if own < 0.001:
                break
    return {p: v for p, v in points.items() if v > 0}


def _tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def _lifted(paths: list[str], blocks: list[Block], chosen: set[int]) -> set[int]:
    """Each container's article, else its main, where there is one; of others, parts rise to the nearest container with text of its own."""
    plain = [b for b in blocks if b.linked < sum(map(len, b.parts)) and not b.heading]
    own = {b.inside[-1] for b in plain if b.inside}
    above = {b.inside[i]: b.inside[:i] for b in blocks for i in range(len(b.inside)) if b.inside[i] in chosen}
    out = set()
    for n in chosen:
        line = (*above.get(n, ()), n)
        whole = [i for i in line if _tag(paths[i]) == "article"][-1:] or [i for i in line if _tag(paths[i]) == "main"][-1:]
        if not whole and _tag(paths[n]) in _PARTS:
            outer = next((k for k in range(len(line) - 1, -1, -1) if _tag(paths[line[k]]) not in _PARTS), 0)
            whole = [i for i in line[outer:-1] if i in own][:1]
        out.update(whole or [n])
    return out


def extract(html: str, path: str | None) -> str:
    """The text of the containers with that path, else of the page's own best one, else of all that isn't noise.

    Containers are lifted first, so that no text of an article beside its largest part is lost. A title that stands before the container, in the one around it, belongs to it.
    """
    paths, blocks = read(html)
    chosen = {i for i, p in enumerate(paths) if p == path}
    if not any(chosen.intersection(b.inside) for b in blocks):
        points = scored(html)
        best = max(points, key=lambda p: (points[p], p), default=None)
        chosen = {i for i, p in enumerate(paths) if p == best}
    chosen = _lifted(paths, blocks, {i for b in blocks for i in b.inside}.intersection(chosen))
    first = next((i for i, b in enumerate(blocks) if chosen.intersection(b.inside)), 0)
    around = {b.inside[k - 1] for b in blocks for k in range(1, len(b.inside)) if b.inside[k] in chosen}
    title = {i for i, b in enumerate(blocks[:first]) if b.heading and b.inside and b.inside[-1] in around}
    lines = (b.text() for i, b in enumerate(blocks) if not chosen or i in title or chosen.intersection(b.inside))
    return "\n".join(x for x in lines if x)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("share", T.DoubleType())])))
def _votes(html: pa.Array) -> pa.Array:
    out = []
    for h in html:
        points = scored(h.as_py() or "")
        most = max(points.values(), default=1.0)
        out.append([{"path": p, "share": round(v / most, 4)} for p, v in points.items()])
    return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("share", pa.float64())])))


@F.arrow_udf(T.StringType())
def _extracted(html: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([extract(h.as_py() or "", p.as_py()) for h, p in zip(html, path, strict=True)], pa.string())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus_paths(pages: DataFrame, *, html: str = "html", url: str = "url") -> DataFrame:
    """``host, path``: the path with most points from a host's pages, a page giving its best container one point."""
    votes = pages.select(host_of(F.col(url)).alias("host"), F.explode(_votes(F.col(html))).alias("v"))
    sums = votes.groupBy("host", F.col("v.path").alias("path")).agg(F.sum(F.col("v.share").cast("decimal(6,4)")).alias("points"))
    return sums.groupBy("host").agg(F.max(F.struct("points", "path"))["path"].alias("path"))


def extract_pages(pages: DataFrame, *, html: str = "html", url: str = "url", text: str = "text") -> DataFrame:
    """Adds ``text``, the main text of each page; a column of that name is replaced, others stay.

    Null or empty html gives the empty text. Pages without a host vote together as one. Repeated rows count
    as often as they stand and all get the same text. An empty table gives an empty table. Very long pages are
    read whole, in a time that grows with their length, whatever their markup.
    """
    winners = stored(consensus_paths(pages, html=html, url=url), "paths")
    kept = replaced(pages, text)
    rows = boxed(pages, at=host_of(F.col(url)), html=F.col(html)).join(winners, F.col("at") == F.col("host"), "left")
    return unboxed(rows, kept.columns, **{text: _extracted(F.col("html"), F.col("path"))})
