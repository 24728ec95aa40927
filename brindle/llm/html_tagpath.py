"""Operator 1: main text of web pages by tag-path ratios.

A page is cut into blocks of text; each has the path of tags from the root down to it. Per path, the length of text
outside links and the number of punctuation marks a block are aggregated over the page. The two ratios are fused
into one weight a block, smoothed along the page, and the paths above a threshold are content. The article is the
deepest element that holds all blocks of the content paths, or the article or main element around it, or what else
encloses it and adds only headings and lists. Its text is every block of a content path, and every other block
whose path is not mostly links, so short paragraphs and headings of the article stay and rows of links go.

Elements, roles and hidden parts that are never an article are left out first. Class and id words (whole ones, or
parts of compounds that don't negate them) only hint: an element that holds the page's article or most of its text
is a wrapper, whatever its name is. A header inside an article gives its headings alone.

Defined results: null or empty html gives an empty text; so does a page without a content block; markup that is
cut off is closed at the end; a tag mark that never closes is text; where quotes never close, tags end at their
first mark, from there to the end of the page; repeated rows are extracted each; an empty table gives no rows;
other columns are ignored. The work is in proportion to the length of a page, however it nests; one page at a time.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import slices, texts_of

#: Fixed values of HTML: elements without content, with raw text, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of one of these ends an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an earlier sibling of these kinds, up to the given parents.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never part of an article: by element and by role. A form may be a wrapper.
BOILERPLATE = frozenset("nav header footer aside script style noscript template iframe object svg math canvas audio video select button input textarea dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What belongs to an article beside its paragraphs.
ARTICLE_PARTS = HEADINGS | frozenset("li dt dd".split())
#: Words of class and id that hint at something else than the article: alone, and as a part of a compound.
WHOLE = frozenset("side widget top bottom alert respond replies reply recommendations subscription subscribe side-nav pager login popup".split())
PARTS = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer comment comments disqus cookie cookies consent gdpr notice notices modal overlay newsletter signup share sharing social related recommended toolbar pagination".split())
#: Of these, what never is a page's layout.
SECTIONS = frozenset("ad ads advert adverts advertisement advertisements adsense sponsor sponsored comment comments disqus cookie cookies consent gdpr newsletter related recommended".split())
#: With one of these a compound speaks of the page's layout.
NEGATIONS = frozenset("no not non without with has have is free enabled disabled open closed on off".split())
#: With one of these a header is the article's own.
ARTICLE_WORDS = frozenset("entry post article story content page title headline heading section".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOLD = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_WORDS = re.compile(r"[a-z]+")
KERNEL = (1, 2, 4, 2, 1)
NONE, HEADINGS_ONLY, ALL = 0, 1, 2  # what an element's kind leaves out


class _Element:
    """tag, the number of its path, what it leaves out, the nearest element around it (or itself) that hints at
    something else, and the blocks that it holds: first..last-1."""

    __slots__ = ("tag", "path", "parent", "block", "out", "hint", "strong", "wrapper", "part", "in_article", "first", "last")

    def __init__(self, tag: str, parent: _Element | None, path: int, first: int):
        self.tag, self.parent, self.path, self.first, self.last = tag, parent, path, first, None
        self.out = parent.out if parent else NONE
        self.hint: _Element | None = parent.hint if parent else None
        self.strong = self.wrapper = False
        self.part = tag in ARTICLE_PARTS or bool(parent and parent.part)
        self.in_article = tag in ("article", "main") or bool(parent and parent.in_article)
        self.block = self


def name_hint(words: str) -> tuple[bool, bool, bool]:
    """Of a class or an id: does a whole word of it hint (or a part that is no layout), a part of a compound, and is it a
    header of an article."""
    whole = part = header = False
    for word in words.split():
        if word in WHOLE or word in PARTS:
            whole = True
            continue
        parts = set(_WORDS.findall(word))
        if len(parts) < 2 or not NEGATIONS.isdisjoint(parts):
            continue
        named = PARTS & parts
        if named <= {"header", "masthead", "banner"} and named and not ARTICLE_WORDS.isdisjoint(parts):
            header = True
        elif named:
            whole, part = whole or not SECTIONS.isdisjoint(named), True
    return whole, part, header


class _Page:
    """Blocks of text of a page in order, each with its element, its text and how much of it stands in links."""

    def __init__(self, page: str):
        self.found: list[tuple[_Element, str, int]] = []
        self.hints: list[_Element] = []
        self.leading: list[_Element] = []  # the first h1, article and main
        self._paths: dict[tuple[int, str], int] = {}
        self._open_at: dict[str, list[int]] = defaultdict(list)
        self._blocks_at: list[int] = []  # depths of elements that aren't inline
        self.stack = [_Element("", None, 0, 0)]
        self._text: list[str] = []
        self._links = 0
        self._where = self.stack[0]
        self._quotes = True
        self._read(page)
        self._pop_to(0)

    # -- blocks and elements

    def _add(self, text: str) -> None:
        top = self.stack[-1].block
        if not self._text:
            self._where = top
        elif top is not self._where and top.tag in INLINE:  # an inline element that hints at something else
            self._end()
            self._where = top
        self._text.append(text)
        if self._open_at["a"]:
            self._links += len(text) - text.count(" ")

    def _end(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                self.found.append((self._where, text, min(self._links, len(text))))
        self._links = 0

    def _pop_to(self, depth: int) -> None:
        self._end()
        self._drop(depth)

    def _drop(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            e.last = len(self.found)
            if e.parent is not None:
                self._open_at[e.tag].pop()
                if e.tag not in INLINE:
                    self._blocks_at.pop()

    def _push(self, tag: str, attributes: str) -> None:
        parent = self.stack[-1]
        label, out, whole, part = tag, NONE, False, False
        if tag in BOILERPLATE:
            out = HEADINGS_ONLY if tag == "header" and parent.in_article else ALL
        elif tag == "form":
            part = True
        if attributes and _TOLD.search(attributes):
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), next((v for v in values if v), "").lower()
                if name == "class":
                    label = f"{tag}.{'.'.join(value.split())}"
                if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES) or (name == "style" and _UNSEEN.search(value)):
                    out = ALL
                elif name in ("class", "id") and tag not in ("body", "html", "main", "article"):
                    a, b, header = name_hint(value)
                    whole, part, out = whole or a, part or b, max(out, HEADINGS_ONLY if header else NONE)
        path = self._paths.setdefault((parent.path, label), len(self._paths) + 1)
        suspect = bool(out or whole or part)
        if suspect:
            self._end()
        e = _Element(tag, parent, path, len(self.found))
        e.out = max(parent.out, out)
        if e.out == HEADINGS_ONLY and tag in HEADINGS:
            e.out = NONE
        if whole or part:
            e.hint, e.strong = e, whole
            self.hints.append(e)
        elif tag in INLINE and not suspect:
            e.block = parent.block
        if tag in ("h1", "article", "main") and all(x.tag != tag for x in self.leading):
            self.leading.append(e)
        self._open_at[tag].append(len(self.stack))
        if tag not in INLINE:
            self._blocks_at.append(len(self.stack))
        self.stack.append(e)

    # -- markup

    def _attributes(self, page: str, at: int) -> tuple[int, int]:
        """Where the attributes of a tag end and where the text after it begins; -1 if the tag never closes."""
        begin = at
        while self._quotes:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                self._quotes = False
                break
            if page[at] == ">":
                return at, at + 1
            k = at - 1
            while k > begin and page[k].isspace():
                k -= 1
            close = page.find(page[at], at + 1) if page[k] == "=" else at
            if close < 0:
                self._quotes = False
                break
            at = close + 1
        end = page.find(">", begin)
        return end, end + 1 if end >= 0 else -1

    def _read(self, page: str) -> None:
        at, size, last = 0, len(page), page.rfind(">")
        while at < size:
            lt = page.find("<", at)
            if lt > at or lt < 0:
                self._add(page[at : lt if lt >= 0 else size])
            if lt < 0:
                break
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else size
                continue
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                self._add(page[lt + 9 : end if end >= 0 else size].replace("&", "&amp;"))
                at = end + 3 if end >= 0 else size
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
                continue
            name = _NAME.match(page, lt) if lt < last else None
            end, at = self._attributes(page, name.end()) if name else (-1, -1)
            if at < 0:  # a mark that opens no tag
                self._add("<")
                at = lt + 1
                continue
            tag = name[2].lower()
            if name[1]:
                self._close(tag)
            else:
                at = self._start(tag, page[name.end() : end], page, at)

    def _close(self, tag: str) -> None:
        depths = self._open_at.get(tag)
        if not depths:
            return
        if tag in INLINE and (not self._blocks_at or self._blocks_at[-1] < depths[-1]):
            if self.stack[-1].block.tag in INLINE:
                self._end()
            self._drop(depths[-1])
        else:
            self._pop_to(depths[-1])

    def _start(self, tag: str, attributes: str, page: str, at: int) -> int:
        if tag == "br":
            if self._text:
                self._text.append(" ")
            return at
        if tag in INLINE:
            if tag not in VOID:
                self._push(tag, attributes)
            return at
        self._end()
        deepest = lambda tags: max((self._open_at[t][-1] for t in tags if self._open_at.get(t)), default=0)
        if tag in CLOSES_P and self._blocks_at and self._open_at.get("p") and self._open_at["p"][-1] == self._blocks_at[-1]:
            self._drop(self._open_at["p"][-1])
        if tag in SIBLINGS:
            kinds, until = SIBLINGS[tag]
            inner = [d for t in kinds for d in self._open_at.get(t, ()) [-1:]]
            if inner and max(inner) > deepest(until):
                self._drop(max(inner))
        if tag in VOID:
            return at
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            end = page.find(">", close.start()) if close else -1
            return end + 1 if end >= 0 else len(page)
        if not attributes.endswith("/"):
            self._push(tag, attributes)
        return at


def _ratios(found: list[tuple[_Element, str, int]], use: list[int]) -> tuple[dict[int, float], dict[int, float]]:
    """For each path of the used blocks: its length of text outside links a block fused with its marks a block, and the
    share of its text that stands in links."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for k in use:
        e, text, links = found[k]
        s = sums[e.path]
        s[0] += len(text)
        s[1] += links
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += 1
    return {p: math.log1p((a - b) / n) * math.log1p(marks / n) for p, (a, b, marks, n) in sums.items()}, {p: b / a for p, (a, b, _, _) in sums.items()}


def _smoothed(raw: list[float]) -> list[float]:
    half = len(KERNEL) // 2
    out = []
    for k in range(len(raw)):
        near = [(w, raw[j]) for j, w in enumerate(KERNEL, k - half) if 0 <= j < len(raw)]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def _above(paths: list[int], weights: list[float], threshold: float) -> set[int]:
    """The paths whose blocks' mean weight reaches the threshold's share of the mean of all."""
    of_path: dict[int, list[float]] = defaultdict(list)
    for p, w in zip(paths, weights, strict=True):
        of_path[p].append(w)
    mean = sum(weights) / len(weights)
    return {p for p, w in of_path.items() if sum(w) / len(w) >= threshold * mean}


def _find_wrappers(page: _Page) -> None:
    """Hinting elements that hold the article or most of the text are wrappers; those below a real hint aren't asked."""
    mass = [len(text) - links if e.out == NONE else 0 for e, text, links in page.found]
    until = [0]
    for m in mass:
        until.append(until[-1] + m)
    whole = max(until[-1], 1)
    for h in page.hints:  # the outer ones first
        outer = h.parent.hint
        if outer is not None and not outer.wrapper:
            continue
        share = (until[h.last] - until[h.first]) / whole
        leads = any(h.first <= x.first and x.last <= h.last and x.first < x.last for x in page.leading)
        h.wrapper = share >= (1 if h.strong else 0.8) or (share >= 0.3 and leads)


def _is_plain(e: _Element) -> bool:
    return e.out == NONE and (e.hint is None or e.hint.wrapper)


def main_text(page: str, *, threshold: float = 0.5) -> str:
    """The text of the article. threshold: of the mean weight that a content path must reach."""
    read = _Page(page)
    found = read.found
    _find_wrappers(read)
    plain = [k for k, (e, _, _) in enumerate(found) if _is_plain(e)]
    if not plain:
        return ""
    ratio, linked = _ratios(found, plain)
    paths = [found[k][0].path for k in plain]
    raw = [ratio[p] for p in paths]
    smooth = _above(paths, _smoothed(raw), threshold)
    content = smooth & _above(paths, raw, threshold) or smooth  # not by its neighbours alone
    inside = [k for k in plain if found[k][0].path in content]
    best = found[inside[0]][0]
    while best.parent is not None and not (best.first <= inside[0] and inside[-1] < best.last):
        best = best.parent
    while best.parent is not None and (best.tag in INLINE or best.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "tbody", "pre", "blockquote")):
        best = best.parent  # a container of blocks, not one of them
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or _with_headings(best, found, content)
    linked = {p for p, share in linked.items() if share > 0.5 and p not in content}
    keep = [k for k in plain if best.first <= k < best.last and (found[k][0].path not in linked or found[k][0].in_article and found[k][0].part)]
    return " ".join(found[k][1] for k in keep)


def _with_headings(best: _Element, found: list[tuple[_Element, str, int]], content: set[int]) -> _Element:
    """The outermost element around best that adds only headings, list items, blocks of content paths and, below the
    body, paragraphs of its own."""

    def belongs(k: int, around: _Element) -> bool:
        e = found[k][0]
        return not _is_plain(e) or e.path in content or e.part or (around.tag not in ("", "html", "body") and e.tag == "p" and e.parent is around)

    out, e = best, best.parent
    while e is not None and all(belongs(k, e) for k in (*range(e.first, out.first), *range(out.last, e.last))):
        out, e = e, e.parent
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 2_000_000, 1024):
        texts = [main_text(t) for t in texts_of(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
