"""Main text of HTML pages by tag-path ratios.

A page is cut into tags and text. Every text belongs to a tag path, root to leaf, with the element names and class
words on it; links and other inline elements belong to the path of their block. Over a page, each path gathers the
length of its text, how many lines it has, and its punctuation; the text ratio (length per line) and the punctuation
ratio (marks per line) are smoothed over the page's lines with a Gaussian window, fused (product of the two and of the
share of text outside links in the line's block element; items share that of their list), weighed by names, and compared
with a threshold, a part of the page's mean line, in which each line counts by its length and its names. Nothing
is dropped before that but scripts, styles and the like and what is hidden. Names weigh in the fusion: next to nothing under
elements that never hold main text (navigation, header, footer, forms, notices, comments and so on: by element name, role,
or a whole class or id); half under one of their class words in a compound (cookie-bar, but not no-sidebar); more under
article or main, but less than would hide text outside that is as dense.

What the ratios keep brings back what belongs to it, never from under such names: headings, paragraphs, items, quotes,
listings, cells and captions in the same container (lists and tables are no containers of their own); in an article or
main with kept text, whatever else stands there. A block stays or goes as a whole: outside article and main one that is nearly all links
goes, unless it is a heading, paragraph, quote or listing.

Text is decoded, white space inside a block becomes one space, blocks are joined in page order by one space.

Of a header element within an article or main its headings stay; other headers go.

Defined cases: null or empty html, or a page without main text, gives an empty text and n_chars 0; very long, very deep or
broken pages take time and memory in proportion to their length; markup that ends early is read as far as it goes; a script or the like that never ends goes up to the next block or to the page's end;
formulas are read, without their annotations; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: A tag up to its end; a quote counts only as a value's, and one without an end is a character like others.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>")
#: The same where a quoted value runs to the page's end.
BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"(?<![-\w:.])([A-Za-z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
CUT = re.compile(r"<[A-Za-z/!?]")
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "annotation", "annotation-xml", "xmp", "noembed", "noframes", "object", "select", "canvas", "audio", "video"}
#: Of these, elements whose content is text alone: the first end tag ends them, whatever stands before it.
RAW_TEXT = {"script", "style", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
#: A formula is read as part of its line.
MATH = {"math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "menclose", "mfenced"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text; all others begin and end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | MATH
NEVER = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "input"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar", "tablist"}
#: Words of class and id values.
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|footer|header|masthead|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|reply|replies|discussion|disqus|widget|pagination|pager|toolbar|search|skip|hidden)(?:$|[\s_-])", re.I)
MAIN = {"article", "main"}
#: A whole class or id that is one of them drops an element; as part of a compound it only lowers the path's score.
WHOLE = re.compile(MARKS.pattern.replace(r"[\s_-]", r"\s"), re.I)
#: Compounds that tell what is around or missing.
ABOUT = re.compile(r"(?:^|(?<=\s))(?:no|not|non|without|has|have|with|show|hide)[_-]\S*", re.I)
#: A path with such a compound against others; above the threshold, so that it is kept where it is the usual text.
PART_WEIGHT = 0.5
#: One under a listed name: it would have to be hundreds of times as dense as the page's text.
NAME_WEIGHT = 0.002
#: A path under article or main against others; below 1 / threshold, so that an equally dense path outside is kept.
MAIN_WEIGHT = 1.5
#: Least share outside links there: marked text that is all links is little, not nothing.
MAIN_PLAIN = 0.1
#: Share of link text beyond which a block outside them goes.
LINKED = 0.8
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORDY = HEADS | {"p", "blockquote", "pre"}
BESIDE = WORDY | {"li", "td", "th", "dt", "dd", "caption", "figcaption", "summary"}
#: Steps from a container down to its text.
PART = BESIDE | {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "hgroup", "details"}
#: Opening one of the first ends an open one of the second, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: A raw element without an end goes at most to here.
BREAK = re.compile(rf"</?(?:{'|'.join(sorted(ENDS_P | {'body', 'head', 'html', 'li', 'td', 'th', 'tr'}))})(?=[\s/>])", re.I)
PUNCT = re.compile(r"[.,;:!?…。，、؟¿¡«»\"“”()-]")
SPACES = re.compile(r"\s+")


def decoded(text: str) -> str:
    return entities.unescape(text) if "&" in text else text


def raw_ends(page: str, name: str, end: int) -> dict[int, int]:
    """Where each element of this name begins and where its end tag ends, nested ones matched; no tag ends after `end`."""
    opened, ends = [], {}
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*+>", re.I).finditer(page, 0, end):
        if not m[1]:
            if not (name == "svg" and m[0].endswith("/>")):
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


class Paths:
    """The tag paths of a page as a tree: each knows its last element, the one above it, and what names stand on the way."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.above, self.name, self.main, self.named = [-1], [""], [-1], [False]

    def below(self, up: int, name: str, words: str, marked: bool, named: bool = False) -> int:
        """named: whether a listed name stands on it or above; paths with and without are different ones."""
        got = self.number.get((up, step := f"{name}.{words}{'!' * named}"))
        if got is None:
            got = self.number[up, step] = len(self.name)
            self.above.append(up)
            self.name.append(name)
            self.named.append(named)
            # The outermost article or main that it is in.
            self.main.append(self.main[up] if self.main[up] >= 0 else got if marked else -1)
        return got


class Stack:
    """Open elements, and where the last ones of a name are, so that no tag walks past elements that it leaves open."""

    def __init__(self):
        # name, path, hidden, in a link, block element, part of a class listed, listed name (2: an article's own header)
        self.open: list[tuple[str, int, bool, bool, int, bool, int]] = []
        self.at: dict[str, list[int]] = {}
        self.solid: list[int] = []  # elements other than inline ones and p

    def push(self, entry: tuple[str, int, bool, bool, int, bool, int]) -> None:
        self.at.setdefault(entry[0], []).append(len(self.open))
        if entry[0] not in INLINE and entry[0] != "p":
            self.solid.append(len(self.open))
        self.open.append(entry)

    def cut(self, i: int) -> None:
        for name, *_ in reversed(self.open[i:]):
            self.at[name].pop()
        while self.solid and self.solid[-1] >= i:
            self.solid.pop()
        del self.open[i:]

    def last(self, names) -> int:
        return max((x[-1] for n in names if (x := self.at.get(n))), default=-1)

    def close(self, name: str) -> None:
        if (i := self.last((name,))) >= 0:
            self.cut(i)

    def make_room(self, name: str) -> None:
        """Ends what an element of this name ends by beginning."""
        if name in ENDS_P and (i := self.last(("p",))) > (self.solid[-1] if self.solid else -1):
            self.cut(i)
        if name in CLOSES:
            ends, stop = CLOSES[name]
            if (i := self.last(ends)) > self.last(stop):
                self.cut(i)


def nodes_of(page: str) -> tuple[list[tuple[str, int, bool, bool, int, int, float]], Paths]:
    """(text, path, hidden, in a link, line number, block element, weight of names) of every text node, in page
    order, and the paths. Linear in the page's length, whatever is in it."""
    paths, stack = Paths(), Stack()
    out, block, elements, at, size, tag = [], 0, 0, 0, len(page), TAG
    last = page.rfind(">")
    endless: set[str] = set()
    matched: dict[str, dict[int, int]] = {}

    def add(raw: str) -> None:
        if raw:
            _, path, hidden, link, element, partly, named = stack.open[-1] if stack.open else ("", 0, False, False, 0, False, 0)
            out.append((decoded(raw), path, hidden, link, block, element, NAME_WEIGHT if named else PART_WEIGHT if partly else 1.0))

    text = 0  # where the text that is read begins
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            cut = CUT.search(page, at)  # a tag that never ends
            add(page[text : cut.start()] if cut and not page.startswith(("<!--", "<![CDATA["), cut.start()) else page[text : cut.start() if cut else size])
            break
        mark = page[begin + 1 : begin + 2]
        if mark in ("!", "?"):
            long = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], begin)), ("<", ">"))
            end = page.find(long[1], begin + len(long[0]))
            add(page[text:begin])
            at = text = end + len(long[1]) if end >= 0 else size
            continue
        m = tag.match(page, begin)
        if not m and tag is TAG and (mark.isalpha() and mark.isascii() or mark == "/"):
            m = BARE.match(page, begin)
            if m:
                tag = BARE
        if not m:
            at = begin + 1
            continue
        add(page[text:begin])
        at = text = m.end()
        name = m[2].lower()
        if name not in INLINE:
            block += 1
        if m[1]:
            stack.close(name)
            continue
        if name in VOID:
            continue
        if name in ("svg", "math") and m[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            if name in RAW_TEXT:
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                stop = end.end() if end else 0
                if not end:
                    endless.add(name)
            else:
                if name not in matched:
                    matched[name] = raw_ends(page, name, last + 1)
                stop = matched[name].get(begin, 0)
            if not stop:
                end = BREAK.search(page, at)
                stop = end.start() if end else size
            at = text = stop
            continue
        stack.make_room(name)
        if m[3].rstrip().endswith("/") and name not in INLINE and name not in ENDS_P:
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m[3])} if m[3] else {}
        words = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        _, path, hidden, link, element, partly, named = stack.open[-1] if stack.open else ("", 0, False, False, 0, False, 0)
        told = words and name not in ("body", "html", "main")
        marked = name in MAIN or attrs.get("role") == "main"
        own = name == "header" and not named and paths.main[path] >= 0
        if named == 2 and name in HEADS:
            named = 0
        elif own:
            named = 2
        elif name in NEVER or attrs.get("role", "").lower() in ROLES or bool(told and WHOLE.search(words)):
            named = 1
        hidden = hidden or bool(m[3]) and ("hidden" in m[3].split() or "hidden" in attrs) or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
        partly = partly or bool(told and MARKS.search(ABOUT.sub("", words)))
        if name not in INLINE:
            path = paths.below(path, name, words, marked, named > 0)
            elements += 1
            element = element if name in ("li", "dt", "dd") else elements
        stack.push((name, path, hidden, link or name == "a", element, partly, named))
    return out, paths


class Statistics:
    """What a page's texts say of each tag path: lengths, lines and punctuation, and of each block: its text and link text."""

    def __init__(self, nodes: list[tuple], paths: Paths):
        self.length, self.lines, self.marks, self.linked = ({} for _ in range(4))
        self.share: dict[int, list[float]] = {}
        first: dict[tuple[int, int], tuple] = {}
        for x in nodes:
            text, path, _, link, block, element, _ = x
            long, of = len(text.strip()), self.share.setdefault(element, [0.0, 0.0])
            self.length[path] = self.length.get(path, 0) + long
            self.marks[path] = self.marks.get(path, 0) + len(PUNCT.findall(text))
            self.linked[path] = self.linked.get(path, 0) + long * link
            of[0] += long
            of[1] += long * link
            if (path, block) not in first:
                first[path, block] = x
                self.lines[path] = self.lines.get(path, 0) + 1
        #: The first node of every line.
        self.first, self.paths = list(first.values()), paths

    def plain(self, x: tuple) -> float:
        """Share of text outside links in the block of a line."""
        s = self.share[x[5]]
        return max(1 - s[1] / s[0], MAIN_PLAIN if self.paths.main[x[1]] >= 0 else 0.0)


def ratio_kept(s: Statistics, threshold: float, sigma: float) -> set[int]:
    """The paths whose smoothed and fused ratios reach the threshold."""
    of = np.array([x[1] for x in s.first])
    text = np.array([s.length[p] / s.lines[p] for p in of.tolist()])
    marks = np.array([s.marks[p] / s.lines[p] for p in of.tolist()])
    plain = np.array([(MAIN_WEIGHT if s.paths.main[x[1]] >= 0 else 1.0) * s.plain(x) for x in s.first])
    names = np.array([x[6] for x in s.first])
    reach = np.arange(-2, 3)
    window = np.exp(-(reach**2) / (2 * sigma**2))
    norm = np.convolve(np.ones(len(of)), window, "full")[2:-2]
    long = text * names
    text, marks = (np.convolve(v, window, "full")[2:-2] / norm for v in (text, marks))
    fused = text * (marks + 0.1) * plain
    path, at = np.unique(of, return_inverse=True)
    mean = np.bincount(at, fused * names) / np.bincount(at)
    # In the bar a listed name takes a line's say, not its score, so that a page of nothing else keeps nothing.
    bar = (fused * np.where(names == NAME_WEIGHT, 1.0, names) * long).sum() / long.sum()
    return set(path[(mean > 0) & (mean >= threshold * bar)].tolist())


def neighbours(s: Statistics, kept: set[int]) -> set[int]:
    """Headings, paragraphs and the like in a container of kept text; in an article or main with kept text, all but what has a listed name."""
    above, name, main, named = s.paths.above, s.paths.name, s.paths.main, s.paths.named
    holders: dict[int, int] = {}

    def holder(p: int) -> int:
        """The first element above that is no part of a list or table."""
        up, way = above[p], []
        while up > 0 and name[up] in PART and up not in holders:
            way.append(up)
            up = above[up]
        found = holders.get(up, up)
        holders.update(dict.fromkeys(way, found))
        return found

    around, mains = {holder(p) for p in kept}, {main[p] for p in kept if main[p] >= 0}
    return {p for p in s.length if not named[p] and (main[p] in mains if main[p] >= 0 else name[p] in BESIDE and holder(p) in around)}


def main_text(page: str | None, threshold: float = 0.6, sigma: float = 0.6) -> str:
    every, paths = nodes_of(page or "")
    nodes = [x for x in every if not x[2]]
    solid = [x for x in nodes if x[0].strip()]
    if not solid:
        return ""
    s = Statistics(solid, paths)
    kept = ratio_kept(s, threshold, sigma)
    kept |= neighbours(s, kept)
    blocks: list[str] = []
    now, held = None, []
    for text, path, _, _, block, element, _ in nodes:
        if text.strip() and (path not in kept or paths.main[path] < 0 and paths.name[path] not in WORDY and s.share[element][1] > LINKED * s.share[element][0]):
            continue
        if block != now:
            blocks.append("".join(held))
            now, held = block, []
        held.append(text)
    blocks.append("".join(held))
    return " ".join(x for x in (SPACES.sub(" ", b).strip() for b in blocks) if x)


def _run(batches):
    for b in batches:
        text = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))
