"""One pass over a page: tags, text and raw elements in order, and what stacks over them tell, in time that grows with the page's length only."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

RAW = ("script", "style", "noscript", "template")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: How far a tag may reach beyond its first > when a quote is open there.
QUOTED = 4096

_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"\s+")


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag's text, names in lower case, entities decoded; the first of a name counts."""
    out: dict[str, str] = {}
    name = _NAME.match(tag)
    for m in _ATTRIBUTE.finditer(tag, name.end() if name else 1):
        out.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


def _end(page: str, at: int, first: int) -> int:
    """Where a tag ends: at its first >, or at a later one near by if that lies within quotes."""
    gt = first
    while 0 <= gt < at + QUOTED:
        rest = page[at : gt + 1]
        if rest.count('"') % 2 == 0 and rest.count("'") % 2 == 0:
            return gt
        gt = page.find(">", gt + 1)
    return first


def tokens(page: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, text, start, end): kind is text, open, close, other (comments, declarations, what has no name) or raw.

    A raw element's text is its tag, and its content lies between start and end. An unclosed comment or raw element is a tag like any other;
    a < without any > after it is text.
    """
    low, at, missing = page.lower(), 0, set()
    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            yield "text", "", page[at:lt], at, lt
        if page.startswith("<!--", lt) and "-->" not in missing:
            done = page.find("-->", lt + 4)
            if done >= 0:
                yield "other", "", "", lt, done + 3
                at = done + 3
                continue
            missing.add("-->")
        gt = page.find(">", lt)
        if gt < 0:
            yield "text", "", page[lt:], lt, len(page)
            return
        gt = _end(page, lt, gt)
        tag = page[lt : gt + 1]
        at = gt + 1
        named = _NAME.match(tag)
        name = named[1].lower() if named else ""
        if not name:
            yield "other", "", tag, lt, at
        elif tag[1] == "/":
            yield "close", name, tag, lt, at
        elif name in RAW and name not in missing and not tag.endswith("/>"):
            done = low.find(f"</{name}", at)
            if done < 0:
                missing.add(name)
                yield "open", name, tag, lt, at
                continue
            yield "raw", name, tag, at, done
            gt = page.find(">", done)
            at = gt + 1 if gt >= 0 else len(page)
        else:
            yield "open", name, tag, lt, at
    if at < len(page):
        yield "text", "", page[at:], at, len(page)


MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
BREAKS = frozenset("br p div ul ol li tr table section article header footer nav main".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


class _Text:
    """Pieces of readable text with places kept for marks, which are put in when their element ends."""

    def __init__(self):
        self.pieces: list[str] = []
        self.marks: set[int] = set()
        self.weight = 0
        self.open: dict[str, list[tuple[int, int, str]]] = defaultdict(list)

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.weight += not text.isspace() and text != ""

    def start(self, name: str, more: str = "") -> None:
        self.open[name].append((len(self.pieces), self.weight, more))
        self.pieces.append("")

    def trim(self, first: int) -> None:
        """Takes the blanks at the start and at the end of what follows a place."""
        for step, strip, i in ((1, str.lstrip, first + 1), (-1, str.rstrip, len(self.pieces) - 1)):
            while first < i < len(self.pieces):
                self.pieces[i] = strip(self.pieces[i])
                if self.pieces[i]:
                    break
                i += step

    def end(self, name: str, before: str, after: str) -> None:
        """Marks around what came since the element's start; nothing where that is blank, or nothing was started."""
        if not self.open[name]:
            return
        at, weight, _ = self.open[name].pop()
        if at >= len(self.pieces) or weight == self.weight:
            return
        self.trim(at)
        self.marks.update((at, len(self.pieces)))
        self.pieces[at] = before
        self.pieces.append(after)

    def heading(self, name: str) -> None:
        """A heading's text has no marks; headings don't hold each other, so all that are open end here."""
        if not self.open[name]:
            return
        at, weight, _ = self.open[name][-1]
        for h in HEADINGS:
            self.open[h].clear()
        for i in range(at + 1, len(self.pieces)):
            if i in self.marks:
                self.marks.discard(i)
                self.pieces[i] = ""
        self.trim(at)
        self.pieces[at] = f"\n\n{'#' * int(name[1])} "
        self.pieces.append("\n\n")


def markdown(page: str | None) -> str | None:
    """Readable text of a page: headings, list items, links, bold and slanted print marked, one blank line at most between paragraphs.

    Entities come first, as pages hold markup that was escaped as a whole.
    """
    if page is None:
        return None
    out = _Text()
    for kind, name, text, _, _ in tokens(html.unescape(page)):
        if kind == "text":
            out.add(_BLANKS.sub(" ", text))
        elif name in MARKS or name == "a":
            if kind == "open":
                href = attributes(text).get("href") if name == "a" else ""
                if href is not None:
                    out.start(name, href)
            elif name == "a":
                link = out.open["a"][-1][2] if out.open["a"] else ""
                out.end("a", "[", f"]({link})")
            else:
                out.end(name, MARKS[name], MARKS[name])
        elif name in HEADINGS:
            out.start(name) if kind == "open" else out.heading(name)
        elif name in BREAKS:
            out.add("\n- " if name == "li" and kind == "open" else "\n")
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out.pieces).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in lines if x != "-")).strip()


def links(page: str | None) -> list[tuple[str, str]]:
    """(address, text) of a page's links, in order; a link ends at its end tag or where the next starts."""
    out, href, words = [], None, []
    for kind, name, text, _, _ in tokens(page or ""):
        if name == "a" and kind in ("open", "close"):
            if href is not None:
                out.append((href, " ".join("".join(words).split())))
            href, words = attributes(text).get("href") if kind == "open" else None, []
        elif kind == "text" and href is not None:
            words.append(html.unescape(text))
    if href is not None:
        out.append((href, " ".join("".join(words).split())))
    return out


def section(page: str | None, attribute: str, value: str) -> str | None:
    """The markup inside the first element with this attribute (for class: among its classes), up to its own end tag.

    Elements of the same name inside it are balanced. Null if there is no such element or it never ends; empty if it has no end tag.
    """
    inside, depth, start = None, 0, 0
    for kind, name, text, lo, hi in tokens(page or ""):
        if inside is None:
            if kind in ("open", "raw") and attribute in text:
                told = attributes(text).get(attribute)
                if told is not None and (value in told.split() if attribute == "class" else told == value):
                    if kind == "raw":
                        return page[lo:hi]
                    if name in VOID or text.endswith("/>"):
                        return ""
                    inside, depth, start = name, 1, hi
        elif name == inside and not (kind == "open" and text.endswith("/>")):
            depth += {"open": 1, "close": -1}.get(kind, 0)
            if depth == 0:
                return page[start:lo]
    return None


class Scope:
    """What the first schema.org JobPosting scope of a page says: values of its itemprops, in page order.

    Text is kept once, and a value is the stretch of it between an element's start and end.
    """

    WITHIN = ("jobLocation", "hiringOrganization")

    def __init__(self, page: str):
        self.words: list[str] = []
        self.weight = [0]
        #: (name, properties of WITHIN around it, content or None, first and last place of its text)
        self.values: list[list] = []
        open_: list[tuple[str, frozenset, int | None]] = []
        of_name: dict[str, list[int]] = defaultdict(list)
        for kind, name, text, _, _ in tokens(page):
            if kind == "open":
                self._start(name, text, open_, of_name)
            elif kind == "close" and of_name[name]:
                self._close(of_name[name][-1], open_, of_name)
                if not open_:
                    return
            elif kind == "text" and open_:
                self.words.append(html.unescape(text))
                self.weight.append(self.weight[-1] + bool(text.strip()))
        if open_:
            self._close(0, open_, of_name)

    def _start(self, name: str, text: str, open_: list, of_name: dict) -> None:
        told = attributes(text)
        if not open_ and not ("itemscope" in told and re.fullmatch(r"(?i)https?://schema\.org/JobPosting", told.get("itemtype", ""))):
            return
        around, at = (open_[-1][1], None) if open_ else (frozenset(), None)
        if open_ and (prop := told.get("itemprop")):
            at = len(self.values)
            self.values.append([prop, around, told.get("content"), len(self.words), len(self.words)])
            around = around | {prop} if prop in self.WITHIN else around
        if name not in VOID and not text.endswith("/>"):
            of_name[name].append(len(open_))
            open_.append((name, around, at))

    def _close(self, at: int, open_: list, of_name: dict) -> None:
        for name, _, value in open_[at:]:
            of_name[name].pop()
            if value is not None:
                self.values[value][4] = len(self.words)
        del open_[at:]

    def value(self, name: str, within: str | None = None) -> str | None:
        """The first value called `name`, below a property `within` if one is given; blanks squeezed, null if empty."""
        for prop, around, content, lo, hi in self.values:
            if prop == name and (within is None or within in around):
                if content is None and self.weight[lo] == self.weight[hi]:
                    continue
                if found := " ".join((content if content is not None else "".join(self.words[lo:hi])).split()):
                    return found
        return None
