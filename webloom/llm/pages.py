"""Pages as lines: what stands on each line of an HTML page, and in which branch of its tree.

A page is split at line feeds and read once from the start. Scripts, styles, comments and the head are blanked, tags
move through a stack of containers, and every line with visible text becomes a leaf below the innermost container that
is open where its text begins. Unclosed and crossed tags are allowed: a closing tag closes everything opened since its
partner, one without a partner closes nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)")
_HEAD_OPEN = re.compile(r"(?is)<head\b(?:(?!</head).)*?(?=<body\b)")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\n|\Z)")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>")
_ANY_TAG = re.compile(r"<[/!?A-Za-z][^<>]*(?:>|$)")
_LINK = re.compile(r"(?is)<a\b[^>]*>(.*?)(?:</a\s*>|$)")
_WORD = re.compile(r"[^\W_]+")
#: What stands between lines of a page that are read together, and what else parts words: in ASCII and outside.
_CUT = "\0"
_BLANKS, _ODD = bytes(i if i > 127 or i == 0 or chr(i).isalnum() else 32 for i in range(256)), re.compile(r"[^\x00-\x7f\w]")
#: What separates the parts of a line, and ends of sentences.
_BARS, _ENDS = ("|", "·", "•", " » ", " › ", " > ", " / "), (". ", "! ", "? ", "。 ")
_DATELIKE = re.compile(r"\d[./-]\d").search
_DIGIT = re.compile(r"\d").search
#: Both open with a set of characters, which is searched for faster than a repeat or a border.
_NUMBER = re.compile(r"\d\d*")
_NAME = re.compile(r"[A-ZÀ-ÖØ-ÞА-Я](?<!\w.)[\w'-]*")
_NAMED = re.compile(r"(?i)(?:class|id|style|width|colspan)\s*=\s*[\"']?([^\"'>]*)")
_LANG = re.compile(r"(?i)lang\s*=\s*[\"']?([A-Za-z]+)")
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
_SEPARATORS, _DASH = "|·•/,;~+*=»›#", re.compile(r"\s-\s")

#: Longest line (in words) that has a form.
FORM_WORDS = 16
CONTAINERS = frozenset("div nav aside article main section footer header table tr td th ul ol dl form fieldset menu".split())
#: Elements that by their meaning, and names that by custom, hold menus, side matter or footers.
SIDE_TAGS = frozenset("nav aside footer menu".split())
SIDE_NAMES = re.compile(r"(?i)\b(?:nav|navbar|menu|sidebar|footer|site-footer|breadcrumbs?|cookie|banner|share|newsletter|related|advert)\b")
MAIN_TAGS = frozenset("article main".split())


@dataclass(slots=True)
class Line:
    no: int
    text: str
    #: The text in lower case with single spaces.
    norm: str
    words: list[str]
    links: int
    link_words: int
    container: int
    dated: bool
    separators: int
    segments: list[str]
    #: The text with numbers, names and the site's own names masked.
    form: str


@dataclass
class Page:
    title: str = ""
    lang: str = ""
    lines: list[Line] = field(default_factory=list)
    #: Of each container its parent (-1: none), its tag with class or id, and whether it is side matter by its name.
    parents: list[int] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    side: list[bool] = field(default_factory=list)
    #: Of each container its children in order: the styles of containers, and of lines by the first tag on them.
    children: list[list[str]] = field(default_factory=list)


@lru_cache(1 << 14)
def _container(tag: str, attrs: str) -> tuple[str, bool]:
    """A container's tag with its class, id or form, and whether that makes it side matter."""
    name = " ".join(_NAMED.findall(attrs)) if attrs.strip() else ""
    return f"{tag}.{name}" if name else tag, tag in SIDE_TAGS or bool(name and SIDE_NAMES.search(name))


def visible(fragment: str) -> str:
    return html.unescape(_ANY_TAG.sub(" ", fragment)) if "<" in fragment or "&" in fragment else fragment


def _blank(m: re.Match) -> str:
    return "\n" * m.group().count("\n")


def segments(text: str, names: tuple[str, ...] = ()) -> list[str]:
    """The parts of a line between separators and sentence ends, in lower case, numbers as ``#``, the site's names as ``@``."""
    return _segments(" ".join(text.casefold().split()), names)


def _segments(text: str, names: tuple[str, ...]) -> list[str]:
    for n in names:
        if n in text:
            text = text.replace(n, "@")
    return _segments_of(_parted(text))


def _parted(text: str) -> str:
    """Text with numbers as ``#`` and a line feed after each part."""
    if _DIGIT(text):
        text = _NUMBER.sub("#", text)
    for bar in _BARS:
        if bar in text:
            text = text.replace(bar, "\n")
    for end in _ENDS:
        if end in text:
            text = text.replace(end, end[0] + "\n")
    return text


def _segments_of(text: str) -> list[str]:
    # A part without letters is nothing but the number of a list item.
    return [s for x in text.split("\n") if (s := x.strip(" .:!?|")).strip("#-()[]")]


def form(text: str, names: tuple[str, ...] = ()) -> str:
    """A line without what differs between sites: numbers as ``#``, capitalized words as ``^``, the site's names as ``@``."""
    out = " ".join(text.split())
    if names and any(n in (low := out.casefold()) for n in names):
        for n in names:
            if n in low:
                out = re.sub(re.escape(n), "@", out, flags=re.I)
    return _masked(out)


def _masked(text: str) -> str:
    return _NAME.sub("^", _NUMBER.sub("#", text) if _DIGIT(text) else text)


def site_names(title: str, host: str) -> tuple[str, ...]:
    """What the site calls itself: the end of its title and the main label of its host."""
    names = {title.rsplit(" - ", 1)[1].strip().casefold()} if " - " in title else set()
    labels = [x for x in host.casefold().split(".") if len(x) > 3]
    if labels:
        names.add(max(labels[:-1] or labels, key=len))
    return tuple(sorted((n for n in names if len(n) > 3), key=len, reverse=True))


class _Scan:
    """What a line says by itself: the containers it opens (tag, style, whether side matter) and closes (tag), in order, and its text."""

    __slots__ = ("dated", "form", "lang", "link_words", "links", "norm", "ops", "segments", "separators", "style", "text", "text_at", "words")

    def __init__(self, raw: str, shells: bool = True) -> None:
        if (first := raw.find("<")) < 0:
            self.ops, self.text_at, self.style, self.lang, self.words = [], 0, "", "", []
            text = raw
        else:
            # Most lines are text between two tags that recur.
            head, last = raw.find(">", first) + 1, raw.rfind("<")
            last = last if last > first else len(raw)
            if shells and head and raw.find("<", first + 1, last) < 0 and not (text := raw[head:last]).isspace() and text and (not first or raw[:first].isspace()):
                self.ops, self.text_at, self.style, self.lang, before, after = _shell(raw[:head], raw[last:])
                self.words = []
                text = before + text + after
            else:
                text = self._tags(raw)
        self.text = html.unescape(text) if "&" in text else text
        links = [len(_WORD.findall(visible(x))) for x in _LINK.findall(raw)] if "<a" in raw or "<A" in raw else []
        self.links, self.link_words = len(links), sum(links)

    def _tags(self, raw: str) -> str:
        """What the line has besides its text; the line with blanks for tags."""
        self.ops: list[tuple[str, str, bool] | str] = []
        #: How many of these stand before the first text; the style of the first other tag; the language of <html>.
        self.text_at, self.style, self.lang = -1, "", ""
        self.words: list[str] = []
        found, style = _TAG.split(raw), None
        parts = iter(found)
        for before, close, tag, attrs in zip(parts, parts, parts, parts):
            if self.text_at < 0 and before and not before.isspace():
                self.text_at = len(self.ops)
            tag = tag.lower()
            if tag in CONTAINERS:
                self.ops.append(tag if close else (tag, *_container(tag, attrs)))
            elif style is None and not close:
                style = _container(tag, attrs)[0]
                if tag == "html" and (lang := _LANG.search(attrs)):
                    self.lang = lang.group(1).lower()
        self.style = style or ""
        if self.text_at < 0:
            self.text_at = len(self.ops)
        text = " ".join(found[::4])
        return _ANY_TAG.sub(" ", raw) if "<" in text else text


@lru_cache(1 << 12)
def _shell(head: str, tail: str) -> tuple[list, int, str, str, str, str]:
    """What a line that opens with the tag ``head``, closes with ``tail`` and has text between says besides it: as ``_Scan``, and what stands for both in the text."""
    scan = _Scan(f"{head}x{tail}", shells=False)
    return scan.ops, scan.text_at, scan.style, scan.lang, _ANY_TAG.sub(" ", head), _ANY_TAG.sub(" ", tail)


def _read(scans: list[_Scan]) -> None:
    """What the text of these lines says, read together: a pattern is searched for once in all of them."""
    joined = f" {_CUT} ".join([s.text for s in scans])
    alone = len(scans) == 1
    if not alone and joined.count(_CUT) >= len(scans):
        for s in scans:
            _read([s])
        return
    cut = (lambda x: [x]) if alone else (lambda x: [y.strip() for y in x.split(_CUT)])
    folded = " ".join(joined.casefold().split())
    if alone and _CUT in folded:
        found = [_WORD.findall(folded)]
    else:
        spaced = (folded if folded.isascii() else _ODD.sub(" ", folded)).encode().translate(_BLANKS).decode()
        found = [x.split() for x in ([spaced] if alone else spaced.split(_CUT))]
    kept, norms = [], []
    for s, words, norm in zip(scans, found, cut(folded)):
        s.words = words
        if words:
            kept.append(s)
            norms.append(norm)
    if not kept:
        return
    dates, dashes = _DATELIKE(joined) is not None, "-" in joined
    separators = [x for x in _SEPARATORS if x in joined]
    #: Segments are as they are where none of the site's names is in the line.
    parted = _parted(_CUT.join(norms))
    for s, norm, parts in zip(kept, norms, [parted] if alone else parted.split(_CUT)):
        text = s.text
        s.norm, s.segments, s.form = norm, _segments_of(parts), ""
        s.dated = dates and _DATELIKE(text) is not None and _DATE.search(text) is not None
        s.separators = sum(map(text.count, separators)) + (len(_DASH.findall(text)) if dashes and "-" in text else 0)
    short = [s for s in kept if len(s.words) <= FORM_WORDS]
    if short:
        masked = _masked(" ".join(f" {_CUT} ".join([s.text for s in short]).split()))
        for s, shape in zip(short, cut(masked)):
            s.form = shape


#: Longest line whose scan is remembered, and how many are: menus, notices and lines of tags recur.
REMEMBERED, MOST_REMEMBERED = 120, 1 << 14
#: Those of late, and those before, which are forgotten unless they recur.
_late: dict[str, _Scan] = {}
_before: dict[str, _Scan] = {}


def _scans(lines: list[str]) -> list[_Scan]:
    global _late, _before
    out, new = [], []
    try:
        for raw in lines:
            scan = _late.get(raw)
            if scan is None:
                scan = _before.get(raw)
                if scan is None:
                    new.append(scan := _Scan(raw))
                if len(raw) <= REMEMBERED:
                    _late[raw] = scan
            out.append(scan)
        if new:
            _read(new)
    except BaseException:
        _late = {}  # some may not be read yet
        raise
    if len(_late) > MOST_REMEMBERED // 2:
        _late, _before = {}, _late
    return out


_form = lru_cache(1 << 13)(form)


def parse(page: str, host: str = "") -> Page:
    """The lines with visible text outside the head, numbered from 1."""
    out = Page()
    if m := _TITLE.search(page):
        out.title = " ".join(html.unescape(m.group(1)).split())
    body = _DROPPED.sub(_blank, _HEAD_OPEN.sub(_blank, page) if "</head" not in page.lower() else page)
    names = site_names(out.title, host)
    stack: list[tuple[str, int]] = []
    parents, styles, sides, children, lines = out.parents, out.styles, out.side, out.children, out.lines
    numbered = [(no, raw) for no, raw in enumerate(body.split("\n"), 1) if raw and not raw.isspace()]
    for (no, _), scan in zip(numbered, _scans([raw for _, raw in numbered])):
        at, text_at = -1, scan.text_at
        if not text_at:
            at = stack[-1][1] if stack else -1
        for i, op in enumerate(scan.ops, 1) if scan.ops else ():
            if type(op) is str:
                for j in range(len(stack) - 1, -1, -1):
                    if stack[j][0] == op:
                        del stack[j:]
                        break
            else:
                tag, style, side = op
                parents.append(stack[-1][1] if stack else -1)
                if stack:
                    children[stack[-1][1]].append(style)
                styles.append(style)
                sides.append(side)
                children.append([])
                stack.append((tag, len(parents) - 1))
            if i == text_at:
                at = stack[-1][1] if stack else -1
        if scan.lang:
            out.lang = scan.lang
        words = scan.words
        if not words:
            continue
        if at >= 0:
            children[at].append(scan.style)
        parts, shape, norm = scan.segments, scan.form, scan.norm
        for n in names:
            if n in norm:
                parts, shape = _segments(norm, names), _form(scan.text, names) if shape else ""
                break
        lines.append(Line(no, scan.text, norm, words, scan.links, scan.link_words, at, scan.dated, scan.separators, parts, shape))
    return out
