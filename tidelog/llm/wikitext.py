"""The words of wiki text as a reader sees them.

``word_streams`` gives one or more sequences of words. The first is the page with
markup, hidden link targets, notes and comments taken out and values of template
parameters and table cells left in; templates that are notes by their name count as
notes. Notes and comments follow as sequences of their own, so that what they hold isn't
lost.

Pages come as revisions that share most of their lines. What follows from a line alone, its
folded form and its words, is kept in the caches that a caller hands on (cleared when full,
which costs time only).

Defined results: broken markup (a comment, note, link or template that isn't closed) is
treated as text with its signs dropped; null and empty texts give no words.
"""

from __future__ import annotations

import html
import re

from tidelog.llm.forms import caseless, lower, plain

WORD = re.compile(r"[^\W_]+")
WORD_WITH_MARKS = re.compile("(?:[^\\W_][\u0300-\u036f]*)+")
_MARK = re.compile("[\u0300-\u036f]")

_COMMENT = re.compile(r"<!--(.*?)-->", re.S)
_EMPTY_REF = re.compile(r"<ref\b[^<>]*/\s*>")
_REF = re.compile(r"<ref\b[^<>]*>(.*?)</ref\s*>", re.S)
_SUP_NOTE = re.compile(r"<sup\b[^<>]*>\s*\[[^\[\]<>]*\]\s*</sup\s*>")
_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\[\]]*+\s*+([^\[\]]*+)\]|https?://[^\s\[\]<>|]++")
_NAMED = re.compile(r"\s*+[^=\n]*+=")
_BREAK_TAG = re.compile(r"</?(?:br|div|p|li|ul|ol|tr|td|th|table|gallery|hr|blockquote|center|h[1-6]|dd|dt|dl|poem|pre)\b[^<>]*>")
_INLINE_TAG = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]*>")
_QUOTES = re.compile(r"'{2,5}")
_TABLE_LINE = re.compile(r"^[ \t:]*(?:\{\||\|-|\|\}).*$", re.M)
_CELL_STYLE = re.compile(r"^([|!]|.*?\|\||.*?!!)[ \t]*(?:[a-z-]+[ \t]*=[ \t]*(?:\"[^\"\n]*\"|'[^'\n]*'|\w+)[ \t]*)+\|(?!\|)", re.M)
_GALLERY_FILE = re.compile(r"^[^|\n\[\]{}<>]+\.(?:png|jpe?g|gif|svg|tiff?|webp|ogg|webm|pdf)\|", re.M)
_SWITCH = re.compile(r"__[a-z]+__")

# Templates that are notes on the words before them.
NOTES = {
    "citation needed", "cn", "fact", "dubious", "clarify", "when", "who", "which", "by whom", "according to whom", "vague",
    "page needed", "full citation needed", "clarification needed", "weasel inline", "specify", "update inline", "failed verification", "better source needed", "unreliable source?", "original research inline", "sic",
    "refn", "efn", "sfn", "rp", "note", "p.", "pp.",
}
_FILE = ("file:", "image:", "datei:", "bild:", "fichier:", "archivo:", "imagen:", "media:")
_HIDDEN = ("category:", "kategorie:", "catégorie:", "categoría:")


#: A parameter name longer than this may be text with a sign of equality: it is kept as a
#: sequence of its own besides.
NAME = 60

#: Visible characters at its beginning that a text under construction knows.
KNOWN = 64


class Parts(list):
    """A text under construction: strings and texts of this kind, put together once at the
    end, so that deep nesting takes linear time. ``start`` is its visible beginning."""

    __slots__ = ("start",)

    def __init__(self, *parts):
        super().__init__()
        self.start = ""
        for p in parts:
            self.add(p)

    def add(self, part) -> None:
        self.append(part)
        if len(self.start) < KNOWN:
            piece = part if isinstance(part, str) else part.start
            self.start += (piece if self.start else piece.lstrip())[: KNOWN - len(self.start)]

    def text(self) -> str:
        out, stack = [], [iter(self)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, str):
                    out.append(part)
                else:
                    stack.append(iter(part))
                    break
            else:
                stack.pop()
        return "".join(out)


def _joined(segments: list[Parts], between: str) -> Parts:
    out = Parts(*segments[:1])
    for s in segments[1:]:
        out.add(between)
        out.add(s)
    return out


def _link(segments: list[Parts]) -> Parts:
    """``segments`` are the parts between bars."""
    target, labels = segments[0], segments[1:]
    name = target.start.lstrip(":")
    if name.startswith(_FILE):
        return Parts(" ", labels[-1], " ") if labels else Parts(" ")
    if name.startswith(_HIDDEN) and not target.start.startswith(":"):
        return Parts(" ")
    label = _joined(labels, "|")
    return label if label.start else target


def _values(segments: list[Parts], asides: list[str]) -> Parts:
    values = []
    for s in segments[1:]:
        named = _NAMED.match(s[0]) if s and isinstance(s[0], str) else None
        if named:
            if len(named[0].strip()) > NAME:
                asides.append(s[0])
            s = Parts(s[0][named.end() :], *s[1:])
        values.append(s)
    return _joined(values, " ")


def _template(segments: list[Parts], asides: list[str]) -> Parts:
    values = _values(segments, asides)
    if segments[0].start.strip() in NOTES:
        asides.append(values.text())
        return Parts()
    return Parts(" ", values, " ")


# Links and templates that hold no others; most are of this kind and need no stack.
_PLAIN_LINK = re.compile(r"(?<!\[)\[\[([^\[\]|]*+)(?:\|([^\[\]|]*+))?\]\](?!\])")
_PLAIN_TEMPLATE = re.compile(r"(?<!\{)\{\{([^{}]*+)\}\}(?!\})")


def _plain_link(m: re.Match) -> str:
    target, label = m[1], m[2]
    start = target.lstrip()
    name = start.lstrip(":")
    if name.startswith(_FILE):
        return f" {label or ''} "
    if name.startswith(_HIDDEN) and not start.startswith(":"):
        return " "
    return label if label and not label.isspace() else target


def _plain_template(body: str, asides: list[str]) -> str:
    name, *values = body.split("|")
    for i, v in enumerate(values):
        named = _NAMED.match(v)
        if named:
            if len(named[0].strip()) > NAME:
                asides.append(v)
            values[i] = v[named.end() :]
    if name.strip() in NOTES:
        asides.append(" ".join(values))
        return ""
    return f" {' '.join(values)} "


_LINK_SIGNS, _TEMPLATE_SIGNS = re.compile(r"(\[\[|\]\])"), re.compile(r"(\{\{+|\}\}+)")


def _nested(text: str, signs: re.Pattern, put) -> str:
    """Replace bracketed parts from the inside out, in one pass; signs without a partner
    become blanks. Of a run of braces three close a parameter, if both sides have them, else
    two a template. ``put`` is given their number and the parts between bars."""
    stack: list[list] = [[0, [Parts()]]]
    for i, part in enumerate(signs.split(text)):
        opened, segments = stack[-1]
        if i % 2 == 0:
            if not opened:
                segments[0].append(part)
            elif part:
                first, *rest = part.split("|")
                segments[-1].add(first)
                segments += [Parts(x) for x in rest]
        elif part[0] in "[{":
            stack.append([len(part), [Parts()]])
        else:
            left = len(part)
            while left > 1 and len(stack) > 1:
                opened, segments = stack[-1]
                taken = 3 if min(opened, left) > 2 else 2
                node = put(taken, segments)
                left -= taken
                if opened - taken > 1:
                    stack[-1] = [opened - taken, [Parts(node)]]
                else:
                    stack.pop()
                    if opened > taken:
                        stack[-1][1][-1].add(" ")
                    stack[-1][1][-1].add(node)
            if left:
                stack[-1][1][-1].add(" ")
    return " ".join(_joined(segments, "|").text() for _, segments in stack)


def _closed(text: str, end: str, pattern: re.Pattern, put) -> str:
    """Replace up to the last ``end``: openings after it are never closed, and looking for
    their end each time would take quadratic time."""
    cut = text.rfind(end)
    if cut < 0:
        return text
    cut = text.find(">", cut) + 1 or len(text)
    return pattern.sub(put, text[:cut]) + text[cut:]


#: Lines that a cache keeps.
KEPT_LINES = 50_000


def _lowered(text: str, cache: dict[str, str]) -> str:
    """``forms.lower`` line by line."""
    if plain(text):
        return text.casefold()
    if len(cache) > KEPT_LINES:
        cache.clear()
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        low = cache.get(line)
        if low is None:
            low = cache[line] = lower(line)
        out.append(low)
    return "\n".join(out)


def _finish(text: str, cache: dict[str, list]) -> list[list]:
    if "<" in text:
        text = _INLINE_TAG.sub("", _BREAK_TAG.sub(" ", text))
    if "&" in text:
        text = lower(html.unescape(text))
    if len(cache) > KEPT_LINES:
        cache.clear()
    out = []
    for line in text.split("\n"):
        held = cache.get(line)
        if held is None:
            folded = caseless(line)
            held = cache[line] = [(WORD_WITH_MARKS if _MARK.search(folded) else WORD).findall(folded), None]
        if held[0]:
            out.append(held)
    return out


def word_streams(text: str | None) -> list[list[str]]:
    """Sequences of folded words; see the module text."""
    return [[w for words, _ in lines for w in words] for lines in line_streams(text, {}, {})]


def line_streams(text: str | None, lowered: dict[str, str], finished: dict[str, list]) -> list[list[list]]:
    """The same sequences as lists of lines, each ``[words, None]``: a line stands for all its
    copies, so a caller may keep in the second place what it makes of the words."""
    if not text:
        return []
    text = _lowered(text, lowered)
    asides: list[str] = []

    def aside(m: re.Match) -> str:
        asides.append(m[1])
        return ""

    if "<" in text:
        text = _closed(text, "-->", _COMMENT, aside)
        text = _EMPTY_REF.sub("", text)
        text = _closed(text, "</ref", _REF, aside)
        text = _SUP_NOTE.sub("", text)
        if "<gallery" in text:
            text = _GALLERY_FILE.sub("", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "{|" in text or "|-" in text:
        text = _CELL_STYLE.sub(r"\1 ", _TABLE_LINE.sub(" ", text))
    if "[[" in text:
        text = _PLAIN_LINK.sub(_plain_link, text)
    if "[[" in text:
        text = _nested(text, _LINK_SIGNS, lambda _, segments: _link(segments))
    if "//" in text:
        text = _EXTERNAL.sub(lambda m: " " + (m[1] or "") + " ", text)
    if "__" in text:
        text = _SWITCH.sub(" ", text)
    if "{{" in text:

        def brace(signs: int, segments: list[Parts]) -> Parts:
            return _joined(segments[1:], "|") if signs == 3 else _template(segments, asides)

        text = _PLAIN_TEMPLATE.sub(lambda m: _plain_template(m[1], asides), text)
        if "{{" in text:
            text = _nested(text, _TEMPLATE_SIGNS, brace)
    streams = [_finish(text, finished)]
    for a in asides:
        streams += line_streams(a, lowered, finished)
    return streams
