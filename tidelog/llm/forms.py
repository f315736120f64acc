"""Forms of text: what a reader sees of a character, and look-alike letters.

``clean`` removes what can't be seen: full-width and half-width forms, composed or
combining accents, invisible characters of all planes, kinds of single blanks, and signs
and letters that exist twice within a script. ``fold`` also brings look-alike letters of
different scripts together; it serves comparisons only. ``lower`` and ``caseless`` do so
without case. Case, accents, raised digits, kinds of dash and the number of blanks and lines
are left as they are. A script is the first word of a letter's name in the character
database, so what is invisible, what is a letter and what belongs together by form or
decomposition follows from that database; the shapes, which it doesn't have, are listed.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of the same shape, in the scripts Latin, Cyrillic, Greek, Coptic,
# Armenian, Cherokee and Lisu, as far as they have one.
LOOK_ALIKES = """
A А Α Ꭺ ꓮ
B В Β Ⲃ Ᏼ ꓐ
C С Ϲ Ⲥ Ꮯ ꓚ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ
F ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ⲏ Ꮋ ꓧ
I І Ι Ⲓ ꓲ
J Ј Ϳ Ꭻ ꓙ
K К Κ Ⲕ Ꮶ ꓗ
L Ꮮ ꓡ
M М Μ Ⲙ Ꮇ ꓟ
N Ν Ⲛ ꓠ
O О Ο Ⲟ Օ ꓳ
P Р Ρ Ⲣ Ꮲ ꓑ
Q Ԛ
R Ꭱ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ⲧ Ꭲ ꓔ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Х Χ Ⲭ ꓫ
Y У Υ Ⲩ ꓬ
Z Ζ Ⲍ Ꮓ ꓜ
Æ Ӕ
Ə Ә
Ʒ Ӡ
Ɵ Ө
a а
c с ϲ ⲥ
d ԁ
e е
g ց
h һ հ
i і
j ј ϳ
l ӏ
n ո
o о ο ⲟ օ
p р ⲣ
q ԛ գ
s ѕ
u ս
v ѵ ν
w ԝ
x х ⲭ
y у
æ ӕ
ə ә
ʒ ӡ
ɵ ө
Г Γ Ⲅ
П Π Ⲡ
Ф Φ Ⲫ
к κ ⲕ
"""

# Signs and letters that exist twice in the same shape, and their usual one.
TWINS = {
    "µ": "μ", "ɡ": "g", "Ӏ": "I", "ʹ": "′", "ꞌ": "'", "։": ":", "׃": ":", "∶": ":", "꞉": ":", "․": ".", "‚": ",",
    "ǃ": "!", "ǀ": "|", "∣": "|", "⁄": "/", "∕": "/", "∗": "*", "へ": "ヘ", "Ð": "Đ", "Ɖ": "Đ", "Ү": "Y", "ү": "y",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}

# Code points that show nothing besides most of the category Cf.
UNSEEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
# Format characters (Cf) that do show something (signs before numbers).
SEEN_CF = {0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x0600, 0x0606)}

_SCRIPT_OF: dict[str, str | None] = {}


def script(c: str) -> str | None:
    """The script of a letter by its name; None for anything else."""
    if c not in _SCRIPT_OF:
        _SCRIPT_OF[c] = unicodedata.name(c, " ").split(" ")[0] or None if c.isalpha() else None
    return _SCRIPT_OF[c]


def _lines() -> list[list[str]]:
    return [line.split() for line in LOOK_ALIKES.strip().split("\n")]


#: Letter -> the members of its class by script.
CLASSES: dict[str, dict[str, str]] = {}
for _line in _lines():
    _members = {script(c): c for c in _line}
    CLASSES.update({c: _members for c in _line})

#: Scripts that have look-alikes; of equally frequent ones the first counts.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "COPTIC", "ARMENIAN", "CHEROKEE", "LISU")


def _table(fold: bool) -> dict[int, str | None]:
    """The translation of a decomposed text, made from the character database."""
    table: dict[int, str | None] = {}
    beyond = (o for o in range(0x3100, 0x20000) if unicodedata.category(chr(o)) == "Cf")
    for o in [*range(0x3100), *beyond, *range(0xFE00, 0x10000), *range(0xE0000, 0xE0200)]:
        c = chr(o)
        cat = unicodedata.category(c)
        if cat == "Zs" or c == "\t":
            table[o] = " "
        elif c in "\r\v\f\x85\u2028\u2029":
            table[o] = "\n"
        elif (cat == "Cf" and o not in SEEN_CF) or (cat == "Cc" and c != "\n") or 0xFE00 <= o < 0xFE10 or 0xE0100 <= o < 0xE01F0:
            table[o] = None
        elif 0xFF00 <= o < 0xFFF0 or 0x2F00 <= o < 0x2FD6:
            table[o] = unicodedata.normalize("NFKD", c)
    table.update({o: None for o in UNSEEN})
    table.update({ord(c): t for c, t in TWINS.items()})
    if fold:
        for c, members in CLASSES.items():
            table[ord(c)] = next(members[s] for s in SCRIPTS if s in members)
    return {o: t for o, t in table.items() if t != chr(o)}


_CLEAN, _FOLD = _table(False), _table(True)

#: Nu looks like v in small and like N in capital letters, and v isn't n: it stays itself,
#: and what compares words takes it for either (see ``leaks``).
NU = "ν"


def _closed() -> dict[int, str]:
    """The letters of a class and their small letters to one of them: where capitals look
    the same, the small ones are the same word in another case."""
    one: dict[str, str] = {}
    for line in _lines():
        small = [c.casefold() for c in line if c.casefold() != NU]
        to = next((one[c] for c in small if c in one), small[0])
        one.update({c: to for c in small})
    for c, t in TWINS.items():
        if t.isalpha():
            one[c.casefold()] = one.get(t.casefold(), t.casefold())
    small_of = ((o, chr(o).casefold()) for o in range(0x10000))
    return {o: one[c] for o, c in small_of if c in one and one[c] != chr(o)}


_LOWER, _CLOSED = {o: t for o, t in _FOLD.items() if chr(o).casefold() != NU}, _closed()

#: Texts without a character of this class are their own clean form and hold nothing
#: but Latin letters, kana and ideographs.
_UNSAFE = re.compile(
    "[^\n -~¡-¬®-´¶-ÏÑ-ƈƊ-ƿǁǂǄ-ɏ–—‘’“-„…"
    "、-〜ぁ-ふほ-ゖァ-ヺー一-鿿\U0001f600-\U0001f64f]"
)


def plain(text: str) -> bool:
    """True for a text that ``clean`` and ``fold`` leave as it is."""
    return _UNSAFE.search(text) is None


def clean(text: str) -> str:
    """The text as it is seen, letter shapes apart; idempotent."""
    if plain(text):
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_CLEAN))


def fold(text: str) -> str:
    """``clean`` with look-alike letters of all scripts brought to one."""
    if plain(text):
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_FOLD))


def lower(text: str) -> str:
    """``fold`` in small letters, with nu as it is."""
    if plain(text):
        return text.casefold()
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_LOWER)).casefold()


def caseless(text: str) -> str:
    """A text in small letters, with the letters brought together that look alike in
    either case."""
    if plain(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_CLOSED))
