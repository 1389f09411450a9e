"""Widths of the characters of the standard sans-serif faces, and lines that fit a width."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# fixed values: advance widths of the faces in thousandths of the font size, for the characters from space to tilde
REGULAR = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
# fixed values: (regular, bold) widths of characters that are no accented letters of the above
OTHERS = {
    "ß": (611, 611), "Æ": (1000, 1000), "æ": (889, 889), "Ø": (778, 778), "ø": (611, 611), "Œ": (1000, 1000), "œ": (944, 944), "Ð": (722, 722), "ð": (556, 611), "Þ": (667, 667), "þ": (556, 611),
    "„": (333, 500), "“": (333, 500), "”": (333, 500), "‚": (222, 278), "‘": (222, 278), "’": (222, 278), "«": (556, 556), "»": (556, 556), "‹": (333, 333), "›": (333, 333),
    "–": (556, 556), "—": (1000, 1000), "…": (1000, 1000), "•": (350, 350), "·": (278, 278), "€": (556, 556), "£": (556, 556), "¥": (556, 556), "§": (556, 556), "¶": (537, 556),
    "©": (737, 737), "®": (737, 737), "™": (1000, 1000), "°": (400, 400), "¿": (611, 611), "¡": (333, 333), "×": (584, 584), "÷": (584, 584), "±": (584, 584), "\xa0": (278, 278),
}
#: The slanted face has the widths of the regular one.
FACES = {"regular": REGULAR, "bold": BOLD, "italic": REGULAR}


@lru_cache(1 << 16)
def width(char: str, face: str = "regular") -> int:
    """Thousandths of the font size. Accented letters are as wide as their letters; what the faces lack is printed as a question mark."""
    bold = face == "bold"
    if char in OTHERS:
        return OTHERS[char][bold]
    base = unicodedata.normalize("NFD", char)[0]
    at = ord(base) - 32
    return FACES[face][at if 0 <= at < len(REGULAR) and len(char.encode("cp1252", "ignore")) else ord("?") - 32]


def text_width(text: str, size: float, face: str = "regular") -> float:
    """Points."""
    return sum(width(c, face) for c in text) * size / 1000


def wrap(text: str, room: float, size: float, face: str = "regular") -> list[str]:
    """Lines of whole words that are no wider than ``room`` points, as many words in each as fit; words that are wider are cut."""
    most, space, out = room * 1000 / size, width(" ", face), []
    for paragraph in text.split("\n"):
        line, used, begin = "", 0, len(out)
        for word in paragraph.split():
            wide = sum(width(c, face) for c in word)
            if line and used + space + wide <= most:
                line, used = f"{line} {word}", used + space + wide
                continue
            if line:
                out.append(line)
            while wide > most:
                end, held = 0, 0
                while end < len(word) and (not end or held + width(word[end], face) <= most):
                    held += width(word[end], face)
                    end += 1
                out.append(word[:end])
                word, wide = word[end:], wide - held
            line, used = word, wide
        if line or len(out) == begin:
            out.append(line)
    return out
