"""Lines by the widths of the faces."""

import random
import re
import zlib

import pytest

from quire.functions.metrics import BOLD, REGULAR, text_width, width, wrap
from quire.operators import export as E


def test_widths():
    assert len(REGULAR) == len(BOLD) == 95
    assert [width(c) for c in "Ai.W@~"] == [667, 222, 278, 944, 1015, 584] and [width(c, "bold") for c in "Ai.W@~"] == [722, 278, 278, 944, 975, 584]
    assert width("ä") == width("a") and width("Ü", "bold") == width("U", "bold") and width("ß") == 611 and width("—") == 1000
    assert width("日") == width("?") and width("\x07") == width("?") and width("ő") == width("?")  # not in the faces' encoding
    assert text_width("Helvetica", 12) == pytest.approx((722 + 556 + 222 + 500 + 556 + 278 + 222 + 500 + 556) * 12 / 1000)


def test_breaks_by_hand():
    # at size 10: "aaa" is 16.68 points, a space 2.78, "iii" 6.66
    assert wrap("aaa aaa aaa", 36.14, 10) == ["aaa aaa", "aaa"] and wrap("aaa aaa aaa", 36.13, 10) == ["aaa", "aaa", "aaa"]
    assert wrap("iii iii iii iii", 34.9, 10) == ["iii iii iii", "iii"]
    assert wrap("aaaaaaa b", 20.0, 10) == ["aaa", "aaa", "a b"] and wrap("W", 1.0, 10) == ["W"]
    assert wrap("a\n\nb", 100, 10) == ["a", "", "b"] and wrap("", 100, 10) == [""]
    # the same words need more lines in bold
    text = "Every paragraph needs more room in bold. " * 20
    assert len(wrap(text, 300, 11, "bold")) > len(wrap(text, 300, 11))


@pytest.mark.parametrize("seed", range(5))
def test_no_line_is_too_wide_and_none_too_short(seed):
    pick = random.Random(seed)
    words = ["".join(pick.choice("iWmläß日-.x") for _ in range(pick.choice([1, 3, 8, 20, 150]))) for _ in range(300)]
    room = (E.WIDTH - 2 * E.MARGIN) * E._MM
    for kind in ("body", "heading", "title", "author"):
        lines, size, face = E.wrap(" ".join(words), kind), E.SIZES[kind][0], E.FACE_OF.get(kind, "regular")
        assert "".join(lines).replace(" ", "") == "".join(words)
        assert max(text_width(x, size, face) for x in lines) <= room + 1e-9
        lines = E.wrap(" ".join(w for w in words if len(w) <= 8), kind)
        for line, after in zip(lines, lines[1:]):  # the next word would not have fitted
            assert text_width(f"{line} {after.split()[0]}", size, face) > room


def test_pages_use_three_faces_and_centre_the_title_page():
    pages = E.layout("A Title", "Someone", [("Heading", "Some text. " * 100)], "de")
    raw = E.pdf(pages)
    assert all(b"/BaseFont /" + f in raw for f in (b"Helvetica ", b"Helvetica-Bold ", b"Helvetica-Oblique "))
    streams = [zlib.decompress(m) for m in re.findall(rb"stream\n(.*?)\nendstream", raw, re.S)]
    title = re.search(rb"/F2 24 Tf ([\d.]+) [\d.]+ Td \(A Title\)", streams[0])
    middle = float(title[1]) + text_width("A Title", 24, "bold") / 2
    assert middle == pytest.approx(E.WIDTH * E._MM / 2, abs=0.02)
    assert b"/F3 14 Tf" in streams[0] and b"/F2 18 Tf 56.69" in streams[1] and b"/F1 11 Tf 56.69" in streams[1]
