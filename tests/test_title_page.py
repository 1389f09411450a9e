"""Every line of the title page."""

from quire.operators.export import HEIGHT, SIZES, layout


def test_long_titles_and_authors_stay_whole():
    title, author = " ".join(f"word{k}" for k in range(30)), " ".join(f"Name{k}" for k in range(25))
    (page,) = layout(title, author, [])
    for kind, text in (("title", title), ("author", author)):
        lines = [(y, x) for y, own, x in page if own == kind]
        assert len(lines) > 1 and " ".join(x for _, x in lines) == text
        assert all(b[0] - a[0] == SIZES[kind][1] for a, b in zip(lines, lines[1:], strict=False))
    assert min(y for y, kind, _ in page if kind == "author") > max(y for y, kind, _ in page if kind == "title")


def test_short_ones_stand_where_they_stood():
    assert layout("T", "A", []) == [[(HEIGHT / 3, "title", "T"), (HEIGHT / 3 + 16, "author", "A")]]
