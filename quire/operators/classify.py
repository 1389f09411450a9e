"""Chapter classification: position, title and content rules, first match wins.

The rules are data: (reason, positions, condition). Conditions come in stages,
so that no stage's generated code grows too large: prepared columns, one
boolean column per predicate, then one CASE over plain booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dialect import SparkOps, SqlOps, count_true, either

S = SparkOps


# ------------------------------------------------------------------ position and file names


def position(index: Column, total: Column) -> Column:
    """start, middle or end of a book; of overlapping ranges start wins."""
    first = F.greatest(F.lit(3), F.ceil(total * F.lit(0.2)))
    last = total - F.greatest(F.lit(2), F.ceil(total * F.lit(0.15)))
    return F.when(index < first, "start").when(index >= last, "end").otherwise("middle")


def skip_reason(ops, path):
    """Why a file is no chapter by its name; null if it may be one."""
    name = ops.replace(ops.lower(path), r"^[\s\S]*\/", "")
    name = ops.cases([(name != "", name)], ops.lower(path))
    cover = ops.contains(name, "cover") & ~ops.contains(name, "discover")
    (first, pattern), *rest = P.SKIPPED_FILES
    return ops.cases([(ops.match(name, pattern) | cover, first), *[(ops.match(name, p), r) for r, p in rest]])


# ------------------------------------------------------------------ content predicates


def lines_of(ops, trimmed):
    """Non-blank lines, trimmed."""
    return ops.keep(ops.transform(ops.split(trimmed, r"\n+"), ops.trim), lambda x: x != "")


def _share(ops, lines, test):
    return ops.ratio(ops.size(ops.keep(lines, test)), ops.size(lines))


#: A text without any of these has no line of a book list.
_BOOK_TEXT = r"isbn|€|\$|\d{3}-\d|erh|ersch|avail|taschenbuch|hardcover|paperback|e-?book|h.rbuch|audiobook|auch"


def prepared(ops, content) -> dict:
    """What several predicates read, as columns of their own: each is computed once. Lines only of short contents."""
    body = ops.trim(content)
    return {"c_body": body, "c_low": ops.lower(content)}


def measured(ops) -> dict:
    """Second stage of ``prepared``: length and lines of the trimmed content; lines of the whole only where a book list is possible."""
    body, low = ops.name("c_body"), ops.name("c_low")
    short = ops.cases([(ops.length(body) <= 5000, body)], "")
    return {"c_n": ops.length(body), "c_lines": lines_of(ops, short), "c_plain": lines_of(ops, ops.cases([(ops.match(low, _BOOK_TEXT), low)], ""))}


def predicates(ops, title, mode="compat"):
    """Named conditions on a chapter with prepared columns (``title`` trimmed): the content rules and what guards them."""
    body, low, n, lines = (ops.name(c) for c in ("c_body", "c_low", "c_n", "c_lines"))
    low_title, count = ops.lower(title), ops.size(lines)
    toc = _share(ops, lines, lambda x: ops.match(x, P.TOC_LINES, True)) > 0.4
    short_form = (_share(ops, lines, lambda x: ops.length(x) < 60) > 0.7) & (_share(ops, lines, lambda x: ops.match(x, P.SENTENCE_BREAK) | (ops.length(x) > 120)) < 0.1)
    cased = _share(ops, lines, lambda x: ops.match(x, P.TITLE_CASE_LINE) & (ops.length(x) < 80)) > 0.5
    plain = ops.name("c_plain")
    book_line = lambda x: either([*[ops.contains(x, w) for w in P.BOOK_LINE_PARTS], ops.match(x, P.BOOK_LINES, True)])
    opening, thanks = ops.head(low, 500), ops.head(low, 800)
    first = ops.coalesce(ops.first(lines), "" if ops is SqlOps else F.lit(""))
    dedicated = ops.match(ops.lower(first), P.DEDICATION_LINES, True)
    if mode == "fixed":
        dedicated = dedicated | ops.match(first, P.DEDICATION_NAME_LINE)
    return {
        "is_toc": (n >= 50) & (n <= 3000) & (count >= 3) & (_share(ops, lines, lambda x: ops.length(x) < 80) > 0.6) & toc,
        "is_promo": (n <= 3000) & (count_true(ops, [ops.match(low, p, True) for p in P.PROMO_SIGNALS]) >= 2),
        "is_author_list": (n >= 100) & (n < 5000) & (count >= 5) & short_form & (cased | ops.match(low_title, P.BY_SOMEONE)),
        "is_short_rights": (n < 200) & either([ops.contains(low, w) for w in P.SHORT_RIGHTS_PHRASES]),
        "is_book_list": (ops.size(plain) >= 3) & (_share(ops, plain, book_line) > 0.3),
        "is_preview": either([*[ops.contains(opening, w) for w in P.PREVIEW_PHRASES], ops.match(opening, P.FIRST_CHAPTER, True)]),
        "is_rights": (n < 1500) & (count_true(ops, [ops.match(low, p) for p in P.RIGHTS_SIGNALS]) >= 2),
        "is_dedication": (n <= 500) & (count <= 10) & dedicated,
        "is_epigraph": (n >= 30) & (n <= 1200) & ops.match(body, P.ATTRIBUTION) & (ops.match(body, P.QUOTED) | (n < 400)),
        "is_biography": (n < 2500) & (count_true(ops, [ops.match(low, p, True) for p in P.BIOGRAPHY_SIGNALS]) >= 2),
        "is_thanks": (n < 4000) & ops.match(thanks, P.THANKS, True),
        "is_editorial": (n < 8000) | ops.match(ops.head(low, 1500), P.EDITOR_OPENINGS, True) | ops.match(ops.tail(low, 500), P.EDITOR_CLOSING),
    }


def title_forms(ops, title):
    """A lower-cased title, and the same without a leading chapter number."""
    low = ops.lower(title)
    return low, ops.trim(ops.replace(low, P.NUMBERED_TITLE, "", True))


def title_predicates(ops, title, mode="compat"):
    low, bare = title_forms(ops, title)
    named = {
        "toc": P.TOC_TITLES, "copyright": P.COPYRIGHT_TITLES, "foreword": P.FOREWORD_TITLES, "dedication": P.DEDICATION_TITLES, "epigraph": P.EPIGRAPH_TITLES,
        "praise": P.PRAISE_TITLES, "about_book": P.ABOUT_BOOK_TITLES, "about_author": P.ABOUT_AUTHOR_TITLES, "thanks": P.ACKNOWLEDGEMENT_TITLES,
        "preview": P.PREVIEW_TITLES, "also_by": P.ALSO_BY_TITLES, "newsletter": P.NEWSLETTER_TITLES, "glossary": P.GLOSSARY_TITLES, "cover": P.COVER_TITLES,
    }
    out = {f"t_{k}": ops.match(low, p) | ops.match(bare, p) for k, p in named.items()}
    out["t_by"] = ops.match(low, P.BY_AUTHOR_TITLES)
    if mode == "fixed":
        out["t_by"] = out["t_by"] | ops.match(title, P.BY_NAME_TITLE)
    out["t_introduction"] = (low == "introduction") | (bare == "introduction")
    main = ops.cases([(bare != "", bare)], low)
    out["t_index"], out["t_bibliography"] = ops.match(main, P.INDEX_TITLES, True), ops.match(main, P.BIBLIOGRAPHY_TITLES, True)
    return out


# fixed values: reasons in order of precedence, the positions where they hold (s start, m middle, e end), their conditions
RULES = (
    ("table of contents (content-detected)", "s", ("is_toc",)),
    ("publisher promo/newsletter", "sme", ("is_promo",)),
    ("also by this author (content-detected)", "s", ("is_author_list",)),
    ("table of contents", "sme", ("t_toc",)),
    ("copyright notice", "sme", ("t_copyright",)),
    ("also by this author", "sme", ("t_by",)),
    ("foreword/introduction", "s", ("t_foreword", "t_introduction", "is_editorial")),
    ("foreword/preface", "s", ("t_foreword", "!t_introduction")),
    ("dedication", "s", ("t_dedication",)),
    ("epigraph", "s", ("t_epigraph",)),
    ("praise/reviews", "s", ("t_praise",)),
    ("about the book", "s", ("t_about_book",)),
    ("about the author", "se", ("t_about_author",)),
    ("acknowledgements", "se", ("t_thanks",)),
    ("book preview", "se", ("t_preview",)),
    ("book suggestions", "se", ("t_also_by",)),
    ("publisher promo/newsletter", "se", ("t_newsletter",)),
    ("glossary", "se", ("t_glossary",)),
    ("index", "e", ("t_index",)),
    ("bibliography", "e", ("t_bibliography",)),
    ("cover/title page", "s", ("t_cover",)),
    ("copyright/publisher info (short)", "se", ("is_short_rights", "many_chapters")),
    ("book list/advertisements", "e", ("is_book_list",)),
    ("book preview (content-detected)", "e", ("is_preview",)),
    ("copyright (content-detected)", "s", ("is_rights",)),
    ("dedication (content-detected)", "s", ("is_dedication",)),
    ("epigraph (content-detected)", "s", ("is_epigraph",)),
    ("about the author (content-detected)", "se", ("is_biography",)),
    ("acknowledgements (content-detected)", "se", ("is_thanks",)),
)
_PLACES = {"s": "start", "m": "middle", "e": "end"}


def reason(ops, place, flag):
    """The CASE over flags: ``flag(name)`` gives a condition."""
    pairs = []
    for text, where, names in RULES:
        tests = [flag(n) if n[0] != "!" else ~flag(n[1:]) for n in names]
        if where != "sme":
            tests.insert(0, either([place == _PLACES[w] for w in where]))
        condition = tests[0]
        for t in tests[1:]:
            condition = condition & t
        pairs.append((condition, text))
    return ops.cases(pairs)


def with_position(chapters: DataFrame, book: str = "book_id", index: str = "chapter_idx") -> DataFrame:
    """Adds n_chapters and position.

    The count comes from an aggregate that is joined back, not from a window:
    Spark broadcasts the counts while they are small, and then chapters are
    neither shuffled nor sorted, however many a single book has.
    """
    total = chapters.groupBy(book).agg(F.count("*").alias("n_chapters"))
    joined = chapters.join(total.withColumnRenamed(book, "_book"), F.col(book).eqNullSafe(F.col("_book"))).drop("_book")
    return joined.withColumn("position", position(F.col(index), F.col("n_chapters")))


def classify(chapters: DataFrame, *, title: str = "title", content: str = "content", mode: str = "compat") -> DataFrame:
    """Adds ``filter_reason`` (null: keep) to chapters with position and n_chapters.

    ``mode="fixed"`` adds the two patterns that "compat" keeps dead for
    compatibility. Null titles and contents count as empty. All native.
    """
    if mode not in ("compat", "fixed"):
        raise ValueError("mode is compat or fixed")
    names = chapters.columns
    rows = chapters.withColumns({"_t": S.trim(F.coalesce(title, F.lit(""))), "_c": F.coalesce(content, F.lit(""))})
    rows = rows.withColumns(title_predicates(S, F.col("_t"), mode))
    rows = with_predicates(rows, F.col("_t"), F.col("_c"), mode).withColumn("many_chapters", F.col("n_chapters") > 5)
    return rows.select(*[c for c in names if c != "filter_reason"], reason(S, F.col("position"), F.col).alias("filter_reason"))


def with_predicates(rows: DataFrame, title: Column, content: Column, mode: str = "compat") -> DataFrame:
    """Adds the prepared columns and one boolean column per content predicate."""
    return rows.withColumns(prepared(S, content)).withColumns(measured(S)).withColumns(predicates(S, title, mode))


def predicates_sql(rows: str, title: str, content: str, mode: str = "compat") -> str:
    """The same over a query, as SQL."""
    from ..functions.dialect import Sql

    stages = [prepared(SqlOps, Sql(content)), measured(SqlOps), predicates(SqlOps, Sql(title), mode)]
    for stage in stages:
        rows = f"select *, {', '.join(f'{v} as {k}' for k, v in stage.items())} from ({rows})"
    return rows


def classify_sql(chapters: str, mode: str = "compat") -> str:
    """The same as SQL over a query with book_id, chapter_idx, title, content."""
    from ..functions.dialect import Sql

    titles = ",\n    ".join(f"{v} as {k}" for k, v in title_predicates(SqlOps, Sql("t"), mode).items())
    return f"""
with chapters as ({chapters}),
placed as (
  select *, case when chapter_idx < greatest(3, ceil(n_chapters * 0.2)) then 'start'
    when chapter_idx >= n_chapters - greatest(2, ceil(n_chapters * 0.15)) then 'end' else 'middle' end as position
  from (select *, count(*) over (partition by book_id) as n_chapters from chapters)),
ready as (select *, {SqlOps.trim(SqlOps.coalesce(Sql("title"), ""))} as t, coalesce(content, '') as c, n_chapters > 5 as many_chapters from placed),
flagged as (select *,
    {titles}
  from ({predicates_sql("select * from ready", "t", "c", mode)})),
classified as (select book_id, chapter_idx, title, content, n_chapters, position, {reason(SqlOps, Sql("position"), Sql)} as filter_reason from flagged)
"""
