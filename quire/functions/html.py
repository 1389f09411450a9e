"""Markup to text, and a chapter's title from markup, text and file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import SparkOps, SqlOps
from .text import decode_entities, decode_entities_sql, normalize, normalize_sql, trim_lines

S = SparkOps


def _strip(ops, x):
    x = ops.replace(x, r"<script[^>]*>[\s\S]*?<\/script>", "", True)
    x = ops.replace(x, r"<style[^>]*>[\s\S]*?<\/style>", "", True)
    x = ops.replace(x, r"<!--[\s\S]*?-->", "")
    x = ops.replace(x, P.BLOCK_TAGS, "\n", True)
    return ops.replace(x, r"<[^>]+>", "")


def _tidy(ops, x):
    x = ops.replace(x, r"\n\s*\n\s*\n", "\n\n")
    x = ops.replace(x, r"[ \t]+", " ")
    return ops.trim(trim_lines(ops, x))


def html_to_text(html: Column, *, letter_spacing: bool = True) -> Column:
    """Plain text of a chapter's markup, normalised. Null becomes empty.

    Without ``letter_spacing`` spaced letters stay apart.
    """
    return normalize(_tidy(S, decode_entities(_strip(S, F.coalesce(html, F.lit(""))))), letter_spacing)


def html_to_text_sql(html) -> str:
    """The same as SQL, without letter spacing."""
    return normalize_sql(_tidy(SqlOps, decode_entities_sql(_strip(SqlOps, SqlOps.coalesce(html, "")))))


def clean_title(raw: Column) -> Column:
    """Tags to spaces, white space collapsed, entities decoded; empty if nothing is left."""
    return decode_entities(_bare_title(S, raw))


def clean_title_sql(raw) -> str:
    """The same as SQL."""
    return decode_entities_sql(_bare_title(SqlOps, raw))


def _bare_title(ops, raw):
    return ops.trim(ops.replace(ops.replace(raw, r"<[^>]+>", " "), r"\s+", " "))


def _filled(ops, x):
    """Null instead of an empty text."""
    return F.nullif(x, F.lit("")) if ops is SparkOps else type(x)(f"nullif({x}, '')")


def title_candidates(ops, html, text, path, number, decode):
    """The six sources of a title in order of trust; each null if it says nothing."""
    heading = _filled(ops, decode(_bare_title(ops, ops.extract(html, P.HEADING, 1, True))))
    tag = decode(_bare_title(ops, ops.extract(html, P.TITLE_TAG, 1, True)))
    tag = ops.cases([((tag != "") & (ops.length(tag) < 80) & ~ops.match(tag, P.GENERIC_TITLE, True), tag)])
    tokens = ops.split(ops.lower(ops.extract(html, P.CLASS_ATTRIBUTE, 1, True)), r"\s+")
    named = ops.transform(tokens, lambda t: ops.cases([(ops.match(t, p), title) for title, p in P.CLASS_TITLES]))
    by_class = ops.first(ops.keep(named, lambda t: ~ops.is_null(t)))
    kind = ops.lower(ops.extract(html, P.TYPE_ATTRIBUTE, 1, True))
    by_type = ops.cases([(ops.match(kind, p), title) for title, p in P.TYPE_TITLES])
    base = ops.replace(ops.replace(ops.lower(file_name(ops, path)), r"\.(x?html?|xhtml)$", ""), "[-_]", " ")
    by_name = ops.cases([(ops.match(base, p), title if title else capitalised(ops, ops.trim(ops.replace(base, r"\s+", " ")))) for title, p in P.FILE_TITLES])
    line = ops.first(ops.keep(ops.transform(ops.split(text, "\n"), ops.trim), lambda x: (x != "") & (ops.length(x) < 120)))
    return [heading, tag, by_class, by_type, by_name, ops.head(line, 80), ops.concat("Chapter " if ops is SqlOps else F.lit("Chapter "), ops.text(number))]


def file_name(ops, path):
    return ops.replace(path, r"^[\s\S]*\/", "")


def capitalised(ops, x):
    """Each word's first letter upper-cased."""
    if ops is SparkOps:
        return F.array_join(F.transform(F.split(x, "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    return ops.join(ops.transform(ops.split(x, " "), lambda w: type(x)(f"(upper(substr({w}, 1, 1)) || substr({w}, 2))")), " ")


def chapter_title(html: Column, text: Column, path: Column, number: Column) -> Column:
    """First source of a title that says something. ``number`` counts chapters from 1; ``html`` and ``path`` may be empty."""
    html, text, path = (F.coalesce(c, F.lit("")) for c in (html, text, path))
    return F.coalesce(*title_candidates(S, html, text, path, number, decode_entities))


def chapter_title_sql(html, text, path, number) -> str:
    html, text, path = (SqlOps.coalesce(c, "") for c in (html, text, path))
    return SqlOps.coalesce(*title_candidates(SqlOps, html, text, path, number, decode_entities_sql))
