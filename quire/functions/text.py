"""Text normalisation, all native.

Each function uses its input once: Catalyst inlines expressions into one
another, and doubled inputs would grow without bound. What is needed twice is
bound by ``let``. Steps that few texts need stand behind a cheap test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import SPACE, SPACE_NOT_NEWLINE, SPACE_RE2, SparkOps, SqlOps, java, let

S = SparkOps
_CLOSED = f"(?=[{SPACE}.,;:!?\"'„‚“”‘’«»‹›)\\]—–…]|\\z)"
#: Possessive repetition runs in a loop, so runs of any length leave Java's stack alone; the condition
#: on what follows a letter stands inside the loop, since nothing can be given back.
_SPACED_RUN = f"(?<=^|[{SPACE}\"'„‚“”‘’«»‹›(\\[—–])(\\p{{L}}(?: {{1,4}}\\p{{L}}{_CLOSED}){{2,}}+)"
#: Every run holds this; few texts do.
_MAYBE_SPACED = "\\p{L} {1,4}\\p{L} {1,4}\\p{L}(?!\\p{L})"
#: ASCII marks and letters, the most of any text, are told from white space by one comparison.
_WIDE_GAP = f"[[^!-~]&&[{SPACE_NOT_NEWLINE}]]{{2,}}"
#: Every word of 80 or more holds this; few texts do. From the start over shorter words, each character once.
_MAYBE_LONG = "\\A(?:[^ \\n]{0,79}+[ \\n])*+[^ \\n]{80}"
_BEGIN, _END = "\ufdd0", "\ufdd1"  # no characters; they never occur in texts


def fix_letter_spacing(x: Column) -> Column:
    """Close up runs of three or more single letters one to four spaces apart; wider gaps part words.

    A run starts at a line's start or after white space or an opening mark, and
    ends before white space, a closing mark or the end.
    """
    close = lambda run: F.array_join(F.transform(F.split(run, " {2,}", -1), lambda w: F.replace(w, F.lit(" "), F.lit(""))), " ")

    def closed(text):
        parts = F.split(F.regexp_replace(text, _SPACED_RUN, f"{_BEGIN}$1{_END}"), f"[{_BEGIN}{_END}]", -1)
        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, close(p)).otherwise(p)), "")

    joined = let(x, lambda text: F.when(text.rlike(_MAYBE_SPACED), closed(text)).otherwise(text))
    return _one_space(joined)


def _one_space(x: Column) -> Column:
    return F.regexp_replace(x, _WIDE_GAP, " ")


# ------------------------------------------------------------------ entities


def decode_named(ops, x):
    """Named entities, one after the other: what an earlier one gives, a later one may read."""
    for name, char in P.ENTITIES:
        x = ops.swap(x, name, char)
    return x


def _numeric(x: Column, mark: str, digits: str, base: int) -> Column:
    """References like ``&#65;`` to characters; what is no character goes."""
    one = f"(?s)^{mark}0*({digits}{{1,8}});.*"

    def put(part):
        code = F.conv(F.regexp_extract(part, one, 1), base, 10).cast("bigint")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, f"^{mark}{digits}+;", "")
        good = part.rlike(one) & (code > 0) & (code < 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(~part.rlike(f"^{mark}{digits}+;"), part).when(good, F.concat(char, rest)).otherwise(rest)

    return F.array_join(F.transform(F.split(x, f"(?={mark}{digits}+;)", -1), put), "")


def decode_entities(x: Column) -> Column:
    """Named entities, then decimal, then hexadecimal references."""
    number = lambda y: _numeric(_numeric(y, "&#", "[0-9]", 10), "&#x", "[0-9a-fA-F]", 16)
    marked = lambda y, mark, decoded: F.when(F.contains(y, F.lit(mark)), decoded).otherwise(y)
    named = let(x, lambda y: marked(y, "&", decode_named(S, y)))
    return let(named, lambda y: marked(y, "&#", number(y)))


def _numeric_sql(x, mark: str, digits: str, value: str):
    """The same as SQL: ``value`` turns the digits of reference ``p`` into a number."""
    code = f"try_cast({value} as bigint)"
    good = f"{code} between 1 and {0x10FFFF - 1} and not {code} between {0xD800} and {0xDFFF}"
    char = f"case when regexp_matches(p, '^{mark}{digits}+;') then case when {good} then chr(cast({code} as int)) else '' end else p end"
    return type(x)(f"array_to_string(list_transform(regexp_extract_all({x}, '{mark}{digits}+;|[^&]+|&'), lambda p: {char}), '')")


def decode_entities_sql(x):
    """``decode_entities`` as SQL."""
    named = decode_named(SqlOps, x)
    decimal = _numeric_sql(named, "&#", "[0-9]", "regexp_extract(p, '[0-9]+')")
    return _numeric_sql(decimal, "&#x", "[0-9a-fA-F]", "('0x' || regexp_extract(p, '^&#x0*([0-9a-fA-F]+);', 1))")


# ------------------------------------------------------------------ normal forms


def trim_lines(ops, x):
    return ops.join(ops.transform(ops.split(x, "\n"), ops.trim), "\n")


def _clean(ops, x, spacing):
    x = ops.replace(x, P.INVISIBLE, "")
    x = ops.swap(x, P.SOFT_HYPHEN, "")
    x = ops.replace(x, P.WIDE_SPACE, " ")
    x = ops.swap(x, P.NO_BREAK_SPACE, " ")
    x = spacing(x)  # leaves no two spaces in a row
    x = trim_lines(ops, x)
    x = ops.replace(x, r"\n{3,}", "\n\n")
    return ops.trim(x)


def normalize(x: Column, letter_spacing: bool = True) -> Column:
    """Text ready for translation: no invisible characters, plain spaces, at most one blank line. Null becomes empty."""
    return _clean(S, F.coalesce(x, F.lit("")), fix_letter_spacing if letter_spacing else _one_space)


def normalize_sql(x) -> str:
    """The same as SQL, without letter spacing."""
    return _clean(SqlOps, SqlOps.coalesce(x, ""), lambda y: SqlOps.replace(y, r"[^\S\n]{2,}", " "))


def normalize_for_export(x: Column, letter_spacing: bool = True) -> Column:
    """``normalize``; over-long words broken after every 40 characters; dashes and quotes that plain fonts have."""
    x = _break_words(normalize(x, letter_spacing))
    return let(x, lambda text: F.when(text.rlike("--|[„‚«»‹›]"), _export_marks(S, text)).otherwise(text))


def _break_words(x: Column) -> Column:
    """A space after every 40 characters of words of 80 or more: the first 40 of such a word, then each 40 right behind.

    The expression looks back at every character, so it reads only the pieces
    between spaces that may be such words.
    """
    broken = lambda piece: F.regexp_replace(piece, java(r"(?:(?<!\S)(?=\S{80})|\G(?!\A)(?<=\S))(\S{40})"), "$1 ")
    pieces = lambda text: F.transform(F.split(text, " ", -1), lambda piece: F.when(F.length(piece) >= 80, broken(piece)).otherwise(piece))
    return let(x, lambda text: F.when(text.rlike(_MAYBE_LONG), F.array_join(pieces(text), " ")).otherwise(text))


def _break_words_sql(x):
    """The same as SQL, word by word."""
    words = f"regexp_extract_all({x}, '[{SPACE_RE2}]+|[^{SPACE_RE2}]+')"
    broken = f"case when length(w) >= 80 and regexp_matches(w, '^[^{SPACE_RE2}]') then regexp_replace(w, '((?s:.){{40}})', '\\1 ', 'g') else w end"
    return type(x)(f"array_to_string(list_transform({words}, lambda w: {broken}), '')")


def normalize_for_export_sql(x) -> str:
    """``normalize_for_export`` as SQL, without letter spacing."""
    return _export_marks(SqlOps, _break_words_sql(normalize_sql(x)))


def _export_marks(ops, x):
    x = ops.replace(x, r"(\s)--(\s)", "$1—$2")
    x = ops.replace(x, "[„‚«»]", '"')
    return ops.replace(x, "[‹›]", "'")


def compare_key(ops, x):
    """Form in which titles and lines are compared."""
    return ops.trim(ops.replace(ops.replace(ops.lower(x), P.COMPARE_DROPS, ""), r"\s+", " "))
