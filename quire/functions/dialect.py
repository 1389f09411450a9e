"""One notation for expressions that exist both as Spark columns and as DuckDB SQL.

Rules are written once against these operations. As ``SparkOps`` they are
native columns for Catalyst; as ``SqlOps`` they are the text of the oracle,
which another engine with another regular-expression library then runs.

Patterns are written with the meaning they have in ECMAScript: white space is
Unicode white space, word bounds are ASCII, ``$`` is the very end. ``java``
turns them into what Java's engine needs for that, ``re2`` into what DuckDB's needs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of ECMAScript's ``\\s`` and ``trim``.
SPACE = "\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
SPACE_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_NOT_NEWLINE = SPACE.replace("\\n", "")
_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_NO_WORD_BEFORE, _NO_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_ANY = r"[^\n\r\u2028\u2029]"
SPACE_RE2 = re.sub(r"\\u([0-9A-F]{4})|\\x([0-9A-F]{2})", lambda m: f"\\x{{{m[1] or m[2]}}}", SPACE)
_SPACE_NOT_NEWLINE_RE2 = SPACE_RE2.replace("\\n", "")
_ANY_RE2 = r"[^\n\r\x{2028}\x{2029}]"


def _alternatives(group: str) -> list[str]:
    """Top-level alternatives of what stands between a group's brackets."""
    out, depth, inside, begin, i = [], 0, False, 0, 0
    while i < len(group):
        c = group[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(group[begin:i])
            begin = i + 1
        i += 1
    return [*out, group[begin:]]


def _begins_with_word(pattern: str) -> bool:
    """Whether whatever the pattern matches surely begins with an ASCII letter or digit."""
    if not pattern.startswith("("):
        return pattern[:1].isascii() and pattern[:1].isalnum() and pattern[1:2] not in {"?", "*", "{"}
    depth, inside, i = 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                break
        i += 1
    body = pattern[1:i].removeprefix("?:")
    return pattern[i + 1 : i + 2] not in {"?", "*", "{"} and not body.startswith("?") and all(_begins_with_word(x) for x in _alternatives(body))


def _ends_with_letters(pattern: str) -> bool:
    """Whether whatever the pattern matches surely ends with an ASCII letter: two plain letters, or a group of such alternatives."""
    if pattern.endswith(")") and not pattern.endswith("\\)"):
        depth = 0
        for i in range(len(pattern) - 1, -1, -1):
            if pattern[i] in "()" and pattern[i - 1 : i] != "\\":
                depth += 1 if pattern[i] == ")" else -1
                if not depth:
                    body = pattern[i + 1 : -1].removeprefix("?:")
                    return "[" not in body and not body.startswith("?") and all(_ends_with_letters(x) for x in _alternatives(body))
        return False
    return len(pattern) > 1 and pattern[-2:].isascii() and pattern[-2:].isalpha() and pattern[-3:-2] != "\\"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Java's engine."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            i += 2
            if pair == "\\s":
                out.append(SPACE if inside else f"[{SPACE}]")
            elif pair == "\\S" and not inside:
                out.append(f"[^{SPACE}]")
            elif pair == "\\b" and not inside:
                # one look instead of four where the neighbour in the pattern says which side holds the word
                out.append(_NO_WORD_BEFORE if _begins_with_word(pattern[i:]) else _NO_WORD_AFTER if _ends_with_letters(pattern[: i - 2]) else _BOUND)
            else:
                out.append(pair)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[":
            c = "\\["
        elif c == "]":
            inside = False
        elif c == "&" and inside:
            c = "\\&"
        elif not inside and c == "$":
            c = "\\z"
        elif not inside and c == ".":
            c = _ANY
        out.append(c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for DuckDB's engine, whose own ``\\s`` is ASCII and whose ``.`` leaves out the newline only."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith(("[\\s\\S]", "[^\\S\\n]"), i):
            whole = pattern.startswith("[\\s\\S]", i)
            out.append("(?s:.)" if whole else f"[{_SPACE_NOT_NEWLINE_RE2}]")
            i += 6 if whole else 7
            continue
        if c == "\\":
            pair = pattern[i : i + 2]
            i += 2
            if pair == "\\s":
                out.append(SPACE_RE2 if inside else f"[{SPACE_RE2}]")
            elif pair == "\\S":
                if inside:
                    raise ValueError(f"no form for {pattern!r}")
                out.append(f"[^{SPACE_RE2}]")
            else:
                out.append(pair)
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]":
            inside = False
        elif c == "." and not inside:
            c = _ANY_RE2
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def any_of(patterns) -> str:
    return patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns)


def let(x: Column, f) -> Column:
    """``f`` of ``x`` with ``x`` evaluated once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


class SparkOps:
    """Expressions as Spark columns."""

    @staticmethod
    def name(column: str):
        return F.col(column)

    @staticmethod
    def lit(value):
        return F.lit(value)

    @staticmethod
    def match(x: Column, patterns, ignore_case: bool = False) -> Column:
        return x.rlike(java(any_of(patterns), ignore_case))

    @staticmethod
    def contains(x: Column, part: str) -> Column:
        return F.contains(x, F.lit(part))

    @staticmethod
    def starts(x: Column, part: str) -> Column:
        return F.startswith(x, F.lit(part))

    @staticmethod
    def lower(x: Column) -> Column:
        return F.lower(x)

    @staticmethod
    def trim(x: Column) -> Column:
        return F.trim(x, F.lit(SPACE_CHARACTERS))

    @staticmethod
    def replace(x: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
        return F.regexp_replace(x, java(pattern, ignore_case), by)

    @staticmethod
    def swap(x: Column, part: str, by: str) -> Column:
        return F.replace(x, F.lit(part), F.lit(by))

    @staticmethod
    def length(x: Column) -> Column:
        """UTF-16 units."""
        return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("bigint")

    @staticmethod
    def head(x: Column, n: int) -> Column:
        return F.substring(x, 1, n)

    @staticmethod
    def tail(x: Column, n: int) -> Column:
        return F.right(x, F.lit(n))

    @staticmethod
    def split(x: Column, pattern: str) -> Column:
        return F.split(x, java(pattern), -1)

    @staticmethod
    def transform(xs: Column, f) -> Column:
        return F.transform(xs, f)

    @staticmethod
    def keep(xs: Column, f) -> Column:
        return F.filter(xs, f)

    @staticmethod
    def size(xs: Column) -> Column:
        return F.size(xs)

    @staticmethod
    def join(xs: Column, by: str) -> Column:
        return F.array_join(xs, by)

    @staticmethod
    def first(xs: Column) -> Column:
        return F.get(xs, F.lit(0))

    @staticmethod
    def last(xs: Column) -> Column:
        return F.get(xs, F.size(xs) - 1)

    @staticmethod
    def extract(x: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
        """Null if there is no match."""
        p = java(pattern, ignore_case)
        return F.when(x.rlike(p), F.regexp_extract(x, p, group))

    @staticmethod
    def concat(*xs) -> Column:
        return F.concat(*xs)

    @staticmethod
    def coalesce(*xs) -> Column:
        return F.coalesce(*xs)

    @staticmethod
    def is_null(x: Column) -> Column:
        return x.isNull()

    @staticmethod
    def number(condition: Column) -> Column:
        return condition.cast("int")

    @staticmethod
    def text(x: Column) -> Column:
        return x.cast("string")

    @staticmethod
    def ratio(a: Column, b: Column) -> Column:
        return a.cast("double") / b

    @staticmethod
    def cases(pairs, otherwise=None) -> Column:
        out = F.when(*pairs[0])
        for c, v in pairs[1:]:
            out = out.when(c, v)
        return out if otherwise is None else out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


class Sql(str):
    """SQL text with the operators of a column."""

    def _with(self, op, other):
        return Sql(f"({self} {op} {SqlOps.lit(other)})")

    def __and__(self, o):
        return self._with("and", o)

    def __or__(self, o):
        return self._with("or", o)

    def __invert__(self):
        return Sql(f"(not {self})")

    def __eq__(self, o):
        return self._with("=", o)

    def __ne__(self, o):
        return self._with("<>", o)

    def __lt__(self, o):
        return self._with("<", o)

    def __le__(self, o):
        return self._with("<=", o)

    def __gt__(self, o):
        return self._with(">", o)

    def __ge__(self, o):
        return self._with(">=", o)

    def __add__(self, o):
        return self._with("+", o)

    def __sub__(self, o):
        return self._with("-", o)

    __hash__ = str.__hash__


class SqlOps:
    """The same expressions as DuckDB SQL text."""

    names = 0

    @staticmethod
    def name(column: str) -> Sql:
        return Sql(column)

    @staticmethod
    def lit(value) -> Sql:
        if isinstance(value, Sql):
            return value
        if value is None:
            return Sql("null")
        if isinstance(value, bool):
            return Sql(str(value).lower())
        if isinstance(value, str):
            return Sql("'" + value.replace("'", "''") + "'")
        return Sql(repr(value))

    @classmethod
    def match(cls, x, patterns, ignore_case=False):
        return Sql(f"regexp_matches({x}, {cls.lit(re2(any_of(patterns), ignore_case))})")

    @classmethod
    def contains(cls, x, part):
        return Sql(f"contains({x}, {cls.lit(part)})")

    @classmethod
    def starts(cls, x, part):
        return Sql(f"starts_with({x}, {cls.lit(part)})")

    @staticmethod
    def lower(x):
        return Sql(f"lower({x})")

    @staticmethod
    def trim(x):
        return Sql(f"trim({x}, {SqlOps.lit(SPACE_CHARACTERS)})")

    @classmethod
    def replace(cls, x, pattern, by, ignore_case=False):
        return Sql(f"regexp_replace({x}, {cls.lit(re2(pattern, ignore_case))}, {cls.lit(by.replace('$', chr(92)))}, 'g')")

    @classmethod
    def swap(cls, x, part, by):
        return Sql(f"replace({x}, {cls.lit(part)}, {cls.lit(by)})")

    @staticmethod
    def length(x):
        return Sql(rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))")

    @staticmethod
    def head(x, n):
        return Sql(f"substr({x}, 1, {n})")

    @staticmethod
    def tail(x, n):
        return Sql(f"right({x}, {n})")

    @classmethod
    def split(cls, x, pattern):
        return Sql(f"string_split_regex({x}, {cls.lit(re2(pattern))})")

    @classmethod
    def _lambda(cls, f):
        cls.names += 1
        name = Sql(f"v{cls.names}")
        return f"lambda {name}: {f(name)}"

    @classmethod
    def transform(cls, xs, f):
        return Sql(f"list_transform({xs}, {cls._lambda(f)})")

    @classmethod
    def keep(cls, xs, f):
        return Sql(f"list_filter({xs}, {cls._lambda(f)})")

    @staticmethod
    def size(xs):
        return Sql(f"len({xs})")

    @classmethod
    def join(cls, xs, by):
        return Sql(f"array_to_string({xs}, {cls.lit(by)})")

    @staticmethod
    def first(xs):
        return Sql(f"({xs})[1]")

    @staticmethod
    def last(xs):
        return Sql(f"({xs})[-1]")

    @classmethod
    def extract(cls, x, pattern, group, ignore_case=False):
        p = cls.lit(re2(pattern, ignore_case))
        return Sql(f"case when regexp_matches({x}, {p}) then regexp_extract({x}, {p}, {group}) end")

    @classmethod
    def concat(cls, *xs):
        return Sql("(" + " || ".join(cls.lit(x) for x in xs) + ")")

    @classmethod
    def coalesce(cls, *xs):
        return Sql(f"coalesce({', '.join(cls.lit(x) for x in xs)})")

    @staticmethod
    def is_null(x):
        return Sql(f"({x} is null)")

    @staticmethod
    def number(condition):
        return Sql(f"cast({condition} as int)")

    @staticmethod
    def text(x):
        return Sql(f"cast({x} as varchar)")

    @staticmethod
    def ratio(a, b):
        return Sql(f"(cast({a} as double) / {b})")

    @classmethod
    def cases(cls, pairs, otherwise=None):
        return Sql("case " + " ".join(f"when {c} then {cls.lit(v)}" for c, v in pairs) + (f" else {cls.lit(otherwise)}" if otherwise is not None else "") + " end")


def count_true(ops, conditions):
    """How many of the conditions hold."""
    return reduce(lambda a, b: a + b, [ops.number(c) for c in conditions])


def either(conditions):
    return reduce(lambda a, b: a | b, conditions)
