"""Conversation structure repair: the cheapest edits that make a conversation alternate, by tight arcs between forward and backward costs.

A conversation is a path through the states of ``(s?(ua)+)?`` (start, after
system, after user, after assistant). At each place a row is kept (0), given the
role that is due (1) or deleted (2), or a row is inserted (5). With the least
costs from the start and to the end, an arc is tight if the two and its own cost
make the least total; tight arcs form a DAG of all optimal repairs. A frontier
of states goes through it and takes the least letter at each step (D, I, K, R).

Rows lie sorted over range partitions, so one conversation may cover any number
of tasks: what a task has of it is a segment, summed up as a 4 x 4 matrix of
least costs. Prefix and suffix products of the matrices give the costs at
segment ends; then every segment is walked by itself, from each state that may
open it. Only digests travel on this path; texts are shuffled once, at the end,
and streamed in order past the letters.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, small_batches, table

#: Rows of a segment, at most.
SEGMENT = 1 << 16
#: Conversations up to this length are remembered by their symbols, and how many.
SHORT, REMEMBERED = 24, 50_000
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
INF = 1 << 60
ROLES = {2: "user", 3: "assistant"}
#: The state that is due after each state.
DUE = (2, 2, 3, 2)
START, END = (0, INF, INF, INF), (0, INF, INF, 0)
_NONE, _BLANK, _DUPLICATE, _CUT = range(4)


def _row_arcs(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) over a row; a symbol is 4 * (0 other, 1 s, 2 u, 3 a) + fault."""
    kind, fault = divmod(symbol, 4)
    arcs = [("D", DELETE, state)]
    if fault not in (_BLANK, _DUPLICATE):
        more = TRUNCATED * (fault == _CUT)
        if kind and ((kind == 1 and state == 0) or kind == DUE[state]):
            arcs.append(("K", more, kind))
        arcs.append(("R", REROLE + more, DUE[state]))
    return arcs


ARCS = [[_row_arcs(symbol, state) for state in range(4)] for symbol in range(16)]


def _inserted(costs) -> tuple:
    """Forward costs with rows inserted here."""
    s, y, u, a = costs
    u = min(u, s + INSERT, y + INSERT, a + INSERT)
    return s, y, u, min(a, u + INSERT)


def _owed(costs) -> tuple:
    """Backward costs with rows inserted here."""
    s, y, u, a = costs
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return min(s, INSERT + u), min(y, INSERT + u), u, a


def forward(symbols: bytes, start=START) -> list[tuple]:
    """Least costs of each state before each row and after the last."""
    out = [_inserted(start)]
    for symbol in symbols:
        after = [INF] * 4
        for state, cost in enumerate(out[-1]):
            if cost < INF:
                for _, c, to in ARCS[symbol][state]:
                    after[to] = min(after[to], cost + c)
        out.append(_inserted(after))
    return out


def backward(symbols: bytes, end=END) -> list[tuple]:
    """Least costs from each state before each row, and after the last, to the end."""
    out = [_owed(end)]
    for symbol in reversed(symbols):
        after = out[-1]
        out.append(_owed([min(c + after[to] for _, c, to in ARCS[symbol][state]) for state in range(4)]))
    return out[::-1]


def matrix(symbols: bytes) -> list[int]:
    """Least costs from each state before the first row to each state just after the last one, row by row."""
    out = []
    for state in range(4):
        costs = tuple(0 if k == state else INF for k in range(4))
        before = forward(symbols[:-1], costs)[-1]
        after = [INF] * 4
        for s, cost in enumerate(before):
            if cost < INF:
                for _, c, to in ARCS[symbols[-1]][s]:
                    after[to] = min(after[to], cost + c)
        out += after
    return out


def walk(symbols: bytes, ahead: list[tuple], behind: list[tuple], state: int, last: bool) -> tuple[str, int] | None:
    """Least letters over the tight arcs from a state, and the state they lead to; None if no optimal repair passes it.

    A segment that is not the last ends with its last row; rows inserted behind it belong to the next one.
    """
    total = min(a + b for a, b in zip(ahead[0], behind[0], strict=True))
    if ahead[0][state] + behind[0][state] != total:
        return None
    at, frontier, letters = 0, {state}, []
    while at < len(symbols) or (last and not any(behind[at][s] == 0 and END[s] == 0 for s in frontier)):
        tight: dict[str, set] = {}
        for s in frontier:
            arcs = [("I", INSERT, DUE[s], at)]
            if at < len(symbols):
                arcs += [(letter, c, to, at + 1) for letter, c, to in ARCS[symbols[at]][s]]
            for letter, c, to, place in arcs:
                if ahead[at][s] + c + behind[place][to] == total:
                    tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        letters.append(letter)
        frontier = tight[letter]
        at += letter != "I"
    return "".join(letters), min(frontier)


def _solve(symbols: bytes) -> tuple[str, int]:
    """Letters and cost of a whole conversation."""
    ahead, behind = forward(symbols), backward(symbols)
    return walk(symbols, ahead, behind, 0, True)[0], behind[0][0]


_remembered = functools.lru_cache(REMEMBERED)(_solve)


def repair_letters(symbols: bytes) -> tuple[str, int]:
    """The least of the cheapest edit sequences, one letter an edit, and its cost."""
    return _remembered(symbols) if len(symbols) <= SHORT else _solve(symbols)


# ---------------------------------------------------------------- segments

_STATS = [("symbols", pa.binary()), ("least_turn", pa.int64()), ("most_turn", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("moves", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("total", pa.int64())]
_STATS_DDL = "symbols binary, least_turn bigint, most_turn bigint, turns bigint, costs array<bigint>, moves array<string>, ends array<int>, total bigint"


def _runs(ids: pa.Array) -> np.ndarray:
    """Where runs of equal identifiers (null is one) begin, and the end."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def _segments(kind: pa.DataType, most: int):
    """Sorted rows (conv, turn, symbol, repeat symbol, copies) to segments; conversations that lie inside the task are solved at once."""
    schema = pa.schema([("conv", kind), ("seg", pa.int64()), ("whole", pa.bool_()), *_STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, done = TaskContext.get().partitionId(), 0, []
        conv, held, size, cut = None, None, 0, True  # the first conversation may have begun in the task before

        def close(whole: bool) -> dict:
            nonlocal made, held, size
            symbols = b"".join(x[0] for x in held)
            turns = np.concatenate([x[1] for x in held])
            row = {"conv": conv, "seg": task << 32 | made, "whole": whole, "symbols": symbols, "turns": int(len(np.unique(turns)))}
            if len(turns):
                row |= {"least_turn": int(turns[0]), "most_turn": int(turns[-1])}
            if whole:
                letters, total = repair_letters(symbols)
                row |= {"moves": [letters], "ends": [0], "total": total}
            else:
                row["costs"] = matrix(symbols)
            made += 1
            held, size = [], 0
            return row

        for batch in batches:
            ids, turns, first, other, copies = batch.columns
            bounds = _runs(ids)
            known = turns.is_valid().to_numpy(zero_copy_only=False)
            turns = turns.fill_null(0).to_numpy()
            first, other, copies = (x.to_numpy().astype(np.int64) for x in (first, other, copies))
            for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                name = ids[at].as_py()
                if held is None or name != conv:
                    if held:
                        done.append(close(not cut))
                        cut = False
                    elif held is not None:
                        cut = False
                    conv, held, size = name, [], 0
                for k in range(at, to, most):
                    part = slice(k, min(to, k + most))
                    # copies of a row: as many bytes, in pieces
                    for symbols, seen in _spread(first[part], other[part], copies[part], turns[part], known[part], most):
                        if size + len(symbols) > most and size:
                            cut = True
                            done.append(close(False))
                        held.append((symbols, seen))
                        size += len(symbols)
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held:
            yield pa.RecordBatch.from_pylist([close(False)], schema)  # it may go on in the next task

    return run


def _spread(first, other, copies, turns, known, most: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Symbols of rows with their copies, and the known turns, in pieces of at most ``most`` rows."""
    at = 0
    while at < len(copies):
        total = np.cumsum(copies[at : at + most])
        n = max(1, int(np.searchsorted(total, most, "right")))
        part = slice(at, at + n)
        symbols = np.repeat(other[part], copies[part]) if total[n - 1] <= most else None
        seen = turns[part][known[part]]
        if symbols is not None:
            begins = total[:n] - copies[part]
            symbols[begins] = first[part]
            yield symbols.astype(np.uint8).tobytes(), seen
        else:  # one row with many copies
            left = int(copies[at])
            yield bytes([first[at]]), seen
            left -= 1
            while left:
                take = min(left, most)
                yield bytes([other[at]]) * take, seen
                left -= take
        at += n


def _borders(kind: pa.DataType):
    """Per segment the least costs before it and after it, from the matrices of a conversation's segments in order (128 bytes a segment)."""
    schema = pa.schema([("conv", kind), ("seg", pa.int64()), ("ahead", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())])

    def solved(conv, held):
        count = len(held)
        before, after = [START], [END]
        for _, costs in held:
            before.append(tuple(min(INF, min(before[-1][s] + costs[4 * s + t] for s in range(4))) for t in range(4)))
        for _, costs in reversed(held):
            after.append(tuple(min(INF, min(costs[4 * s + t] + (after[-1] if len(after) > 1 else _owed(END))[t] for t in range(4))) for s in range(4)))
        after = after[::-1]
        return pa.RecordBatch.from_pylist([{"conv": conv, "seg": seg, "ahead": before[k], "behind": after[k + 1], "last": k + 1 == count} for k, (seg, _) in enumerate(held)], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, []
        for batch in batches:
            for name, seg, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and name != conv:
                    yield solved(conv, held)
                    held = []
                conv = name
                held.append((seg, costs))
        if held:
            yield solved(conv, held)

    return run


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the costs at their ends: the letters from each state that an optimal repair may be in at their begin."""
    for batch in batches:
        names = batch.schema.names
        moves, ends, totals = [], [], []
        for symbols, ahead, behind, last in zip(*(batch.column(names.index(c)).to_pylist() for c in ("symbols", "ahead", "behind", "last")), strict=True):
            f, b = forward(symbols, ahead), backward(symbols, behind)
            found = [walk(symbols, f, b, s, last) for s in range(4)]
            moves.append([w and w[0] for w in found])
            ends.append([w and w[1] for w in found])
            totals.append(min(x + y for x, y in zip(f[0], b[0], strict=True)))
        out = {n: batch.column(k) for k, n in enumerate(names) if n not in ("ahead", "behind", "last")}
        out |= {"moves": pa.array(moves, pa.list_(pa.string())), "ends": pa.array(ends, pa.list_(pa.int32())), "total": pa.array(totals, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


# ---------------------------------------------------------------- rows and letters


class Repair:
    """One conversation while its segments, then its rows, stream by in order."""

    def __init__(self, conv):
        self.conv, self.state, self.moves = conv, 0, []
        self.letters, self.at, self.due = None, 0, 0
        self.turns, self.least, self.most, self.total = 0, None, None, 0
        self.faults, self.illegal, self.kind = np.zeros(4, np.int64), 0, None
        self.digest, self.lines = hashlib.sha256(), 0

    def segment(self, row: dict) -> None:
        self.moves.append(row["moves"][self.state])
        self.state, self.total = row["ends"][self.state], row["total"]
        symbols = np.frombuffer(row["symbols"], np.uint8)
        self.faults += np.bincount(symbols & 3, minlength=4)
        kinds = symbols >> 2
        if self.kind is not None:
            kinds = np.concatenate([[self.kind], kinds])
        pairs = kinds[:-1] * 4 + kinds[1:]
        self.illegal += int(len(pairs) - np.isin(pairs, (6, 11, 14)).sum())  # su, ua, au
        self.kind = kinds[-1]
        if row["turns"]:
            self.turns += row["turns"] - (self.most == row["least_turn"])
            self.least = row["least_turn"] if self.least is None else self.least
            self.most = row["most_turn"]

    def row(self, role: str, text: str) -> list[tuple]:
        """The edits up to and including that of the row: (position, letter, role, text); deleted rows have their own role and text."""
        out = self._inserted()
        letter = self.letters[self.at]
        if letter == "R":
            self.due = DUE[self.due]
            role = ROLES[self.due]
        elif letter == "K":
            self.due = {"s": 1, "u": 2, "a": 3}[role[0]]
        return [*out, self._edit(letter, role, text)]

    def _inserted(self) -> list[tuple]:
        if self.letters is None:
            self.letters = "".join(self.moves)
        out = []
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.due = DUE[self.due]
            out.append(self._edit("I", ROLES[self.due], ""))
        return out

    def _edit(self, letter: str, role: str, text: str) -> tuple:
        self.at += 1
        if letter != "D":
            self.digest.update(("\n" * (self.lines > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.lines += 1
        return self.at - 1, letter, role, text

    def end(self) -> tuple[list[tuple], dict]:
        edits = self._inserted()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        _, blank, duplicate, truncated = self.faults.tolist()
        return edits, {
            "conv": self.conv, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": self.illegal,
            "cost": self.total, "audit": self.letters, "repaired_sha256": self.digest.hexdigest(),
        }


_SUMMARY = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_SUMMARY_DDL = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_EDITS = [("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
_EDITS_DDL = "position bigint, edit string, role string, text string"


def _applied(kind: pa.DataType, rows: bool):
    """Sorted segments and rows of conversations to edits, or to one summary a conversation."""
    schema = pa.schema([("conv", kind), *(_EDITS if rows else _SUMMARY)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0

        def edits(found):
            nonlocal size
            if rows:
                out.extend({"conv": now.conv, "position": p, "edit": e, "role": r, "text": t} for p, e, r, t in found)
                size += sum(len(x[3]) for x in found)

        def finish():
            found, summary = now.end()
            edits(found)
            if not rows:
                out.append(summary)

        for batch in batches:
            names = batch.schema.names
            columns = {n: batch.column(k).to_pylist() for k, n in enumerate(names)}
            for k, conv in enumerate(columns["conv"]):
                if now is None or conv != now.conv:
                    if now is not None:
                        finish()
                    now = Repair(conv)
                step = columns["step"][k]
                if step == 0:
                    now.segment({n: columns[n][k] for n in ("symbols", "moves", "ends", "total", "turns", "least_turn", "most_turn")})
                elif step == 1:
                    role, text = columns["role"][k], columns["text"][k]
                    edits(now.row(role, text))
                if len(out) >= 2000 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if now is not None:
            finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


# ---------------------------------------------------------------- the job


def _repaired(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None, rows: bool) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    space = F.lit(" ")
    given = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    kind = to_arrow_type(given.schema["conv"].dataType)
    ddl = given.schema["conv"].dataType.simpleString()
    given = given.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    slim = given.where("present").select("conv", "turn", "role", "digest", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    # equal rows are one row with a count, so that a conversation full of them can still be split
    slim = materialize(slim.groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies")), "turns")
    firsts = slim.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first")).select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), F.col("first.turn").alias("first_turn"))
    known = slim.join(firsts, slim["conv"].eqNullSafe(firsts["conv_"]) & (slim["role"] == firsts["role_"]) & (slim["digest"] == firsts["digest_"]))
    initial = F.substring("role", 1, 1)
    kind_of = F.when(initial == "s", 4).when(initial == "u", 8).when(initial == "a", 12).otherwise(0)
    fault = F.when(F.col("blank"), _BLANK).when(~F.col("turn").eqNullSafe(F.col("first_turn")), _DUPLICATE).when(F.col("cut"), _CUT).otherwise(_NONE)
    order = ["conv", "turn", "role", "digest"]
    known = known.select(*order, (kind_of + fault).cast("int").alias("symbol"), (kind_of + F.when(F.col("blank"), _BLANK).otherwise(_DUPLICATE)).cast("int").alias("other"), "copies")
    ordered = known.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "symbol", "other", "copies")
    segments = materialize(ordered.mapInArrow(_segments(kind, SEGMENT), f"conv {ddl}, seg bigint, whole boolean, {_STATS_DDL}"), "segments")
    whole = segments.where("whole").drop("whole", "costs")
    parts = segments.where("not whole")
    borders = parts.select("conv", "seg", "costs").repartition("conv").sortWithinPartitions("conv", "seg")
    borders = borders.mapInArrow(_borders(kind), f"conv {ddl}, seg bigint, ahead array<bigint>, behind array<bigint>, last boolean")
    joined = parts.drop("whole", "costs").join(borders.drop("conv"), "seg")
    walked = joined.select(*whole.columns, "ahead", "behind", "last").mapInArrow(_walked, whole.schema)
    pieces = whole.unionByName(walked).withColumn("step", F.lit(0))
    texts = given.select("conv", "turn", "digest", F.when(F.col("present"), F.col("role")).alias("role"), F.when(F.col("present"), F.col("text")).alias("text"), F.when(F.col("present"), 1).otherwise(2).alias("step"))
    stream = pieces.unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "step", "seg", "turn", "role", "digest").drop("digest", "turn", "seg")
    return stream.mapInArrow(_applied(kind, rows), f"conv {ddl}, {_EDITS_DDL if rows else _SUMMARY_DDL}").withColumnRenamed("conv", conv_col)


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The cheapest edits of every conversation, in order: identifier, position, edit (D, I, K, R), role, text; rows without D are the repaired conversation.

    Rows go by turn (nulls first), then role, then the digest of the text; so
    the order of rows that share a turn is defined. Null roles and texts count
    as one space, null identifiers as one conversation of their own. Rows that
    are blank, or whose role and text came before, are deleted; repeated rows
    so become one. Empty roles have no initial and are never kept. A condition
    ``present`` leaves rows out. Other columns are ignored.
    """
    return _repaired(df, conv_col, turn_col, role_col, text_col, present, True)


def audit_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' letters) and the digest of the repaired rows.

    Rows are taken as ``repair_conversations`` takes them. A conversation none
    of whose rows is ``present`` has zeros, an empty audit and the digest of
    nothing. The digest of one conversation is taken in one task, as SHA-256
    asks for, with its rows streaming by; letters take a byte a row there.
    """
    return _repaired(df, conv_col, turn_col, role_col, text_col, present, False)


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by the checksum of ``conv_id:turn``; dropped rows stay, with ``present`` false."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    draw = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    """Contract: statistics, least edits and the digest of the repaired rows of every conversation, after the damage."""
    return audit_conversations(damage(table(spark, sf_dir, "conversations")), present=F.col("present"))
