"""Conversation repair against every possible edit sequence, on odd rows and over many segments."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, edit int"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """All edit sequences that cost no more than deleting every row; the least cost, then the least letters."""
    best = (2 * len(rows), "D" * len(rows), ())

    def go(k, cost, letters, made):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made)) and (cost, letters) <= best[:2]:
            best = (cost, letters, made)
        if not re.match(r"(s?(ua)*u?)?\Z", "".join(r[:1] for r, _ in made)):
            return
        for role in ("user", "assistant"):
            go(k, cost + 5, letters + "I", (*made, (role, "")))
        if k < len(rows):
            role, text = rows[k]
            go(k + 1, cost + 2, letters + "D", made)
            if faults[k] in ("", "truncated"):
                more = 5 * (faults[k] == "truncated")
                if role:
                    go(k + 1, cost + more, letters + "K", (*made, (role, text)))
                for other in ("user", "assistant"):
                    go(k + 1, cost + 1 + more, letters + "R", (*made, (other, text)))

    go(0, 0, "", ())
    return best


def plain(rows):
    """The contract for the rows of one conversation after the damage, in order: (turn, role, text)."""
    faults = faults_of([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, made = cheapest([r[1:] for r in rows], faults)
    pairs = ["".join(x[:1] for x in (a[1], b[1])) for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    )


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def wanted(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    out = {conv: plain([]) for conv in {r[0] for r in rows}}
    for conv, group in groupby(sorted(damaged(rows), key=key), key=lambda r: r[0]):
        out[conv] = plain([r[1:] for r in group])
    return out


def random_rows(seed, count=120):
    pick = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(pick.randint(1, 6)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "uncle", None])
            text = pick.choice(["a.", "b!", "c?", "cut", " \n", "", "x. ", "é.　", None, "d.", "e."])
            rows.append((conv, pick.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + [(None, 1, "user", "q."), (None, None, "assistant", "r."), (10**12, 1, "user", "no partner."), rows[0], rows[0]]


@pytest.fixture(scope="module")
def conversations(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = tmp_path_factory.mktemp("conversations")
    rows = random_rows(1)
    table = pa.Table.from_pylist([{"conv_id": a, "turn": b, "role": c, "text": d, "edit": "clash", "present": None, "conv": 1} for a, b, c, d in rows])
    pq.write_table(table, at / "conversations.parquet")
    return str(at), rows


def test_against_all_edit_sequences(spark, conversations):
    at, rows = conversations
    got = {r.conv_id: tuple(r)[1:] for r in R.op12_conversation_repair(spark, at).collect()}
    assert got == wanted(rows)


def test_segments_give_the_same(spark, conversations, monkeypatch):
    """Segments of two rows: conversations cross segments and tasks."""
    at, rows = conversations
    monkeypatch.setattr(R, "SEGMENT", 2)
    got = {r.conv_id: tuple(r)[1:] for r in R.op12_conversation_repair(spark, at).collect()}
    assert got == wanted(rows)


@pytest.mark.parametrize("seed", range(3))
def test_walks_in_pieces(seed):
    """Letters of segments, composed, equal those of the whole."""
    pick = random.Random(seed)
    for _ in range(60):
        symbols = bytes(pick.choice([4, 8, 12, 8, 12, 1, 10, 11, 15, 0]) for _ in range(pick.randint(1, 40)))
        letters, total = R.repair_letters(symbols)
        cuts = sorted({0, len(symbols), *(pick.randrange(len(symbols) + 1) for _ in range(3))})
        parts = [symbols[a:b] for a, b in zip(cuts, cuts[1:])]
        costs = [(k, R.matrix(p)) for k, p in enumerate(parts)]
        before, after = [R.START], [R._owed(R.END)]
        for _, m in costs:
            before.append([min(before[-1][s] + m[4 * s + t] for s in range(4)) for t in range(4)])
        for _, m in reversed(costs):
            after.append([min(m[4 * s + t] + after[-1][t] for t in range(4)) for s in range(4)])
        after, state, out = after[::-1], 0, ""
        for k, p in enumerate(parts):
            last = k + 1 == len(parts)
            found = R.walk(p, R.forward(p, before[k]), R.backward(p, R.END if last else after[k + 1]), state, last)
            out, state = out + found[0], found[1]
        assert out == letters and after[0][0] == total


def test_edits_make_the_repaired_rows(spark, conversations):
    at, rows = conversations
    source = R.damage(spark.read.parquet(f"{at}/conversations.parquet"))
    edits = R.repair_conversations(source, present=F.col("present")).collect()
    summary = {r.conv_id: r for r in R.audit_conversations(source, present=F.col("present")).collect()}
    by_conv = {}
    for e in sorted(edits, key=lambda e: (str(e.conv_id), e.position)):
        by_conv.setdefault(e.conv_id, []).append(e)
    for conv, row in summary.items():
        mine = by_conv.get(conv, [])
        assert "".join(e.edit for e in mine) == row.audit and [e.position for e in mine] == list(range(len(mine)))
        lines = "\n".join(f"{e.role}:{e.text}" for e in mine if e.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == row.repaired_sha256


def test_one_conversation_holds_most_rows(spark):
    """Twenty thousand turns of one conversation, a third of them the same row at the same turn, beside small ones."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(12_000)] + [(1, 12_000, "user", "same.")] * 8_000 + [(k, 0, "user", "hi.") for k in range(2, 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r.conv_id: r for r in R.audit_conversations(df).collect()}
    # the last user turn stays without an answer: deleting it is cheaper than inserting one
    assert got[1].audit == "K" * 12_000 + "D" * 8_000 and got[1].duplicate == 7_999 and got[1].cost == 16_000 and got[1].gaps == 0
    assert got[2].audit == "D" and got[2].cost == 2 and len(got) == 49


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.audit_conversations(none).collect() == [] and R.repair_conversations(none).collect() == []
