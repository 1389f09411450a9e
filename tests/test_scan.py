"""Running sums by book and over all, and books as segments, whatever the spread of rows over books and tasks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chapters as C
from quire.operators import translation as T
from quire.operators.scan import numbered, running_sums


def plain(rows, group):
    """Running sums and numbers of (group, order, value) rows."""
    held, out = {}, []
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        key = g if group else None
        s, n = held.get(key, (0, 0))
        held[key] = s + (v or 0), n + 1
        out.append((g, o, v, *held[key]))
    return out


@pytest.mark.parametrize("shape", ["one", "many", "mixed", "none", "single"])
@pytest.mark.parametrize("group", [True, False])
@pytest.mark.parametrize("partitions", [1, 7, None])
def test_running_sums(spark, shape, group, partitions):
    pick = random.Random(shape)
    n = {"one": 400, "many": 400, "mixed": 600, "none": 0, "single": 1}[shape]
    book = {"one": lambda k: "b", "many": lambda k: f"b{k:03d}", "mixed": lambda k: pick.choice(["hot", "hot", None, f"b{k % 40}"]), "none": str, "single": str}[shape]
    rows = [(book(k), k if pick.random() < 0.999 else None, pick.choice([None, -5, 0, 7, 10**12])) for k in range(n)]
    seen = set()
    rows = [r for r in rows if r[:2] not in seen and not seen.add(r[:2])]
    order = ["b", "i"] if not group else ["i"]
    df = spark.createDataFrame(rows, "b string, i long, v long").repartition(5)
    got = running_sums(df, ["b"] if group else [], order, partitions, s=F.col("v"), n=F.lit(1)).select("b", "i", "v", "s", "n").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, group)))


def test_hot_and_small_groups_spread(spark):
    """One book of 300,000 chapters and 100,000 of one: no task has much more than its share."""
    hot = spark.range(300_000).select(F.lit(-1).cast("long").alias("b"), "id")
    small = spark.range(100_000).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("id"))
    out = numbered(hot.union(small), ["b"], ["id"], "n", 16)
    sizes = [r["count"] for r in out.groupBy("b").count().where("b = -1").collect()]
    assert sizes == [300_000] and out.where("b = -1 and n <> id + 1").count() == 0 and out.where("b >= 0 and n <> 1").count() == 0
    parts = hot.union(small).repartitionByRange(16, "b", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts < 3 * 400_000 / 16


def test_no_window_holds_texts(spark):
    """Plans of the text operators: no window at all over rows with texts."""
    rows = spark.createDataFrame([("b", k, f"t{k}", "text " * 50) for k in range(30)], "book_id string, chapter_idx int, title string, content string")
    for df in (C.kept(rows.withColumn("filter_reason", F.lit(None).cast("string"))), C.content_segments(rows)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window" in line:
                assert "content" not in line and "text" not in line
    assert [r.chapter_idx for r in C.kept(rows.withColumn("filter_reason", F.when(F.col("chapter_idx") % 3 == 0, "x"))).orderBy("chapter_idx").collect()] == list(range(20))


CASES = {
    "plain": ["a", "b", "c"], "blank ends": ["", " \n", " a ", "", "b　", " ", None], "blank": [" ", None, ""], "one": ["  x  "], "none": [], "blank inside": ["a", "", "", "b"], "spaces": ["a ", " b "],
}


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("gap", ["\n\n", "; "])
def test_segments_make_the_book(spark, trim, gap):
    rows = [(name, k, t) for name, texts in CASES.items() for k, t in enumerate(texts)] + [("long", k, f"chapter {k} ä" * (k % 5)) for k in range(200)]
    df = spark.createDataFrame(rows, "book_id string, chapter_idx int, content string").repartition(6)
    segments = C.content_segments(df, gap=gap, trim=trim)
    books, digests = {}, {r.book_id: (r.digest, r.n) for r in C.segment_digests(segments).collect()}
    for r in segments.collect():
        books.setdefault(r.book_id, []).append(r)
    white = "".join(map(chr, (9, 10, 11, 12, 13, 32, 160, 0x3000)))
    for name in {r[0] for r in rows}:
        whole = gap.join(t or "" for b, _, t in sorted(rows, key=lambda r: r[1]) if b == name)
        # where the gap is no white space, blank chapters at the ends go with their gaps
        texts = [t or "" for b, _, t in sorted(rows, key=lambda r: r[1]) if b == name]
        if trim:
            while texts and not texts[0].strip(white):
                texts.pop(0)
            while texts and not texts[-1].strip(white):
                texts.pop()
            whole = gap.join(texts).strip(white)
        parts = sorted(books.get(name, []), key=lambda r: r.segment)
        assert "".join(r.text for r in parts) == whole, name
        at = 0
        for k, r in enumerate(parts):
            assert (r.segment, r.offset) == (k, at), name
            at += len(r.text)
        assert digests.get(name, (hashlib.md5(b"").hexdigest(), 0)) == (hashlib.md5(whole.encode()).hexdigest(), len(whole))


def test_quota_plan_over_many_books(spark):
    pick = random.Random(3)
    rows = [(b, i, pick.randint(0, 50)) for b in range(60) for i in range(pick.randint(1, 5))] + [(None, 0, 5), (None, 1, None)]
    got = {(r.book_id, r["index"]): (r.spent, r.provider) for r in T.plan_providers(spark.createDataFrame(rows, "book_id int, index int, char_count int").repartition(4), 1000).collect()}
    total = 0
    for b, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total += n or 0
        assert got[b, i] == (total, "deepl" if total <= 1000 else "google")
