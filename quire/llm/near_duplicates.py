"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds the hashes of its word shingles. Equal texts are one
class from the start, and so are equal sets in other texts, once their full sets
are confirmed to be equal. A sketch of ``COORDINATES`` values is filled
by rounds of hashed bin placement: each round throws every element into one
bin, a bin keeps its least value of the first round that reached it, and after
as many rounds as bins each bin draws from all elements, so no coordinate
stays empty. Bands of the sketch propose pairs, and only pairs whose full sets
confirm the threshold are linked.

Large buckets never become all their pairs. Each bucket first compares its
members with its smallest one. What is still apart after the links found so far
is compared in full: in small buckets by pairs, in large ones by blocks of
documents against an inverted index of other blocks of the same bucket family.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, small_batches, table, text_blocks, tidy
from .components import components

WORDS, BANDS, ROWS = 5, 40, 5
COORDINATES = BANDS * ROWS
#: Similarity in percent from which documents are linked.
PERCENT = 75
#: Members up to which a bucket that is still apart is compared by pairs; documents in a block otherwise; members per leader's text.
SMALL, BLOCK, CHUNK = 24, 256, 64

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all shingles of a whole text.

    A-Z are lower-cased; words are parted by space, tab and line breaks. Fewer
    words than a shingle make one shingle; none make an empty set.
    """
    row = (text or "").encode().lower().split()
    if not row:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, row), np.uint64, len(row))
    n = max(1, len(own) - words + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(words, len(own)), np.uint64)
        for i in range(min(words, len(own))):
            out += own[i : i + n] * _WEIGHTS[i % len(_WEIGHTS)]
        return np.unique(_mix(out))


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketch: ``COORDINATES`` values, equal in two sets with probability of their similarity."""
    t = COORDINATES
    out = np.full(t, np.iinfo(np.uint64).max)
    at, step = 0, max(1, 4096 // len(items))
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    while at < t:
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        h = _mix(items[None, :] ^ _SEEDS[at : at + len(rounds), None])
        bins = ((h >> half) * np.uint64(t)) >> half
        np.minimum.at(out, bins.ravel().astype(np.int64), (h & low | rounds[:, None] << half).ravel())
        at += len(rounds)
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[b] = np.uint64(t + b) << half | (_mix(items ^ _SEEDS[t + b]) & low).min()
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band of a sketch."""
    with np.errstate(over="ignore"):
        rows = values.reshape(BANDS, ROWS) * _WEIGHTS[:ROWS]
        return _mix(_mix(rows.sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


_SIGNATURE = pa.struct([("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])


@tidy
def _signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for block in text_blocks(texts, rows=1000, max_bytes=4 << 20):
            rows = []
            for t in block.to_pylist():
                s = shingles(t)
                if not len(s):
                    rows.append({"n": 0, "f1": None, "f2": None, "bands": None})
                    continue
                other = _mix(s + np.uint64(0x5851F42D4C957F2D))
                rows.append({"n": len(s), "f1": int(s.sum(dtype=np.uint64).astype(np.int64)), "f2": int(np.bitwise_xor.reduce(other).astype(np.int64)), "bands": band_keys(sketch(s))})
            yield pa.array(rows, _SIGNATURE)


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among rows (a, chunk, role, id, text): in each (a, chunk), the text of role 0 against all of role 1."""

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        found = []
        for (a, _), group in groupby(each(), lambda r: r[:2]):
            leaders = []
            for _, _, role, other, text in group:
                s = shingles(text)
                if role == 0:
                    leaders.append(s)
                elif any(similar(x, s, percent) for x in leaders):
                    found.append((a, other))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    order = ["a", "chunk", "role"]
    return rows.repartition("a", "chunk").sortWithinPartitions(*order).select("a", "chunk", "role", "id", "text").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links among pairs (a, b, n), sets that reach ``percent``: ``n``, about the number of pairs with the same ``a``, decides into how many chunks they go."""
    pairs = pairs.groupBy("a", "b").agg(F.max("n").alias("n"))
    pairs = materialize(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk")), "pairs")
    leaders = pairs.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = pairs.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("id")).union(leaders)
    return materialize(_compare(rows.join(texts.hint("merge"), "id"), percent), "links")


def _compare_blocks(rows: DataFrame) -> DataFrame:
    """Links among rows (c, i, j, role, id, p, text): in each (c, i, j), role 1 against an inverted index of role 0, other components only."""

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        found = []
        for _, group in groupby(each(), lambda r: r[:3]):
            sets, ids, parts, index = [], [], [], None
            for _, _, _, role, own, p, text in group:
                s = shingles(text)
                if role == 0:
                    sets.append(s)
                    ids.append(own)
                    parts.append(p)
                    continue
                if index is None:
                    if not sets:
                        break
                    size = np.array([len(x) for x in sets])
                    keys = np.concatenate(sets)
                    order = np.argsort(keys, kind="stable")
                    index = (keys[order], np.repeat(np.arange(len(sets)), size)[order], size, np.array(parts))
                keys, owner, size, part = index
                low, high = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
                width = high - low
                at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                both = np.bincount(owner[at], minlength=len(size))
                linked = np.flatnonzero((100 * both >= PERCENT * (len(s) + size - both)) & (part != p))
                # one link to each other component says all
                _, first = np.unique(part[linked], return_index=True)
                found += [(own, ids[k]) for k in linked[first]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    order = ["c", "i", "j", "role"]
    return rows.repartition("c", "i", "j").sortWithinPartitions(*order).select("c", "i", "j", "role", "id", "p", "text").mapInArrow(run, "a long, b long")


def _apart(buckets: DataFrame, parents: DataFrame) -> DataFrame:
    """Members (key, id, n, lead, p) of the buckets that still hold more than one component."""
    at = lookup_join(buckets, parents.select(F.col("v").alias("id"), "p"), "id").withColumn("p", F.coalesce("p", "id"))
    at = materialize(at, "bucket-components")
    torn = at.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi").select("key")
    return materialize(lookup_join(at, materialize(torn, "torn"), "key", "inner"), "apart")


def duplicate_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents whose shingle sets reach the threshold are linked; the component
    is the smallest identifier reachable, itself included, and ``kept`` marks
    the document that bears it. Null and empty texts, and texts of white space
    only, have no shingles and are linked with nothing. Rows with a null
    identifier are linked with nothing: null component, kept. Rows are judged
    one by one; repeated rows give equal rows. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    signature = F.arrow_udf(_signature, "n bigint, f1 bigint, f2 bigint, bands array<bigint>")
    signed = rows.withColumn("s", signature("text")).select("id", "s.n", "s.f1", "s.f2", "s.bands", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("d"))
    signed = materialize(signed, "signatures")

    # equal texts: one class under its smallest identifier
    full = signed.where("id is not null and n > 0")
    copies = full.groupBy("d").agg(F.min("id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    copies = materialize(copies, "copies")
    n_copies = copies.count()
    members = lookup_join(signed.select("id", "n", "d"), copies, "d", rows=n_copies).select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    members = materialize(members, "members")
    firsts = materialize(lookup_join(full, copies, "d", rows=n_copies).where("rep is null or rep = id").select("id", "n", "f1", "f2", "bands"), "firsts")

    # what looks like the same set in another text: confirmed on full sets, then under the smallest identifier too
    keys = ["n", "f1", "f2"]
    alike = firsts.groupBy(*keys).agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count("*").alias("n_alike")).where("a < last")
    pairs = materialize(lookup_join(firsts.select("id", *keys), materialize(alike.drop("last"), "alike"), keys, "inner").where("id <> a"), "alike-pairs")
    same = pairs.select(F.col("a").alias("id")).union(pairs.select("id")).distinct()
    equal = _verify(pairs.select("a", F.col("id").alias("b"), F.col("n_alike").alias("n")), materialize(lookup_join(rows, materialize(same, "wanted"), "id", "left_semi"), "texts"), 100)
    merged = pairs.join(equal.withColumnRenamed("b", "id"), ["a", "id"]).select("id", *keys).distinct()
    singles = firsts.join(merged.hint("merge"), ["id", *keys], "left_anti").select("id", F.explode("bands").alias("key"))
    singles = materialize(singles, "bands")

    # buckets of more than one class, each with its smallest member
    leads = singles.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count("*").alias("n")).where("lead < last").drop("last")
    leads = materialize(leads, "leads")
    buckets = materialize(lookup_join(singles, leads, "key", "inner"), "buckets")
    wanted = buckets.select("id").distinct()
    texts = materialize(rows.join(materialize(wanted, "wanted").hint("merge"), "id", "left_semi"), "texts")

    pairs = buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), "n")
    links = _verify(pairs, texts)
    parents = components(links.union(equal))

    apart = _apart(buckets, parents)
    small = apart.where(F.col("n") <= SMALL)
    left, right = small.select("key", F.col("id").alias("a"), F.col("p").alias("pa"), "lead"), small.select("key", F.col("id").alias("b"), F.col("p").alias("pb"))
    pairs = left.join(right, "key").where("a < b and pa <> pb and a <> lead").select("a", "b", F.lit(SMALL).alias("n"))
    links = _verify(pairs, texts)
    parents = components(links, parents)

    large = _apart(buckets.where(F.col("n") > SMALL), parents)
    links = _across(large, texts)
    parents = components(links, parents)

    found = lookup_join(members, parents.where("p <> v").select(F.col("v").alias("rep"), "p"), "rep")
    component = F.coalesce("p", "rep")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _across(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components inside families of large buckets (buckets that share members)."""
    family = components(large.select(F.col("lead").alias("a"), F.col("id").alias("b")))
    own = lookup_join(large.select("id", "p").distinct(), family.select(F.col("v").alias("id"), F.col("p").alias("c")), "id", "inner")
    own = materialize(own, "families")
    sizes = own.groupBy("c", "p").count().groupBy("c").agg(F.max(F.struct("count", "p")).alias("m"), F.sum("count").alias("all"))
    sizes = materialize(sizes.select("c", F.col("m.p").alias("main"), F.ceil(F.col("all") / BLOCK).alias("nj"), F.ceil((F.col("all") - F.col("m.count")) / BLOCK).alias("ni")), "family-sizes")
    own = lookup_join(own, sizes, "c", "inner")
    spot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    rest = own.where("p <> main").select("c", spot(F.col("ni")).alias("i"), every(F.col("nj")).alias("j"), F.lit(1).alias("role"), "id", "p")
    whole = own.where("ni > 0").select("c", every(F.col("ni")).alias("i"), spot(F.col("nj")).alias("j"), F.lit(0).alias("role"), "id", "p")
    rows = rest.union(whole)
    return materialize(_compare_blocks(rows.join(texts.hint("merge"), "id")), "block-links")


def op6_near_duplicates(spark, sf_dir):
    """Contract: doc_id, n_shingles, component_id, kept of every document."""
    return duplicate_classes(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark, docs, sf_dir):
    """Pipeline stage: of each group of near-duplicates the document with the smallest doc_id stays.

    Rows that share a doc_id stay or go together; they stay if one of them does.
    """
    gone = duplicate_classes(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("any_kept"))
    gone = materialize(gone.where("not any_kept").select("doc_id"), "duplicates")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
