"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language (one to
three letters, word bounds marked). A document is ranked the same way and gets
the language whose profile has the least out-of-place distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import least_hashes, lookup_join, materialize, small_batches, spare_name, table, text_blocks, tidy

PROFILE = 300
#: Distinct n-grams of a language that a task holds before it passes their counts on.
HELD = 1 << 20
#: Labelled documents per language that a profile is learned from, about.
MAX_DOCS = 3000
UNKNOWN = "und"
#: Documents whose own ranking is further from every profile than this are no known language (1: nothing shared).
MAX_DISTANCE = 0.9
#: Longer ones (n-grams in their ranking) are held to the distances of the labelled documents: a quantile of these, and a margin.
ENOUGH, QUANTILE, MARGIN = 50, 0.999, 0.2
#: Bins in which distances are counted to find an exact quantile. Only speed depends on it.
BINS = 4096

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a whole text, ascending, and their counts.

    Letters take 21 bits each; a run of other characters is one word bound
    (code 1). N-grams do not reach across a bound.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.where(letter, codes, 1).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    row = np.concatenate([[1], row[keep], [1]]) if letter[0] else np.concatenate([row[:1], row[keep], [1]])
    if not letter[-1]:
        row = row[:-1]
    two = row[:-1] << 21 | row[1:]
    three = two[:-1] << 21 | row[2:]
    return np.unique(np.concatenate([row[row > 1], two, three[row[1:-1] > 1]]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, equal counts in the order of their codes."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank-order profiles of all languages, ready for look-up."""

    def __init__(self, ranks: dict[str, list[int]], size: int):
        self.languages, self.size = sorted(ranks), size
        self.keys, self.ranks = [], []
        for lang in self.languages:
            own = np.array(ranks[lang], np.int64)
            order = np.argsort(own)
            self.keys.append(own[order])
            self.ranks.append(order)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, from 0 to 1; an n-gram that a profile lacks counts ``size``."""
        place, out = np.arange(len(own)), np.ones(len(self.languages))
        for i, (keys, ranks) in enumerate(zip(self.keys, self.ranks, strict=True)):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            far = np.where(keys[at] == own, np.abs(ranks[at] - place), self.size)
            out[i] = far.sum() / (len(own) * self.size)
        return out


def _labelled(docs: DataFrame, text_col: str, lang_col: str, id_col: str, max_docs: int | None) -> DataFrame | None:
    """All labelled documents (lang, text), or about ``max_docs`` of each language; then None without any."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    if max_docs is None:
        return rows.select("lang", "text")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    share = docs.sparkSession.createDataFrame([(r["lang"], least_hashes(max_docs, r["count"])) for r in counts], "lang string, most long")
    # one row a language
    rows = lookup_join(rows, share, "lang", "inner", len(counts))
    return rows.where(F.xxhash64("i", "lang") <= F.col("most")).select("lang", "text")


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *, size: int = PROFILE, max_docs: int | None = MAX_DOCS) -> Profiles:
    """Profiles from labelled documents; rows with a null label or text are left out.

    Of each language about ``max_docs`` documents are taken, chosen by a hash of
    the identifier; with None all are. Every language of the table is learned; the driver and the
    broadcast hold ``size`` n-grams of each, about 5 KB a language.
    """
    small_batches(docs.sparkSession)
    rows = _labelled(docs, text_col, lang_col, id_col, max_docs)
    if rows is None:
        return Profiles({}, size)

    def flush(lang, parts):
        keys, n = _sum(parts)
        for at in range(0, len(keys), 50_000):
            k = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[at : at + 50_000])], names=["lang", "gram", "n"])

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
                if len(held[lang]) >= 200:
                    held[lang] = [_sum(held[lang])]
                    if len(held[lang][0][0]) > HELD:  # the shuffle sums what is sent twice
                        yield from flush(lang, held.pop(lang))
        for lang, parts in held.items():
            yield from flush(lang, parts)

    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    ranks: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranks, size)


def _sum(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", out: str = "language", *, sharpness: float = 25.0) -> DataFrame:
    """Append ``out``: struct of lang, score (0 to 1), distance (to the chosen profile, 0 to 1) and n_grams (in the document's ranking).

    Null texts and texts without a letter give ``und``, score 0, distance 1 and no n-grams.
    The score compares the distances to all languages; equal distances go to
    the first language by name. Other columns pass unchanged. No shuffle; the
    broadcast holds the profiles only.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("distance", pa.float64()), ("n_grams", pa.int32())])

    @F.arrow_udf("lang string, score double, distance double, n_grams int")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p: Profiles = shared.value
        for texts in batches:
            langs, scores, distances, sizes = [], [], [], []
            for block in text_blocks(texts, max_bytes=4 << 20):
                for text in block.to_pylist():
                    keys, counts = grams(text) if text else ((), ())
                    sizes.append(min(len(keys), p.size))
                    if not len(keys) or not p.languages:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        distances.append(1.0)
                        continue
                    d = p.distances(ranked(keys, counts, p.size))
                    best = int(d.argmin())
                    langs.append(p.languages[best])
                    scores.append(float(1 / np.exp(-sharpness * (d - d[best])).sum()))
                    distances.append(float(d[best]))
            yield pa.StructArray.from_arrays([pa.array(langs), pa.array(scores, pa.float64()), pa.array(distances, pa.float64()), pa.array(sizes, pa.int32())], fields=list(kind)) if langs else pa.array([], kind)

    return docs.withColumn(out, run(F.col(text_col)))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the identifier as text leaves ``part``; a null identifier is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def op7_language_id(spark, sf_dir):
    """Contract: doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    profiles = learn_profiles(docs.where(~out & F.col("doc_id").isNotNull()))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.distance")


def quantile(values: DataFrame, share: float) -> float | None:
    """Exact quantile of a column of numbers from 0 to 1, between neighbours in proportion; None without rows.

    ``values`` is read twice, so it should be materialised. The driver holds the
    counts of ``BINS`` bins, then those of the distinct values of at most two.
    """
    x = F.col(values.columns[0])
    bins = F.floor(x * BINS).cast("int")
    counted = values.groupBy(bins.alias("v")).agg(F.count("*").alias("n")).sort("v").collect()
    if not counted:
        return None
    position = (sum(r["n"] for r in counted) - 1) * share
    wanted, found, before = (math.floor(position), math.ceil(position)), {}, 0
    for r in counted:
        inside = [k for k in wanted if before <= k < before + r["n"] and k not in found]
        if inside:
            at = before
            for v, n in values.where(bins == r["v"]).groupBy(x.alias("v")).agg(F.count("*").alias("n")).sort("v").collect():
                found |= {k: v for k in inside if at <= k < at + n}
                at += n
        before += r["n"]
    low, high = (found[k] for k in wanted)
    return low + (position - wanted[0]) * (high - low)


def distance_limit(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> float:
    """Distance beyond which a document of ``ENOUGH`` n-grams is no known language: from the distances of all labelled documents."""
    near = identify(_labelled(docs, text_col, lang_col, id_col, None), profiles, out="found")
    return limit_of(materialize(near.select("found.distance", "found.n_grams"), "distances"))


def limit_of(found: DataFrame) -> float:
    """The same from the labelled documents' (distance, n_grams), read twice."""
    high = quantile(found.where(F.col("n_grams") >= ENOUGH).select("distance"), QUANTILE)
    return MAX_DISTANCE if high is None else min(MAX_DISTANCE, high + MARGIN)


def keep_known_languages(spark, docs, sf_dir):
    """Pipeline stage: drop documents without letters and those far from every profile.

    Far is ``MAX_DISTANCE`` for short documents, for others ``distance_limit``.
    Profiles and limit come from all labelled documents; documents are
    identified once, for the limit and for the decision. Null texts go, null
    identifiers and labels stay but are not learned from; repeated rows are
    decided alike; columns pass unchanged, whatever their names.
    """
    labelled = ~held_out(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    profiles = learn_profiles(docs.where(labelled), max_docs=None)
    own = spare_name(docs, "language")
    found = materialize(identify(docs, profiles, out=own), "languages")
    limit = limit_of(found.where(labelled).select(f"{own}.distance", f"{own}.n_grams"))
    far = F.when(F.col(f"{own}.n_grams") < ENOUGH, MAX_DISTANCE).otherwise(limit)
    return found.where((F.col(f"{own}.lang") != UNKNOWN) & (F.col(f"{own}.distance") <= far)).drop(own)
