"""Near duplicates, decontamination, toxicity and language against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import decontaminate as D
from quire.llm import language_id as L
from quire.llm import near_duplicates as N
from quire.llm import toxicity as T
from quire.llm.components import components


def word_sets(documents):
    out = []
    for d in documents:
        w = (d["text"] or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_components(documents):
    sets, n = word_sets(documents), len(documents)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [i for i in range(n) if sets[i] and documents[i]["doc_id"] is not None]
    for k, i in enumerate(live):
        for j in live[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) or documents[i]["doc_id"] == documents[j]["doc_id"]:
                parent[find(i)] = find(j)
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), 1 << 60), documents[i]["doc_id"])
    out = Counter()
    for i, d in enumerate(documents):
        c = least[find(i)] if i in set(live) else d["doc_id"]
        out[d["doc_id"], len(sets[i]), c, c == d["doc_id"] or c is None] += 1
    return out


def near_family(rng, n, words, edits, first):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"v{rng.randrange(10**9)}"
        out.append({"doc_id": first + k, "text": " ".join(w)})
    return out


def test_components_of_odd_documents(spark, odd_dir, documents):
    assert Counter(map(tuple, N.op6_near_duplicates(spark, odd_dir).collect())) == brute_components(documents)


def test_a_large_family_loses_no_link(spark):
    """Copies around the threshold: many pairs share bands and fail, and links run across large buckets."""
    rng = random.Random(11)
    docs = near_family(rng, 160, 150, 7, 1000) + near_family(rng, 40, 60, 2, 3000) + [{"doc_id": 5000 + k, "text": f"short {k % 3}"} for k in range(9)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    got, want = Counter(map(tuple, N.duplicate_classes(df).collect())), brute_components(docs)
    assert got == want and len({k[2] for k in want}) > 10


def test_blocks_find_links_that_leaders_miss(spark, monkeypatch):
    rng = random.Random(3)
    docs = near_family(rng, 90, 120, 8, 0)
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "BLOCK", 16)
    assert Counter(map(tuple, N.duplicate_classes(df).collect())) == brute_components(docs)


def test_sketch():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 5000):
        s = N.sketch(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)))
        assert len(s) == N.COORDINATES and s.max() < np.iinfo(np.uint64).max
    errors = []
    for share in (0.3, 0.75, 0.9):
        for _ in range(30):
            n = 400
            both = int(round(2 * n * share / (1 + share)))
            x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n - both :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((N.sketch(a) == N.sketch(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 300)] + [(299, 1000), (7, 7)], [(5, 9), (9, 5), (3, 9), (20, 21)]])
def test_graph_components(spark, edges):
    got = {r.v: r.p for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = v
                    todo += near[x]
    assert got == want


def test_components_merge_through_any_vertex(spark):
    first = components(spark.createDataFrame([(10, 11), (10, 12), (20, 21), (20, 22), (30, 31)], "a long, b long"))
    second = components(spark.createDataFrame([(12, 22), (21, 31), (40, 41)], "a long, b long"), first)
    assert {r.v: r.p for r in second.collect()} == {**{v: 10 for v in (10, 11, 12, 20, 21, 22, 30, 31)}, 40: 40, 41: 40}


# ------------------------------------------------------------------ decontamination


def brute_tiles(doc, item, k):
    """Greedy string tiling as published: longest unmarked common runs first, first in the document, then in the item."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_d[i + n] and not used_i[j + n]:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        for t in range(best[2]):
            used_d[best[0] + t] = used_i[best[1] + t] = True


def test_tiling():
    rng = random.Random(2)
    for _ in range(150):
        doc, item = ([rng.randrange(3) for _ in range(rng.randint(1, 40))] for _ in range(2))
        k = rng.randint(1, 4)
        seeds = [(i, j) for i in range(len(doc) - k + 1) for j in range(len(item) - k + 1) if doc[i : i + k] == item[j : j + k]]
        got = D.tile(np.array(doc), np.array(item), seeds, k)
        assert sum(t[2] for t in got) == sum(t[2] for t in brute_tiles(doc, item, k))


def test_reordered_passages_are_caught(spark):
    words = [f"t{k}" for k in range(40)]
    item = " ".join(words)
    filler = " ".join(f"f{k}" for k in range(30))
    texts = [filler + " " + " ".join(words[20:] + ["zz"] + words[:20]) + " " + filler, " ".join(words[:8]) + filler, filler, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.hits for r in D.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert [(h.item_id, h.coverage, h.n_tiles, h.longest) for h in got[0]] == [(7, 1.0, 2, 20)] and all(got[k] == [] for k in (1, 2, 3, 4))


def test_decontamination_query(spark, odd_dir, empty_dir, documents, monkeypatch):
    import pyarrow.parquet as pq

    items = [(b["item_id"], D.tokens(b["text"] or "")) for b in pq.read_table(f"{odd_dir}/benchmark.parquet").to_pylist()]
    want = Counter()
    for d in documents:
        if len(d["text"] or "") > 20_000:
            continue
        doc = D.tokens(d["text"] or "")
        grams = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for i, item in items:
            k = min(5, len(item))
            if item and (any(tuple(item[j : j + 5]) in grams for j in range(len(item) - 4)) if k == 5 else " ".join(item) in " ".join(doc)):
                tiles = brute_tiles(doc, item, k)
                share = sum(t[2] for t in tiles) / len(item)
                if share >= 0.5:
                    want[d["doc_id"], i, round(share, 6), len(tiles), max(t[2] for t in tiles)] += 1
    assert Counter(map(tuple, D.op9_decontamination(spark, odd_dir).collect())) == want and len(want) > 3
    monkeypatch.setattr(D, "BLOCK_BYTES", 700)
    assert Counter(map(tuple, D.op9_decontamination(spark, odd_dir).collect())) == want
    assert D.op9_decontamination(spark, empty_dir).collect() == []


# ------------------------------------------------------------------ toxicity and language


def test_index_equals_full_comparison():
    rng = np.random.default_rng(4)
    terms = [f"t{k}" for k in range(40)]
    examples = []
    for i in range(500):
        t = np.unique(rng.zipf(1.6, rng.integers(0, 8)) % 40)
        examples.append((i, int(rng.random() < 0.3), t.tolist(), rng.integers(1, 5, len(t)).tolist()))
    index = T.Index(terms, 1 + rng.random(40), examples, k=9, block=16)
    index.calibrate()
    dense = np.zeros((500, 40))
    for i, _, t, c in examples:
        if t:
            dense[i, t] = index.weigh(np.array(t), np.array(c, float))
    for _ in range(200):
        t = np.unique(rng.integers(0, 40, rng.integers(1, 6)))
        w = index.weigh(t, rng.integers(1, 4, len(t)).astype(float))
        q = np.zeros(40)
        q[t] = w
        want = np.sort((dense @ q)[dense @ q > 0])[::-1][:9]
        places, sims = index.nearest(t, w, 9)
        assert np.allclose(sims, want) and np.allclose([dense[index.ids[p]] @ q for p in places], sims)
    assert 0 <= index.score(np.array([1]), np.array([1]))[0] <= 1 and index.score(np.zeros(0, int), np.zeros(0, int)) == (index.blank, [])
    assert (np.diff(index.curve[1]) >= 0).all()


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = T.op3_toxicity_neighbours(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93


def test_toxicity_of_odd_documents(spark, odd_dir, empty_dir, documents):
    rows = T.op3_toxicity_neighbours(spark, odd_dir).collect()
    assert len(rows) == len(documents) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    text = {d["doc_id"]: d["text"] for d in documents}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(text[r.doc_id], r.score) == r.score
    assert T.op3_toxicity_neighbours(spark, empty_dir).collect() == []


def brute_grams(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for n in (1, 2, 3):
            p = word if n == 1 else f"\x01{word}\x01"
            for i in range(len(p) - n + 1):
                counts[p[i : i + n]] += 1
    return counts


def test_grams():
    for text in ("Avec.", "  the cat, the hat", "É1é", "a", "x y", "123", "日本語テキスト a", "ab\n"):
        keys, counts = L.grams(text)
        spelled = Counter()
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            s = ""
            while k:
                s, k = chr(k & 0x1FFFFF) + s, k >> 21
            spelled[s] += n
        # a bound between two words starts one n-gram and ends another
        want = brute_grams(text)
        assert spelled == want, (text, spelled - want, want - spelled)


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = L.op7_language_id(spark, sf).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_of_odd_documents(spark, odd_dir, empty_dir, documents):
    rows = L.op7_language_id(spark, odd_dir).collect()
    text = {d["doc_id"]: d["text"] for d in documents}
    assert len(rows) == len(documents)
    for r in rows:
        letters = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
    assert L.op7_language_id(spark, empty_dir).collect() == []


def test_distance_by_hand():
    p = L.Profiles({"a": [10, 20, 30], "b": [30, 40, 50]}, 3)
    assert np.allclose(p.distances(np.array([20, 10, 99])), [(1 + 1 + 3) / 9, 1.0])


def test_equal_sums_are_no_proof(spark, odd_dir, documents, monkeypatch):
    """Sets that only look equal are not linked, and keep their own links."""
    from collections.abc import Iterator

    import pyarrow as pa

    words = [f"w{k}" for k in range(40)]
    docs = [{"doc_id": k, "text": " ".join(words[k % 3 :][:20])} for k in range(9)] + [{"doc_id": 20 + k, "text": " ".join(words[k:][:20]).upper() + "\n" * k} for k in range(4)] + [{"doc_id": 21, "text": "other text " + " ".join(words[22:40])}]
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    want = Counter(map(tuple, N.duplicate_classes(df).collect()))
    plain = N._signature

    def without_sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """All sets of a size look equal."""
        for out in plain(batches):
            n = out.field("n")
            zero = pa.array([0] * len(n), pa.int64())
            yield pa.StructArray.from_arrays([n, zero, zero, out.field("bands")], ["n", "f1", "f2", "bands"])

    monkeypatch.setattr(N, "_signature", without_sums)
    assert Counter(map(tuple, N.duplicate_classes(df).collect())) == want
    assert Counter(map(tuple, N.op6_near_duplicates(spark, odd_dir).collect())) == brute_components(documents)
