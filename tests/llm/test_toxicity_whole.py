"""Toxicity over all words, against cosines of whole texts."""

import math
import mmap
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from quire.llm import toxicity as T


def word_counts(text):
    return Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))


def test_cosines_of_whole_texts(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = T.fit(df, labels)
    labelled = {r.doc_id for r in labels.collect()}
    counts = {d["doc_id"]: word_counts(d["text"]) for d in docs}
    inside = {w for i in labelled for w in counts[i]}
    assert set(index.terms) == inside
    seen, n = Counter(w for c in counts.values() for w in c), len(docs)

    toxic = {}
    for r in labels.where("toxic is not null").collect():
        toxic[r.doc_id] = max(r.toxic, toxic.get(r.doc_id, 0))
    # equal examples count once
    distinct = {(toxic[i], frozenset(counts[i].items())) for i in toxic}
    per_label = [Counter(w for y, c in distinct if y == own for w, _ in c) for own in (0, 1)]
    sizes = [max(1, sum(y == own for y, _ in distinct)) for own in (0, 1)]

    def relevance(w):
        return math.log2(2 + max(0, per_label[1][w] - 1) / sizes[1] / ((per_label[0][w] + 1) / sizes[0])) ** 2 if w in inside else 1.0

    assert max(map(relevance, inside)) > 2 and min(map(relevance, inside)) == 1.0

    def vector(c):
        v = {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + (seen[w] if w in inside else 1))) + 1) * relevance(w) for w, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = [vector(counts[i]) for i in labelled]
    got = T.score(df, index).collect()
    assert len(got) == n
    for r in got:
        own = vector(counts[r.doc_id])
        best = sorted((s for s in (sum(x * e.get(w, 0.0) for w, x in own.items()) for e in examples) if s > 1e-9), reverse=True)[:3]
        assert all(abs(e.similarity - x) < 1e-6 for e, x in zip(r.toxicity.evidence, best, strict=True)), r.doc_id


def test_few_labels_still_vote(spark, sf_dir):
    """Sixty-odd distinct examples, ten of them toxic."""
    planted = [(10**9, "you pathetic idiot " * 3), (10**9 + 1, "the and of clown that is a moron and a clown there")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = docs.union(spark.createDataFrame(planted, "doc_id long, text string"))
    kept = {r.doc_id for r in T.drop_toxic(spark, both, sf_dir).collect()}
    assert not kept & {i for i, _ in planted} and len(kept) > 0.9 * docs.count()


def test_pipeline_drops_the_planted_row(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    (_, language), (_, toxic) = corpus_pipeline.STAGES[:2]
    known = language(spark, docs, odd_dir)
    planted = "text like 'you pathetic idiot%'"
    assert known.where(planted).count() == 1 and toxic(spark, known, odd_dir).where(planted).count() == 0


def test_workers_map_the_index(tmp_path):
    """The handle that workers get is small, its arrays are a mapped file, and it scores as the index does."""
    rng = np.random.default_rng(5)
    examples = [(i, int(rng.random() < 0.3), t.tolist(), rng.integers(1, 5, len(t)).tolist()) for i in range(3000) for t in [np.unique(rng.zipf(1.4, 60) % 3000)]]
    terms = pa.array(["none", *(f"ä{k}" for k in range(3000))])[1:]
    index = T.Index(terms, 1 + rng.random(3000), examples, k=9, frequent=64)
    index.calibrate()
    handle = pickle.dumps(index.stored(f"file://{tmp_path}/deep/index"))
    own = pickle.loads(handle).open()
    assert len(handle) < 40_000 and isinstance(mapped(own.posts), mmap.mmap) and isinstance(mapped(own.blocks[0]), mmap.mmap)
    assert own.terms == index.terms and set(own.__dict__) == set(index.__dict__)
    documents = [(t, rng.integers(1, 4, len(t)).astype(float)) for _ in range(300) for t in [np.unique(rng.zipf(1.4, 40) % 3100)]]
    assert own.score_each(documents) == index.score_each(documents)
    bare = pickle.loads(pickle.dumps(T.Index([], np.zeros(0), []).stored(f"{tmp_path}/bare"))).open()
    assert bare.score_each(documents[:1]) == [(0.5, [])]


def mapped(x):
    while isinstance(x, np.ndarray):
        x = x.base
    return x.obj if isinstance(x, memoryview) else x


def test_share_of_labels_at_any_number():
    """Samples of evenly spread 64-bit hashes keep their size from a few labels to far beyond what a share in millionths could say."""
    import numpy as np

    from quire.llm.common import least_hashes

    hashes = np.sort(np.random.default_rng(7).integers(-(2**63), 2**63 - 1, 2_000_000))
    for known in (10**6, 10**9, 10**10, 10**11, 10**12, 10**15):
        most = least_hashes(20_000, known)
        assert -(2**63) <= most < 2**63
        share = (most + 2**63) / 2**64  # of all hashes
        assert abs(share * known - 20_000) < 1
        if known == 10**6:
            assert abs((hashes <= most).mean() - 0.02) < 0.001
    assert least_hashes(20_000, 20_000) == least_hashes(20_000, 3) == least_hashes(1, 0) == 2**63 - 1
