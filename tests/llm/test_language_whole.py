"""The pipeline's language stage learns from all labelled documents."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.llm import language_id as L


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """More labelled documents of one language than ``MAX_DOCS``, ever further from its profile, and rows that teach nothing."""
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(60)]
    other = ["".join(draw.choices("stuvwxyz", k=4)) for _ in range(60)]
    n = L.MAX_DOCS * 2
    texts = [" ".join(draw.choice(other if draw.random() < (k / n) ** 4 / 2 else words) for _ in range(60)) for k in range(n)]
    rows = pa.table({"doc_id": [*range(n), n, n + 1], "text": [*texts, "Ω " * 40, None], "lang": [*["a"] * n, None, "b"]})
    at = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    pq.write_table(rows, at)
    return spark.read.parquet(at)


def test_profiles_and_limit_from_all(docs, monkeypatch):
    monkeypatch.setattr(L, "MARGIN", 0.0)
    texts = [r.text for r in docs.where("lang = 'a'").collect()]
    counts = Counter()
    for t in texts:
        counts.update(dict(zip(*(x.tolist() for x in L.grams(t)), strict=True)))
    want = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: L.PROFILE]]
    profiles = L.learn_profiles(docs, max_docs=None)
    ranks = np.argsort(profiles.ranks[0])
    assert profiles.languages == ["a"] and profiles.keys[0][ranks].tolist() == want
    own = [L.ranked(*L.grams(t), L.PROFILE) for t in texts]
    far = [profiles.distances(x)[0] for x in own if len(x) >= L.ENOUGH]
    limit = L.distance_limit(docs, profiles)
    assert limit < L.MAX_DISTANCE and limit == pytest.approx(np.quantile(far, L.QUANTILE), abs=1e-12)


def test_stage_uses_all(spark, docs, monkeypatch):
    """A bound on documents a language changes nothing in the stage."""
    taught = docs.where(~L.held_out(docs.doc_id, 4, 2))
    profiles = L.learn_profiles(taught, max_docs=None)
    seen = {}
    monkeypatch.setattr(L, "identify", lambda rows, p, *a, _own=L.identify, **k: seen.setdefault("p", p) and _own(rows, p, *a, **k))
    assert L.keep_known_languages(spark, docs, None).where("doc_id >= 6000").count() == 0
    assert [x.tolist() for x in seen["p"].ranks] == [x.tolist() for x in profiles.ranks]
    assert [x.tolist() for x in seen["p"].keys] == [x.tolist() for x in profiles.keys]


@pytest.mark.parametrize("values", [[], [0.25], [1.0, 0.0], [0.5] * 7, [0.1, 0.1000001, 0.9, 1.0, 0.3]])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.999, 1.0])
def test_quantile(spark, values, share):
    got = L.quantile(spark.createDataFrame([(v,) for v in values], "x double"), share)
    assert got is None if not values else got == pytest.approx(np.quantile(values, share), abs=1e-15)
