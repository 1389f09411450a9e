"""Nearest vectors against full comparison, with every unwelcome row."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm.vector_search import Tile, nearest, op11_vector_search, oracle, products, quantise

NAN, INF = float("nan"), float("inf")


def write(at, rows, kind=pa.float32()):
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": v, "label": 1, "score": "mine", "rank": None, "block": 3} for i, v in rows], pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(kind)), ("label", pa.int32()), ("score", pa.string()), ("rank", pa.int64()), ("block", pa.int64())])), f"{at}/embeddings.parquet")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(700)]
    same = rng.normal(size=16).tolist()
    rows += [(1000 + k, same) for k in range(300)]  # a large group of copies, six of them queries
    rows += [(2000 + k, (np.array(same) + rng.normal(size=16) * 1e-4).tolist()) for k in range(300)]
    rows += [(50, rows[50][1]), (3000, rows[50][1]), (51, rows[50][1]), (50, rng.normal(size=16).tolist())]  # repeated and tied rows
    rows += [(3050, None), (3100, [0.0] * 16), (3150, [1.0, None] * 8), (3200, [NAN] * 16), (3250, [INF] * 16), (3300, []), (None, same), (None, rows[3][1])]
    rows += [(4000, [1.0, 2.0, 3.0]), (4001, [1.0, 2.0, 4.0]), (4050, [-1.0, 2.0, 3.0]), (4100, [5.0])]  # other lengths
    rows += [(5000, [1e38] * 16), (5001, [1e-38] * 16), (5002, [-1e-42] + [0.0] * 15)]
    write(at, rows)
    return str(at), rows


def test_equals_sql(spark, odd):
    at, rows = odd
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, op11_vector_search(spark, at).collect()), key=key)
    assert got == sorted(con.sql(oracle()).fetchall(), key=key)
    assert sum(r[0] == 50 for r in got) == 15  # three rows with that identifier
    assert {r[2] for r in got if r[0] == 4000} == {4001, 4050} and not any(r[0] == 4100 for r in got)


def test_many_blocks(spark, odd, monkeypatch):
    """Blocks of a few vectors, queries spread over several of them."""
    from quire.llm import vector_search

    at, _ = odd
    want = sorted(map(str, op11_vector_search(spark, at).collect()))
    monkeypatch.setattr(vector_search, "LEAST_BYTES", 2000)
    df = spark.read.parquet(f"{at}/embeddings.parquet").repartition(7)
    assert sorted(map(str, nearest(df, queries=F.col("vec_id") % 50 == 0).collect())) == want


def test_doubles_and_other_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5)) * 1e160
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "id int, v array<double>, query_id int")
    got = nearest(df, "id", "v", queries=F.col("id") < 4, k=100).collect()
    assert len(got) == 4 * 89
    y = x / np.linalg.norm(x / 1e160, axis=1, keepdims=True) / 1e160
    for q in range(4):
        order = [c for c in np.argsort(-(y @ y[q])) if c != q]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == order


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 2500):
        a, b = rng.normal(size=(40, dim)), rng.normal(size=(60, dim)) ** 3
        (p, s, e), (q, t, f) = quantise(a), quantise(b)
        assert np.array_equal(products(p, q), p.astype(np.int64) @ q.astype(np.int64).T)
        true = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        bound = e[:, None] + f[None] + e[:, None] * f[None] + 1e-6
        assert (np.abs(products(p, q) * s[:, None] * t[None] - true) <= bound).all()


def test_most_pairs_are_never_computed(monkeypatch):
    from quire.llm import vector_search

    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(50, 64)).astype(np.float32), rng.normal(size=(20_000, 64)).astype(np.float32)
    seen = []
    plain = vector_search.cosines
    monkeypatch.setattr(vector_search, "cosines", lambda x, y: (seen.append(len(x)), plain(x, y))[1])
    best = Tile(q, c, quantise(c), np.arange(20_000), np.full(50, -1), 5).run()
    assert sum(seen) < 50 * 20_000 / 200
    every = plain(np.repeat(q, 20_000, 0), np.tile(c, (50, 1))).reshape(50, -1)
    for row, found in zip(every, best):
        order = np.lexsort((np.arange(20_000), -row))[:5]
        assert [-x[2] for x in found] == order.tolist() and math.isclose(found[0][0], row[order[0]])


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(none, queries=F.lit(True)).collect() == []
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest(one, queries=F.lit(True)).collect() == []
