"""The status machine over a stream against the fold of a batch: late events, a restart, refused starts."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire.operators import catalog as K
from quire.streaming.status import STORE, status_changes

SCHEMA = "event_id long, book_id long, ts timestamp, kind string"
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def events(seed, n=400):
    pick = random.Random(seed)
    return [(k, pick.choice([1, 1, 1, *range(2, 12)]), BEGIN + dt.timedelta(seconds=pick.randint(0, 3) + 5 * k), pick.choice(["start", "start", "complete", "cancel", "fail", "open"])) for k in range(n)]


def folded(rows):
    out, status = [], {}
    for event_id, book, ts, kind in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind != "open":
            refused = kind == "start" and status.get(book) == "translating"
            status[book] = {"start": "translating", "complete": "completed"}.get(kind, "none")
            out.append((book, event_id, kind, refused, status[book]))
    return sorted(out)


def write(folder, name, rows):
    table = pa.Table.from_pylist([dict(zip(("event_id", "book_id", "ts", "kind"), r, strict=True)) for r in rows], pa.schema([("event_id", pa.int64()), ("book_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("kind", pa.string())]))
    pq.write_table(table, os.path.join(folder, name))


@pytest.mark.parametrize("seed", [1])
def test_stream_equals_fold(spark, tmp_path, seed):
    """Events come shuffled within two minutes; the query stops half way and is started again from its checkpoint."""
    source = tmp_path / "in"
    source.mkdir()
    rows = events(seed)
    pick = random.Random(seed)
    came = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=pick.randint(0, 110)))
    assert came != rows
    spark.conf.set(*STORE)
    try:
        for half in (came[:200], [*came[200:], (10**6, 99, BEGIN + dt.timedelta(days=1), "open"), (10**6 + 1, 99, BEGIN + dt.timedelta(days=1), "cancel")]):
            for k in range(0, len(half), 100):
                write(source, f"{half[0][0]}-{k}.parquet", half[k : k + 100])
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
            query = status_changes(stream, "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None
    finally:
        spark.conf.unset(STORE[0])
    got = spark.read.parquet(str(tmp_path / "out")).where("event_id < 1000000").select("book_id", "event_id", "kind", "refused", "translation_status").collect()
    assert sorted(map(tuple, got)) == folded(rows)
    assert any(r.refused for r in got)


def test_batch_equals_fold(spark):
    rows = events(7) + [(9000, None, BEGIN, "start"), (9001, None, BEGIN, "start")]
    got = K.status_steps(spark.createDataFrame(rows, SCHEMA)).select("book_id", "event_id", "kind", "refused", "translation_status").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, folded([r for r in rows if r[1] is not None]) + [(None, 9000, "start", False, "translating"), (None, 9001, "start", True, "translating")]))
