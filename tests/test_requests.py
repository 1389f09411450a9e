"""Requests to providers: what errors lead to, windows, delays, a shared pace."""

import threading
import time

import pytest

from quire.operators import catalog as K
from quire.operators import translation as T


class Failing:
    """Raises the messages in turn, then translates."""

    def __init__(self, *messages):
        self.messages, self.calls = list(messages), 0

    def __call__(self, texts):
        self.calls += 1
        if self.messages:
            raise RuntimeError(self.messages.pop(0))
        return [t.upper() for t in texts]


@pytest.mark.parametrize(("messages", "calls", "error", "waits"), [
    (["DeepL HTTP 429 too many requests"], 1, T.QuotaError, []),
    (["HTTP 456"], 1, T.QuotaError, []),
    (["Character limit reached"], 1, T.QuotaError, []),
    (["HTTP 403 forbidden"], 1, T.RequestError, []),
    (["Google HTTP 404"], 1, T.RequestError, []),
    (["DeepL HTTP 503"], 2, None, [1.0]),
    (["read ETIMEDOUT", "odd"], 3, None, [1.0, 2.0]),
    (["HTTP 400 after fetch failed"], 2, None, [1.0]),
    (["odd", "DeepL HTTP 500", "DeepL HTTP 502"], 3, T.RequestError, [1.0, 2.0]),
    (["odd", "HTTP 456"], 2, T.QuotaError, [1.0]),
])
def test_messages_decide(messages, calls, error, waits):
    failing, slept = Failing(*messages), []
    provider = T.Provider("deepl", failing)
    if error:
        with pytest.raises(error):
            T.call(provider, ["x"], slept.append)
    else:
        assert T.call(provider, ["x"], slept.append) == ["X"]
    assert failing.calls == calls and slept == waits


@pytest.mark.parametrize(("message", "server"), [("DeepL HTTP 503", True), ("failed after 3 attempts: DeepL HTTP 503", True), ("ECONNRESET", True), ("Google HTTP 503", False), ("HTTP 403", False), ("2 results for 1 texts", False)])
def test_whose_fault(message, server):
    assert T.RequestError(message).server is server


class Counting:
    """Notes the sizes of requests, how many run at once, and when each began."""

    def __init__(self):
        self.sizes, self.most, self.now, self.began, self.lock = [], 0, 0, [], threading.Lock()

    def __call__(self, texts):
        with self.lock:
            self.sizes.append(len(texts))
            self.now += 1
            self.most = max(self.most, self.now)
            self.began.append(time.monotonic())
        time.sleep(0.02)
        with self.lock:
            self.now -= 1
        return [t.upper() for t in texts]


TEXT = "".join(f"Sentence number {k} of this text. " for k in range(120))


@pytest.mark.parametrize(("name", "limit", "sizes", "at_once", "pauses"), [("deepl", 100, None, 1, 0), ("deepl", 40, "single", 5, 0), ("google", 400, "single", 3, "every")])
def test_windows(name, limit, sizes, at_once, pauses):
    counting, slept = Counting(), []
    provider = T.Provider(name, counting, **(T.REQUESTS[name] | {"max_chunk": limit}))
    chunks = T.chunk_text(TEXT, limit)
    assert T.translate_text(TEXT, provider, slept.append) == " ".join(c.upper() for c in chunks)
    if sizes is None:
        assert len(chunks) <= 50 and counting.sizes == [len(chunks)]
    else:
        assert counting.sizes == [1] * len(chunks) and counting.most == at_once
    assert slept == ([0.25] * ((len(chunks) - 1) // 3) if pauses == "every" else [])


def test_chapter_requests():
    counting = Counting()
    deepl = T.Provider("deepl", counting)
    assert T.translate_chapter("Title", "Short.", deepl) == ("TITLE", "SHORT.") and counting.sizes == [2]
    assert T.translate_chapter(" ", " \n", deepl) == ("", "") and counting.sizes == [2]
    google = T.Provider("google", counting, **T.REQUESTS["google"])
    assert T.translate_chapter("Title", "Short.", google) == ("TITLE", "SHORT.") and counting.sizes == [2, 1, 1]


def test_pace_is_shared_by_threads():
    counting = Counting()
    provider = T.Provider("google", counting, batch=0, in_flight=8, max_chunk=40)
    T.translate_text(TEXT[:400], provider, pace=T.Pace(50))
    began = sorted(counting.began)
    assert len(began) > 5 and all(b - a > 0.015 for a, b in zip(began, began[1:]))


def items(spark, n=12):
    return spark.createDataFrame([("b", k, f"T{k}", f"Text {k}.", "deepl") for k in range(n)], "book_id string, index int, title string, content string, provider string")


def counted(path, message, name="deepl"):
    """A provider that fails with a message and leaves a mark for every request."""
    def translate(texts):
        with open(path, "a") as f:
            f.write("x")
        raise RuntimeError(message)

    return T.Provider(name, translate)


def test_a_used_up_quota_is_remembered(spark, tmp_path):
    mark = str(tmp_path / "calls")
    got = T.translate_items(items(spark), {"deepl": counted(mark, "HTTP 456 quota exceeded"), "google": T.UpperCase("google")}, partitions=1).collect()
    assert {r.provider for r in got} == {"google"} and sorted(r.translated_content for r in got) == sorted(f"TEXT {k}." for k in range(12))
    assert len(open(mark).read()) == 1


@pytest.mark.parametrize(("message", "fallback", "falls"), [("DeepL HTTP 503", True, True), ("DeepL HTTP 503", False, False), ("HTTP 403", True, False), ("odd", True, False)])
def test_fallback_on_the_providers_faults_only(spark, tmp_path, monkeypatch, message, fallback, falls):
    monkeypatch.setattr(T, "BACKOFF", 0.0)
    job = T.translate_items(items(spark, 1), {"deepl": counted(str(tmp_path / "c"), message), "google": T.UpperCase("google")}, fallback_on_error=fallback, partitions=1)
    if falls:
        assert job.first().provider == "google"
    else:
        with pytest.raises(Exception, match="HTTP|odd"):
            job.collect()


def test_rate_of_the_account(spark):
    began = time.monotonic()
    got = T.translate_items(items(spark, 10), {"deepl": T.UpperCase()}, partitions=2, rate=20).collect()
    assert len(got) == 10 and time.monotonic() - began > 0.2  # two tasks, ten requests a second each


def test_point_is_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    assert K.point(rows, id=1).first().v == "a" and K.point(rows, id=3).collect() == []
    with pytest.raises(Exception, match="more than one row"):
        K.point(rows, id=2).collect()
