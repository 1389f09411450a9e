"""Chunking, providers, quota planning, and the map over chapters.

A provider is a plain object with a name, ``translate(list of texts) -> list of
texts`` and the way its requests go. Provider calls need a network
and are not part of this package; ``Provider`` is the interface, and
``UpperCase`` a deterministic stand-in.
"""

from __future__ import annotations

import contextlib
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dialect import SparkOps, either
from ..functions.text import normalize
from .scan import running_sums

S = SparkOps
MAX_CHUNK = {"deepl": 4500, "google": 3000}
#: Attempts and backoff of one request, in seconds.
ATTEMPTS, BACKOFF, BACKOFF_MAX = 3, 1.0, 6.0

_SENTENCE_END = re.compile(P.SENTENCE_END)


# ------------------------------------------------------------------ chunks


def _pack(pieces: list[str], limit: int, gap: str) -> list[str]:
    """Fill chunks in order without passing ``limit``, unless one piece alone does."""
    out, current = [], ""
    for piece in pieces:
        if current and len(current) + len(gap) + len(piece) > limit:
            out.append(current)
            current = piece
        else:
            current = current + gap + piece if current else piece
    return [*out, current] if current else out


def chunk_text(text: str, limit: int) -> list[str]:
    """Chunks of whole sentences, trimmed, none over ``limit`` characters but single words.

    A text within the limit is its own chunk. A sentence ends after its
    terminators, closing marks and the white space behind them; terminators at
    the start and text after the last terminator count as sentences, so nothing
    is lost. Sentences over the limit are cut between words. One linear scan.
    """
    if len(text) <= limit:
        return [text]
    sentences, at = [], 0
    for m in _SENTENCE_END.finditer(text):
        sentences.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        sentences.append(text[at:])
    out: list[str] = []
    run: list[str] = []
    for s in sentences:
        if len(s) > limit:
            out += _pack(run, limit, "")
            out += _pack(s.split(), limit, " ")
            run = []
        else:
            run.append(s)
    out += _pack(run, limit, "")
    return [c for c in (c.strip() for c in out) if c]


def chunks(x: Column, limit: int) -> Column:
    """Array of chunks; null gives an empty array. Arrow batches, no row-at-a-time calls."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([chunk_text(t, limit) if t is not None else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(x)


def contains_html(x: Column) -> Column:
    return S.match(x, r"<[a-zA-Z!\/][^>]*>")


# ------------------------------------------------------------------ errors and capacity


def is_quota_error(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return either([F.contains(low, F.lit(x)) for x in P.QUOTA_ERRORS])


def is_server_error(message: Column) -> Column:
    message = F.coalesce(message, F.lit(""))
    return message.rlike(P.SERVER_ERROR) | either([F.contains(F.lower(message), F.lit(x)) for x in P.NETWORK_ERRORS])


def retry_action(message: Column, attempt: Column) -> Column:
    """What follows an error: fail at once, or wait so many milliseconds and try again, at most three times."""
    stop = is_quota_error(message) | (F.contains(message, F.lit("HTTP 4")) & ~is_server_error(message)) | (attempt >= ATTEMPTS - 1)
    wait = F.least(F.lit(1000) * F.pow(F.lit(2), attempt), F.lit(6000)).cast("int")
    return F.when(stop, F.lit(-1)).otherwise(wait)


def capacity(used: Column, limit: Column) -> tuple[Column, Column]:
    """Remaining characters, and whether more than one percent is left (no limit: always)."""
    rest = F.greatest(F.lit(0), limit - used)
    return rest, (limit == 0) | (rest > limit * F.lit(0.01))


def probe(source: Callable[[], tuple[int, int] | None] | None, timeout: float = 5.0) -> dict | None:
    """Usage of the account from ``source`` (characters used, limit), asked once on the driver.

    None, for unknown, without a source, on any failure, and if it takes longer
    than ``timeout`` seconds.
    """
    if source is None:
        return None
    answer: list = []

    def ask():
        with contextlib.suppress(Exception):  # whatever goes wrong, the usage is unknown
            used, limit = source()
            rest = max(0, int(limit) - int(used))
            answer.append({"used": int(used), "limit": int(limit), "remaining": rest, "has_capacity": int(limit) == 0 or rest > int(limit) * 0.01})

    worker = threading.Thread(target=ask, daemon=True)
    worker.start()
    worker.join(timeout)
    return answer[0] if answer else None


def expected_provider(has_key: Column, has_capacity: Column, remaining: Column, total: Column) -> tuple[Column, Column]:
    """Provider of a run, and a warning or null. Unknown capacity (null) counts as enough."""
    exhausted = ~F.coalesce(has_capacity, F.lit(True))
    provider = F.when(~has_key | exhausted, "google").otherwise("deepl")
    short = F.concat(F.lit("only "), F.format_number(remaining, 0), F.lit(" of "), F.format_number(total, 0), F.lit(" characters left"))
    return provider, F.when(has_key & exhausted, "quota exhausted").when(has_key & (remaining < total), short)


def plan_providers(items: DataFrame, remaining: int | None, *, has_key: bool = True, order: tuple[str, ...] = ("index",), book: str = "book_id", size: str = "char_count") -> DataFrame:
    """Adds ``spent`` (characters of the account up to and with an item) and the provider that fits.

    Tasks share no state, so the moment the quota ends is planned: books follow
    each other by identifier, and items go to the first provider while the
    account's running sum fits ``remaining``. Unknown remaining (None) puts no
    bound. The sum is a scan over all items (``scan.running_sums``), for which
    they travel without their texts; items of equal book and order are spent together.
    """
    keys = [book, *order]
    narrow = items.groupBy(*keys).agg(F.sum(F.coalesce(size, F.lit(0))).alias("_size"))
    spent = running_sums(narrow, [], keys, spent=F.col("_size")).select(F.struct(*keys).alias("_key"), "spent")
    rows = items.join(spent, F.struct(*keys).eqNullSafe(F.col("_key"))).drop("_key")
    fits = F.lit(True) if remaining is None else F.col("spent") <= F.lit(remaining)
    return rows.withColumn("provider", F.when(F.lit(has_key) & fits, "deepl").otherwise("google"))


def overall_provider(translated: DataFrame, book: str = "book_id") -> DataFrame:
    """Per book: the only provider used, ``mixed`` if there are several, ``deepl`` if none is known."""
    used = F.collect_set(F.when(F.col("provider") != "", F.col("provider")))
    return translated.groupBy(book).agg(F.when(F.size(used) > 1, "mixed").when(F.size(used) == 1, F.get(used, F.lit(0))).otherwise("deepl").alias("provider"))


def legacy_provider(translated: DataFrame, book: str = "book_id") -> DataFrame:
    """Per book: ``deepl`` if it was used at all, else ``google``."""
    return translated.groupBy(book).agg(F.when(F.coalesce(F.bool_or(F.col("provider") == "deepl"), F.lit(False)), "deepl").otherwise("google").alias("provider"))


# ------------------------------------------------------------------ the map over chapters


class QuotaError(Exception):
    """The provider's quota is used up."""


class RequestError(Exception):
    """A request failed for good. ``server``: on the provider's side or on the way there, so another provider may help."""

    def __init__(self, message: str = "", server: bool | None = None):
        super().__init__(message)
        self.server = _is_server(message) if server is None else server


def _is_quota(message: str) -> bool:
    return any(x in message.lower() for x in P.QUOTA_ERRORS)


def _is_server(message: str) -> bool:
    return re.search(P.SERVER_ERROR, message) is not None or any(x in message.lower() for x in P.NETWORK_ERRORS)


@dataclass
class Provider:
    """A named function from texts to texts.

    ``batch``: texts of one request, at most; a text in more chunks, and every
    text where it is 0, goes chunk by chunk, ``in_flight`` requests at a time,
    ``delay`` seconds between such windows. Requests that fail raise any
    exception; what follows depends on its message (``call``).
    """

    name: str
    translate: Callable[[list[str]], list[str]]
    max_chunk: int = 4500
    batch: int = 50
    in_flight: int = 5
    delay: float = 0.0


#: How requests go to each provider.
REQUESTS = {"deepl": {"max_chunk": 4500, "batch": 50, "in_flight": 5, "delay": 0.0}, "google": {"max_chunk": 3000, "batch": 0, "in_flight": 3, "delay": 0.25}}


def UpperCase(name: str = "deepl", max_chunk: int | None = None) -> Provider:
    """Deterministic stand-in: upper-cases each text. Requests go as those to the provider of that name, without its delay."""
    settings = REQUESTS.get(name, REQUESTS["deepl"]) | {"delay": 0.0} | ({"max_chunk": max_chunk} if max_chunk else {})
    return Provider(name, lambda texts: [t.upper() for t in texts], **settings)


class Pace:
    """Requests begin at least ``1 / rate`` seconds apart, whichever thread makes them; None puts no bound."""

    def __init__(self, rate: float | None = None, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep = 1 / rate if rate else 0.0, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = self.clock()
                at = max(now, self.next)
                self.next = at + self.gap
            if at > now:
                self.sleep(at - now)


def call(provider: Provider, texts: list[str], sleep=time.sleep, pace: Pace | None = None) -> list[str]:
    """One request with retries; results must match the texts in number.

    An error's message decides: a used-up quota ends in ``QuotaError`` at once, a
    refused request ("HTTP 4..") in ``RequestError`` at once; failures of the
    provider or the network and all others are tried again, three times in all.
    """
    for attempt in range(ATTEMPTS):
        try:
            if pace:
                pace.wait()
            out = provider.translate(texts)
            if len(out) != len(texts):
                raise RequestError(f"{len(out)} results for {len(texts)} texts")
            return out
        except (QuotaError, RequestError):
            raise
        except Exception as e:
            message = str(e)
            if _is_quota(message):
                raise QuotaError(message) from e
            if "HTTP 4" in message and not _is_server(message):
                raise RequestError(message) from e
            if attempt == ATTEMPTS - 1:
                raise RequestError(f"failed after {ATTEMPTS} attempts: {e}", _is_server(message)) from e
            sleep(min(BACKOFF * 2**attempt, BACKOFF_MAX))
    raise AssertionError


def _windows(parts: list[str], provider: Provider, sleep, pace: Pace | None) -> list[str]:
    """Results of single-chunk requests in order, a window of them at a time; the first failure ends the text."""
    out: list[str] = []
    with ThreadPoolExecutor(provider.in_flight) as pool:
        for at in range(0, len(parts), provider.in_flight):
            if at and provider.delay:
                sleep(provider.delay)
            out += [x for done in pool.map(lambda part: call(provider, [part], sleep, pace), parts[at : at + provider.in_flight]) for x in done]
    return out


def translate_text(text: str, provider: Provider, sleep=time.sleep, pace: Pace | None = None) -> str:
    """One text: all chunks in one request if the provider takes as many, else in windows; joined by a space."""
    if not text.strip():
        return ""
    parts = chunk_text(text, provider.max_chunk)
    return " ".join(call(provider, parts, sleep, pace) if len(parts) <= provider.batch else _windows(parts, provider, sleep, pace))


def translate_chapter(title: str, content: str, provider: Provider, sleep=time.sleep, pace: Pace | None = None) -> tuple[str, str]:
    """Title and content: in one request if the provider takes several texts and the content is one chunk, else side by side."""
    texts = [title if title.strip() else "", content if content.strip() else ""]
    if provider.batch > 1 and len(chunk_text(texts[1], provider.max_chunk)) <= 1:
        done = iter(call(provider, [x for x in texts if x], sleep, pace) if any(texts) else [])
        title, content = (next(done) if x else "" for x in texts)
        return title, content
    with ThreadPoolExecutor(2) as pool:
        title, content = pool.map(lambda x: translate_text(x, provider, sleep, pace), texts)
    return title, content


def translate_book(content: str, chapters: list[tuple[str, str]], translate: Callable[[str, str], tuple[str, str, str]]) -> dict:
    """A whole book on one machine: ``translate`` gives title, content and used provider of each chapter.

    Without chapters the content goes as one text. The provider is "deepl" if it
    was used at all. For many books use ``translate_items`` and ``translated_books``.
    """
    began = time.monotonic()
    done = [translate(title, text) for title, text in chapters]
    single = translate("", content) if not chapters else None
    used = {name for *_, name in done}
    return {
        "content": single[1] if single else "\n\n".join(text for _, text, _ in done),
        "chapters": [(title, text) for title, text, _ in done],
        "provider": single[2] if single else "deepl" if "deepl" in used else "google",
        "stats": {"total_chunks": 0, "total_characters": sum(len(text) for _, text in chapters) if chapters else len(content), "duration_ms": int((time.monotonic() - began) * 1000)},
    }


def translate_items(items: DataFrame, providers: dict[str, Provider], *, fallback_on_error: bool = False, partitions: int | None = None, rate: float | None = None) -> DataFrame:
    """Translate (book_id, index, title, content, provider): adds translated_title, translated_content, used provider, duration_ms.

    Texts are normalised first. When a provider's quota is used up, the chapter
    and all later ones of the task go to "google"; with ``fallback_on_error`` a
    chapter also goes there whose provider fails on its side (5xx, network).
    Other errors fail the task, which Spark retries. Chapters are dealt evenly
    by book and index, so a long book is shared by all tasks. ``rate`` bounds
    the account's requests a second: tasks that may run at once share it evenly.
    """
    rows = items.select("book_id", "index", normalize(F.col("title")).alias("title"), normalize(F.col("content")).alias("content"), "provider")
    rows = rows.repartition(partitions, "book_id", "index") if partitions else rows.repartition("book_id", "index")
    kinds = dict(items.dtypes)
    ddl = f"book_id {kinds['book_id']}, index {kinds['index']}, translated_title string, translated_content string, provider string, duration_ms bigint"
    at_once = min(partitions or 1 << 30, items.sparkSession.sparkContext.defaultParallelism)
    share = rate / at_once if rate else None

    def run(batches):
        used_up: set[str] = set()
        pace = Pace(share)
        for batch in batches:
            out = []
            for title, content, name in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                began = time.monotonic()
                name = "google" if name in used_up else name
                try:
                    got = translate_chapter(title, content, providers[name], pace=pace)
                except (QuotaError, RequestError) as e:
                    quota = isinstance(e, QuotaError)
                    if name == "google" or not (quota or (fallback_on_error and e.server)):
                        raise
                    if quota:
                        used_up.add(name)
                    name = "google"
                    got = translate_chapter(title, content, providers[name], pace=pace)
                out.append((*got, name, int((time.monotonic() - began) * 1000)))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, types, strict=True)]], names=["book_id", "index", "translated_title", "translated_content", "provider", "duration_ms"])

    return rows.mapInArrow(run, ddl)


def translated_books(translated: DataFrame) -> DataFrame:
    """Per book: chapters in order as an array, their contents joined by blank lines, overall provider."""
    item = F.struct(F.col("index").alias("i"), F.col("translated_title").alias("title"), F.col("translated_content").alias("content"))
    grouped = translated.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    content = F.array_join(F.transform("c", lambda x: x["content"]), "\n\n")
    chapters = F.transform("c", lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content")))
    return grouped.select("book_id", chapters.alias("chapters"), content.alias("content")).join(overall_provider(translated), "book_id")
