"""Queries and changes on the library tables: books, translations, folders, users.

Changes are functions from tables to tables; what a store does with foreign
keys happens here as joins. All keys are columns named as in ``schema``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SparkOps
from ..storage import materialize
from .scan import numbered

S = SparkOps
LISTED = ("id", "title", "author", "original_filename", "file_size", "upload_date", "source_language", "translation_status", "folder_id")
LISTED_TRANSLATION = ("id", "target_language", "translation_status", "created_at", "provider")


def scoped(df: DataFrame, user_id: str, column: str = "user_id") -> DataFrame:
    """Rows of one user. A filter for convenience, not a security boundary."""
    return df.where(F.col(column) == user_id)


def point(df: DataFrame, **keys) -> DataFrame:
    """The row with given keys, or none. Two rows with these keys are an error of the query: whoever reads it must not get either."""
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    two = F.when(F.col("_rows") > 1, F.raise_error(F.lit(f"more than one row with {', '.join(keys)}"))).otherwise(F.lit(True))
    # at most two rows are counted, whatever the table holds
    return df.limit(2).withColumn("_rows", F.count("*").over(Window.partitionBy(F.lit(0)))).where(two).drop("_rows")


# ------------------------------------------------------------------ listings


def library_listing(books: DataFrame, translations: DataFrame, *, columns=LISTED, inner=LISTED_TRANSLATION, key: str = "epub_file_id") -> DataFrame:
    """Books, newest upload first (unknown dates before), each with an array of its translations by creation. Bodies are not read."""
    item = F.struct(*[c for c in inner if c in translations.columns])
    nested = translations.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["created_at"] < b["created_at"], -1).when(a["created_at"] > b["created_at"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("translations"))
    rows = books.select(*[c for c in columns if c in books.columns]).join(nested, "id", "left")
    kind = dict(nested.dtypes)["translations"]
    return rows.withColumn("translations", F.coalesce("translations", F.array().cast(kind))).orderBy(F.desc_nulls_first("upload_date"), "id")


def latest_per_key(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the one with the larger tie-breaker. One aggregate, no sort of groups."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("r"))
    return best.select(key, "r.*")


def latest_translation(translations: DataFrame, book_id: str, user_id: str) -> DataFrame:
    return translations.where((F.col("epub_file_id") == book_id) & (F.col("user_id") == user_id)).orderBy(F.desc_nulls_first("created_at"), F.desc("id")).limit(1)


def translation_flags(books: DataFrame, translations: DataFrame, key: str = "epub_file_id") -> DataFrame:
    """Books with has_translation and the provider of their latest translation."""
    last = latest_per_key(translations.select(key, "created_at", "id", "provider"), key, "created_at", "id").select(F.col(key).alias("id"), "provider", F.lit(True).alias("has_translation"))
    return books.join(last, "id", "left").withColumn("has_translation", F.coalesce("has_translation", F.lit(False)))


def without_translation(books: DataFrame, translations: DataFrame, key: str = "epub_file_id") -> DataFrame:
    """Books that no translation names; one or more count as done."""
    return books.join(translations.select(F.col(key).alias("id")), "id", "left_anti")


def folder_listing(folders: DataFrame) -> DataFrame:
    return folders.orderBy(F.asc_nulls_last("name"), "id")


def folder_counts(folders: DataFrame, books: DataFrame) -> DataFrame:
    """Every folder with its number of books, empty ones too."""
    n = books.where("folder_id is not null").groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n_books"))
    return folders.join(n, "id", "left").withColumn("n_books", F.coalesce("n_books", F.lit(0)).cast("bigint"))


def in_folder(books: DataFrame, folder_id: str | None) -> DataFrame:
    """Books of a folder; without one, the books outside all folders."""
    return books.where(F.col("folder_id").isNull() if folder_id is None else F.col("folder_id") == folder_id)


def any_translating(books: DataFrame) -> DataFrame:
    return books.agg(F.coalesce(F.bool_or(F.col("translation_status") == "translating"), F.lit(False)).alias("any_translating"))


def may_start(books: DataFrame) -> DataFrame:
    """Books whose translation may start: those under way are not free."""
    return books.where(F.coalesce("translation_status", F.lit("none")) != "translating")


def upload_summary(uploads: DataFrame) -> DataFrame:
    """Numbers of pending, successful and failed uploads, and whether all went well."""
    is_ = lambda v: F.col("status") == v
    return uploads.agg(F.count_if(is_("pending")).alias("pending"), F.count_if(is_("success")).alias("success"), F.count_if(is_("error")).alias("error"), F.coalesce(F.bool_and(is_("success")), F.lit(False)).alias("all_success"))


# ------------------------------------------------------------------ changes


def insert_missing_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users, and of ``incoming`` those whose id is new (repeated ones once)."""
    new = incoming.dropDuplicates(["id"]).join(users.select("id"), "id", "left_anti")
    return users.unionByName(new, allowMissingColumns=True)


def new_book(uploads: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows for the books table from uploads (user_id, original_filename, custom_title, title, author, language, file_size, document)."""
    at = at if at is not None else F.current_timestamp()
    title = F.coalesce(F.when(F.col("custom_title") != "", F.col("custom_title")), F.col("title"))
    path = F.concat("user_id", F.lit("/"), F.unix_millis(at).cast("string"), F.lit("_"), "original_filename")
    return uploads.select(F.uuid().alias("id"), "user_id", title.alias("title"), "author", "original_filename", path.alias("file_path"), F.col("file_size").cast("int").alias("file_size"), F.col("language").alias("source_language"), at.alias("upload_date"), at.alias("created_at"), "document", F.lit("none").alias("translation_status"), F.lit(None).cast("string").alias("folder_id"))


def new_translations(done: DataFrame, at: Column | None = None, language: str = "de") -> DataFrame:
    """Rows for the translations table from finished books (book_id, user_id, original, content, chapters, providers).

    ``providers`` lists what each chapter used, null if unknown: several make
    "mixed", a single one is the row's provider, none gives "deepl".
    """
    at = at if at is not None else F.current_timestamp()
    used = F.array_distinct(F.filter(F.coalesce("providers", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != ""))
    provider = F.when(F.size(used) > 1, "mixed").when(F.size(used) == 1, F.get(used, F.lit(0))).otherwise("deepl")
    body = F.struct(F.coalesce("original", F.lit("")).alias("original"), F.col("content").alias("translated"), "chapters", "providers")
    return done.select(F.uuid().alias("id"), F.col("book_id").alias("epub_file_id"), "user_id", F.parse_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("translated_content"), F.lit(language).alias("target_language"), F.lit("completed").alias("translation_status"), at.alias("created_at"), provider.alias("provider"))


def valid_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Chapter requests (variant ``body``) that can be served: a number as chapterIndex, a title and a content that are not empty."""
    index = F.schema_of_variant(F.try_variant_get(F.col(body), "$.chapterIndex", "variant"))
    text = lambda name: F.coalesce(F.try_variant_get(F.col(body), f"$.{name}", "string"), F.lit("")) != ""
    return requests.where(F.coalesce(index.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False)) & text("title") & text("content"))


def backfill_content(books: DataFrame, column: str = "original_content") -> DataFrame:
    """An empty object where a book has no stored content."""
    return books.withColumn(column, F.coalesce(F.col(column), F.parse_json(F.lit("{}"))))


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """Change columns of the rows that meet a condition; order of columns and rows stay."""
    return df.select(*[F.when(condition, values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def rename_book(books: DataFrame, book_id: str, user_id: str, title: str) -> DataFrame:
    """New title, trimmed. An empty one is refused; white space alone passes and leaves an empty title."""
    if not isinstance(title, str) or title == "":
        raise ValueError("a title is needed")
    return set_where(books, (F.col("id") == book_id) & (F.col("user_id") == user_id), title=S.trim(F.lit(title)))


def move_books(books: DataFrame, ids: DataFrame, user_id: str, folder_id: str | None) -> DataFrame:
    """Put the books whose id is in ``ids`` into a folder, or out of all (null)."""
    marked = books.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    moved = set_where(marked, F.col("_hit").isNotNull() & (F.col("user_id") == user_id), folder_id=F.lit(folder_id).cast("string"))
    return moved.select(*books.columns)


def delete_book(books: DataFrame, translations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books and translations without the books in ``gone`` (id, user_id)."""
    left = books.join(gone.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*books.columns)
    dropped = books.join(gone.select("id", "user_id"), ["id", "user_id"], "left_semi").select(F.col("id").alias("epub_file_id"))
    return left, translations.join(dropped, "epub_file_id", "left_anti").select(*translations.columns)


def delete_folder(folders: DataFrame, books: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders without those in ``gone`` (id); their books are in no folder."""
    marked = books.join(gone.select(F.col("id").alias("folder_id"), F.lit(True).alias("_hit")).distinct(), "folder_id", "left")
    freed = marked.withColumn("folder_id", F.when(F.col("_hit").isNull(), F.col("folder_id"))).select(*books.columns)
    return folders.join(gone.select("id"), "id", "left_anti").select(*folders.columns), freed


def delete_user(users: DataFrame, books: DataFrame, translations: DataFrame, folders: DataFrame, user_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All tables without a user and what belongs to them."""
    keep = lambda df, c: df.where(F.coalesce(F.col(c), F.lit("")) != user_id)
    return keep(users, "id"), keep(books, "user_id"), keep(translations, "user_id"), keep(folders, "user_id")


def add_folder(folders: DataFrame, user_id: str, name: str) -> DataFrame:
    """A new folder, name trimmed; blank names are refused."""
    if not name.strip():
        raise ValueError("a name is needed")
    row = folders.sparkSession.range(1).select(F.uuid().alias("id"), F.lit(user_id).alias("user_id"), S.trim(F.lit(name)).alias("name"), F.current_timestamp().alias("created_at"))
    return folders.unionByName(row)


def rename_folder(folders: DataFrame, folder_id: str, user_id: str, name: str) -> DataFrame:
    if not name.strip():
        raise ValueError("a name is needed")
    return set_where(folders, (F.col("id") == folder_id) & (F.col("user_id") == user_id), name=S.trim(F.lit(name)))


def backfill_status(books: DataFrame, translations: DataFrame, key: str = "epub_file_id") -> DataFrame:
    """Status "completed" for books that a translation names, else "none"."""
    done = translations.select(F.col(key).alias("id")).where("id is not null").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit").isNotNull(), "completed").otherwise("none")
    return books.drop("translation_status").join(done, "id", "left").withColumn("translation_status", status).drop("_hit")


def set_status(books: DataFrame, book_id: str, user_id: str, status: str) -> DataFrame:
    return set_where(books, (F.col("id") == book_id) & (F.col("user_id") == user_id), translation_status=status)


def fold_status(events: DataFrame, key: str = "book_id", kind: str = "kind", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Status per key after its last start, complete, cancel or fail event."""
    status = F.when(F.col(kind) == "start", "translating").when(F.col(kind) == "complete", "completed").otherwise("none")
    known = events.where(F.col(kind).isin("start", "complete", "cancel", "fail"))
    return known.groupBy(key).agg(F.max_by(status, F.struct(at, tie)).alias("translation_status"))


def status_steps(events: DataFrame, key: str = "book_id", kind: str = "kind", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Every start, complete, cancel and fail event with ``refused`` and the status after it.

    A start is refused while the book is translating: when the event before it
    is a start, refused or not. ``streaming.status`` gives the same of a stream.
    Events are numbered by a scan and each is joined to the one before, so a
    book with most of the events is shared by all tasks.
    """
    known = events.where(F.col(kind).isin("start", "complete", "cancel", "fail"))
    rows = materialize(numbered(known.select(key, at, tie, kind), [key], [at, tie], "_n"), "events")
    before = rows.select(F.col(key).alias("_key"), (F.col("_n") + 1).alias("_next"), F.col(kind).alias("_before"))
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("_next")), "left")
    start = F.col(kind) == "start"
    status = F.when(start, "translating").when(F.col(kind) == "complete", "completed").otherwise("none")
    return joined.select(key, tie, at, kind, (start & F.coalesce(F.col("_before") == "start", F.lit(False))).alias("refused"), status.alias("translation_status"))


def download_name(ops, title, translated: bool):
    """File name of an export: word characters, white space, dots and dashes stay."""
    name = ops.trim(ops.replace(title, r"[^A-Za-z0-9_\s.-]", "_"))
    tag = "_DE.pdf" if translated else "_EN.pdf"
    return ops.concat(ops.cases([(name != "", name)], "book"), tag if not hasattr(ops.lit(tag), "alias") else ops.lit(tag))


def encoded_name(name: Column) -> Column:
    """A file name for a Content-Disposition header: UTF-8, all but unreserved characters percent-encoded."""
    coded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    for plain in "!'()~":
        coded = F.replace(coded, F.lit(f"%{ord(plain):02X}"), F.lit(plain))
    return coded


def top_by(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def ranked_in(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
