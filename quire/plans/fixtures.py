"""How the driver's tables stand for books, chapters, translations and folders; and small literal tables.

Each binding exists as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import numbered

#: Titles that synthetic chapters bear in turn: one or more for each title rule, and near misses.
TITLES = (
    "Chapter 1", "Table of Contents", "Contents and more", "Inhaltsverzeichnis", "Copyright 2020", "Legal Notice", "Impressum", "Colophon",
    "Books by Jane Doe", "By Jane Doe", "Foreword", "Prologue", "Introduction", "Chapter 2: Introduction", "Vorwort", "Dedication", "For the Queen",
    "Für Anna", "In memory of them", "Epigraph", "Zitat", "Praise for this", "Reviews", "About this book", "Klappentext", "About the Author",
    "Über den Autor", "Vita", "Acknowledgements", "Danksagung", "Thank you", "Leseprobe: mehr", "Sneak peek", "Excerpt", "Also by", "More books by X",
    "Bibliography", "References", "Sign up now", "Newsletter", "What's next on the list", "Glossary", "Abbreviations", "Index", "Stichwortverzeichnis",
    "Cover", "Title Page", "Frontispiece", "Kapitel 7 - Vorwort", "Chapter 3: Preface", " The Index of Things ", "Discovery", "", "XII", "Ein neuer Morgen",
)

#: Paths for the file-name rule.
PATHS = (
    "OEBPS/cover.xhtml", "x/discover.xhtml", "x/recovery.xhtml", "title.html", "titlepage.xhtml", "toc.xhtml", "table-of-contents.htm", "contents.html",
    "nav.xhtml", "navigation.xhtml", "Copyright.XHTML", "legal.html", "impressum.htm", "dedication.xhtml", "widmung.html", "colophon.xhtml", "about_author.xhtml",
    "about-the-author.html", "aboutme.xhtml", "vita.html", "acknowledgments.xhtml", "danksagung.htm", "also-by.xhtml", "alsoby.html", "bm01.xhtml", "bmx.xhtml",
    "ata.xhtml", "prh-ad.html", "ch01.xhtml", "text/part0001.html", "a/b/", "", "cover/", "promo.xhtml", "signup.htm", "index.html",
)

_PROSE = "She walked on. The road was long and nobody spoke for hours, and then the rain began to fall on all of them."
_TOC = "\n".join(["Contents", "Chapter 1", "Chapter 2 ..... 14", "Part III", "IV. The End", "12. Something", "Epilogue", "Someone 214"])
_LIST = "\n".join(["The Long Road", "A Short Stay", "Winter's Tale", "Night and Day", "The Other House", "Home at Last", "Under the Hill"]) + "\n" + "The Last of Them All"

#: (place, title, content, expected reason): each content rule, and near misses.
GOLDEN = (
    ("start", "One", _TOC, "table of contents (content-detected)"),
    ("middle", "One", _TOC, None),
    ("start", "One", "Chapter 1\nChapter 2", None),
    ("middle", "One", "Sign up for news. Subscribe to our newsletter today.", "publisher promo/newsletter"),
    ("end", "One", "Melden Sie sich an. Das ist eine tolle Lektüre.", "publisher promo/newsletter"),
    ("middle", "One", "Please subscribe.", None),
    ("start", "One", _LIST, "also by this author (content-detected)"),
    ("start", "By Jane Doe", _LIST.replace("The", "1 the"), "also by this author (content-detected)"),
    ("middle", "By Kim Harrison", _PROSE, None),
    ("start", "Introduction", _PROSE, "foreword/introduction"),
    ("start", "Introduction", _PROSE * 90, None),
    ("start", "Introduction", "In this book we learn. " + _PROSE * 90, "foreword/introduction"),
    ("start", "Introduction", _PROSE * 90 + " The translator", "foreword/introduction"),
    ("start", "Chapter 3: Preface", _PROSE, "foreword/preface"),
    ("end", "Bibliography", _PROSE, "book suggestions"),
    ("end", "References", _PROSE, "bibliography"),
    ("end", "One", "All rights reserved. 2020", "copyright/publisher info (short)"),
    ("middle", "One", "All rights reserved. 2020", None),
    ("end", "One", _PROSE + "\nISBN 978-3-16\nHardcover 12 €\nAvailable now\n" + _PROSE, "book list/advertisements"),
    ("end", "One", "Leseprobe aus dem neuen Buch. " + _PROSE * 3, "book preview (content-detected)"),
    ("end", "One", "Chapter 1\n" + _PROSE * 3, "book preview (content-detected)"),
    ("end", "One", "Chapter 11\n" + _PROSE * 3, None),
    ("start", "One", _PROSE * 2 + " Published by Some House. Copyright (c) 2019 and first published then.", "copyright (content-detected)"),
    ("start", "One", "For my mother", "dedication (content-detected)"),
    ("start", "One", "For Anna", None),
    ("start", "One", "“To be or not to be”\n— William Shakespeare", "epigraph (content-detected)"),
    ("start", "One", _PROSE * 8 + "\n— William Shakespeare", None),
    ("end", "One", "Jane Doe lives in Berlin. She was born in 1970. " + _PROSE, "about the author (content-detected)"),
    ("end", "One", "Jane Doe lives in Berlin. " + _PROSE, None),
    ("end", "One", "I would like to thank everyone. " + _PROSE, "acknowledgements (content-detected)"),
    ("end", "One", "Ich möchte mich bedanken. " + _PROSE, "acknowledgements (content-detected)"),
    ("end", "übook", "Der Vübook was born in Rom and lives in Wien. " + _PROSE, "about the author (content-detected)"),
    ("start", None, None, None),
)

#: Package documents: (book_id, base, opf).
PACKAGES = (
    ("b1", "OEBPS/", '<dc:title id="t"> A &amp; B </dc:title><dc:creator>Jane &quot;J&quot; Doe</dc:creator><dc:language>de</dc:language><item id="a" href="a%20b.xhtml" x="1"/><item href="c+d.xhtml" id="c"/><item id="n" href="nav.xhtml"/><item id="a" href="second.xhtml"/><itemref idref="a"/><itemref linear="no" idref="c"/><itemref idref="a"/><itemref idref="n"/><itemref idref="gone"/>'),
    ("b2", "", '<dc:title><![CDATA[No]]></dc:title><dc:creator opf:role="aut">X</dc:creator><item id="cover" href="cover.xhtml"/><itemref idref="cover"/>'),
    ("b3", None, ""),
)

#: Messages of failed requests.
ERRORS = ("HTTP 456 quota exceeded", "DeepL HTTP 503 unavailable", "Google HTTP 429", "Too Many Requests", "read ETIMEDOUT", "HTTP 400 bad", "character limit reached", "fetch failed", "DeepL HTTP 600", "network down", "odd", "")


def _list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def values(rows) -> str:
    """Rows as SQL VALUES."""
    def one(v):
        return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "values " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


#: Tables of whole texts and the key by which their rows are spread.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts cost far more to work on than to move, so a table of texts in fewer splits than there are cores is spread over them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, _TEXTS[name]) if name in _TEXTS and rows.rdd.getNumPartitions() < cores else rows


#: (file name, markup) of chapter files, one or more for each source of a title.
NAMES = (
    ("ch1.xhtml", "<p class='x dedication'>a</p>"),
    ("x.html", "<section epub:type='frontmatter copyright-page'>b</section>"),
    ("about_author.xhtml", "c"),
    ("a/my-foreword_2.html", "d"),
    ("t.html", "<title>Untitled</title>e\nf"),
    ("t.html", "<title>Real &amp; Good</title>"),
    ("y.html", "<h2> <b>A</b>\n B</h2>"),
    ("z.html", ""),
    ("toc.html", "<p class='intro'>g"),
    ("q.html", "l" * 130 + "\nshort"),
)


def pick(pool, number):
    """The pool's entries in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (number % len(pool) + 1).cast("int"))


def pick_sql(pool, number: str) -> str:
    return f"{_list(pool)}[cast({number} % {len(pool)} + 1 as int)]"


TITLE_SOURCES_SQL = f"""select page_id as id, {pick_sql([n for n, _ in NAMES], 'page_id')} as path,
  {pick_sql([h for _, h in NAMES], 'page_id')} || '<p>' || coalesce(url, '') || '</p>' as html from pages"""


def title_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under the file names of the list, the markup of the list before their addresses."""
    k = F.col("page_id")
    html = F.concat(pick([h for _, h in NAMES], k), F.lit("<p>"), F.coalesce("url", F.lit("")), F.lit("</p>"))
    return t(spark, sf_dir, "pages").select(k.alias("id"), pick([n for n, _ in NAMES], k).alias("path"), html.alias("html"))


PAGE_PATHS_SQL = f"select page_id, case when page_id % 2 = 0 then coalesce(url, '') || '/' else '' end || {pick_sql(PATHS, 'page_id')} as path from pages"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the list, every other one below a page's address."""
    k = F.col("page_id")
    lead = F.when(k % 2 == 0, F.concat(F.coalesce("url", F.lit("")), F.lit("/"))).otherwise("")
    return t(spark, sf_dir, "pages").select(k.alias("page_id"), F.concat(lead, pick(PATHS, k)).alias("path"))


# ------------------------------------------------------------------ chapters

CHAPTERS_SQL = f"""select source as book_id, row_number() over (partition by source order by doc_id) - 1 as chapter_idx,
  {_list(TITLES)}[doc_id % {len(TITLES)} + 1] as title, text as content from documents"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters: a source is a book, titles in turn from the list. Texts do not travel by source: numbers are joined to them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    numbers = numbered(docs.select("source", "doc_id"), ["source"], ["doc_id"], "n").select(F.col("doc_id").alias("_id"), (F.col("n") - 1).alias("chapter_idx"))
    # a merge: small tables of texts would otherwise be broadcast, to be worked on wherever the few numbers lie
    rows = docs.join(numbers.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return rows.select(F.col("source").alias("book_id"), "chapter_idx", pick(TITLES, F.col("doc_id")).alias("title"), F.col("text").alias("content"))


_PLACE = {"start": 0, "middle": 5, "end": 9}


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of ten documents each; one of the ten is a golden chapter at its place, in turn."""
    docs, k = t(spark, sf_dir, "documents"), F.col("doc_id")
    book, at = F.floor(k / 10).cast("bigint"), k % 10
    here = at == pick([_PLACE[p] for p, *_ in GOLDEN], book)
    title = F.when(here, pick([x[1] for x in GOLDEN], book)).otherwise(F.concat(F.lit("Part "), at.cast("string")))
    content = F.when(here, pick([x[2] for x in GOLDEN], book)).otherwise(F.col("text"))
    return docs.select(book.alias("book_id"), at.alias("chapter_idx"), title.alias("title"), content.alias("content"))


_BOOK = "(doc_id // 10)"
_HERE = f"doc_id % 10 = [{', '.join(str(_PLACE[p]) for p, *_ in GOLDEN)}][cast({_BOOK} % {len(GOLDEN)} + 1 as int)]"
GOLDEN_SQL = f"""select {_BOOK} as book_id, doc_id % 10 as chapter_idx,
  case when {_HERE} then {pick_sql([x[1] for x in GOLDEN], _BOOK)} else 'Part ' || doc_id % 10 end as title,
  case when {_HERE} then {pick_sql([x[2] for x in GOLDEN], _BOOK)} else text end as content from documents"""

_PAGE_HREF = "regexp_replace(coalesce(url, ''), '[<>\"%]', '', 'g')"
PACKAGES_SQL = f"""select page_id as book_id, {pick_sql([b for _, b, _ in PACKAGES], 'page_id')} as base,
  '<dc:title>' || {_PAGE_HREF} || ' &#8212; page</dc:title>' || {pick_sql([o for *_, o in PACKAGES], 'page_id')}
  || '<item id="page" href="' || {_PAGE_HREF} || '"/><itemref idref="page"/>' as opf from pages"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package documents around the pages' addresses: a title, the elements of the list in turn, an item."""
    k = F.col("page_id")
    href = F.regexp_replace(F.coalesce("url", F.lit("")), '[<>"%]', "")
    opf = F.concat(F.lit("<dc:title>"), href, F.lit(" &#8212; page</dc:title>"), pick([o for *_, o in PACKAGES], k), F.lit('<item id="page" href="'), href, F.lit('"/><itemref idref="page"/>'))
    return t(spark, sf_dir, "pages").select(k.alias("book_id"), pick([b for _, b, _ in PACKAGES], k).alias("base"), opf.alias("opf"))


FAILURES_SQL = f"select event_id, {pick_sql(ERRORS, 'event_id')} || ' ' || event_type as message, cast(event_id % 4 as int) as attempt from events"


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed requests, the messages of the list in turn."""
    k = F.col("event_id")
    return t(spark, sf_dir, "events").select(k.alias("event_id"), F.concat(pick(ERRORS, k), F.lit(" "), F.col("event_type")).alias("message"), (k % 4).cast("int").alias("attempt"))


# ------------------------------------------------------------------ library tables

BOOKS_SQL = """select c_custkey as id, c_mktsegment as user_id, c_name as title, c_nationkey as folder_id, c_acctbal as file_size,
  case when c_custkey % 5 = 0 then null else date '2020-01-01' + cast(c_custkey % 400 as int) end as upload_date,
  case when c_custkey % 7 = 0 then 'translating' when c_custkey % 3 = 0 then 'completed' when c_custkey % 11 = 0 then null else 'none' end as translation_status
  from customer union all select -k, 'BUILDING', 'Unread ' || k, null, 0.0::double, null, 'none' from range(1, 4) as r(k)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books: segment as user, nation as folder; and three books that no order names."""
    k = F.col("c_custkey")
    uploaded = F.when(k % 5 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k % 400).cast("int")))
    status = F.when(k % 7 == 0, "translating").when(k % 3 == 0, "completed").when(k % 11 != 0, "none")
    rows = t(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("user_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("folder_id"), F.col("c_acctbal").alias("file_size"), uploaded.alias("upload_date"), status.alias("translation_status"))
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.union(spark.createDataFrame([(-n, "BUILDING", f"Unread {n}", None, 0.0, None, "none") for n in (1, 2, 3)], kinds))


TRANSLATIONS_SQL = """select o_orderkey as id, o_custkey as epub_file_id, o_orderdate as created_at, o_orderstatus as translation_status,
  case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 'google' else 'deepl' end as provider from orders"""


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as translations."""
    k = F.col("o_orderkey")
    provider = F.when(k % 4 == 1, "google").when(k % 4 != 0, "deepl")
    return t(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("epub_file_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("translation_status"), provider.alias("provider"))


FOLDERS_SQL = "select n_nationkey as id, n_name as name from nation union all select 100, ' empty '"


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as folders, and an empty one."""
    rows = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return rows.union(spark.createDataFrame([(100, " empty ")], "id int, name string"))


ITEMS_SQL = """select conv_id as book_id, turn as "index", text as content, length(text) as char_count,
  case when role = 'user' then 'deepl' when conv_id % 5 = 0 then null else 'google' end as provider from conversations"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books of short chapters, roles as providers."""
    provider = F.when(F.col("role") == "user", "deepl").when(F.col("conv_id") % 5 != 0, "google")
    return t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("index"), F.col("text").alias("content"), F.length("text").cast("bigint").alias("char_count"), provider.alias("provider"))


EVENTS_SQL = """select event_id, user_id as book_id, ts,
  {0}[cast(event_id % 5 + 1 as int)] as kind from events""".format("['start', 'complete', 'cancel', 'open', 'fail']")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status changes of books."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("start", "complete", "cancel", "open", "fail")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("book_id"), "ts", kind.alias("kind"))
