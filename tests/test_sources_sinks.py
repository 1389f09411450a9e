"""The data source of books and the sink of documents: large archives, oversized entries, retries, aborts."""

import os
import subprocess
import sys
import tracemalloc
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.operators import chapters as C
from quire.operators import export as E
from quire.sinks.documents import FORMAT, DocumentSink, file_name, listed_documents, save_documents
from quire.sources import books as B
from quire.sources.containers import read_books
from quire.sources.stores import listed

PROSE = "<p>" + "A river runs past the town and nobody minds. " * 40 + "</p>"


def archive(path, chapters, *, lead=0, extra=(), level=zipfile.ZIP_DEFLATED):
    """A book whose archive stands behind ``lead`` bytes of nothing, as in self-extracting files."""
    with open(path, "wb") as f:
        f.seek(lead)
        with zipfile.ZipFile(f, "w", level) as z:
            names = [f"c{k:04d}.xhtml" for k in range(len(chapters))] + [n for n, _ in extra]
            items = "".join(f'<item id="i{k}" href="{n}"/>' for k, n in enumerate(names))
            z.writestr("META-INF/container.xml", '<rootfile full-path="OEBPS/x.opf"/>')
            z.writestr("OEBPS/x.opf", f"<package><dc:title>Long</dc:title><dc:language>en</dc:language>{items}{''.join(f'<itemref idref={chr(34)}i{k}{chr(34)}/>' for k in range(len(names)))}</package>")
            for name, body in zip(names, chapters):
                z.writestr(f"OEBPS/{name}", body)
            for name, size in extra:
                with z.open(f"OEBPS/{name}", "w") as out:
                    for _ in range(size >> 20):
                        out.write(bytes(1 << 20))


def test_three_gigabytes_in_bounded_memory(spark, tmp_path):
    """A file of 3 GB, read by ranges of its reading order; an entry of 300 MB is a row with an error."""
    path = tmp_path / "long.epub"
    chapters = [f"<h1>Chapter {k}</h1>" + os.urandom(30_000).hex() + PROSE for k in range(60)]
    archive(path, chapters, lead=3 << 30, extra=[("huge.xhtml", 300 << 20)])
    assert path.stat().st_size > 3 << 30 and path.stat().st_blocks * 512 < 50 << 20  # the lead takes no room on disk
    df = read_books(spark, str(tmp_path), splitBytes=200_000, maxEntryBytes=1 << 20)
    assert df.rdd.getNumPartitions() > 5
    rows = sorted(df.collect(), key=lambda r: r.chapter_idx)
    assert [r.chapter_idx for r in rows] == list(range(61)) and [r.html for r in rows[:60]] == chapters
    assert rows[60].html is None and rows[60].path == "OEBPS/huge.xhtml" and "larger than 1048576" in rows[60].parse_error
    book = C.book_documents(df).first()
    assert book.title == "Long" and book.total_chapters == 60 and book.parse_error is None
    reader = B.BookReader({"path": str(tmp_path), "maxEntryBytes": str(1 << 20)})
    tracemalloc.start()
    count = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 61 and peak < 60 << 20


def test_small_files_share_partitions(spark, tmp_path):
    for k in range(40):
        archive(tmp_path / f"b{k:02d}.epub", [f"<h1>{k}</h1>{PROSE}"])
    (tmp_path / "_hidden").mkdir()
    archive(tmp_path / "_hidden" / "x.epub", ["x"])
    (tmp_path / "bad.epub").write_bytes(b"PK")
    reader = B.BookReader({"path": str(tmp_path), "splitBytes": "10000"})
    sizes = [len(p.ranges) for p in reader.partitions()]
    assert sum(sizes) == 41 and 1 < len(sizes) < 41
    rows = read_books(spark, str(tmp_path), splitBytes=10_000).collect()
    assert len(rows) == 41 and sum(r.parse_error is not None for r in rows) == 1
    one = read_books(spark, str(tmp_path / "b07.epub")).collect()
    assert len(one) == 1 and one[0].book_id == f"file:{tmp_path}/b07.epub"


def test_missing_folder_and_kind(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path / "none"), ".epub")
    with pytest.raises(ValueError, match="epub or mobi"):
        B.BookReader({"path": ".", "kind": "pdf"})


# ------------------------------------------------------------------ documents


def rendered(spark, n, lead="b"):
    return spark.range(n, numPartitions=4).select(F.concat(F.lit(lead), F.col("id").cast("string")).alias("book_id"), F.encode(F.concat(F.lit("document "), F.col("id").cast("string")), "UTF-8").alias("document"))


def files(folder):
    return sorted(x for x in os.listdir(folder) if not x.startswith((".", "_")))


def test_one_file_a_document(spark, tmp_path):
    folder = str(tmp_path / "out")
    out = E.write_documents(rendered(spark, 50), folder)
    for _ in range(2):  # reading the result writes nothing
        assert sorted((r.book_id, r.n_bytes) for r in out.collect()) == sorted((f"b{k}", len(f"document {k}")) for k in range(50))
    assert files(folder) == sorted(f"b{k}.pdf" for k in range(50)) and os.listdir(f"{folder}/_lists").__len__() == 1
    assert all(open(r.path, "rb").read().decode() == f"document {r.book_id[1:]}" for r in out.collect())
    save_documents(rendered(spark, 3, "c"), folder)
    assert len(files(folder)) == 53 and listed_documents(spark, folder).count() == 53
    save_documents(rendered(spark, 4), folder, mode="overwrite")
    assert files(folder) == [f"b{k}.pdf" for k in range(4)] and listed_documents(spark, folder).count() == 4
    assert not [x for x in os.listdir(folder) if x.startswith("_staging")]
    assert listed_documents(spark, str(tmp_path / "none")).collect() == []


def test_an_abort_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = rendered(spark, 40).withColumn("document", F.when(F.col("book_id") == "b37", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("document")))
    with pytest.raises(PySparkException):
        save_documents(bad, folder)
    assert not os.path.isdir(folder) or os.listdir(folder) == []
    with pytest.raises(PySparkException):
        spark.dataSource.register(DocumentSink)
        spark.range(3).write.format(FORMAT).mode("append").save(folder)


def test_names():
    assert file_name("a.b-c_1") == "a.b-c_1" and file_name(5) == "5"
    odd = [file_name(x) for x in ("", ".", "..", "a/b", "a:b", "x" * 200, None, "ä", ".hidden")]
    assert len(set(odd)) == len(odd) and not any(x.startswith(".") or "/" in x for x in odd)


_JOB = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
from quire.sinks.documents import save_documents
def fail_once(batches):
    for k, batch in enumerate(batches):
        yield batch
    if not os.path.exists({marker!r}):
        open({marker!r}, "w").close()
        raise RuntimeError("first attempt")
df = spark.range(30, numPartitions=1).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("book_id"), F.lit("x").cast("binary").alias("document"))
save_documents(df.mapInArrow(fail_once, df.schema), {folder!r})
"""


def test_a_task_that_fails_once(tmp_path):
    """The second attempt's files count, the first one's are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    marker, folder = str(tmp_path / "failed"), str(tmp_path / "out")
    run = subprocess.run([sys.executable, "-c", _JOB.format(root=root, marker=marker, folder=folder)], capture_output=True, text=True, timeout=180, check=False)
    assert run.returncode == 0, run.stderr[-2000:]
    assert os.path.exists(marker) and files(folder) == sorted(f"d{k}.pdf" for k in range(30))
    assert os.listdir(folder).__len__() == 31  # and the lists
