"""URL filter and web archives on odd pages, against plain Python."""

import base64
import hashlib
import re

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quire.llm import warc
from quire.llm.url_filter import RULES, judge_urls, op2_url_reputation, oracle
from quire.llm.warc import op4_warc_revisits


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_rules(spark, odd_dir):
    got = op2_url_reputation(spark, odd_dir).collect()
    urls = pq.read_table(f"{odd_dir}/pages.parquet").to_pylist()
    assert len(got) == len(urls)
    want = sorted((str(p["page_id"]), *(str(x) for x in rule_of(p["url"])[:2]), str((rule_of(p["url"])[2] or (None, None))[1])) for p in urls)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    for r in got:
        if r.rule:
            assert r.verdict == dict((b, a) for a, b in RULES)[r.rule]
        assert r.verdict in ("allow", "block")


def test_sql_agrees_on_odd_pages(spark, odd_dir):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"create view {name} as select * from '{odd_dir}/{name}.parquet' where {'page_id is not null and page_id > 0' if name == 'pages' else 'doc_id is not null'}")
    want = sorted(map(str, con.sql(oracle()).fetchall()))
    got = op2_url_reputation(spark, odd_dir).where("page_id > 0")
    assert sorted(str(tuple(r)) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want


def test_bad_hosts_are_blocked_and_shrunk(spark):
    rows = [(i, f"http://bad.example.com/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 7}.example.org/{i}") for i in range(300)] + [(500, "http://new.bad-free.example.org/x"), (501, "http://rare.example.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([(i, i < 60 or i == 501) for i, _ in rows if i != 500], "page_id long, bad boolean")
    got = {r.page_id: r for r in judge_urls(pages, bad, rules=[("allow", "none.example/")]).collect()}
    assert got[3].verdict == "block" and got[110].verdict == got[500].verdict == "allow"
    assert got[501].verdict == "allow" and got[501].mean < 0.9  # one bad page does not condemn a host
    assert got[3].lower < got[3].mean < 1


def test_empty_pages(spark, empty_dir):
    assert op2_url_reputation(spark, empty_dir).collect() == [] and op4_warc_revisits(spark, empty_dir).collect() == []


def expected_records(pages, min_bytes):
    first = {}
    for p in pages:
        key = (p["html"] or "").encode()
        if len(key) >= min_bytes:
            first.setdefault(key, []).append((p["page_id"] is None, p["page_id"]))
    return {k: min(v)[1] for k, v in first.items()}


def test_archives(spark, odd_dir):
    pages = pq.read_table(f"{odd_dir}/pages.parquet").to_pylist()
    got = op4_warc_revisits(spark, odd_dir).collect()
    first = expected_records(pages, 0)
    by_digest = {base64.b32encode(hashlib.sha1(k).digest()).decode(): (len(k), v) for k, v in first.items()}
    assert len(got) == len(pages)
    responses = {}
    for r in got:
        size, original = by_digest[r.payload_digest]
        assert r.payload_bytes == size
        if r.record_type == "response":
            assert r.page_id == original and r.refers_to is None
            responses[r.payload_digest] = responses.get(r.payload_digest, 0) + 1
        else:
            assert r.record_type == "revisit" and r.refers_to == original
    assert set(responses.values()) == {1} and len(responses) == len(first)


def test_archive_files(spark, odd_dir):
    pages = spark.read.parquet(f"{odd_dir}/pages.parquet")
    headers = warc.write_archives(pages)
    manifest = warc.resolve_revisits(headers, min_bytes=2)
    back = warc.read_archives(manifest, payloads=True).collect()
    html = {p["page_id"]: (p["html"] or "").encode() for p in pq.read_table(f"{odd_dir}/pages.parquet").to_pylist()}
    ids = {r.record_id: r for r in back}
    assert len(ids) == len(back)
    for r in back:
        if r.record_type == "response":
            assert bytes(r.payload) == html[r.page_id]
        else:
            assert r.payload is None and r.payload_bytes >= 2
            assert ids[r.refers_to_record].payload_digest == r.payload_digest and ids[r.refers_to_record].record_type == "response"
        assert r.url is None or not re.search(r"[\x00-\x20]", r.url)
    assert all(r.record_type == "response" for r in back if r.payload_bytes < 2)
    assert headers.count() == pages.count() == manifest.agg(F.sum("n_records")).first()[0] - manifest.count()


def test_records_across_reads(tmp_path, monkeypatch):
    data = b"".join(warc._member(b"x" * n, 6) for n in (0, 10, 3 << 20))
    (tmp_path / "a").write_bytes(data)
    with open(tmp_path / "a", "rb") as f:
        assert [len(x) for x in warc.records(f)] == [0, 10, 3 << 20]
