"""Inputs that once were slow, unbounded or fatal: long runs of letters, damaged images, repetitive texts, repeated rows."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quire.llm import decontaminate as D
from quire.llm import jpeg as J
from quire.llm import language_id as L
from quire.llm import sstable as S
from quire.llm import toxicity as T
from quire.llm import url_filter as U
from quire.llm.bpe_codec import round_trip
from quire.llm.token_count import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_megabyte_of_one_letter(spark):
    texts = ["y" * 1_000_000, "a" + "ha" * 300_000 + " the end", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, tokenizer_path=PATH).collect()} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: r.coded.ids for r in round_trip(docs, tokenizer_path=PATH).collect()} == want
    back = S.read_tables(S.write_tables(docs, tokenizer_path=PATH, end_id=2)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in back} == {i: [*x, 2] for i, x in want.items()}


def test_one_row_repeated(spark):
    docs = spark.range(100_000).selectExpr("7L as doc_id", "case when id % 2 = 0 then '' else 'the' end as text")
    rows = S.read_tables(S.write_tables(docs, tokenizer_path=PATH, end_id=2)).selectExpr("doc_id", "start", "octet_length(ids) / 4 as n").collect()
    assert len(rows) == 100_000 and Counter(r.n for r in rows) == {1: 50_000, 2: 50_000}
    assert sorted(r.start for r in rows) == list(np.cumsum([0, *(r.n for r in sorted(rows, key=lambda r: r.start))])[:-1])


def damaged():
    good = J.encode_samples(bytes(range(256)) * 20)
    scan = good.index(b"\xff\xda")
    marker = good.index(b"\xff\xd0")
    flipped = bytearray(good)
    for k in range(scan + 12, scan + 40):
        flipped[k] = 0xFE
    table = good.index(b"\xff\xc4")
    return good, {
        "flipped scan": bytes(flipped),
        "missing table": good[:table] + good[table + 2 + int.from_bytes(good[table + 2 : table + 4], "big") :],
        "missing scan": good[:scan] + b"\xff\xd9",
        "lost marker": good[:marker] + good[marker + 2 :],
        "lost bytes": good[: marker - 3] + good[marker:],
        "no frame": good.replace(b"\xff\xc0", b"\xff\xe0"),
        "huge frame": good.replace(b"\xff\xc0\x00\x0b\x08", b"\xff\xc0\x00\x0b\x08\xff\xff\xff\xff", 1),
    }


def test_damaged_images_beside_good_ones(spark):
    good, bad = damaged()
    rows = [("good", good), *bad.items(), ("good again", good), ("none", None)]
    got = {r.name: r.image for r in J.read_media(spark.createDataFrame(rows, "name string, media binary").coalesce(1)).collect()}
    assert got["good"].payload_bytes == 5120 and got["good"] == got["good again"]
    for name in [*bad, "none"]:
        assert got[name] is None or all(x is None for x in got[name]), name


def test_random_damage_never_raises():
    good, _ = damaged()
    rng = random.Random(5)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        J.describe([bytes(data[: rng.randint(1, len(data))]), good])


def test_foreign_comment_is_no_mark():
    good, _ = damaged()
    foreign = good.replace(J.MAGIC, b"other comment ")
    found = J.describe([foreign, good])
    assert found[0]["payload"] is None and found[0]["hash"] == found[1]["hash"] and found[1]["payload"] == bytes(range(256)) * 20


def test_hash_covers_all_frames():
    first, second, other = (J.encode_samples(bytes([x, 255 - x] * 600)) for x in (10, 90, 200))
    a, b = J.describe([first + second, first + other])
    assert a["hash"] != "" and a["hash"].count("+") == 1 and a["dims"] == b["dims"]


def test_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "again " * 100_000), (2, "one two " * 30_000), (3, "again " * 300 + "b " + "again " * 300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "again " * 400), (2, "one two " * 200 + "three"), (3, "again " * 150 + "b " + "again " * 150)], "item_id long, text string")
    got = {(r.doc_id, h.item_id): (round(h.coverage, 4), h.n_tiles, h.longest) for r in D.contaminated(docs, items).collect() for h in r.hits}
    assert got == {(1, 1): (1.0, 1, 400), (1, 3): (0.9967, 2, 150), (2, 2): (round(400 / 401, 4), 1, 400), (3, 1): (1.0, 2, 300), (3, 3): (1.0, 1, 301)}


def test_blocks_of_a_benchmark(spark, odd_dir):
    docs, items = (spark.read.parquet(f"{odd_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.withColumn("digest", docs.doc_id).withColumn("found", docs.text)
    whole, parts = D.contaminated(docs, items), D.contaminated(docs, items, block_bytes=3000)
    assert parts.columns == whole.columns and parts.count() == whole.count()
    plain = lambda df: Counter((r.doc_id, r.digest, r.found, tuple(map(tuple, r.hits))) for r in df.collect())
    assert plain(parts) == plain(whole) and sum(bool(r[3]) for r in plain(whole)) > 3


def test_repeated_identifier_is_one_example(spark):
    docs = spark.createDataFrame([(1, "you pathetic idiot")] * 500 + [(1, "fine weather today")] * 500 + [(2, "fine weather today"), (3, "what an idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    index = T.fit(docs, labels)
    assert sorted(index.ids) == [1, 2] and T.score(docs, index).count() == 1002


def test_long_hosts(spark):
    pages = [(1, "http://" + "a." * 5000 + "example.com/en/7"), (2, "http://" + "." * 20_000 + "/x"), (3, "http://10.0.0.1/x"), (4, "http://11.0.0.1:80/x"), (5, "http://com/en/")]
    outcomes = spark.createDataFrame([(3, True), (5, False)], "page_id long, bad boolean")
    got = {r.page_id: r for r in U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), outcomes).collect()}
    assert (got[1].rule, got[1].verdict) == ("example.com/en/7", "allow") and got[5].rule == "com/en/" and got[2].rule is None
    assert got[3].mean > got[4].mean


def brute_profile(texts, size=300):
    total = Counter()
    for t in texts:
        total.update(brute_grams(t))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def brute_grams(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for n in (1, 2, 3):
            p = word if n == 1 else f"\x01{word}\x01"
            for i in range(len(p) - n + 1):
                counts[p[i : i + n]] += 1
    return counts


def test_languages_against_plain_profiles(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    rows = {r.doc_id: r for r in L.op7_language_id(spark, sf_dir).collect()}
    texts = {}
    for d in docs:
        if d["lang"] is not None and d["text"] is not None and not rows[d["doc_id"]].held_out:
            texts.setdefault(d["lang"], []).append(d["text"])
    ranks = {lang: {g: k for k, g in enumerate(brute_profile(t))} for lang, t in texts.items()}
    for d in docs:
        r = rows[d["doc_id"]]
        own = brute_profile([d["text"] or ""])
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) / (300 * len(own)) for lang, p in ranks.items()}
        assert r.lang_pred == min(sorted(far), key=far.get) and r.distance == pytest.approx(far[r.lang_pred]), d["doc_id"]


def test_every_language_is_learned(spark):
    names = [f"l{k}" for k in range(600)]
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k + 1000)) * 3
    rows = [(k, word(k), lang) for k, lang in enumerate(names)]
    docs = spark.createDataFrame(rows + [(10_000 + k, "common words", "zz") for k in range(50)], "doc_id long, text string, lang string")
    profiles = L.learn_profiles(docs)
    assert set(profiles.languages) == {*names, "zz"}


def test_unlearned_languages_go(spark, sf_dir):
    """Two languages in Latin letters that no label names, and letters without any; the corpus itself stays."""
    planted = [
        (10**9, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 3),
        (10**9 + 1, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3),
        (10**9 + 2, "xq zzkv wqpj kkx vvzq jjqx pqz xkcd qqzx " * 10),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.unionByName(spark.createDataFrame([(*r, None) for r in planted], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in L.keep_known_languages(spark, both, sf_dir).select("doc_id").collect()}
    assert not kept & {i for i, _ in planted} and len(kept) >= docs.where("text rlike '[a-zA-Z]'").count()


def test_toxicity_finds_and_ranks(spark):
    """Held-out labelled documents of sf0.01: answering 0 for all would find none and rank by chance."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = T.op3_toxicity_neighbours(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == y] for y in (1, 0))
    ranked = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    found, wrong = sum(r.predicted for r in toxic), sum(r.predicted for r in clean)
    assert len(toxic) > 4 and ranked > 0.8 and found / len(toxic) >= 0.6 and wrong / len(clean) < 0.05
