"""The pipeline's result from the single operators' decisions, applied by hand."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import decontaminate, language_id, near_duplicates, toxicity


def test_stages(spark, odd_dir, documents):
    kept = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, odd_dir)
        assert kept.columns == columns, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.count() < before, name
    got = corpus_pipeline.run(spark, odd_dir).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in kept.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {d["doc_id"]: d["text"] for d in documents}
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.text == text[r.doc_id]


def test_decisions(spark, odd_dir, documents):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    profiles = language_id.learn_profiles(docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2"))
    limit = language_id.distance_limit(docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2"), profiles)
    assert 0.5 < limit < language_id.MAX_DISTANCE
    known = language_id.identify(docs, profiles, out="found").where(f"found.lang <> 'und' and found.distance <= if(found.n_grams < {language_id.ENOUGH}, {language_id.MAX_DISTANCE}, {limit})")
    assert ids(language_id.keep_known_languages(spark, docs, odd_dir)) == ids(known)
    assert ids(toxicity.drop_toxic(spark, docs, odd_dir)) == ids(toxicity.op3_toxicity_neighbours(spark, odd_dir).where("score < 0.5"))
    assert ids(near_duplicates.keep_one_of_each(spark, docs, odd_dir)) == ids(near_duplicates.op6_near_duplicates(spark, odd_dir).where("kept"))
    leaks = {r.doc_id for r in decontaminate.op9_decontamination(spark, odd_dir).collect()}
    assert ids(decontaminate.drop_contaminated(spark, docs, odd_dir)) == sorted(str(d["doc_id"]) for d in documents if d["doc_id"] not in leaks)


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
