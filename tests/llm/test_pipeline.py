"""The pipeline's stages on a small corpus, and the registered queries."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sylvan.llm import decontaminate, ngram_join, pieces, quality, secrets

from .conftest import EN, prose


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(21)
    clean = [prose(rng, [w + str(k) for w in EN for k in range(20)], 60) for _ in range(40)]
    item = "which of these quiet stones fell under the river before the morning light of that day came"
    texts = clean + [clean[0], clean[1] + " more", item + " " + clean[2], clean[3] + " token: abcdefabcdef1234567890", "too short", None]
    rows = [(k, t, "en", "a", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the same by the single operators, in plain Python over their results
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.judge(docs).filter("kept").select("doc.doc_id").collect()}
    first = docs.filter(F.col("doc_id").isin(list(good)))
    unique = {r.doc_id for r in ngram_join.ngram_join(first).filter("doc_id = class_id").collect()}
    leaks = {r.doc_id for r in decontaminate.find_leaks(first, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).filter(F.size("items") > 0).select("doc.doc_id").collect()}
    assert set(found) == unique - leaks and 42 in leaks and not {40, 41, 42, 44, 45} & set(found) and set(range(40)) <= set(found) | {40}
    v = pieces.default_vocabulary()
    assert pieces.decode(found[0].ids, v.pieces) == texts[0]
    redacted = {r.doc_id: r.text for r in secrets.redact(first).collect()}
    for i, r in found.items():
        assert pieces.decode(r.ids, v.pieces) == redacted[i]


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] and set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_of_nothing_and_of_repeated_rows(spark, tmp_path, empty, docs, rows):
    bench = spark.createDataFrame([(1, "an item that no document has in it anywhere at all")], "item_id long, text string")
    for name, table in (("none", empty), ("some", docs)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    kept = decontaminate.remove_leaks(empty, bench)
    assert kept.columns == empty.columns and kept.collect() == []
    assert quality.keep_good(empty).columns == empty.columns
    found = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = [r.doc_id for r in found]
    assert found and all(r.text_back for r in found) and len(set(ids)) == len(ids)  # of equal rows one stays
