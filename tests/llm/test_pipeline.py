"""The corpus pipeline on a small table, stage by stage."""

import random

from pyspark.sql import functions as F

from test_llm import DOCS, corpus, prose

import corpus_pipeline


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(12)
    rows = [r for r in corpus() if r[0] is not None and r[0] < 1000][:90]
    long = [(200 + i, prose(rng, "en", 300), "en", "s", 0) for i in range(5)]
    copies = [(300 + i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(long)]
    junk = [(400 + i, " ".join(w + "###" for w in prose(rng, "en", 60).split()), "en", "s", 0) for i in range(15)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows + long + copies + junk + [(500, None, None, None, 0)], DOCS).write.parquet(str(path))
    docs = spark.read.parquet(str(path))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not left[0] & {400 + i for i in range(15)} and 500 not in left[0] and left[0] >= {r[0] for r in rows + long + copies}
    assert left[1] == left[0]
    assert not left[2] & {300 + i for i in range(5)} and left[2] >= {200 + i for i in range(5)}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left[2]


def test_stages_take_empty_tables_repeated_rows_clashing_names_and_long_texts(spark, tmp_path):
    rng = random.Random(5)
    rows = [r for r in corpus() if r[0] is not None and r[0] < 1000]
    same = (200, prose(rng, "en", 300), "en", "s", 0)
    long = (201, prose(rng, "fr", 60_000), "fr", "s", 0)
    odd = [(None, None, None, None, None), (300, "", None, None, 0), (301, None, "en", "s", 0)]
    taken = ["kept", "base_failed", "lang_pred", "score", "fingerprint", "component_id", "h", "p", "ids", "sequence_id", "length"]
    extra = lambda df: df.withColumns({c: F.lit(f"own {c}") for c in taken})
    full, none = tmp_path / "full", tmp_path / "none"
    extra(spark.createDataFrame([*rows, same, same, long, *odd], DOCS)).write.parquet(str(full / "documents.parquet"))
    extra(spark.createDataFrame([], DOCS)).write.parquet(str(none / "documents.parquet"))
    docs = spark.read.parquet(str(full / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(full))
        assert docs.columns == before.columns, name
        assert not docs.where(" OR ".join(f"{c} IS DISTINCT FROM 'own {c}'" for c in taken)).count(), name
    left = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert left.count(200) == 1 and 201 in left and not {None, 300, 301} & set(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(full))
    pieces = [r for r in packed.collect() if r["doc_id"] == 201]
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] > 60_000
    assert corpus_pipeline.run(spark, str(none)).count() == 0
