"""The pipeline's result against its stages done by brute force on the smallest documents."""

import numpy as np

import corpus_pipeline
from loomql.llm import decontam, secrets

from .test_methods import SF, brute_components, queries


def test_pipeline_rows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    kept = {r.doc_id for r in queries.op7_quality_votes(spark, SF).collect() if r.kept}
    texts = {i: t for i, t in texts.items() if i in kept}
    texts = {i: texts[i] for i, (_, root) in brute_components(texts).items() if root == i}
    found = decontam.automaton([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    texts = {i: t for i, t in texts.items() if not decontam.scan(found, t)[1]}
    spans = secrets.scan(list(texts.values()), secrets.learnt())
    texts = {i: secrets.cut(t, s) for (i, t), s in zip(texts.items(), spans, strict=True)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == wanted
    assert sum(r.length for r in rows) == sum(wanted.values())
    assert len({r.sequence_id for r in rows}) == -(-sum(wanted.values()) // 4096)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert np.all([r.text is not None for r in docs.collect()])


def test_run_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, clashing columns, and an empty table."""
    words = lambda k, n: " ".join(f"word{k}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(n))
    rows = [(1, None), (2, ""), (3, words("a", 60)), (3, words("a", 60)), (None, words("b", 70)), (5, words("c", 15_000)), (6, "few words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "1 as posterior", "2 as may_hold", "3 as digest")
    empty = spark.createDataFrame([], "item_id bigint, text string")
    for name, table in (("all", docs), ("none", docs.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        empty.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/all").collect()
    assert sorted(str(r.doc_id) for r in found if r.start == 0) == ["3", "5", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_stages_free_what_earlier_ones_staged(spark, tmp_path):
    import os

    from loomql.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = [p for p in corpus_pipeline._staged if os.path.isdir(p)]
    assert left == [p for p in left if p in common.made] and not any(os.path.isdir(f"{p}/quality") for p in left)
