"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from loomql.llm import chat, decontam, near_dup, pack, pii, ppm, quality, secrets, shard, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, LONG), (6, LONG), (None, "a null id here"), (None, None), (7, "é 　 ünï 日本 " * 30)]
CLASH = ("q", "votes", "kept", "class", "id", "row", "n", "may_hold", "part", "shard", "size", "source", "h")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return base.select("doc_id", "text", *(F.lit("clash").alias(c) for c in CLASH), F.length("text").cast("bigint").alias("n_chars"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word0x0 word1x1 word2x2"), (2, None), (3, "")], "item_id bigint, text string")


DOCUMENTS = {
    "shard": lambda d, b: shard.plan(d, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 5)[0].withColumnRenamed("id", "doc_id"),
    "ppm": lambda d, b: ppm.score(d),
    "secrets": lambda d, b: secrets.find_secrets(d),
    "redact": lambda d, b: secrets.redact(d),
    "quality": lambda d, b: quality.score(d),
    "near_dup": lambda d, b: near_dup.jaccard_components(d),
    "pii": lambda d, b: pii.find_personal_data(d),
    "decontam": lambda d, b: decontam.find_contamination(d, b),
}


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_one_row_for_each_row(docs, bench, name):
    found = DOCUMENTS[name](docs, bench).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", sorted(DOCUMENTS))
def test_empty_tables(docs, bench, name):
    assert DOCUMENTS[name](docs.where("false"), bench.where("false")).collect() == []


def test_defined_results(docs, bench):
    own = {str(r.doc_id): r for r in near_dup.jaccard_components(docs).collect()}
    assert (own["1"].n_shingles, own["1"].component_id, own["6"].component_id, own["4"].n_shingles) == (0, 1, 5, 1)
    hits = {str(r.doc_id): r for r in decontam.find_contamination(docs, bench).collect()}
    assert hits["1"].n_words == 0 and list(hits["5"]["items"]) == [1] and hits["5"].n_hit == 3
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {5, 6, 7}


def test_pack_edges(docs):
    pieces = pack.pack(docs, VOCABULARY).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == sorted(str(i) for i, _ in ROWS)
    assert [r.doc_tokens for r in pieces if r.doc_id == 1] == [1] and max(r.length for r in pieces) <= 4096
    assert pack.pack(docs.where("false"), VOCABULARY).collect() == []


def test_keep_one_edges(docs):
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None", "None"]


def test_keep_one_judges_rows_by_their_own_text(spark):
    """Rows that share an id but no text, and copies whose ids are null."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (None, text(3)), (None, text(3)), (5, text(3)), (None, text(4)), (None, text(4)), (6, None), (6, None)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame([(1, text(1)), (2, text(2)), (5, text(3)), (None, text(4)), (6, None), (6, None)], "doc_id bigint, text string").collect())


def test_drop_contaminated_keeps_columns(docs, bench):
    out = decontam.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and 5 not in {r.doc_id for r in out.collect()}


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", ""), (None, 1, None, "x"), (2, 1, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit(1)).withColumn("formatted", F.lit(2))
    out = chat.format_conversations(turns)
    assert all(r.identical for r in out.collect())
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [t.role for t in back[1].turns] == ["assistant", "user", "user"] and back[2].loss_text == LONG and back[None].loss_text == ""
    assert chat.read_back(chat.format_conversations(turns.where("false"))).collect() == []


def test_warc_edges(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "u v\r\nX: y", "same"), (3, "u", "same"), (4, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (9, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).withColumn("first", F.lit(0))
    warc.write(warc.deduplicated(pages), str(tmp_path / "a"))
    found = [(r.record_type, r.record_id, r.refers) for r in warc.read(spark, str(tmp_path / "a")).collect()]
    page = "<urn:page:{}>".format
    assert sorted(map(str, found)) == sorted(map(str, [
        ("response", page(1), None), ("revisit", page(2), page(1)), ("response", page(3), None), ("response", page(3), None), ("revisit", page(4), page(3)),
        ("revisit", page("none"), page(3)), ("response", page("none"), None), ("response", page(9), None),
    ]))
    warc.write(warc.deduplicated(pages.where("false")), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).collect() == []
