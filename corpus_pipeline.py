"""A corpus pipeline of five stages over ``documents``; counted as part of ``loomql.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, extra ones too, whatever their names. Every stage
keeps rows with a null id, treats a null text as its operator does, judges repeated rows each (only the second removes
copies), takes whole texts however long, and gives an empty table of an empty one.

What a stage has staged is freed when the next one begins, unless that one's ``docs`` still read it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.llm import common, decontam, near_dup, pack, quality, secrets

#: SQL has no learnt rules, shingle components, automata or tokenizers: run() is tested against brute force instead.
ORACLE_SQL = None

#: Folders that stages have staged tables in, and that may still be read.
_staged: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for path in [p for p in _staged if not any(p.rpartition("/")[2] in f for f in read)]:
            common.free(spark, path)
            _staged.remove(path)
        before = len(common.made)
        out = work(spark, docs, sf_dir)
        _staged.extend(common.made[before:])
        return out

    return run_one


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is even or better and that pass the base rule. Null, empty and short texts fail
    it; ties at even odds are kept; equal texts get equal verdicts, whatever their id. ``labels`` help the estimates where
    the folder has them."""
    return quality.keep_good(docs, common.table_or_none(spark, sf_dir, "labels"))


@_stage
def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id. Texts without words are no copies."""
    return near_dup.keep_one(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. A null or empty text, and any text where the benchmark is empty, has none."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted anew. A null text stays null."""
    return secrets.redact(docs)


@_stage
def hilbert_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a checksum of their ids. A null or empty text is its end alone; equal
    vectors go by id."""
    import public_tokenizers

    pieces = pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_dedup", jaccard_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("hilbert_pack", hilbert_pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``. Each stage's table is freed once the next one's is written."""
    docs = common.table(spark, sf_dir, "documents")
    path = common.shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs = common.staged(out, f"{path}/{k}_{name}")
        if k:
            common.free(spark, f"{path}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
