"""Shared pieces: reading tables, staging tables in the shared folder, and small helpers on columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the words of most operators are split (Java and Python regular expressions).
BLANK = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None
#: Every folder that ``shared_dir`` has given out: a caller can free those of steps that are over.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this process, removed when it ends; that serves only where the driver and
    all tasks are one process, so anywhere else it is an error.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="loomql-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = _own_dir
    made.append(path := f"{base.rstrip('/')}/loomql/{uuid.uuid4().hex}")
    return path


def free(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables. What was made of them must be written by now."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if p in made:
            made.remove(p)


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: lineage ends there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_none(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table, or None where the folder has none of that name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return table(spark, sf_dir, name) if there else None


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case, as Spark does)."""
    names, name, k = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in names:
        k += 1
        name = f"{stem}{k}"
    return name


#: Bits of the largest id filter: sent out as at most 2 ** 21 words of 64 bits, whatever the number of ids.
FILTER_BITS = 27


def may_hold(rows: DataFrame, id_col: str, ids: DataFrame, count: int) -> DataFrame:
    """``rows`` and a last boolean column: false only where the id (null is an id too) isn't in ``ids`` (one column).

    A bit per hash value, about sixteen bits per id up to the bound; beyond it more rows are let through, and the
    exact join that follows has more to do. Rows are not shuffled.
    """
    bits = min(FILTER_BITS, max(10, (16 * max(count, 1)).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    name, word, held = fresh(rows, "may_hold"), fresh(rows, "filter_word"), fresh(rows, "filter_bits")
    words = ids.select(at(F.col(ids.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias(held))
    place = at(F.col(f"`{id_col}`"))
    rows = rows.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), word, "left")
    bit = F.call_function("shiftrightunsigned", F.col(held), place.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return rows.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(word, held)
