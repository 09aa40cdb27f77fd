"""WARC archives: writing with payload deduplication, and reading by a verified chain of record boundaries.

Archives are plain text files written by Spark's text writer, so they can lie wherever Spark writes. They are read as
segments between occurrences of the magic ``WARC/1.1`` and CR LF, in splits of any size. Every segment is a candidate: its
header gives a record length, and so the offset of its successor. Which candidates are records is decided from the file's
start alone. Candidates whose successor is the very next candidate form runs; runs are linked where a record ends at
another run; pointer jumping over runs, doubling its reach each round, marks what the first record reaches. Magic inside a
payload opens a candidate that nothing reaches.

Offsets are running sums of segment lengths, made from sums per split. The work on a file is on a few numbers per
segment; payloads are hashed where they are read. Only the texts of records that contain the magic are put together
from several segments, in a second reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Seconds are no part of the data, so records carry a constant date and archives are the same for the same pages.
DATE = "2024-01-01T00:00:00Z"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: 20 bits, that is five digits, are four letters."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: Column) -> Column:
    return base32(F.upper(F.sha1(payload.cast("binary"))))


def deduplicated(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """The columns page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of all rows.

    Of rows with equal payloads of at least ``min_bytes``, those with the smallest id are responses and the others
    revisits of it. A null payload is empty. Rows that share the smallest id are all responses; a null id is no smallest
    one unless the group has no other.
    """
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in pages.columns else F.lit("")
    payload = common.text_or_empty(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", digest(F.col("payload")))
    # Payloads are shuffled only where another row may have the same one; large groups are split by the adaptive join.
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = common.staged(groups.where("n > 1 and first is not null").drop("n"), f"{common.shared_dir(pages.sparkSession)}/groups")
    rows = common.may_hold(rows, "payload_digest", groups.select("payload_digest"), groups.count())
    alone, asked = (rows.where(c).drop("may_hold") for c in (~F.col("may_hold"), F.col("may_hold")))
    first = F.lit(None).cast(rows.schema["page_id"].dataType)
    rows = alone.withColumn("first", first).unionByName(asked.join(groups, ["payload_digest", "payload_bytes"], "left"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def record(payload: Column, page_id: Column, url: Column, payload_bytes: Column, payload_digest: Column, record_type: Column, refers_to: Column) -> Column:
    """A record but for its last CR LF. A revisit has no payload; it names the full payload's size and digest."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda of: F.concat(F.lit("<urn:page:"), F.coalesce(of.cast("string"), F.lit("none")), F.lit(">"))
    is_revisit = record_type == "revisit"
    block = F.when(is_revisit, F.lit("")).otherwise(payload)
    return F.concat(
        F.lit(MAGIC), line("WARC-Type", record_type), line("WARC-Record-ID", name(page_id)), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.regexp_replace(url, r"[\x00-\x20]+", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), payload_digest)), line("X-Payload-Length", payload_bytes.cast("string")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(refers_to)))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write(rows: DataFrame, path: str) -> None:
    """Archives of rows as :func:`deduplicated` returns them, one file per task."""
    text = record(*(F.col(c) for c in ("payload", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")))
    rows.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, split, seq (order within the file's split), value: what lies between occurrences of the magic."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _placed(segments: DataFrame) -> DataFrame:
    """Segments after a magic, with ``at``, where that magic begins: a running sum of sizes over the file."""
    line = Window.partitionBy("file").orderBy("split", "seq")
    before = F.sum(F.col("size") + len(MAGIC)).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("at", F.coalesce(before, F.lit(0)) - len(MAGIC)).where("at >= 0")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, at (offset), split, seq, end (offset of the successor; null without a readable length), whole (the payload
    lies in the segment), and the header's fields, for every segment after a magic."""
    head = F.substring_index("value", GAP, 1)
    length = F.expr("try_cast(length as bigint)")
    own = _segments(spark, path).withColumn("head", head)
    own = own.withColumn("length", _field(F.col("head"), "Content-Length")).withColumn("size", F.octet_length("value").cast("bigint"))
    own = own.withColumn("from", (F.octet_length("head") + len(GAP)).cast("bigint")).withColumn("length", F.when(F.col("from") <= F.col("size"), length))
    block = F.substring(F.col("value").cast("binary"), F.col("from").cast("int") + 1, F.col("length").cast("int"))
    whole = F.col("from") + F.col("length") <= F.col("size")
    own = own.select(
        "file", "split", "seq", "size", "from", "length", F.coalesce(whole, F.lit(False)).alias("whole"), F.when(whole, digest(block)).alias("sha1"),
        *(_field(F.col("head"), n).alias(a) for n, a in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers"), ("WARC-Payload-Digest", "stated"), ("X-Payload-Length", "stated_length"))),
    )
    own = _placed(own)
    return own.withColumn("end", F.col("at") + len(MAGIC) + F.col("from") + F.col("length") + len(GAP))


def reachable(found: DataFrame, path: str) -> DataFrame:
    """The candidates that the chain from each file's start reaches."""
    line = Window.partitionBy("file").orderBy("at")
    follows = F.coalesce(F.lag("end").over(line) == F.col("at"), F.lit(False))
    found = found.withColumn("opens", (~follows).cast("bigint"))
    found = common.staged(found.withColumn("run", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0))), f"{path}/candidates")
    runs = found.groupBy("file", "run").agg(F.min("at").alias("start"), F.max_by("end", "at").alias("exit"))
    # A run's exit is a candidate further on, in the middle of its run perhaps, or nothing.
    entry = found.select("file", F.col("at").alias("exit"), F.col("run").alias("next"))
    links = common.staged(runs.join(entry, ["file", "exit"], "left").select("file", "run", "start", "next", F.when(F.col("next").isNotNull(), F.col("exit")).alias("enter")), f"{path}/runs")
    jump = links.where("next is not null").select("file", "run", "next", "enter")
    reached = links.where("start = 0").select("file", "run", F.col("start").alias("from_at"))
    known = reached.count()
    turn = 0
    while True:
        step = reached.join(jump, ["file", "run"]).select("file", F.col("next").alias("run"), F.col("enter").alias("from_at"))
        reached = common.staged(reached.unionByName(step).groupBy("file", "run").agg(F.min("from_at").alias("from_at")), f"{path}/reached{turn}")
        if (now := reached.count()) == known:
            break
        known = now
        far = jump.select("file", F.col("run").alias("next"), F.col("next").alias("far"), F.col("enter").alias("far_enter"))
        jump = common.staged(jump.join(far, ["file", "next"]).select("file", "run", F.col("far").alias("next"), F.col("far_enter").alias("enter")), f"{path}/jump{turn}")
        turn += 1
    return found.join(reached, ["file", "run"]).where(F.col("at") >= F.col("from_at")).drop("from_at", "run", "opens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: file, at, record_type, record_id, refers, stated, stated_length, block_bytes, sha1.

    ``sha1`` is of the block as it lies in the archive. A file that doesn't begin with the magic has no record; a chain
    ends at the first record without a readable length. No archive gives no rows.
    """
    staging = common.shared_dir(spark)
    records = reachable(candidates(spark, path), staging)
    records = common.staged(records, f"{staging}/records")
    split = records.where(~F.col("whole")).select("file", F.col("at").alias("owner"), "end", (F.col("at") + len(MAGIC) + F.col("from")).alias("begin"), "length")
    if not split.isEmpty():
        records = records.join(_split_digests(spark, path, split), ["file", "at"], "left").withColumn("sha1", F.coalesce("sha1", "joined_sha1")).drop("joined_sha1")
    return records.select("file", "at", "record_type", "record_id", "refers", "stated", "stated_length", F.col("length").alias("block_bytes"), "sha1")


def _split_digests(spark: SparkSession, path: str, split: DataFrame) -> DataFrame:
    """Digests of blocks that hold the magic: the segments from the record's magic to its end are put together."""
    # Places are made anew: another reading may be cut into other splits.
    own = _segments(spark, path).join(split.select("file").distinct(), "file", "left_semi").withColumn("size", F.octet_length("value").cast("bigint"))
    inside = (F.col("at") >= F.col("owner")) & (F.col("at") < F.col("end"))
    parts = _placed(own).join(split, "file").where(inside).groupBy("file", "owner", "begin", "length").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("own"))
    text = F.concat(F.lit(MAGIC), F.array_join(F.transform("own", lambda x: x["value"]), MAGIC))
    block = F.substring(text.cast("binary"), (F.col("begin") - F.col("owner") + 1).cast("int"), F.col("length").cast("int"))
    return parts.select("file", F.col("owner").alias("at"), digest(block).alias("joined_sha1"))
