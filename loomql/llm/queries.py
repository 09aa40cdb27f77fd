"""The registered ``opN_*`` queries: each applies its operator to a whole table and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, near_dup, pack, pii, ppm, quality, secrets, shard, warc
from .common import shared_dir, table

SHARDS = 40
#: Before resharding, a source's documents lie together.
OLD_SHARDS = 32


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    assigned, flow = shard.plan(docs, old, SHARDS)
    written = shard.rewrite(assigned, flow, f"{shared_dir(spark)}/shards")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return written.select(F.col("id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives"
    warc.write(warc.deduplicated(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    records = warc.read(spark, path)
    # A response's payload is hashed and measured as it was read; a revisit has none and states what it refers to.
    own = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"), F.when(own, F.col("block_bytes")).otherwise(F.col("stated_length").cast("bigint")).alias("payload_bytes"),
        F.when(own, F.col("sha1")).otherwise(F.regexp_replace("stated", "^sha1:", "")).alias("payload_digest"), "record_type", page("refers").alias("refers_to"),
    )


def op4_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Made by a range, so that the whole plan is Spark's own.
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    back = chat.read_back(chat.format_conversations(turns.unionByName(more)))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "posterior")


def op8_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_components(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op1_reshard": op1_reshard, "op2_ppm_score": op2_ppm_score, "op3_warc_chain": op3_warc_chain, "op4_hilbert_pack": op4_hilbert_pack, "op5_secret_grammar": op5_secret_grammar, "op6_chat_round_trip": op6_chat_round_trip, "op7_quality_votes": op7_quality_votes, "op8_jaccard_tiles": op8_jaccard_tiles, "op9_personal_data": op9_personal_data, "op10_decontaminate": op10_decontaminate}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = lambda kept: f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{kept}')"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = " || ".join(f"translate(to_base(CAST('0x' || substr(sha1(h), {1 + 5 * k}, 5) AS BIGINT), 32, 4), '{_DIGITS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for k in range(8))

#: What SQL can express whole: the others have learnt parts, tokenizers, or searches that are too slow there.
SQL: dict[str, str] = {
    "op3_warc_chain": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op6_chat_round_trip": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, CASE WHEN regexp_matches(text, '(?s)\\.') OR contains(text, '</turn>') OR contains(text, '###')
                        THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##') ELSE text END AS shown FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ' || role || ': ' || shown || '</turn>') + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_jaccard_tiles": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM both_have JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON d.doc_id = a""",
    "op10_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_WORDS(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM win),
        own AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
        hit AS (SELECT DISTINCT doc_id, i, k, item_id FROM own JOIN win USING (k, s)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, places.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
