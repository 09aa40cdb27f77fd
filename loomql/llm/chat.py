"""Chat formatting with a grammar round trip, in DataFrame operations only.

A turn is rendered as ``### ROLE: TEXT</turn>`` and a line feed. The parser is deterministic: it cuts at ``</turn>`` and a
line feed, takes the role up to the first colon and blank, and turns every backslash with the character after it into
that character. A conversation is first rendered as it is and parsed again; turns that don't come back identical are
rendered with their control strings escaped, after which neither a role nor a text can hold one:

* a backslash becomes two, ``</turn>`` becomes ``<\\/turn>``, ``###`` becomes ``#\\##``; in roles ``:`` becomes ``\\:``.

The rendered conversation is parsed once more as a whole and the result compared with the source: ``identical`` says so,
and reading ``formatted`` of one that differs is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"
OPEN = "### "
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("<\\/turn>")), F.lit("###"), F.lit("#\\##"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """Array of (role, text, start, end) of the rendered turns; start and end are code points of the escaped text."""
    role_end = r"(?s)^### ((?:[^:\\]|\\.)*+): "
    pieces = F.split(rendered, END + "\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    heads = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.regexp_extract(p, role_end, 1).alias("role")))
    read = F.transform(heads, lambda h: F.struct(unescape(h["role"]).alias("role"), F.substr(h["piece"], F.char_length(h["role"]) + F.lit(len(OPEN) + 3)).alias("body"), (F.char_length(h["role"]) + F.lit(len(OPEN) + 2)).alias("head")))
    # The positions are running sums over the turns. Their array is copied once a turn: eight bytes times the turns squared.
    ends = F.aggregate(read, F.struct(F.array().cast("array<bigint>").alias("to"), F.lit(0).cast("bigint").alias("at")), lambda acc, x: F.struct(F.concat(acc["to"], F.array(acc["at"])).alias("to"), (acc["at"] + x["head"] + F.char_length(x["body"]) + F.lit(len(END) + 1)).cast("bigint").alias("at")), lambda acc: acc["to"])
    return F.transform(
        F.arrays_zip(read.alias("r"), ends.alias("e")),
        lambda z: F.struct(z["r"]["role"].alias("role"), unescape(z["r"]["body"]).alias("text"), (z["e"] + z["r"]["head"]).cast("bigint").alias("start"), (z["e"] + z["r"]["head"] + F.char_length(z["r"]["body"])).cast("bigint").alias("end")),
    )


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points in ``formatted``), identical.

    Turns are ordered by (turn, role, text), null turns first; null texts and roles are empty; repeated rows are turns
    of their own; rows with a null conversation form one conversation. An empty table gives an empty result. The text of
    one conversation is put together in one row, as its rendering is one string.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    back = lambda r: F.size(r) == 1
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    plain = _turn(F.col("role"), F.col("text"))
    rows = rows.withColumn("again", parse(plain))
    same = back(F.col("again")) & (F.col("again")[0]["role"] == F.col("role")) & (F.col("again")[0]["text"] == F.col("text"))
    # A text with a control string that happens to survive alone must not open a turn once others follow it.
    free = ~F.col("text").contains(END) & ~F.col("text").contains("###") & ~F.col("role").contains(END)
    rows = rows.withColumn("piece", F.when(F.coalesce(same, F.lit(False)) & free, plain).otherwise(_turn(escape_role(F.col("role")), escape(F.col("text"))))).drop("again")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("own"))
    whole = whole.select("conv_id", F.transform("own", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"), F.array_join(F.transform("own", lambda x: x["piece"]), "").alias("formatted"))
    read = whole.withColumn("parsed", parse(F.col("formatted")))
    identical = F.col("source") == F.transform("parsed", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    # Escaping leaves no control string in a turn, so this can't differ; if it did, the text must not be used.
    read = read.withColumn("formatted", F.when(identical, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    loss = F.transform(F.filter("parsed", lambda x: x["role"] == LOSS_ROLE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return read.select("conv_id", "formatted", loss.alias("loss_spans"), identical.alias("identical"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) as parsed, loss_text (all text under the mask, unescaped), formatted_chars."""
    out = formatted.withColumn("parsed", parse(F.col("formatted")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return out.select("conv_id", F.transform("parsed", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
