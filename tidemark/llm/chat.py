"""Chat formatting with Spark expressions only.

``format_conversations`` sorts the collected turn structs of a conversation, merges adjacent turns of one role into
a block and concatenates the blocks. The template is

    <|role|>ROLE<|text|>PART<|part|>PART<|end|>

with one part per original turn, so merging loses no turn border. Control strings inside roles and texts (the
template's own and those of other common templates) are escaped reversibly: ``&`` first, then the opening character.
``read_conversations`` parses the formatted string back into turns.

Defined cases: null role or text counts as empty; turns are ordered by (turn, role, text), a null turn first, so ties
and repeated rows have one order and all of them stay; rows whose conversation id is null form one conversation; an
empty table gives no rows; further columns are ignored. A conversation becomes one string, so it must fit a row; work
and memory grow linearly with it. Partial ``collect_list`` results are built before the only exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, PART, END = "<|role|>", "<|text|>", "<|part|>", "<|end|>"

#: Fixed values: (control string, its escaped form). All template strings start with the first.
CONTROLS = [("<|", "&lt;|"), ("|>", "|&gt;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lsqb;INST]"), ("[/INST]", "&lsqb;/INST]")]
_BACK = [("&lt;", "<"), ("&gt;", ">"), ("&lsqb;", "["), ("&amp;", "&")]
_CHUNK = 256


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, safe in CONTROLS:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, plain in _BACK:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _with_prefix_sums(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Array of exclusive prefix sums of an array of longs, in blocks, so that no array grows one by one over all of it."""
    zero = lambda: F.struct(F.lit(0).cast("bigint").alias("s"), F.expr("cast(array() as array<bigint>)").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _CHUNK) - 1, F.lit(0)).cast("int"))
    df = df.withColumn("__chunks", F.transform(starts, lambda c: F.slice(F.col(lengths), c * _CHUNK + 1, _CHUNK)))
    df = df.withColumn("__local", F.transform("__chunks", lambda ch: F.aggregate(ch, zero(), step)))
    df = df.withColumn("__base", F.aggregate("__local", zero(), lambda acc, x: step(acc, x["s"]))["a"])
    sums = F.flatten(F.zip_with("__local", "__base", lambda x, b: F.transform(x["a"], lambda v: v + b)))
    return df.withColumn(out, sums).drop("__chunks", "__local", "__base")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``n_turns``, ``n_blocks`` and ``loss``.

    ``loss`` lists, in order, where a text of ``loss_role`` stands in ``formatted``: (start, length) in code points
    and (byte_start, byte_length) in UTF-8; nothing else is under the mask.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    df = df.withColumn("t", F.transform("t", lambda x: F.struct(x["role"].alias("role"), escape(x["text"]).alias("text"))))
    # A block starts where the role changes.
    df = df.withColumn("prev", F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("t.role")), 1, F.size("t")))
    df = df.withColumn("first", F.zip_with("t", "prev", lambda x, p: ~x["role"].eqNullSafe(p)))
    df = df.withColumn("at", F.filter(F.zip_with("first", F.sequence(F.lit(1), F.size("t")), lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
    df = df.withColumn("upto", F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("t") + 1)))
    df = df.withColumn("blocks", F.zip_with("at", "upto", lambda a, b: F.slice(F.col("t"), a, b - a)))
    # Each block as its pieces: head, part, separator, part, ..., end; those of the loss role are marked.
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def pieces(b):
        head = F.concat(F.lit(ROLE), escape(b[0]["role"]), F.lit(TEXT))
        body = F.flatten(F.transform(b, lambda x, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(PART)), no), piece(x["text"], x["role"] == loss_role))))
        return F.concat(F.array(piece(head, no)), body, F.array(piece(F.lit(END), no)))

    df = df.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    df = df.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.size("blocks").cast("bigint").alias("n_blocks"), "pieces")
    df = df.withColumn("formatted", F.array_join("pieces.s", ""))
    df = df.withColumn("chars", F.transform("pieces", lambda p: F.char_length(p["s"]).cast("bigint")))
    df = df.withColumn("bytes", F.transform("pieces", lambda p: F.octet_length(p["s"]).cast("bigint")))
    df = _with_prefix_sums(df, "chars", "char_at")
    df = _with_prefix_sums(df, "bytes", "byte_at")
    spans = F.arrays_zip("pieces.loss", "char_at", "chars", "byte_at", "bytes")
    loss = F.transform(
        F.filter(spans, lambda z: z["loss"]),
        lambda z: F.struct(z["char_at"].alias("start"), z["chars"].alias("length"), z["byte_at"].alias("byte_start"), z["bytes"].alias("byte_length")),
    )
    return df.select("conv_id", "formatted", "n_turns", "n_blocks", loss.alias("loss"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Adds, from ``formatted`` and ``loss`` alone, ``turns`` (role, text; escapes undone) and ``loss_text``."""
    quoted = lambda s: re.escape(s)
    blocks = F.split("formatted", quoted(END))
    df = formatted.withColumn("__blocks", F.slice(blocks, 1, F.size(blocks) - 1))

    def turns_of(b):
        halves = F.split(b, quoted(TEXT))
        role = unescape(F.substring(halves[0], F.lit(len(ROLE) + 1), F.char_length(halves[0])))
        return F.transform(F.split(halves[1], quoted(PART)), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    df = df.withColumn("turns", F.flatten(F.transform("__blocks", turns_of))).withColumn("__raw", F.col("formatted").cast("binary"))
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("__raw"), (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")))
    return df.withColumn("loss_text", F.array_join(under, "")).drop("__blocks", "__raw")
