"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation (every role but `system`) the whole dialogue is rendered with that speaker as the
assistant and all others as named users; the mask is true exactly on the assistant's messages, and spans give the
characters of their contents.

A rendered dialogue comes in chunks of `per_chunk` messages, so most have one row and a dialogue of any length is many of
bounded count; `start` is where a chunk's text begins in the whole dialogue, and spans count from there too, so the chunks
on end are the dialogue. Messages are ordered by a range sort, which spreads one long conversation over partitions; places
in the conversation and offsets are running sums within a partition or chunk plus the sums of those before.

Cases: messages are ordered by turn (null first), role and MD5 of the text; equal messages are rendered as often as they
occur; a null role speaks as `unknown`; a null text is empty; a null conversation is one of its own; a conversation of
system messages alone has no perspective; `<|` in a role or text is rendered as `< |`, so nobody can forge a mark, and a line
break in a role as a space; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixar.llm import common

SYSTEM, ASSISTANT, USER, END = "<|im_start|>system\n", "<|im_start|>assistant\n", "<|im_start|>user name=", "<|im_end|>\n"


def ordered(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, role, text) with pos from 0 in the conversation's order."""
    spark = messages.sparkSession
    plain = lambda c, default: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(default)), F.lit("<|"), F.lit("< |"))
    m = messages.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.regexp_replace(plain(role_col, "unknown"), "[\r\n]", " ").alias("role"), plain(text_col, "").alias("text"))
    m = m.withColumns({"h": F.md5("text"), "row": F.monotonically_increasing_id()})  # row: equal messages may part
    order = ["conv_id", "turn", "role", "h", "row"]
    dealt = common.materialize(m.repartitionByRange(common.partitions(spark), *order).withColumn("part", F.spark_partition_id()), "messages")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))  # at most partitions + conversations rows
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.filter("base > 0").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "base")  # at most partitions rows
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "h", "row")) - 1
    placed = dealt.withColumn("within", within).join(F.broadcast(before), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return placed.select("conv_id", (F.col("within") + F.coalesce("base", F.lit(0))).alias("pos"), "role", "text")


def rotate(messages: DataFrame, per_chunk: int = 1024, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, chunk, start, n_messages, text, mask, spans) for every participant and chunk."""
    m = ordered(messages, conv_col, turn_col, role_col, text_col).withColumn("chunk", F.floor(F.col("pos") / per_chunk).cast("long"))
    # as `base`, everyone but `system` is a named user; a perspective's own messages then differ by one constant each
    base = F.when(F.col("role") == "system", F.lit(len(SYSTEM))).otherwise(F.length("role") + len(USER) + 1) + F.length("text") + len(END)
    m = m.withColumn("base", base.cast("long"))
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum("base").over(in_chunk), F.lit(0)))
    m = m.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "chunk", "role").orderBy("pos")) - 1)
    m = common.materialize(m, "chunks")
    chunks = m.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "at", "nth"))).alias("messages"), F.sum("base").alias("size"))
    chunks = chunks.withColumn("base_start", F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = m.groupBy(F.col("conv_id").alias("_c")).agg(F.max("chunk").alias("last"))
    own = m.filter("role <> 'system'").groupBy("conv_id", F.col("role").alias("perspective"), "chunk").agg(F.count(F.lit(1)).alias("own"))
    who = own.select("conv_id", "perspective").distinct().join(last, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"))
    own = own.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("chunk").alias("_k"), "own")
    who = who.join(own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("chunk") == F.col("_k")), "left")
    so_far = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    who = who.select(F.col("conv_id").alias("_c"), "perspective", F.col("chunk").alias("_k"), F.coalesce(F.sum("own").over(so_far), F.lit(0)).alias("own_before"))
    d = chunks.join(who, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")))
    differ = F.lit(len(ASSISTANT)) - (F.length("perspective") + len(USER) + 1)
    d = d.withColumn("differ", differ).withColumn("start", (F.col("base_start") + F.col("own_before") * F.col("differ")).cast("long"))
    head = lambda x: F.when(x["role"] == "system", F.lit(SYSTEM)).when(x["role"] == F.col("perspective"), F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), x["role"], F.lit("\n")))
    text = F.array_join(F.transform("messages", lambda x: F.concat(head(x), x["text"], F.lit(END))), "")
    mine = F.filter("messages", lambda x: x["role"] == F.col("perspective"))
    begin = lambda x: F.col("start") + x["at"] + x["nth"] * F.col("differ") + len(ASSISTANT)
    spans = F.transform(mine, lambda x: F.struct(begin(x).cast("long").alias("start"), (begin(x) + F.length(x["text"])).cast("long").alias("end")))
    return d.select("conv_id", "perspective", "chunk", "start", F.size("messages").cast("long").alias("n_messages"), text.alias("text"), F.transform("messages", lambda x: x["role"] == F.col("perspective")).alias("mask"), spans.alias("spans"))
