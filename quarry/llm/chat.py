"""Chat formatting of reply trees.

A message has a conversation, an id and the id of what it replies to. Root-to-leaf paths come from iterative self-joins:
the pairs (leaf, message, distance) of up to 2^k - 1 steps are joined with the table of jumps of 2^k steps, which is joined
with itself for 2^(k+1), so a thread of n turns takes log2(n) rounds. A conversation's paths are ranked by mean score of their
messages, then leaf id; the best `keep` are formatted, each as one conversation:

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

Inside roles and texts, `&` becomes `&amp;` and the first sign of any control string (CONTROL) a character reference, so
no such string is left and the text can be read back. The loss mask is the list of (start, end), in code points of the formatted text, of the
assistant's escaped texts.

Defined cases: a null text or role is empty; equal turns are ordered by role, then text; rows that repeat are turns of
their own; a message whose parent is missing is a root; a reply cycle has no root and gives no path; an empty table gives no conversation but those added; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import cut, read, running_sum

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REFERENCE = {"<": "&lt;", "[": "&#91;"}


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(REFERENCE[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for sign, reference in REFERENCE.items():
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def threads(conversations: DataFrame) -> DataFrame:
    """Rows by turn as messages, each a reply to the one before: conv_id, msg_id, parent_id, role, text, score."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("bigint")
    return conversations.select("conv_id", n.alias("msg_id"), F.when(n > 1, n - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, msg_id, up (steps from the leaf): the messages of every root-to-leaf path."""
    ids = messages.select("conv_id", "msg_id", "parent_id")
    known = ids.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("p"))
    jumps = ids.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent_id") == F.col("p"))).select("conv_id", "msg_id", F.col("parent_id").alias("to"))
    jumps = cut(jumps)
    replied = jumps.select(F.col("conv_id").alias("c"), F.col("to").alias("p")).distinct()
    leaf = ids.join(replied, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("p")), "left_anti")
    pairs = leaf.select("conv_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("bigint").alias("up"))
    step = 1
    while not jumps.isEmpty():
        hop = jumps.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("p"), F.col("to").alias("to2"))
        further = pairs.join(hop, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("p"))).select("conv_id", "leaf", F.col("to2").alias("msg_id"), (F.col("up") + step).alias("up"))
        grown = cut(further)
        pairs = cut(pairs.unionByName(grown))
        if grown.isEmpty():
            break  # what jumps are left lie on cycles, which no leaf reaches, or beyond all paths
        jumps = cut(jumps.join(hop, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("to") == F.col("p"))).select("conv_id", "msg_id", F.col("to2").alias("to")))
        step *= 2
    return pairs


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """conv_id, leaf, n_turns, formatted, mask (array of start, end): the best paths of each conversation."""
    found = paths(messages).withColumnsRenamed({"conv_id": "c", "msg_id": "m"})
    rows = found.join(messages, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("m") == F.col("msg_id"))).select("conv_id", "leaf", "up", "role", "text", "score")
    turns = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    one = rows.groupBy("conv_id", "leaf").agg(turns.alias("turns"), F.avg("score").alias("score"))
    best = one.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("score").desc_nulls_last(), "leaf"))).filter(F.col("place") <= keep)
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    parts = best.select("conv_id", "leaf", "turns", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))).alias("parts"))
    tail = F.lit(f"{END}\n")
    lengths = F.transform("parts", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(tail)).cast("bigint"))
    parts = parts.withColumn("ends", running_sum(lengths))
    spans = F.transform("parts", lambda p, i: F.struct(p["loss"].alias("loss"), (F.get("ends", i) - F.length(tail) - F.length(p["body"])).alias("start"), (F.get("ends", i) - F.length(tail)).alias("end")))
    mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], tail)), "")
    return parts.select("conv_id", "leaf", F.size("turns").cast("bigint").alias("n_turns"), formatted.alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text from formatted and mask alone."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    said = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = lambda p: F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n"))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)
    turns = F.transform(said, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def with_control_case(conversations: DataFrame) -> DataFrame:
    """Conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(added)


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    out = read_back(format_trees(threads(with_control_case(read(spark, sf_dir, "conversations")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def _escaped(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{REFERENCE[c[0]] + c[1:]}')"
    return out


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length(replace({_escaped("role")}, chr(10), '&#10;')) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
