"""Quotation linking: reply-ordered conversations without their quotes.

The quote level of a line is the number of '>' before its text. Quoted lines are
normalised and hashed, and joined to the lines that messages of the same
conversation wrote themselves at an earlier turn. The message that most lines of
the outermost quotation lead to is the one replied to; without such a link it is
the previous message. Every conversation then comes in the order of its reply
tree, each message with only the text it adds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.runtime import materialise

QUOTE = r"^(?:[ \t]*>)+"
SCHEMA = "conv_id long, position long, turn long, role string, text string, parent_turn long, depth int, quoted_lines int, linked_lines int"


def level_of(line):
    """Number of '>' marks that open a line."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[ \t]", ""))


def normal(line):
    """A line without quote marks, case, punctuation and superfluous space."""
    bare = F.regexp_replace(line, QUOTE, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def messages(talk: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the position of each row in its conversation; rows without conv_id are left out."""
    lean = talk.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return lean.withColumn("n", F.row_number().over(order).cast("long"))


def lines(numbered: DataFrame) -> DataFrame:
    """conv_id, n, at, line, level, hash of every line; hash is null where nothing but marks is left."""
    split = numbered.where("text is not null").select("conv_id", "n", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("at", "line"))
    rest = normal(F.col("line"))
    return split.select("conv_id", "n", "at", "line", level_of(F.col("line")).alias("level"), F.when(rest != "", F.sha2(rest, 256)).alias("hash"))


def quotation_links(every: DataFrame) -> DataFrame:
    """conv_id, n, level, origin, matched: the message that most lines of each quote level come from; ties go to the latest."""
    quoted = every.where("level > 0 and hash is not null").select("conv_id", "n", "level", "hash", "at")
    own = every.where("level = 0 and hash is not null").select("conv_id", F.col("n").alias("origin"), "hash").distinct()
    met = quoted.join(own, ["conv_id", "hash"]).where("origin < n").groupBy("conv_id", "n", "level", "origin").agg(F.count("*").alias("matched"))
    best = Window.partitionBy("conv_id", "n", "level").orderBy(F.desc("matched"), F.desc("origin"))
    return met.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def _order(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Depth-first order of the reply trees of the conversations of one bucket."""
    rows = rows.sort_values(["conv_id", "n"], kind="stable").reset_index(drop=True)
    position, depth = [0] * len(rows), [0] * len(rows)
    convs, ns, parents = rows["conv_id"].tolist(), rows["n"].tolist(), rows["parent"].tolist()
    start = 0
    while start < len(rows):
        end = start
        while end < len(rows) and convs[end] == convs[start]:
            end += 1
        children: dict = {}
        for i in range(start, end):
            children.setdefault(0 if parents[i] != parents[i] or parents[i] is None else int(parents[i]), []).append(i)
        stack, place = [(i, 0) for i in reversed(children.get(0, []))], 0
        while stack:
            i, deep = stack.pop()
            place += 1
            position[i], depth[i] = place, deep
            stack += [(c, deep + 1) for c in reversed(children.get(ns[i], []))]
        start = end
    out = rows.assign(position=position, depth=depth)
    for c in ("turn", "parent_turn"):
        out[c] = out[c].astype("Int64")
    return out[[x.split()[0] for x in SCHEMA.split(", ")]]


def reply_order(talk: DataFrame) -> DataFrame:
    """SCHEMA of talk(conv_id, turn, role, text, ...): one row per message, in `position` order within its conversation.

    text lacks the quoted lines and the blank lines at its ends; parent_turn is
    the turn replied to (null for the first message); depth counts replies from
    the root. quoted_lines are those with words, linked_lines those whose
    original was found.

    Rows with a null conv_id are left out. A null text stays null and quotes
    nothing. A null turn comes after all others. Repeated (conv_id, turn) rows
    are messages of their own, in order of role and text. A quotation of
    something that no earlier message wrote leaves the previous message as the
    parent. An empty table gives an empty result. Other columns are not read.
    """
    spark = talk.sparkSession
    numbered = materialise(messages(talk), "messages")
    every = lines(numbered)
    own = every.groupBy("conv_id", "n").agg(
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "line")))).alias("_own"),
        F.sum(F.when((F.col("level") > 0) & F.col("hash").isNotNull(), 1).otherwise(0)).cast("int").alias("quoted_lines"),
    )
    links = quotation_links(every)
    replied = links.groupBy("conv_id", "n").agg(F.min_by("origin", "level").alias("origin"), F.sum("matched").cast("int").alias("linked_lines"))
    text = F.regexp_replace(F.array_join(F.transform("_own", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    joined = numbered.drop("text").join(own, ["conv_id", "n"], "left").join(replied, ["conv_id", "n"], "left")
    joined = joined.withColumn("parent", F.coalesce("origin", F.when(F.col("n") > 1, F.col("n") - 1)))
    parents = numbered.select(F.col("conv_id").alias("_c"), F.col("n").alias("_n"), F.col("turn").alias("parent_turn"))
    joined = joined.join(parents, (F.col("conv_id") == F.col("_c")) & (F.col("parent") == F.col("_n")), "left")
    ready = joined.select(
        "conv_id", "n", "turn", "role", text.alias("text"), "parent", "parent_turn", F.coalesce("quoted_lines", F.lit(0)).alias("quoted_lines"), F.coalesce("linked_lines", F.lit(0)).alias("linked_lines"),
        F.pmod(F.xxhash64("conv_id"), F.lit(8 * int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("bucket"),
    )
    return ready.groupBy("bucket").applyInPandas(_order, SCHEMA)
