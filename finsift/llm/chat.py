"""Chat formatting with cumulative-snapshot collapse.

Logs often hold the same conversation several times, each snapshot a turn longer. A rolling hash over a conversation's
turns names every prefix; a conversation whose whole hash is the hash of a proper prefix of another is dropped by an
anti-join, and of equal conversations the one with the smallest id stays. Only the maximal ones are rendered.

Turns are in the order of (turn, role, text), nulls first; null roles and texts count as empty. Rows without a
conversation id are left out. Repeated rows of a turn are turns of their own. An empty table gives an empty result.
Only 16 bytes a turn are gathered for the hashes; a rendered conversation is one value, so it has to fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm._shared import read, written

START, END = "<|im_start|>", "<|im_end|>"


def harmless(x: Column) -> Column:
    """x without marks of its own."""
    for mark in (START, END):
        x = F.replace(x, F.lit(mark), F.lit(mark.replace("|", "\\|", 1)))
    return x


def prefixes(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, n_turns, hashes): the hash of each prefix, the whole conversation's last."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("t"), F.unhex(F.md5(F.concat_ws("\n", role, F.md5(text.cast("binary"))).cast("binary"))).alias("h"))
    order = turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    @F.arrow_udf("array<binary>")
    def rolling(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = []
            for hashes in lists.to_pylist():
                state, held = b"", []
                for h in hashes:
                    state = hashlib.md5(state + h, usedforsecurity=False).digest()
                    held.append(state)
                out.append(held)
            yield pa.array(out, pa.list_(pa.binary()))

    return order.select("conv_id", F.size("turns").alias("n_turns"), rolling(F.col("turns.h")).alias("hashes"))


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another."""
    known = written(prefixes(turns, conv_col, turn_col, role_col, text_col), "prefixes")
    whole = known.select("conv_id", "n_turns", F.element_at("hashes", -1).alias("h"))
    unique = whole.groupBy("h").agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"))
    proper = known.where("n_turns > 1").select(F.explode(F.expr("slice(hashes, 1, n_turns - 1)")).alias("h")).distinct()
    return unique.join(proper, "h", "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, chat) of the maximal conversations."""
    kept = written(maximal(turns, conv_col, turn_col, role_col, text_col), "maximal")
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    own = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("t"), text.alias("text")).alias("x"))
    lists = own.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    chat = F.array_join(F.transform("x", lambda x: F.concat(F.lit(START), harmless(x["role"]), F.lit("\n"), harmless(x["text"]), F.lit(END + "\n"))), "")
    return lists.select("conv_id", F.size("x").cast("long").alias("n_turns"), chat.alias("chat"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = render(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return chats.select("conv_id", "n_turns", F.length("chat").cast("long").alias("n_chars"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))


def oracle() -> str:
    safe = lambda x: f"replace(replace({x}, '<|im_start|>', '<\\|im_start|>'), '<|im_end|>', '<\\|im_end|>')"
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT conv_id, list(role || chr(10) || md5(text) ORDER BY turn NULLS FIRST, role, md5(text)) AS h,
                 string_agg('{START}' || {safe('role')} || chr(10) || {safe('text')} || '{END}' || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text)) AS chat FROM t GROUP BY conv_id),
    w AS (SELECT conv_id, len(h) AS n, array_to_string(h, chr(0)) AS k, chat FROM l),
    p AS (SELECT DISTINCT array_to_string(h[1:i], chr(0)) AS k FROM (SELECT h, unnest(range(1, len(h))) AS i FROM l)),
    u AS (SELECT k, min(conv_id) AS conv_id, any_value(n) AS n, any_value(chat) AS chat FROM w GROUP BY k)
    SELECT conv_id, n AS n_turns, CAST(length(chat) AS BIGINT) AS n_chars, sha256(chat) AS chat_sha256 FROM u WHERE k NOT IN (SELECT k FROM p)
    """
