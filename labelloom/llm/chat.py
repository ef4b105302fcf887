"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that
reply trainable. A conversation that doesn't end with an assistant turn also gets an example of all
its turns with nothing trainable, so that no turn is lost.

A turn reads ``<s>role<t>text</s>``. Inside roles and texts a backslash follows each ``<``, ``[``
and backslash, so none of the marks above, and no other mark in angle or square brackets, can
occur there; taking those backslashes away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common as C

START, MIDDLE, END = "<s>", "<t>", "</s>"
TRAINED_ROLE = "assistant"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """Examples ``conv_id, example, formatted, target_start, target_chars`` from rows by turn.

    The trainable part of ``formatted`` is ``target_chars`` code points from ``target_start``
    (from 0; null where nothing is trainable). Null texts and roles count as empty, equal turn
    numbers are ordered by role and text, null turn numbers come first, and repeated rows stay.
    Rows with a null conv_id form one conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = F.struct(
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(START), escape(role), F.lit(MIDDLE)).alias("head"),
        escape(text).alias("body"),
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    whole = F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    talks = talks.select("conv_id", "t", whole.alias("whole"), F.size("t").alias("n"))
    at = talks.select("conv_id", "whole", "n", F.posexplode("t").alias("i", "x")).filter(
        (F.col("x.role") == TRAINED_ROLE) | (F.col("i") == F.col("n") - 1)
    )
    before = F.concat(F.array_join(F.slice("whole", F.lit(1), F.col("i")), ""), F.col("x.head"))
    trained = F.col("x.role") == TRAINED_ROLE
    return at.select(
        "conv_id",
        F.col("i").alias("example"),
        before.alias("context"),
        F.col("x.body").alias("body"),
        trained.alias("trained"),
    ).select(
        "conv_id",
        "example",
        F.concat("context", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("trained"), F.char_length("context")).alias("target_start"),
        F.when(F.col("trained"), F.char_length("body")).alias("target_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """``conv_id, turns (role, text), losses, formatted_chars`` read from formatted examples only.

    The last example of a conversation holds all its turns. ``losses`` are the trainable texts.
    """
    last = F.max_by("formatted", "example")
    loss = F.when(
        F.col("target_start").isNotNull(),
        F.struct(
            "example",
            unescape(F.substring(F.col("formatted"), F.col("target_start") + 1, F.col("target_chars"))).alias("loss"),
        ),
    )
    found = examples.groupBy("conv_id").agg(
        last.alias("last"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    pieces = F.slice(F.split("last", END), F.lit(1), F.size(F.split("last", END)) - 1)
    turn = lambda x: F.struct(
        unescape(F.substring(F.split(x, MIDDLE)[0], len(START) + 1, 2**31 - 1)).alias("role"),
        unescape(F.split(x, MIDDLE)[1]).alias("text"),
    )
    return found.select(
        "conv_id",
        F.transform(pieces, turn).alias("turns"),
        F.transform("losses", lambda x: x["loss"]).alias("losses"),
        "formatted_chars",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """Add conversation -1, whose texts are control strings."""
    made = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(TRAINED_ROLE)).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(made)


def digest(turns: DataFrame) -> DataFrame:
    back = read_back(format_turns(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark, folder: str) -> DataFrame:
    return digest(with_probe(C.table(spark, folder, "conversations")))


ORACLE = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), sized AS (
  SELECT *, 10 + 2 * (length(role) + length(text))
    - length(regexp_replace(role, '[<\[\\]', '', 'g')) - length(regexp_replace(text, '[<\[\\]', '', 'g')) AS chars,
    lead(turn) OVER w IS NULL AS is_last,
    row_number() OVER w AS nth
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY nth) AS upto FROM sized
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS everything,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '') AS learnt,
    sum(CASE WHEN role = 'assistant' OR is_last THEN upto END)::BIGINT AS formatted_chars
  FROM summed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars FROM joined
"""
