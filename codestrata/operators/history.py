"""Conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turns shown and preview lengths.
LAST_TURNS, QUESTION_CHARS, ANSWER_CHARS = 5, 60, 100


def question_answers(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows, from ``(conv_id, turn, role, text)``.

    Turns are numbered one by one, so the answer is found by key and a very long conversation spreads over tasks.
    """
    asked = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answers, ["conv_id", "turn"], "left").select("conv_id", "turn", "question", "answer")


def last_turns(turns: DataFrame, n: int = LAST_TURNS) -> DataFrame:
    """Last ``n`` questions of every conversation, oldest first, as previews."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    forward = Window.partitionBy("conv_id").orderBy("turn")
    return recent.select(
        "conv_id", "turn", F.row_number().over(forward).alias("no"),
        F.concat(F.substring("question", 1, QUESTION_CHARS), F.lit("...")).alias("question_preview"),
        F.concat(F.substring(F.coalesce("answer", F.lit("")), 1, ANSWER_CHARS), F.lit("...")).alias("answer_preview"),
    )
