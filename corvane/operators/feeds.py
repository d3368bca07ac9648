"""Training feeds: prompt-completion rows and preference rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.prompts import messages, user_request
from corvane.functions.text import text_or_empty

SYSTEM = "You answer questions about code from the code and its documentation."


def sft_feed(df: DataFrame, doc: str = "text", answer: str = "improved_answer", system: str = SYSTEM) -> DataFrame:
    """Rows whose four fields are not empty, as (prompt, completion) messages."""
    kept = df.where(" and ".join(f"length(`{c}`) > 0" for c in ("code", doc, "question", answer)))
    ask = user_request(F.col("code"), F.col(doc), F.col("question"))
    return kept.select(messages(("system", F.lit(system)), ("user", ask)).alias("prompt"), messages(("assistant", text_or_empty(F.col(answer)))).alias("completion"))


def preference_feed(df: DataFrame, chosen: str = "improved_answer", rejected: str = "raw_answer", doc: str = "text", system: str = SYSTEM) -> DataFrame:
    """Rows with two different answers, as (prompt, chosen, rejected) messages."""
    good, bad = text_or_empty(F.col(chosen)), text_or_empty(F.col(rejected))
    kept = df.where(" and ".join(f"length(`{c}`) > 0" for c in ("code", doc, "question"))).where((good != "") & (bad != "") & (good != bad))
    ask = user_request(F.col("code"), F.col(doc), F.col("question"))
    return kept.select(messages(("system", F.lit(system)), ("user", ask)).alias("prompt"), messages(("assistant", good)).alias("chosen"), messages(("assistant", bad)).alias("rejected"))
