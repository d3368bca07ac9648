"""Prompts, chat messages and the parsing of completions, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip, text_or_empty, truncate

#: Fixed value: what precedes an assistant's turn.
ASSISTANT = "<|start_header_id|>assistant<|end_header_id|>"


def chat_prompt(system: str, user: Column) -> Column:
    return F.concat(F.lit(f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{system}\n<|eot_id|><|start_header_id|>user<|end_header_id|>\n"), user, F.lit(f"\n<|eot_id|>{ASSISTANT}\n"))


def judge_request(source: Column, entity: Column, language: Column, text: Column, code: Column) -> Column:
    """The body of a judge prompt; the recovery of text and code reads it back."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.concat(
        F.lit("Judge how well a documentation snippet fits the code.\n\nSOURCE TYPE: "), known(source), F.lit(" ("), known(entity), F.lit(")\nLANGUAGE: "), known(language),
        F.lit("\n\nDOCUMENTATION TEXT:\n"), truncate(text, 1200), F.lit("\n\nCODE/DIFF:\n"), truncate(code, 3000), F.lit("\n\nReturn ONLY JSON: label (keep, borderline or reject), then reason."),
    )


def user_request(code: Column, documentation: Column, question: Column, closing: str = "Answer directly and technically.") -> Column:
    return F.concat(F.lit("Code:\n"), text_or_empty(code), F.lit("\n\nDocumentation:\n"), text_or_empty(documentation), F.lit("\n\nQuestion:\n"), text_or_empty(question), F.lit(f"\n\n{closing}"))


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))


def question_request(text: Column, code: Column) -> Column:
    """Asks for a question and its answer about a piece of code."""
    return F.concat(
        F.lit("Write one question that a reader of this code would ask, and answer it from the code and its documentation.\n\nDocumentation:\n"), text_or_empty(text),
        F.lit("\n\nCode:\n"), text_or_empty(code), F.lit("\n\nReturn ONLY JSON: reasoning, question, answer."),
    )


def improve_request(code: Column, documentation: Column, question: Column, draft: Column) -> Column:
    """Asks for a better answer than a draft."""
    return F.concat(user_request(code, documentation, question, "Draft answer:"), F.lit("\n"), text_or_empty(draft), F.lit("\n\nImprove the draft: be correct, direct and short."))


def predict_request(code: Column, documentation: Column, question: Column) -> Column:
    """The request that predictions and rewards are made for."""
    return user_request(code, documentation, question, "Answer:")


#: Fixed value: a judgement, the label before the reason.
LABELLED = r'(?s)\{\s*"label"\s*:\s*"(?:keep|borderline|reject)"\s*,\s*"reason"\s*:\s*".*?"\s*\}'


def parse_judgement(raw: Column) -> Column:
    """struct<label, reason>; what can't be read is a reject."""
    text = text_or_empty(raw)
    text = strip(F.when(text.contains(ASSISTANT), F.element_at(F.split(text, rf"\Q{ASSISTANT}\E", -1), -1)).otherwise(text))
    found = F.from_json(F.regexp_extract(text, LABELLED, 0), "label string, reason string")
    ok = found.getField("label").isNotNull() & found.getField("reason").isNotNull()
    return F.when(ok, found).otherwise(F.struct(F.lit("reject").alias("label"), F.concat(F.lit("Could not parse model output: "), F.left(text, F.lit(100))).alias("reason")))


def recover_text(raw: Column) -> Column:
    return strip(F.regexp_extract(raw, r"(?s)DOCUMENTATION TEXT:\n(.*?)\n\nCODE/DIFF:", 1))


def recover_code(raw: Column) -> Column:
    return strip(F.regexp_extract(raw, r"(?s)CODE/DIFF:\n(.*?)\n\nReturn ONLY JSON:", 1))


def parse_answer(raw: Column, schema: str = "reasoning string, question string, answer string") -> Column:
    """The object between the last { and the last }, once more with line feeds as
    blanks; null where there is none."""
    body = F.regexp_extract(raw, r"(?s)(\{[^{]*\})[^}]*\z", 1)
    names = [f.split()[0] for f in schema.split(", ")]

    def read(text: Column) -> Column:
        got = F.from_json(text, schema, {"allowSingleQuotes": "false"})
        return F.when(F.coalesce(*(got.getField(n) for n in names)).isNotNull(), got)

    return F.when(body != "", F.coalesce(read(body), read(F.replace(body, F.lit("\n"), F.lit(" ")))))
