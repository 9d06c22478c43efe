"""String, time, hash and JSON helpers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_case(c: Column) -> Column:
    """CamelCase to snake_case; digits stay with the word before them, and a leading underscore is read as ``private``."""
    parted = F.regexp_replace(F.regexp_replace(c, "(.)([A-Z][a-z0-9]+)", "$1_$2"), "([a-z])([A-Z])", "$1_$2")
    low = F.lower(parted)
    return F.when(F.startswith(low, F.lit("_")), F.concat(F.lit("private"), low)).otherwise(low)


def whitelisted(c: Column) -> Column:
    """Only letters, digits and ``- _ . , space``."""
    return F.regexp_replace(c, r"[^a-zA-Z0-9\-_. ,]", "")


def short_label(c: Column, longest: int = 60) -> Column:
    """Longer labels as eight hash digits, a dash and the last 51 characters."""
    return F.when(F.length(c) > longest, F.concat(F.left(F.sha2(c, 256), F.lit(8)), F.lit("-"), F.right(c, F.lit(51)))).otherwise(c)


def input_hash(args: list, kwargs: dict) -> str:
    """Cache key of a call: blake2b-128 of its JSON."""
    return hashlib.blake2b(json.dumps([args, kwargs], sort_keys=True).encode(), digest_size=16).hexdigest()


def prompt(instruction: Column, context: Column, answer: Column) -> Column:
    """Instruction prompt; the input section only where there is one."""
    has = F.coalesce(context, F.lit("")) != ""
    body = F.when(has, F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), context, F.lit("\n\n### Response:\n")))
    return F.concat(body.otherwise(F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"))), F.coalesce(answer, F.lit("")))


def question_prompt(question: Column, answer: Column) -> Column:
    """Question and answer as training text; a null is empty."""
    return F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer: "), F.coalesce(answer, F.lit("")))


def training_text(df: DataFrame, end: str) -> Column:
    """The text to train on, by the columns that a table has, with the end token behind it.

    instruction and output (and input, if there), else question and answer, else text, else the row as JSON.
    """
    has = set(df.columns)
    if {"instruction", "output"} <= has:
        body = prompt(F.col("instruction"), F.col("input") if "input" in has else F.lit(None).cast("string"), F.col("output"))
    elif {"question", "answer"} <= has:
        body = question_prompt(F.col("question"), F.col("answer"))
    elif "text" in has:
        body = F.coalesce(F.col("text"), F.lit(""))
    else:
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return F.concat(body, F.lit(end))


def word_count(c: Column) -> Column:
    """Words between white space; a null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))


def date_string(days: int = 0, base: Column | None = None) -> Column:
    """UTC date (of now, or of a timestamp) moved by days, as text."""
    return F.date_format(F.date_add((base if base is not None else F.current_timestamp()).cast("date"), days), "yyyy-MM-dd")


def format_seconds(seconds: Column, pattern: str) -> Column:
    """Epoch seconds as text; the session's time zone should be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def epoch_millis(c: Column) -> Column:
    """Milliseconds since 1970 of a zoneless timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def epoch_micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def safe_text(c: Column, complex_: bool = False) -> Column:
    """Any value as text: JSON for nested types."""
    return F.coalesce(F.to_json(c) if complex_ else c.cast("string"), F.lit(""))
