"""Prompts as columns; templates are the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import answers as A


def build_prompts(rows: DataFrame, system: str, template: str, columns: tuple[str, ...]) -> DataFrame:
    """Add system_prompt, user_prompt and chat to rows; ``columns`` name the template's places and what fills them."""
    user = A.fill(template, **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
    return rows.withColumn("system_prompt", F.lit(system)).withColumn("user_prompt", user).withColumn("chat", A.chat_format(F.lit(system), user))


def build_regeneration_prompts(answers: DataFrame, template: str) -> DataFrame:
    """user_prompt for answers (code, valid, errors) that don't parse, from their code and errors."""
    rows = answers.where("not valid").withColumn("previous_code", F.col("code")).withColumn("errors_text", A.format_errors(F.col("errors")))
    user = A.fill(template, previous_code=F.col("previous_code"), errors=F.col("errors_text"))
    return rows.withColumn("user_prompt", user).drop("previous_code", "errors_text")
