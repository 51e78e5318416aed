"""Expressions that build and parse request and result messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeloom import fixed_values as fv
from gradeloom.functions.text import stripped


def lettered_question(question: Column, choices: Column, letters: list[str] = fv.CHOICE_LETTERS) -> Column:
    """Question followed by its lettered choices; unchanged when it has none.

    Choices beyond the available letters are left out.
    """
    names = F.array(*[F.lit(x) for x in letters])
    lines = F.transform(
        F.slice(choices, 1, len(letters)),
        lambda choice, i: F.concat(F.get(names, i), F.lit(") "), choice),
    )
    return F.when(F.coalesce(F.size(choices), F.lit(0)) <= 0, question).otherwise(
        stripped(F.concat(question, F.lit("\n\n"), F.array_join(lines, "\n")))
    )


def user_prompt(system_prompt: Column, question: Column) -> Column:
    return F.concat(system_prompt, F.lit("\n\nQuestion: "), question)


def custom_id(question_id: Column, strategy: Column) -> Column:
    return F.concat(F.lit("q"), question_id.cast("string"), F.lit("_"), strategy)


def custom_id_question(identifier: Column) -> Column:
    """Question number of a custom id: digits before the first underscore."""
    digits = F.regexp_extract(identifier, r"^q(\d+)(?:_|$)", 1)
    return F.when(digits != "", digits.cast("long"))


def custom_id_strategy(identifier: Column) -> Column:
    """Everything after the first underscore (strategy names contain underscores)."""
    return F.nullif(F.regexp_extract(identifier, r"^q\d+_(.*)$", 1), F.lit(""))


def provider_label(provider: Column, model: Column) -> Column:
    """Display name of a provider and the model it serves."""
    low = F.lower(model)
    family = F.when(F.contains(low, F.lit("haiku")), "Haiku").when(F.contains(low, F.lit("sonnet")), "Sonnet").otherwise("Claude")
    cleaned = F.replace(F.replace(model, F.lit("gpt-"), F.lit("GPT-")), F.lit("-"), F.lit(""))
    return (
        F.when(provider == "openai", F.concat(F.lit(fv.PROVIDER_LABEL_PREFIX["openai"]), cleaned))
        .when(provider == "claude", F.concat(F.lit(fv.PROVIDER_LABEL_PREFIX["claude"]), family))
        .when(provider == "gemini", F.concat(F.lit(fv.PROVIDER_LABEL_PREFIX["gemini"]), model))
        .otherwise(F.concat(provider, F.lit("-"), model))
    )
