"""Tables before and after the explanation model; the model call is not part of this."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config


def build_prompts(df: DataFrame, fields: Sequence[str] = tuple(config.EXPLANATION_FIELDS)) -> DataFrame:
    """One JSON payload per evidence row: the row, its flags and the wording guidance.

    Needs the explanation fields and `validator_flags`; a missing field is an error.
    An unknown status stops the job.
    """
    missing = [f for f in [*fields, "validator_flags"] if f not in df.columns]
    if missing:
        raise ValueError("missing fields: " + ", ".join(missing))
    status = F.col("evidence_status")
    guidance = F.raise_error(
        F.concat(F.lit("unsupported evidence_status: "), F.coalesce(status, F.lit("NULL")))
    ).cast("string")
    for name, text in config.STATUS_GUIDANCE.items():
        guidance = F.when(status == name, text).otherwise(guidance)
    payload = F.struct(
        F.struct(*fields).alias("capability_evidence"),
        F.col("validator_flags"),
        guidance.alias("confidence_instruction"),
    )
    return df.select(
        "unique_id",
        "capability",
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
    )


def extract_completion(df: DataFrame, col: str) -> DataFrame:
    """Adds `completion` and `completion_error` from a chat response in JSON text.

    The first choice's content is text or a list of parts; text parts are joined.
    """
    choices = F.from_json(F.col(col), "choices array<struct<message: struct<content: string>>>")["choices"]
    content = F.try_element_at(choices, F.lit(1))["message"]["content"]
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    is_list = F.get_json_object(F.col(col), "$.choices[0].message.content[0]").isNotNull() & (
        F.substring(content, 1, 1) == "["
    )
    empty_list = content == "[]"
    joined = F.array_join(
        F.transform(
            F.filter(parts, lambda p: p["type"].isin("text", "output_text")),
            lambda p: F.coalesce(p["text"], F.lit("")),
        ),
        "",
    )
    text = F.when(is_list & parts.isNotNull(), joined).when(empty_list, "").otherwise(content)
    return df.withColumns(
        {
            "completion": F.trim(text),
            "completion_error": F.when(
                F.coalesce(F.size(choices), F.lit(0)) == 0, "no choices"
            ).when(content.isNull(), "no text"),
        }
    )


def lint_explanations(
    df: DataFrame,
    text: str = "explanation",
    required: Mapping[str, Sequence[str]] = config.REQUIRED_PHRASES,
    forbidden: Mapping[str, Sequence[str]] = config.FORBIDDEN_PHRASES,
) -> DataFrame:
    """Adds `violations`: which output rules an explanation breaks, in a fixed order.

    It must end with the confirm message, have two or three sentences, state its
    confidence in the words of its status and avoid that status's forbidden phrases.
    """
    lowered = F.lower(F.col(text))
    status = F.col("evidence_status")

    def contains_any(phrases: Sequence[str]) -> Column:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | lowered.contains(phrase)
        return hit

    unstated, overconfident = F.lit(False), F.lit(False)
    for name, phrases in required.items():
        unstated = F.when(status == name, ~contains_any(phrases)).otherwise(unstated)
    for name, phrases in forbidden.items():
        overconfident = F.when(status == name, contains_any(phrases)).otherwise(overconfident)
    sentences = F.regexp_count(F.col(text), F.lit(config.SENTENCE_END))
    checks = {
        "confirm_message": ~F.endswith(F.col(text), F.col("confirm_message")),
        "sentence_count": ~sentences.isin(2, 3),
        "confidence_language": unstated,
        "overconfident_language": overconfident,
    }
    found = F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])
    return df.withColumns(
        {"sentences": sentences, "violations": F.filter(found, lambda v: v.isNotNull())}
    )
