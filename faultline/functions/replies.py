"""Text and scores out of model replies, as column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _get(value: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def _as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _block_text(block: Column) -> Column:
    own = F.when(_kind(_get(block, "$.text")) == "STRING", _get(block, "$.text", "string"))
    return F.when(_kind(block) == "STRING", _as_text(block)).when(_kind(block).startswith("OBJECT"), text.filled(own))


def choice_text(choice: Column) -> Column:
    """Text of one reply choice: a string, a message, message content (text, blocks, object) or a plain field."""
    message = _get(choice, "$.message")
    content = _get(choice, "$.message.content")
    inner = _get(choice, "$.message.content.text")
    blocks = F.array_compact(F.transform(F.try_variant_get(content, "$", "array<variant>"), _block_text))
    out = F.lit(None).cast("string")
    for field in ("output", "result", "text"):
        value = _get(choice, f"$.{field}")
        out = F.when(_kind(value) == "STRING", _as_text(value)).otherwise(out)
    found = (
        F.when(_kind(choice) == "STRING", _as_text(choice))
        .when(_kind(message) == "STRING", _as_text(message))
        .when(_kind(content) == "STRING", _as_text(content))
        .when(_kind(content).startswith("ARRAY") & (F.size(blocks) > 0), F.array_join(blocks, "\n"))
        .when(_kind(inner) == "STRING", _as_text(inner))
        .otherwise(out)
    )
    return text.filled(text.strip(found))


def parse_llm_reply(body: Column) -> Column:
    """Text of a reply: the first usable choice, or the message when there are no choices."""
    reply = F.try_parse_json(body)
    choices = F.try_variant_get(reply, "$.choices", "array<variant>")
    texts = F.array_compact(F.transform(choices, choice_text))
    has_choices = _kind(_get(reply, "$.choices")).startswith("ARRAY")
    first = F.when(F.size(texts) > 0, texts[0])
    return F.when(has_choices, first).when(_kind(_get(reply, "$.message")) != "VOID", choice_text(reply))


def extract_json(reply: Column) -> Column:
    """JSON object between the first '{' and the last '}' as text; other text becomes {"summary_text": ...}."""
    cut = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    is_object = _kind(F.try_parse_json(cut)).startswith("OBJECT")
    return F.when(is_object, cut).otherwise(F.to_json(F.struct(text.strip(reply).alias("summary_text"))))


def _finding(item: Column) -> Column:
    def field(name: str, default: str) -> Column:
        return F.coalesce(_get(item, f"$.{name}", "string"), F.lit(default))

    line = _get(item, "$.line", "string")
    detail = F.concat(
        F.lit("• *["), field("severity", "N/A"), F.lit("]* "), field("type", "Unknown"), F.lit(" — "),
        text.strip(field("description", "")),
        F.when(F.length(line) > 0, F.concat(F.lit("\n   → `"), line, F.lit("`"))).otherwise(""),
    )
    return F.when(_kind(item).startswith("OBJECT"), detail).otherwise(F.concat(F.lit("• "), _as_text(item)))


def review_scores(json_text: Column) -> Column:
    """Struct of scores, summary, findings and recommendations; without any score the fixed summary stands in."""
    v = F.try_parse_json(json_text)
    keys = ("quality_score", "security_score", "maintainability_score")
    scored = F.lit(False)
    for k in keys:
        scored = scored | F.coalesce(F.get_json_object(json_text, f"$.{k}").isNotNull(), F.lit(False))

    def score(key: str) -> Column:
        return F.when(scored, F.coalesce(_get(v, f"$.{key}", "string"), F.lit("N/A"))).otherwise("N/A")

    def listed(key: str, item, empty: str) -> Column:
        items = F.transform(F.try_variant_get(v, f"$.{key}", "array<variant>"), item)
        return F.when(scored & (F.size(items) > 0), F.array_join(items, "\n")).otherwise(empty)

    summary = F.coalesce(_get(v, "$.overall_summary", "string"), _get(v, "$.summary_text", "string"), F.lit("(no summary)"))
    return F.struct(
        score("quality_score").alias("quality"), score("security_score").alias("security"),
        score("maintainability_score").alias("maintainability"),
        F.when(scored, summary).otherwise(fixed.UNSCORED_TEXT).alias("summary"),
        listed("potential_vulnerabilities", _finding, fixed.NO_FINDINGS_TEXT).alias("findings"),
        listed("recommended_improvements", lambda i: F.concat(F.lit("• "), _as_text(i)), fixed.NO_ADVICE_TEXT).alias("recommendations"),
    )
