import json

import pytest
from pyspark.sql import functions as F

from faultline.functions import replies, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("name, safe", [("my app", "my_app"), ("a/b:c", "a_b_c"), ("__x__", "x"), ("é-1.2_z", "é-1.2_z"), ("a  b", "a_b"), ("///", "")])
def test_sanitize(spark, name, safe):
    assert one(spark, lambda X: text.sanitize_name(X), name) == safe


def test_paths(spark):
    c = F.lit
    assert one(spark, lambda X: text.job_log_path(c("my app"), c(12), c(7), c(3), X), "unit test") == "my_app_12/pipeline_7/job_3_unit_test.log"
    assert one(spark, lambda X: text.job_log_path(c(""), c(12), c(7), c(3), X), "a") == "project_12/pipeline_7/job_3_a.log"
    assert one(spark, lambda X: text.stage_log_path(c("j"), c(5), X), "Build it") == "jenkins-builds/j/5/stage_Build_it.log"
    assert one(spark, lambda X: text.stage_file_name(X), "Build it/Now!") == "build_it_now!"


@pytest.mark.parametrize(
    "value, masked",
    [
        ("short token=abc", "short token=abc"),
        ("call with glpat-abcdefghijklmnopqrstuv now", "call with glpat-abcd...[REDACTED***]stuv now"),
        ("a TOKEN=abcdefghijklmnop&b=1 token=zzz", "a TOKEN=abcd...[REDACTED***]mnop&b=1 TOKEN=abcd...[REDACTED***]mnop"),
        ("Authorization: Bearer abcdefgh", "Authorization: Bearer ****"),
        ("secret: $1\\2345678901234567890", "secret: $1\\2...[REDACTED***]7890"),
        ("nothing to hide in this text", "nothing to hide in this text"),
    ],
)
def test_mask_text(spark, value, masked):
    assert one(spark, lambda X: text.mask_text(X), value) == masked


def test_mask_token_and_map(spark):
    assert one(spark, lambda X: text.mask_token(X), "abcdefghijk") == "****"
    assert one(spark, lambda X: text.mask_token(X), "abcdefghijkl") == "abcd...[REDACTED***]ijkl"

    def entries(X):
        return F.create_map(F.lit("X-Auth"), X, F.lit("note"), X)

    assert one(spark, lambda X: text.mask_map(entries(X)), "abcdefghijkl") == {"X-Auth": "abcd...[REDACTED***]ijkl", "note": "abcdefghijkl"}


def test_small_rules(spark):
    assert one(spark, lambda X: text.format_duration(X.cast("double")), "59.9") == "0m 59s"
    assert one(spark, lambda X: text.normalize_url(X), "HTTPS://A/b//") == "https://a/b"
    assert one(spark, lambda X: text.error_text_norm(X), " a \n\n\tb") == "a\nb"
    assert one(spark, lambda X: text.chunks(X, 2), "abcde") == ["ab", "cd", "e"] and one(spark, lambda X: text.chunks(X), "") == []
    assert one(spark, lambda X: text.normalize_symbols(text.strip_emoji(X)), "🚀 go ✅ ok ⚠️ hm") == "go ✓ ok ! hm"
    assert one(spark, lambda X: text.email_local_part(X), "a.b@c") == "a.b" and one(spark, lambda X: text.email_local_part(X), "ab") is None
    assert one(spark, lambda X: text.flatten_metadata(X), '{"a": {"b": 1, "c": [2]}, "d": true, "a_b": "x"}') == {"a_b": "x", "a_c": "[2]", "d": "true"}


@pytest.mark.parametrize(
    "body, reply",
    [
        ({"choices": [" hi "]}, "hi"),
        ({"choices": [{"message": "m"}]}, "m"),
        ({"choices": [{"message": {"content": [{"text": "a"}, {"text": ""}, "b"]}}]}, "a\nb"),
        ({"choices": [{"message": {"content": []}, "text": "t"}]}, "t"),
        ({"choices": [{"message": {"content": {"text": "x"}}}]}, "x"),
        ({"choices": [{"message": ""}, {"output": "o"}]}, "o"),
        ({"choices": [{"message": None, "text": 5, "result": "r"}]}, "r"),
        ({"choices": [7, {"index": 0}]}, None),
        ({"choices": []}, None),
        ({"message": {"content": "c"}}, "c"),
        ([], None),
    ],
)
def test_parse_reply(spark, body, reply):
    assert one(spark, lambda X: replies.parse_llm_reply(X), json.dumps(body)) == reply


def test_parse_reply_without_json(spark):
    assert one(spark, lambda X: replies.parse_llm_reply(X), "oops") is None


@pytest.mark.parametrize(
    "raw, parsed",
    [('x {"a": 1} y', {"a": 1}), (" plain ", {"summary_text": "plain"}), ("} {", {"summary_text": "} {"}), ("{bad}", {"summary_text": "{bad}"}), ("[1]", {"summary_text": "[1]"})],
)
def test_extract_json(spark, raw, parsed):
    assert json.loads(one(spark, lambda X: replies.extract_json(X), raw)) == parsed


def test_review_scores(spark):
    got = one(spark, lambda X: replies.review_scores(X), json.dumps({"quality_score": 8, "potential_vulnerabilities": ["v", {"type": "T", "line": "l"}]}))
    assert (got.quality, got.security, got.summary) == ("8", "N/A", "(no summary)")
    assert got.findings == "• v\n• *[N/A]* T — \n   → `l`" and got.recommendations == "_No recommendations provided._"
    assert one(spark, lambda X: replies.review_scores(X), '{"summary_text": "s"}').summary.startswith("MR analysis could not be scored")
