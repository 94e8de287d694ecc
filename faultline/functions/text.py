"""Text rules as column expressions. Every function takes and returns a Column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# ---- fixed values: the characters that count as white space ----
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Drop white space at both ends (Spark's trim alone keeps tabs)."""
    return F.btrim(text, F.lit(_SPACES))


def not_blank(text: Column) -> Column:
    """The text, or null when it is null or only white space."""
    return F.when(F.length(strip(text)) > 0, text)


def filled(text: Column) -> Column:
    """The text, or null when it is the empty string."""
    return F.nullif(text, F.lit(""))


def clean_line(raw: Column, max_length: int = fixed.MAX_LINE_LENGTH) -> Column:
    """Readable ASCII form of one log line: no colour codes, no leading time stamp, single spaces.

    Every step uses the former one once, so the expression stays a chain; a run of blanks and of characters outside
    ASCII becomes one blank in a single step, and a lone blank costs nothing.
    """
    stamp = r"(?:\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[.,]\d+\s*)?(?:\[\d{2}:\d{2}:\d{2}\])?"
    text = strip(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")
    text = F.regexp_replace(text, f"(?U)^{stamp}", "")
    text = F.regexp_replace(text, r"[^\x21-\x7e\t\n]{2,}|[^\x20-\x7e\t\n]", " ")
    text = F.btrim(text, F.lit(" \t\n"))
    return F.regexp_replace(text, f"(?s)^(.{{{max_length}}}).+", "$1...")


def quoted(value: str) -> str:
    """SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(low: str, needles: Sequence[str]) -> str:
    """SQL condition: `low`, SQL text of a lower-case string, holds one of the literals, which may be in any case."""
    return "(" + (" or ".join(f"contains({low}, {quoted(n.lower())})" for n in needles) or "false") + ")"


def first_contained(low: str, needles: Sequence[str]) -> str:
    """SQL value: the first literal of the list that `low` holds, or null."""
    return "case " + " ".join(f"when contains({low}, {quoted(n.lower())}) then {quoted(n)}" for n in needles) + " end"


def sanitize_name(name: Column) -> Column:
    """A name that is safe as a file name: letters, digits, '-', '_' and '.'."""
    safe = F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")
    return F.btrim(F.regexp_replace(safe, "_+", "_"), F.lit("_"))


def stage_file_name(stage: Column) -> Column:
    """The weaker rule used for stage files."""
    return F.translate(F.lower(stage), " /", "__")


def project_dir(project_name: Column, project_id: Column) -> Column:
    return F.when(
        F.length(project_name) > 0, F.concat(sanitize_name(project_name), F.lit("_"), project_id.cast("string"))
    ).otherwise(F.concat(F.lit("project_"), project_id.cast("string")))


def job_log_path(project_name: Column, project_id: Column, pipeline_id: Column, job_id: Column, job: Column) -> Column:
    return F.concat(
        project_dir(project_name, project_id), F.lit("/pipeline_"), pipeline_id.cast("string"),
        F.lit("/job_"), job_id.cast("string"), F.lit("_"), sanitize_name(job), F.lit(".log"),
    )


def stage_log_path(job: Column, build: Column, stage: Column) -> Column:
    return F.concat(
        F.lit("jenkins-builds/"), sanitize_name(job), F.lit("/"), build.cast("string"),
        F.lit("/stage_"), sanitize_name(stage), F.lit(".log"),
    )


def repo_short_name(project: Column) -> Column:
    return F.element_at(F.split(F.coalesce(project, F.lit("unknown")), "/"), -1)


def short_sha(sha: Column) -> Column:
    return F.coalesce(filled(F.left(sha, F.lit(7))), F.lit("unknown"))


def format_duration(seconds: Column) -> Column:
    """'3m 45s', or 'N/A' for null and zero."""
    whole = F.floor(seconds)
    return F.when(
        F.coalesce(seconds, F.lit(0.0)) != 0,
        F.concat(
            F.floor(seconds / 60).cast("string"), F.lit("m "), (whole - F.floor(seconds / 60) * 60).cast("string"),
            F.lit("s"),
        ),
    ).otherwise("N/A")


def normalize_url(url: Column) -> Column:
    return F.lower(F.rtrim(url, F.lit("/")))


def email_local_part(email: Column) -> Column:
    return F.when(email.contains("@"), F.split_part(email, F.lit("@"), F.lit(1)))


def mask_token(token: Column) -> Column:
    return F.when(F.coalesce(F.length(token), F.lit(0)) < 12, "****").otherwise(
        F.concat(F.left(token, F.lit(4)), F.lit(fixed.REDACTED), F.right(token, F.lit(4)))
    )


def mask_text(
    text: Column, patterns: Sequence[str] = fixed.SECRET_PATTERNS, marks: Sequence[str] | None = None, longer_than: int = 20
) -> Column:
    """Mask secrets: the first pattern that matches decides, and all its hits get the first hit's mask.

    `marks` names, per pattern, a lower-case text without which it cannot match; a plain look for it spares most texts
    the regular expressions.
    """
    if marks is None:
        marks = fixed.SECRET_MARKS if patterns is fixed.SECRET_PATTERNS else [""] * len(patterns)

    def masked(low: Column) -> Column:
        out = text
        for pattern, mark in reversed(list(zip(patterns, marks))):
            mask = F.concat(F.regexp_extract(text, pattern, 1), mask_token(F.regexp_extract(text, pattern, 2)))
            literal = F.regexp_replace(mask, r"([\\$])", r"\\$1")
            out = F.when(low.contains(mark) & text.rlike(pattern), F.regexp_replace(text, F.lit(pattern), literal)).otherwise(out)
        return out

    # The lower-case text is made once, as the only element of an array.
    return F.when(F.length(text) > longer_than, F.transform(F.array(F.lower(text)), masked)[0]).otherwise(text)


def mask_map(entries: Column, keys: Sequence[str] = fixed.SECRET_KEYS) -> Column:
    """Mask map values whose key names a secret wholly, the others by pattern."""
    def secret(key: Column) -> Column:
        return F.exists(F.lit(list(keys)), lambda s: F.lower(key).contains(s))

    return F.transform_values(entries, lambda k, v: F.when(secret(k), mask_token(v)).otherwise(mask_text(v)))


def error_text_norm(text: Column) -> Column:
    """Strip each line, drop blank ones."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def error_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fix_id(text: Column) -> Column:
    return F.concat(F.lit("fix-"), F.sha1(text))


def chunks(text: Column, size: int = fixed.CHUNK_CHARS) -> Column:
    """Array of fixed-size pieces; empty for null and empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def strip_emoji(text: Column) -> Column:
    out = text
    for symbol in fixed.REMOVED_SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(""))
    return out


def normalize_symbols(text: Column) -> Column:
    out = text
    for old, new in fixed.REPLACED_SYMBOLS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def parse_moment(text: Column) -> Column:
    """Time stamp in UTC, written with 'T' or a blank and with 'Z', 'UTC', an offset or none of them; null when unreadable."""
    offset = r"(:\d\d(?:\.\d+)?) ?([+-])(\d\d):?(\d\d)$"
    hours, minutes = F.regexp_extract(text, offset, 3).try_cast("int"), F.regexp_extract(text, offset, 4).try_cast("int")
    ahead = F.when(F.regexp_extract(text, offset, 2) == "-", -1).otherwise(1) * (60 * hours + minutes)
    local = F.regexp_replace(F.regexp_replace(text, r"( UTC|Z)$", ""), offset, "$1").try_cast("timestamp_ntz")
    return local - F.make_dt_interval(mins=F.coalesce(ahead, F.lit(0)))


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone, whatever the session's zone is."""
    day = F.unix_date(F.to_date(moment)).cast("bigint") * 86_400_000_000
    clock = (F.hour(moment) * 60 + F.minute(moment)).cast("bigint") * 60_000_000
    return day + clock + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("bigint")


def later_wins(pairs: Column) -> Column:
    """Map from an array of (key, value) structs; a later entry replaces an earlier one with the same key."""
    kept = F.filter(
        pairs,
        lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]),
    )
    return F.map_from_entries(kept)


def flatten_metadata(json_text: Column) -> Column:
    """One level of nesting becomes 'key_sub'; arrays and deeper objects become text; scalars stay as text."""
    top = F.from_json(json_text, "map<string,string>")

    def spread(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        inner = F.map_entries(F.from_json(value, "map<string,string>"))
        return F.when(
            value.startswith("{"),
            F.transform(inner, lambda e: F.struct(F.concat(key, F.lit("_"), e["key"]).alias("key"), e["value"].alias("value"))),
        ).otherwise(F.array(F.struct(key.alias("key"), value.alias("value"))))

    return later_wins(F.flatten(F.transform(F.map_entries(top), spread)))


def any_literal(text: str) -> str:
    """Regular expression that matches the text literally in both engines."""
    return re.escape(text)
