"""Operators over log lines: `log_lines(log_id, line_no, raw)` with 0-based line numbers, and `logs(log_id, content)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .blocked import block_of, with_halo


def explode_lines(logs: DataFrame, content: str = "content") -> DataFrame:
    """One row per line; an empty or null log has none, a trailing empty line is kept."""
    keep = [c for c in logs.columns if c != content]
    return logs.filter(F.length(content) > 0).select(*keep, F.posexplode(F.split(content, "\n")).alias("line_no", "raw"))


def clean_lines(lines: DataFrame, max_length: int = fixed.MAX_LINE_LENGTH) -> DataFrame:
    """Add `clean` and its lower-case form `low`.

    The two come out of a generator, so that a filter on them is not rewritten into many copies of the cleaning rule.
    """
    clean = text.clean_line(F.col("raw"), max_length)
    once = lines.select("*", F.explode(F.array(clean)).alias("clean"))
    return once.select("*", F.explode(F.array(F.lower("clean"))).alias("low"))


def is_error(
    low: str, patterns: Sequence[str] = fixed.ERROR_PATTERNS, ignore: Sequence[str] = fixed.IGNORE_PATTERNS
) -> str:
    """SQL condition: `low`, SQL text of a lower-case line, holds a pattern and no ignore pattern."""
    return f"({text.contains_any(low, patterns)} and not {text.contains_any(low, ignore)})"


def error_lines(
    lines: DataFrame, patterns: Sequence[str] = fixed.ERROR_PATTERNS, ignore: Sequence[str] = fixed.IGNORE_PATTERNS
) -> DataFrame:
    """Cleaned lines that hold an error pattern and no ignore pattern."""
    return clean_lines(lines).filter(f"clean <> '' and {is_error('low', patterns, ignore)}").drop("low")


def matched_lines(
    lines: DataFrame, patterns: Sequence[str] = fixed.ERROR_PATTERNS, ignore: Sequence[str] = fixed.IGNORE_PATTERNS
) -> DataFrame:
    """Lines with a pattern: `pattern` is the first that matches, `ignored_by` the first ignore pattern or null."""
    return (
        clean_lines(lines)
        .withColumn("pattern", F.expr(text.first_contained("low", patterns)))
        .filter(F.col("pattern").isNotNull())
        .withColumn("ignored_by", F.expr(text.first_contained("low", ignore)))
    )


def error_pattern_counts(lines: DataFrame, **patterns) -> DataFrame:
    """Count per log and pattern; rows of kind 'ignored' count the ignore pattern that took lines out."""
    hit = matched_lines(lines, **patterns)
    kind = F.when(F.col("ignored_by").isNull(), "error").otherwise("ignored")
    return hit.groupBy("log_id", kind.alias("kind"), F.coalesce("ignored_by", "pattern").alias("pattern")).agg(
        F.count("*").alias("lines")
    )


def error_count(lines: DataFrame, **patterns) -> DataFrame:
    return (
        clean_lines(lines)
        .groupBy("log_id")
        .agg(F.expr(f"count_if(clean <> '' and {is_error('low', **patterns)})").alias("errors"))
    )


def pattern_samples(lines: DataFrame, **patterns) -> DataFrame:
    """Per log, kind and pattern: `lines` and a `sample` of 1-based line numbers, in one pass over the lines.

    The sample shows all numbers when there are five or fewer, else the first five and the last. The numbers are
    gathered per block of lines, five at most, and the first five blocks of a pattern hold its first five lines.
    """
    keys = ["log_id", "kind", "pattern"]
    hit = matched_lines(lines, **patterns).select(
        "log_id", F.when(F.col("ignored_by").isNull(), "error").otherwise("ignored").alias("kind"),
        F.coalesce("ignored_by", "pattern").alias("pattern"), (F.col("line_no") + 1).alias("n"),
    )
    per_block = hit.groupBy(*keys, block_of(F.col("n")).alias("_blk")).agg(
        F.count("*").alias("_lines"), F.max("n").alias("_last"), F.slice(F.array_sort(F.collect_list("n")), 1, 5).alias("_first")
    )
    order = Window.partitionBy(*keys).orderBy("_blk")
    early = F.when(F.col("_r") <= 5, F.col("_first"))
    total = per_block.withColumn("_r", F.row_number().over(order)).groupBy(*keys).agg(
        F.sum("_lines").alias("lines"), F.max("_last").alias("_last"),
        F.slice(F.array_sort(F.flatten(F.collect_list(early))), 1, 5).alias("_first"),
    )
    tail = F.when(F.col("lines") > 5, F.concat(F.lit(" ... "), F.col("_last").cast("string"))).otherwise("")
    shown = F.array_join(F.col("_first").cast("array<string>"), ",")
    return total.select(
        *keys, "lines", F.concat(shown, tail, F.lit(" ("), F.col("lines").cast("string"), F.lit(" total)")).alias("sample")
    )


def error_line_samples(lines: DataFrame, **patterns) -> DataFrame:
    """Per log and pattern the line numbers of its errors, shortened when there are more than five."""
    return pattern_samples(lines, **patterns).filter(F.col("kind") == "error").drop("kind")


def log_sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("log_id").agg((F.max("line_no") + 1).alias("total_lines"))


def grep_context(lines: DataFrame, hit: Column, around: int = 5, block: int = 4096) -> DataFrame:
    """Lines within `around` lines of a line for which `hit` holds."""
    cut = with_halo(lines.withColumn("_hit", hit), "line_no", around, block)
    near = Window.partitionBy("log_id", "_blk").orderBy("line_no").rangeBetween(-around, around)
    return (
        cut.withColumn("_near", F.max("_hit").over(near)).filter(F.col("_core") & F.col("_near"))
        .withColumnRenamed("_hit", "is_hit").drop("_blk", "_core", "_near")
    )


# ---- whole-log text: one row per log, no shuffle ----

def tail_lines(content: Column, n: int = fixed.TAIL_LINES) -> Column:
    """The last n lines; a shorter log unchanged."""
    parts = F.split(content, "\n")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), "\n")).otherwise(content)


def tail_bytes(content: Column, n: int = fixed.TAIL_LINES, bytes_per_line: int = fixed.BYTES_PER_LINE) -> Column:
    """The last n * bytes_per_line bytes; the first line of the result may be cut."""
    raw = F.encode(content, "UTF-8")
    size = n * bytes_per_line
    return F.when(F.octet_length(content) > size, F.substring(raw, -size, size)).otherwise(raw)


def head_cap(logs: DataFrame, n: int = fixed.HEAD_LINES, content: str = "content") -> DataFrame:
    """The first n lines, a `truncated` flag (also set when the log has exactly n lines) and the line count kept."""
    parts = F.split(F.col(content), "\n")
    size = F.size(parts)
    return logs.withColumn(
        content, F.when(size > n, F.array_join(F.slice(parts, 1, n), "\n")).otherwise(F.col(content))
    ).withColumn("truncated", size >= n).withColumn("total_lines", F.least(size, F.lit(n)))


def hybrid_log(
    logs: DataFrame, tail: int = fixed.TAIL_LINES, head: int = fixed.HEAD_LINES, content: str = "content",
    patterns: Sequence[str] = fixed.ERROR_PATTERNS, ignore: Sequence[str] = fixed.IGNORE_PATTERNS,
) -> DataFrame:
    """The tail when one of its uncleaned lines is an error line, else the capped head; `method` tells which."""
    parts = F.split(F.col(content), "\n")
    last = F.when(F.size(parts) > tail, F.slice(parts, -tail, tail)).otherwise(parts)
    size = F.size(parts)
    use_tail = F.expr(f"exists(_last, x -> {is_error('lower(x)', patterns, ignore)})")
    return (
        logs.withColumn("_last", last)
        .withColumn("method", F.when(use_tail, "tail").otherwise("streaming"))
        .withColumn("truncated", (F.col("method") == "streaming") & (size >= head))
        .withColumn(
            "total_lines", F.when(F.col("method") == "tail", F.size("_last")).otherwise(F.least(size, F.lit(head)))
        )
        .withColumn(
            content,
            F.when(F.col("method") == "tail", F.array_join("_last", "\n"))
            .when(size > head, F.array_join(F.slice(parts, 1, head), "\n"))
            .otherwise(F.col(content)),
        )
        .drop("_last")
    )
