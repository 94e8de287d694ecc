"""Error sections: which error lines to show, with how much context, and the text of it.

The rule is sequential: from the last line upwards, take an error line with its context, then go on above the
context. Two forms, both exact and both without a task that holds a whole log:

* with context buckets the number of picks is capped, so only a bounded number of the last error lines of a log
  can matter; those are gathered and folded;
* with a fixed context there is no cap. A log is cut into blocks; for each block the fold is a small table "where
  the context above reaches into this block -> where it reaches into the next". Tables are combined per group of
  blocks, then per log, and the true entry point of each block is handed back down.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .blocked import block_of, carry_forward, last_rows, number_rows, spans_to_blocks
from .lines import clean_lines, error_lines, is_error, log_sizes, pattern_samples
from .shared import settle

Buckets = Sequence[tuple[int, int, int]]


@dataclass(frozen=True)
class ContextPlan:
    """`buckets` of (errors, before, after), or None for a fixed, uncapped context."""

    before: int = fixed.LINES_BEFORE
    after: int = fixed.LINES_AFTER
    buckets: Buckets | None = None

    @property
    def cap(self) -> int | None:
        return sum(b[0] for b in self.buckets) if self.buckets else None

    @property
    def reach(self) -> int:
        """How many of the last error lines can matter when the number of picks is capped."""
        return sum(count * (before + 1) for count, before, _ in self.buckets or ())

    @property
    def section_lines(self) -> int:
        sizes = [(b[1], b[2]) for b in self.buckets] if self.buckets else [(self.before, self.after)]
        return max(b + a + 1 for b, a in sizes)


def context_plan(
    before: int = fixed.LINES_BEFORE, after: int = fixed.LINES_AFTER, adaptive: bool = True,
    buckets: Buckets = fixed.CONTEXT_BUCKETS, mode: str = "auto",
) -> ContextPlan:
    """`auto` uses buckets only with the default context sizes; 'buckets' and 'fixed' force one form."""
    default_sizes = (before, after) == (fixed.LINES_BEFORE, fixed.LINES_AFTER)
    use = mode == "buckets" or (mode == "auto" and adaptive and bool(buckets) and default_sizes)
    return ContextPlan(before, after, tuple(buckets) if use else None)


def parse_buckets(text: str) -> Buckets:
    """'100:10:5,50:50:10' -> ((50, 50, 10), (100, 10, 5)): by size. Sizes are positive and differ, contexts are not negative; an
    empty text gives the default."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        numbers = part.split(":")
        if len(numbers) != 3 or not all(n.strip().lstrip("+-").isdigit() for n in numbers):
            raise ValueError(f"a bucket is errors:before:after, not {part!r}")
        errors, before, after = map(int, numbers)
        if errors <= 0 or before < 0 or after < 0:
            raise ValueError(f"bucket {part!r}: errors must be positive, contexts not negative")
        out.append((errors, before, after))
    if len({b[0] for b in out}) < len(out):
        raise ValueError("two buckets have the same size")
    return tuple(sorted(out)) or fixed.CONTEXT_BUCKETS


def adaptive_context(counts: DataFrame, buckets: Buckets = fixed.CONTEXT_BUCKETS) -> DataFrame:
    """Context by total error count: the first bucket whose size is not exceeded, else the last."""

    def pick(i: int):
        out = F.lit(buckets[-1][i])
        for b in reversed(buckets):
            out = F.when(F.col("errors") <= b[0], b[i]).otherwise(out)
        return out

    return counts.withColumn("lines_before", pick(1)).withColumn("lines_after", pick(2))


def _bucket_value(n: str, buckets: Buckets, index: int) -> str:
    """SQL text: the context size of the n-th pick (0-based)."""
    out, total = "", 0
    for bucket in buckets:
        total += bucket[0]
        out += f" when {n} < {total} then {bucket[index]}"
    return f"case{out} else {buckets[-1][index]} end"


def _fold(plan: ContextPlan) -> str:
    """SQL text: the picks, last line first, out of `_errs`, the error lines of one log in falling order."""
    before = _bucket_value("size(s.p)", plan.buckets, 1) if plan.buckets else str(plan.before)
    room = f"size(s.p) < {plan.cap}" if plan.buckets else "true"
    return f"""aggregate(_errs,
        named_struct('lim', cast(9223372036854775807 as bigint), 'p', cast(array() as array<bigint>)),
        (s, x) -> if(x <= s.lim and {room},
                     named_struct('lim', greatest(cast(0 as bigint), x - ({before})) - 1, 'p', concat(s.p, array(x))),
                     s),
        s -> s.p)"""


def _capped_picks(errors: DataFrame, plan: ContextPlan) -> DataFrame:
    reachable = last_rows(errors.select("log_id", "line_no"), ["log_id"], "line_no", plan.reach)
    gathered = reachable.groupBy("log_id").agg(F.sort_array(F.collect_list("line_no"), asc=False).alias("_errs"))
    picks = gathered.select("log_id", F.expr(_fold(plan)).alias("_p")).select(
        "log_id", F.size("_p").alias("_total"), F.posexplode("_p").alias("_n", "error_line")
    )
    return picks.select(
        "log_id",
        (F.col("_total") - F.col("_n") - 1).cast("bigint").alias("section_no"),
        "error_line",
        F.expr(_bucket_value("_n", plan.buckets, 1)).alias("before"),
        F.expr(_bucket_value("_n", plan.buckets, 2)).alias("after"),
    )


def _uncapped_picks(errors: DataFrame, plan: ContextPlan, group: int = 1024) -> DataFrame:
    b = plan.before
    size = max(1024, 2 * (b + 1))
    step = f"(lim, x) -> if(x <= lim, greatest(cast(0 as bigint), x - {b}) - 1, lim)"
    low, high = f"(_blk * {size})", f"((_blk + 1) * {size} - 1)"
    reach_below = f"lim -> greatest(cast(0 as bigint), {low} - 1 - lim)"
    # A block passes its entry point on only when it is dense: errors at both ends and no gap wider than `before`.
    passes = f"""_errs[0] > {high} - {b} and _errs[size(_errs) - 1] < {low} + {b}
        and not exists(sequence(1, greatest(size(_errs) - 1, 1)),
                       i -> size(_errs) > 1 and _errs[i - 1] - _errs[i] > {b})"""
    table = f"""if({passes},
        transform(sequence(cast(0 as bigint), cast({b} as bigint)), o -> aggregate(_errs, {high} - o, {step}, {reach_below})),
        array(aggregate(_errs, {high}, {step}, {reach_below})))"""
    blocks = (
        errors.select("log_id", F.col("line_no").cast("bigint").alias("line_no"))
        .groupBy("log_id", block_of(F.col("line_no"), size).alias("_blk"))
        .agg(F.sort_array(F.collect_list("line_no"), asc=False).alias("_errs"))
        .withColumn("_out", F.expr(table))
    )
    supers = blocks.groupBy("log_id", block_of(F.col("_blk"), group).alias("_sup")).agg(
        F.sort_array(F.collect_list(F.struct("_blk", "_out", "_errs")), asc=False).alias("_bs")
    )
    # Entry of each block, top down; a missing block above resets the entry to 0.
    enter = "if(x._blk = s.next, s.o, cast(0 as bigint))"
    leave = f"x._out[if(size(x._out) = 1, 0, cast({enter} as int))]"
    walk = f"(s, x) -> named_struct('next', x._blk - 1, 'o', {leave})"
    start = f"named_struct('next', (_sup + 1) * {group} - 1, 'o', o)"
    result = f"s -> if(s.next = _sup * {group} - 1, s.o, cast(0 as bigint))"
    passes_all = f"size(_bs) = {group} and not exists(_bs, x -> size(x._out) = 1)"
    super_table = f"""if({passes_all},
        transform(sequence(cast(0 as bigint), cast({b} as bigint)), o -> aggregate(_bs, {start}, {walk}, {result})),
        array(aggregate(_bs, {start.replace("'o', o", "'o', cast(0 as bigint)")}, {walk}, {result})))"""
    supers = supers.withColumn("_sout", F.expr(super_table))
    chain = """aggregate(_ss,
        named_struct('next', cast(-1 as bigint), 'o', cast(0 as bigint),
                     'e', cast(array() as array<struct<_sup: bigint, _entry: bigint>>)),
        (s, x) -> named_struct(
            'next', x._sup - 1,
            'o', x._sout[if(size(x._sout) = 1, 0, cast(if(x._sup = s.next, s.o, 0) as int))],
            'e', concat(s.e, array(named_struct('_sup', x._sup, '_entry', if(x._sup = s.next, s.o, cast(0 as bigint)))))),
        s -> s.e)"""
    entries = (
        supers.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("_sup", "_sout")), asc=False).alias("_ss"))
        .select("log_id", F.explode(F.expr(chain)).alias("_e")).select("log_id", "_e.*")
    )
    block_entries = f"""aggregate(_bs,
        named_struct('next', (_sup + 1) * {group} - 1, 'o', _entry,
                     'e', cast(array() as array<bigint>)),
        (s, x) -> named_struct('next', x._blk - 1, 'o', {leave}, 'e', concat(s.e, array({enter}))),
        s -> s.e)"""
    picks = f"""aggregate(_b._errs,
        named_struct('lim', (_b._blk + 1) * {size} - 1 - _o, 'p', cast(array() as array<bigint>)),
        (s, x) -> if(x <= s.lim,
                     named_struct('lim', greatest(cast(0 as bigint), x - {b}) - 1, 'p', concat(s.p, array(x))), s),
        s -> s.p)"""
    taken = (
        supers.select("log_id", "_sup", "_bs").join(entries, ["log_id", "_sup"])
        .withColumn("_es", F.expr(block_entries))
        .select("log_id", F.explode(F.arrays_zip("_bs", "_es")).alias("_z"))
        .select("log_id", F.col("_z._bs").alias("_b"), F.col("_z._es").alias("_o"))
        .select("log_id", F.explode(F.expr(picks)).alias("error_line"))
    )
    numbered = number_rows(taken, ["log_id"], ["error_line"], block_of(F.col("error_line"), size), "section_no")
    return numbered.select(
        "log_id", "section_no", "error_line", F.lit(b).alias("before"), F.lit(plan.after).alias("after")
    )


def pick_errors(errors: DataFrame, plan: ContextPlan) -> DataFrame:
    """`errors(log_id, line_no)` -> picks(log_id, section_no, error_line, before, after), sections in file order."""
    return _capped_picks(errors, plan) if plan.buckets else _uncapped_picks(errors, plan)


def bottom_up_sections(
    lines: DataFrame, plan: ContextPlan | None = None, errors: DataFrame | None = None, **patterns
) -> DataFrame:
    """Sections of each log: (log_id, section_no, error_line, start_line, end_line), end exclusive.

    `errors` may pass the error lines when they have been found already.
    """
    plan = plan or context_plan()
    picks = pick_errors(error_lines(lines, **patterns) if errors is None else errors, plan)
    return picks.join(log_sizes(lines), "log_id").select(
        "log_id", "section_no", "error_line",
        F.greatest(F.col("error_line") - F.col("before"), F.lit(0)).alias("start_line"),
        F.least(F.col("error_line") + F.col("after") + 1, F.col("total_lines")).alias("end_line"),
    )


def section_lines(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """The non-empty cleaned lines of each section, as 'Line N: text' with 1-based N."""
    spans = spans_to_blocks(
        sections.select("log_id", "section_no", "start_line", (F.col("end_line") - 1).alias("_last")), "start_line", "_last"
    )
    # Stored, so that few spans are known to be few and the raw lines are not shuffled for them.
    spans = settle(spans, "spans")
    # Only the lines inside a section are cleaned here.
    inside = (
        lines.select("log_id", "line_no", "raw", block_of(F.col("line_no")).alias("_blk")).join(spans, ["log_id", "_blk"])
        .filter(F.col("line_no").between(F.col("start_line"), F.col("_last")))
    )
    return clean_lines(inside).filter(F.col("clean") != "").select(
        "log_id", "section_no", "line_no",
        F.concat(F.lit("Line "), (F.col("line_no") + 1).cast("string"), F.lit(": "), F.col("clean")).alias("text"),
    )


def section_texts(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per section; a section is never longer than its context."""
    return section_lines(lines, sections).groupBy("log_id", "section_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text")
    )


def format_sections(
    lines: DataFrame, plan: ContextPlan | None = None, errors: DataFrame | None = None, **patterns
) -> DataFrame:
    """One text per log with a separator between sections. Needs a capped plan, so that the text is bounded."""
    plan = plan or context_plan()
    if plan.cap is None:
        raise ValueError("format_sections needs context buckets; use section_texts for an uncapped context")
    texts = section_texts(lines, bottom_up_sections(lines, plan, errors, **patterns))
    ordered = F.array_sort(F.collect_list(F.struct("section_no", "text")))
    return texts.groupBy("log_id").agg(
        F.count("*").alias("sections"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), f"\n\n{fixed.SECTION_SEPARATOR}\n\n").alias("text"),
    )


def extract_error_sections(
    logs: DataFrame, plan: ContextPlan | None = None, content: str = "content",
    patterns: Sequence[str] = fixed.ERROR_PATTERNS, ignore: Sequence[str] = fixed.IGNORE_PATTERNS,
) -> DataFrame:
    """Whole-log form: add `total_errors`, `sections` and `text` (null without errors) to rows that hold a log each.

    Everything happens inside the row, so job logs that were read as a tail need no shuffle at all. For logs too long
    for one row use the line table and `format_sections`.
    """
    plan = plan or context_plan()

    def let(df: DataFrame, **values) -> DataFrame:
        """Columns that later steps use many times; a generator keeps them from being copied into each use."""
        for name, value in values.items():
            df = df.select("*", F.explode(F.array(value)).alias(name))
        return df

    before, after = [_bucket_value("n", plan.buckets, i) if plan.buckets else str(v) for i, v in ((1, plan.before), (2, plan.after))]
    hits = f"filter(transform(_low, (x, i) -> if({is_error('x', patterns, ignore)}, cast(i as bigint), null)), i -> i is not null)"
    lines_of = f"""transform(_picks, (x, n) -> array_join(transform(
        slice(_clean, cast(greatest(x - ({before}), 0) + 1 as int), cast(x + ({after}) + 1 - greatest(x - ({before}), 0) as int)),
        (l, i) -> if(l = '', null, concat('Line ', cast(greatest(x - ({before}), 0) + i + 1 as string), ': ', l))), '\n'))"""
    split = F.split(F.coalesce(F.col(content), F.lit("")), "\n")
    ready = let(logs, _clean=F.transform(split, lambda line: text.clean_line(line)))
    ready = let(ready, _low=F.transform("_clean", F.lower))
    ready = let(ready, _errs=F.reverse(F.expr(hits)))
    ready = let(ready, _picks=F.expr(_fold(plan)))
    separator = f"\n\n{fixed.SECTION_SEPARATOR}\n\n"
    return ready.select(
        *logs.columns, F.size("_errs").alias("total_errors"), F.size("_picks").alias("sections"),
        F.when(F.size("_picks") > 0, F.array_join(F.reverse(F.expr(lines_of)), separator)).alias("text"),
    )


def fixed_context(lines: DataFrame, before: int, after: int, **patterns) -> DataFrame:
    """Ranges of `before`/`after` lines around every error line, overlapping or touching ones merged."""
    errors = settle(error_lines(lines, **patterns).select("log_id", "line_no"), "error_lines")
    prev = carry_forward(errors, ["log_id"], "line_no", {"_prev": F.col("line_no")}, inclusive=False)
    opens = F.col("_prev").isNull() | (
        F.greatest(F.col("line_no") - before, F.lit(0)) > F.col("_prev") + after + 1
    )
    marked = carry_forward(prev, ["log_id"], "line_no", {"_open": F.when(opens, F.col("line_no"))})
    return (
        marked.groupBy("log_id", "_open").agg(F.max("line_no").alias("_last"), F.count("*").alias("errors"))
        .join(log_sizes(lines), "log_id")
        .select(
            "log_id",
            F.greatest(F.col("_open") - before, F.lit(0)).alias("start_line"),
            F.least(F.col("_last") + after + 1, F.col("total_lines")).alias("end_line"),
            "errors",
        )
    )


def error_summary(lines: DataFrame, plan: ContextPlan | None = None, **patterns) -> DataFrame:
    """One record per log with errors: totals, settings, counts and samples per pattern, ignored counts."""
    plan = plan or context_plan()

    def as_map(kind: str, value: str):
        entry = F.when(F.col("kind") == kind, F.struct("pattern", value))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    shown = plan.buckets or fixed.CONTEXT_BUCKETS
    total = F.sum(F.when(F.col("kind") == "error", F.col("lines")).otherwise(0))
    capped = plan.cap is not None
    if capped:
        first, parts = 0, []
        for n, b, a in plan.buckets:
            parts.append(f"errors {first + 1}-{first + n}: {b}b/{a}a")
            first += n
        used = f"incremental buckets ({', '.join(parts)})"
    else:
        used = f"{plan.before} before, {plan.after} after (fixed)"
    return (
        pattern_samples(lines, **patterns).groupBy("log_id")
        .agg(
            total.alias("total_errors_found"),
            F.lit(",".join(f"{n}:{b}:{a}" for n, b, a in shown)).alias("error_settings"),
            F.lit("bottom-up").alias("search_technique"),
            F.lit(used).alias("context_used"),
            as_map("error", "lines").alias("error_types"),
            as_map("error", "sample").alias("line_samples"),
            as_map("ignored", "lines").alias("ignored_patterns"),
            F.lit(capped).alias("extraction_capped"),
            (F.lit(plan.cap).cast("bigint") if capped else total).alias("max_errors_extracted"),
        )
        .filter(F.col("total_errors_found") > 0)
    )
