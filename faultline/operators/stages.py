"""Console logs: stages, parallel blocks, slices by name, real failures and the text to show for a failed stage.

All results are per line or per span; no step puts a whole console into one row or one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .blocked import attach_last, block_of, carry_forward, spans_to_blocks
from .lines import error_lines, is_error, log_sizes
from .nesting import matched, with_parents
from .sections import ContextPlan, context_plan, format_sections
from .shared import settle

KEY = ["log_id"]


def segment_console(lines: DataFrame) -> DataFrame:
    """Content lines with the stage and the parallel block they belong to; marker lines are taken out.

    Adds stage_no (1-based), stage_name, block_start and block_name (null outside a block) and block_closed.
    """
    raw = F.col("raw")
    header = F.regexp_extract(raw, r"\[Pipeline\] stage \((.*?)\)", 1)
    branch = F.regexp_extract(raw, r"\[Pipeline\] \{ \((.*?)\)", 1)
    kind = F.when(
        raw.contains("[Pipeline] "),
        F.when(raw.rlike(r"\[Pipeline\] stage \(.*?\)"), "stage")
        .when(raw.contains("[Pipeline] parallel"), "open")
        .when(raw.rlike(r"\[Pipeline\] \{ \(.*?\)"), "branch")
        .when(raw.contains("[Pipeline] // parallel"), "close"),
    )
    is_stage = F.col("_kind") == "stage"
    # Marker lines are few; all the bookkeeping is done on them alone.
    marks = settle(
        lines.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
        .select("log_id", "line_no", "_kind", F.when(is_stage, header).when(F.col("_kind") == "branch", branch).alias("_name")),
        "markers",
    )
    staged = carry_forward(
        marks, KEY, "line_no",
        last={
            "_mode": F.when(F.col("_kind") != "branch", F.col("_kind")),
            "stage_name": F.when(is_stage, F.col("_name")),
        },
        sums={"stage_no": F.when(is_stage, 1).otherwise(0)},
    )
    opens = (F.col("_kind") == "branch") & (F.col("_mode") == "open")
    turns = staged.filter(opens | F.col("_kind").isin("stage", "close"))
    # Whether a block is closed is settled on the few turns, so that content lines need no look-up by log.
    last_turn = turns.groupBy("log_id").agg(F.max("line_no").alias("_last_turn"))
    state = F.struct(
        F.col("line_no").alias("at"), F.col("stage_no"), F.col("stage_name"), F.when(opens, F.col("_name")).alias("block"),
        (F.col("line_no") < F.col("_last_turn")).alias("closed"),
    )
    turns = settle(turns.join(last_turn, KEY).select("log_id", "line_no", state.alias("_state")), "turns")
    content = lines.withColumn("_kind", kind).filter(F.col("_kind").isNull() | (F.col("_kind") == "branch")).drop("_kind")
    in_block = F.col("_state.block").isNotNull()
    return (
        attach_last(content, turns, KEY, "line_no", "_state")
        .filter((F.col("_state.stage_no") > 0) & (F.col("_state.at") != F.col("line_no")))
        .select(
            *lines.columns, F.col("_state.stage_no").alias("stage_no"), F.col("_state.stage_name").alias("stage_name"),
            F.when(in_block, F.col("_state.at")).alias("block_start"), F.col("_state.block").alias("block_name"),
            (~in_block | F.col("_state.closed")).alias("block_closed"),
        )
    )


def segment_stages(lines: DataFrame) -> DataFrame:
    """Lines of each stage outside parallel blocks."""
    return segment_console(lines).filter(F.col("block_name").isNull()).select(
        "log_id", "stage_no", "stage_name", "line_no", "raw"
    )


def segment_parallel(lines: DataFrame) -> DataFrame:
    """Lines of each parallel block; a block still open at the end of the log is left out."""
    return segment_console(lines).filter(F.col("block_name").isNotNull() & F.col("block_closed")).select(
        "log_id", "stage_no", "stage_name", "block_start", "block_name", "line_no", "raw"
    )


def _after_marker(line: Column, marker: str) -> Column:
    """Array: for every place where the marker stands, the rest of the line after it."""
    parts = F.split(line, rf"\Q{marker}\E")
    n = F.size(parts)
    rests = F.transform(F.sequence(F.lit(2), n), lambda j: F.array_join(F.slice(parts, j, n), marker))
    return F.when(n > 1, rests).otherwise(F.array().cast("array<string>"))


def _closed_names(rest: Column) -> Column:
    """Array of texts x such that the rest starts with x + ')'."""
    parts = F.split(rest, r"\)")
    n = F.size(parts)
    names = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ")"))
    return F.when(n > 1, names).otherwise(F.array().cast("array<string>"))


def _rests(lines: DataFrame, line: Column, marker: str) -> DataFrame:
    """(log_id, line_no, _rest): one row per place where the marker stands."""
    return lines.filter(line.contains(marker)).select("log_id", "line_no", F.explode(_after_marker(line, marker)).alias("_rest"))


def _prefix_matches(rests: DataFrame, wanted: DataFrame, name: Column, then: str = "") -> DataFrame:
    """Beginnings of the rest that are as long as some wanted name and are followed by `then`: one row per such length."""
    lengths = rests.select("*", wanted.select(F.collect_set(F.length(name))).scalar().alias("_lengths"))
    rest = F.col("_rest")
    fits = F.filter("_lengths", lambda n: (n > 0) & (n <= F.length(rest)) & (F.substr(rest, n + 1, F.lit(len(then))) == then))
    return lengths.withColumn("_n", F.explode(fits)).select("log_id", "line_no", F.substr("_rest", F.lit(1), F.col("_n")).alias("_match"))


def _named_starts(matches: DataFrame, wanted: DataFrame, name: Column) -> DataFrame:
    """Start lines by wanted name: (log_id, name, line_no). An equi-join on the names a line could stand for."""
    keys = wanted.select("log_id", "name", name.alias("_match"))
    return matches.join(keys, ["log_id", "_match"]).select("log_id", "name", "line_no")


def _next_end(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """For each (log_id, name, start_line) the first end line below it, or null."""
    s = starts.select("log_id", "name", "start_line", (F.col("start_line") * -2 - 1).alias("_pos"), F.lit(None).cast("bigint").alias("_end"))
    e = ends.select(
        "log_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("start_line"),
        (F.col("line_no") * -2).alias("_pos"), F.col("line_no").cast("bigint").alias("_end"),
    )
    both = carry_forward(s.unionByName(e), KEY, "_pos", last={"end_line": F.col("_end")})
    return both.filter(F.col("name").isNotNull()).select("log_id", "name", "start_line", "end_line")


def _marks(lines: DataFrame, hit: Column) -> DataFrame:
    """The few lines that start or end something, found in one pass and stored."""
    return settle(lines.filter(hit).select("log_id", "line_no", "raw"), "marks")


def _cut(lines: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Lines after the first start line of a name up to its next end line, without repeated start lines."""
    starts = settle(starts, "starts")
    first = starts.groupBy("log_id", "name").agg(F.min("line_no").cast("bigint").alias("start_line"))
    spans = _next_end(first, ends.select("log_id", "line_no")).join(log_sizes(lines), KEY).select(
        "log_id", "name", "start_line", F.coalesce("end_line", "total_lines").alias("end_line")
    )
    return span_lines(lines, spans, starts)


def span_lines(lines: DataFrame, spans: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Lines strictly between start_line and end_line of each span, without the (log_id, name, line_no) of `skip`."""
    cut = spans_to_blocks(
        spans.withColumn("_from", F.col("start_line") + 1).withColumn("_to", F.col("end_line") - 1), "_from", "_to"
    )
    # Stored, so that few spans are known to be few and the lines are not shuffled for them.
    cut = settle(cut, "spans")
    out = (
        lines.withColumn("_blk", block_of(F.col("line_no"))).join(cut, ["log_id", "_blk"])
        .filter(F.col("line_no").between(F.col("_from"), F.col("_to")))
        .select("log_id", "name", "line_no", "raw")
    )
    return out if skip is None else out.join(skip, ["log_id", "name", "line_no"], "left_anti")


def slice_stage(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of each wanted stage (log_id, name): from 'stage (NAME)' in any case to the next '// stage'."""
    low = F.lower("raw")
    marks = _marks(lines.withColumn("raw", low), F.col("raw").contains("stage (") | F.col("raw").contains("// stage"))
    raw = F.col("raw")
    starts = _named_starts(_prefix_matches(_rests(marks, raw, "stage ("), wanted, F.lower("name"), ")"), wanted, F.lower("name"))
    return _cut(lines, starts, marks.filter(raw.contains("// stage") & ~raw.contains("stage (")))


def slice_block(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of each wanted block: from '{ (NAME)' or 'Branch: NAME' to '[Pipeline] }' or '// parallel'."""
    raw = F.col("raw")
    begins, ends = raw.contains("{ (") | raw.contains("Branch: "), raw.contains("[Pipeline] }") | raw.contains("// parallel")
    marks = _marks(lines, begins | ends)
    closed = _prefix_matches(_rests(marks, raw, "{ ("), wanted, F.col("name"), ")")
    open_ended = _prefix_matches(_rests(marks, raw, "Branch: "), wanted, F.col("name"))
    starts = _named_starts(closed.unionByName(open_ended), wanted, F.col("name"))
    return _cut(lines, starts, marks.filter(ends & ~begins))


def slice_step(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of each wanted step: from the first line with '{ (NAME', a prefix match, to '[Pipeline] }'."""
    raw = F.col("raw")
    marks = _marks(lines, raw.contains("{ (") | raw.contains("[Pipeline] }"))
    starts = _named_starts(_prefix_matches(_rests(marks, raw, "{ ("), wanted, F.col("name")), wanted, F.col("name"))
    return _cut(lines, starts, marks.filter(raw.contains("[Pipeline] }") & ~raw.contains("{ (")))


def slice_stage_two_line(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of each wanted stage: '[Pipeline] stage' followed by '[Pipeline] { (NAME)', to '[Pipeline] // stage'.

    The start and the end marker belong to the slice; without an end marker it runs to the end of the log.
    """
    raw = F.col("raw")
    marks = _marks(lines, raw.rlike(r"(?i)^\[Pipeline\]\s+(stage|\{\s*\(|//\s+stage)"))
    bare = marks.filter(raw.rlike(r"(?i)^\[Pipeline\]\s+stage\s*$")).select("log_id", (F.col("line_no") + 1).alias("line_no"))
    opener = r"(?i)^\[Pipeline\]\s+\{\s*\("
    opened = marks.filter(raw.rlike(opener)).select("log_id", "line_no", F.regexp_replace(raw, opener, "").alias("_rest"))
    pairs = opened.join(bare, ["log_id", "line_no"]).withColumn("line_no", F.col("line_no") - 1)
    names = F.transform(_closed_names(F.col("_rest")), lambda n: F.lower(F.regexp_replace(n, r"\s+$", "")))
    matches = pairs.select("log_id", "line_no", F.explode(names).alias("_match"))
    starts = _named_starts(matches, wanted, F.lower("name"))
    ends = marks.filter(raw.rlike(r"(?i)^\[Pipeline\]\s+//\s+stage\s*$")).select("log_id", "line_no")
    first = starts.groupBy("log_id", "name").agg(F.min("line_no").cast("bigint").alias("start_line"))
    spans = _next_end(first, ends).join(log_sizes(lines), KEY).select(
        "log_id", "name", (F.col("start_line") - 1).alias("start_line"),
        F.coalesce(F.col("end_line") + 1, F.col("total_lines")).alias("end_line"),
    )
    return span_lines(lines, spans)


def nested_spans(lines: DataFrame) -> DataFrame:
    """Spans of stages and of the blocks of parallel groups, each with its own end.

    One row per span: log_id, kind ('stage' or 'block'), name, start_line and end_line (the marker lines; end_line is the number of lines
    for a span the log never closes), closed, depth (1 for an outermost span) and parent (start_line of the span around it, null without
    one). A stage opens with '[Pipeline] stage (NAME)', or with '[Pipeline] stage' before '[Pipeline] { (NAME)'; a block is a brace right
    inside a parallel group, with or without 'Branch: ' before its name. Closing markers that close nothing are passed over.
    """
    raw = F.col("raw")
    kind = (
        F.when(raw.rlike(r"\[Pipeline\] (// )?stage( \(.*\))?\s*$"), "stage")
        .when(raw.rlike(r"\[Pipeline\] (// )?parallel\s*$"), "parallel")
        .when(raw.rlike(r"\[Pipeline\] (\{( \(.*\))?|\})\s*$"), "brace")
    )
    marks = settle(lines.filter(raw.contains("[Pipeline] ")).select("log_id", "line_no", kind.alias("kind"), "raw").filter("kind is not null"), "markers")
    named = F.nullif(F.regexp_extract("raw", r"\[Pipeline\] (?:stage|\{) \((?:Branch: )?(.*)\)\s*$", 1), F.lit(""))
    step = F.when(F.col("raw").rlike(r"\[Pipeline\] (// |\})"), -1).otherwise(1)
    steps = marks.select("log_id", "line_no", "kind", named.alias("name"), step.alias("step"))
    opened = matched(steps, ["log_id", "kind"], "line_no", "step")
    spans = settle(opened.select("log_id", "kind", "name", "line_no", "end"), "all-spans")
    below = spans.filter("kind = 'brace'").select("log_id", (F.col("line_no") - 1).alias("line_no"), F.lit("stage").alias("kind"), F.col("name").alias("_below"))
    around = with_parents(spans, KEY, "line_no", "end")
    groups = spans.filter("kind = 'parallel'").select("log_id", F.col("line_no").cast("bigint").alias("parent"), F.lit(True).alias("_grouped"))
    blocks = around.filter("kind = 'brace'").join(groups, ["log_id", "parent"]).select("log_id", F.lit("block").alias("kind"), "name", "line_no", "end")
    stages = spans.filter("kind = 'stage'").join(below, ["log_id", "line_no", "kind"], "left")
    stages = stages.select("log_id", "kind", F.coalesce("name", "_below").alias("name"), "line_no", "end")
    nodes = with_parents(stages.unionByName(blocks), KEY, "line_no", "end").join(log_sizes(lines), KEY)
    return nodes.select(
        "log_id", "kind", "name", F.col("line_no").cast("bigint").alias("start_line"), F.coalesce("end", "total_lines").alias("end_line"),
        F.col("end").isNotNull().alias("closed"), "depth", "parent",
    )


_PART = ["log_id", "stage_pos", "stage_name", "is_parallel", "node_pos", "part_name", "status", "duration_ms"]


def _stage_parts(stages: DataFrame) -> DataFrame:
    """One row per stage, or per block of a stage with more than one flow node."""
    parallel = F.size("nodes") > 1
    single = stages.filter(~parallel).select(
        "log_id", "stage_pos", F.col("name").alias("stage_name"), F.lit(False).alias("is_parallel"),
        F.lit(None).cast("int").alias("node_pos"), F.col("name").alias("part_name"), "status", "duration_ms",
    )
    blocks = stages.filter(parallel).select(
        "log_id", "stage_pos", F.col("name").alias("stage_name"), F.lit(True).alias("is_parallel"), F.posexplode("nodes").alias("node_pos", "_n"),
    )
    return single.unionByName(blocks.select(*_PART[:5], F.col("_n.name").alias("part_name"), "_n.status", "_n.duration_ms"))


def _part_lines(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """(log_id, is_parallel, name, line_no, raw): the slices of the parts' names, each ending with the next closing marker."""
    single, blocks = (parts.filter(c).select("log_id", F.col("part_name").alias("name")).distinct() for c in ("not is_parallel", "is_parallel"))
    return slice_stage(lines, single).withColumn("is_parallel", F.lit(False)).unionByName(slice_block(lines, blocks).withColumn("is_parallel", F.lit(True)))


def _part_spans(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """The parts with start_line, end_line and closed of their own spans: the first stage of that name in any case, the first block of that
    name right inside that stage; null where the log has none."""
    spans = settle(nested_spans(lines), "nested-spans")
    of_stage = spans.filter("kind = 'stage'").groupBy("log_id", F.lower("name").alias("_stage")).agg(
        F.min_by(F.struct("start_line", "end_line", "closed"), "start_line").alias("_s")
    )
    named = parts.withColumn("_stage", F.lower("stage_name")).join(of_stage, ["log_id", "_stage"], "left").withColumn("_parent", F.col("_s.start_line"))
    of_block = spans.filter("kind = 'block'").groupBy("log_id", F.col("parent").alias("_parent"), F.col("name").alias("part_name")).agg(
        F.min_by(F.struct("start_line", "end_line", "closed"), "start_line").alias("_b")
    )
    found = F.when(F.col("is_parallel"), F.col("_b")).otherwise(F.col("_s"))
    return named.join(of_block, ["log_id", "_parent", "part_name"], "left").select(*_PART, found.alias("_span")).select(*_PART, "_span.*")


def stage_tree(stages: DataFrame, lines: DataFrame, nested: bool = False) -> DataFrame:
    """One row per stage, or per block of a stage with more than one flow node, with the size of its text.

    `stages(log_id, stage_pos, name, status, duration_ms, nodes ARRAY<STRUCT<name, status, duration_ms>>)`. A part ends with the next closing
    marker, so a nested stage cuts the outer one short. With `nested` each part ends with its own marker and comes with start_line,
    end_line and closed (null where the log does not hold it).
    """
    parts = _stage_parts(stages)
    sizes = [F.count("*").alias("lines"), F.sum(F.length("raw")).alias("chars")]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "chars")]
    if nested:
        spans = settle(_part_spans(parts, lines), "part-spans")
        ranges = spans.filter("start_line is not null").select("log_id", "start_line", "end_line").distinct()
        keyed = ranges.withColumn("name", F.col("start_line").cast("string"))
        sized = span_lines(lines, keyed).groupBy("log_id", F.col("name").cast("bigint").alias("start_line")).agg(*sizes)
        return spans.join(sized, ["log_id", "start_line"], "left").select(*_PART, "start_line", "end_line", "closed", *counts)
    sized = _part_lines(parts, lines).groupBy("log_id", "is_parallel", F.col("name").alias("part_name")).agg(*sizes)
    return parts.join(sized, ["log_id", "is_parallel", "part_name"], "left").select(*_PART, *counts)


def stage_texts(stages: DataFrame, lines: DataFrame, nested: bool = False) -> DataFrame:
    """The text of each part of `stage_tree`: its columns without sizes, `part` and `text`.

    A text comes in parts of one block of lines of the log, so that none grows with the log; parts without lines have no row.
    """
    parts = _stage_parts(stages)
    if nested:
        parts = settle(_part_spans(parts, lines).filter("start_line is not null"), "part-spans").withColumn("name", F.col("start_line").cast("string"))
        cut = span_lines(lines, parts.select("log_id", "name", "start_line", "end_line").distinct())
        key = ["log_id", "name"]
    else:
        cut = _part_lines(parts, lines).withColumnRenamed("name", "part_name")
        key = ["log_id", "is_parallel", "part_name"]
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    texts = cut.groupBy(*key, block_of(F.col("line_no")).alias("part")).agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n").alias("text"))
    return parts.join(texts, key).select(*_PART, "part", "text")


def real_failures(nodes: DataFrame, keys: Sequence[str], pos: str = "node_pos") -> DataFrame:
    """Per stage with failed nodes: the last failed node that no successful or skipped node follows.

    `total_failed` counts failed nodes, `handled` those followed by a node that went on. step_name is null when all
    failures were handled.
    """
    failed = F.col("status").isin(*fixed.FAILED_STAGE_STATUSES)
    went_on = nodes.filter(F.col("status").isin(*fixed.CONTINUED_STATUSES)).groupBy(*keys).agg(F.max(pos).alias("_ok"))
    bad = nodes.filter(failed).join(went_on, list(keys), "left")
    real = F.col("_ok").isNull() | (F.col(pos) > F.col("_ok"))
    return bad.groupBy(*keys).agg(
        F.max_by("name", F.when(real, F.col(pos))).alias("step_name"),
        F.count("*").alias("total_failed"), F.count_if(~real).alias("handled"),
    )


def failed_step_counts(nodes: DataFrame, keys: Sequence[str], pos: str = "node_pos") -> DataFrame:
    return real_failures(nodes, keys, pos).select(*keys, "total_failed", "handled")


def hybrid_lines(lines: DataFrame, tail: int = fixed.TAIL_LINES, head: int = fixed.HEAD_LINES) -> DataFrame:
    """Line-table form of the hybrid read: the tail if it holds an error line, else the capped head."""
    sized = lines.join(log_sizes(lines), KEY)
    in_tail = F.col("line_no") >= F.col("total_lines") - tail
    # The check reads uncleaned lines.
    hits = sized.filter(in_tail).filter(is_error("lower(raw)")).select("log_id").distinct().withColumn("_hit", F.lit(True))
    return (
        sized.join(hits, KEY, "left")
        .filter(F.when(F.col("_hit"), in_tail).otherwise(F.col("line_no") < head)).drop("_hit", "total_lines")
    )


def stage_log_choice(
    failed: DataFrame, own_logs: DataFrame, console: DataFrame, plan: ContextPlan | None = None,
    tail: int | None = None, head: int | None = None,
) -> DataFrame:
    """Text to show for each failed stage: (log_id, name, choice, part, text).

    `failed(log_id, name, step_name)`; `own_logs(log_id, name, line_no, raw)` are logs of single stages. In order: the
    stage's own log, the slice of its failed step, its slice of the console, the whole console; of all but the step
    slice the error sections when there are any. Sections are one bounded text (part 0); lines shown as they are come in
    parts of one block of lines each, so no text grows with the log. The whole console is read; `tail` and `head` together
    ask for the hybrid read of it instead.
    """
    plan = plan or context_plan()
    stage = ["log_id", "name"]
    console = settle(console if tail is None or head is None else hybrid_lines(console, tail, head), "console")
    failed = failed.select(*stage, "step_name")

    def without(rows: DataFrame, done: DataFrame) -> DataFrame:
        return rows.join(done.select(*stage).distinct(), stage, "left_anti")

    own = own_logs.join(failed.select(*stage), stage, "left_semi").select(*stage, "line_no", "raw")
    rest = without(failed, own)
    steps = rest.filter(F.length("step_name") > 0)
    step_lines = slice_step(console, steps.select("log_id", F.col("step_name").alias("name")).distinct())
    by_step = settle(
        steps.join(step_lines.withColumnRenamed("name", "step_name"), ["log_id", "step_name"])
        .select(*stage, "line_no", "raw"), "by_step",
    )
    rest = without(rest, by_step).select(*stage)
    by_stage = settle(slice_stage_two_line(console, rest), "by_stage")
    rest = without(rest, by_stage)
    # One text per console, however many stages fall back to it.
    whole = console.join(rest.select("log_id").distinct(), KEY, "left_semi").withColumn("name", F.lit(None).cast("string"))

    def tagged(rows: DataFrame, source: str) -> DataFrame:
        key = F.struct(F.lit(source).alias("choice"), *stage)
        return rows.select(key.alias("log_id"), "line_no", "raw")

    candidates = settle(
        tagged(own, "stage log").unionByName(tagged(by_stage, "stage slice")).unionByName(tagged(whole, "console")),
        "candidates",
    )

    def plain(lines: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
        blocks = lines.groupBy("log_id", block_of(F.col("line_no")).alias("part"))
        return blocks.agg(F.array_join(F.transform(ordered, lambda x: x["raw"]), "\n").alias("text"))

    cut = format_sections(candidates, plan).select("log_id", F.lit(0).cast("bigint").alias("part"), "text")
    uncut = tagged(by_step, "step").unionByName(candidates.join(error_lines(candidates).select("log_id").distinct(), KEY, "left_anti"))
    texts = (
        cut.withColumn("choice", F.concat("log_id.choice", F.lit(" sections")))
        .unionByName(plain(uncut).withColumn("choice", F.col("log_id.choice")))
        .select("log_id.log_id", "log_id.name", "choice", "part", "text")
    )
    of_console = texts.filter(F.col("name").isNull()).drop("name")
    return texts.filter(F.col("name").isNotNull()).unionByName(rest.join(of_console, KEY))
