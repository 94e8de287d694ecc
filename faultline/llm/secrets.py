"""Secret scans over a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: every match must hold them. Index rows (trigram, document) are
stored for the trigrams of all queries; a rule's candidates are the documents whose postings
satisfy its query, and only they are read by the rule's pattern. Rules without mandatory trigrams read every text.
Only DataFrame operations are used; the driver handles patterns, never documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import settle

# Beyond so many alternatives a part of a pattern says nothing about its text.
MOST_STRINGS = 64
# Matches whose starts are summed in one go.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """`pattern` finds leftmost non-overlapping matches; those whose `group` has under `least` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


# The three base kinds.
BASE_RULES = (
    Rule(
        "assign", "((?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 12,
    ),
    Rule("access", "(AKIA[A-Z0-9]+)", 1, 18),
    Rule("hex", "([0-9a-f]{16,})", 1, 16),
)
# Further kinds; their spans come on top of the base ones.
MORE_RULES = (
    Rule("private_key", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 20),
    Rule("hosting", "(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    Rule("chat", "(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15),
    Rule("cloud", "(AIza[A-Za-z0-9_-]{35})", 1, 39),
    Rule("web_token", "(eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,})", 1, 29),
    Rule("login_url", "([a-z]{2,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1, 12),
)
RULES = BASE_RULES + MORE_RULES


def _strings(node) -> list[str] | None:
    """All lower-case strings the parsed pattern can match, or None if too many."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(value).lower()]
    if op == "IN":
        found: set[str] = set()
        for kind, item in value:
            if str(kind) == "LITERAL":
                found.add(chr(item).lower())
            elif str(kind) == "RANGE" and item[1] - item[0] < MOST_STRINGS:
                found.update(chr(c).lower() for c in range(item[0], item[1] + 1))
            else:
                return None
        return sorted(found) if len(found) <= 8 else None
    if op == "SUBPATTERN":
        return _joined(value[3])
    if op == "BRANCH":
        branches = [_joined(b) for b in value[1]]
        return None if any(b is None for b in branches) else sorted({s for b in branches for s in b})
    if op in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 2:
        inner = _joined(value[2])
        if inner is None:
            return None
        return sorted({"".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)})
    return None


def _joined(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = [a + b for a, b in product(out, part)]
    return out


def _flat(nodes) -> list:
    out = []
    for node in nodes:
        if str(node[0]) == "SUBPATTERN" and _joined(node[1][3]) is None:
            out += _flat(node[1][3])
        else:
            out.append(node)
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, in lower case: every match contains all trigrams of one alternative. Empty: no such trigrams.

    The pattern is cut into stretches that can match a few strings only; the stretch whose weakest string has the most
    trigrams gives the query.
    """
    runs: list[list[str]] = [[""]]
    for node in _flat(re._parser.parse(pattern)):
        part = _strings(node)
        if part is None:
            inner = None
            if str(node[0]) in ("MAX_REPEAT", "MIN_REPEAT") and node[1][0] >= 1:
                inner = _joined(node[1][2])
            # One turn of a repeat follows what stands before it; anything may come after.
            if inner is not None and len(runs[-1]) * len(inner) <= MOST_STRINGS:
                runs[-1] = [a + b for a, b in product(runs[-1], inner)]
            runs.append([""])
        elif len(runs[-1]) * len(part) <= MOST_STRINGS:
            runs[-1] = [a + b for a, b in product(runs[-1], part)]
        else:
            runs.append(list(part))
    best = max(runs, key=lambda run: min(len(_trigrams(s)) for s in run))
    choices = {_trigrams(s) for s in best}
    if frozenset() in choices:
        return []
    return sorted((c for c in choices if not any(o < c for o in choices)), key=sorted)


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """`docs(doc_id, text)` -> (trigram, doc_id) for the trigrams that the rules' queries name."""
    wanted = sorted({t for rule in rules for choice in trigram_query(rule.pattern) for t in choice})
    folded = docs.filter("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in wanted]))
    return folded.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents per rule whose postings satisfy the rule's query -> (doc_id, rules array<string>).

    Postings of one document are met by document: the bits of its trigrams are or-ed, and a choice holds if all its bits are set.
    """
    choices = [(rule.kind, c) for rule in rules for c in trigram_query(rule.pattern)]
    wanted = sorted({t for _, c in choices for t in c})
    place = {t: n for n, t in enumerate(wanted)}
    words = -(-len(wanted) // 60)
    number = F.element_at(F.create_map(*[x for t, n in place.items() for x in (F.lit(t), F.lit(n))]), F.col("trigram"))
    rows = index.withColumn("_n", number)
    bits = [
        F.bit_or(F.when(F.floor(F.col("_n") / 60) == w, F.expr(f"shiftleft(1L, _n - {60 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"_b{w}")
        for w in range(words)
    ]
    found = rows.groupBy("doc_id").agg(*bits)

    def holds(choice: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            mask = sum(1 << (place[t] - 60 * w) for t in choice if place[t] // 60 == w)
            if mask:
                out = out & (F.col(f"_b{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return out

    kinds = []
    for rule in rules:
        own = [holds(c) for kind, c in choices if kind == rule.kind]
        if own:
            any_of = own[0]
            for condition in own[1:]:
                any_of = any_of | condition
            kinds.append(F.when(any_of, F.lit(rule.kind)))
    return found.select("doc_id", F.array_compact(F.array(*kinds)).alias("rules")).filter(F.size("rules") > 0)


def _walked(rows: Column) -> Column:
    """Struct (upto, spans): spans of `rows(gap, own, good)` laid end to end from 0, and where they end."""
    span = "struct<start:int,end:int,good:boolean>"
    empty = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{span}>").alias("spans"))
    return F.aggregate(
        rows, empty,
        lambda acc, row: F.struct(
            (acc["upto"] + row["gap"] + row["own"]).alias("upto"),
            F.concat(acc["spans"], F.array(F.struct(
                (acc["upto"] + row["gap"]).alias("start"), (acc["upto"] + row["gap"] + row["own"]).alias("end"), row["good"].alias("good"),
            ))).alias("spans"),
        ),
    )


def _spans(rule: Rule, number: int) -> Column:
    """The matches of a rule in `text` as structs (start, number, kind, end, good) in code points, end exclusive.

    What stands between two matches is cut out by a split with the same pattern; starts are running sums of both lengths, first inside
    chunks of CHUNK matches, then over the chunks. Gaps and matches are zipped, so each pattern pass runs once a text.
    """
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split("text", rule.pattern, -1), F.regexp_extract_all("text", pattern, 1), F.regexp_extract_all("text", pattern, rule.group)
    )
    # The last gap has no match behind it: its lengths are null or 0 and it is not good.
    rows = F.transform(zipped, lambda z: F.struct(
        F.length(z["0"]).alias("gap"), F.coalesce(F.length(z["1"]), F.lit(0)).alias("own"),
        F.coalesce(F.length(z["2"]) >= rule.least, F.lit(False)).alias("good"),
    ))
    # An array of one array gives the rows a name inside the lambda; written out there, they would be found anew per chunk.
    chunks = F.flatten(F.transform(F.array(rows), lambda every: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")),
        lambda c: _walked(F.slice(every, c * CHUNK + 1, F.lit(CHUNK))),
    )))
    chunk = "struct<start:int,end:int,good:boolean>"
    empty = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<struct<base:int,spans:array<{chunk}>>>").alias("done"))
    based = F.aggregate(
        chunks, empty,
        lambda acc, c: F.struct(
            (acc["upto"] + c["upto"]).alias("upto"),
            F.concat(acc["done"], F.array(F.struct(acc["upto"].alias("base"), F.filter(c["spans"], lambda s: s["good"]).alias("spans")))).alias("done"),
        ),
    )["done"]
    return F.flatten(F.transform(based, lambda c: F.transform(c["spans"], lambda s: F.struct(
        (c["base"] + s["start"]).alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"),
        (c["base"] + s["end"]).alias("end"), s["good"].alias("good"),
    ))))


def _joined_text(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All secrets of each row of `docs(doc_id, text)` -> (doc_id, found array<struct<start, number, kind, end, good>>).

    Ordered by start, then by the order of the rules. One row out per row in. Rows with a null id are not in the index and are read by
    every rule; repeated ids share their candidates, which only adds reading; null and empty texts have no secrets; an empty table
    gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = settle(postings(docs, rules), "trigram-postings")
    asked = settle(candidates(index, rules), "secret-candidates").select(F.col("doc_id").alias("_id"), "rules")
    free = [rule.kind for rule in rules if not trigram_query(rule.pattern)]
    named = docs.filter("doc_id is not null").join(asked, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    unnamed = docs.filter("doc_id is null").withColumn("rules", F.array(*[F.lit(r.kind) for r in rules]))
    both = named.unionByName(unnamed)
    for number, rule in enumerate(rules):
        may = F.regexp_like("text", F.lit(rule.pattern))
        if rule.kind not in free:
            may = F.array_contains("rules", rule.kind) & may
        none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int,good:boolean>>")
        both = both.withColumn(f"_found{number}", F.when(may, _spans(rule, number)).otherwise(none))
    every = F.array_sort(F.concat(*[F.col(f"_found{n}") for n in range(len(rules))]))
    return both.select("doc_id", every.alias("found"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and spans per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = find(docs, rules)
    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    rows = rows.withColumn("_base", base)

    def number(rule: Rule) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")

    n = [number(rule) for rule in BASE_RULES]
    return rows.select(
        "doc_id", *n, F.sha2(_joined_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _joined_text(F.col("found")).alias("spans"),
    )
