"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest, met with the index by a
sort-merge join on the digest, and what the index lacks is appended. Only DataFrame operations are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import new_path, settle
from .tables import SALTS

BUCKETS = 64
BREAKS = ("\t", "\n", "\x0b", "\x0c", "\r")


def with_plain_spaces(docs: DataFrame, column: str, out: str) -> DataFrame:
    """Add the text with each run of space, tab, newline, vertical tab, form feed and carriage return as one space.

    Null counts as empty. The runs are searched by a pattern only in texts that have two spaces in a row by then.
    """
    plain = F.coalesce(F.col(column).cast("string"), F.lit(""))
    for mark in BREAKS:
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    single = F.when(F.contains(F.col(out), F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(F.col(out))
    return docs.withColumn(out, plain).withColumn(out, single)


def with_digest(docs: DataFrame) -> DataFrame:
    """Add the binary SHA-256 of the plain-spaced text as `_digest`; `_plain` holds that text."""
    return with_plain_spaces(docs, "text", "_plain").withColumn("_digest", F.unhex(F.sha2(F.col("_plain").cast("binary"), 256)))


class DigestIndex:
    """The digests of all texts taken in so far, in a folder that all executors share.

    Rows (digest, keep_id, batch). A batch that is taken in again under its own name meets only what other batches stored, so a run
    that broke off between the append and the use of its result can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.location = f"{path.rstrip('/')}/by_digest_{buckets}"
        self.name = "faultline_digests_" + hashlib.md5(self.location.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def others(self, batch: str) -> DataFrame:
        return self.rows().filter(F.col("batch") != batch)

    def claim(self, digests: DataFrame, batch: str) -> None:
        """Fail if the batch name stands in the index with a digest that is not among `digests(digest)`: the name belongs to other data."""
        own = self.rows().filter(F.col("batch") == batch).select("digest")
        if not own.join(digests.hint("merge"), "digest", "left_anti").isEmpty():
            raise ValueError(f"the index holds another batch of the name {batch!r}")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """`fresh(digest, keep_id)`: store the digests that the index lacks; one file per bucket."""
        lacking = fresh.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        rows = lacking.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        rows.sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def _index(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> tuple[DigestIndex, str]:
    """The index and the name of the batch; without an index a new one for this call."""
    if index is None:
        return DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index")), batch or "only"
    if not batch:
        raise ValueError("a batch needs a name of its own in the index")
    return index, batch


def assign(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """For each row of `docs(doc_id, text)`: which row stays for its text.

    Returns (doc_id, keep_id, group_size, kept, text_sha256), one row out per row in. Of equal texts of the batch the row with the
    smallest id stays (null ids last; of repeated rows exactly one stays), unless the index has the text from another batch:
    then none stays and keep_id is the id stored there. group_size counts the rows of the batch with the text. Null and
    empty texts are equal to each other. Other columns are not read; an empty table gives no rows.

    With an index the batch must be named; a name that the index knows with other texts fails, the same batch again gives the same answer.
    A text may fill a third of the batch: rows are reduced per (digest, salt) before the digest, and found again by both.
    """
    given = index is not None
    index, batch = _index(docs, index, batch)
    rows = with_digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("doc_id", F.col("_digest").alias("digest"), F.monotonically_increasing_id().alias("_row"))
    rows = settle(rows, "digests").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    parts = rows.groupBy("digest", "_salt").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("_salt").alias("salts"))
    stored = index.others(batch).select("digest", F.col("keep_id").alias("stored_id"), F.lit(True).alias("known")).hint("merge")
    groups = settle(groups.join(stored, "digest", "left"), "digest-groups")
    if given:
        index.claim(groups.select("digest"), batch)
    index.append(groups.filter("known is null").select("digest", F.col("first.doc_id").alias("keep_id")), batch)
    found = groups.select("digest", "first", "n", "known", "stored_id", F.explode("salts").alias("_salt"))
    fresh = F.col("known").isNull()
    return rows.join(found, ["digest", "_salt"]).select(
        "doc_id", F.when(fresh, F.col("first.doc_id")).otherwise(F.col("stored_id")).alias("keep_id"), F.col("n").alias("group_size"),
        (fresh & (F.col("_row") == F.col("first._row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def assign_in_batches(docs: DataFrame, batches: int = 2) -> DataFrame:
    """`assign` for documents that come in batches by rising id into one index: the answer of a single batch.

    The ids are cut at equal distances; rows without an id come last. A later batch meets the texts of the earlier ones in the index, so what
    stays is the row with the smallest id of all; group_size is summed over the batches.
    """
    index = DigestIndex(docs.sparkSession, new_path(docs.sparkSession, "digest-index"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = ends.low or 0, ends.high or 0
    cuts = [low + (high - low) * k // batches for k in range(1, batches)]
    turn = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: F.col("doc_id") > c))
    turn = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(turn)
    parts = [assign(rows.filter(turn == k), index, f"batch-{k}") for k in range(batches)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = settle(whole.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "batches")
    counts = whole.groupBy("text_sha256", "_salt").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("text_sha256").agg(F.sum("n").alias("_size"), F.collect_list("_salt").alias("_salts"))
    sized = sums.select("text_sha256", "_size", F.explode("_salts").alias("_salt"))
    return whole.join(sized, ["text_sha256", "_salt"]).select("doc_id", "keep_id", F.col("_size").alias("group_size"), "kept", "text_sha256")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, under the rules of `assign`; new texts enter the index, whose batches are
    named as there.

    The first row of each text is taken inside every input partition before the shuffle, so copies do not meet in one task.
    """
    given = index is not None
    index, batch = _index(docs, index, batch)
    keyed = with_digest(docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), "text"))
    keyed = keyed.select("_doc", "_id", F.col("_digest").alias("digest"))
    window = Window.partitionBy("digest").orderBy(F.col("_id").asc_nulls_last())
    firsts = keyed.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1")
    if given:
        index.claim(firsts.select("digest"), batch)
    fresh = firsts.join(index.others(batch).select("digest").hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("_id").cast("long").alias("keep_id")), batch)
    return fresh.select("_doc.*")
