"""Which texts contain which strings, through postings of three-character grams.

A text that contains a string of three characters or more holds all its grams. The postings of the string's rarest grams are
intersected, and what is left is verified on the text itself. Shorter strings are looked up among the parts of one and two characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle

GRAM = 3
RAREST = 4


def _parts(text: Column, size: int) -> Column:
    """The different parts of `size` characters, an empty array for a shorter text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame) -> DataFrame:
    """(gram, id) of `texts(id, text)`: every different gram of each text."""
    return texts.select(F.explode(_parts(F.col("text"), GRAM)).alias("gram"), "id")


def containing(needles: DataFrame, texts: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(needle, id): every row of `texts(id, text)` that contains a needle of `needles(needle)`. Ids are unique; empty needles are in none.

    `index` are the stored postings of the texts; without it they are made here. Only postings of grams that some needle asks for are
    shuffled, and of each needle only those of its RAREST rarest grams.
    """
    wanted = settle(needles.filter(F.length("needle") > 0).select("needle").distinct(), "needles")
    grams = settle(wanted.select("needle", F.explode(_parts(F.col("needle"), GRAM)).alias("gram")), "needle-grams")
    held = settle((postings(texts) if index is None else index).join(grams.select("gram").distinct(), "gram", "left_semi"), "postings")
    sizes = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    known = grams.join(sizes, "gram", "left").groupBy("needle").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram"))), 1, RAREST).alias("_g")
    )
    # A needle with a gram that no text has is in no text.
    asked = known.filter(F.col("_g")[0]["n"] > 0).select("needle", F.size("_g").alias("_all"), F.explode("_g.gram").alias("gram"))
    met = asked.join(held, "gram").groupBy("needle", "id").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all")).filter("_n = _all")
    found = met.join(texts.select("id", "text"), "id").filter(F.contains("text", F.col("needle"))).select("needle", "id")
    short = wanted.filter(F.length("needle") < GRAM)
    pieces = texts.select("id", F.explode(F.concat(*(_parts(F.col("text"), size) for size in range(1, GRAM)))).alias("needle"))
    return found.unionByName(pieces.join(short, "needle", "left_semi").select("needle", "id"))


def first_containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, pos): of the rows of `texts(pos, texts ARRAY)` with a text that contains the needle, the first by position.

    For short texts such as names: their parts of the wanted lengths are made, each is kept once with its first place, and needles are
    looked up among them. The work grows with the texts and with the needles, however many texts hold a needle.
    """
    wanted = settle(needles.filter(F.length("needle") > 0).select("needle").distinct(), "needles")
    longest = texts.select(F.max(F.array_max(F.transform("texts", F.length)))).first()[0] or 0
    # As many rows as there are lengths, at most that of the longest text.
    sizes = [r[0] for r in wanted.select(F.length("needle").alias("n")).filter(F.col("n") <= longest).distinct().collect()]
    if not sizes:
        return wanted.limit(0).select("needle", F.lit(None).cast(texts.schema["pos"].dataType).alias("pos"))

    def parts(text: Column) -> Column:
        fit = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n <= F.length(text))
        return F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))))

    pieces = texts.select("pos", F.explode(F.array_distinct(F.flatten(F.transform("texts", parts)))).alias("needle"))
    return pieces.groupBy("needle").agg(F.min("pos").alias("pos")).join(wanted, "needle", "left_semi")


class TextIndex:
    """Stored texts and their postings under `location`. Postings are sorted by gram, so that a look-up reads few row groups."""

    def __init__(self, spark: SparkSession, location: str):
        self.location = location.rstrip("/")
        self.texts, self.postings = (spark.read.parquet(f"{self.location}/{part}") for part in ("texts", "postings"))

    @classmethod
    def create(cls, rows: DataFrame, location: str) -> TextIndex:
        """Store `rows(id, text, ..)`; searches compare the lower-case text. Fails if the location is in use."""
        spark, place = rows.sparkSession, location.rstrip("/")
        rows.write.parquet(f"{place}/texts")
        texts = spark.read.schema(rows.schema).parquet(f"{place}/texts")
        # By gram and id, so that a common gram spreads over files.
        grams = postings(texts.select("id", F.lower("text").alias("text")))
        grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{place}/postings")
        return cls(spark, place)

    def search(self, needle: str) -> DataFrame:
        """The stored rows whose text contains the needle in any case; an empty needle is in every text."""
        wanted = needle.lower()
        if len(wanted) < GRAM:
            return self.texts.filter(F.contains(F.lower("text"), F.lit(wanted)))
        grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        held = settle(self.postings.filter(F.col("gram").isin(grams)), "postings")
        sizes = dict.fromkeys(grams, 0) | dict(held.groupBy("gram").count().collect())  # as many rows as the needle has grams
        rarest = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
        met = held.filter(F.col("gram").isin(rarest)).groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(rarest))
        return self.texts.join(met.select("id"), "id", "left_semi").filter(F.contains(F.lower("text"), F.lit(wanted)))
