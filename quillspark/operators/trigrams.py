"""Substring search by an index of trigrams: a word's rows come from the postings of its rarest trigrams."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trust

#: Trigrams of a word that are looked up; more cost more reading than they save rows.
RAREST = 3
#: How many files a task may have open, and the bytes that each of them holds before they are written.
WRITERS, GROUP_BYTES = "spark.sql.maxConcurrentOutputFileWriters", 4 << 20


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case, none if it is null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def grams_of(word: str) -> list[str]:
    return sorted({word[i : i + 3] for i in range(len(word) - 2)})


@dataclass
class TrigramIndex:
    """Postings (gram, id) and counts (gram, n) as Parquet below ``path``, in hash buckets that are folders; the postings
    of each append() have a folder of their own.

    A search reads the buckets of its own trigrams only. What the postings give are candidates: each is tested on its
    row as it is now, so rows that changed or went since they were indexed give no false hit, and new rows or texts
    need their postings appended only. A row that was indexed twice counts once.
    """

    spark: SparkSession
    path: str
    buckets: int = 64
    fields: tuple[str, ...] = trust.FIELDS
    key: str = "id"
    key_type: str = "string"

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> None:
        """Index ``rows`` (key and fields). Rows without a key are none."""
        if rows.schema[self.key].dataType.simpleString() != self.key_type:
            raise ValueError(f"{self.key} is no {self.key_type}")
        grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(f)) for f in self.fields])))
        found = rows.filter(F.col(self.key).isNotNull()).select(F.col(self.key).alias("id"), F.explode(grams).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        # Each task writes to all buckets at once: the postings, many times the rows, are neither shuffled nor sorted.
        batch = f"{self.path}/postings/batch={uuid.uuid4().hex}"
        before = self.spark.conf.get(WRITERS)
        self.spark.conf.set(WRITERS, str(max(int(before), self.buckets)))
        try:
            found.write.partitionBy("bucket").option("parquet.block.size", str(GROUP_BYTES)).parquet(batch)
        finally:
            self.spark.conf.set(WRITERS, before)
        written = self.spark.read.schema("gram string, bucket int").parquet(batch)
        counts = written.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("append").parquet(f"{self.path}/counts")

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        """The rows of some trigrams; the buckets are named, so that other folders are not opened."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        numbers = sorted({r[0] for r in asked.select(self._bucket(F.col("gram"))).collect()})  # no more than a query has trigrams
        columns = {"postings": f"id {self.key_type}, gram string", "counts": "gram string, n bigint"}[table]
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(*numbers) & F.col("gram").isin(*grams))

    def _rarest(self, words: list[str]) -> dict[str, list[str]]:
        """For each word its rarest trigrams; none for a word with a trigram that no row has."""
        asked = sorted({g for w in words for g in grams_of(w)})
        n = {r.gram: r.n for r in self._of("counts", asked).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each trigram of the query
        return {w: sorted(grams_of(w), key=lambda g: (n[g], g))[:RAREST] if all(g in n for g in grams_of(w)) else [] for w in words}

    def candidates(self, words: list[str], every: bool) -> DataFrame | None:
        """(id) of rows that may hold every word, or any of them; None where the words are too short to tell."""
        words = sorted({w.lower() for w in words})
        long = [w for w in words if len(w) > 2]
        if not long or (not every and len(long) < len(words)):
            return None
        rarest = self._rarest(long)
        known = [w for w in long if rarest[w]]
        if not known or (every and len(known) < len(long)):
            return self.spark.createDataFrame([], f"id {self.key_type}")
        grams = sorted({g for w in known for g in rarest[w]})
        # An id's rows of one trigram may be several, where it was indexed again.
        has = {g: F.max(F.when(F.col("gram") == g, 1).otherwise(0)).alias(f"g{i}") for i, g in enumerate(grams)}
        flags = self._of("postings", grams).groupBy("id").agg(*has.values())
        at = {g: F.col(f"g{i}") == 1 for i, g in enumerate(grams)}
        test = F.lit(every)
        for w in known:
            whole = F.lit(True)
            for g in rarest[w]:
                whole = whole & at[g]
            test = (test & whole) if every else (test | whole)
        return flags.filter(test).select("id")

    def _search(self, rows: DataFrame, words: list[str], every: bool, test: Column) -> DataFrame:
        found = self.candidates(words, every)
        near = rows if found is None else rows.join(found.withColumnRenamed("id", self.key), self.key, "left_semi")
        return near.filter(test)

    def all_tokens(self, rows: DataFrame, words: list[str]) -> DataFrame:
        """The ``rows`` (key and fields) with every word in one of the fields, as trust.all_tokens(); no words, no rows.

        Words of one or two characters have no trigram: the others choose the candidates, and without any other the
        rows are scanned.
        """
        return self._search(rows, words, True, self._test(trust.all_tokens, words)) if words else rows.filter(F.lit(False))

    def any_token(self, rows: DataFrame, words: list[str], most: int = 12) -> DataFrame:
        """The ``rows`` with one of the first ``most`` words, as trust.any_token(); with a word of one or two characters
        the rows are scanned."""
        words = list(words)[:most]
        return self._search(rows, words, False, self._test(trust.any_token, words)) if words else rows.filter(F.lit(False))

    def _test(self, rule, words: list[str]) -> Column:
        return rule(words, fields=self.fields)
