"""Keyed snapshots without a table format: append, upsert, retract, chunk, summarise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 32 * 1024


def _order(df: DataFrame, first: Column, *more: Column) -> Column:
    """An order of rows that no partitioning changes: by ``first`` with nulls at one end, ``more``, then every column that
    has an order."""
    return F.struct(first.isNotNull(), first, *more, *[F.col(n) for n, kind in df.dtypes if not kind.startswith("map")])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, the first by ``position`` of each key: nulls go first, ties by all columns.
    Null keys are keys like any other."""
    first = new.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*new.columns), _order(new, F.col(position))).alias("__row")).select("__row.*")
    held = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return first.join(held, test, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The row of the greatest ``version`` for each key; columns in ``keep_first`` keep the value of the least one, so a
    replaced row keeps, say, when it was first seen. A null version is less than any other; of equal versions a new row
    goes before an old one, and ties are by all columns."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    names = [c for c in rows.columns if c != "__new"]
    rest = [c for c in names if c not in keep_first]
    order = _order(rows.select(*names), F.col(version), F.col("__new"))
    known = F.struct(F.col(version).isNull(), order)  # rows without a version say last when something was first
    aggs = [F.max_by(F.struct(*rest), order).alias("__row"), *[F.min_by(c, known).alias(c) for c in keep_first]]
    rows = rows.select(*names, "__new")
    out = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*aggs)
    return out.select("__row.*", *keep_first).select(*names)


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with whole rows replaced by ``new``'s of the same key: columns that ``new`` lacks become null. Of several new
    rows of a key the greatest by all columns stays."""
    wide = new.select(*[(F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType)).alias(c) for c in old.columns])
    blank = old.limit(0)
    return insert_if_absent(wide, old, keys, keys[0]).unionByName(upsert(blank, wide, keys, keys[0]))


def replaced_children(children: DataFrame, new: DataFrame, parent: str, key: str) -> DataFrame:
    """``children`` without those whose ``parent`` is among the replaced rows' ``key``: replacing a row deletes it first."""
    return children.join(new.select(F.col(key).alias("__parent")).distinct(), F.col(parent) == F.col("__parent"), "left_anti")


def update(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` replaced where ``changes`` has the key; a null there is a value. Of several changes of a key
    the greatest by ``columns`` counts, so rows don't multiply."""
    from .trust import check_columns

    check_columns(old, columns)
    side = changes.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*columns)).alias("__new"))
    rows = old.join(side, F.col(key) == F.col("__key"), "left")
    return rows.select(*[F.when(F.col("__key").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete(old: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return old.join(doomed.select(key), key, "left_anti")


def retract(items: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and edges without the doomed items (id); back-references to them become null."""
    gone = doomed.select(F.col("id").alias("__gone")).distinct()
    left = items.join(gone, F.col("id") == F.col("__gone"), "left_anti")
    for c in (c for c in ("supersedes_item_id", "changed_from_item_id", "corrected_item_id") if c in items.columns):
        marked = left.join(gone, F.col(c) == F.col("__gone"), "left")
        left = marked.withColumn(c, F.when(F.col("__gone").isNull(), F.col(c))).drop("__gone")
    for c in ("old_item_id", "new_item_id"):
        edges = edges.join(gone, F.col(c) == F.col("__gone"), "left_anti")
    return left, edges


def retract_links(links: DataFrame, doomed: DataFrame, column: str) -> DataFrame:
    """Links - evidence of claims, matches of submissions - whose ``column`` is not among the doomed ids."""
    gone = doomed.select(F.col("id").alias("__gone")).distinct()
    return links.join(gone, F.col(column) == F.col("__gone"), "left_anti")


def health(spark: SparkSession, tables: dict[str, str], least: int = 1) -> DataFrame:
    """(dependency, ok, n_rows) for named Parquet tables, and ``service``, which is ok if all are: a table is if it can be
    read and has at least ``least`` rows. Rows are counted by the executors; a table that isn't there has none."""
    from pyspark.errors import AnalysisException

    if least < 1:
        raise ValueError("a table that isn't there has no rows, so that at least one has to be asked for")
    found = spark.createDataFrame([], "dependency string, n_rows bigint")
    for name, path in tables.items():
        try:
            rows = spark.read.parquet(path)
        except AnalysisException:
            rows = spark.range(0)
        found = found.unionByName(rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dependency"), "n_rows"))
    each = F.inline(F.array(F.struct("dependency", "n_rows"), F.struct(F.lit("service").alias("dependency"), "n_rows")))
    whole = F.when(F.col("dependency") == "service", F.min("n_rows")).otherwise(F.sum("n_rows"))
    return found.select(each).groupBy("dependency").agg((F.min("n_rows") >= least).alias("ok"), whole.alias("n_rows"))


def chunks(rows: DataFrame, key: str, body: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(key, chunk_index, chunk) of a binary column; an empty body has one empty chunk."""
    count = F.greatest(F.ceil(F.octet_length(body) / size).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col(body), i * size + 1, F.lit(size)))
    return rows.filter(F.col(body).isNotNull()).select(key, F.posexplode(cut).alias("chunk_index", "chunk"))


def reassemble(parts: DataFrame, key: str) -> DataFrame:
    """(key, body): chunks joined in order of their index. A body's own chunks are all that one task gathers."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.hex("chunk").alias("h")))), lambda x: x["h"])
    return parts.groupBy(key).agg(F.unhex(F.array_join(ordered, "")).alias("body"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts over (status, bytes): status FAILED if all failed, PARTIAL if some did, else SUCCEEDED."""
    failed = F.count_if(F.col("status") == "FAILED")
    n = F.count("*")
    said = F.when((n > 0) & (failed == n), "FAILED").when(failed > 0, "PARTIAL").otherwise("SUCCEEDED")
    return outcomes.agg(n.alias("sources"), F.count_if(F.col("status") == "FETCHED").alias("fetched"), F.count_if(F.col("status") == "CHANGED").alias("changed"), failed.alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), said.alias("status"))


def manifest_hash(rows: DataFrame) -> DataFrame:
    """One row: a hash of a table that neither order nor partitions change. Rows are hashed and summed, not gathered."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(rows.columns)]
    one = F.conv(F.substring(F.sha2(F.concat_ws("\u0001", *cols), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(one), F.lit(0)).cast("string")), 256).alias("manifest_sha256"), F.count("*").alias("objects"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, violations) for each named check that a row must pass; a null result passes. One pass over ``df``."""
    counted = df.agg(*[F.count_if(F.coalesce(~c, F.lit(False))).alias(name) for name, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in checks])
    return counted.select(F.explode(pairs).alias("__row")).select("__row.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, if no two share their keys; else an error that names one. Runs a job."""
    if again := duplicate_keys(rows, keys).limit(1).collect():
        raise ValueError(f"duplicate key: {again[0].asDict()}")
    return rows



def one_row(df: DataFrame, what: str) -> dict:
    """The single row of a lookup; anything else is an error."""
    got = df.limit(2).collect()
    if len(got) != 1:
        raise KeyError(what)
    return got[0].asDict()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
