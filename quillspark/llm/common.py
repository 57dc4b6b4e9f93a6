"""What the training-data operators share: text batches for Python workers, shared tables, sample choice."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as Python objects at a time.
CHUNK_BYTES = 2 << 20
#: Rows of a record batch between Spark and a Python worker; texts may be long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece have at most ``limit`` bytes; a longer text stands alone.

    Python's cycle collector rests meanwhile: words and tables of words have no cycles, and there are many of them.
    """
    gc.disable()
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            start, held = 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > limit:
                    yield batch.slice(start, i - start)
                    start, held = i, 0
                held += n
            if start < batch.num_rows:
                yield batch.slice(start)
    finally:
        gc.enable()


class Numbering(dict):
    """Numbers keys in order of first sight; ``new`` lists those that came since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, its session set to hand Python workers batches of at most BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over all shuffle partitions, before each row becomes many: by size alone few would be left."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine if
    all work is done here (a local master), else an error: executors elsewhere would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def materialize(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later steps don't compute it again, and a
    lost executor loses nothing. Void columns aren't allowed. ``held`` takes the path, for remove()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, held: list[str]) -> None:
    """Delete shared tables that nothing reads any more, and forget their paths."""
    for path in held:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    held.clear()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() returned."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(k, y): every id with a label of 0 or 1, once. One that is labelled both ways counts as its greatest label."""
    return labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.max(label).cast("int").alias("y"))


def labelled_sample(labels: DataFrame, id_col: str, label: str, most: int) -> DataFrame:
    """(k, y): of labelled(), at most ``most`` rows with label 0 and as many with label 1, of the least hash of the id."""
    rows = labelled(labels, id_col, label)
    least = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most)
    return least(0).unionByName(least(1))


#: Keys that join_copies() takes by themselves: those with at least a HOT_KEYS-th of all rows, so no more than so many.
HOT_KEYS = 1024


def join_copies(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, one row of it for each ``key``; ``counts`` has (key, copies), the number of
    rows by key. Keys that hold a HOT_KEYS-th of the rows or more - there can't be more of those than HOT_KEYS - meet
    their row of the table by a broadcast, all others by a shuffle in which no key is larger than that."""
    total = counts.agg(F.sum("copies")).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col("copies") >= max(64, -(-total // HOT_KEYS))).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(table.filter(~is_hot), key))


#: Keys that having() sends to every task; 8 bytes each, about 40 as Spark holds them.
SENT_KEYS = 1_000_000


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is one of a written table of ``keys``, nulls included if there is one. At most SENT_KEYS of
    them go to every task, so that the rows stay where they are; more meet the rows in a shuffle."""
    keys = keys.select(F.col(key).alias("__key"))
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, rows[key].eqNullSafe(F.col("__key")), "left_semi")
