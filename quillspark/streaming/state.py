"""Incremental forms: once-only notifications, claim states over time, new content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import submissions
from ..operators.claims import TRANSITIONS

KEYS = ["user_id", "item_id", "kind", "key"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on disk instead of in the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files; the table may be a folder or a single file."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def once_only(stream: DataFrame, time: str = "ts", delay: str = "2 days", keys: list[str] = KEYS) -> DataFrame:
    """Each key once while rows are at most ``delay`` late; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def new_content(stream: DataFrame, time: str = "fetched_at", delay: str = "30 days") -> DataFrame:
    """Fetches whose content their source had not shown within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source_id", "content_hash"])


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that claims notifications in a ledger of Parquet folders, one for each batch.

    A batch run again overwrites its own folder and looks only at the folders of earlier batches, so it claims the same
    rows again. SENT and PENDING rows suppress; FAILED and SKIPPED ones are retried by a later row.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy(*KEYS).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
        if number:
            earlier = [f"{path}/batch={i}" for i in range(number)]
            held = spark.read.parquet(*earlier).filter(F.col("status").isin("SENT", "PENDING")).select(*KEYS)
            rows = rows.join(held, KEYS, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def queue_sink(path: str, archive: DataFrame, strong: float = submissions.STRONG) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that holds queued submissions (id, text) against a static archive (id, title, summary,
    in_conflict) and writes their verdicts, one folder for each batch; a batch run again overwrites its own. An id that
    comes in several batches has a verdict in each: ``queue_verdicts`` reads one for each id."""

    def run(batch: DataFrame, number: int) -> None:
        scored = submissions.scores(batch, archive, dated=submissions.DATED)
        bad = archive.filter("in_conflict").select(F.col("id").alias("item_id"))
        submissions.classify(batch, scored, bad, strong).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def queue_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(submission_id, verdict) of what ``queue_sink`` wrote, the same under any cut into batches."""
    return submissions.strongest(spark.read.parquet(path).select("submission_id", "verdict"))


def claim_states(stream: DataFrame, delay: str = "7 days", keep_days: int = 365) -> DataFrame:
    """(claim_id, ts, state, accepted) for each event (claim_id, ts, next_state): the state after it. Events of a batch
    are taken in order of time; an illegal move leaves the state and is not accepted. A claim starts UNVERIFIED, and is forgotten
    when the watermark has passed its last event by ``keep_days``."""
    legal = {k: frozenset((*v, k)) for k, v in TRANSITIONS.items()}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else "UNVERIFIED"
        f = pd.concat(list(frames)).sort_values(["ts", "next_state"])
        states, good = [], []
        for wanted in f["next_state"]:
            good.append(wanted in legal[now])
            now = wanted if good[-1] else now
            states.append(now)
        state.update((now,))
        last = int(f["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_days * 24 * 3600 * 1000)
        yield pd.DataFrame({"claim_id": key[0], "ts": f["ts"], "state": states, "accepted": good})

    return stream.withWatermark("ts", delay).groupBy("claim_id").applyInPandasWithState(run, "claim_id string, ts timestamp, state string, accepted boolean", "state string", "append", "EventTimeTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, into Parquet, and read it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
