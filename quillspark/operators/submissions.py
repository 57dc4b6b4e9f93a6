"""Submitted texts against an archive: scores, best matches, verdicts, review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

# Fixed values.
KEEP, STRONG, BEST = 0.15, 0.35, 5
#: From the weakest to the strongest.
VERDICTS = ("UNVERIFIED", "MATCHED", "CONFLICTING")
#: Columns of the archive that give dates, which a title does not; times among them count by their day.
DATED, TIMES = ("summary", "statement", "due_at", "starts_at"), ("due_at", "starts_at")


def _classes(rows: DataFrame, told: Column, dated: Column, tokens: Callable[[Column], Column], dates: Callable[[Column], Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id) of the same texts, ``told`` for tokens and ``dated`` for dates, are a class. Returns the keys of each class
    once (``name``, its number of tokens ``n_name``, kind, key), where kind is t for a token and d for a date, and the
    members (``name``, id). Rows without a token have no keys, as they score with nothing."""
    key = F.unhex(F.substring(ids.sha(F.sha2(told, 256), F.sha2(dated, 256)), 1, 32)).alias(name)
    sets = rows.select(key, tokens(told).alias("t"), dates(dated).alias("d")).filter(F.array_size("t") > 0).distinct()
    of = lambda kind: F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    keys = sets.select(name, F.array_size("t").alias(f"n_{name}"), F.explode(F.concat(of("t"), of("d"))).alias("k"))
    return keys.select(name, f"n_{name}", "k.kind", "k.key"), rows.select(key, "id")


def scores(submissions: DataFrame, archive: DataFrame, keep: float = KEEP, stop_words: tuple[str, ...] = (), dates: Callable[[Column], Column] = text.date_tokens, dated: tuple[str, ...] = DATED) -> DataFrame:
    """(submission_id, item_id, score, shared, date_hit) of pairs that score ``keep`` or more.

    Only pairs that share a token can score, apart from the date bonus, which alone reaches ``keep``: so pairs meet on
    tokens and on dates. The overlap is the number of tokens on which a pair meets, so token sets travel once. Rows of
    equal texts meet as one class, and pairs of rows are made last, so that none of them is shuffled and an id that comes
    twice counts no token twice. Of the archive, ``title``, ``summary`` and, if there, ``statement`` give tokens, and
    those of the columns ``dated`` that are there give dates, which ``dates`` finds.
    """
    told = [c for c in ("summary", "statement") if c in archive.columns]
    named = F.concat_ws(" ", *[F.date_format(c, "yyyy-MM-dd") if c in TIMES else F.col(c) for c in dated if c in archive.columns])
    tokens = lambda c: text.content_tokens(c, stop_words)
    sent, senders = _classes(submissions, F.col("text"), F.col("text"), tokens, dates, "a")
    kept, items = _classes(archive, F.concat_ws(" ", "title", *told), named, tokens, dates, "b")
    met = sent.join(kept, ["kind", "key"]).groupBy("a", "b", "n_a", "n_b").agg(F.count_if(F.col("kind") == "t").alias("shared"), F.bool_or(F.col("kind") == "d").alias("date_hit"))
    n = F.col("shared")
    # Decimal weights, rounded once, as the SQL has them: 0.55 is no double, and a score at a limit hangs on its rounding.
    score = F.least(F.lit(1.0), 55 * n / 100 / (F.col("n_a") + F.col("n_b") - n) + 30 * n / 100 / F.col("n_a") + F.when(F.col("date_hit"), 0.15).otherwise(0.0))
    pairs = met.select("a", "b", score.alias("score"), "shared", "date_hit").filter(F.col("score") >= keep)
    pairs = pairs.join(items.withColumnRenamed("id", "item_id"), "b").join(senders.withColumnRenamed("id", "submission_id"), "a")
    return pairs.select("submission_id", "item_id", "score", "shared", "date_hit")


def best(scored: DataFrame, most: int = BEST) -> DataFrame:
    """The ``most`` best matches of each submission, by score, then item."""
    order = Window.partitionBy("submission_id").orderBy(F.desc("score"), "item_id")
    reason = F.concat(F.col("shared").cast("string"), F.lit(" shared tokens"), F.when(F.col("date_hit"), "; matching date").otherwise(""))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumn("reason", reason)


def classify(submissions: DataFrame, scored: DataFrame, conflicting: DataFrame, strong: float = STRONG) -> DataFrame:
    """(submission_id, verdict), once for each id: UNVERIFIED without a strong match, CONFLICTING if a strong one is in a
    conflict (``conflicting``: item_id), else MATCHED."""
    hits = scored.filter(F.col("score") >= strong).join(conflicting.select("item_id").distinct().withColumn("bad", F.lit(True)), "item_id", "left")
    by = hits.groupBy("submission_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    return submissions.select(F.col("id").alias("submission_id")).distinct().join(by, "submission_id", "left").select("submission_id", F.when(F.col("bad").isNull(), "UNVERIFIED").when(F.col("bad"), "CONFLICTING").otherwise("MATCHED").alias("verdict"))


def strongest(verdicts: DataFrame) -> DataFrame:
    """One verdict for each submission_id of several: those of all its texts together."""
    order = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("verdict"))
    return verdicts.groupBy("submission_id").agg(F.max_by("verdict", order).alias("verdict"))


def review_queue(verdicts: DataFrame, scored: DataFrame) -> DataFrame:
    """What people must look at: conflicting submissions, and unverified ones that came close."""
    top = scored.groupBy("submission_id").agg(F.max("score").alias("top_score"))
    rows = verdicts.join(top, "submission_id", "left")
    return rows.filter("verdict = 'CONFLICTING' OR (verdict = 'UNVERIFIED' AND top_score IS NOT NULL)").select("submission_id", "verdict", F.coalesce("top_score", F.lit(0.0)).alias("top_score"))


def batch(submissions: DataFrame, archive: DataFrame, conflicts: DataFrame, folder: str) -> DataFrame:
    """One relation of all that a verification run reads: its rows by ``part`` (submission, item, conflict), columns that
    a part lacks null. A submission with an ``object_key`` gets ``object_file``, its file below ``folder``."""
    files = F.when(F.coalesce(F.col("object_key"), F.lit("")) != "", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("id")))
    parts = (("submission", submissions.withColumn("object_file", files)), ("item", archive), ("conflict", conflicts))
    first, *rest = [rows.withColumn("part", F.lit(name)) for name, rows in parts]
    for rows in rest:
        first = first.unionByName(rows, allowMissingColumns=True)
    return first
