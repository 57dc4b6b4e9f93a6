"""The nearest vectors of many query vectors at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that one reading of the rows takes along; more queries make more readings.
BLOCK_BYTES = 32 << 20
#: Queries and rows of one matrix product.
QUERIES, ROWS = 512, 2048
#: More than a product of unit vectors can be off by.
SLACK = 1e-9


def _packed(vector: Column, size: int) -> Column:
    """The vector as doubles; zeros if it is null, has another size, or a component that is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    sound = F.coalesce((F.size(vector) == size) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(sound, values).otherwise(F.array_repeat(F.lit(0.0), size))


def nearest(vectors: DataFrame, queries: DataFrame, most: int, key: str = "id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): for each of ``queries`` (key, vector) its ``most`` rows of ``vectors`` (key, vector) by
    cosine, then key: what named.vector_top() gives for each query. A query that is a row meets itself.

    All queries must have one length. A row that is null, of another length, without a norm, or with a component that
    is null or not finite has score 0, and so have all rows for such a query. Keys are unique and not null.

    Queries go in blocks of ``block_bytes``, which is all that the driver and a task hold of them; each block reads the
    rows once, so none meets all others in a join. In a task, products of matrices find which rows may come among the
    best so far; only these have their score summed, in the order of the components, so that it doesn't depend on
    the batch. Of equal rows in a batch only the first by key are looked at. Each task sends its best rows only.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    sizes = [r[0] for r in queries.filter(F.col(vector).isNotNull()).select(F.size(vector)).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("queries must have one length")
    size = sizes[0] if sizes and sizes[0] else 1
    rows, asked = (df.select(F.col(key).alias("id"), _packed(F.col(vector), size).alias("v")) for df in (vectors, queries))
    kind = rows.schema["id"].dataType.simpleString()
    if asked.schema["id"].dataType.simpleString() != kind:
        raise ValueError("queries and vectors must have keys of one type")
    blocks = max(1, -(-asked.count() * size * 8 // block_bytes))
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        one = rows.mapInArrow(_best(part.column("id").combine_chunks(), _matrix(part.column("v").combine_chunks(), size), most, size), f"query_id {kind}, id {kind}, score double")
        out = one if out is None else out.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", "rank", "id", "score")


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, size)


def _best(query_ids: pa.Array, asked: np.ndarray, most: int, size: int):
    """A function of record batches (id, v): the best rows of each query among all that a task reads."""
    n_queries, per_step, per_slice, slack = len(query_ids), QUERIES, ROWS, SLACK

    def matrix(lists: pa.Array) -> np.ndarray:
        return np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, size)

    def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for i in range(size):  # component by component, as a plain sum goes
            total += a[:, i] * b[:, i]
        return total

    def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt(summed(m, m))
        return norm, np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)

    def first_of_equal(m: np.ndarray) -> np.ndarray:
        """The places of the first ``most`` rows of each group of equal rows; rows are in order of their keys."""
        whole = np.ascontiguousarray(m + 0.0).view(np.dtype((np.void, size * 8))).ravel()  # -0.0 is 0.0
        order = np.argsort(whole, kind="stable")
        same = np.concatenate([[False], whole[order][1:] == whole[order][:-1]])
        starts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        return np.sort(order[np.arange(len(order)) - starts < most])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms, units = unit(asked)
        # By query: the scores of its best rows so far and their keys, which stand in ``keys`` in their order.
        scores = np.full((n_queries, most), -np.inf)
        held = np.full((n_queries, most), -1, dtype=np.int64)
        keys = query_ids.slice(0, 0)

        def take(ids: pa.Array, m: np.ndarray) -> None:
            nonlocal keys, held
            # Keys of rows that are held and of the slice, by rank, so that ties are settled by numbers.
            both = pa.concat_arrays([keys, ids.cast(keys.type)])
            order = np.asarray(pc.array_sort_indices(both))
            rank = np.empty(len(both), dtype=np.int64)
            rank[order] = np.arange(len(both))
            keys, held = both.take(pa.array(order)), np.where(held >= 0, rank[held], -1)
            mine = rank[len(both) - len(ids) :]
            by_key = np.argsort(mine)
            m, mine = m[by_key], mine[by_key]
            first = first_of_equal(m)
            m, mine = m[first], mine[first]
            norm, u = unit(m)
            for at in range(0, n_queries, per_step):
                s = slice(at, min(at + per_step, n_queries))
                near = units[s] @ u.T
                least = scores[s, -1].copy()
                if near.shape[1] >= most:
                    least = np.maximum(least, np.partition(near, -most, axis=1)[:, -most] - slack)
                q, r = np.nonzero(near >= least[:, None] - slack)
                if not len(q):
                    continue
                lengths = norms[s][q] * norm[r]
                exact = np.divide(summed(m[r], asked[s][q]), lengths, out=np.zeros(len(q)), where=lengths > 0)
                # What was held and what comes, best first; the first ``most`` of each query stay.
                n = s.stop - s.start
                all_q = np.concatenate([np.repeat(np.arange(n), most), q])
                all_s = np.concatenate([scores[s].ravel(), exact])
                all_k = np.concatenate([held[s].ravel(), mine[r]])
                by = np.lexsort((all_k, -all_s, all_q))
                starts = np.searchsorted(all_q[by], np.arange(n))
                chosen = by[(starts[:, None] + np.arange(most)).ravel()]
                scores[s], held[s] = all_s[chosen].reshape(n, most), all_k[chosen].reshape(n, most)
            used = np.unique(held[held >= 0])
            keys, held = keys.take(pa.array(used)), np.where(held >= 0, np.searchsorted(used, held), -1)

        for b in batches:
            whole = matrix(b.column(1))
            for at in range(0, b.num_rows, per_slice):
                take(b.column(0).slice(at, per_slice), whole[at : at + per_slice])
        q, k = np.nonzero(held >= 0)
        for at in range(0, len(q), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q[part])), keys.take(pa.array(held[q[part], k[part]])), pa.array(scores[q[part], k[part]])], ["query_id", "id", "score"])

    return run
