"""Vector search over an embedding column: exact top-k, score threshold, metadata filters, MMR.

A search takes a stated set of query vectors against all vectors, in blocks.
Each task multiplies its vectors with the query matrix and keeps its
own best k per query, so that only k rows per query and task are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: About so many query vectors are broadcast at once; more are taken in further blocks.
MAX_QUERIES = 10_000
#: Vectors and queries that a task multiplies at once, and pairs that it scores in double precision at once.
ROWS, QUERIES, PAIRS = 1024, 512, 1 << 16


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """queries, dealt by hash of the id into blocks of about MAX_QUERIES rows at most."""
    n = -(-queries.count() // MAX_QUERIES)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision, rounded to 6 digits; null for a zero vector."""
    return F.round(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), 6)


def score_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of each query vector with each vector but itself: (qid, vec_id, label, score).

    queries: (qid, qvec), any number; they are broadcast in blocks.
    """
    each = [
        vectors.join(F.broadcast(block), F.col("vec_id") != F.col("qid")).select("qid", "vec_id", "label", cosine(F.col("embedding"), F.col("qvec")).alias("score"))
        for block in _blocks(queries)
    ]
    return reduce(DataFrame.unionAll, each)


def ranked(scored: DataFrame, k: int, key: str = "qid", item: str = "vec_id", score: str = "score") -> DataFrame:
    """The k best items of each key in a total order, with rank from 1."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k of many query vectors by blocked matrix products: (qid, vec_id, score, rank).

    A vector is never its own neighbour (by id). Null and zero vectors have no neighbours and are none.
    Of several blocks of queries each is searched and written to the checkpoint folder before the next is read;
    vectors and queries are computed once, however many blocks there are.
    """
    packed = _packed(vectors, k)
    if -(-queries.count() // MAX_QUERIES) <= 1:
        return _knn_block(packed, queries, k)
    packed, queries = checkpointed(packed), checkpointed(queries)
    return reduce(DataFrame.unionAll, [checkpointed(_knn_block(packed, block, k)) for block in _blocks(queries)])


def _placed(*order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of the keys (the last is the first, as in lexsort), and each one's place among those of an equal last key."""
    rows = np.lexsort(order)
    key = order[-1][rows]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return rows, np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def _packed(vectors: DataFrame, k: int) -> DataFrame:
    """vectors as (n, ids, data): up to ROWS ids of 64 bits, and their vectors in double precision, compressed.

    Zero vectors are left out. Of equal vectors in a batch the k + 1 of least id are kept: no search of depth k returns another.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, rows = batch.drop_null(), []
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, data = part.column("vec_id").to_numpy(zero_copy_only=False), _matrix(part.column("embedding"))
                known = np.sqrt((data * data).sum(axis=1)) > 0
                ids, data = ids[known], data[known]
                if len(ids):
                    _, same = np.unique(data.view(f"V{data.shape[1] * 8}").ravel(), return_inverse=True)
                    order, place = _placed(ids, same)
                    kept = np.sort(order[place <= k])
                    rows.append((len(kept), ids[kept].tobytes(), zlib.compress(data[kept].tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["n", "ids", "data"])

    # nulls are left out by the task: a filter would compute the embeddings once more
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(pack, "n long, ids binary, data binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.ascontiguousarray(flat.reshape(len(column), -1))


class _Best:
    """The k best of all the vectors met, for each query (a row of matrix).

    Products in single precision of normalised vectors show which pairs may be among the best;
    only those are scored in double precision. margin bounds the error of the former and of rounding the latter.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.norm = np.sqrt((matrix * matrix).sum(axis=1))
        self.unit = (matrix / self.norm[:, None]).astype(np.float32)
        self.margin = (matrix.shape[1] + 8) * 2.0**-24 + 1e-6
        self.score, self.vec = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, vec: np.ndarray, data: np.ndarray) -> None:
        norm = np.sqrt((data * data).sum(axis=1))
        unit = np.ascontiguousarray((data / norm[:, None]).astype(np.float32).T)
        # columns without a vector fill the rows up to whole words of the mask
        unit = np.concatenate([unit, np.full((len(unit), -len(vec) % 8), np.nan, np.float32)], axis=1)
        for at in range(0, len(self.ids), QUERIES):
            near = self.unit[at : at + QUERIES] @ unit
            least = self.score[at : at + QUERIES, -1] - self.margin
            new = np.flatnonzero(np.isneginf(least))
            if len(new) and len(vec) > self.k + 1:
                # fewer than k are known: one of the k + 1 best may be the query itself
                approximate = np.where(np.isnan(near[new, : len(vec)]), -np.inf, near[new, : len(vec)])
                least[new] = np.partition(approximate, -self.k - 1, axis=1)[:, -self.k - 1] - 2 * self.margin
            words = np.flatnonzero((near >= least.astype(np.float32)[:, None]).ravel().view(np.uint64))
            if len(words):
                flat = (words[:, None] * 8 + np.arange(8)).ravel()
                row, column = np.divmod(flat, near.shape[1])
                met = near[row, column] >= least.astype(np.float32)[row]
                self._merge(at + row[met], column[met], vec, data, norm)

    def _merge(self, row: np.ndarray, column: np.ndarray, vec: np.ndarray, data: np.ndarray, norm: np.ndarray) -> None:
        for lo in range(0, len(row), PAIRS):
            r, c = row[lo : lo + PAIRS], column[lo : lo + PAIRS]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                score = np.round(np.einsum("ij,ij->i", data[c], self.matrix[r]) / (norm[c] * self.norm[r]), 6)
            known = np.isfinite(score) & (vec[c] != self.ids[r])
            r, c, score = r[known], c[known], score[known]
            met = np.unique(r)
            r, ids, score = np.concatenate([r, np.repeat(met, self.k)]), np.concatenate([vec[c], self.vec[met].ravel()]), np.concatenate([score, self.score[met].ravel()])
            order, place = _placed(ids, -score, r)
            order, place = order[place < self.k], place[place < self.k]
            self.score[r[order], place], self.vec[r[order], place] = score[order], ids[order]

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.vec[row, place]), pa.array(self.score[row, place])], names=["qid", "vec_id", "score"])


def _knn_block(packed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    table = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec")).toArrow().drop_null()
    ids = table.column("qid").to_numpy()
    matrix = _matrix(table.column("qvec").combine_chunks()) if len(ids) else np.empty((0, 0))
    known = np.sqrt((matrix * matrix).sum(axis=1)) > 0
    ids, matrix = ids[known], matrix[known]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, matrix, k)
        for batch in batches:
            for vec, data in zip(batch.column("ids").to_pylist(), batch.column("data").to_pylist(), strict=True) if len(ids) else ():
                vec = np.frombuffer(vec, np.int64)
                best.add(vec, np.frombuffer(zlib.decompress(data)).reshape(len(vec), -1))
        yield best.found()

    return ranked(packed.mapInArrow(block, "qid long, vec_id long, score double"), k)


def mmr(pool: DataFrame, vectors: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over a ranked pool of a fixed size per query: (qid, pick, vec_id).

    Greedy: the first pick is the most relevant, each further pick maximises
    weight * relevance - (1 - weight) * (largest cosine with a pick so far).
    Ties go to the smaller vec_id.
    """
    items = pool.join(vectors.select("vec_id", "embedding"), "vec_id").select("qid", "vec_id", "score", "embedding")

    def picks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "vec_id"], ascending=[False, True], ignore_index=True)
        data = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        data /= np.maximum(np.sqrt((data * data).sum(axis=1)), 1e-300)[:, None]
        rel, ids = pdf["score"].to_numpy(), pdf["vec_id"].to_numpy()
        cos = np.round(data @ data.T, 6)
        chosen: list[int] = []
        for _ in range(min(k, len(pdf))):
            value = rel if not chosen else np.round(weight * rel - (1 - weight) * cos[:, chosen].max(axis=1), 6)
            value = np.where(np.isin(np.arange(len(pdf)), chosen), -np.inf, value)
            chosen.append(int(np.lexsort((ids, -value))[0]))
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "pick": range(1, len(chosen) + 1), "vec_id": ids[chosen]})

    return items.groupBy("qid").applyInPandas(picks, "qid long, pick int, vec_id long")
