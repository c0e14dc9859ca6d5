"""Language identification by interpolated Kneser-Ney character models.

One model of order ORDER per language, learned from a bounded sample of documents with a
known language. Texts are lower-cased, and runs of anything but letters become one
space. Each order's n-grams of all languages share one sorted array of hashes, with a row
of log-probabilities, one column a language; back-off weights of histories are kept the same
way. A text's language is the one with the lowest cross-entropy per character. Its score is
a softmax of the cross-entropies with a temperature fitted on further known documents.
On these also the bound of rejection is calibrated: the least score from which on at least PRECISION of the answers
are right. A text is rejected where it has no letter, or where its score is below that bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import pieces, table, texts

#: Order of the models; documents of each language that they are learned from at most, and that fit the temperature; languages at most.
ORDER, TRAIN_ROWS, FIT_ROWS, MAX_LANGUAGES = 4, 1000, 200, 200
#: Documents ranked for the sample, as a multiple of those taken.
MARGIN = 4
#: Characters that count for the score's softmax at most, and the temperatures tried.
SCORE_CHARS, TEMPERATURES = 400, np.geomspace(0.01, 4, 40)
#: Share of right answers that the bound of rejection keeps, among the known documents it is fitted on.
PRECISION = 0.99
#: Code points assumed for the uniform distribution below the lowest order.
ALPHABET = 1 << 16
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def encode(text: str, order: int = ORDER) -> np.ndarray:
    """Code points of the text as the models read it, after order - 1 spaces; only those if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    pad = np.full(order - 1, 32, np.uint32)
    if not letter.any():
        return pad
    codes = np.where(letter, codes, np.uint32(32))
    space = ~letter
    return np.concatenate([pad, codes[~(space & np.concatenate([[True], space[:-1]]))]])


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams given as columns of code points."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for j in range(grams.shape[1]):
        h = (h ^ grams[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _sums(grams: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of weight of each, and where each input row went."""
    rows, back = np.unique(grams, axis=0, return_inverse=True)
    back = back.ravel()
    return rows, np.bincount(back, weight, len(rows)), back


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1: (n-grams, their probabilities, histories, their back-off weights).

    grams: distinct n-grams of the highest order as rows of code points, with their counts. Lower
    orders count the distinct characters before an n-gram.
    """
    levels, at, n = [], grams, counts.astype(np.float64)
    while True:
        levels.append((at, n))
        if at.shape[1] == 1:
            break
        at, n, _ = _sums(at[:, 1:], np.ones(len(at)))
    out = []
    for at, n in reversed(levels):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))
        history, total, back = _sums(at[:, :-1], n) if at.shape[1] > 1 else (np.empty((1, 0), at.dtype), np.array([n.sum()]), np.zeros(len(at), np.int64))
        kinds = np.bincount(back, minlength=len(history))
        weight = discount * kinds / total
        if out:
            lower, p, _, _ = out[-1]
            order = np.argsort(_hash(lower))
            below = p[order[np.searchsorted(_hash(lower)[order], _hash(at[:, 1:]))]]
        else:
            below = np.full(len(at), 1 / ALPHABET)
        out.append((at, (n - discount) / total[back] + weight[back] * below, history, weight))
    return out


class Models:
    """All languages' models. grams[n], logs[n]: hashes and log-probabilities of order n + 1; histories[n], weights[n]: of their histories."""

    def __init__(self, by_language: dict[str, list]):
        self.languages = sorted(by_language)
        self.temperature, self.reject_below = 1.0, 0.0
        self.order = ORDER
        columns = len(self.languages)
        self.grams, self.logs, self.histories, self.weights = [], [], [], []
        for n in range(self.order if columns else 0):
            parts = [by_language[x][n] for x in self.languages]
            hashes, where = [_hash(p[0]) for p in parts], [_hash(p[2]) if n else np.zeros(1, np.uint64) for p in parts]
            grams, histories = np.unique(np.concatenate(hashes)), np.unique(np.concatenate(where))
            weights = np.zeros((len(histories), columns), np.float32)
            for k, p in enumerate(parts):
                weights[np.searchsorted(histories, where[k]), k] = np.log(p[3])
            self.histories.append(histories)
            self.weights.append(weights)
            logs = np.full((len(grams), columns), np.nan, np.float32)
            for k, p in enumerate(parts):
                logs[np.searchsorted(grams, hashes[k]), k] = np.log(p[1])
            if n:  # what a language has not seen backs off, here once and for all
                every = np.unique(np.concatenate([p[0] for p in parts]), axis=0)
                key = _hash(every)
                gone = np.isnan(logs[np.searchsorted(grams, key)])
                rest = self._weight(n, every[:, :-1]) + self._logs(n - 1, every[:, 1:])
                at = np.searchsorted(grams, key)
                logs[at] = np.where(gone, rest, logs[at])
            else:
                logs = np.where(np.isnan(logs), weights[0] - np.float32(np.log(ALPHABET)), logs)
            self.grams.append(grams)
            self.logs.append(logs)

    @staticmethod
    def _find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(array, keys)
        at[at == len(array)] = 0
        return at, array[at] == keys

    def _weight(self, n: int, history: np.ndarray) -> np.ndarray:
        at, known = self._find(self.histories[n], _hash(history))
        return np.where(known[:, None], self.weights[n][at], np.float32(0))

    def _logs(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities (natural) of the last character of each n-gram given those before it."""
        at, known = self._find(self.grams[n], _hash(grams))
        out = self.logs[n][at]
        if not known.all():
            gone = ~known
            out[gone] = self._weight(n, grams[gone, :-1]) + self._logs(n - 1, grams[gone, 1:]) if n else self.weights[0][0] - np.float32(np.log(ALPHABET))
        return out

    def entropies(self, docs: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character (natural) of each encoded text under each language; nan without letters."""
        pad, out = self.order - 1, np.full((len(docs), len(self.languages)), np.nan)
        held = [i for i, x in enumerate(docs) if len(x) > pad]
        if held and self.languages:
            joined = np.concatenate([docs[i] for i in held])
            sizes = np.array([len(docs[i]) for i in held])
            starts = np.cumsum(sizes) - sizes
            own = np.ones(len(joined), bool)
            for k in range(pad):
                own[starts + k] = False
            where = np.flatnonzero(own)
            view = np.lib.stride_tricks.sliding_window_view(joined, self.order)
            total = np.zeros((len(held), len(self.languages)))
            doc = np.repeat(np.arange(len(held)), sizes - pad)
            for at in range(0, len(where), 1 << 19):
                block = slice(at, at + (1 << 19))
                logs = self._logs(self.order - 1, view[where[block] - pad])
                first = np.concatenate([[0], np.flatnonzero(np.diff(doc[block])) + 1])
                total[doc[block][first]] += np.add.reduceat(logs.astype(np.float64), first, axis=0)
            out[held] = -total / (sizes - pad)[:, None]
        return out

    def scores(self, entropies: np.ndarray, sizes: np.ndarray, temperature: float | None = None) -> np.ndarray:
        """Probabilities of the languages."""
        logits = -(temperature or self.temperature) * np.minimum(sizes, SCORE_CHARS)[:, None] * entropies
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(known: DataFrame, rows: int = TRAIN_ROWS, fit_rows: int = FIT_ROWS) -> Models:
    """Models of the languages of known (doc_id, text, lang); rows bounds the documents of a language, those of least hashed id."""
    usable = known.where("lang is not null and doc_id is not null and text is not null and text <> ''")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Hashes are spread evenly, so the least few of a language lie below a bound, and only those few are ranked in one task.
    bounds = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, (MARGIN * (rows + fit_rows) + 1000) / n))]) if sizes else F.lit(None).cast("map<string,double>")
    place = (F.xxhash64("doc_id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = usable.select("doc_id", "lang").where(place <= bounds[F.col("lang")])
    chosen = few.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rows + fit_rows)
    mine = usable.select("doc_id", F.col("lang").alias("own"), "text").join(F.broadcast(chosen), "doc_id").where("own = lang").select("lang", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            lang, codes = piece.column("lang").to_pylist(), [encode(x) for x in texts(piece)]
            for name in sorted(set(lang)):
                grams = [np.lib.stride_tricks.sliding_window_view(x, ORDER) for x, y in zip(codes, lang, strict=True) if y == name and len(x) >= ORDER]
                if grams:
                    bytes_ = np.ascontiguousarray(np.concatenate(grams)).view(f"V{4 * ORDER}").ravel()
                    rows_, n = np.unique(bytes_, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array([x.tobytes() for x in rows_], pa.binary()), pa.array(n)], names=["lang", "gram", "n"])

    learn = mine.where(F.col("rank") <= rows).mapInArrow(run, "lang string, gram binary, n long")
    counted = learn.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    by_language = {}
    for name in sorted(set(counted.column("lang").to_pylist())):
        own = counted.filter(pc.equal(counted.column("lang"), name)).sort_by("gram")
        grams = np.frombuffer(b"".join(own.column("gram").to_pylist()), "<u4").reshape(-1, ORDER)
        by_language[name] = kneser_ney(grams, own.column("n").to_numpy())
    models = Models(by_language)
    check = mine.where(F.col("rank") > rows).toArrow()
    held = [(encode(t), models.languages.index(x)) for x, t in zip(check.column("lang").to_pylist(), check.column("text").to_pylist(), strict=True) if x in by_language]
    held = [(x, y) for x, y in held if len(x) >= ORDER]
    if held and len(models.languages) > 1:
        entropies, sizes = models.entropies([x for x, _ in held]), np.array([len(x) - ORDER + 1 for x, _ in held])
        truth = np.array([y for _, y in held])
        loss = [-np.log(np.maximum(models.scores(entropies, sizes, t)[np.arange(len(truth)), truth], 1e-4)).mean() for t in TEMPERATURES]
        models.temperature = float(TEMPERATURES[int(np.argmin(loss))])
        scores = models.scores(entropies, sizes)
        models.reject_below = calibrate(scores.max(axis=1), np.argmin(entropies, axis=1) == truth)
    return models


def calibrate(scores: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> float:
    """The least bound such that of the answers with that score or more a share of precision is right; above all scores if there is none."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(right[order]) / (np.arange(len(order)) + 1)
    last = np.append(np.diff(scores[order]) != 0, True)  # equal scores are taken together
    good = np.flatnonzero((share >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else float(np.nextafter(scores.max(), 2)) if len(scores) else 0.0


def identify(docs: DataFrame, models: Models, reject: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), from texts alone.

    A null text or one without letters is und with score 0 and rejected, and so is every text if no
    language was learned. A text whose score is below the models' calibrated bound is rejected; with reject its lang_pred is und
    too. Equal texts get equal answers; ties go to the language whose name sorts first. Further columns are ignored; an empty
    table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for piece in pieces(batches):
            codes = [encode(x) for x in texts(piece)]
            sizes = np.array([len(x) - own.order + 1 for x in codes])
            names, scores, rejected = [UNDETERMINED] * len(codes), np.zeros(len(codes)), np.ones(len(codes), bool)
            held = np.flatnonzero(sizes > 0)
            if len(held) and own.languages:
                entropies = own.entropies([codes[i] for i in held])
                best = np.argmin(entropies, axis=1)
                scores[held] = own.scores(entropies, sizes[held])[np.arange(len(held)), best]
                rejected[held] = scores[held] < own.reject_below
                for i, k in zip(held.tolist(), best.tolist(), strict=True):
                    if not (reject and rejected[i]):
                        names[i] = own.languages[k]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id has 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(1))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, fit(docs.where(fold() != 0)))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "rejected")
