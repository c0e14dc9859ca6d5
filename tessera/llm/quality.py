"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence is a log-likelihood ratio for each defect (low quality,
toxic): a logistic regression over words, word beginnings and style marks whose log-odds
among labelled documents are clear. Over all documents,
the evidence's expected counts are aggregated by host and by path within the host.
A host's rate is shrunk toward the global rate and a path's toward its host's, by prior
strengths that the spread of the rates themselves gives. A document's posterior is
its own evidence plus its path's shrunk log-odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fits, pieces, table, texts
from tessera.session import checkpointed

#: Labelled documents that the classifier is fitted on at most (those of least hashed id), and of these each near copy once.
TRAIN_ROWS = 20_000
#: A feature is taken if it is in MIN_COUNT documents and its log-odds are SIGNIFICANT standard errors from 0 (a word's, above 0).
MIN_COUNT, SIGNIFICANT = 5, 2.5
#: Letters of a word's beginning that are a feature of their own, ridge penalty and steps of the regression.
BEGINNING, RIDGE, STEPS = 5, 0.1, 400
#: A document is rejected if a defect's posterior is above this.
REJECT = 0.5
#: Parts into which a site's documents are dealt where the sites' rates are too large to broadcast.
SALTS = 16
#: Bounds of a site's prior strength, in documents.
STRENGTH = (1.0, 1e6)
DEFECTS = ("low", "toxic")

_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in (b"AZ", b"az", b"09"))
_SIGNS = {"!": b"!", "|": b"|", "#": b"#$%&*", "<": b"<>{}="}
_BINS = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8, 0.95, 1.5, 2.5)


def _bin(x: float) -> int:
    return int(np.searchsorted(_BINS, x))


def features(text: str) -> set[str]:
    """The words (runs of letters, lower case), their beginnings and style marks of a text; an empty text has the mark of no words."""
    words = _LETTERS.findall(text.lower())
    found = set(words)
    again = sum(map(eq, words, words[1:]))
    data = text.encode()
    n = max(1, len(words))
    without = lambda chars: len(data) - len(data.translate(None, chars))
    upper, lower = without(_UPPER), without(_LOWER)
    size = len(words).bit_length()
    lines = [x for x in text.split("\n") if x]
    marks = {f"~size {size}", f"~upper {_bin(upper / max(1, upper + lower))}", f"~digit {_bin(without(_DIGIT) / max(1, len(data)))}", f"~unique {min(size, 10)} {_bin(len(found) / n)}", f"~lines {_bin(len(set(lines)) / max(1, len(lines)))}", f"~again {_bin(again / n)}", f"~word {min(20, round(sum(map(len, words)) / n))}"}
    marks |= {f"~sign {name} {_bin(without(chars) / n)}" for name, chars in _SIGNS.items()}
    return found | {"^" + w[:BEGINNING] for w in found if len(w) > BEGINNING} | marks


def _signature(text: str) -> int:
    """The least hash of five-word shingles: near copies mostly share it."""
    words = text.split()
    joined = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(map(xxhash.xxh64_intdigest, joined)) - (1 << 63)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, low, toxic, found) for at most rows labelled documents.

    Of labels that contradict each other the defect holds; of several texts with one id the one with the least signature is read.
    """
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    chosen = (
        known.groupBy("doc_id")
        .agg(F.max(F.col("quality") == 0).alias("low"), F.max(F.col("toxic") == 1).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = texts(piece)
            columns = [piece.column(c) for c in ("doc_id", "low", "toxic")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([_signature(x) for x in found], pa.int64()), pa.array([sorted(features(x)) for x in found], pa.list_(pa.string()))], names=["doc_id", "low", "toxic", "signature", "found"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "low", "toxic")
    got = checkpointed(mine.mapInArrow(run, f"doc_id {kind}, low boolean, toxic boolean, signature long, found array<string>"))
    one = got.groupBy("doc_id").agg(F.min(F.struct("signature", "low", "toxic", "found")).alias("own")).select("doc_id", "own.*")
    return one.groupBy("signature").agg(F.min(F.struct("doc_id", "low", "toxic", "found")).alias("own")).select("own.*")


def _clear(name: str, a: int, b: int, bad: int, good: int) -> bool:
    """Whether a feature of a bad and b good documents tells them apart."""
    w = np.log((a + 0.5) / (bad + 1)) - np.log((b + 0.5) / (good + 1))
    return a + b >= MIN_COUNT and (w if name[0] != "~" else abs(w)) >= SIGNIFICANT * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def _regress(found: list[list[int]], bad: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on binary features by accelerated diagonal Newton steps: weights and intercept."""
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    col = np.concatenate([np.asarray(x, np.int64) for x in found]) if len(row) else np.empty(0, np.int64)
    per_row = np.bincount(row, minlength=len(found)) + 1.0
    rate = (bad.sum() + 0.5) / (len(bad) + 1)
    w, b = np.zeros(n_features), float(np.log(rate / (1 - rate)))
    curve = np.bincount(col, per_row[row], n_features) / 4 + RIDGE  # bounds the curvature of each coordinate
    curve_b = per_row.sum() / 4
    last_w, last_b = w, b
    for k in range(STEPS):
        m = k / (k + 3)
        at_w, at_b = w + m * (w - last_w), b + m * (b - last_b)
        z = np.bincount(row, at_w[col], len(found)) + at_b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad
        last_w, last_b = w, b
        w = at_w - (np.bincount(col, g[row], n_features) + RIDGE * at_w) / curve
        b = at_b - g.sum() / curve_b
    return w, b


class Model:
    """For each defect: its features' weights, the intercept, and the log-odds of its rate among the labelled."""

    def __init__(self, weights: dict[str, dict[str, float]], fit: dict[str, tuple[float, float]]):
        self.weights, self.fit = weights, fit

    def evidence(self, found: set[str]) -> list[float]:
        """Log-likelihood ratio of each defect."""
        out = []
        for d in DEFECTS:
            w, (b, prior) = self.weights[d], self.fit[d]
            out.append(float(sum(w[x] for x in sorted(found & w.keys()))) + b - prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The classifier. Without labels of both kinds for a defect, its evidence is 0 for every document."""
    sample = checkpointed(labelled_sample(docs, labels, rows))
    sums = [F.sum(F.when(F.col(d) == value, 1).otherwise(0)).alias(f"{d}_{value}".lower()) for d in DEFECTS for value in (True, False)]
    totals = sample.agg(*sums).first().asDict()
    counted = sample.select(*DEFECTS, F.explode("found").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= MIN_COUNT)
    taken: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in counted.toLocalIterator():
        for d in DEFECTS:
            if _clear(r["name"], r[f"{d}_true"], r[f"{d}_false"], totals[f"{d}_true"] or 0, totals[f"{d}_false"] or 0):
                taken[d][r["name"]] = 0
    for d in DEFECTS:
        taken[d] = {name: i for i, name in enumerate(sorted(taken[d]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(d) for d in ("doc_id", *DEFECTS)), *(pa.array([[taken[d][x] for x in f if x in taken[d]] for f in found], pa.list_(pa.int64())) for d in DEFECTS)],
                names=["doc_id", *DEFECTS, *(f"{d}_at" for d in DEFECTS)],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows_at = sample.mapInArrow(run, f"doc_id {kind}, low boolean, toxic boolean, low_at array<long>, toxic_at array<long>").toArrow().sort_by("doc_id")
    weights, lines = {}, {}
    for d in DEFECTS:
        known = rows_at.filter(rows_at.column(d).is_valid())
        bad = known.column(d).to_numpy(zero_copy_only=False).astype(float)
        rate = (bad.sum() + 0.5) / (len(bad) + 1)
        prior = float(np.log(rate / (1 - rate)))
        w, b = _regress(known.column(f"{d}_at").to_pylist(), bad, len(taken[d])) if 0 < bad.sum() < len(bad) else (np.zeros(len(taken[d])), prior)
        weights[d] = {name: float(w[i]) for name, i in taken[d].items()}
        lines[d] = (float(b), prior)
    return Model(weights, lines)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _shrunk(sites: DataFrame, by: Sequence[str], parent: str) -> DataFrame:
    """sites (by, n, parent rate and sum of each defect) with rate_<defect>, shrunk toward the parent's.

    The prior's strength k comes from moments: the variance of the site rates beyond what
    binomial counts of their sizes give is m (1 - m) / (k + 1).
    """
    stats = []
    for d in DEFECTS:
        m, rate = F.col(f"{parent}_{d}"), F.col(f"sum_{d}") / F.col("n")
        stats += [F.sum(F.col("n") * (rate - m) ** 2).alias(f"spread_{d}"), F.sum(m * (1 - m)).alias(f"chance_{d}"), F.sum(F.col("n") * m * (1 - m)).alias(f"full_{d}")]
    s = sites.agg(*stats).first()
    out = sites
    for d in DEFECTS:
        extra = ((s[f"spread_{d}"] or 0) - (s[f"chance_{d}"] or 0)) / max(s[f"full_{d}"] or 0, 1e-12)
        k = float(np.clip(1 / extra - 1 if extra > 0 else STRENGTH[1], *STRENGTH))
        out = out.withColumn(f"rate_{d}", (F.col(f"sum_{d}") + k * F.col(f"{parent}_{d}")) / (F.col("n") + k))
    return out.select(*by, "n", *[f"sum_{d}" for d in DEFECTS], *[f"rate_{d}" for d in DEFECTS])


def site_rates(evidence: DataFrame) -> DataFrame:
    """(host, path, path_rate_<defect>) from evidence (host, path, <defect>_llr) of all documents.

    Each level is one grouped aggregation with partial sums before its shuffle.
    """
    start = {d: F.avg(_sigmoid(F.col(f"{d}_llr") + F.col(f"{d}_prior"))) for d in DEFECTS}
    totals = evidence.agg(*[x.alias(d) for d, x in start.items()]).first()
    rates = {d: totals[d] if totals[d] is not None else 0.5 for d in DEFECTS}
    expected = [F.sum(_sigmoid(F.col(f"{d}_llr") + F.col(f"{d}_prior"))).alias(f"sum_{d}") for d in DEFECTS]
    paths = checkpointed(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *expected))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{d}").alias(f"sum_{d}") for d in DEFECTS])
    hosts = _shrunk(hosts.select("*", *[F.lit(rates[d]).alias(f"global_{d}") for d in DEFECTS]), ["host"], "global")
    above = hosts.select("host", *[F.col(f"rate_{d}").alias(f"host_{d}") for d in DEFECTS])
    found = _shrunk(paths.join(above, "host"), ["host", "path"], "host")
    return found.select("host", "path", *[F.col(f"rate_{d}").alias(f"path_rate_{d}") for d in DEFECTS])


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS, columns: Sequence[str] | None = None) -> DataFrame:
    """columns of docs (all, if None) with _p_low, _p_toxic (posteriors) and _keep, false if either is above REJECT.

    host and path name columns whose values (null is a value of its own) place a document. A
    null text is empty. Documents need no label; without any label all are kept. Repeated
    rows get equal values. Input columns of the three names are replaced; further columns pass
    through, whatever their names. An empty table gives an empty one. The evidence travels in the documents' own
    rows, so nothing is joined back to texts.
    """
    docs = docs.drop("_p_low", "_p_toxic", "_keep")
    out = list(docs.columns if columns is None else columns)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    model = shared.value
    # a document's columns are one struct, so that no name of theirs clashes
    own_columns = F.struct(*[F.col(f"`{c}`") for c in out]).alias("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for piece in pieces(batches):
            scores = np.array([own.evidence(features(x)) for x in texts(piece)]).reshape(-1, len(DEFECTS))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("own", "host", "path")), *map(pa.array, scores.T.copy())], names=["own", "host", "path", *(f"{d}_llr" for d in DEFECTS)])

    place = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    placed = docs.select(own_columns, place(host).alias("host"), place(path).alias("path"), "text")
    schema = placed.drop("text").schema
    for d in DEFECTS:
        schema = schema.add(f"{d}_llr", "double")
    evidence = checkpointed(placed.mapInArrow(run, schema))
    shared.destroy()
    evidence = evidence.select("*", *[F.lit(model.fit[d][1]).alias(f"{d}_prior") for d in DEFECTS])
    rates = checkpointed(site_rates(evidence))
    if fits(rates, F.octet_length("host") + F.octet_length("path") + 16):
        joined = evidence.join(F.broadcast(rates), ["host", "path"])
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = evidence.withColumn("salt", F.pmod(F.xxhash64("low_llr", "toxic_llr"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    final = {d: _sigmoid(F.col(f"{d}_llr") + _logit(F.col(f"path_rate_{d}"))) for d in DEFECTS}
    scored = joined.select("own", *[x.alias(f"_p_{d}") for d, x in final.items()])
    keep = (F.col("_p_low") <= REJECT) & (F.col("_p_toxic") <= REJECT)
    return scored.select(*[F.col("own").getField(c).alias(c) for c in out], "_p_low", "_p_toxic", keep.alias("_keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    found = classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), columns=["doc_id"])
    return found.select("doc_id", F.round("_p_low", 6).alias("p_low_quality"), F.round("_p_toxic", 6).alias("p_toxic"), F.col("_keep").alias("keep"))
