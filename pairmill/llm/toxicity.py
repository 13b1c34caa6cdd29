"""Toxicity classifier whose scores do not follow identity terms: counterfactual-regularised logistic regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import Words, bites, list_array, mix

#: Words that name groups of people; in counterfactuals each stands in for any other.
IDENTITY = (
    "women men woman man girls boys female male gay lesbian straight bisexual transgender queer black white asian african european american "
    "latino hispanic arab chinese indian mexican turkish jewish jews muslim muslims christian christians hindu hindus buddhist catholic catholics "
    "protestant atheist atheists immigrant immigrants refugee refugees foreigner foreigners disabled blind deaf elderly old young "
    "frauen männer muslime juden christen ausländer flüchtlinge femmes hommes musulmans juifs chrétiens immigrés "
    "mujeres hombres musulmanes judíos cristianos inmigrantes"
).split()
#: Features are hashed into 2^20 places: each word and its first 4, 5 and 6 bytes.
DIM = 1 << 20
PREFIXES = (4, 5, 6)
#: At most so many labelled rows are fitted, chosen by the hash of their id.
MAX_TRAIN = 16_000
#: Features get a weight when their chi-square with the label over the fitted rows is at least this; chance reaches it once in 10^6.
LEAST_CHI = 24.0
ROUNDS, RATE, RIDGE, FAIRNESS = 150, 0.2, 2e-5, 1.0


def _places(w_hash: np.ndarray, prefixes: list[np.ndarray]) -> list[np.ndarray]:
    salts = np.arange(1, len(prefixes) + 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    return [(mix(h ^ s) % np.uint64(DIM)).astype(np.int64) for h, s in zip([w_hash, *prefixes], salts, strict=True)]


def features(texts: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct features of each row, in order; of those with a weight only, where weights are given."""
    w = Words(texts, letters=True, prefixes=PREFIXES)
    row = w.rows
    keys = []
    for place in _places(w.hash, w.prefix):
        r = row
        if weights is not None:
            some = weights[place] != 0
            r, place = row[some], place[some]
        keys.append(r * DIM + place)
    key = np.unique(np.concatenate(keys))
    return key // DIM, key % DIM


def _identity_places() -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the identity terms, sorted, and the places of each term's features."""
    w = Words(pa.array([" ".join(IDENTITY)]), letters=True, prefixes=PREFIXES)
    order = np.argsort(w.hash)
    return w.hash[order], [p[order] for p in _places(w.hash, w.prefix)]


def _feature_batches(batches):
    """(toxic, places, swaps): ``swaps`` has, for each identity term of the row, its index and that of a stand-in."""
    known, _ = _identity_places()
    for b in bites(batches):
        n = b.num_rows
        row, place = features(b.column(1))
        w = Words(b.column(1), letters=True)
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        some = known[at] == w.hash
        pair = np.unique(w.rows[some] * len(known) + at[some])
        r, term = pair // len(known), pair % len(known)
        step = (mix(pair.astype(np.uint64)) % np.uint64(len(known) - 1)).astype(np.int64) + 1
        swaps = np.stack([term, (term + step) % len(known)], axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), list_array(place, np.searchsorted(row, np.arange(n + 1)), pa.int32()), list_array(swaps, 2 * np.searchsorted(r, np.arange(n + 1)), pa.int32())],
            ["toxic", "places", "swaps"],
        )


def fit(toxic: np.ndarray, indptr: np.ndarray, place: np.ndarray, swaps: np.ndarray, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """(weights, bias): the mean log loss, plus ``fairness`` times the mean squared change of the score when an identity
    term of a row is swapped for another, plus a ridge; Adam over all rows, the same steps each time. Only features that
    go with the label beyond chance take part, so that long texts gather no noise.

    Without rows, or with labels of one kind only, the weights are 0 and the bias is the smoothed log odds of the labels.
    """
    n, positive = len(toxic), float(toxic.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    weights = np.zeros(DIM)
    if n == 0 or positive in (0.0, float(n)):
        return weights, bias
    row = np.repeat(np.arange(n), np.diff(indptr))
    rows_of, toxic_of = np.bincount(place, minlength=DIM), np.bincount(place, weights=toxic[row], minlength=DIM)
    spread = rows_of * (n - rows_of) * positive * (n - positive)
    chi = np.where(spread > 0, n * (toxic_of * n - rows_of * positive) ** 2 / np.maximum(spread, 1), 0.0)
    cols = np.flatnonzero(chi >= LEAST_CHI)
    col = np.full(DIM, len(cols))  # features without a weight share a last, unused place
    col[cols] = np.arange(len(cols))
    _, terms = _identity_places()
    swaps = swaps.reshape(-1, 2)
    old, new = [col[p[swaps[:, 0]]] for p in terms], [col[p[swaps[:, 1]]] for p in terms]
    c = col[place]
    row, c = row[c < len(cols)], c[c < len(cols)]
    w, m, v = (np.zeros(len(cols) + 1) for _ in range(3))
    w[-1] = bias
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[c], minlength=n) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        grad = np.append(np.bincount(c, weights=err[row], minlength=len(cols)), err.sum())
        grad[:-1] += 2 * RIDGE * w[:-1]
        if len(swaps):
            held = np.append(w[:-1], 0.0)
            g = 2 * fairness * (sum(held[a] for a in old) - sum(held[a] for a in new)) / len(swaps)
            for sign, places in ((1, old), (-1, new)):
                for a in places:
                    grad[:-1] += sign * np.bincount(a, weights=g, minlength=len(cols) + 1)[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (ROUNDS + 1))
    weights[cols] = w[:-1]
    return weights, float(w[-1])


def _fit_batches(batches):
    toxic, indptr, place, swaps = [], [np.zeros(1, np.int64)], [], []
    for b in batches:
        for lists, out in ((b.column(1), place), (b.column(2), swaps)):
            out.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        indptr.append(np.cumsum(np.diff(b.column(1).offsets.to_numpy())) + indptr[-1][-1])
        toxic.append(b.column(0).to_numpy(zero_copy_only=False).astype(float))
    cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
    w, bias = fit(cat(toxic, float), np.concatenate(indptr), cat(place, np.int64), cat(swaps, np.int64))
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(w[some], bias))], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Model fitted to at most ``max_train`` labelled rows, those whose ids hash lowest.

    Ids with several labels count as toxic if one of them is; null ids and labels are left out, null texts are empty.
    The chosen ids are so few by that bound that they are broadcast; one task fits the model, and its at most
    2^20 weights come to the driver.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    chosen = rows.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(max_train)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_toxic", "_text")
    found = texts.mapInArrow(_feature_batches, "toxic int, places array<int>, swaps array<int>").repartition(1)
    weights, bias = np.zeros(DIM, dtype=np.float32), 0.0
    for r in found.mapInArrow(_fit_batches, "place long, weight double").toLocalIterator():
        if r["place"] < 0:
            bias = r["weight"]
        else:
            weights[r["place"]] = r["weight"]
    return weights, bias


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, place = features(texts, weights)
    z = np.bincount(row, weights=weights[place], minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the toxicity of the whole text, 0 to 1, in ``column`` (replaced if there is one); null texts count as empty."""
    from pyspark.sql import types as T

    docs = docs.drop(column)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for b in bites(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(b.column(at), *held.value))], [*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def held_out(key: str = "doc_id", parts: int = 5, rest: int = 0):
    """Whether a row is kept from training: crc32 of the id as text leaves ``rest``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == rest


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (same columns) without the rows that score at least ``least``."""
    model = train(docs, labels, key, text)
    return score_texts(docs, model, text, "_score").where(F.col("_score") < least).drop("_score")
