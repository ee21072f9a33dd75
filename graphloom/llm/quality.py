"""Quality classifier: Bradley-Terry ranking of documents, thresholded by a quantile of the scores.

Every pair of a good and a bad labelled document is a preference. The strength of a document is linear in
features of its whole text, and P(good beats bad) = sigmoid(strength difference), so the weights minimise the
logistic loss on feature differences. The threshold is the quantile of the strengths of the labelled
documents at the share of bad ones; a score is sigmoid(strength - threshold), so 0.5 divides.

Fitting takes all labelled documents and all their pairs, none drawn. A sum over pairs of a smooth function of the
strength difference is a sum over pairs of nodes: a document's strength is shared out to the NODES Chebyshev nodes of
its unit interval (interpolation, to about 1e-13), so that a Newton step takes two passes over the documents, each
in tasks that return sums for nodes. The threshold is an exact order statistic, found by counting in ever
smaller ranges.

Cases: null and empty texts get a score like any other (all their features are 0); documents are scored row by
row, so repeated rows and null ids come back as they are; a label that is null or not 0 or 1 is left out; of
several labels for one id the lowest holds; an id on several texts is labelled on each, and counts once for each;
without labels of both kinds every score is 0.5; an empty table gives no rows. Only the text column is
read; other columns pass through ``keep_good`` unchanged; ``score`` needs its column's name to be free.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import chunks, discard, materialize, words_of

#: Nodes in a unit interval of strengths.
NODES = 12
#: Ranges that an order statistic is looked for in at a time, and tasks of a pass over the labelled documents' features.
RANGES, TASKS = 4096, 64
SCORE = "__graphloom_score"

_CHEBYSHEV = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_LAGRANGE = np.polynomial.chebyshev.chebvander(_CHEBYSHEV, NODES - 1).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def features(texts: list[str]) -> np.ndarray:
    """A row of features for each text: lengths, shares of kinds of characters, repetition."""
    n = len(texts)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, n)
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_of_char = np.repeat(np.arange(n), lengths)

    def share(mask: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(doc_of_char[mask], minlength=n), lengths)

    w = words_of(texts)
    count = np.diff(w.offsets)
    doc = np.repeat(np.arange(n), count)

    def distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document: the number of different values, and how often the commonest one stands."""
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])]) if len(v) else np.zeros(0, np.int64)
        runs, most = np.diff(np.append(first, len(v))), np.zeros(n)
        np.maximum.at(most, d[first], runs)
        return np.bincount(d[first], minlength=n), most

    kinds, commonest = distinct(w.hashes, doc)
    s, ok = w.shingles(5)
    shingle_kinds, commonest_shingle = distinct(s[ok], doc[ok])
    n_shingles = np.bincount(doc[ok], minlength=n)
    length = w.ends - w.starts
    same = np.zeros(n)
    if len(doc) > 1:
        same = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (w.hashes[1:] == w.hashes[:-1])], minlength=n)
    lines = np.fromiter(((t or "").count("\n") + 1 for t in texts), np.float64, n)
    mean = _ratio(np.bincount(doc, length, n), count)
    upper = (codes >= 65) & (codes <= 90)
    return np.column_stack([
        np.log1p(lengths), np.log1p(count), mean, np.sqrt(np.maximum(0, _ratio(np.bincount(doc, length.astype(float) ** 2, n), count) - mean**2)),
        share(upper), share((codes >= 97) & (codes <= 122)), share((codes >= 48) & (codes <= 57)), share(codes >= 128), share(codes == 32), share(codes == 10),
        share((codes == 44) | (codes == 46)), share((codes > 32) & (codes < 127) & ~upper & ~((codes >= 97) & (codes <= 122)) & ~((codes >= 48) & (codes <= 57)) & (codes != 44) & (codes != 46)),
        share(codes == 33), share(codes == 124), _ratio(kinds, np.sqrt(count)), _ratio(kinds, count), _ratio(commonest, count), _ratio(same, count),
        _ratio(shingle_kinds, n_shingles), _ratio(commonest_shingle, n_shingles), _ratio(lengths, lines) / 1000, _ratio(np.bincount(doc[length == 1], minlength=n), count),
    ])


@dataclass(frozen=True)
class BradleyTerry:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def _shares(strengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit interval that each strength lies in, and its shares in the interval's nodes."""
    cell = np.floor(strengths)
    return cell.astype(np.int64), np.polynomial.chebyshev.chebvander(2 * (strengths - cell) - 1, NODES - 1) @ _LAGRANGE


#: A pass: calls a function of (x, good) on parts of the labelled documents, and gives its results.
Pass = Callable[[Callable[[np.ndarray, np.ndarray], object]], list]
Cells = dict[tuple[int, bool], np.ndarray]


def _merged(parts: list[Cells]) -> Cells:
    out: Cells = {}
    for part in parts:
        for k, v in part.items():
            out[k] = out[k] + v if k in out else v
    return out


def _node_sums(model: BradleyTerry) -> Callable[[np.ndarray, np.ndarray], Cells]:
    """For each cell and label: a row for each node, with the documents' shares and their inputs by share."""

    def run(x: np.ndarray, good: np.ndarray) -> Cells:
        z = model.inputs(x)
        cell, share = _shares(z @ model.weights)
        ones, out = np.hstack([np.ones((len(z), 1)), z]), {}
        order = np.lexsort((good, cell))
        for at in np.split(order, np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(good[order].astype(int)) != 0)) + 1) if len(order) else []:
            out[int(cell[at[0]]), bool(good[at[0]])] = share[at].T @ ones[at]
        return out

    return run


def _curvature(model: BradleyTerry, weights: Cells) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The sum of the inputs' outer squares; ``weights``: for each cell and label those of its nodes."""

    def run(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        z = model.inputs(x)
        cell, share = _shares(z @ model.weights)
        kinds, of = np.unique(2 * cell + good, return_inverse=True)
        each = np.array([weights[c >> 1, bool(c & 1)] for c in kinds.tolist()]).reshape(-1, NODES)[of]
        return (z * (share * each).sum(axis=1)[:, None]).T @ z

    return run


def _ranks(run: Pass, model: BradleyTerry, ranks: list[int]) -> list[float]:
    """The strengths at these places in their order, from 0."""

    def extent(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
        s = model.strength(x)
        return float(s.min(initial=np.inf)), float(s.max(initial=-np.inf))

    least, most = (f(v) for f, v in zip((min, max), zip(*run(extent), strict=True), strict=True))
    out = []
    for rank in ranks:
        lo, hi, before = least, most, 0
        while lo < hi:
            edges = np.linspace(lo, hi, RANGES)

            def count(x: np.ndarray, good: np.ndarray, lo: float = lo, hi: float = hi, edges: np.ndarray = edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                s = model.strength(x)
                s = s[(s >= lo) & (s <= hi)]
                at = np.searchsorted(edges, s, "right") - 1
                first, last = np.full(RANGES, np.inf), np.full(RANGES, -np.inf)
                np.minimum.at(first, at, s)
                np.maximum.at(last, at, s)
                return np.bincount(at, minlength=RANGES), first, last

            counts, first, last = zip(*run(count), strict=True)
            total = before + np.cumsum(np.sum(counts, axis=0))
            k = int(np.searchsorted(total, rank, "right"))
            before = int(total[k - 1]) if k else before
            lo, hi = float(np.min(first, axis=0)[k]), float(np.max(last, axis=0)[k])
        out.append(lo)
    return out


def _merge_moments(a: tuple, b: tuple) -> tuple:
    """Number, means, sums of squared deviations and number of good ones of two parts together."""
    n, shift = a[0] + b[0], b[1] - a[1]
    return n, a[1] + shift * (b[0] / max(1, n)), a[2] + b[2] + shift**2 * (a[0] * b[0] / max(1, n)), a[3] + b[3]


def _fit(run: Pass, k: int, penalty: float = 1e-3) -> BradleyTerry:
    """Newton's method on the mean logistic loss of all preference pairs."""
    moments = (0, np.zeros(k), np.zeros(k), 0)
    for part in run(lambda x, good: (len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0), int(good.sum())) if len(x) else (0, np.zeros(k), np.zeros(k), 0)):
        moments = _merge_moments(moments, part)
    n, mean, squares, n_good = moments
    if n_good in (0, n):
        return BradleyTerry(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0)
    scale = np.sqrt(squares / n)
    model = BradleyTerry(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * k), 0.0)
    pairs, w = n_good * (n - n_good), model.weights
    for _ in range(40):
        model = replace(model, weights=w)
        sums = _merged(run(_node_sums(model)))
        keys = {label: sorted(c for c, g in sums if g == label) for label in (True, False)}
        at = {label: (np.array(keys[label], float)[:, None] + (_CHEBYSHEV + 1) / 2).ravel() for label in keys}
        better, worse = (np.concatenate([sums[c, label] for c in keys[label]]) for label in (True, False))
        lost, bent, beaten, bowed, across = [], [], 0, 0, 0
        for i in range(0, len(better), 1024):
            part = better[i : i + 1024]
            losing = 1 / (1 + np.exp(np.clip(at[True][i : i + 1024, None] - at[False], -500, 500)))  # the good one's probability
            bend = losing * (1 - losing)
            lost.append(losing @ worse[:, 0])
            bent.append(bend @ worse[:, 0])
            beaten, bowed, across = beaten + part[:, 0] @ losing, bowed + part[:, 0] @ bend, across + part[:, 1:].T @ (bend @ worse[:, 1:])
        gradient = (better[:, 1:].T @ np.concatenate(lost) - worse[:, 1:].T @ beaten) / pairs - penalty * w
        weights = {(c, label): v for label, of in ((True, np.concatenate(bent)), (False, bowed)) for c, v in zip(keys[label], of.reshape(-1, NODES), strict=True)}
        hessian = (sum(run(_curvature(model, weights))) - across - across.T) / pairs + penalty * np.eye(2 * k)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model = replace(model, weights=w)
    # the middle of the gap at the quantile of the share of bad ones
    return replace(model, threshold=float(np.mean(_ranks(run, model, [n - n_good - 1, n - n_good]))))


def fit_pairs(x: np.ndarray, good: np.ndarray, penalty: float = 1e-3) -> BradleyTerry:
    """Fits on these documents: a row of features for each, and whether it is good."""
    return _fit(lambda f: [f(x, good)], x.shape[1] if x.ndim == 2 else 0, penalty)


def fit(documents: DataFrame, labels: DataFrame, bound: int | None = None) -> BradleyTerry:
    """Fits on all documents with a label 0 or 1 in ``labels(doc_id, quality)``; on ``bound`` of them at most, drawn by
    a hash of their ids, if that is given (no query does)."""
    labelled = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
    if bound is not None:
        rows = rows.join(labelled.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(bound)
    doc_id = rows.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield pa.record_batch([part.column(0), pa.array([v.tobytes() for v in features(texts)], pa.binary())], ["doc_id", "x"])

    # features are joined, not texts: some 200 bytes a document
    found = rows.mapInArrow(run, T.StructType([doc_id, T.StructField("x", T.BinaryType())])).join(labelled, "doc_id").select((F.col("quality") == 1).alias("good"), "x")
    k = features([""]).shape[1]
    if bound is not None:
        few = found.toPandas()
        return fit_pairs(_matrix(few["x"], k), few["good"].to_numpy(bool))
    stored = materialize(found)
    try:
        return _fit(lambda f: _over(stored, f, k), k)
    finally:
        discard(stored)


def _matrix(rows, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(-1, k)


def _over(stored: DataFrame, f: Callable[[np.ndarray, np.ndarray], object], k: int) -> list:
    """``f``'s results for TASKS parts, at most, of the stored features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches, schema)
        if found.num_rows:
            x, good = _matrix(found["x"].to_pylist(), k), found["good"].to_numpy().astype(bool)
            yield pa.record_batch([pa.array([pickle.dumps(f(x, good))], pa.binary())], ["part"])

    schema = pa.schema([("good", pa.bool_()), ("x", pa.binary())])
    return [pickle.loads(r.part) for r in stored.coalesce(TASKS).mapInArrow(run, "part binary").collect()]


def score(documents: DataFrame, model: BradleyTerry) -> DataFrame:
    """``documents`` with a column SCORE from 0 to 1."""
    if SCORE in documents.columns:
        raise ValueError(f"the documents have a column {SCORE}")
    schema = T.StructType([*documents.schema.fields, T.StructField(SCORE, T.DoubleType(), False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.score(features(texts)))], names=names)

    return documents.mapInArrow(run, schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels but for the held-out third of the ids."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose score is 0.5 or more, all columns as they are."""
    return score(documents, fit(documents, learning_labels(labels))).where(F.col(SCORE) >= 0.5).drop(SCORE)
