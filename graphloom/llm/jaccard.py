"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a shorter text: its words, as one shingle). Texts with the same set are
one copy class; only one of each class goes on, so copies are never expanded into pairs.

1. MinHash signatures; classes that agree on a whole band of BAND_ROWS values are candidates. A pair at the
   threshold 0.8 misses all BANDS bands with probability (1 - 0.8**5)**24 = 7e-5. A band's classes are linked to
   the least one, a star; the components of all stars are dealt to blocks of about BLOCK classes.
2. Within a component each pair of blocks is one unit of work. The signatures of a pair are compared STEP values
   at a time. With a uniform prior, after m matches among n values the similarity is Beta(m+1, n-m+1); once
   P(similarity >= threshold) falls below TOLERANCE the pair is dropped.
3. The others are verified on the exact shingle sets. A unit returns numbers of links, and links enough to connect
   what is connected: never one row for each pair.
4. Links make groups: connected components by alternating large-star and small-star rounds, each round cut off
   by a table in the shared folder. Nothing but counts reaches the driver.

Cases: null and wordless texts are classes by their equal (trimmed) texts and have no links; rows with a null id
come back with nulls; repeated rows are copies and come back as often as they stand; the texts of an id that stands on
several are classes of their own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, materialize, mix, words_of

WIDTH, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 24, 5
HASHES = BANDS * BAND_ROWS
STEP, TOLERANCE = 8, 1e-6
BLOCK = 1024

_seeds = np.random.default_rng(20240607)
_A = _seeds.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _seeds.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    w = words_of(texts)
    s, ok = w.shingles(width)
    out = []
    for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(s[a:b][ok[a:b]]))
        else:  # of few words: all of them, in order
            out.append(np.frombuffer(blake2b(w.hashes[a:b].tobytes(), digest_size=8).digest(), np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i : i + 1024, None] * _A + _B).min(axis=0))
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def copy_key(shingles: np.ndarray, text: str | None) -> bytes:
    """Alike for the texts of one copy class."""
    return blake2b(shingles.tobytes() if len(shingles) else b"-" + (text or "").strip().encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        sets = shingle_sets(texts)
        full = [len(s) > 0 for s in sets]
        keys = [copy_key(s, t) for s, t in zip(sets, texts, strict=True)]
        signs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
        bands = mix(signs.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64) + np.uint64(1))
        band = np.full(bands.shape[:2], 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for k in range(BAND_ROWS):
            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
        yield pa.record_batch([
            rows.column(0), rows.column(1), pa.array(keys, pa.binary()),
            pa.array([b.view(np.int64) if f else None for b, f in zip(band, full, strict=True)], pa.list_(pa.int64())),
            pa.array([s.tobytes() if f else None for s, f in zip(signs, full, strict=True)], pa.binary()),
        ], ["doc_id", "text_key", "copy", "bands", "sign"])


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> tuple[int, ...]:
    """For step, 2*step, ... values: the fewest matches with which a pair is kept.

    For m of n matches the posterior is Beta(m+1, n-m+1), so P(similarity >= t) = P(Binomial(n+1, t) <= m)."""
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (row i of a, row j of b) of two signature matrices are kept."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[i[alive], part] == b[j[alive], part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        sets = shingle_sets(texts)
        yield pa.record_batch([pa.array([copy_key(s, t) for s, t in zip(sets, texts, strict=True)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["copy", "shingles"])


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``, exactly: products of incidence matrices."""
    sizes = [len(x) for x in (*a, *b)]
    _, inverse, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sizes)), sizes), times[inverse] > 1
    row, number = row[common], (np.cumsum(times > 1) - 1)[inverse[common]]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    width = int(number[-1]) + 1 if len(number) else 0
    for begin in range(0, width, 4096):
        lo, hi = np.searchsorted(number, [begin, begin + 4096])
        m = np.zeros((len(sizes), min(4096, width - begin)), np.float32)
        m[row[lo:hi], number[lo:hi] - begin] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def similar(signs_a: np.ndarray, sets_a: list[np.ndarray], signs_b: np.ndarray | None = None, sets_b: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the similar pairs of two blocks, or within one: Bayesian pruning, then exact verification."""
    one = signs_b is None
    i, j = np.triu_indices(len(sets_a), 1) if one else (x.ravel() for x in np.indices((len(sets_a), len(sets_b))))
    signs_b, sets_b = (signs_a, sets_a) if one else (signs_b, sets_b)
    kept = prune(signs_a, signs_b, i, j)
    i, j = i[kept], j[kept]
    if not len(i):
        return i, j
    rows, ri = np.unique(i, return_inverse=True)
    columns, cj = np.unique(j, return_inverse=True)
    shared = _shared([sets_a[x] for x in rows], [sets_b[x] for x in columns])[ri, cj]
    union = np.fromiter(map(len, sets_a), np.float64)[i] + np.fromiter(map(len, sets_b), np.float64)[j] - shared
    ok = shared >= THRESHOLD * union
    return i[ok], j[ok]


def _compare(table: pa.Table) -> pa.Table:
    """Of the block pairs in ``table``: for each class with links their number, and a class that it is linked to,
    such that these links connect what all links connect."""
    root, p, q, b, ids = (table.column(k).to_numpy() for k in ("root", "p", "q", "b", "id"))
    signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    order = np.lexsort((ids, b, q, p, root))
    cut = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(p[order]) != 0) | (np.diff(q[order]) != 0)) + 1
    out: list[tuple[np.ndarray, ...]] = []
    for at in np.split(order, cut):
        left, right = (at[b[at] == p[at[0]]], at[b[at] == q[at[0]]]) if p[at[0]] != q[at[0]] else (at, None)
        if right is None:
            i, j = similar(signs[left], [sets[x] for x in left])
            u, v = left[i], left[j]
        else:
            i, j = similar(signs[left], [sets[x] for x in left], signs[right], [sets[x] for x in right])
            u, v = left[i], right[j]
        if len(u):
            named, ends = np.unique(np.concatenate([ids[u], ids[v]]), return_inverse=True)
            x, y = ends[: len(u)], ends[len(u) :]
            label = np.arange(len(named))
            while True:
                low = np.minimum(label[x], label[y])
                new = label.copy()
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                if (new == label).all():
                    break
                label = new
            out.append((named, named[label], np.bincount(ends, minlength=len(named))))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["id", "to", "n"])


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), copy (key of the copy class), bands, sign of each row; a table in the
    shared folder."""
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return materialize(docs.mapInArrow(_sign, "doc_id long, text_key long, copy binary, bands array<long>, sign binary"))


def nodes(signed: DataFrame) -> DataFrame:
    """copy, copy_id (its least id), id of each copy class. ``id`` is copy_id but for further classes of one id, which
    have a hash."""
    least = signed.where("doc_id IS NOT NULL").groupBy("copy").agg(F.min("doc_id").alias("copy_id"))
    first = least.groupBy("copy_id").agg(F.min("copy").alias("first"))
    further = F.xxhash64("copy").bitwiseOR(F.lit(-(1 << 63)))
    return least.join(first, "copy_id").select("copy", "copy_id", F.when(F.col("copy") == F.col("first"), F.col("copy_id")).otherwise(further).alias("id"))


def links(documents: DataFrame, signed: DataFrame, of: DataFrame) -> DataFrame:
    """id, to, n: for each copy class of ``of`` (``nodes``) its similar classes, counted in parts (n), and links (to)
    that connect what all links connect. A table in the shared folder."""
    # by the id: copies never meet in one task
    least = of.select(F.col("copy_id").alias("doc_id"), "copy", "id")
    one = signed.where("sign IS NOT NULL").join(least, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    one = materialize(one.select("id", F.col("doc_id").alias("copy_id"), "copy", "bands", "sign"))
    keys = one.select("id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    stars = keys.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = materialize(stars)
    near = components(stars)
    blocks = near.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = materialize(near.join(blocks, "root").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    small = max(1, placed.count() // (2 * BLOCK))
    known = placed.join(one.select("id", "copy_id", "copy", "sign"), "id")
    texts = documents.select(F.col("doc_id").cast("long").alias("copy_id"), "text").join(known.select("copy_id"), "copy_id", "left_semi")
    # an id that stands on several texts: the one of this copy class
    sets = texts.mapInArrow(_sets, "copy binary, shingles binary").dropDuplicates(["copy"])
    full = known.join(sets, "copy")
    paired = full.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("b", "c")).withColumn("q", F.greatest("b", "c"))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(small))).otherwise(F.xxhash64("root", "p", "q"))
    return materialize(paired.select(unit.alias("unit"), "root", "p", "q", "b", "id", "sign", "shingles").groupBy("unit").applyInArrow(_compare, "id long, to long, n long"))


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of its connected component) for every id in ``edges(a, b)``."""
    work, spent = edges.select("a", "b").where("a <> b"), []
    while True:
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: each larger neighbour is linked to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each smaller neighbour, and the node itself
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, *spent)
        # done when every node has one parent that has none itself
        stars = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        work, spent = new, [new]
        if stars:
            break
    return work.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(work.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _grouped(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signatures``, and for each copy class: copy, copy_id, class_id, n_links, kept (of its group the first)."""
    signed = signatures(documents)
    of = materialize(nodes(signed))
    found = links(documents, signed, of)
    ends = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    grouped = roots.join(of, "id").groupBy("root").agg(F.min(F.struct("copy_id", "copy")).alias("least"))
    linked = roots.join(grouped, "root").select("id", "least")
    out = of.join(ends, "id", "left").join(linked, "id", "left")
    kept = F.coalesce(F.col("least.copy") == F.col("copy"), F.lit(True))
    return signed, out.select("copy", "copy_id", F.coalesce("least.copy_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"))


def classes(documents: DataFrame) -> DataFrame:
    """For every row: doc_id, class_id (the least id of its group of near copies), copy_id (the least id of its
    exact copies), n_links (other copy classes that are similar to its own)."""
    signed, of = _grouped(documents)
    out = signed.select("doc_id", "copy").join(of, "copy", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", *[F.when(known, F.col(c)).alias(c) for c in ("class_id", "copy_id", "n_links")])


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, one of the least id; rows without an id stay."""
    signed, of = _grouped(documents)
    first = of.where("kept").select(F.col("copy_id").alias("doc_id"), "copy")
    least = signed.join(first, ["doc_id", "copy"]).groupBy("doc_id", "copy").agg(F.min("text_key").alias("text_key")).select(F.struct("doc_id", "text_key").alias("__key"))
    known = documents.where("doc_id IS NOT NULL").select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).alias("__of"), F.struct("*").alias("__row"))
    kept = known.join(least, F.col("__of") == F.col("__key"), "left_semi").dropDuplicates(["__of"]).select("__row.*")
    return kept.unionByName(documents.where("doc_id IS NULL"))
