"""Stupid-backoff scores from n-gram counts of the whole corpus.

S(w | context) = count(context w) / count(context) if the n-gram stands at least MIN_COUNT times in the corpus,
else ALPHA * S(w | shorter context); for single words count(w) / N. A document's score is the sum of ln S over its
words, each with the ORDER - 1 words before it (fewer at the start).

N-gram tables are relations, but their rows travel packed. Documents are dealt to blocks by a hash. A block counts
its different n-grams and sends them, sorted by hash, to the partitions of the count table: one row for each
(block, partition) with packed arrays. A partition adds up the counts of all blocks and answers each block with
the totals, in the order asked. The block, cogrouped with its answers, looks up every n-gram of its documents. A
common n-gram so makes one entry for each block, never one for each occurrence, and no task sees more than a
block or a partition. N-grams are told apart by 64-bit hashes.

Cases: null and wordless texts have no words and a null mean; a null id is a document like others; repeated
rows count as often as they stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, mix, words_of

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Bytes of text in a block and for each partition of the count table, on average.
BLOCK_BYTES, PARTITION_BYTES = 12_000_000, 3_000_000

SCHEMA = "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long"


#: Bytes of a sorted hash's difference to the next that look random.
_RANDOM = 5


def pack(x: np.ndarray, raw: int = 0) -> bytes:
    """uint64 values as planes of bytes, deflated but for the ``raw`` lowest ones, which are not worth it."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes(), 1)


def unpack(data: bytes, n: int, raw: int = 0) -> np.ndarray:
    """``n`` values that ``pack`` made bytes of."""
    planes = np.frombuffer(data[: raw * n] + zlib.decompress(data[raw * n :]), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def grams(hashes: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``: hashes of the n words that end at each word; 0 where the document has fewer."""
    out = [mix(hashes ^ np.uint64(0x5BF03635)) | np.uint64(1)]
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    for n in range(2, order + 1):
        g = np.zeros(len(hashes), np.uint64)
        g[1:] = mix(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + np.uint64(n)) | np.uint64(1)
        g[place < n - 1] = 0
        out.append(g)
    return out


def _block(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a block's documents in order of id: numbers of words, word hashes' n-grams."""
    hashes, counts = [], []
    for batch in table.to_batches():
        for _, texts in chunks([batch]):
            w = words_of(texts)
            hashes.append(w.hashes)
            counts.append(np.diff(w.offsets))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return n, h, grams(h, np.concatenate([[0], np.cumsum(n)]), order)


#: Stands for all words in requests: asks for the size of the corpus.
_ALL = np.array([2**64 - 1], np.uint64)


def _types(g: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(g)
    types, counts = np.unique(every[every > 0], return_counts=True)
    return np.append(types, _ALL), np.append(counts.astype(np.uint64), np.uint64(len(g[0])))


def score(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """SCHEMA for every row of ``documents(doc_id, text)``; the mean is per word."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    bits = max(1, int(total // partition_bytes).bit_length())
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        types, counts = _types(_block(table, order)[2])
        parts = (types >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts)) + 1
        asked = [(p, c) for p, c in zip(np.split(types, cuts), np.split(counts, cuts), strict=True) if len(p)]
        return pa.table({
            "part": pa.array([int(p[0] >> np.uint64(64 - bits)) for p, _ in asked], pa.int64()), "block": pa.array([key[0].as_py()] * len(asked), pa.int64()),
            "n": pa.array([len(p) for p, _ in asked], pa.int64()), "types": pa.array([pack(np.diff(p, prepend=np.uint64(0)), _RANDOM) for p, _ in asked], pa.binary()), "counts": pa.array([pack(c) for _, c in asked], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        asked = [np.cumsum(unpack(x, n, _RANDOM), dtype=np.uint64) for x, n in zip(table.column("types").to_pylist(), sizes, strict=True)]
        counts = np.concatenate([unpack(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        types, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(inverse, counts, len(types)).astype(np.uint64)  # exact below 2**53
        mine = np.split(totals[inverse], np.cumsum(sizes)[:-1])
        return pa.table({"block": table.column("block"), "part": pa.array([key[0].as_py()] * len(asked), pa.int64()), "n": table.column("n"), "totals": pa.array([pack(x) for x in mine], pa.binary())})

    requests = dealt.groupBy("block").applyInArrow(ask, "part long, block long, n long, types binary, counts binary")
    answers = requests.groupBy("part").applyInArrow(answer, "block long, part long, n long, totals binary")

    def look_up(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        n, _, g = _block(table, order)
        types, _ = _types(g)
        order_of = np.argsort(replies.column("part").to_numpy(), kind="stable").tolist()
        got, sizes = replies.column("totals").to_pylist(), replies.column("n").to_pylist()
        totals = np.concatenate([unpack(got[i], sizes[i]) for i in order_of]) if got else np.zeros(0, np.uint64)
        assert len(totals) == len(types), "a block's documents changed between two reads"
        corpus = float(totals[-1])
        of = [np.where(x > 0, totals[np.searchsorted(types, x)], 0).astype(np.float64) for x in g]
        value = np.log(np.maximum(of[0], 1) / corpus) if corpus else np.zeros(0)
        backed = np.zeros(len(value), np.int64)
        for k in range(1, order):
            context = np.concatenate([[1.0], of[k - 1][:-1]]) if len(value) else value
            here = of[k] >= min_count
            whole = g[k] > 0
            value = np.where(here, np.log(np.maximum(of[k], 1) / np.maximum(context, 1)), np.where(whole, value + np.log(alpha), value))
            backed = np.where(here, 0, backed + whole)
        doc = np.repeat(np.arange(len(n)), n)
        sums = np.bincount(doc, value, len(n)) if len(n) else np.zeros(0)
        return pa.table({
            "doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array([float(s / k) if k else None for s, k in zip(sums, n, strict=True)], pa.float64()), "n_backed_off": pa.array(np.bincount(doc[backed > 0], minlength=len(n)), pa.int64()),
        })

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, SCHEMA)

