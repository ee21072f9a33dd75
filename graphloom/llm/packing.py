"""Best-fit packing under conflicts: documents fill bins of a fixed capacity, the longest ones first.

Open bins stand ordered by their residual capacity. Each carries bitmaps: one of the duplicate clusters it
holds, and for sources one bitmap for each of the ``per_source`` places (bit set in the k-th: k documents of
this source are in). A piece goes to the tightest bin that takes it: the search starts at the smallest residual
that is large enough and goes on to each successor until a bin is compatible; else a new bin opens. Two
documents of one cluster never share a bin, nor do more than ``per_source`` of one source. The query's clusters are
the groups of near copies.

A document longer than the capacity is cut; its full pieces are bins of their own and the rest is packed.
Documents are dealt to shards by a hash of their ids; each shard of about SHARD_ROWS documents is packed by
itself, so no source or cluster, however large, meets in one task, and the cost of packing grows in proportion
to the input.

Cases: a null or empty text takes no bin (bin null, size 0); a null source is no source; ties in size go by
cluster, id and start; repeated rows are packed as often as they stand and, as copies, in different bins; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import jaccard
from .common import materialize

#: Code points in a bin.
CAPACITY = 16384
#: Documents of one source that may share a bin.
PER_SOURCE = 4
#: Documents packed together, on average.
SHARD_ROWS = 8192

SCHEMA = "doc_id long, piece int, start long, end long, size long, bin long, slot int"


class Bins:
    """Open bins ordered by residual capacity, with the successor search."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (residual, bin), ordered
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.filled: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the place in it. ``source`` is a bit number, -1 for none."""
        cluster_bit, source_bit = 1 << cluster, 1 << source if source >= 0 else 0
        last, clusters, sources = self.per_source - 1, self.clusters, self.sources
        for at in range(bisect_left(self.open, (size, -1)), len(self.open)):
            residual, b = self.open[at]
            if not clusters[b] & cluster_bit and not sources[b][last] & source_bit:
                del self.open[at]
                break
        else:
            residual, b = self.capacity, len(self.filled)
            clusters.append(0)
            sources.append([0] * self.per_source)
            self.filled.append(0)
        clusters[b] |= cluster_bit
        for k, bits in enumerate(sources[b]):
            if not bits & source_bit:
                sources[b][k] |= source_bit
                break
        if residual > size:
            insort(self.open, (residual - size, b))
        self.filled[b] += 1
        return b, self.filled[b] - 1


def pack_rows(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Packs doc_id, source, cluster, size; the rows in any order."""
    rows = rows[rows["size"] > 0]
    full = (rows["size"] // capacity).to_numpy()
    rest = (rows["size"] % capacity).to_numpy()
    parts = full + (rest > 0)
    of = np.repeat(np.arange(len(rows)), parts)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[of], "cluster": rows["cluster"].to_numpy()[of], "source": rows["source"].to_numpy()[of], "piece": piece})
    out["start"] = out["piece"].astype("int64") * capacity
    out["size"] = np.where(piece < full[of], capacity, rest[of]).astype("int64")
    out["end"] = out["start"] + out["size"]
    out = out.sort_values(["size", "cluster", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
    bins = Bins(capacity, per_source)
    placed = [bins.add(*x) for x in zip(out["size"].tolist(), pd.factorize(out["source"])[0].tolist(), pd.factorize(out["cluster"])[0].tolist(), strict=True)]
    out["bin"], out["slot"] = [b for b, _ in placed], [s for _, s in placed]
    return out[["doc_id", "piece", "start", "end", "size", "bin", "slot"]]


def pack(documents: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, cluster=None) -> DataFrame:
    """Spans of ``documents(doc_id, text, source)`` with the bins they go to: SCHEMA, in code points.

    ``cluster`` is the column expression of the duplicate cluster; texts alike but for case and white space
    are one cluster unless it is given. ``pack_apart`` gives that of near copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if cluster is None:
        cluster = F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), F.char_length(text).cast("long").alias("size"))
    shards = max(1, -(-documents.count() // shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("cluster"))), F.lit(shards))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = pack_rows(part, capacity, per_source)
        out["bin"] += int(key[0]) << 32
        return out

    filled = rows.where("size > 0").groupBy(shard.alias("shard")).applyInPandas(run, SCHEMA)
    none = rows.where("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), "size", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("slot"))
    return filled.unionByName(none)


def pack_apart(documents: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pack`` with the groups of near copies of ``jaccard.classes`` as clusters; rows without an id have the hash
    of their text. Rows that share an id share its least class."""
    docs = documents.select(F.col("doc_id").cast("long"), "text", "source")
    # a row for each id, and only for those whose class is not their own
    found = jaccard.classes(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("class_id")).where("class_id <> doc_id")
    found = found.withColumnRenamed("doc_id", "__id")
    joined = materialize(docs.join(found, docs["doc_id"] == found["__id"], "left").drop("__id"))
    text = F.regexp_replace(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\s+", " ")
    return pack(joined, capacity, per_source, shard_rows, F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.coalesce("class_id", "doc_id")))
