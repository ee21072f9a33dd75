"""What the text operators share: vectorised words and shingles, and tables in the shared folder.

A *word* is a maximal run of letters, digits and underscores, compared without regard to case. Words of a
whole chunk of documents are found and hashed with a few numpy passes over its code points, so there is no
Python work per word. Hashes are 64 bits, alike on every worker and in every run.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Code points handled in one vectorised pass; a longer document makes a pass of its own.
CHUNK_CHARS = 1 << 17

_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, as in tests, under a temporary one, if all runs on
    this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *spent: DataFrame, by: str | None = None, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut, every executor sees it.
    The tables ``spent``, which nothing later reads, are deleted then. ``by``: a column that parts the files."""
    path = shared_folder(df.sparkSession)
    (df.write.option("compression", compression) if compression else df.write).parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_folder = path
    discard(*spent)
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of tables that ``materialize`` wrote."""
    for df in frames:
        path = getattr(df, "_graphloom_folder", None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def size_on_disk(table: DataFrame) -> int:
    """Bytes of a table that ``materialize`` wrote."""
    folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._graphloom_folder)
    return folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 2**16: whether it is part of words, and a number for its lower case.
    Code points above count as part of words and as themselves."""
    chars = [chr(i) for i in range(1 << 16)]
    word = np.fromiter((c.isalnum() or c == "_" for c in chars), bool, 1 << 16)
    word[-1] = True
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint64, 1 << 16)
    return word, lower


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _BASE, and of its inverse modulo 2**64, to at least ``n``."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK_CHARS) + 2, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of some documents: ``hashes[offsets[d]:offsets[d+1]]`` are those of the d-th one; ``starts`` and
    ``ends`` are code point positions in its text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for the ``width`` words that start at each word, and whether they lie in one document."""
        n = len(self.hashes)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= width:
            s = np.zeros(n - width + 1, np.uint64)
            for j in range(width):
                s = s * np.uint64(_STEP) + self.hashes[j : n - width + 1 + j]
            out[: n - width + 1] = mix(s)
            ok[: n - width + 1] = True
            ends = self.offsets[1:]
            for j in range(1, width):
                ok[np.clip(ends[ends >= j] - j, 0, n - 1)] = False
        return out, ok


def words_of(texts: list[str]) -> Words:
    """Words of the texts. Null is no text."""
    joined = "\0".join(t or "" for t in texts)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word, lower = _tables()
    at = np.minimum(codes, 0xFFFF)
    edges = np.flatnonzero(np.diff(is_word[at].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power(len(codes))
    value = lower[at]
    if len(codes) and codes.max() > 0xFFFF:
        value = np.where(codes > 0xFFFF, codes.astype(np.uint64), value)
    value = (value + np.uint64(0x51ED27)) * np.uint64(_STEP)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(value * power[: len(codes)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    offsets = np.searchsorted(starts, np.append(begins, len(codes) + 1))
    doc = np.repeat(begins, np.diff(offsets))
    return Words(hashes, starts - doc, ends - doc, offsets)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row slices with about CHUNK_CHARS code points of text each, whole documents always."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            n = len(t or "") + 1
            if size and size + n > CHUNK_CHARS:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without_spans(rows: DataFrame, spans: str) -> DataFrame:
    """``rows`` whose text lacks what the column ``spans`` (begin, end in code points, in order, or null) covers.
    Column n_chars, if there, follows the text."""
    # what stands between the spans: the furthest end so far is carried along
    kept = F.aggregate(
        spans, F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["begin"] - acc["at"], F.lit(0)))).alias("s"), F.greatest(acc["at"], x["end"]).alias("at")),
        lambda acc: F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))),
    )
    had = F.col(spans).isNotNull()
    out = rows.withColumn("text", F.when(had, kept).otherwise(F.col("text")))
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(had, F.char_length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
