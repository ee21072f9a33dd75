"""Sharding by sampled splitters: records in the order of a key, in shards of near equal bytes.

1. Equal records (same text and id) are counted as one with so many copies.
2. Draw a sample in which a record stands with a weight of its bytes (the lowest of -ln(u)/bytes, u from a hash of
   the record, so the same in every run), at most SAMPLE records however large the input. Its quantiles, each record
   weighted by the bytes it stands for, are the splitters of fine ranges of the key.
3. Count bytes of every range over all records. A range is overfull if a border between two shards (i/n of all bytes)
   lies in it and it has several records, or if it has more than twice its share: it is divided anew by a sample
   drawn inside it. In the end each border lies in a range of one record, and moves to the nearest end of a copy: the
   borders are the splitters, and shards differ from an equal share by no more than one text on either side.
4. Range-partition the records by the splitters; the ranges before a record, the bytes and the rows before it in its
   own range give its place, and so its shard and slot.

The key is (60 bits of the text's MD5, doc_id), so a group of equal texts, however large, is divided too. No text is
shuffled.

Cases: null is an empty text, of size 1 (null: no bytes, plus 1); null ids come first in their text's group;
repeated rows follow each other, and may lie in two shards; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

SAMPLE = 32_768
#: Records of a fine range, and the most ranges to begin with.
RANGE_ROWS, RANGES = 4096, 8192
#: Parts of a range with a border between shards that is too large to be known record by record.
PARTS = 64

Key = tuple[int, bool, int]


def _key(row) -> Key:
    return row["k"], row["d"] is not None, row["d"] or 0


def _sample(records: DataFrame, salt: int) -> list[tuple[Key, float]]:
    """Keys of a sample weighted by bytes, in order, and the bytes that each stands for."""
    u = (F.pmod(F.xxhash64("k", "d", F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = records.select("k", "d", "bytes", (-F.log(u) / F.col("bytes")).alias("w")).orderBy("w", "k", "d").limit(SAMPLE + 1).collect()
    # a record is in the sample if its w is under the next one: with probability 1 - exp(-bytes * next)
    following = drawn.pop()["w"] if len(drawn) > SAMPLE else math.inf
    return sorted((_key(r), r["bytes"] / -math.expm1(-r["bytes"] * following)) for r in drawn)


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    total, seen, out = sum(w for _, w in sample), 0.0, set()
    for key, w in sample:
        if int(seen * parts / total) < int((seen + w) * parts / total):
            out.add(key)
        seen += w
    return sorted(out)


def _range_of(splitters: list[Key]):
    """The number of splitters at or below (k, d), by a binary search in the JVM."""
    if not splitters:
        return F.lit(0)
    # one literal, however many splitters
    at = F.from_json(F.lit(json.dumps([{"k": k, "d": d if known else None} for k, known, d in splitters])), "array<struct<k: long, d: long>>")
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]

    def step(low, width):
        there = F.get(at, low + width - 1)  # null past the end; a null id is the least
        return F.when(there <= F.struct(F.col("k").alias("k"), F.col("d").alias("d")), low + width).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _numbers(values: list[int]):
    return F.from_json(F.lit(json.dumps(values)), "array<long>")


def split(records: DataFrame, shards: int) -> tuple[list[Key], list[int], list[int]]:
    """Splitters of ``records(k, d, bytes, copies)``; the bytes before each range; the borders between shards, in bytes."""
    n = records.count()
    ranges = min(RANGES, max(shards, -(-n // RANGE_ROWS)))
    splitters, salt = _quantiles(_sample(records, 0), ranges), 0
    while True:
        counted = records.groupBy(_range_of(splitters).alias("r")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.max("copies").alias("copies"), F.max("bytes").alias("most")).collect()
        found = {r["r"]: r for r in counted}
        before = list(accumulate((found[r]["bytes"] if r in found else 0 for r in range(len(splitters) + 1)), initial=0))
        total = before[-1]
        borders = [i * total / shards for i in range(1, shards)]
        held = {bisect_right(before, b) - 1 for b in borders} if total else set()
        over = [r for r, x in found.items() if x["rows"] > 1 and (r in held or x["bytes"] > 2 * max(total / ranges, x["most"]))]
        if not over:
            break
        salt += 1
        inside: dict[int, list] = {r: [] for r in over}
        for key, w in _sample(records.where(_range_of(splitters).isin(over)), salt):
            inside[bisect_right(splitters, key)].append((key, w))
        new = set()
        for r, sample in inside.items():
            if found[r]["rows"] > len(sample) or r not in held:
                new.update(_quantiles(sample, max(PARTS if r in held else 2, int(2 * found[r]["bytes"] * ranges // total))))
                continue
            # all records of the range are known: the one with the border is cut out
            at = before[r]
            for i, (key, w) in enumerate(sample):
                if any(at <= b < at + w for b in borders):
                    new.update(k for k, _ in sample[i : i + 2])
                at += w
        if not new - set(splitters) and not held & set(over):
            break  # what is overfull has one large record that a neighbour goes with
        splitters = sorted({*splitters, *new})
    cuts = []
    for b in borders:
        if total:
            r = bisect_right(before, b) - 1
            size = (before[r + 1] - before[r]) // found[r]["copies"]
            cuts.append(before[r] + size * math.ceil((b - before[r]) / size - 0.5))
    return splitters, before, cuts


def shard_bytes(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``documents(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        F.col("doc_id"), F.col("doc_id").cast("long").alias("d"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("k"),
    )
    records = rows.groupBy("k", "d", "size", "text_crc32").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("bytes", F.col("size") * F.col("copies"))
    records = materialize(records)
    splitters, before, cuts = split(records, shards)
    dealt = records.withColumn("r", _range_of(splitters)).repartitionByRange(min(RANGES, len(before)), "r")
    order = Window.partitionBy("r").orderBy("k", F.col("d").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    start = F.get(_numbers(before), F.col("r")) + F.sum("bytes").over(order) - F.col("bytes")
    placed = dealt.select("doc_id", "size", "text_crc32", "r", "copies", start.alias("start"), (F.sum("copies").over(order) - F.col("copies")).alias("i"))
    each = placed.select("doc_id", "size", "text_crc32", "r", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy", "j"), "start", "i")
    place = F.col("start") + F.col("j") * F.col("size")
    shard = F.size(F.filter(_numbers(cuts), lambda c: c <= place)) if cuts else F.lit(0)
    out = materialize(each.select("doc_id", "size", "text_crc32", "r", (F.col("i") + F.col("j")).alias("i"), shard.cast("int").alias("shard")), records)
    # a shard's first row in a range has slot: the shard's rows in the ranges before it
    runs = out.groupBy("shard", "r").agg(F.count("*").alias("n"), F.min("i").alias("first"))  # at most ranges + shards rows
    runs = runs.select("shard", "r", (F.sum("n").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - F.col("first")).alias("shift"))
    return out.join(F.broadcast(runs), ["shard", "r"]).select("doc_id", "size", "text_crc32", "shard", (F.col("i") + F.col("shift")).cast("long").alias("slot"))
