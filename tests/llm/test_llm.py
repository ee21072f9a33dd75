"""Each operator against a brute-force version on small tables, with the awkward rows: nulls, empty and very long
texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import html as html_lib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import decontaminate, html, jaccard, jpeg, lm, packing, quality, revisits, sharding, substrings
from graphloom.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, shard int"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def make(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    texts = [text(rng.randint(5, 200)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1] + " more words here", texts[2].upper(), text(40) + " " + passage + " " + text(30), text(20) + " " + passage, passage]
    near = texts[5].split()
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), None, "", "   ", "one two", "one two", "x" * 5000, text(6000), "é ñ ü ß 漢字 𠀀", "a\0b\nc"]
    return texts


TEXTS = make()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 0.5, 7, 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "without an id", "en", "s1", 3, 0.5, 7, 1), rows[3]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles():
    w = words_of(TEXTS)
    seen = {}
    for i, t in enumerate(TEXTS):
        a, b = w.offsets[i : i + 2]
        assert [(t or "")[x:y] for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)] == re.findall(r"\w+", t or "")
        for h, x in zip(w.hashes[a:b].tolist(), words(t), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_quality(spark, docs, empty):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "over", "stones", "and", "moss"]) for _ in range(60)) + "."
    bad = lambda: "BUY!! NOW!! " * 30
    rows = [(i, good() if i % 3 else bad(), 1 if i % 3 else 0) for i in range(300)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:200]] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    kept = {r.doc_id for r in quality.score(d, model).where(f"{quality.SCORE} >= 0.5").collect()}
    assert kept == {r[0] for r in rows if r[2]}
    none = quality.fit(d, labels.limit(0))
    scored = quality.score(docs, none)
    assert scored.count() == docs.count() and {r[quality.SCORE] for r in scored.collect()} == {0.5}
    assert quality.keep_good(empty, labels).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns


def test_packing_is_best_fit_and_keeps_conflicts_apart(docs, empty):
    capacity, per_source = 500, 2
    got = packing.pack(docs, capacity, per_source).collect()
    by_id = {r.doc_id: r for r in docs.collect()}
    spans = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        if r.bin is not None:
            spans[r.doc_id].append((r.start, r.end))
            bins[r.bin].append(r)
    for i, r in by_id.items():
        times = 2 if i == 3 else 1
        n = len(r.text or "")
        assert sorted(spans[i]) == sorted([(a, min(a + capacity, n)) for a in range(0, n, capacity)] * times)
    for rows in bins.values():
        assert sum(r.size for r in rows) <= capacity and sorted(r.slot for r in rows) == list(range(len(rows)))
        sources = Counter(by_id[r.doc_id].source for r in rows)
        sources.pop(None, None)
        assert max(sources.values(), default=0) <= per_source
        clusters = [re.sub(r"\s+", " ", by_id[r.doc_id].text.strip().lower()) for r in rows]
        assert len(set(clusters)) == len(clusters)
    assert packing.pack(empty).count() == 0


def test_bins_against_brute_force():
    rng = random.Random(5)
    bins, naive = packing.Bins(100, 2), []
    for size in sorted((rng.randint(1, 100) for _ in range(400)), reverse=True):
        source, cluster = rng.randint(-1, 4), rng.randint(0, 60)
        b, slot = bins.add(size, source, cluster)
        fits = [(100 - sum(x[0] for x in n), i) for i, n in enumerate(naive) if 100 - sum(x[0] for x in n) >= size and all(x[2] != cluster for x in n) and (source < 0 or sum(x[1] == source for x in n) < 2)]
        if not fits:
            naive.append([])
        want = min(fits)[1] if fits else len(naive) - 1
        assert (b, slot) == (want, len(naive[want]))
        naive[want].append((size, source, cluster))


def test_jpeg_round_trip(docs, empty):
    got = {r.doc_id: r for r in jpeg.digests(jpeg.media(docs)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        data = jpeg.write_jpeg(payload)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert jpeg.digests(jpeg.media(empty)).count() == 0
    with pytest.raises(ValueError):
        jpeg.read_jpeg(jpeg.write_jpeg(b"x" * 192)[:400])


def test_jpeg_fast_scans_equal_slow_ones():
    for n in (192, 576, 3840):
        data = jpeg.write_jpeg(np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes())
        fast, slow = jpeg.read_jpeg(data), jpeg.read_jpeg(data, fast=False)
        assert all((a.blocks == b.blocks).all() for a, b in zip(fast.components, slow.components, strict=True))
        assert (jpeg.to_rgb(fast) == jpeg.to_rgb(slow)).all()


def test_jpeg_sparse_scans():
    """A grey image with zero runs, end-of-band runs and a refinement that brings in new coefficients."""
    codes = {0x00: (0, 2), 0x10: (1, 2), 0x01: (2, 2), 0xF0: (6, 3), 0x02: (14, 4), 0x31: (30, 5), 0x21: (62, 6)}
    body = bytes([0, 3, 1, 1, 1, 1] + [0] * 10) + bytes([0x00, 0x10, 0x01, 0xF0, 0x02, 0x31, 0x21])
    assert jpeg._codes(body) == codes
    put = lambda s, *bits: format(codes[s][0], f"0{codes[s][1]}b") + "".join(bits)
    # first pass, half precision. Block 0: 2, then its end; blocks 1 and 2: a run of two ends; block 3: its end
    first = put(0x02, "10") + put(0x00) + put(0x10, "0") + put(0x00)
    to_bytes = lambda s: int((s + "1" * (-len(s) % 8)), 2).to_bytes((len(s) + 7) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\1" * 64) + jpeg._segment(0xC2, b"\x08\x00\x10\x00\x10\x01\x01\x11\x00") + jpeg._segment(0xC4, b"\x10" + body)
    scan = lambda data, high, low: jpeg._segment(0xDA, bytes([1, 1, 0, 1, 63, high << 4 | low])) + to_bytes(data)
    # refinement: block 0: a new -1 after 18 zeros (16 of them in one code), the 4 is not corrected; block 1: a new 1 after 3 zeros; block 2, 3: end
    refine = put(0xF0) + "0" + put(0x21, "0") + put(0x00) + put(0x31, "1") + put(0x00) + put(0x00) + put(0x00)
    image = jpeg.read_jpeg(head + scan(first, 0, 1) + scan(refine, 1, 0) + b"\xff\xd9")
    got = {(b, k): int(v) for b, row in enumerate(image.components[0].blocks) for k, v in enumerate(row) if v}
    assert got == {(0, 1): 4, (0, 20): -1, (1, 4): 1}
    assert jpeg.to_rgb(image).shape == (16, 16, 3)


def test_repeated_passages(docs, empty):
    spans = substrings.duplicate_spans(docs).collect()
    own = defaultdict(set)
    for i, t in enumerate(TEXTS):
        w = words(t)
        for k in range(len(w) - 49):
            own[" ".join(w[k : k + 50])].add(i)
    need = set().union(*[ids - {min(ids)} for ids in own.values() if len(ids) > 1])
    assert need and need <= {r.doc_id for r in spans}
    shingles = lambda t: {tuple(x) for x in zip(*[words(t)[k:] for k in range(5)], strict=False)}
    for r in spans:
        assert r.holder_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8
        assert len(words(TEXTS[r.doc_id][r.begin : r.end])) == r.n_words
        assert len(shingles(TEXTS[r.doc_id][r.begin : r.end]) & shingles(TEXTS[r.holder_id])) >= 0.8 * (r.n_words - 4)
    left = substrings.cut_duplicates(docs)
    assert left.columns == docs.columns
    after = defaultdict(set)
    for r in left.collect():
        for k in range(len(words(r.text)) - 49):
            if r.doc_id is not None:
                after[" ".join(words(r.text)[k : k + 50])].add(r.doc_id)
    assert all(len(x) == 1 for x in after.values())
    assert substrings.duplicate_spans(empty).count() == 0 and substrings.cut_duplicates(empty).count() == 0


def test_compact_windows_cover_each_sequence_once():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, span = int(rng.integers(1, 50)), int(rng.integers(1, 8))
        v = rng.integers(0, 25, n).astype(np.uint64)
        got = Counter((i, j) for c, lo, hi in zip(*substrings.compact_windows(v, span), strict=True) for i in range(lo, c + 1) for j in range(c, hi + 1) if j - i + 1 >= span and v[c] == v[i : j + 1].min())
        assert got == Counter((i, j) for i in range(n) for j in range(i + span - 1, n) if v[i : j + 1].min() > 0)


def test_lm_scores(docs, empty):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    counts, total = Counter(), 0
    for _, w in rows:
        total += len(w)
        counts.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    def s(g):
        if len(g) == 1:
            return np.log(counts[g] / total)
        return np.log(counts[g] / counts[g[:-1]]) if counts[g] >= 2 else np.log(0.4) + s(g[1:])

    want = sorted((str(i), len(w), round(float(sum(s(tuple(w[max(0, k - 2) : k + 1])) for k in range(len(w)))), 5)) for i, w in rows)
    got = lm.score(docs, block_bytes=3000, partition_bytes=500).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 5)) for r in got) == want
    assert lm.score(empty).count() == 0


def test_near_copies_against_brute_force(docs, empty):
    def shingles(t):
        w = words(t)
        return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else (t or "").strip()

    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect() if r.doc_id is not None]
    least = {}
    for i, s in rows:
        least[s] = min(i, least.get(s, i))
    linked = defaultdict(set)
    for a, b in itertools.combinations([s for s in least if isinstance(s, frozenset)], 2):
        if len(a & b) >= 0.8 * len(a | b):
            linked[least[a]].add(least[b])
            linked[least[b]].add(least[a])

    def root(i):
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in linked[todo.pop()] if not (x in seen or seen.add(x))]
        return min(seen)

    want = sorted((i, root(least[s]), least[s], len(linked[least[s]])) for i, s in rows)
    got = jaccard.classes(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want and any(w[3] for w in want)
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, None, None, None)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({w[1] for w in want})
    assert jaccard.classes(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(80):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_sharding(spark, docs, empty, monkeypatch):
    repeated = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500, "same text")] * 90 + [(None, None)] * 3, "doc_id long, text string"))
    rows = [(i, t) for i, t in map(tuple, repeated.collect())]

    def key(r):
        raw = (r[1] or "").encode()
        return int(hashlib.md5(raw).hexdigest()[:15], 16), r[0] is not None, r[0] or 0

    def want(shards):
        """An independent placement: in order, borders at the end of a row nearest to equal shares."""
        ordered = sorted(rows, key=key)
        sizes = [len((t or "").encode()) + 1 for _, t in ordered]
        ends = [0, *itertools.accumulate(sizes)]
        borders = [min(ends, key=lambda e: (abs(e - i * ends[-1] / shards), e)) for i in range(1, shards)]
        out, slots = [], Counter()
        for (i, t), size, at in zip(ordered, sizes, ends, strict=False):
            shard = sum(b <= at for b in borders)
            out.append((str(i), size, zlib.crc32((t or "").encode()), shard, slots[shard]))
            slots[shard] += 1
        return sorted(out)

    for shards, sample in ((4, 32_768), (7, 10), (1, 10)):
        monkeypatch.setattr(sharding, "SAMPLE", sample)
        monkeypatch.setattr(sharding, "RANGE_ROWS", 8)
        got = sharding.shard_bytes(repeated, shards).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == want(shards)
    assert sharding.shard_bytes(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(words(TEXTS[4])[:20])), (2, TEXTS[4].upper()), (3, "one TWO"), (4, None), (5, ""), (10, "not in any document at all"), (1, "one TWO"), (None, "a b c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    want = []
    for r in docs.collect():
        w, hit, ids = tokens(r.text), set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])] - {None}
        names = ",".join(sorted(map(str, ids)))
        want.append((str(r.doc_id), len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [(str(r[0]), *r[1:6]) for r in decontaminate.contamination(docs, benchmark).collect()]
    assert sorted(got) == sorted(want) and any(x[5] for x in want)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    assert decontaminate.keep_uncontaminated(docs, benchmark).columns == docs.columns


def test_proximity_against_brute_force(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    items = [(i, text(rng.randint(1, 6))) for i in range(30)] + [(99, "a a"), (98, "none")]
    counts = Counter(w for _, t in docs for w in t.split())
    want = {}
    for d, t in docs:
        w, found = t.split(), set()
        for i, x in items:
            rare = sorted(set(x.split()), key=lambda w: (counts[w], w))[:4]
            if len(rare) > 1 and any(a == rare[0] and all(any(y == b and abs(p - q) <= 12 for q, y in enumerate(w)) for b in rare[1:]) for p, a in enumerate(w)):
                found.add(i)
        want[d] = len(found)
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.n_near for r in got.collect()} == want and any(want.values())


def test_benchmark_stage_catches_short_hits_in_long_texts(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    item = text(60)
    docs = [(1, text(20_000) + " " + item + " " + text(20)), (2, text(300)), (2, item), (3, " ".join(item.split()[5:18])), (4, " ".join(item.split()[5:17])), (None, None)]
    kept = decontaminate.keep_uncontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [docs[1], docs[4], docs[5]]))


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a> <a>More</a></nav>
    <div class="ad">Buy this now</div><article><h1>A&amp;B</h1><p>First <b>bo</b>ld &eacute;&#233; text.<p>Second\n  one<br>line</p><script>var a="</p>";</script>
    <div class="comments"><p>I liked it</p></div></article><footer>&copy; us</footer></body></html>"""
    want = "A&B First bold éé text. Second one line"
    others = [(i, f"u{i}", page.replace("First", "First " + "word " * i)) for i in range(1, 30)]
    pages = spark.createDataFrame([(0, "u", page), (99, "u", None), (98, None, ""), (97, "u", "<p>plain"), (96, "u", "<<>> & <")] + others, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got[0] == (want, len(want)) and got[5][0] == want.replace("First", "First " + "word " * 5).replace("  ", " ")
    assert got[99] == got[98] == ("", 0) and got[97][0] == "plain"
    assert html.extract(pages.limit(0)).count() == 0
    assert html_lib.unescape("&amp;") == "&"


def test_revisits(spark):
    rng = random.Random(4)
    h = lambda **k: [(a.replace("_", "-"), b) for a, b in k.items()]
    rows = []
    for i in range(300):
        url = rng.choice(["http://Hot.example/a/?b=2&a=1#x", "https://hot.example:443/a?a=1&utm_source=q&b=2", f"http://e{rng.randint(0, 20)}.example/", None])
        if rng.random() < 0.4:
            rows.append((i, url, rng.randint(0, 50), 200, h(ETag=f'"{i % 3}"', Last_Modified=str(i % 2), Content_Length="9"), f"body{i}"))
        else:
            rows.append((i, url, rng.randint(0, 50), rng.choice([304, 304, 304, 404]), rng.choice([h(etag=f'W/"{i % 3}"', Content_Length="0"), h(last_modified="1"), None, h(date="d")]), None))
    rows.append((900, "http://hot.example/a?a=1&b=2", None, 304, None, None))
    captures = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers array<struct<name:string,value:string>>, payload string")
    keys = {r.record_id: r.k for r in captures.select("record_id", revisits.canonical_url(captures.url).alias("k")).collect()}
    assert len({keys[r[0]] for r in rows if r[1] and "ot.ex" in r[1]}) == 1
    want = {}
    for i, _, ts, status, headers, _ in rows:
        if status != 304:
            continue
        earlier = [r for r in rows if r[3] == 200 and keys[r[0]] is not None and keys[r[0]] == keys[i] and ts is not None and r[2] < ts]
        if not earlier:
            want[i] = (None, "orphan")
            continue
        r = max(earlier, key=lambda r: (r[2], r[0]))
        mine, stored = ({a.lower(): b for a, b in x or []} for x in (headers, r[4]))
        same = mine["etag"].removeprefix("W/") == stored["etag"] if "etag" in mine else mine["last-modified"] == stored["last-modified"] if "last-modified" in mine else True
        want[i] = (r[0], "merged" if same else "changed")
    for slices in (1, 8, 512):
        got = revisits.resolve(captures, slices).collect()
        assert {r.record_id: (r.response_id, r.outcome) for r in got} == want
    for r in got:
        if r.outcome == "merged":
            assert ("content-length", "9") in [tuple(x) for x in r.headers] and r.payload == f"body{r.response_id}"
    assert revisits.resolve(captures.limit(0)).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, TEXTS[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    part = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, part, str(tmp_path))
        assert out.columns == part.columns and out.count() <= part.count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert 4 not in {r.doc_id for r in packed.collect()} and packed.count() > 20


def test_passages_shared_behind_partial_holders(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(40):
        p, line = text(60), text(20)
        parts = [p[:40], p[20:], p[:45], p[15:], line, line, p, p]
        for i, part in enumerate(parts):
            rows.append((8 * k + i, " ".join(text(70) + part + text(70))))
        want.add((8 * k + 7, 8 * k + 6))
    got = substrings.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.holder_id) for r in got} == want
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)


def test_passages_beside_text_that_stands_elsewhere():
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, line = word(80), word(14)
    near = passage[:40] + ["changed"] + passage[41:]
    held = passage + word(300) + line
    for copy, begin in ((near + line, 0), (line + near, 14), (line + near + line, 14)):
        a, b = (words_of([" ".join(x)]).shingles(5)[0][: len(x) - 4] for x in (copy, held))
        (i, j, s), = substrings.passages(a, b)
        assert (i, j) == (begin, begin + 76) and s == 71 / 81


def test_main_text_inside_wrappers():
    weight = html.DEFAULT
    article = "<article><p>One two three four</p></article>"
    aside = "<div class='comments'><p>I liked it</p></div><form><label>Find it</label></form>"
    for open_, shut in (("<div class='layout has-sidebar'>", "</div>"), ("<div class='with-nav'>", "</div>"), ("<section id='social-policy'>", "</section>"), ("<div class='post-comments-enabled'>", "</div>"), ("<form action='/'>", "</form>"), ("<div id='sidebar'>", "</div>")):
        assert html.main_text(f"<body>{open_}{article}{shut}{aside}</body>", weight) == "One two three four"
        assert html.main_text(f"<body>{open_}<p>One two three four five six seven eight</p>{shut}{aside}</body>", weight) == "One two three four five six seven eight"
        assert html.main_text(f"<body>{open_}{article}{aside}{shut}</body>", weight) == "One two three four"
    long = "<div id='comments'><article><p>" + "I liked it " * 3 + "</p></article><article>So did I</article></div>"
    words = "word " * 40
    assert html.main_text(f"<body><main><p>{words}</p></main>{long}</body>", weight) == words.strip()
    assert html.main_text(f"<body><main><form><p>{words}</p></form></main></body>", weight) == words.strip()


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    from graphloom.llm import queries

    rng = random.Random(8)
    text = [f"w{rng.randint(0, 99)}" for _ in range(100)]
    near = lambda i: " ".join([*text[:i], "changed", *text[i + 1 :]] if i % 2 else [*text, f"line {i}"])
    rows = [(i, near(i), None) for i in range(20)] + [(100 + i, f"short text {i}", None) for i in range(20)]
    rows += [(None, "no id", None), (None, "no  ID", None), (0, near(0), None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    copies = [r.bin for r in got if r.doc_id is not None and r.doc_id < 20]
    assert len(copies) == 21 == len(set(copies))
    assert len({r.bin for r in got if r.doc_id is None}) == 2 and len({r.bin for r in got}) == 21


def test_jpeg_tensors_are_stored(docs):
    table = jpeg.stored(docs)
    for r in table.collect():
        rgb = jpeg.to_rgb(jpeg.read_jpeg(bytes(r.media)))
        assert (r.tensor.height, r.tensor.width, bytes(r.tensor.rgb)) == (*rgb.shape[:2], rgb.tobytes())
    digests = lambda df: sorted(map(str, jpeg.digests(df).collect()))
    assert digests(table) == digests(jpeg.media(docs))


def drifting(words_in: int, changes: int, groups: int, seed: int):
    """Unlike documents with passages of ``words_in`` words, each copy of which changes ``changes`` more words than the
    one before; and the pairs (copy, earlier copy) of passages whose similarity is 0.8 or more."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    sets = lambda w: set(zip(*[w[k:] for k in range(5)], strict=False))
    rows, need = [], set()
    for g in range(groups):
        p, copies = text(words_in), []
        for k in range(5):
            copies.append(list(p))
            for _ in range(changes):
                p[rng.randrange(len(p))] = text(1)[0]
            rows.append((10 * g + k, " ".join(text(60) + copies[-1] + text(60))))
        need |= {10 * g + b for a, b in itertools.combinations(range(5), 2) if len(sets(copies[a]) & sets(copies[b])) >= 0.8 * len(sets(copies[a]) | sets(copies[b]))}
    return rows, need


def test_passages_that_drift(spark):
    for words_in in (60, 100):
        rows, need = drifting(words_in, 1, 100, words_in)
        got = substrings.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(need & {r.doc_id for r in got}) >= 0.95 * len(need) > 300


def test_exact_passages_behind_many_partial_holders(spark):
    """More documents than are linked share parts of the passage, so that only its whole runs tell."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(20):
        p = text(52)
        parts = [p, *[p[a:] if a % 2 else p[:-a] for a in rng.sample(range(4, 12), 8) for _ in range(3)], p]
        for i, part in enumerate(parts):
            rows.append((100 * k + i, " ".join(text(70) + part + text(70))))
        want.add((100 * k + len(parts) - 1, 100 * k))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.holder_id) for r in substrings.duplicate_spans(docs).collect()}
    assert want <= got


def test_whole_windows_and_regions():
    rng = random.Random(6)
    for _ in range(200):
        windows = [{"number": rng.randrange(5), "begin": (b := rng.randrange(60)), "end": b + rng.randint(1, 40)} for _ in range(rng.randint(1, 12))]
        covered = [x for x in range(101) if sum(any(w["begin"] <= x < w["end"] for w in windows if w["number"] == k) for k in range(5)) >= 4]
        assert [x for a, b in substrings.whole_windows(windows) for x in range(a, b)] == covered
    link = lambda n, a, b, c, d: (a, b, c, d, n)
    assert substrings.regions([link(0, 0, 10, 50, 60), link(1, 5, 20, 55, 70), link(2, 15, 30, 500, 510), link(3, 40, 50, 90, 99)]) == [(0, 20, 50, 70)]


def test_repeated_ids_have_their_own_spans(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    p, other = text(80), text(120)
    docs = spark.createDataFrame([(1, p), (2, p), (2, other), (3, other + " " + p)], "doc_id long, text string")
    assert sorted(map(tuple, substrings.cut_duplicates(docs).collect())) == [(1, p), (2, other)]


def test_best_window_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        own, b = rng.integers(0, 12, rng.integers(1, 9)), rng.integers(0, 12, rng.integers(1, 20))
        size = int(rng.integers(1, 25))
        before = np.array([max([k for k in range(p) if b[k] == b[p]], default=-1) for p in range(len(b))])
        sets = [set(b[k : k + size].tolist()) for k in range(max(1, len(b) - size + 1))]
        mine = set(own.tolist())
        assert abs(substrings._best_window(own, b, before, size) - max(len(mine & x) / len(mine | x) for x in sets)) < 1e-9


def test_near_copies_with_repeated_ids(spark):
    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(60))
    p, other, third = text(), text(), text()
    near = p + " more"
    docs = spark.createDataFrame([(1, p), (2, p), (2, other), (2, other), (3, near), (3, third), (4, third + " more"), (None, p)], "doc_id long, text string")
    rows = Counter(map(tuple, jaccard.classes(docs).collect()))
    assert rows == Counter([(1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 2, 0), (2, 2, 2, 0), (3, 1, 3, 1), (3, 3, 3, 1), (4, 3, 4, 1), (None, None, None, None)])
    assert sorted(map(str, map(tuple, jaccard.keep_one(docs).collect()))) == sorted(map(str, [(1, p), (2, other), (3, third), (None, p)]))


def test_fit_bound_holds_for_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, good: seen.append(len(x)))
    quality.fit(docs, labels, 2)
    assert seen == [2]
    with pytest.raises(ValueError):
        quality.score(docs.withColumn(quality.SCORE, docs.doc_id), None)


def test_main_text_of_marked_paragraphs_and_split_references():
    page = "<body><article><h1>Head</h1><p class='alert box'>Mind the gap</p><p>more <label>words</label> here</p><div class='share'><p>Share it</p></div><p>to the end</p></article></body>"
    assert html.main_text(page, html.DEFAULT) == "Head Mind the gap more words here to the end"
    assert html.main_text("<p>a &am<b>p;</b> b &amp; c</p>", html.DEFAULT) == "a &amp; b & c"


def test_region_against_all_regions():
    rng = random.Random(15)
    weight = {"": 1.0, "p": -1.5, "/p": -1.5, "div": -2.5, "/div": -0.5}
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "x y ", "z "]) for _ in range(14))
        found = html.tokens(page)
        score = lambda t: sum(len(x.split()) * weight[""] if not k else weight[k] for k, x, _ in t)
        text = lambda t: " ".join(" ".join(x for _, x, _ in t).split())
        regions = [found[i:j] for i in range(len(found)) for j in range(i + 1, len(found) + 1)]
        best = max(map(score, regions), default=0)
        texts = {text(r) for r in regions if score(r) == best} if best > 0 else {""}
        assert html.main_text(page, weight) in texts


def test_main_text_of_long_and_repeated_pages_with_further_columns(spark):
    long = "<article><p>" + "word " * 100_000 + "</p></article>"
    rows = [(1, "u", long, "a", 1), (1, "u", long, "b", 2), (None, None, "<p>x</p>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 499_999), ("1", 499_999), ("None", 1)] and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_fit_takes_all_documents_and_all_pairs(spark):
    rng = random.Random(21)
    text = lambda bad: " ".join(rng.choice(["the", "River", "ran", "over!", "12", "stones"] + ["NOW!", "7"] * (2 * bad)) for _ in range(rng.randint(5, 60)))
    rows = [(i, text(i % 3 == 0), int(i % 3 > 0) if i % 10 else i // 10 % 2) for i in range(9000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    x, good = quality.features([r[1] for r in rows]), np.array([r[2] for r in rows]) == 1
    scale = x.std(axis=0)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(scale > 1e-9, scale, 1))
    # the gradient over all pairs, one by one, is zero
    z, gradient = model.inputs(x), -1e-3 * model.weights
    s, worse = z @ model.weights, z[~good]
    for i in np.flatnonzero(good):
        lost = 1 / (1 + np.exp(s[i] - s[~good]))
        gradient += (lost.sum() * z[i] - lost @ worse) / (good.sum() * (~good).sum())
    assert np.abs(gradient).max() < 1e-8
    assert abs(model.threshold - np.sort(s)[[(~good).sum() - 1, (~good).sum()]].mean()) < 1e-9


def test_reported_passages_are_not_looked_for_once_more(spark):
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    p = text(120)
    near = p[:60] + ["changed"] + p[61:]
    docs = spark.createDataFrame([(i, " ".join(text(70) + (near if i % 2 else p) + text(70))) for i in range(12)], "doc_id long, text string")
    got = substrings.duplicate_spans(docs).collect()
    # no copy's halves beside the copy
    assert {r.doc_id for r in got if r.n_words == 120} == set(range(1, 12)) and all(r.n_words > 70 for r in got)
    spans = [{"begin": int(b), "end": int(b + rng.randint(1, 30))} for b in rng.sample(range(60), 8)]
    begin, end = np.array([(b, b + n) for b in range(80) for n in (1, 5, 20)]).T
    assert substrings.inside_spans(begin, end, spans).tolist() == [any(x["begin"] <= b and e <= x["end"] for x in spans) for b, e in zip(begin, end, strict=True)]
    assert not substrings.inside_spans(begin, end, None).any()


def test_jpeg_tensors_are_stored_slice_by_slice(docs, empty, monkeypatch):
    stored, alive, most = [], set(), []
    kept, gone = jpeg.materialize, jpeg.discard

    def write(df, **how):
        out = kept(df, **how)
        if "tensor" in out.columns:
            alive.add(out._graphloom_folder)
            most.append(len(alive))
            stored.extend(r.doc_id for r in out.select("doc_id").collect())
        return out

    def drop(*frames):
        alive.difference_update(x._graphloom_folder for x in frames)
        gone(*frames)

    monkeypatch.setattr(jpeg, "materialize", write)
    monkeypatch.setattr(jpeg, "discard", drop)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(jpeg.sliced_digests(docs, 3)) == rows(jpeg.digests(jpeg.media(docs)))
    assert Counter(stored) == Counter(r.doc_id for r in docs.select("doc_id").collect()) and most == [1, 1, 1] and not alive
    assert jpeg.sliced_digests(empty, 2).count() == 0


def hidden_near_copies(groups: int, holders: int, seed: int):
    """Near copies, a changed word in 52, of a passage the parts of which more documents have than are linked."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(groups):
        p = text(52)
        near = p[:26] + ["changed"] + p[27:]
        parts = [p[:26], p[27:]] * holders + [p] + [p[:26], p[27:]] * holders + [near]
        rows += [(100 * k + i, " ".join(text(70) + part + text(70))) for i, part in enumerate(parts)]
        want.add((100 * k + len(parts) - 1, 100 * k + 2 * holders))
    return rows, want


def test_near_passages_behind_many_partial_holders(spark, monkeypatch):
    rows, want = hidden_near_copies(20, 8, 31)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (4096, 5):
        monkeypatch.setattr(substrings, "BLOCK", block)
        got = substrings.duplicate_spans(docs, whole=True).collect()
        assert {(r.doc_id, r.holder_id) for r in got} == want and all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)
