"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

Words are lower-cased (A-Z only) runs of digits, ASCII letters and all other non-ASCII characters. The index is a
stored table with a posting (term, document, position) for each word that is a term of the benchmark, and one at its
end for each document, which so holds the number of its words. Documents are read once for it.

1. The index tells how often each term stands. The places of a window, 13 words of an item, are ordered from the
   rarest term on. A window with a term that no document has cannot occur.
2. The list of the rarest term, shifted by its offset, gives candidates: alignments of a document with an item.
   Neighbouring windows share their rarest term and so these.
3. The shifted lists of the second and the third rarest term are intersected with the candidates, one after the
   other. Neither grows with the commonest terms.
4. What is left is compared with the words of the few documents concerned in full: exact phrase matches.
5. Proximity matches: an item's NEAR_TERMS rarest terms, each at most NEAR_WITHIN words from one occurrence of the
   rarest, in any order.

Tables made from the benchmark are broadcast while they have BROADCAST_BYTES or less on disk, and joined by shuffle
beyond.

Cases: null and empty texts have no words; items without words have no windows; repeated items count once by
item_id; an item with a null id makes hits but is in no list; an item of one term makes no proximity match; repeated
documents come back as often as they stand; rows that share an id are told apart by a hash of the text; empty tables
give no rows, or no hits. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, size_on_disk

#: Characters between words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
NEAR_TERMS, NEAR_WITHIN = 4, 12
BROADCAST_BYTES = 8 << 20
#: The term at the end of each document; as a separator it is in no word.
END = "\0"


def words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), "")


def document_key() -> Column:
    """Tells rows of ``documents(doc_id, text)`` apart."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))


def _small(df: DataFrame, source: DataFrame) -> DataFrame:
    """For joins with a selection of the stored table ``source``: broadcast only if that is small."""
    return F.broadcast(df) if size_on_disk(source) <= BROADCAST_BYTES else df


def index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: term, doc, pos of the words of ``documents(doc, words)`` that are in the stored table
    ``terms(term)``, and of END."""
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term")))
    found = documents.select("doc", F.posexplode(F.array_append("words", F.lit(END))).alias("pos", "term"))
    return materialize(found.join(_small(wanted, terms), "term", "left_semi").select("term", "doc", "pos"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """i, item, words: the different items of ``benchmark(item_id, text)`` with words, with a key; a stored table."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    return materialize(items.select(F.xxhash64("item", F.array_join("words", " ")).alias("i"), "item", "words"))


def _counted(items: DataFrame, terms: DataFrame) -> DataFrame:
    """i, places: the (n, term, offset) of each item's words in order."""
    places = items.select("i", F.posexplode("words").alias("offset", "term")).join(terms, "term", "left")
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")
    return places.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("offset", place.alias("place")))).alias("all")).select("i", F.transform("all", lambda x: x["place"]).alias("places"))


def windows(counted: DataFrame, width: int = WINDOW) -> DataFrame:
    """i, start, n, first, second, third: all windows of items that may occur, with the (n, term, offset) of their
    rarest terms (fewer in shorter windows)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("places") - width, F.lit(0)))
    each = counted.select("i", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_sort(F.slice("places", s + 1, width)).alias("rare")))).alias("w"))
    rare = [F.get("w.rare", F.lit(k)).alias(name) for k, name in enumerate(("first", "second", "third"))]
    return each.select("i", F.col("w.start").alias("start"), F.size("w.rare").alias("n"), *rare).where("first.n > 0")


def phrase_starts(postings: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """doc, i, start, at, n: candidates for windows ``found`` of stored ``items``: the window that starts at ``start``
    of the item, at ``at`` of the document. Its three rarest terms stand where they must."""
    first = found.select("i", F.col("first.term").alias("term"), F.col("first.offset").alias("offset")).distinct()
    aligned = postings.join(_small(first, items), "term").select("doc", "i", "offset", (F.col("pos") - F.col("offset")).alias("shift"))
    on = found.withColumnRenamed("i", "j").withColumn("o", F.col("first.offset"))
    out = aligned.join(_small(on, items), (F.col("i") == F.col("j")) & (F.col("offset") == F.col("o"))).where("shift + start >= 0").select("doc", "i", "shift", "start", "n", "second", "third")
    for name in ("second", "third"):
        terms = found.select(F.col(f"{name}.term").alias("term")).where("term IS NOT NULL").distinct()
        lists = postings.join(_small(terms, items), "term", "left_semi").select(F.col("term").alias("t"), F.col("doc").alias("d"), F.col("pos").alias("p")).distinct()
        wanted = (F.col("doc") == F.col("d")) & (F.col(f"{name}.term") == F.col("t")) & (F.col("shift") + F.col(f"{name}.offset") == F.col("p"))
        out = out.join(lists, wanted, "left").where(F.col(name).isNull() | F.col("t").isNotNull()).drop("t", "d", "p")
    return out.select("doc", "i", "start", (F.col("shift") + F.col("start")).alias("at"), "n").distinct()


def phrases(documents: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """doc, hits: the candidates that ``documents(doc, text)`` confirm word by word, (at, n, item) each."""
    whole = candidates.join(_small(items, items), "i").select("doc", F.struct("at", "n", F.slice("words", F.col("start") + 1, F.col("n")).alias("want"), "item").alias("hit"))
    by_doc = materialize(whole.groupBy("doc").agg(F.collect_set("hit").alias("hits")))
    # only the documents concerned are split into words and joined
    ids = by_doc.select("doc")
    concerned = documents.join(_small(ids, by_doc), "doc", "left_semi").dropDuplicates(["doc"])
    same = F.filter("hits", lambda x: F.slice(F.col("words"), x["at"] + 1, x["n"]) == x["want"])
    joined = concerned.select("doc", words(F.col("text")).alias("words")).join(by_doc, "doc")
    return joined.select("doc", F.transform(same, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["item"].alias("item"))).alias("hits")).where("size(hits) > 0")


def rarest(counted: DataFrame, terms: int = NEAR_TERMS) -> DataFrame:
    """i, rare: the (n, term) of each item's ``terms`` rarest terms, of items with several that may occur."""
    kinds = F.array_sort(F.array_distinct(F.transform("places", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term")))))
    return counted.select("i", F.slice(kinds, 1, terms).alias("rare")).where("size(rare) > 1 AND rare[0].n > 0")


def near(postings: DataFrame, rare: DataFrame, items: DataFrame, within: int = NEAR_WITHIN) -> DataFrame:
    """doc, i, at: occurrences of an item's rarest term with the other ones of ``rare`` at most ``within`` words away."""
    first = rare.select("i", F.col("rare")[0]["term"].alias("term"), (F.size("rare") - 1).alias("others"))
    others = rare.select("i", F.explode(F.expr("slice(rare, 2, size(rare))")).alias("r")).select("i", F.col("r.term").alias("term"))
    # positions meet by cells of ``within`` words and their neighbours
    cell = lambda x: F.floor(x / F.lit(within)).cast("int")
    begin = postings.join(_small(first, items), "term").select("doc", "i", "others", F.col("pos").alias("at"))
    spread = begin.select("*", F.explode(F.array(*[cell(F.col("at")) + k for k in (-1, 0, 1)])).alias("cell"))
    beside = postings.join(_small(others, items), "term").select(F.col("doc").alias("d"), F.col("i").alias("j"), "term", "pos", cell(F.col("pos")).alias("c"))
    met = spread.join(beside, (F.col("doc") == F.col("d")) & (F.col("i") == F.col("j")) & (F.col("cell") == F.col("c"))).where(F.abs(F.col("pos") - F.col("at")) <= within)
    return met.select("doc", "i", "at", "others", "term").distinct().groupBy("doc", "i", "at", "others").count().where("count = others").select("doc", "i", "at")


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """For each row of ``documents(doc_id, text)``: n_words, n_hit, n_items, items_sha256, contaminated; leaked (a
    window of full width stands in it); n_near (items with a proximity match); h (a hash of the text)."""
    docs = documents.select(document_key().alias("doc"), "text")
    items = items_of(benchmark)
    terms = materialize(items.select(F.explode("words").alias("term")).distinct())
    postings = index(docs.select("doc", words(F.col("text")).alias("words")), terms)
    counted = materialize(_counted(items, postings.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))))
    parts, rare = windows(counted, width), rarest(counted)
    # one scan of the index finds all lists that are searched
    searched = parts.select(F.explode(F.array("first.term", "second.term", "third.term")).alias("term")).unionByName(rare.select(F.explode("rare.term").alias("term"))).distinct()
    lists = materialize(postings.join(_small(searched, counted), "term", "left_semi"))
    candidates = materialize(phrase_starts(lists, counted, parts))
    found = phrases(docs, candidates, items)
    named = F.array_sort(F.array_compact(F.array_distinct(F.transform("hits", lambda x: x["item"]))))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    hits = found.select("doc", named.alias("items"), F.size(covered).alias("n_hit"), F.exists("hits", lambda x: x["n"] == width).alias("leaked"))
    close = near(lists, rare, counted).select("doc", "i").distinct().join(_small(items.select("i", "item"), items), "i").groupBy("doc").agg(F.countDistinct("item").alias("n_near"))
    rows = postings.where(F.col("term") == END).select("doc", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hits, "doc", "left").join(close, "doc", "left")
    ids, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("leaked", F.lit(False)).alias("leaked"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("doc.h").alias("h"),
    )


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without a window of full width of an item and not contaminated by shorter items, all
    columns as they are."""
    bad = contamination(documents, benchmark).where("contaminated OR leaked").select(F.struct("doc_id", "h").alias("__doc")).distinct()
    keyed = documents.select(document_key().alias("__key"), F.struct("*").alias("__row"))
    return keyed.join(bad, F.col("__key") == F.col("__doc"), "left_anti").select("__row.*")
