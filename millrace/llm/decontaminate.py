"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become lists of word hashes (lower case, runs of letters and numbers). A seed takes the words at the fixed offsets of
a mask and ignores the others; seeds of benchmark items are joined with those of documents. A hit names a diagonal on which
the item's and the document's words are compared one by one. An item is found if WINDOW successive words on the diagonal
(whole items of SPAN to WINDOW - 1 words: all) agree in at least LEAST places. The two masks hit every such window, whatever
two of its words are replaced, so the seeds lose nothing. Of a run of hits on a diagonal only the first is verified, on a slice
of the document that is no longer than the item, so a text that repeats one word a million times needs no more memory.

The benchmark's seeds are broadcast in blocks of some MOST_SEEDS rows (48 bytes each), so their size is bounded; the items'
words are broadcast where one block holds all seeds, else joined with the hits. The documents are never shuffled, hits are.

Null and empty texts and items of fewer than SPAN words match nothing; texts are read whole; repeated rows and ids count
once; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The masks' offsets; any 11 of 13 successive words contain one of them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN, WINDOW, LEAST = 8, 13, 11
MOST_SEEDS = 1_000_000


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes(text: str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(mask: int, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get("h", at + o) for o in MASKS[mask]))


def _seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with columns keep and h -> one row for each seed: keep, h, at, mask, seed."""
    places = F.when(F.size("h") >= SPAN, F.sequence(F.lit(0), F.size("h") - SPAN))
    placed = rows.select(*keep, "h", F.explode(places).alias("at"))
    return placed.select(*keep, "h", "at", F.posexplode(F.array(*(_seed(k, F.col("at")) for k in range(len(MASKS))))).alias("mask", "seed"))


def _before(at: Column) -> Column:
    """The seed of the same mask one place earlier; null at the start."""
    before = at - 1
    kinds = F.when(F.col("mask") == 0, _seed(0, before))
    for k in range(1, len(MASKS)):
        kinds = kinds.when(F.col("mask") == k, _seed(k, before))
    return F.when(at > 0, kinds)


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, most_seeds: int) -> DataFrame:
    """(id, mark, item_id, matched, words) of each verified diagonal; mark is the text's hash."""
    items = benchmark.select(F.col(item_col).alias("item_id"), hashes(item_text).alias("h")).filter(F.size("h") >= SPAN).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "h"))
    seeds = _seeds(items.select("item", "h"), "item")
    seeds = seeds.select("item", F.size("h").alias("m"), F.col("mask").alias("kind"), "seed", F.col("at").alias("item_at"), _before(F.col("at")).alias("prior"))
    blocks = -(-seeds.count() // most_seeds) or 1
    theirs = items.select("item", "item_id", F.col("h").alias("theirs"))
    theirs = F.broadcast(theirs) if blocks == 1 else theirs  # fewer words than seeds
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), hashes(text_col).alias("h"))
    own = _seeds(rows, "id", "mark")
    turn = F.pmod(F.xxhash64("item", "kind", "item_at"), F.lit(blocks))
    return reduce(DataFrame.union, (_verified(own, seeds.filter(turn == b), theirs) for b in range(blocks)))


def _verified(of_docs: DataFrame, of_items: DataFrame, items: DataFrame) -> DataFrame:
    hits = of_docs.join(F.broadcast(of_items), "seed").filter("mask = kind")
    prior = _before(F.col("at"))
    hits = hits.filter(F.col("prior").isNull() | prior.isNull() | (prior != F.col("prior")))
    start = F.greatest(F.col("at") - F.col("item_at"), F.lit(0))
    skipped = start - (F.col("at") - F.col("item_at"))  # words of the item before the document's first
    n = F.least(F.size("h") - start, F.col("m") - skipped)  # a hit carries no more words than its item has
    met = hits.select("id", "mark", "item", "m", skipped.alias("skipped"), F.slice("h", start + 1, n).alias("own")).join(items, "item")
    equal = F.zip_with("own", F.slice("theirs", F.col("skipped") + 1, F.size("own")), lambda a, b: F.when(a == b, 1).otherwise(0))
    met = met.select("id", "mark", "item_id", "m", equal.alias("equal"))
    width = F.least(F.col("m"), F.lit(WINDOW))
    least = F.when(F.col("m") < WINDOW, F.col("m")).otherwise(LEAST)
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - width + 1), lambda s: F.aggregate(F.slice("equal", s, width), F.lit(0), lambda x, y: x + y))
    good = F.when(F.size("equal") >= width, F.array_max(sums) >= least).otherwise(False)
    total = F.aggregate("equal", F.lit(0), lambda x, y: x + y)
    return met.filter(good).select("id", "mark", "item_id", total.cast("long").alias("matched"), F.col("m").cast("long").alias("words"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_seeds: int = MOST_SEEDS) -> DataFrame:
    """(id, item_id, matched, words): each document and item of which it holds a window; matched: equal words on the best diagonal."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text, most_seeds)
    return found.groupBy("id", "item_id").agg(F.max("matched").alias("matched"), F.max("words").alias("words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns. A document is its id and text: others of the same
    or no id stay."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text, MOST_SEEDS)
    found = common.settle_keys(found.select(F.col("id").alias("__mr_id"), F.col("mark").alias("__mr_mark")).distinct(), "leaks")
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__mr_id")) & (F.xxhash64(text_col) == F.col("__mr_mark")), "left_anti")


ORACLE_SQL = """
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    bw AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b WHERE len(w) >= 8),
    e AS (SELECT doc_id, item_id, m, i - j AS diagonal, j FROM dw JOIN bw USING (word)),
    f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS matched,
                 count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near FROM e)
    SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(m)::BIGINT AS words FROM f
    WHERE near >= CASE WHEN m < 13 THEN m ELSE 11 END GROUP BY doc_id, item_id"""
