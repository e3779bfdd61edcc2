"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of benchmark words.  A document can hold a window only if it holds all of its words, so it is
enough to join on the prefix of each window when its words are ordered by rarity: for exact containment that
prefix is the rarest word.  Rarity is counted over all documents.  A joined position fixes where the window would
begin; length and positional bounds drop what would stick out of the text, and the words in between are compared
exactly.  Generating words, joining, bounding and comparing are one fused stage over each document's own row;
texts are never shuffled.

Texts are read twice, once to count and once to join, whatever the number of windows.  Windows are broadcast if their
size, which is summed first, is at most `BROADCAST_BYTES`.  Larger sets are joined by shuffling: a bit table of the wanted words, of
fixed size, drops nearly all others before they leave their task, and a word takes along the few words around it only.

Results in special cases
------------------------
* null text, or one without words: no words, not hit; a benchmark item without words has no window;
* an item of fewer words than `size` is one window of its own length;
* equal windows in several items, or repeated items: every item_id that owns an occurring window counts once;
* null doc_id or item_id: an ordinary value; a null item_id is left out of the digest and of n_items;
* repeated doc_id: each row is judged by its own text;
* overlapping occurrences cover a word once; empty tables: no windows, nothing is hit; further columns are kept by
  `clean` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

SIZE = 10
#: Bytes of all windows that may be broadcast, and places of the table of wanted words otherwise (a byte each).
BROADCAST_BYTES, SLOTS = 64 << 20, 1 << 22
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, words): every run of `size` words, or the whole of a shorter item."""
    rows = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words")).distinct()


def row_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("row"))


def wanted(words: DataFrame) -> Callable[[Column], Column]:
    """A test for words (word): holds for all of them, and for few others."""
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")
    table = bytearray(SLOTS)
    for r in words.select(slot(F.col("word")).alias("slot")).distinct().toLocalIterator():  # SLOTS rows at most
        table[r["slot"]] = 1
    bits = bytes(table)
    return lambda w: F.substring(F.lit(bits), slot(w) + 1, 1) == F.lit(b"\x01")


def occurrences(docs: DataFrame, items: DataFrame, size: int = SIZE, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, __row, begin (word position), length, window (number), n_words, exactly where windows stand; and the windows.

    every: also a row without window for each document.
    """
    owned = common.cut(windows_of(items, size))
    windows = owned.select("words").distinct()
    windows = common.cut(windows.withColumn("window", F.monotonically_increasing_id()))
    bulk = F.aggregate("words", F.lit(64).cast("long"), lambda n, w: n + F.octet_length(w) + 16)
    small = (windows.agg(F.sum(bulk)).first()[0] or 0) <= BROADCAST_BYTES
    texts = docs.select("doc_id", row_id(F.col("text")).alias("__row"), words_of(F.col("text")).alias("w"))
    # rarity over all documents, of the words that occur in windows
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    said = texts.select(F.explode("w").alias("word"))
    said = said.join(F.broadcast(vocabulary), "word", "left_semi") if small else said.where(wanted(vocabulary)(F.col("word"))).join(vocabulary, "word", "left_semi")
    seen = said.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = W.partitionBy("window").orderBy("n", "word", "place")
    placed = windows.select("window", "words", F.posexplode("words").alias("place", "word")).join(seen, "word")
    # windows with a word that no document has are gone by the inner join if it is their rarest; the rest need all their words
    whole = placed.withColumn("found", F.count(F.lit(1)).over(W.partitionBy("window"))).where(F.col("found") == F.size("words"))
    prefix = whole.withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("window", "words", "place", F.col("word").alias("rarest"), F.size("words").alias("length"))
    prefix = common.cut(prefix)
    n_words = F.size("w").alias("n_words")
    # a document's last row is for itself: no word, so nothing is joined to it
    all_words = F.concat("w", F.array(F.lit(None).cast("string"))) if every else F.col("w")
    at = texts.select("doc_id", "__row", "w", n_words, F.posexplode(all_words).alias("at", "word"))
    if small:
        joined = at.join(F.broadcast(prefix), F.col("word") == F.col("rarest"), "left" if every else "inner").withColumns({"around": F.col("w"), "left": F.col("at")})
    else:
        keep = wanted(prefix.select(F.col("rarest").alias("word")))(F.col("word"))
        at = at.where(F.col("word").isNull() | keep if every else keep)
        left = F.least("at", F.lit(size - 1))
        at = at.select("doc_id", "__row", "n_words", "at", "word", left.alias("left"), F.slice("w", F.col("at") - left + 1, 2 * size - 1).alias("around"))
        joined = at.join(prefix, F.col("word") == F.col("rarest"), "left" if every else "inner")
    begin = F.col("at") - F.col("place")
    fits = (begin >= 0) & (begin + F.col("length") <= F.col("n_words"))
    # where a window would begin before its words do, `fits` has already said no
    exact = fits & (F.slice("around", F.greatest(F.col("left") - F.col("place"), F.lit(0)) + 1, F.col("length")) == F.col("words"))
    exact = F.coalesce(exact, F.lit(False))
    rows = joined.where(exact | F.col("word").isNull() if every else exact)
    return rows.select("doc_id", "__row", begin.alias("begin"), "length", "window", "n_words"), windows.join(owned, "words").select("window", "item_id")


def judged(found: DataFrame, owners: DataFrame) -> DataFrame:
    """A row per hit document: doc_id, __row, n_hit, item_ids (sorted as strings)."""
    found = found.select("doc_id", "__row", "begin", "length", "window").distinct()
    key = ["doc_id", "__row"]
    # the words covered: each stretch adds what lies beyond all stretches that begin before it
    stretch = found.groupBy(*key, "begin").agg(F.max("length").alias("length"))
    order = W.partitionBy(*key).orderBy("begin")
    end = F.col("begin") + F.col("length")
    reach = F.coalesce(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = stretch.withColumn("fresh", F.greatest(end - F.greatest(F.col("begin"), reach), F.lit(0)))
    hit = fresh.groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    # one row per document and window before the owners, so a passage that repeats in a text costs one
    owned = found.select(*key, "window").distinct().join(owners, "window").where(F.col("item_id").isNotNull())
    owned = owned.select(*key, F.col("item_id").cast("string").alias("item_id")).groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    owned = owned.withColumnsRenamed({"doc_id": "__doc", "__row": "__its"})
    same = hit["doc_id"].eqNullSafe(owned["__doc"]) & (hit["__row"] == owned["__its"])
    return hit.join(owned, same, "left").drop("__doc", "__its")


def report(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids, contaminated."""
    found, owners = occurrences(docs, items, size, every=True)
    found = common.cut(found)
    hit = judged(found.where("window IS NOT NULL"), owners).withColumnsRenamed({"doc_id": "__doc", "__row": "__its"})
    base = found.where("window IS NULL").select("doc_id", "__row", F.col("n_words").cast("long").alias("n_words"))
    out = base.join(hit, base["doc_id"].eqNullSafe(hit["__doc"]) & (base["__row"] == hit["__its"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    doc, its = common.free_names(docs, "doc", "its")
    found, _ = occurrences(common.plain_columns(docs, ["doc_id", "text"]), items, size)
    hit = common.cut(found.select(F.col("doc_id").alias(doc), F.col("__row").alias(its)).distinct())
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[doc]) & (row_id(docs["text"]) == hit[its]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.plain_columns(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    items = common.plain_columns(common.table(spark, sf_dir, "benchmark"), ["item_id", "text"])
    return report(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(translate(coalesce({text}, ''), '{common.UPPER}', '{common.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


_WORDS = words_sql("text")
OP8_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i : least(i + 9, len(w))] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents
), lengths AS (SELECT DISTINCT len(words) AS n FROM windows
), runs AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), found AS (SELECT r.doc_id, r.i, r.n, x.item_id FROM runs r JOIN windows x USING (words)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), owned AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN owned USING (doc_id)
"""
