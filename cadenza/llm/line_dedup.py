"""Removal of lines that repeat across documents, as per-document keep bitmaps.

Every line's key is hashed to 128 bits.  The hashes are range-partitioned together with a slice of the document
ids and sorted by document and position, so a first occurrence in a document is told from its neighbour in
the stream.  A hash that a third of all documents hold is spread over the slices; each slice gives one partial row
(documents, largest document), and those are added up.  What comes back is, per document, a run-length
compressed bitmap of the lines to keep; only whoever needs the text applies it.

A key found in at least `min_docs` documents keeps its lines in the largest doc_id that holds it, and loses
all others.

Results in special cases
------------------------
* null or empty text: one empty line, kept; the kept text is empty;
* null doc_id: its lines neither count nor go; all are kept;
* repeated doc_id: rows of one doc_id count as one document; each row has its own bitmap, told apart by its text;
* ties: none are possible, the largest doc_id is one document (all its lines stay, repeats included);
* very long texts: lines are separate rows, nothing is gathered but one document's own dropped positions;
* empty table: empty result; further columns, however named, are kept by `deduplicate` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.binding import bound
from . import common

MIN_CHARS, MIN_DOCS = 20, 3
#: Least slices of one hash, and lines of one slice at most: a line that every document has is spread over as many as that takes.
SLICES, SLICE_ROWS = 64, 1_000_000


def line_key(line: Column) -> Column:
    return common.ascii_lower(common.ascii_strip(line))


def text_id(text: Column) -> Column:
    """With the doc_id, tells rows apart where a doc_id repeats."""
    return F.xxhash64(text, F.lit("row"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line whose key is long enough: doc_id, __text, pos, h1, h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_id(text).alias("__text"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = rows.where(F.char_length("line") >= min_chars).select("doc_id", "__text", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "__text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keeper of the keys that at least min_docs documents hold."""
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(max(SLICES, -(-lines.count() // SLICE_ROWS)))).alias("slice")
    ranged = lines.select("h1", "h2", piece, "doc_id", "pos").repartitionByRange("h1", "h2", "slice")
    order = W.partitionBy("h1", "h2", "slice").orderBy("doc_id", "pos")
    # the range partitioning has each (h1, h2, slice) in one place, so this window streams over it without a further exchange
    before = F.lag("doc_id").over(order)
    first = F.when(before.isNull() | (before != F.col("doc_id")), 1).otherwise(0)
    sliced = ranged.withColumn("first", first).groupBy("h1", "h2", "slice").agg(F.sum("first").alias("n"), F.max("doc_id").alias("keeper"))
    return sliced.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, __text, dropped (sorted positions): rows that lose lines only."""
    lines = common.cut(lines_of(docs, min_chars))
    # written first, so that both sides of the join come from exchanges of its own and a hot key is split at run time
    gone = lines.join(common.cut(repeated_keys(lines, min_docs)), ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    return gone.groupBy("doc_id", "__text").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def dropped_runs(dropped: Column) -> Column:
    """first and last: where the runs of dropped lines begin and end."""
    near = lambda p, i, step: F.coalesce(F.get(dropped, i + step) == p + step, F.lit(False))
    return F.struct(F.filter(dropped, lambda p, i: ~near(p, i, -1)).alias("first"), F.filter(dropped, lambda p, i: ~near(p, i, 1)).alias("last"))


def keep_bitmap(n_lines: Column, dropped: Column) -> Column:
    """Run lengths kept, dropped, kept, ... in turn, beginning with kept: the compressed bitmap."""

    def lengths(r: Column) -> Column:
        after = lambda j: F.coalesce(F.get(r["last"], j - 1) + 1, F.lit(0))
        pairs = F.flatten(F.transform(r["first"], lambda p, j: F.array(p - after(j), F.get(r["last"], j) - p + 1)))
        rest = n_lines - F.element_at(r["last"], -1) - 1
        return F.when(rest > 0, F.concat(pairs, F.array(rest))).otherwise(pairs)

    return F.when(dropped.isNull(), F.array(n_lines)).otherwise(bound(dropped_runs(dropped), lengths))


def marked(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, Column, Column]:
    """The documents with two more columns: their lines (array) and the dropped ones (positions or null)."""
    doc, own, lines, dropped = common.free_names(docs, "doc", "own", "lines", "dropped")
    gone = dropped_positions(common.plain_columns(docs, ["doc_id", "text"]), min_chars, min_docs).withColumnsRenamed({"doc_id": doc, "__text": own, "dropped": dropped})
    text = F.coalesce(docs["text"], F.lit(""))
    # rows that lose nothing still meet the join: it is decided by key, not by reading the text twice
    out = docs.join(gone, (docs["doc_id"] == gone[doc]) & (text_id(text) == gone[own]), "left")
    return out.withColumn(lines, F.split(text, "\n")).drop(doc, own), F.col(f"`{lines}`"), F.col(f"`{dropped}`")


def kept_text(lines: Column, dropped: Column) -> Column:
    """The kept lines joined again."""

    def kept(r: Column) -> Column:
        begin = lambda j: F.coalesce(F.get(r["last"], j - 1) + 1, F.lit(0))
        stretch = lambda j: F.slice(lines, begin(j) + 1, F.coalesce(F.get(r["first"], j), F.size(lines)) - begin(j))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(r["first"])), stretch)), "\n")

    return F.when(dropped.isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(bound(dropped_runs(dropped), kept))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_runs (the compressed bitmap); no text moves."""
    docs = common.plain_columns(docs, ["doc_id", "text"])
    gone = dropped_positions(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "__doc", "__text": "__own"})
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_id(text).alias("its"), F.size(F.split(text, "\n")).alias("n_lines"))
    out = rows.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.col("its") == F.col("__own")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), keep_bitmap(F.col("n_lines"), F.col("dropped")).alias("keep_runs"))


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with the repeated lines gone from their text; all columns stay as they are."""
    out, lines, dropped = marked(docs, min_chars, min_docs)
    text = F.when(dropped.isNull(), F.col("text")).otherwise(kept_text(lines, dropped))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lines, dropped = marked(common.plain_columns(common.table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    n = F.size(lines)
    return docs.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(lines, dropped), 256).alias("kept_sha256"),
        keep_bitmap(n, dropped).alias("keep_runs"),
    )


_STRIP = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
OP9_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate({_STRIP}, '{common.UPPER}', '{common.LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone FROM keyed k LEFT JOIN repeated r USING (key)
), runs AS (
  SELECT doc_id, gone, min(pos) AS first_pos, count(*) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS island FROM judged
  ) GROUP BY doc_id, gone, island
), bitmaps AS (
  SELECT doc_id, CASE WHEN arg_min(gone, first_pos) THEN list_prepend(0, list(run ORDER BY first_pos)) ELSE list(run ORDER BY first_pos) END AS runs FROM runs GROUP BY doc_id
)
SELECT j.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256, any_value(runs)::INT[] AS keep_runs
FROM judged j JOIN bitmaps USING (doc_id) GROUP BY j.doc_id
"""
