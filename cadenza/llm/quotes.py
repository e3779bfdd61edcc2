"""Quotation linking: nested quotes of messages are joined to the messages they come from, and conversations are put in
reply order without quotes.

A line's quote level is the number of leading `>` (white space between them is allowed).  A passage is a run of
lines of one level; it is normalised (lower case, single spaces) and hashed.  A quoted passage belongs to the
earliest message of its conversation whose own (unquoted) passage, or any single own line, has the same hash and
which comes before the quoting message.  A quoted passage that belongs to none as a whole (a trimmed or interleaved quote)
is looked up line by line in the same way, unless `by_line` is off.  A message replies to the origin that it quotes at the shallowest
level, as what it answers stands there and what that one answered stands deeper; of several, to the one that it quotes most characters
of at that level, the latest turn winning ties.  Roots are found by pointer doubling; a conversation is ordered by
the root's turn and then the turn, so that every reply follows what it answers.

Results in special cases
------------------------
* null or empty text: a message without lines to link; the cleaned text is empty;
* null conv_id or turn: the message links to nothing and is its own root;
* repeated (conv_id, turn): one message for linking; each row is returned, in any order among themselves;
* ties: fixed by level and turn as above; quotes without an origin are only taken out;
* passages found in very many messages: only the earliest holder of each conversation is kept, before any join;
* very long texts: lines are rows of their own; empty table: empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

QUOTED = r"^(?:[ \t]*>)+"


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), r"[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, its (the text's hash), run (its first line), alone, level, body (normalised), hash: runs of lines of one level, and their lines alone."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTED, "").alias("line")))
    rows = keyed.select("conv_id", "turn", F.xxhash64("text").alias("its"), lines.alias("lines"))
    # each line with the number of level changes before it: the number of its run
    last = lambda x, i: F.when(i == 0, x["level"]).otherwise(F.get(F.col("lines"), i - 1)["level"])
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get(F.col("lines"), i)["level"] != last(F.get(F.col("lines"), i), i)))
    rows = rows.withColumn("starts", starts)
    stop = lambda j: F.coalesce(F.get(F.col("starts"), j + 1), F.size("lines"))
    line = lambda x, at, alone: F.struct(x["level"].alias("level"), x["line"].alias("body"), at.alias("run"), F.lit(alone).alias("alone"))
    of = lambda at, j: F.slice("lines", at + 1, stop(j) - at)
    whole = lambda at, j: F.struct(
        F.get(F.col("lines"), at)["level"].alias("level"), F.array_join(F.transform(of(at, j), lambda x: x["line"]), " ").alias("body"), at.alias("run"), F.lit(False).alias("alone")
    )
    # a run of one line is that line already
    alone = lambda at, j: F.filter(F.transform(of(at, j), lambda x: line(x, at, True)), lambda x: stop(j) - at > 1)
    parts = F.concat(F.transform("starts", whole), F.flatten(F.transform("starts", alone)))
    out = rows.select("conv_id", "turn", "its", F.explode(parts).alias("p"))
    return out.select("conv_id", "turn", "its", "p.run", "p.alone", "p.level", normal(F.col("p.body")).alias("body")).where("body <> ''").withColumn("hash", F.xxhash64("body"))


def replies(messages: DataFrame, by_line: bool = True) -> DataFrame:
    """conv_id, turn, parent_turn, linked (characters of all linked quotes); `by_line` looks up passages without an origin line by line."""
    found = common.cut(passages(messages).select("conv_id", "turn", "its", "run", "alone", "level", "hash", F.char_length("body").alias("chars")))
    origins = common.cut(found.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")))
    linked = lambda x: x.join(origins, ["conv_id", "hash"]).where("origin < turn")
    quoted = found.where("level > 0")
    whole = common.cut(linked(quoted.where("NOT alone")))
    votes = whole
    if by_line:  # lines count only where their run as a whole is nobody's
        rest = quoted.where("alone").join(whole.select("conv_id", "turn", "its", "run").distinct(), ["conv_id", "turn", "its", "run"], "left_anti")
        votes = whole.unionByName(linked(rest))
    per_level = votes.groupBy("conv_id", "turn", "origin", "level").agg(F.sum("chars").alias("chars"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "chars", "origin"))
    return per_level.groupBy("conv_id", "turn").agg(best["origin"].alias("parent_turn"), F.sum("chars").alias("linked"))


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of the messages that reply to others, by pointer doubling."""
    at = common.cut(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        step = at.join(up, ["conv_id", "root_turn"], "left")
        at = common.cut(step.select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        if at.where("moved").limit(1).count() == 0:
            return at.drop("moved")
        at = at.drop("moved")


def conversations(messages: DataFrame, by_line: bool = True) -> DataFrame:
    """A row per message: conv_id, turn, role, text (without quotes), n_quoted_lines, max_level, parent_turn, root_turn, depth, position in the conversation."""
    rows = messages.select("conv_id", "turn", "role", "text")
    links = common.cut(replies(rows, by_line))
    tree = links.join(roots(links), ["conv_id", "turn"]).withColumnsRenamed({"conv_id": "__conv", "turn": "__turn"})
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    own = F.array_join(F.filter(lines, lambda x: ~x.rlike(QUOTED)), "\n")
    n_quoted = F.size(F.filter(lines, lambda x: x.rlike(QUOTED)))
    deepest = F.array_max(F.transform(lines, level))
    # quotes are gone before anything is shuffled
    base = rows.select("conv_id", "turn", "role", own.alias("text"), n_quoted.alias("n_quoted_lines"), deepest.alias("max_level"))
    out = base.join(common.cut(tree), (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left").select(
        "conv_id", "turn", "role", "text", "n_quoted_lines", "max_level",
        "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    placed = common.globally_indexed(out, [F.col("conv_id"), F.col("root_turn"), F.col("turn")], "__place")
    first = common.cut(placed.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("__place").alias("__first")))
    placed = placed.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return placed.withColumn("position", F.col("__place") - F.col("__first")).drop("__place", "__first", "__conv")


def as_mail(turns: DataFrame) -> DataFrame:
    """Conversations as mail: three of four turns quote, by (conv_id + turn) mod 4, the turn before as a whole (1), without its last line (2), or with the one before it a level deeper (3).

    The given turns hold hardly a quote; their own words stay as they are.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    before = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    # a text goes only to turns that quote it
    back = lambda n, *kinds: before.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"back{n}")).where(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).isin(*kinds))
    x = rows.join(back(1, 1, 2, 3), ["conv_id", "turn"], "left").join(back(2, 3), ["conv_id", "turn"], "left")
    quote = lambda c: F.regexp_replace(c, r"(?m)^", "> ")
    lines = F.split("back1", "\n")
    trimmed = F.when(F.size(lines) > 1, quote(F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    quoted = F.when(kind == 1, quote(F.col("back1"))).when(kind == 2, trimmed).when(kind == 3, F.concat_ws("\n", quote(quote(F.col("back2"))), quote(F.col("back1"))))
    return x.select("conv_id", "turn", "role", F.when(F.col("text").isNotNull() & (quoted != ""), F.concat(quoted, F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("text"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(as_mail(common.table(spark, sf_dir, "conversations")))


def _line_sql(x: str) -> str:
    return rf"length(regexp_replace(regexp_extract({x}, '^(?:[ \t]*>)+'), '[^>]', '', 'g'))"


def _normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


OP3_SQL = rf"""
WITH RECURSIVE c AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations
), b AS (SELECT conv_id, turn, min(text) AS t FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), x AS (SELECT c.*, string_split(b1.t, chr(10)) AS l1, string_split(b2.t, chr(10)) AS l2, (c.conv_id + c.turn) % 4 AS kind FROM c
  LEFT JOIN b b1 ON b1.conv_id = c.conv_id AND b1.turn = c.turn - 1 LEFT JOIN b b2 ON b2.conv_id = c.conv_id AND b2.turn = c.turn - 2
), y AS (SELECT *, CASE kind WHEN 1 THEN list_transform(l1, lambda v: '> ' || v) WHEN 2 THEN CASE WHEN len(l1) > 1 THEN list_transform(l1[1 : len(l1) - 1], lambda v: '> ' || v) END
  WHEN 3 THEN list_concat(list_transform(l2, lambda v: '> > ' || v), list_transform(l1, lambda v: '> ' || v)) END AS quoted FROM x
), m AS (SELECT id, conv_id, turn, role, CASE WHEN text IS NOT NULL AND len(quoted) > 0 THEN array_to_string(quoted, chr(10)) || chr(10) || text ELSE text END AS text FROM y
), n AS (SELECT id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS i FROM m
), lv AS (SELECT id, i, line, {_line_sql('line')} AS level, regexp_replace(line, '^(?:[ \t]*>)+', '') AS bare, regexp_matches(line, '^(?:[ \t]*>)+') AS is_quote FROM n
), st AS (SELECT *, coalesce((level <> lag(level) OVER (PARTITION BY id ORDER BY i))::INT, 1) AS fresh FROM lv
), rn AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run FROM st
), keyed AS (SELECT id, conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL
), w AS (SELECT id, run, any_value(level) AS level, count(*) AS n_lines, {_normal_sql("string_agg(bare, ' ' ORDER BY i)")} AS body FROM rn GROUP BY id, run
), p AS MATERIALIZED (SELECT k.conv_id, k.turn, q.* FROM keyed k JOIN (SELECT id, run, false AS alone, level, body FROM w UNION ALL SELECT rn.id, rn.run, true, rn.level, {_normal_sql('bare')} FROM rn JOIN w USING (id, run) WHERE n_lines > 1) q USING (id) WHERE body <> ''
), origins AS MATERIALIZED (SELECT conv_id, body, min(turn) AS origin FROM p WHERE level = 0 GROUP BY ALL
), whole AS MATERIALIZED (SELECT p.*, origin FROM p JOIN origins USING (conv_id, body) WHERE level > 0 AND NOT alone AND origin < turn
), votes AS (SELECT * FROM whole UNION ALL SELECT p.*, origin FROM p JOIN origins USING (conv_id, body) WHERE level > 0 AND alone AND origin < turn AND (id, run) NOT IN (SELECT (id, run) FROM whole)
), per AS (SELECT conv_id, turn, origin, level, sum(length(body)) AS chars FROM votes GROUP BY ALL
), parents AS MATERIALIZED (SELECT conv_id, turn, arg_max(origin, (-level, chars, origin)) AS parent_turn FROM per GROUP BY ALL
), walk AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM parents UNION ALL SELECT w.conv_id, w.turn, r.parent_turn, w.depth + 1 FROM walk w JOIN parents r ON r.conv_id = w.conv_id AND r.turn = w.root_turn
), roots AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM walk GROUP BY ALL
), own AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_quote), '') AS text, count(*) FILTER (is_quote) AS n_quoted_lines, max(level) AS max_level FROM rn GROUP BY id
), o AS (SELECT m.conv_id, m.turn, m.role, own.text, n_quoted_lines::INT AS n_quoted_lines, max_level::INT AS max_level, parent_turn, coalesce(root_turn, m.turn) AS root_turn, coalesce(depth, 0)::INT AS depth FROM m JOIN own USING (id) LEFT JOIN parents USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn))
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn) - 1 AS position FROM o
"""
