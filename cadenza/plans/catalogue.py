"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can say it.

Every query takes the whole of its tables.  Stand-ins: clips are `embeddings` rows, takes are `lineitem` rows, words are
timed tokens of `documents`, the consent ledger is `events`.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, signal, text, vectors
from ..functions.files import filesystem, scratch
from ..operators import consent, entities, gates, ingest, listings, ranking, reports, seams, segment, takes
from ..sources import audio, delivery, files
from ..streaming import ledger as streams
from ..streaming import live
from . import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- stand-ins -------------------------------------------------------------------------------------------------


def clip_rows(spark, sf):
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        i, F.col("label").alias("source"), F.col("embedding").alias("emb"), (20.0 * i).alias("start"), (4.0 + i % 10).alias("duration"), (10.0 + i % 31).alias("snr_db"),
        (0.4 + (i % 13) / 20.0).alias("confidence"), (80.0 + (i * 7) % 120).alias("f0_median"), (1.5 + (i % 17) / 8.0).alias("rate_wps"), ((i % 29) / 10000.0).alias("clipping"), (5000.0 + (i % 23) * 150).alias("bandwidth"),
    )


CLIPS = """clips AS (SELECT vec_id, label AS source, embedding AS emb, 20.0::DOUBLE * vec_id AS start, 4.0::DOUBLE + vec_id % 10 AS duration, 10.0::DOUBLE + vec_id % 31 AS snr_db,
 0.4::DOUBLE + (vec_id % 13) / 20.0::DOUBLE AS confidence, 80.0::DOUBLE + (vec_id * 7) % 120 AS f0_median, 1.5::DOUBLE + (vec_id % 17) / 8.0::DOUBLE AS rate_wps,
 (vec_id % 29) / 10000.0::DOUBLE AS clipping, 5000.0::DOUBLE + (vec_id % 23) * 150 AS bandwidth FROM embeddings)"""


def take_rows(spark, sf):
    w = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS part", f"{w} AS take", "l_returnflag <> 'R' AS ok", "0.7D + l_discount * 3 AS q", "1 + l_tax * 10 AS rtf", "l_discount * 2 AS cer", "0.4D + l_discount * 5 AS similarity",
        "l_quantity AS duration", "l_tax * 20 AS longest_pause", "CASE WHEN l_returnflag = 'R' THEN concat('bad ', l_linestatus) ELSE '' END AS reason", "l_suppkey % 50 AS voice", "concat('e', l_partkey % 6) AS engine", "concat('ref0', l_linenumber % 4) AS reference",
    )


TAKES = """takes AS (SELECT l_orderkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS take, l_returnflag <> 'R' AS ok,
 0.7::DOUBLE + l_discount * 3 AS q, 1 + l_tax * 10 AS rtf, l_discount * 2 AS cer, 0.4::DOUBLE + l_discount * 5 AS similarity, l_quantity AS duration, l_tax * 20 AS longest_pause,
 CASE WHEN l_returnflag = 'R' THEN 'bad ' || l_linestatus ELSE '' END AS reason, l_suppkey % 50 AS voice, 'e' || (l_partkey % 6) AS engine, 'ref0' || (l_linenumber % 4) AS reference FROM lineitem)"""


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'verified' WHEN 'click' THEN 'attested' WHEN 'error' THEN 'revoked' END"
_LEDGER = f"""SELECT user_id AS voice, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, status, CASE WHEN status = 'attested' OR event_id % 4 = 0 THEN 'attested' ELSE 'spoken' END AS kind,
 CASE WHEN event_id % 3 > 0 THEN event_id % 20 / 20.0 END AS match, date_trunc('day', ts) AS created FROM (SELECT *, {_STATUS} AS status FROM events) WHERE status IS NOT NULL"""
_REFUSAL = "CASE WHEN status IS NULL THEN 'missing' WHEN status NOT IN ('verified', 'attested') THEN status WHEN kind = 'spoken' AND match < 0.45 THEN 'another speaker' ELSE '' END"
LEDGER = f"ledger AS ({_LEDGER}), now AS (SELECT *, {_REFUSAL} AS refusal FROM (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY seq DESC) AS last FROM ledger) WHERE last = 1)"


def ledger_rows(spark, sf):
    x = table(spark, sf, "events").withColumn("status", F.expr(_STATUS)).where("status IS NOT NULL")
    return x.selectExpr(
        "user_id AS voice", "ts", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq", "status", "CASE WHEN status = 'attested' OR event_id % 4 = 0 THEN 'attested' ELSE 'spoken' END AS kind",
        "CASE WHEN event_id % 3 > 0 THEN double(event_id % 20 / 20.0D) END AS match", "date_trunc('day', ts) AS created",
    )


def asked_rows(spark, sf):
    """Customers who ask, a month after all events."""
    x = table(spark, sf, "customer").selectExpr("c_custkey AS voice", "c_name AS speaker", "c_custkey", "c_mktsegment AS segment")
    return x.crossJoin(F.broadcast(table(spark, sf, "events").agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("now"))))


ASKED = "asked AS (SELECT c_custkey AS voice, c_name AS speaker, c_custkey, c_mktsegment AS segment, (SELECT max(ts) + INTERVAL 30 DAYS FROM events) AS now FROM customer)"


# --- gates -----------------------------------------------------------------------------------------------------


def gated(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    x = d.join(lab, "doc_id", "left").withColumn("tokens", F.size(F.split("text", r"\s+")))
    rules = [(F.col("n_chars") < 200, "too short"), (F.col("tokens") > 2000, "too long"), (F.col("quality") == 0, "low quality"), (F.col("toxic") == 1, "toxic")]
    return x.withColumn("reason", gates.first_failing(*rules))


GATED = r"""gated AS (SELECT *, CASE WHEN n_chars < 200 THEN 'too short' WHEN tokens > 2000 THEN 'too long' WHEN quality = 0 THEN 'low quality' WHEN toxic = 1 THEN 'toxic' ELSE '' END AS reason
 FROM (SELECT d.*, l.quality, l.toxic, len(string_split_regex(d.text, '\s+')) AS tokens FROM documents d LEFT JOIN labels l USING (doc_id)))"""


@query(f"WITH {GATED} SELECT doc_id, lang, tokens, reason FROM gated")
def quality_gate(spark, sf):
    return gated(spark, sf).select("doc_id", "lang", "tokens", "reason")


@query(f"WITH {GATED} SELECT reason, count(*) AS n, min(doc_id) AS first_position FROM gated WHERE reason <> '' GROUP BY reason")
def rejection_histogram(spark, sf):
    return gates.histogram(gated(spark, sf), "reason", "doc_id")


@query(f"""WITH {CLIPS} SELECT vec_id, CASE WHEN clipping > 0.001 THEN 'clipped' WHEN bandwidth < 6000 THEN 'low bandwidth' WHEN snr_db < 18 THEN 'noisy'
 WHEN confidence < 0.55 THEN 'unclear speech' WHEN f0_median <= 0 THEN 'no voiced speech' ELSE '' END AS reason FROM clips""")
def clip_gate(spark, sf):
    x = clip_rows(spark, sf)
    return x.select("vec_id", gates.first_failing(*gates.clip_rules(*map(F.col, ("clipping", "bandwidth", "snr_db", "confidence", "f0_median")))).alias("reason"))


@query(f"""WITH {CLIPS} SELECT vec_id, coalesce('contains ' || nullif(array_to_string(list_sort(list_filter([CASE WHEN vec_id % 5 / 10.0 >= 0.2 THEN 'Radio' END, CASE WHEN vec_id % 7 / 10.0 >= 0.2 THEN 'Music' END], lambda x: x IS NOT NULL)), ', '), ''), '') AS reason FROM clips""")
def event_screen(spark, sf):
    p = F.create_map(F.lit("Radio"), F.col("vec_id") % 5 / 10.0, F.lit("Music"), F.col("vec_id") % 7 / 10.0, F.lit("Speech"), F.lit(0.9))
    return clip_rows(spark, sf).select("vec_id", gates.contaminants(p).alias("reason"))


# --- robust scores, shortlists ---------------------------------------------------------------------------------


@query("""WITH m AS (SELECT lang, median(n_chars) AS med FROM documents GROUP BY lang), d AS (SELECT lang, median(abs(n_chars - med)) AS mad FROM documents JOIN m USING (lang) GROUP BY lang)
 SELECT doc_id, lang, round(CASE WHEN mad < 1e-9 THEN 0 ELSE least(3, greatest(-3, (n_chars - med) / (1.4826 * mad))) END, 6) AS z FROM documents JOIN m USING (lang) JOIN d USING (lang)""")
def robust_z_score(spark, sf):
    x = ranking.robust_z(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["lang"], ["n_chars"])
    return x.select("doc_id", "lang", F.round("z_n_chars", 6).alias("z"))


CENTRED = f"""{CLIPS}, parts AS (SELECT source, p, avg(e) AS m FROM (SELECT source, unnest(emb)::DOUBLE AS e, generate_subscripts(emb, 1) AS p FROM clips) GROUP BY source, p),
 raw AS (SELECT source, list(m ORDER BY p) AS m FROM parts GROUP BY source), centre AS (SELECT source, list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-9)) AS c FROM raw),
 sims AS (SELECT clips.*, list_inner_product(emb::DOUBLE[], c) / (sqrt(list_inner_product(emb::DOUBLE[], emb::DOUBLE[])) * sqrt(list_inner_product(c, c)) + 1e-9) AS sim FROM clips JOIN centre USING (source))"""


def with_sim(spark, sf):
    x = clip_rows(spark, sf)
    return x.join(vectors.centroids(x, ["source"], "emb"), "source").withColumn("sim", vectors.cosine(F.col("emb"), F.col("centroid"))).drop("centroid", "n")


@query(f"WITH {CENTRED} SELECT source, list_transform(c, lambda x: round(x, 6)) AS centroid, n FROM centre JOIN (SELECT source, count(*) AS n FROM clips GROUP BY source) USING (source)")
def centroid_by_label(spark, sf):
    return vectors.centroids(clip_rows(spark, sf), ["source"], "emb").select("source", vectors.rounded(F.col("centroid"), 6).alias("centroid"), "n")


@query(f"WITH {CENTRED} SELECT vec_id, round(sim, 6) AS sim FROM sims")
def cosine_to_target(spark, sf):
    return with_sim(spark, sf).select("vec_id", F.round("sim", 6).alias("sim"))


@query(f"""WITH {CENTRED}, cut AS (SELECT source, coalesce(greatest(0.1, median(sim) FILTER (sim >= 0.1) - 0.05), 0.1) AS cut FROM sims GROUP BY source)
 SELECT vec_id, source, round(sim, 6) AS sim, round(cut, 6) AS cut FROM sims JOIN cut USING (source) WHERE sim >= cut""")
def adaptive_similarity_cut(spark, sf):
    x = ranking.adaptive_cut(with_sim(spark, sf), ["source"], "sim", 0.1, 0.05)
    return x.select("vec_id", "source", F.round("sim", 6).alias("sim"), F.round("cut", 6).alias("cut"))


@query(f"""WITH {CLIPS}, t AS (SELECT source, p, sum(e) AS s FROM (SELECT source, unnest(emb)::DOUBLE AS e, generate_subscripts(emb, 1) AS p FROM clips) GROUP BY source, p),
 tot AS (SELECT source, list(s ORDER BY p) AS s FROM t GROUP BY source), r AS (SELECT source, emb::DOUBLE[] AS e, list_transform(list_zip(s, emb::DOUBLE[]), lambda z: z[1] - z[2]) AS o FROM clips JOIN tot USING (source))
 SELECT source, round(median(list_inner_product(o, e) / ((sqrt(list_inner_product(o, o)) + 1e-9) * (sqrt(list_inner_product(e, e)) + 1e-9))), 6) AS self_similarity FROM r GROUP BY source""")
def self_similarity_loo(spark, sf):
    return vectors.self_similarity(clip_rows(spark, sf), ["source"], "emb").select("source", F.round("self_similarity", 6).alias("self_similarity"))


def _z(c):
    return f"CASE WHEN mad_{c} < 1e-9 THEN 0 ELSE least(3, greatest(-3, ({c} - med_{c}) / (1.4826 * mad_{c}))) END"


_SIX = ("sim", "confidence", "snr_db", "f0_dev", "rate_dev", "length_fit")
def _scored(rows: str, tag: str) -> str:
    """CTEs for the composite score within the pool `rows`; the result is `{tag}scored`."""
    return f"""{tag}pool AS (SELECT source, median(f0_median) AS f0, median(rate_wps) AS rate FROM {rows} GROUP BY source),
 {tag}dev AS (SELECT x.*, abs(12 * log2(f0_median / f0)) AS f0_dev, abs(ln(greatest(rate_wps, 0.1) / greatest(rate, 0.1))) AS rate_dev, -greatest(0, 7 - duration, duration - 11) AS length_fit FROM {rows} x JOIN {tag}pool USING (source)),
 {tag}med AS (SELECT source, {', '.join(f'median({c}) AS med_{c}' for c in _SIX)} FROM {tag}dev GROUP BY source),
 {tag}mad AS (SELECT source, {', '.join(f'median(abs({c} - med_{c})) AS mad_{c}' for c in _SIX)} FROM {tag}dev JOIN {tag}med USING (source) GROUP BY source),
 {tag}scored AS (SELECT {tag}dev.*, 0.40 * ({_z('sim')}) + 0.20 * ({_z('confidence')}) + 0.15 * ({_z('snr_db')}) + 0.15 * (-(({_z('f0_dev')}) + ({_z('rate_dev')})) / 2) + 0.10 * ({_z('length_fit')}) AS score FROM {tag}dev JOIN {tag}med USING (source) JOIN {tag}mad USING (source))"""


SCORED = f"{CENTRED}, {_scored('sims', '')}"


@query(f"WITH {SCORED} SELECT vec_id, source, round(score, 6) AS score FROM scored")
def clip_composite_score(spark, sf):
    return ranking.clip_scores(with_sim(spark, sf), ["source"]).select("vec_id", "source", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT vec_id, source, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, vec_id) AS place FROM scored) WHERE place <= 8")
def shortlist(spark, sf):
    x = ranking.clip_scores(with_sim(spark, sf), ["source"]).withColumn("score", F.round("score", 6))
    return ranking.top(x, ["source"], [F.desc("score"), F.col("vec_id")], 8).select("vec_id", "source", "place")


def _greedy(pool: str, tag: str, n: int) -> str:
    """CTEs for the greedy choice of n rows of each source, by (score, vec_id), out of `pool`; the result is `{tag}`."""
    return f"""{tag}_order AS MATERIALIZED (SELECT *, list_transform(emb::DOUBLE[], lambda x: x / (sqrt(list_inner_product(emb::DOUBLE[], emb::DOUBLE[])) + 1e-9)) AS u, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS nr FROM {pool}),
 {tag}_walk AS (SELECT source, 0::BIGINT AS nr, []::STRUCT(vec_id BIGINT, start DOUBLE, u DOUBLE[])[] AS taken FROM (SELECT DISTINCT source FROM {pool})
  UNION ALL SELECT o.source, o.nr, CASE WHEN len(list_filter(w.taken, lambda t: abs(t.start - o.start) < 60 OR list_inner_product(t.u, o.u) > 0.97)) = 0 THEN list_append(w.taken, struct_pack(vec_id := o.vec_id, start := o.start, u := o.u)) ELSE w.taken END
  FROM {tag}_walk w JOIN {tag}_order o ON o.source = w.source AND o.nr = w.nr + 1 WHERE len(w.taken) < {n}),
 {tag}_last AS (SELECT source, arg_max(taken, nr) AS taken FROM {tag}_walk GROUP BY source),
 {tag} AS (SELECT source, unnest(list_transform(taken, lambda t: t.vec_id)) AS vec_id, unnest(range(1, len(taken) + 1))::INT AS chosen FROM {tag}_last)"""


@query(f"WITH RECURSIVE {SCORED}, rounded AS (SELECT * REPLACE (round(score, 6) AS score) FROM scored), {_greedy('rounded', 'best', 8)} SELECT vec_id, source, score, chosen FROM best JOIN rounded USING (source, vec_id)")
def diverse_topk(spark, sf):
    x = ranking.clip_scores(with_sim(spark, sf), ["source"]).select("vec_id", "source", "start", F.round("score", 6).alias("score"), "emb", F.col("vec_id").alias("pos"))
    return ranking.diverse_top(x, ["source"], 8, apart=60.0, alike=0.97).select("vec_id", "source", "score", "chosen")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, spent AS spent_before FROM (SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM lineitem) WHERE spent < 600""")
def budget_prefix(spark, sf):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return ranking.budget_prefix(table(spark, sf, "lineitem"), ["l_suppkey"], order, "l_quantity", 600).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "spent_before")


PAIRS = f"""{CLIPS}, unit AS (SELECT vec_id, emb::DOUBLE[] AS e FROM clips), pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e)) + 1e-9) AS c FROM unit x JOIN unit y ON x.vec_id < y.vec_id)"""


@query(f"WITH {PAIRS} SELECT a, b, round(c, 5) AS cosine FROM pairs WHERE c >= 0.25")
def near_pairs(spark, sf):
    return ranking.similar_pairs(clip_rows(spark, sf), "vec_id", "emb", 0.25).select("a", "b", F.round("cosine", 5).alias("cosine"))


def clustered(spark, sf):
    x = clip_rows(spark, sf).withColumnRenamed("vec_id", "id")
    return ranking.density_clusters(x, "emb", 0.25), x.select("id", "duration")


def _clusters() -> str:
    """CTEs for four greedy rounds over near pairs; the result is `clusters`."""
    out = f"""{PAIRS}, near AS MATERIALIZED (SELECT a, b FROM pairs WHERE c >= 0.25 UNION ALL SELECT b, a FROM pairs WHERE c >= 0.25 UNION ALL SELECT vec_id, vec_id FROM clips),
 left0 AS MATERIALIZED (SELECT vec_id, duration FROM clips)"""
    for k in range(4):
        out += f""", m{k} AS MATERIALIZED (SELECT a FROM near JOIN left{k} y ON y.vec_id = b WHERE a IN (SELECT vec_id FROM left{k}) AND (SELECT count(*) FROM left{k}) >= 3 GROUP BY a ORDER BY round(sum(duration), 9) DESC, a LIMIT 1),
 c{k} AS MATERIALIZED (SELECT {k + 1} AS cluster, a AS medoid, b AS id, duration FROM near JOIN m{k} USING (a) JOIN left{k} ON vec_id = b), left{k + 1} AS MATERIALIZED (SELECT * FROM left{k} WHERE vec_id NOT IN (SELECT id FROM c{k}))"""
    return out + ", clusters AS (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(4)) + ")"


@query(f"WITH {_clusters()} SELECT cluster, medoid, id, duration FROM clusters")
def density_clusters(spark, sf):
    return clustered(spark, sf)[0].select("cluster", "medoid", "id", "duration")


@query(f"""WITH {_clusters()}, s AS (SELECT coalesce(sum(duration) FILTER (cluster = 1), 0) / (SELECT sum(duration) FROM clips) AS s1, coalesce(sum(duration) FILTER (cluster = 2), 0) / (SELECT sum(duration) FROM clips) AS s2 FROM clusters)
 SELECT round(s1, 6) AS share, round(s2, 6) AS second_share, NOT (s1 < 0.6 OR (s2 > 0.2 AND s1 < 2 * s2)) AS dominant FROM s""")
def dominant_target(spark, sf):
    c, rows = clustered(spark, sf)
    return ranking.dominant(c, rows).select(F.round("share", 6).alias("share"), F.round("second_share", 6).alias("second_share"), "dominant")


@query(f"""WITH {CENTRED}, best AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY source ORDER BY round(sim, 6) DESC, vec_id) AS n FROM sims) WHERE n <= 3)
 SELECT source, count(*) AS n, sum(duration) AS seconds FROM sims WHERE vec_id NOT IN (SELECT vec_id FROM best) GROUP BY source""")
def holdout_anti(spark, sf):
    x = with_sim(spark, sf)
    chosen = ranking.top(x, ["source"], [F.desc(F.round("sim", 6)), F.col("vec_id")], 3)
    return x.join(chosen.select("vec_id"), "vec_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("seconds"))


@query(f"""WITH {CLIPS}, a AS (SELECT source, arg_min(emb, vec_id)::DOUBLE[] AS anchor FROM clips GROUP BY source), s AS (SELECT vec_id, source, list_inner_product(emb::DOUBLE[], anchor) AS sim FROM clips JOIN a USING (source)),
 t AS (SELECT source, count(*) FILTER (sim >= 0.45) AS n, quantile_cont(sim, 0.8) AS q FROM s GROUP BY source)
 SELECT vec_id, source, round(sim, 6) AS sim FROM s JOIN t USING (source) WHERE CASE WHEN n >= 3 THEN sim >= 0.45 ELSE round(sim, 9) >= round(q, 9) END""")
def target_seeds(spark, sf):
    x = clip_rows(spark, sf)
    anchors = x.groupBy("source").agg(F.min_by("emb", "vec_id").alias("anchor"))  # the first clip of a source stands for its consent recording
    near = x.join(anchors, "source").withColumn("sim", vectors.dot(F.col("emb"), F.col("anchor")))
    return ranking.target_seeds(near, ["source"], "sim").select("vec_id", "source", F.round("sim", 6).alias("sim"))


@query(f"""WITH {_clusters()}, e AS (SELECT p, avg(x) AS m FROM (SELECT unnest(emb)::DOUBLE AS x, generate_subscripts(emb, 1) AS p FROM clips WHERE vec_id IN (SELECT id FROM clusters WHERE cluster = 2)) GROUP BY p), v AS (SELECT list(m ORDER BY p) AS m FROM e)
 SELECT (SELECT count(*) FROM clusters WHERE cluster = 2) AS n, list_transform(m, lambda x: round(x / (sqrt(list_inner_product(m, m)) + 1e-9), 6)) AS centroid FROM v""")
def picked_target(spark, sf):
    x = clip_rows(spark, sf).withColumnRenamed("vec_id", "id")
    return ranking.find_target(x, pick=2, alike=0.25).select("n", vectors.rounded(F.col("centroid"), 6).alias("centroid"))


@query(f"""WITH {CENTRED}, usable AS (SELECT * FROM sims WHERE clipping <= 0.001 AND bandwidth >= 6000 AND snr_db >= 18), med AS (SELECT source, median(sim) AS med_sim, median(snr_db) AS med_snr_db FROM usable GROUP BY source),
 mad AS (SELECT source, median(abs(sim - med_sim)) AS mad_sim, median(abs(snr_db - med_snr_db)) AS mad_snr_db FROM usable JOIN med USING (source) GROUP BY source),
 r AS (SELECT vec_id, source, round(0.6 * ({_z('sim')}) + 0.4 * ({_z('snr_db')}), 6) AS rank_score FROM usable JOIN med USING (source) JOIN mad USING (source))
 SELECT vec_id, source, rank_score, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, vec_id) AS place FROM r""")
def region_rank(spark, sf):
    x = with_sim(spark, sf)
    usable = x.where(gates.first_failing(*gates.signal_rules(F.col("clipping"), F.col("bandwidth"), F.col("snr_db"))) == "")
    return ranking.region_rank(usable, ["source"], "sim", "snr_db", "vec_id").select("vec_id", "source", "rank_score", "place")


@query(f"WITH {CLIPS} SELECT vec_id, floor(start / 60)::BIGINT || ':' || lpad((start::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM clips")
def clocks(spark, sf):
    return clip_rows(spark, sf).select("vec_id", ranking.clock(F.col("start")).alias("clock"))


# --- words and pauses ------------------------------------------------------------------------------------------


def regions(spark, sf):
    """Documents as regions of timed words: a word lasts by its length, a sentence end is followed by a longer gap; times are summed up inside the row."""
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), ws.alias("texts"))
    ws = F.col("texts")
    long = F.transform(ws, lambda w: (0.15 + 0.02 * F.char_length(w)))
    gap = F.transform(ws, lambda w, i: F.when(w.rlike(r"[.?!]$"), 0.4).otherwise((i % 7) * 0.03))
    return segment.timed(x.select("key", "texts", long.alias("long"), gap.alias("gap"), F.transform(ws, lambda w, i: -0.01 * (i % 9)).alias("logprob")))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id AS key, unnest({_WORDS}) AS text, generate_subscripts({_WORDS}, 1) - 1 AS i FROM documents),
 l AS (SELECT *, 0.15::DOUBLE + 0.02::DOUBLE * length(text) AS long, CASE WHEN regexp_matches(text, '[.?!]$') THEN 0.4::DOUBLE ELSE (i % 7) * 0.03::DOUBLE END AS gap FROM w),
 s AS (SELECT *, round(coalesce(sum(long + gap) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM l),
 t AS MATERIALIZED (SELECT key, i, text, start, round(start + long, 6) AS stop, -0.01::DOUBLE * (i % 9) AS logprob, right(text, 1) IN ('.', '?', '!') AS closes FROM s),
 g AS MATERIALIZED (SELECT *, start - lag(stop) OVER k AS before, coalesce(lead(start) OVER k - stop, 1.0) AS after FROM t WINDOW k AS (PARTITION BY key ORDER BY i)),
 c AS (SELECT a.key, a.i, b.i AS j, b.stop - a.start AS d, b.closes, b.after FROM g a JOIN g b ON a.key = b.key AND b.i BETWEEN a.i AND a.i + 80 WHERE (a.before IS NULL OR a.before >= 0.12) AND b.stop - a.start BETWEEN 4 AND 14 AND b.after >= 0.12),
 best AS MATERIALIZED (SELECT key, i, coalesce(min(j) FILTER (closes AND d >= 10), max(j) FILTER (closes AND d >= 7), min(j) FILTER (after >= 0.25)) AS j FROM c GROUP BY key, i),
 nxt AS MATERIALIZED (SELECT g.key, g.i, min(b.i) OVER (PARTITION BY g.key ORDER BY g.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at FROM g LEFT JOIN (SELECT * FROM best WHERE j IS NOT NULL) b USING (key, i)),
 r AS (SELECT n.key, 0 AS clip, b.i, b.j FROM nxt n JOIN best b ON b.key = n.key AND b.i = n.at WHERE n.i = 0
  UNION ALL SELECT r.key, r.clip + 1, b.i, b.j FROM r JOIN nxt n ON n.key = r.key AND n.i = r.j + 1 JOIN best b ON b.key = n.key AND b.i = n.at)
 SELECT r.key, clip::INT AS clip, round(min(t.start), 4) AS start, round(max(t.stop), 4) AS "end", count(*)::INT AS n_words, round(exp(avg(t.logprob)), 6) AS confidence FROM r JOIN t ON t.key = r.key AND t.i BETWEEN r.i AND r.j GROUP BY r.key, clip""")
def clip_cutter(spark, sf):
    return segment.clips(regions(spark, sf)).select("key", "clip", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "n_words", F.round("confidence", 6).alias("confidence"))


@query("""WITH w AS (SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + value / 10 AS e FROM events), g AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) - e AS gap FROM w)
 SELECT user_id, count(*) AS n, round(coalesce(max(gap), 0), 3) AS longest_pause, round(sum(e - s + coalesce(least(0.25, greatest(0, gap)), 0)), 3) AS speech_seconds FROM g GROUP BY user_id""")
def pause_stats(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    x = table(spark, sf, "events").select("user_id", "event_id", t.alias("start"), (t + F.col("value") / 10).alias("end"))
    out = segment.pauses(x, ["user_id"], ["start", "event_id"])
    return out.select("user_id", "n", F.round("longest_pause", 3).alias("longest_pause"), F.round("speech_seconds", 3).alias("speech_seconds"))


# --- text ------------------------------------------------------------------------------------------------------


_ONES, _TENS = (str(list(x)) for x in (text.ONES, text.TENS))


def _hundred(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN {_ONES}[{n} + 1] ELSE {_TENS}[{n} // 10 + 1] || CASE WHEN {n} % 10 = 0 THEN '' ELSE ' ' || {_ONES}[{n} % 10 + 1] END END"


def _thousand(n: str) -> str:
    return f"list_transform([{n}], lambda h: CASE WHEN h < 100 THEN {_hundred('h')} ELSE {_ONES}[h // 100 + 1] || ' hundred' || CASE WHEN h % 100 = 0 THEN '' ELSE list_transform([h % 100], lambda t: ' and ' || {_hundred('t')})[1] END END)[1]"


def _number(n: str) -> str:
    """The words of a whole number from 0 to 10^12 - 1, as SQL."""
    high = ", ".join(f"CASE WHEN n // {div} % 1000 > 0 THEN {_thousand(f'(n // {div} % 1000)')} || ' {word}' END" for div, word in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")))
    return f"list_transform([{n}], lambda n: CASE WHEN n < 1000 THEN {_thousand('n')} ELSE concat_ws(' ', {high}) || CASE WHEN n % 1000 = 0 THEN '' ELSE CASE WHEN n % 1000 < 100 THEN ' and ' ELSE ' ' END || {_thousand('(n % 1000)')} END END)[1]"


_YEAR = f"list_transform([y], lambda y: {_number('(y // 100)')} || ' ' || CASE WHEN y % 100 = 0 THEN 'hundred' WHEN y % 100 < 10 THEN 'oh ' || {_ONES}[y % 100 + 1] ELSE {_number('(y % 100)')} END)[1]".replace("[y]", "[d::BIGINT]")
#: A piece z of a text cut at its numbers, with the characters before and after it, as words.
_SPOKEN = rf"""CASE WHEN NOT regexp_matches(z.v, '^[0-9]') THEN z.v WHEN contains(z.v, ',') THEN {_number("replace(z.v, ',', '')::BIGINT")}
 ELSE list_transform([rtrim(z.v, '%')], lambda d: CASE WHEN length(d) = 4 AND (d BETWEEN '1100' AND '1999' OR d BETWEEN '2010' AND '2099') AND NOT regexp_matches(z.before, '[\pL\pN_]$') AND (z.v LIKE '%\%' ESCAPE '\' OR NOT regexp_matches(z.after, '^[\pL\pN_]')) THEN {_YEAR}
  WHEN length(d) < 10 THEN {_number('d::BIGINT')} ELSE d END || CASE WHEN z.v LIKE '%\%' ESCAPE '\' THEN ' percent' ELSE '' END)[1] END"""


def _bare(t: str) -> str:
    """Words alone, of a text without numbers, brackets and composed characters, as SQL."""
    t = rf"regexp_replace(lower(replace(replace({t}, '’', chr(39)), '&', ' and ')), '\[[^\]]*\]', ' ', 'g')"
    t = rf"' ' || regexp_replace({t}, '[^\pL\pN_'' ]+', ' ', 'g') || ' '"
    # an apostrophe stays between two letters alone
    t = rf"regexp_replace(regexp_replace({t}, '([^\pL\pN_])''+', '\1 ', 'g'), chr(39) || '+([^\pL\pN_])', ' \1', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '\b[0-9]{{1,3}}(?:,[0-9]{{3}})+\b|[0-9]+%?|[^0-9]+') AS p FROM documents),
 q AS (SELECT doc_id, list_transform(list_zip(p, list_prepend('', p[1:len(p) - 1]), list_append(p[2:], '')), lambda x: struct_pack(v := x[1], before := x[2], after := x[3])) AS p FROM p),
 t AS (SELECT doc_id, array_to_string(list_transform(p, lambda z: {_SPOKEN}), '') AS t FROM q)
 SELECT doc_id, {_bare('t')} AS normal FROM t""")
def text_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalise(F.col("text")).alias("normal"))


@query(f"SELECT o_orderkey, {_number('o_orderkey')} AS words FROM orders")
def number_words(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.number_words(F.col("o_orderkey")).alias("words"))


def turn_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", text.normalise(F.col("text")).alias("t"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u")), ["conv_id", "turn"])


#: Turns hold no digits.  Edit distances go by characters: each is one letter of the first 256 in its pair, or it isn't compared.
TURNS = f"""c AS (SELECT conv_id, turn, {_bare('text')} AS t FROM conversations), pairs AS (SELECT a.conv_id, a.turn, a.t, b.t AS u FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_PLAIN = {c: chr(k) for c, k in zip("äöüßéèêçÄÖÜÉÈÊÇáíóúñ", range(1, 21))}


def _edits(a: str, b: str) -> str:
    """Edit distance by characters, as SQL: the letters beyond ASCII that the tables hold are one byte each first."""
    one = lambda t: f"translate({t}, '{''.join(_PLAIN)}', '{''.join(_PLAIN.values())}')"
    return f"levenshtein({one(a)}, {one(b)})"


@query(f"WITH {TURNS} SELECT conv_id, turn, round({_edits("replace(t, ' ', '')", "replace(u, ' ', '')")} / greatest(1, length(replace(t, ' ', ''))), 6) AS cer FROM pairs")
def cer_pairs(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(text.cer(F.col("t"), F.col("u")), 6).alias("cer"))


def _word_edits(pairs: str) -> str:
    """CTE `edits` (conv_id, turn, n, size) of pairs (conv_id, turn, t, u), a row of the table at a time."""
    return f"""split AS (SELECT conv_id, turn, list_filter(string_split(t, ' '), lambda w: w <> '') AS a, list_filter(string_split(u, ' '), lambda w: w <> '') AS b FROM {pairs}),
 walk AS (SELECT conv_id, turn, a, b, 0::BIGINT AS i, range(0, len(b) + 1) AS r FROM split
  UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform([list_transform(range(0, len(b) + 1), lambda k: (CASE WHEN k = 0 THEN i + 1 ELSE least(r[k + 1] + 1, r[k] + (b[k] <> a[i + 1])::INT) END) - k)], lambda d: list_transform(range(0, len(b) + 1), lambda j: j + list_min(d[1 : j + 1])))[1] FROM walk WHERE i < len(a)),
 edits AS (SELECT conv_id, turn, r[len(b) + 1] AS n, greatest(1, len(a)) AS size FROM walk WHERE i = len(a))"""


@query(f"WITH RECURSIVE {TURNS}, {_word_edits('pairs')} SELECT conv_id, turn, round(n / size, 6) AS wer FROM edits")
def wer_pairs(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(text.wer(F.col("t"), F.col("u")), 6).alias("wer"))


_GRAMS = "SELECT conv_id, turn, g, count(*) AS n, min(i) AS i FROM (SELECT conv_id, turn, i, ws[i : i + 2] AS g FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT conv_id, turn, string_split({c}, ' ') AS ws FROM pairs)))  GROUP BY conv_id, turn, g"


@query(f"""WITH {TURNS}, said AS ({_GRAMS.format(c='t')}), heard AS ({_GRAMS.format(c='u')}), looped AS (SELECT h.conv_id, h.turn, arg_min(h.g, h.i) AS g FROM heard h LEFT JOIN said s USING (conv_id, turn, g) WHERE h.n > greatest(1, coalesce(s.n, 0)) GROUP BY h.conv_id, h.turn)
 SELECT conv_id, turn, array_to_string(g, ' ') AS phrase FROM pairs LEFT JOIN looped USING (conv_id, turn)""")
def repeated_ngram(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", text.repeated_trigram(F.col("t"), F.col("u")).alias("phrase"))


def _sentences(rows: str) -> str:
    """CTE `parts` (key, s: sentences) of rows (key, text): breaks are marked, those after abbreviations unmarked again."""
    short = "|".join(a.replace(".", r"\.") for a in text.ABBREVIATIONS)
    flat = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    cut = rf"""regexp_replace({flat}, '([.!?…])["'')\]]*\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
    whole = rf"regexp_replace({cut}, '(?i)(^|[^\pL\pN_])({short})\.' || chr(1), '\1\2. ', 'g')"
    return rf"parts AS (SELECT key, list_filter(list_transform(string_split({whole}, chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s FROM ({rows}))"


@query(f"WITH {_sentences('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, unnest(range(0, len(s)))::INT AS place, unnest(s) AS sentence FROM parts")
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


_CUT = """CASE WHEN contains(left(todo[1], 120), ', ') AND length(regexp_extract(left(todo[1], 120), '(?s)^(.*), ', 1)) > 40 THEN length(regexp_extract(left(todo[1], 120), '(?s)^(.*), ', 1))
 WHEN contains(left(todo[1], 120), ' ') AND length(regexp_extract(left(todo[1], 120), '(?s)^(.*) ', 1)) > 0 THEN length(regexp_extract(left(todo[1], 120), '(?s)^(.*) ', 1)) ELSE 120 END + 1"""


@query(f"""WITH RECURSIVE {_sentences('SELECT item_id AS key, text FROM benchmark')}, r AS (SELECT key, s AS todo, '' AS cur, []::VARCHAR[] AS done FROM parts UNION ALL SELECT key,
  CASE WHEN length(todo[1]) > 120 THEN list_prepend(trim(todo[1][({_CUT}) + 1 :]), todo[2:]) ELSE todo[2:] END,
  CASE WHEN length(todo[1]) > 120 THEN '' WHEN cur <> '' AND length(cur) + 1 + length(todo[1]) <= 120 THEN cur || ' ' || todo[1] ELSE todo[1] END,
  CASE WHEN length(todo[1]) > 120 THEN list_concat(done, list_filter([cur, trim(left(todo[1], {_CUT}))], lambda x: x <> '')) WHEN cur <> '' AND length(cur) + 1 + length(todo[1]) > 120 THEN list_append(done, cur) ELSE done END FROM r WHERE len(todo) > 0),
 f AS (SELECT key, list_filter(list_append(done, cur), lambda x: x <> '') AS c FROM r WHERE len(todo) = 0) SELECT key AS item_id, unnest(range(0, len(c)))::INT AS place, unnest(c) AS chunk FROM f""")
def chunk_pack(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(text.chunks(F.col("text"), 120)).alias("place", "chunk"))


@query(r"""SELECT item_id, CASE right(rtrim(regexp_replace(rtrim(text), '["'')\]]+$', '')), 1) WHEN '.' THEN 0.42 WHEN '!' THEN 0.42 WHEN '?' THEN 0.45 WHEN ';' THEN 0.32 WHEN ':' THEN 0.3 WHEN ',' THEN 0.22 ELSE 0.3 END AS pause FROM benchmark""")
def pause_after(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.pause_after(F.col("text")).alias("pause"))


@query(f"""WITH b AS (SELECT item_id, string_split({_bare('text')}, ' ') AS ws FROM benchmark), w AS (SELECT item_id, array_to_string(ws[3:6], '') AS code, len(ws[3:6]) AS n, ws, unnest(range(1, greatest(1, len(ws) - len(ws[3:6]) + 1) + 1)) AS p FROM b),
 d AS (SELECT item_id, p, {_edits('code', "array_to_string(ws[p : p + n - 1], '')")} / greatest(1, length(code)) AS cer FROM w) SELECT item_id, round(min(cer), 6) AS cer, arg_min(p, (cer, p))::INT AS "at" FROM d GROUP BY item_id""")
def code_best_window(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", text.normalise(F.col("text")).alias("t"))
    code = F.array_join(F.slice(F.split("t", " "), 3, 4), " ")
    return b.select("item_id", text.best_window(code, F.col("t")).alias("w")).select("item_id", F.round("w.cer", 6).alias("cer"), "w.at")


# --- takes -----------------------------------------------------------------------------------------------------


@query(f"""WITH {TAKES} SELECT part, take, round(n, 6) AS sim_norm, round(0.5 * least(1, n) + 0.35 * exp(-cer / 0.03) + 0.15 * exp(-abs(ln(fr)) / 0.15) * exp(-abs(ln(rr)) / 0.25), 6) AS q FROM (SELECT *,
 least(1.2, greatest(0, (similarity - 0.15) / greatest(0.1, 0.8 - 0.15))) AS n, coalesce(nullif(duration, 0) / nullif(25.0, 0), 1) AS fr, coalesce(nullif(longest_pause, 0) / 1.5, 1) AS rr FROM takes)""")
def take_score(spark, sf):
    n = takes.sim_norm(F.col("similarity"), F.lit(takes.CEILING))
    q = takes.quality(n, F.col("cer"), takes.ratio(F.col("duration"), F.lit(25.0)), takes.ratio(F.col("longest_pause"), F.lit(1.5)))
    return take_rows(spark, sf).select("part", "take", F.round(n, 6).alias("sim_norm"), F.round(q, 6).alias("q"))


def heard_takes(spark, sf):
    """Turns as scripts of takes that are said in full, cut off, with a loop, as the next turn, or with a long pause, by turns."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    x = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"]).withColumn("k", k)
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    said = F.when(F.col("k") == 1, F.array_join(F.slice(ws, 1, F.greatest(F.size(ws) - 3, F.lit(0))), " ")).when(F.col("k") == 2, F.concat_ws(" ", "text", "text", "text")).when(F.col("k") == 3, F.col("next")).otherwise(F.col("text"))
    n = (F.size(ws) * 4 + F.when(F.col("k") == 4, 400).otherwise(2)).cast("int")  # ten samples a second
    words = F.transform(ws, lambda w, i: F.struct((i * 0.4 + F.when((F.col("k") == 5) & (i > 0), 2.43).otherwise(0.0)).alias("start"), (i * 0.4 + 0.35).alias("end")))
    return x.select(
        "conv_id", "turn", F.col("text").alias("script"), said.alias("transcript"), F.array_repeat(F.lit(0.5), n).alias("samples"), F.lit(10).alias("sr"), words.alias("words"),
        (0.35 + F.col("turn") * 0.1).alias("similarity"), F.lit(150.0).alias("f0_median"), F.lit(2.5).alias("rate_wps"), F.lit(0.8).alias("self_similarity"), F.lit(140.0).alias("voice_f0"), F.lit(2.5).alias("voice_rate"),
    )


@query(rf"""WITH RECURSIVE x AS (SELECT a.conv_id, a.turn, a.text, b.text AS nxt, (a.conv_id + a.turn) % 7 AS k, list_filter(string_split_regex(a.text, '\s+'), lambda w: w <> '') AS ws FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 y AS (SELECT *, CASE k WHEN 1 THEN array_to_string(ws[1 : greatest(len(ws) - 3, 0)], ' ') WHEN 2 THEN concat_ws(' ', text, text, text) WHEN 3 THEN nxt ELSE text END AS said, len(ws) * 4 + CASE WHEN k = 4 THEN 400 ELSE 2 END AS n FROM x),
 pairs AS MATERIALIZED (SELECT conv_id, turn, {_bare('text')} AS t, {_bare('said')} AS u, n / 10.0::DOUBLE AS duration, 0.35::DOUBLE + turn * 0.1::DOUBLE AS sim,
  coalesce(list_max(list_transform(range(1, len(ws)), lambda i: i * 0.4::DOUBLE + CASE WHEN k = 5 THEN 2.43::DOUBLE ELSE 0 END - ((i - 1) * 0.4::DOUBLE + 0.35::DOUBLE))), 0) AS longest FROM y),
 {_word_edits('pairs')}, said AS ({_GRAMS.format(c='t')}), heard AS ({_GRAMS.format(c='u')}), looped AS (SELECT h.conv_id, h.turn, array_to_string(arg_min(h.g, h.i), ' ') AS phrase FROM heard h LEFT JOIN said s USING (conv_id, turn, g) WHERE h.n > greatest(1, coalesce(s.n, 0)) GROUP BY h.conv_id, h.turn),
 z AS (SELECT p.*, e.n / e.size AS wer, phrase, {_edits("replace(t, ' ', '')", "replace(u, ' ', '')")} / greatest(1, length(replace(t, ' ', ''))) AS cer, list_filter(string_split(t, ' '), lambda w: w <> '') AS s, list_filter(string_split(u, ' '), lambda w: w <> '') AS h FROM pairs p JOIN edits e USING (conv_id, turn) LEFT JOIN looped USING (conv_id, turn)),
 v AS (SELECT *, len(s) / 2.5::DOUBLE AS expected, least(1.2, greatest(0, (sim - 0.15) / greatest(0.1, 0.8 - 0.15))) AS norm FROM z),
 r AS (SELECT *, CASE WHEN duration < 0.3 THEN 'empty or broken audio' WHEN NOT (duration / greatest(0.5, expected) BETWEEN 0.5 AND 2.0 + 1.5 / greatest(0.5, expected)) THEN format('implausible length ({{:.1f}}s for ~{{:.1f}}s of text)', duration, expected) ELSE '' END AS refused FROM v),
 g AS (SELECT *, CASE WHEN refused <> '' THEN refused
   WHEN len(s) > 0 AND NOT list_contains(h[greatest(len(h) - 2, 1) :], s[len(s)]) AND {_edits('s[len(s)]', "array_to_string(h[greatest(len(h) - 1, 1) :], '')")} / greatest(1, length(s[len(s)])) > 0.5 THEN 'ending cut off or garbled'
   WHEN phrase IS NOT NULL THEN 'repeated phrase: ' || chr(39) || phrase || chr(39) WHEN cer > 0.08 THEN 'wording off (character error ' || round(cer * 100)::INT || '%)' WHEN longest > 1.6 THEN format('dead air ({{:.1f}}s pause)', longest)
   WHEN sim < 0.40 THEN format('does not sound like the speaker (similarity {{:.2f}})', sim) ELSE '' END AS reason FROM r)
 SELECT conv_id, turn, reason = '' AS ok, reason, round(CASE WHEN refused <> '' THEN 0 ELSE 0.5 * least(1, norm) + 0.35 * exp(-cer / 0.03) + 0.15 * exp(-abs(ln(150.0 / 140.0)) / 0.15) END, 6) AS q, round(CASE WHEN refused <> '' THEN 1 ELSE cer END, 6) AS cer, round(CASE WHEN refused <> '' THEN 1 ELSE wer END, 6) AS wer,
  round(CASE WHEN refused <> '' THEN 0 ELSE sim END, 6) AS similarity, round(CASE WHEN refused <> '' THEN 0 ELSE norm END, 6) AS sim_norm, round(duration, 6) AS duration, round(expected, 6) AS expected, round(CASE WHEN refused <> '' THEN 0 ELSE longest END, 6) AS longest_pause,
  round(CASE WHEN refused <> '' THEN 1 ELSE 150.0 / 140.0 END, 6) AS f0_ratio, 1.0::DOUBLE AS rate_ratio FROM g""")
def take_evaluation(spark, sf):
    scores = [F.round(c, 6).alias(c) for c in ("q", "cer", "wer", "similarity", "sim_norm", "duration", "expected", "longest_pause", "f0_ratio", "rate_ratio")]
    return takes.evaluate(heard_takes(spark, sf)).select("conv_id", "turn", "ok", "reason", *scores)


@query(f"""WITH {TAKES}, x AS (SELECT *, coalesce(max(q) FILTER (ok) OVER w >= 0.80, false) OR count(*) FILTER (ok) OVER w >= 4 AS stop FROM takes WHERE take <= 6 WINDOW w AS (PARTITION BY part ORDER BY take)),
 y AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY part ORDER BY take ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM x)
 SELECT part, take, ok, q, consumed FROM (SELECT part, take, ok, round(q, 6) AS q, count(*) OVER (PARTITION BY part) AS consumed, row_number() OVER (PARTITION BY part ORDER BY ok DESC, q DESC, take) AS n FROM y WHERE ended = 0) WHERE n = 1""")
def best_of_n(spark, sf):
    return takes.best_of(take_rows(spark, sf), takes.PRESETS[1]).select("part", "take", "ok", F.round("q", 6).alias("q"), "consumed")


def twin_rows(spark, sf):
    """Takes and, for every other one, a polished twin that is a little better or worse, or fails."""
    raw = take_rows(spark, sf).select("part", "take", "ok", "q", F.lit(False).alias("polished"), "reason")
    n = F.col("part") + F.col("take")
    twins = raw.where("ok").where(n % 2 == 0).select("part", "take", (n % 6 > 0).alias("ok"), (F.col("q") + (n % 5 - 2) * 0.03).alias("q"), F.lit(True).alias("polished"), F.lit("").alias("reason"))
    return raw.unionByName(twins)


TWINS = f"""{TAKES}, twins AS (SELECT part, take, (part + take) % 6 > 0 AS ok, q + ((part + take) % 5 - 2) * 0.03::DOUBLE AS q FROM takes WHERE ok AND (part + take) % 2 = 0),
 pairs AS (SELECT r.part, r.take, r.ok, r.reason, CASE WHEN r.ok AND t.ok AND t.q > r.q THEN t.q ELSE r.q END AS q, r.ok::INT + coalesce(t.ok, false)::INT AS passes FROM takes r LEFT JOIN twins t USING (part, take)),
 x AS (SELECT *, coalesce(max(q) FILTER (ok) OVER w >= 0.80, false) OR (sum(passes) OVER w >= 4 AND bool_or(ok) OVER w) AS stop FROM pairs WHERE take <= 6 WINDOW w AS (PARTITION BY part ORDER BY take)),
 y AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY part ORDER BY take ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM x),
 chosen AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY part) AS consumed, row_number() OVER (PARTITION BY part ORDER BY ok DESC, q DESC, take) AS n FROM y WHERE ended = 0) WHERE n = 1)"""


def chosen_rows(spark, sf):
    return takes.best_of(takes.with_twins(twin_rows(spark, sf)), takes.PRESETS[1])


@query(f"WITH {TWINS} SELECT part, take, ok, round(q, 6) AS q, consumed, reason FROM chosen")
def polished_best(spark, sf):
    return chosen_rows(spark, sf).select("part", "take", "ok", F.round("q", 6).alias("q"), "consumed", "reason")


@query(f"""WITH {TWINS}, f AS (SELECT part % 500 AS render, count(*) AS n_parts, arg_min(part, part) FILTER (NOT ok) AS bad, arg_min(reason, part) FILTER (NOT ok) AS why FROM chosen GROUP BY ALL)
 SELECT render, n_parts, bad IS NULL AS ok, CASE WHEN bad IS NULL THEN '' ELSE 'part ' || bad || ' never passed the checks (last problem: ' || why || ')' END AS problem FROM f""")
def render_gate(spark, sf):
    return takes.fail_closed(chosen_rows(spark, sf).withColumn("render", F.col("part") % 500), ["render"]).select("render", "n_parts", "ok", "problem")


_MEANS = ("q", "cer", "wer", "similarity", "sim_norm", "f0_ratio", "rate_ratio")
_MORE = {"wer": "cer * 1.5", "sim_norm": "similarity - 0.1D", "f0_ratio": "0.9D + q / 10", "rate_ratio": "1.1D - q / 10", "expected": "duration * 0.9D", "transcript": "concat('t', take)"}


@query(f"""WITH {TAKES}, more AS (SELECT *, {', '.join(f"{v.replace('0.1D', '0.1::DOUBLE').replace('0.9D', '0.9::DOUBLE').replace('1.1D', '1.1::DOUBLE')} AS {k}" for k, v in _MORE.items())} FROM takes)
 SELECT part, {', '.join(f'round(sum({c} * duration) / sum(duration) + 1e-9, 6) AS {c}' for c in _MEANS)}, sum(duration) AS duration, round(sum(expected), 6) AS expected, max(longest_pause) AS longest_pause, bool_and(ok) AS ok,
 coalesce(string_agg(reason, '; ' ORDER BY take) FILTER (NOT ok), '') AS reason, string_agg(transcript, ' ' ORDER BY take) AS transcript FROM more GROUP BY part""")
def part_combine(spark, sf):
    x = take_rows(spark, sf).withColumns({k: F.expr(v) for k, v in _MORE.items()})
    x = takes.combine(x, ["part"], "take", "duration").withColumn("expected", F.round("expected", 6))
    return x.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in _MEANS})


TRIED = f"""{TAKES}, tried AS (SELECT voice, engine, reference, avg(ok::INT::DOUBLE) AS pass_rate, avg(similarity) AS similarity, avg(least(1, least(1.2, greatest(0, (similarity - 0.15) / 0.65)))) AS sim_norm, avg(cer) AS cer, avg(q) AS q, avg(rtf) AS rtf FROM takes GROUP BY ALL)"""


def tried(spark, sf):
    return takes.tournament(take_rows(spark, sf).withColumn("sim_norm", takes.sim_norm(F.col("similarity"), F.lit(0.8))))


@query(f"""WITH {TRIED} SELECT voice, engine, reference, round(pass_rate, 6) AS pass_rate, round(similarity, 6) AS similarity, round(sim_norm, 6) AS sim_norm, round(cer, 6) AS cer, round(q, 6) AS q, round(rtf, 6) AS rtf,
 row_number() OVER (PARTITION BY voice ORDER BY pass_rate >= 0.5 DESC, round(q, 9) DESC, round(similarity, 9) DESC, engine, reference) = 1 AS winner FROM tried""")
def tournament(spark, sf):
    x = tried(spark, sf)
    return x.select("voice", "engine", "reference", *[F.round(c, 6).alias(c) for c in ("pass_rate", "similarity", "sim_norm", "cer", "q", "rtf")], "winner")


@query(f"""WITH {TRIED}, ok AS (SELECT *, max(similarity) OVER (PARTITION BY voice) AS best FROM tried WHERE pass_rate >= 0.5), close AS (SELECT * FROM ok WHERE round(similarity, 9) >= round(best - 0.04, 9))
 SELECT voice, engine, reference, round(rtf, 6) AS rtf FROM (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY round(rtf, 9), engine, reference) AS n FROM close) WHERE n = 1""")
def fast_pick(spark, sf):
    return takes.fast_pick(tried(spark, sf)).select("voice", "engine", "reference", F.round("rtf", 6).alias("rtf"))


_ENGINE_ROWS = ", ".join(f"('{e[0]}', '{e[1]}', {e[2]}, {e[3]}, {e[4]}, {list(e[6])})" for e in takes.ENGINES)
_ENGINE_CTE = f"engines(engine, family, languages, lo, hi, tags) AS (VALUES {_ENGINE_ROWS})"


@query(f"""WITH {_ENGINE_CTE}, refs AS (SELECT p_partkey AS reference, p_size % 5 AS voice, 3.0 + p_size / 3.0 AS duration, p_retailprice AS score FROM part)
 SELECT voice, engine, reference, fits, place FROM (SELECT *, duration BETWEEN lo - 1.5 AND hi + 3.0 AS fits, row_number() OVER (PARTITION BY voice, engine ORDER BY duration BETWEEN lo - 1.5 AND hi + 3.0 DESC, score DESC, reference) AS place FROM refs, engines) WHERE place <= 3""")
def engine_window_join(spark, sf):
    refs = table(spark, sf, "part").selectExpr("p_partkey AS reference", "p_size % 5 AS voice", "3.0D + p_size / 3.0D AS duration", "p_retailprice AS score")
    return takes.references_for(refs, takes.engines(spark), 3).select("voice", "engine", "reference", "fits", "place")


@query(f"WITH {_ENGINE_CTE} SELECT engine FROM engines WHERE list_contains(languages, 'de') AND NOT list_contains(tags, 'gpu-preferred') AND family IN ('qwen3', 'sopro')")
def engine_candidates(spark, sf):
    installed = spark.createDataFrame([("qwen3",), ("sopro",)], "family string")
    return takes.candidates(takes.engines(spark), installed, "de", "cpu").select("engine")


def engine_requests(spark, sf):
    """Customers as requests: some name an engine, some have been tuned, some want speed."""
    k = F.col("c_custkey")
    of = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    x = table(spark, sf, "customer").select(k.alias("voice"), "c_custkey", of("en", "de", "zh", "ar", "xx").alias("language"), F.when(k % 7 == 0, of("sopro", "chatterbox-turbo", "qwen3-tts-0.6b")).alias("requested"))
    return x.withColumns({"quality": of("fast", "balanced"), "fast_pick": F.when(k % 3 == 0, F.lit("sopro")), "tuned": F.when(k % 4 == 0, of("qwen3-tts-1.7b", "chatterbox-nano", "sopro"))})


REQUESTS = """requests AS (SELECT c_custkey AS voice, ['en', 'de', 'zh', 'ar', 'xx'][c_custkey % 5 + 1] AS language, CASE WHEN c_custkey % 7 = 0 THEN ['sopro', 'chatterbox-turbo', 'qwen3-tts-0.6b'][c_custkey % 3 + 1] END AS requested, ['fast', 'balanced'][c_custkey % 2 + 1] AS quality,
 CASE WHEN c_custkey % 3 = 0 THEN 'sopro' END AS fast_pick, CASE WHEN c_custkey % 4 = 0 THEN ['qwen3-tts-1.7b', 'chatterbox-nano', 'sopro'][c_custkey % 3 + 1] END AS tuned FROM customer)"""


@query(f"""WITH {_ENGINE_CTE}, {REQUESTS}, there AS (SELECT *, list_position({takes.DEVICE_ORDER['cpu']}, engine) AS rank FROM engines WHERE family IN ('qwen3', 'sopro')),
 usual AS (SELECT language, arg_min(engine, rank) AS usual FROM (SELECT unnest(languages) AS language, engine, rank FROM there WHERE rank > 0) GROUP BY language),
 x AS (SELECT r.*, u.usual, coalesce(CASE WHEN quality = 'fast' THEN f.engine END, t.engine, u.usual) AS picked, q.engine AS asked FROM requests r LEFT JOIN usual u USING (language) LEFT JOIN there f ON f.engine = fast_pick LEFT JOIN there t ON t.engine = tuned LEFT JOIN there q ON q.engine = requested)
 SELECT voice, CASE WHEN requested IS NOT NULL THEN asked ELSE picked END AS engine, CASE WHEN requested IS NOT NULL AND asked IS NULL THEN 'not installed: ' || requested WHEN requested IS NULL AND picked IS NULL THEN 'no installed engine speaks the language' ELSE '' END AS problem FROM x""")
def engine_choice(spark, sf):
    installed = spark.createDataFrame([("qwen3",), ("sopro",)], "family string")
    return takes.choose_engine(engine_requests(spark, sf), takes.engines(spark), installed, "cpu").select("voice", "engine", "problem")


def reference_rows(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey AS reference", "p_size % 5 AS voice", "3.0D + p_size / 3.0D AS duration", "p_retailprice AS score", "p_name AS text")


def reference_requests(spark, sf):
    v = spark.range(7).withColumnRenamed("id", "voice")
    x = v.crossJoin(takes.engines(spark).select("engine", "position"))
    named = F.when((F.col("voice") + F.col("position")) % 5 == 0, F.col("voice") + 1)
    return x.select("voice", "engine", named.alias("requested"), F.when(F.col("voice") % 2 == 0, F.lit("sopro")).alias("tuned_engine"), F.when(F.col("voice") % 2 == 0, F.col("voice") + 5).alias("tuned_reference"))


@query(f"""WITH {_ENGINE_CTE}, refs AS (SELECT p_partkey AS reference, p_size % 5 AS voice, 3.0 + p_size / 3.0 AS duration, p_retailprice AS score FROM part),
 req AS (SELECT voice, engine, CASE WHEN (voice + position) % 5 = 0 THEN voice + 1 END AS requested, CASE WHEN voice % 2 = 0 THEN 'sopro' END AS tuned_engine, CASE WHEN voice % 2 = 0 THEN voice + 5 END AS tuned_reference FROM (SELECT unnest(range(7)) AS voice) , (SELECT engine, row_number() OVER () - 1 AS position FROM engines)),
 tried AS (SELECT voice, engine, arg_min(reference, (-round(score / 3000, 9), reference)) AS best FROM refs JOIN (SELECT engine FROM engines WHERE family = 'qwen3') ON reference % 2 = 0 GROUP BY ALL),
 fits AS (SELECT voice, engine, reference FROM (SELECT *, row_number() OVER (PARTITION BY voice, engine ORDER BY duration BETWEEN lo - 1.5 AND hi + 3.0 DESC, score DESC, reference) AS n FROM refs, engines) WHERE n = 1),
 x AS (SELECT r.voice, r.engine, coalesce(requested, CASE WHEN tuned_engine = r.engine THEN tuned_reference END, CASE WHEN tuned_engine IS NOT NULL THEN t.best END, f.reference) AS reference FROM req r LEFT JOIN tried t USING (voice, engine) LEFT JOIN fits f USING (voice, engine)),
 y AS (SELECT x.*, CASE WHEN voice NOT IN (SELECT voice FROM refs) THEN 'no references yet' WHEN NOT EXISTS (SELECT 1 FROM refs k WHERE k.voice = x.voice AND k.reference = x.reference) THEN 'no such reference: ' || reference ELSE '' END AS problem FROM x)
 SELECT voice, engine, CASE WHEN problem = '' THEN reference END AS reference, problem FROM y""")
def reference_choice(spark, sf):
    refs, dimension = reference_rows(spark, sf), takes.engines(spark)
    tried = refs.where("reference % 2 = 0").crossJoin(dimension.where("family = 'qwen3'").select("engine")).select("voice", "engine", "reference", (F.col("score") / 3000).alias("similarity"))
    return takes.choose_reference(reference_requests(spark, sf), refs, tried, dimension).select("voice", "engine", "reference", "problem")


_PROBES = (("en", 1, "It works far better than I thought."), ("en", 2, "Send me the figures by Friday, please."), ("en", 3, "Rain fell over the harbour all night."))


@query(f"""WITH {_ENGINE_CTE}, refs AS (SELECT p_partkey AS reference, p_size % 5 AS voice, 3.0 + p_size / 3.0 AS duration, p_retailprice AS score, p_name AS text FROM part), probes(language, place, text) AS (VALUES {', '.join(map(str, _PROBES))}),
 voices AS (SELECT voice, CASE WHEN voice < 2 THEN 'en' ELSE 'de' END AS language FROM (SELECT unnest(range(5)) AS voice)),
 own AS (SELECT voice, place, text FROM (SELECT voice, text, row_number() OVER (PARTITION BY voice ORDER BY score, reference) AS place FROM refs) WHERE place <= 2 AND voice IN (SELECT voice FROM voices WHERE language <> 'en')),
 said AS (SELECT voice, place AS probe, text FROM own UNION ALL SELECT voice, place, text FROM voices JOIN probes USING (language) WHERE place <= 2),
 best AS (SELECT voice, engine, reference, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY voice, engine ORDER BY duration BETWEEN lo - 1.5 AND hi + 3.0 DESC, score DESC, reference) AS n FROM refs, engines) WHERE n <= 3)
 SELECT voice, engine, reference, rank, probe, text, (1233 + probe)::INT AS seed FROM best JOIN said USING (voice)""")
def trials(spark, sf):
    refs = reference_rows(spark, sf)
    voices = spark.range(5).select(F.col("id").alias("voice"), F.when(F.col("id") < 2, "en").otherwise("de").alias("language"))
    said = takes.probes(voices, refs, spark.createDataFrame(list(_PROBES), "language string, place int, text string"), 2)
    return takes.trials(refs, takes.engines(spark), said, 3).select("voice", "engine", "reference", "rank", "probe", "text", F.col("seed").cast("int").alias("seed"))


@query(f"""WITH {LEDGER}, {TRIED}, r AS (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY pass_rate >= 0.5 DESC, round(q, 9) DESC, round(similarity, 9) DESC, engine, reference) AS n FROM tried WHERE voice IN (SELECT voice FROM now WHERE refusal = ''))
 SELECT voice, engine, reference, round(q, 4) AS score, round(similarity, 4) AS similarity, round(cer, 4) AS cer, round(rtf, 2) AS rtf FROM r WHERE n = 1""")
def tuned_voices(spark, sf):
    x = take_rows(spark, sf).withColumn("sim_norm", takes.sim_norm(F.col("similarity"), F.lit(0.8)))
    return flows.tune(x, ledger_rows(spark, sf))[0]


@query(f"WITH {TRIED}, ok AS (SELECT *, max(similarity) OVER (PARTITION BY voice) AS best FROM tried WHERE pass_rate >= 0.5 AND engine IN ('e1', 'e4')) SELECT voice, engine, reference FROM (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY round(rtf, 9), engine, reference) AS n FROM ok WHERE round(similarity, 9) >= round(best - 0.04, 9)) WHERE n = 1")
def fast_pick_installed(spark, sf):
    there = spark.createDataFrame([("e1",), ("e4",)], "engine string")
    return takes.fast_pick(tried(spark, sf), there=there).select("voice", "engine", "reference")


@query(f"WITH {TAKES}, x AS (SELECT voice, part, take, duration, coalesce(sum(duration) OVER (PARTITION BY voice ORDER BY part, take ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM takes) SELECT voice, part, take FROM x WHERE spent <= 300")
def tune_budget(spark, sf):
    runs = take_rows(spark, sf).select("voice", "part", "take", "duration")  # all that is sorted, written and read again
    return takes.within_budget(runs, ["voice"], ["part", "take"], "duration", 300.0).select("voice", "part", "take")


CASES = r"""u AS (SELECT source AS speaker, doc_id AS id, text, 5.0::DOUBLE + doc_id % 13 AS duration FROM documents), ref AS (SELECT speaker, arg_min(id, (abs(duration - 10.5), id)) AS ref FROM u WHERE duration BETWEEN 8 AND 14 GROUP BY speaker),
 f AS (SELECT u.*, id = ref AS is_ref, id <> ref AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) BETWEEN 12 AND 30 AS fit FROM u JOIN ref USING (speaker)), n AS (SELECT *, fit AND row_number() OVER (PARTITION BY speaker, fit ORDER BY id) <= 2 AS is_target FROM f),
 cases AS (SELECT speaker, id, CASE WHEN is_ref THEN 'reference' WHEN is_target THEN 'target' WHEN sum((NOT is_ref AND NOT is_target)::INT) OVER (PARTITION BY speaker ORDER BY id) <= 20 THEN 'holdout' ELSE 'none' END AS role FROM n)"""


def utterances(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("speaker"), F.col("doc_id").alias("id"), "text", (5.0 + F.col("doc_id") % 13).alias("duration"))


@query(f"WITH {CASES} SELECT speaker, id, role FROM cases")
def bench_cases(spark, sf):
    return reports.cases(utterances(spark, sf))


@query(f"""WITH {CASES}, e AS (SELECT speaker, p, avg(x) AS m FROM (SELECT speaker, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM cases JOIN embeddings ON vec_id = id WHERE role = 'holdout') GROUP BY speaker, p), c AS (SELECT speaker, list(m ORDER BY p) AS m FROM e GROUP BY speaker),
 k AS (SELECT speaker, count(*) AS n FROM cases JOIN embeddings ON vec_id = id WHERE role = 'holdout' GROUP BY speaker) SELECT speaker, n, list_transform(m, lambda x: round(x / (sqrt(list_inner_product(m, m)) + 1e-9), 6)) AS centroid FROM c JOIN k USING (speaker)""")
def bench_centroids(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    return reports.held_out_centroids(utterances(spark, sf), e).select("speaker", "n", vectors.rounded(F.col("centroid"), 6).alias("centroid"))


@query(f"WITH {TAKES} SELECT engine, count(*) AS n, round(avg(cer * 1.5), 6) AS wer, round(avg(cer), 6) AS cer, round(avg(similarity), 6) AS sim, round(min(similarity), 6) AS min_sim, round(median(rtf), 6) AS rtf FROM takes GROUP BY engine")
def bench_summary(spark, sf):
    x = reports.by_engine(take_rows(spark, sf).withColumns({"wer": F.col("cer") * 1.5, "sim": F.col("similarity")}))
    return x.select("engine", "n", *[F.round(c, 6).alias(c) for c in ("wer", "cer", "sim", "min_sim", "rtf")])


# --- consent ---------------------------------------------------------------------------------------------------


@query(f"WITH {LEDGER} SELECT voice, seq, ts, status, kind, match, refusal, refusal = '' AS usable FROM now")
def consent_current(spark, sf):
    return consent.current(ledger_rows(spark, sf)).select("voice", "seq", "ts", "status", "kind", "match", "refusal", "usable")


@query(f"WITH {LEDGER}, probes AS (SELECT user_id AS voice, ts AS at, event_id AS probe FROM events WHERE event_type = 'view') SELECT p.voice, p.probe, (SELECT l.status FROM ledger l WHERE l.voice = p.voice AND l.ts <= p.at ORDER BY l.seq DESC LIMIT 1) AS in_force FROM probes p")
def consent_asof(spark, sf):
    return consent.as_of(ledger_rows(spark, sf), work_begun(spark, sf)).select("voice", "probe", "in_force")


@query(f"WITH {LEDGER} SELECT event_id, user_id AS voice FROM events WHERE event_type = 'view' AND user_id IN (SELECT voice FROM now WHERE refusal = '')")
def consent_usable_semi(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'view'").selectExpr("event_id", "user_id AS voice")
    return consent.permitted(rows, ledger_rows(spark, sf)).select("event_id", "voice")


#: Every second record has the seq of the one before it, as two writers without a check would make it, and every third was stamped by a clock a week behind.
_TIED = f"SELECT voice, CASE WHEN seq % 3 = 0 THEN ts - INTERVAL 7 DAY ELSE ts END AS ts, (seq + 1) // 2 AS seq, status, kind, match FROM ({_LEDGER})"
_STRICT = f"CASE WHEN status = 'revoked' THEN 2 WHEN {_REFUSAL} <> '' THEN 1 ELSE 0 END"


@query(f"WITH tied AS ({_TIED}), r AS (SELECT *, {_STRICT} AS strict FROM tied) SELECT voice, max(seq) AS seq, arg_max(strict, (seq, strict)) = 0 AS usable, arg_max(strict, (seq, strict)) = 2 AS revoked FROM r GROUP BY voice")
def consent_tied(spark, sf):
    """Two writers' records with one seq and clocks set back: the strictest record of the last seq is in force."""
    x = ledger_rows(spark, sf).withColumns({"ts": F.expr("CASE WHEN seq % 3 = 0 THEN ts - INTERVAL 7 DAYS ELSE ts END"), "seq": F.expr("(seq + 1) DIV 2")})
    return consent.current(x).select("voice", "seq", "usable", (F.col("status") == "revoked").alias("revoked"))


def work_begun(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").selectExpr("user_id AS voice", "ts AS at", "event_id AS probe")


@query(f"""WITH {LEDGER}, begun AS (SELECT user_id AS voice, ts AS at, event_id AS probe FROM events WHERE event_type = 'view'),
 held AS (SELECT voice, probe, kind, created FROM (SELECT b.voice, b.probe, l.kind, l.created, row_number() OVER (PARTITION BY b.probe ORDER BY l.seq DESC NULLS LAST) AS n FROM begun b LEFT JOIN ledger l ON l.voice = b.voice AND l.ts <= b.at) WHERE n = 1)
 SELECT h.voice, probe, CASE WHEN now.voice IS NULL THEN 'missing' WHEN refusal <> '' THEN refusal WHEN h.kind IS DISTINCT FROM now.kind OR h.created IS DISTINCT FROM now.created THEN 'consent changed' ELSE '' END AS problem FROM held h LEFT JOIN now USING (voice)""")
def consent_unchanged(spark, sf):
    ledger = ledger_rows(spark, sf)
    return consent.unchanged(consent.as_of(ledger, work_begun(spark, sf)), ledger).select("voice", "probe", "problem")


@query(f"WITH {LEDGER} SELECT voice, seq, previous, coalesce(previous = 'revoked', false) AS needs_override FROM (SELECT *, lag(status) OVER (PARTITION BY voice ORDER BY seq) AS previous FROM ledger) WHERE status = 'attested'")
def attest_override(spark, sf):
    return consent.revocations(ledger_rows(spark, sf)).select("voice", "seq", "previous", "needs_override")


@query(f"""WITH {LEDGER}, {ASKED} SELECT voice, coalesce(seq, 0) + 1 AS seq, 'pending' AS status, 'spoken' AS kind, 'I, ' || speaker || ', agree that a synthetic voice is made of my own. It can say what I never said, and I can take this back. My code is ' || lower(segment) || ' ' || (10 + c_custkey % 90) || '.' AS statement,
 epoch_us(a.now + INTERVAL 14 DAYS) AS expires FROM asked a LEFT JOIN now USING (voice)""")
def consent_request(spark, sf):
    asked = asked_rows(spark, sf).withColumn("code", F.concat(F.lower("segment"), F.lit(" "), (10 + F.col("c_custkey") % 90).cast("string"))).withColumn("scope", F.lit("any"))
    out = consent.appendable(consent.requested(asked, ledger_rows(spark, sf)))
    return out.select("voice", "seq", "status", "kind", "statement", F.unix_micros(F.col("expires").cast("timestamp")).alias("expires"))


@query(f"""WITH {LEDGER}, {ASKED}, m AS (SELECT voice, 2.0 + c_custkey % 9 AS seconds, c_custkey % 7 / 20.0 AS code_cer, c_custkey % 11 / 40.0 AS statement_cer, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 13 / 13.0 END AS heard FROM asked),
 x AS (SELECT m.*, seq, status, match, CASE WHEN coalesce(kind, '') <> 'spoken' OR status = 'revoked' THEN 'request first' WHEN seconds < 4 THEN 'too short' WHEN code_cer > 0.25 THEN 'code not heard' WHEN statement_cer > 0.2 THEN 'statement not heard' WHEN heard < 0.45 THEN 'another speaker' ELSE '' END AS reason FROM m LEFT JOIN now USING (voice))
 SELECT voice, coalesce(seq, 0) + 1 AS seq, CASE WHEN reason = '' THEN 'verified' ELSE status END AS status, round(coalesce(heard, match), 6) AS match, reason FROM x""")
def consent_verify(spark, sf):
    k = F.col("c_custkey")
    measured = asked_rows(spark, sf).select("voice", "now", (2.0 + k % 9).alias("seconds"), (k % 7 / 20.0).alias("code_cer"), (k % 11 / 40.0).alias("statement_cer"), F.when(k % 5 > 0, k % 13 / 13.0).alias("match"))
    return consent.verified(measured, ledger_rows(spark, sf)).select("voice", "seq", "status", F.round("match", 6).alias("match"), "reason")


@query(f"""WITH {LEDGER}, {ASKED}, x AS (SELECT a.voice, seq, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'Clerk ' || c_custkey % 6 END AS who, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'letter' END AS evidence, c_custkey % 3 = 0 AS override, status AS previous FROM asked a LEFT JOIN now USING (voice))
 SELECT voice, coalesce(seq, 0) + 1 AS seq, trim(who) AS attested_by, CASE WHEN trim(who) = '' THEN 'name missing' WHEN evidence IS NULL THEN 'evidence missing' WHEN previous = 'revoked' AND NOT override THEN 'revoked before' ELSE '' END AS reason FROM x""")
def consent_attest(spark, sf):
    k = F.col("c_custkey")
    asked = asked_rows(spark, sf).select("voice", "now", "speaker", F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("Clerk "), (k % 6).cast("string"))).alias("by"), F.when(k % 10 != 0, "letter").alias("evidence"), F.lit("").alias("scope"), (k % 3 == 0).alias("override"))
    return consent.attested(asked, ledger_rows(spark, sf)).select("voice", "seq", "attested_by", "reason")


@query(f"WITH {LEDGER}, {ASKED} SELECT voice, seq + 1 AS seq, 'revoked' AS status, kind, round(match, 6) AS match, epoch_us(a.now) AS revoked_at FROM asked a JOIN now USING (voice)")
def consent_revoke(spark, sf):
    out = consent.appendable(consent.revoked(asked_rows(spark, sf).select("voice", "now"), ledger_rows(spark, sf)))
    return out.select("voice", "seq", "status", "kind", F.round("match", 6).alias("match"), F.unix_micros(F.col("revoked_at").cast("timestamp")).alias("revoked_at"))


@query(f"""WITH {LEDGER}, {CENTRED}, {ASKED}, s AS (SELECT vec_id + 1 AS voice, round(sim, 4) AS match FROM sims)
 SELECT voice, seq + 1 AS seq, status, s.match, CASE WHEN status IN ('verified', 'attested') AND s.match < 0.45 THEN 'another speaker' WHEN status NOT IN ('verified', 'attested') THEN status ELSE '' END AS refusal FROM asked JOIN now USING (voice) JOIN s USING (voice) WHERE kind = 'spoken'""")
def consent_rematch(spark, sf):
    near = with_sim(spark, sf).select((F.col("vec_id") + 1).alias("voice"), F.col("sim").alias("match"))
    out = consent.appendable(consent.matched(asked_rows(spark, sf).select("voice", "now").join(near, "voice"), ledger_rows(spark, sf)))
    return consent.current(out).select("voice", "seq", "status", "match", "refusal")


@query(f"WITH {LEDGER}, {ASKED} SELECT voice, coalesce(status, 'none') AS consent, CASE WHEN refusal = '' THEN 0 ELSE 4 END AS n_steps FROM asked LEFT JOIN now USING (voice)")
def consent_steps(spark, sf):
    return consent.steps(asked_rows(spark, sf), ledger_rows(spark, sf)).select("voice", "consent", F.size("steps").alias("n_steps"))


@query(f"WITH {LEDGER} SELECT c_custkey AS voice, c_name AS speaker FROM customer WHERE c_custkey IN (SELECT voice FROM now WHERE refusal = '')")
def delivered(spark, sf):
    """What is read back of a batch of all permitted customers, after staging, checks, a second look at the ledger, and the rename."""
    ledger = ledger_rows(spark, sf)
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS voice", "c_name AS speaker", "0.9D AS probability", "true AS payload", "-2.0D AS true_peak")
    tags = delivery.disclosure_tags(F.col("voice").cast("string"), F.col("speaker"), F.lit("spoken"), F.lit("e"))
    path = f"{scratch(spark)}/delivered-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    try:
        delivery.deliver(consent.permitted(rows, ledger).withColumn("tags", tags), lambda: ledger, path)
        return spark.read.parquet(path).select("voice", "speaker").checkpoint()
    finally:
        fs.delete(at(path), True)


@query("SELECT c_custkey::VARCHAR AS voice, 1 + (c_custkey % 6 = 0)::INT AS seq, CASE WHEN c_custkey % 6 = 0 THEN 'revoked' ELSE 'attested' END AS status, c_custkey % 6 <> 0 AS usable FROM customer WHERE c_custkey % 3 = 0")
def ledger_commits(spark, sf):
    """A ledger on disk: attestations, revocations, and a writer who hasn't seen these and is turned away."""
    asked = asked_rows(spark, sf).where("c_custkey % 3 = 0").select(F.col("voice").cast("string").alias("voice"), "speaker", "c_custkey", F.lit("Bo").alias("by"), F.lit("letter").alias("evidence"), F.lit("").alias("scope"), F.lit(True).alias("override"), F.lit("2025-01-01").cast("timestamp").alias("now"))
    path = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    try:
        nothing = spark.createDataFrame([], "voice string, seq long, ts timestamp, status string")
        consent.append(consent.attested(asked, nothing), path)
        seen = consent.ledger(spark, path)
        late = consent.attested(asked.where("c_custkey % 12 = 0"), seen)
        consent.append(consent.revoked(asked.where("c_custkey % 6 = 0"), seen), path)
        try:
            consent.append(late, path)
        except consent.LedgerConflict:
            return consent.current(consent.ledger(spark, path)).select("voice", F.col("seq").cast("int").alias("seq"), "status", "usable").checkpoint()
        raise AssertionError("a grant was written over a revocation")
    finally:
        fs.delete(at(path), True)


# --- signals ---------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(20 * log10(greatest(1e-12, sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)))), 5) AS rms_db, round(20 * log10(greatest(1e-12, list_max(list_transform(e, lambda x: abs(x))))), 5) AS peak_db,
 round(len(list_filter(e, lambda x: abs(x) >= 0.2))::DOUBLE / len(e), 6) AS clipping FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def signal_levels(spark, sf):
    x = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(signal.rms_db(x), 5).alias("rms_db"), F.round(signal.peak_db(x), 5).alias("peak_db"), F.round(signal.clipping_ratio(x, 0.2), 6).alias("clipping"))


FRAMES = """frames AS (SELECT vec_id, k, 20 * log10(greatest(1e-12, sqrt(list_sum(list_transform(e[k * 8 + 1 : k * 8 + 8], lambda x: x * x)) / 8))) AS db FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(8)) AS k FROM embeddings))"""


@query(f"WITH {FRAMES} SELECT vec_id, round(quantile_cont(db, 0.95) - quantile_cont(db, 0.10), 5) AS snr_db FROM frames GROUP BY vec_id")
def signal_snr(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(signal.snr_db(F.col("embedding"), 8, 8), 5).alias("snr_db"))


@query(f"""WITH {FRAMES}, a AS (SELECT *, max(db) OVER (PARTITION BY vec_id) - 6 AS thr FROM frames), r AS (SELECT vec_id, k, min((db > greatest(-45, thr))::INT) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS on_, count(*) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS w FROM a)
 SELECT vec_id, coalesce(min(k * 8) FILTER (on_ = 1 AND w = 2), 0)::INT AS first_sample, coalesce(max((k + 2) * 8) FILTER (on_ = 1 AND w = 2), 64)::INT AS last_sample FROM r GROUP BY vec_id""")
def active_bounds(spark, sf):
    b = signal.active_bounds(F.col("embedding"), 8, 2, relative_db=6.0)
    return table(spark, sf, "embeddings").select("vec_id", b.alias("b")).select("vec_id", F.col("b.begin").cast("int").alias("first_sample"), F.col("b.end").cast("int").alias("last_sample"))


RECORDINGS = "recordings AS (SELECT vec_id // 256 AS recording, row_number() OVER (PARTITION BY vec_id // 256 ORDER BY vec_id) - 1 AS second, embedding FROM embeddings)"


def recordings(spark, sf):
    """Recordings of up to 256 seconds, each second the 64 samples of a vector."""
    rows = table(spark, sf, "embeddings").selectExpr("vec_id DIV 256 AS recording", "struct(vec_id, embedding) AS part")
    return rows.groupBy("recording").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["embedding"])).alias("samples"))


@query(f"""WITH {RECORDINGS} SELECT recording, second, list_sum(list_transform(embedding, lambda x: round_even(least(1, greatest(-1, x::DOUBLE)) * 32767, 0)))::BIGINT AS level, len(embedding)::BIGINT AS n
 FROM recordings WHERE second >= 10 AND second < 20 AND recording % 2 = 0""")
def wav_windows(spark, sf):
    """Written as WAV files, read back a second at a time: only every second file is opened, and only ten seconds of it are read."""
    path = f"{scratch(spark)}/wav-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    try:
        audio.write_wav(recordings(spark, sf), F.format_string("%08d.wav", "recording"), F.col("samples"), F.lit(64), path)
        even = [f.getPath().toUri().getPath() for f in fs.listStatus(at(path)) if int(f.getPath().getName().removesuffix(".wav")) % 2 == 0]
        x = audio.windows(spark, path, 1.0).where(F.col("path").isin(even) & (F.col("begin") >= 10.0) & (F.col("begin") < 20.0))
        # files are read in 32768ths, written in 32767ths
        level = F.aggregate(F.transform("samples", lambda v: F.rint(v.cast("double") * 32768)), F.lit(0.0), lambda s, v: s + v).cast("long")
        recording = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long")
        return x.select(recording.alias("recording"), F.col("window").alias("second"), level.alias("level"), F.size("samples").cast("long").alias("n")).checkpoint()
    finally:
        fs.delete(at(path), True)


@query(f"""WITH {RECORDINGS} SELECT recording, second, list_sum(list_transform(embedding[33:64], lambda x: round_even(least(1, greatest(-1, x::DOUBLE)) * 32767, 0)))::BIGINT AS level
 FROM recordings WHERE second % 7 = 3""")
def wav_stretches(spark, sf):
    """The second half of every seventh second of each recording, by byte ranges."""
    path = f"{scratch(spark)}/wav-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    try:
        x = recordings(spark, sf).withColumn("n", F.size("samples") / 64)
        audio.write_wav(x, F.format_string("%08d.wav", "recording"), F.col("samples"), F.lit(64), path)
        asked = x.select("recording", F.concat(F.lit(f"{path}/"), F.format_string("%08d.wav", "recording")).alias("path"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("second")).where("second % 7 = 3")
        got = audio.stretches(asked.select("recording", "second", "path", (F.col("second") + 0.5).cast("double").alias("begin"), F.lit(0.5).alias("seconds")))
        level = F.aggregate(F.transform("samples", lambda v: F.rint(v.cast("double") * 32768)), F.lit(0.0), lambda s, v: s + v).cast("long")
        return got.select("recording", F.col("second").cast("long").alias("second"), level.alias("level")).checkpoint()
    finally:
        fs.delete(at(path), True)


# --- streams as tables, tags, documents ------------------------------------------------------------------------


@query(r"""WITH u AS (SELECT item_id, unnest(regexp_extract_all(text, ' ?[^ ]{1,3}')) AS tok, generate_subscripts(regexp_extract_all(text, ' ?[^ ]{1,3}'), 1) - 1 AS i FROM benchmark),
 v AS (SELECT *, min(i) FILTER (NOT mark) OVER (PARTITION BY item_id) AS first FROM (SELECT *, regexp_matches(tok, '^\s*[^\p{L}\p{N}\s]+\s*$') AS mark FROM u WHERE trim(tok) <> '')),
 w AS (SELECT *, sum((NOT mark AND (starts_with(tok, ' ') OR i = first))::INT) OVER (PARTITION BY item_id ORDER BY i) AS word FROM v WHERE i >= first)
 SELECT item_id, (word - 1)::INT AS place, string_agg(trim(tok), '' ORDER BY i) AS text, round(min(i) * 0.1, 6) AS start, round(max(i) * 0.1 + 0.08, 6) AS "end", round(avg(-(i % 7) / 10.0), 6) AS logprob FROM w GROUP BY item_id, word""")
def token_words(spark, sf):
    """Texts cut into tokens of up to three letters, put together again as words."""
    pieces = F.regexp_extract_all("text", F.lit(" ?[^ ]{1,3}"), F.lit(0))
    tokens = F.transform(pieces, lambda t, i: F.struct(t.alias("token"), (i * 0.1).alias("start"), F.lit(0.08).alias("duration"), (-(i % 7) / 10).alias("logprob")))
    x = table(spark, sf, "benchmark").select("item_id", F.posexplode(segment.grouped_tokens(tokens)).alias("place", "w"))
    return x.select("item_id", "place", "w.text", F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"), F.round("w.logprob", 6).alias("logprob"))


@query("SELECT user_id AS job, list_reverse(list(event_type || ' ' || event_id ORDER BY ts DESC, event_id DESC)[1:6]) AS messages FROM events GROUP BY user_id")
def job_log_tail(spark, sf):
    return streams.log_tails(table(spark, sf, "events").selectExpr("user_id AS job", "ts AS at", "event_id AS seq", "concat(event_type, ' ', event_id) AS message"))


@query("""WITH r AS (SELECT event_id AS id, user_id, ts, event_type, CASE WHEN event_id % 50 = 0 THEN 'shutdown' WHEN event_type = 'error' THEN 'unheard of' ELSE event_type END AS method FROM events),
 k AS (SELECT *, count(*) FILTER (method = 'shutdown') OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM r)
 SELECT id, method, CASE method WHEN 'view' THEN '{"twice": ' || 2 * id || '}' WHEN 'click' THEN '"id ' || id || '"' WHEN 'shutdown' THEN '{"bye": true}' END AS result,
 CASE WHEN method NOT IN ('view', 'click', 'purchase', 'shutdown') THEN 'unknown method ' || chr(39) || method || chr(39) WHEN method = 'purchase' THEN 'ValueError: nothing to sell' END AS error FROM k WHERE ended = 0""")
def protocol_answers(spark, sf):
    """Events as lines of requests to a worker a user, answered until it is shut down."""
    method = "CASE WHEN event_id % 50 = 0 THEN 'shutdown' WHEN event_type = 'error' THEN 'unheard of' ELSE event_type END"
    lines = table(spark, sf, "events").select("user_id", "ts", F.to_json(F.struct(F.col("event_id").alias("id"), F.expr(method).alias("method"), F.to_json(F.struct(F.col("event_id").alias("n"))).alias("params"))).alias("value"))
    parsed = F.from_json("value", "id long, method string, params string")
    requests = lines.select("user_id", "ts", parsed.alias("r")).select("user_id", "ts", "r.*")

    def sell(params):
        raise ValueError("nothing to sell")

    handlers = {"view": lambda p: {"twice": 2 * p["n"]}, "click": lambda p: f"id {p['n']}", "purchase": sell}
    return streams.answers(streams.until_shutdown(requests, ["user_id"], ["ts", "id"]), handlers).select("id", "method", "result", "error")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v, i: v * CASE WHEN i <= 8 THEN pow(sin(pi() / 2 * (i - 1) / 7), 2) ELSE 1 END * CASE WHEN 64 - i < 16 THEN pow(sin(pi() / 2 * (64 - i) / 15), 2) ELSE 1 END) AS f FROM embeddings)
 SELECT vec_id, round(list_sum(f), 6) AS total, round(f[4], 6) AS fourth, round(f[60], 6) AS late FROM x""")
def signal_fade(spark, sf):
    f = signal.fade(F.col("embedding"), 8, 16)
    x = table(spark, sf, "embeddings").select("vec_id", f.alias("f"))
    return x.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.get("f", F.lit(3)), 6).alias("fourth"), F.round(F.get("f", F.lit(59)), 6).alias("late"))


@query("""WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT *, 20 * log10(greatest(1e-12, sqrt(list_sum(list_transform(e, lambda v: v * v)) / len(e)))) AS rms, 20 * log10(greatest(1e-12, list_max(list_transform(e, lambda v: abs(v))))) AS peak FROM l)
 SELECT vec_id, round(list_max(list_transform(e, lambda v: abs(v))) * pow(10, least(-23 - rms, -1 - peak) / 20), 6) AS loudest FROM x""")
def signal_to_level(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", signal.to_level(F.col("embedding")).alias("f"))
    return x.select("vec_id", F.round(F.array_max(F.transform("f", F.abs)), 6).alias("loudest"))


@query("""SELECT c_custkey, 'This audio is synthetic speech. Voice of ' || c_name || ', by ' || CASE WHEN c_custkey % 2 = 0 THEN 'spoken consent' ELSE 'consent attested by the operator' END || '.' AS comment,
 c_custkey % 3 > 0 AS ok FROM customer""")
def disclosure(spark, sf):
    """Tags of delivered files, every third of which has lost those that say so."""
    tags = delivery.disclosure_tags(F.col("c_custkey").cast("string"), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "spoken").otherwise("attested"), F.lit("e"))
    kept = F.when(F.col("c_custkey") % 3 > 0, F.col("tags")).otherwise(F.map_filter("tags", lambda k, v: ~k.isin("comment", "description")))
    return table(spark, sf, "customer").select("c_custkey", "c_name", tags.alias("tags")).select("c_custkey", F.col("tags")["comment"].alias("comment"), delivery.tags_ok(kept).alias("ok"))


#: Events as frames of a minute; an hour of silence parts regions, those under five minutes are none, and two hours are the most.
_REGIONS = """WITH s AS (SELECT user_id, epoch_us(ts) AS opened, epoch_us(ts) + 60000000 AS closed FROM events WHERE event_id % 10 >= 3 AND user_id IS NOT NULL AND ts IS NOT NULL),
 r AS (SELECT user_id, min(opened) AS opened, max(closed) AS closed FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY opened, closed ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce((opened - lag(closed) OVER (PARTITION BY user_id ORDER BY opened, closed) >= 3600000000)::INT, 1) AS new FROM s)) GROUP BY user_id, run),
 p AS (SELECT *, unnest(range(greatest(1, ceil((closed - opened) / 7200000000.0)::BIGINT))) AS part FROM r WHERE closed - opened >= 300000000)
 SELECT user_id, (opened + part * 7200000000)::BIGINT AS opened, least(closed, opened + (part + 1) * 7200000000)::BIGINT AS closed FROM p"""


@query(_REGIONS)
def speech_regions(spark, sf):
    frames = table(spark, sf, "events").withColumn("p", F.expr("CASE WHEN event_id % 10 >= 3 THEN 0.9 ELSE 0.1 END"))
    return streams.regions(frames, ["user_id"], "ts", "p", frame=60.0, silence=3600.0, least=300.0, most=7200.0, bucket=86400.0)


def played(spark, rows, key, run, slices=3, per_file=500_000):
    """What a stream gives that plays rows (key, ts, ...) in slices of time, one after the other, and then two that only bring the clock on.

    Each slice is one batch: all have the same number of files, so that many tasks write and read them.  State is dealt out over as many
    partitions as there are cores (or 8) at most: each costs every batch a store to load and to commit and a Python worker, however few rows it has,
    and buckets keep a task's memory small by themselves.
    """
    path = f"{scratch(spark)}/played-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    first, last, n = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    files = max(1, -(-n // (slices * per_file)))
    value = lambda c, ts: F.lit(-1) if c == key else F.lit(ts) if c == "ts" else F.lit(0)
    clock = lambda ts, m: spark.range(0, m, 1, m).select(*[value(c, ts).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    try:
        cuts = [first + (last - first) * k / slices for k in range(slices)] + [None]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            part = rows.where(F.col("ts") >= F.lit(lo).cast(rows.schema["ts"].dataType))
            part = part if hi is None else part.where(F.col("ts") < F.lit(hi).cast(rows.schema["ts"].dataType))
            (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{path}/in/{k}")
            short = files - sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(at(f"{path}/in/{k}")))
            if short:  # a slice of few rows leaves some tasks none, and no file
                clock(lo, short).write.mode("append").parquet(f"{path}/in/{k}")
        for k in (1, 2):
            clock(last + datetime.timedelta(days=400 * k), files).write.parquet(f"{path}/in/{slices + k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
        states = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", min(int(states), max(8, spark.sparkContext.defaultParallelism)))
        try:  # a query keeps the number that it has been started with
            q = run(stream).writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", states)
        q.awaitTermination()
        return spark.read.parquet(f"{path}/out").where(~F.col(key).eqNullSafe(-1)).checkpoint()
    finally:
        fs.delete(at(path), True)


@query(_REGIONS)
def live_regions(spark, sf):
    """The regions of `speech_regions` out of a stream, with timers."""
    frames = table(spark, sf, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("CASE WHEN event_id % 10 >= 3 THEN 0.9D ELSE 0.1D END").alias("p"))
    return played(spark, frames, "user_id", lambda s: live.speech_regions(s, "user_id", "ts", "p", "0 seconds", 60.0, 0.5, 3600.0, 300.0, 7200.0))


@query("""WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 900 SECOND THEN 0 ELSE 1 END AS new FROM events))
 SELECT user_id, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) + 900000000 AS dropped, count(*) AS n FROM g GROUP BY user_id, s""")
def live_dropped(spark, sf):
    """Workers that are dropped after 900 idle seconds, out of a stream."""
    uses = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return played(spark, uses, "user_id", lambda s: live.dropped(s, "user_id", "ts", "0 seconds"))


@query("""WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 900 SECOND THEN 0 ELSE 1 END AS new FROM events))
 SELECT user_id, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) + 900000000 AS closed, count(*) AS n FROM g GROUP BY user_id, s""")
def idle_sessions(spark, sf):
    x = streams.sessions(table(spark, sf, "events"), ["user_id"], "ts", "900 seconds")
    return x.select("user_id", F.unix_micros("opened").alias("opened"), F.unix_micros("closed").alias("closed"), "n")


@query("SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT) AS total FROM events GROUP BY event_type")
def props_parse(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query(r"SELECT page_id, regexp_extract(html, '<html lang=\"(\w+)\"', 1) AS lang, regexp_matches(url, '^https?://') AS is_url FROM pages")
def tag_parse(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"), files.is_url(F.col("url")).alias("is_url"))


@query(f"""WITH {TAKES} SELECT part, count(*)::INT AS n, to_json(struct_pack(part := part, attempts := list(struct_pack(take := take, ok := ok, q := round(q, 4), reason := reason) ORDER BY take)))::VARCHAR AS json FROM takes GROUP BY part""")
def manifest_json(spark, sf):
    return delivery.manifest(take_rows(spark, sf).withColumn("q", F.round("q", 4)), ["part"], ["ok", "q", "reason"], "take")


@query(f"""WITH {CLIPS} SELECT vec_id, CASE WHEN NOT (snr_db / 40 >= 0.5 AND vec_id % 2 = 0) THEN 'watermark not found' WHEN NOT (vec_id % 3 > 0) THEN 'disclosure tags missing' WHEN NOT (-(vec_id % 4) <= -0.5) THEN 'too loud' ELSE '' END AS reason FROM clips""")
def delivery_gate(spark, sf):
    i = F.col("vec_id")
    said = F.when(i % 3 > 0, F.lit(delivery.DISCLOSURE)).otherwise("music")
    tags = F.create_map(F.lit("comment"), said, F.lit("description"), said)
    return clip_rows(spark, sf).select("vec_id", gates.delivery_reason(F.col("snr_db") / 40, i % 2 == 0, delivery.tags_ok(tags), -(i % 4)).alias("reason"))


# --- joins of takes, listings, jobs ----------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {SCORED}, rounded AS (SELECT * REPLACE (round(score, 6) AS score) FROM scored), {_greedy('rounded', 'first', 16)}, survivors AS (SELECT sims.* FROM sims JOIN first USING (source, vec_id) WHERE vec_id % 3 <> 0),
 {_scored('survivors', 's_')}, again AS (SELECT * REPLACE (round(score, 6) AS score) FROM s_scored), {_greedy('again', 'second', 8)} SELECT vec_id, source, score, chosen FROM second JOIN again USING (source, vec_id)""")
def two_stage_shortlist(spark, sf):
    x = with_sim(spark, sf).withColumn("pos", F.col("vec_id"))
    return ranking.two_stage(x, ["source"], 8, F.col("vec_id") % 3 != 0).select("vec_id", "source", "score", "chosen")


def part_rows(spark, sf):
    i = F.col("vec_id")
    mark = F.element_at(F.array(*map(F.lit, (".", "?", ",", ";", ""))), (i % 5 + 1).cast("int"))
    return table(spark, sf, "embeddings").select(F.floor(i / 4).alias("render"), i, F.col("embedding").alias("samples"), F.concat(F.lit("so"), mark).alias("said"))


@query(f"""WITH {FRAMES}, a AS (SELECT *, max(db) OVER (PARTITION BY vec_id) - 6 AS thr FROM frames),
 r AS (SELECT vec_id, k, min((db > greatest(-45, thr))::INT) OVER w AS on_, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
 b AS (SELECT vec_id, vec_id // 4 AS render, coalesce(min(k * 8) FILTER (on_ = 1 AND n = 2), 0) AS lo, coalesce(max((k + 2) * 8) FILTER (on_ = 1 AND n = 2), 64) AS hi FROM r GROUP BY vec_id),
 p AS (SELECT *, count(*) OVER (PARTITION BY render) AS n_parts, lead(vec_id) OVER (PARTITION BY render ORDER BY vec_id) IS NULL AS last FROM b),
 q AS (SELECT render, vec_id, n_parts, (CASE WHEN n_parts = 1 THEN 0 ELSE greatest(0, lo - 10) END)::INT AS lo, (CASE WHEN n_parts = 1 THEN 64 ELSE least(64, hi + 10) END)::INT AS hi, CASE WHEN last THEN 0 ELSE [168, 180, 88, 128, 120][vec_id % 5 + 1] END AS gap FROM p)
 SELECT *, coalesce(sum(hi - lo + gap) OVER (PARTITION BY render ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM q""")
def seam_layout(spark, sf):
    return seams.seams(part_rows(spark, sf), ["render"], "vec_id", "samples", "said", 400, relative_db=6.0)


@query()
def joined_takes(spark, sf):
    x = seams.joined(part_rows(spark, sf), ["render"], "vec_id", "samples", "said", 400, relative_db=6.0)
    return x.select("render", "n_parts", F.size("samples").alias("n_samples"), F.round(signal.rms_db(F.col("samples")), 5).alias("rms_db"))


@query(f"""WITH {LEDGER}, refs AS (SELECT o_custkey AS voice, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
 SELECT c_custkey AS voice, c_name AS speaker, 'en' AS language, coalesce(status, 'none') AS consent, coalesce(refusal = '', false) AND coalesce(n, 0) > 0 AS ready, coalesce(n, 0) AS "references",
 CASE WHEN c_custkey % 3 = 0 THEN 'sopro' END AS tuned_engine FROM customer LEFT JOIN now ON c_custkey = now.voice LEFT JOIN refs ON c_custkey = refs.voice""")
def voice_listing(spark, sf):
    entities = table(spark, sf, "customer").selectExpr("c_custkey AS voice", "c_name AS speaker", "'en' AS language")
    references = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS voice")
    return listings.voices(entities, ledger_rows(spark, sf), references, entities.where("voice % 3 = 0").selectExpr("voice", "'sopro' AS engine"))


@query(f"""WITH {_ENGINE_CTE} SELECT engine, family, family IN ('qwen3', 'sopro') AS installed, array_to_string(languages[1:6], ',') || CASE WHEN len(languages) > 6 THEN '...' ELSE '' END AS languages, array_to_string(tags, ', ') AS notes FROM engines""")
def engine_listing(spark, sf):
    return listings.engines(takes.engines(spark), spark.createDataFrame([("qwen3",), ("sopro",)], "family string"))


_QUEUE = """WITH RECURSIVE j AS (SELECT user_id, event_id, epoch_us(ts) AS arrive, 60000000 * (1 + event_id % 90) AS took, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 q AS (SELECT *, arrive AS begun, arrive + took AS finished FROM j WHERE n = 1 UNION ALL SELECT j.*, greatest(j.arrive, q.finished), greatest(j.arrive, q.finished) + j.took FROM j JOIN q ON j.user_id = q.user_id AND j.n = q.n + 1)
 SELECT user_id, event_id, arrive, begun, finished FROM q"""


@query(_QUEUE)
def job_queue(spark, sf):
    x = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrive"), (60_000_000 * (1 + F.col("event_id") % 90)).alias("took"))
    return listings.queue(x, ["user_id"], "arrive", "took", ["event_id"]).select("user_id", "event_id", "arrive", "begun", "finished")


@query(_QUEUE)
def live_queue(spark, sf):
    """The queue of `job_queue` out of a stream, with one permit a machine."""
    jobs = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("job"), F.expr("60000000L * (1 + event_id % 90)").alias("took"))
    out = played(spark, jobs, "user_id", lambda s: live.queued(s.fillna(0, ["job", "took"]), "user_id", "ts", "0 seconds", "job", "took"))
    return out.select("user_id", F.col("job").alias("event_id"), F.col("arrived").alias("arrive"), "begun", "finished")



@query("""WITH r AS (SELECT user_id * 40 + event_id % 40 AS job, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'running' END AS status FROM events),
 s AS (SELECT job, count(*) AS n, coalesce(arg_min(status, seq) FILTER (status IN ('done', 'failed')), arg_max(status, seq)) AS status, arg_min(seq, seq) FILTER (status IN ('done', 'failed')) AS ended FROM r GROUP BY job)
 SELECT job, status, CASE WHEN status = 'failed' THEN 'm' || ended END AS error, n FROM s""")
def job_states(spark, sf):
    status = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'running' END AS status"
    return streams.jobs(table(spark, sf, "events").selectExpr("user_id * 40 + event_id % 40 AS job", "event_id AS seq", status, "concat('m', event_id) AS message"))


# --- entities, outputs, scalars, ingest ------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN '_x' ELSE 'voice-' || c_custkey % 40 END AS voice, c_name AS speaker FROM customer), v AS (SELECT 'voice-' || n_nationkey AS voice FROM nation),
 r AS (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY speaker) AS n FROM a) SELECT voice, speaker, CASE WHEN NOT regexp_matches(voice, '^[a-z0-9][a-z0-9_-]{0,62}$') THEN 'bad name' WHEN voice IN (SELECT voice FROM v) OR n > 1 THEN 'already exists' ELSE '' END AS problem FROM r""")
def voice_creation(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.col("c_name")).when(k % 5 == 1, "_x").otherwise(F.concat(F.lit("voice-"), (k % 40).cast("string")))
    asked = table(spark, sf, "customer").select(name.alias("voice"), F.col("c_name").alias("speaker"), F.lit(None).cast("string").alias("language"), F.lit(0).alias("now"))
    old = table(spark, sf, "nation").select(F.concat(F.lit("voice-"), F.col("n_nationkey").cast("string")).alias("voice"))
    return entities.created(asked, old).select("voice", "speaker", "problem")


@query("""SELECT page_id, '/out/' || CASE page_id % 6 WHEN 0 THEN page_id || '.wav' WHEN 1 THEN 'a/' || page_id || '.MP3' WHEN 2 THEN '' WHEN 3 THEN page_id || '.exe' WHEN 4 THEN 'b.c/' || page_id ELSE page_id || '.flac' END AS stem,
 CASE page_id % 6 WHEN 2 THEN 'outside the outputs folder' WHEN 3 THEN 'unknown ending' WHEN 4 THEN 'unknown ending' ELSE CASE WHEN page_id % 12 < 2 THEN 'already exists' ELSE '' END END AS problem FROM pages""")
def output_guard(spark, sf):
    i = F.col("page_id")
    n = i.cast("string")
    path = F.element_at(F.array(F.concat(F.lit("x/../"), n, F.lit(".wav")), F.concat(F.lit("/out/./a//"), n, F.lit(".MP3")), F.concat(F.lit("../etc/"), n, F.lit(".wav")), F.concat(n, F.lit(".exe")), F.concat(F.lit("b.c/"), n), F.concat(n, F.lit(".flac"))), (i % 6 + 1).cast("int"))
    pages = table(spark, sf, "pages").select("page_id", path.alias("path"))
    old = pages.where(i % 12 < 2).select(F.when(i % 2 == 0, F.concat(F.lit("/out/"), n, F.lit(".wav"))).otherwise(F.concat(F.lit("/out/a/"), n, F.lit(entities.MANIFEST))).alias("path"))
    out = entities.agent_outputs(pages, "/out", old)
    return out.select("page_id", F.when(i % 6 == 2, "/out/").otherwise(F.col("path")).alias("stem"), "problem")


@query(f"""WITH {CLIPS} SELECT vec_id, round(least(-16 - (-10.0 - vec_id % 20), -1.5 - (-(vec_id % 9))), 6) AS gain, (7 + 1000 * (vec_id % 4) + vec_id % 3)::BIGINT AS seed, round(duration / greatest(0.1, vec_id % 3), 6) AS rtf,
 CASE WHEN vec_id % 2 = 0 THEN 'low' ELSE 'high' END AS pitch, strftime(TIMESTAMP '2024-01-31 22:00:00' + to_seconds(vec_id * 61), '%Y%m%d-%H%M%S') AS stamp FROM clips""")
def small_rules(spark, sf):
    i = F.col("vec_id")
    chosen = scalars.options(F.lit("en"), F.create_map(F.lit("pitch"), F.lit("low")), F.lit(True), F.when(i % 2 == 1, F.create_map(F.lit("pitch"), F.lit("high"))))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-31 22:00:00")) + i * 61)
    return clip_rows(spark, sf).select(
        "vec_id", F.round(scalars.loudness_gain(-10.0 - i % 20, -(i % 9)), 6).alias("gain"), scalars.take_seed(F.lit(7), i % 4, i % 3).cast("long").alias("seed"),
        F.round(scalars.real_time_factor(F.col("duration"), i % 3), 6).alias("rtf"), chosen["pitch"].alias("pitch"), scalars.stamp(at).alias("stamp"),
    )


@query(f"""WITH {CENTRED}, t AS (SELECT source, c AS target FROM centre), near AS (SELECT * EXCLUDE (sim), list_inner_product(emb::DOUBLE[], target) AS sim FROM sims JOIN t USING (source) WHERE duration >= 1.5),
 cut AS (SELECT source, coalesce(greatest(0.5, median(sim) FILTER (sim >= 0.5) - 0.25), 0.5) AS cut FROM near GROUP BY source) SELECT source, count(*) AS n, count(*) FILTER (sim >= cut) AS kept, round(sum(duration) / 60, 2) AS minutes, round(coalesce(sum(duration) FILTER (sim >= cut), 0) / 60, 2) AS target_minutes FROM near JOIN cut USING (source) GROUP BY source""")
def target_regions(spark, sf):
    x = clip_rows(spark, sf).withColumn("voice", F.col("source"))
    long = ingest.long_enough(x)
    kept = ingest.of_target(long, vectors.centroids(x, ["voice"], "emb").select("voice", F.col("centroid").alias("target"))).select("vec_id", F.lit(True).alias("__kept"))
    y = long.join(kept, "vec_id", "left").withColumn("__kept", F.coalesce("__kept", F.lit(False)))
    n = y.groupBy("voice").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__kept"), 1)).alias("kept"))
    return ingest.minutes(y, ["voice"], minutes=F.lit(True), target_minutes=F.col("__kept")).join(n, "voice").withColumnRenamed("voice", "source")


@query(f"""WITH {CENTRED}, near AS (SELECT * EXCLUDE (sim), list_inner_product(emb::DOUBLE[], c) AS sim FROM sims JOIN centre USING (source) WHERE clipping <= 0.001 AND bandwidth >= 6000 AND snr_db >= 18), med AS (SELECT source, median(sim) AS med_sim, median(snr_db) AS med_snr_db FROM near GROUP BY source),
 mad AS (SELECT source, median(abs(sim - med_sim)) AS mad_sim, median(abs(snr_db - med_snr_db)) AS mad_snr_db FROM near JOIN med USING (source) GROUP BY source),
 r AS (SELECT vec_id, source, duration, row_number() OVER (PARTITION BY source ORDER BY round(0.6 * ({_z('sim')}) + 0.4 * ({_z('snr_db')}), 6) DESC, start) AS place FROM near JOIN med USING (source) JOIN mad USING (source))
 SELECT vec_id, source, place FROM (SELECT *, coalesce(sum(duration) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r) WHERE spent < 60""")
def transcription_shortlist(spark, sf):
    x = clip_rows(spark, sf).withColumn("voice", F.col("source"))
    return ingest.to_transcribe(x, vectors.centroids(x, ["voice"], "emb"), 60.0).select("vec_id", "source", "place")


@query(f"""WITH {CENTRED}, x AS (SELECT sims.* EXCLUDE (sim), list_inner_product(emb::DOUBLE[], c) AS sim, CASE WHEN clipping > 0.001 THEN 'clipped' WHEN bandwidth < 6000 THEN 'low bandwidth' WHEN snr_db < 18 THEN 'noisy' WHEN confidence < 0.55 THEN 'unclear speech' WHEN f0_median <= 0 THEN 'no voiced speech' ELSE '' END AS reason FROM sims JOIN centre USING (source)),
 good AS (SELECT * FROM x WHERE reason = '') SELECT source AS voice, count(*) AS clean_clips, round(sum(duration) / 60, 2) AS clean_minutes, round(median(f0_median), 1) AS f0_median, round(median(rate_wps), 3) AS rate_wps FROM good GROUP BY source""")
def ingest_statistics(spark, sf):
    x = clip_rows(spark, sf).withColumn("voice", F.col("source")).withColumn("f0_range_st", F.lit(3.0))
    good = ingest.judged(x, vectors.centroids(x, ["voice"], "emb")).where("reason = ''")
    return ingest.statistics(good).select("voice", "clean_clips", "clean_minutes", "f0_median", "rate_wps")


@query("""WITH m AS (SELECT s_suppkey AS machine, s_suppkey % 25 AS free, s_suppkey % 90 AS busy, s_suppkey % 4 AS tool, s_suppkey % 3 AS n, s_suppkey % 5 = 0 AS idle FROM supplier),
 r AS (SELECT machine, 0 AS position, 'disk' AS "check", free >= 10 AS ok, free || ' GB free' AS detail, CASE WHEN free < 10 THEN 'free some space' ELSE '' END AS fix FROM m
 UNION ALL SELECT machine, 1, 'media tool', tool < 2, CASE tool WHEN 3 THEN 'not found' WHEN 2 THEN 'missing: aac, flac' ELSE 'complete' END, CASE WHEN tool < 2 THEN '' ELSE 'install a complete build' END FROM m
 UNION ALL SELECT machine, 2, 'load', NULL, busy || '% busy, so speeds are low', '' FROM m WHERE busy > 50
 UNION ALL SELECT machine, 3, 'model asr', true, 'ready', '' FROM m UNION ALL SELECT machine, 4, 'model vad', NULL, 'comes with its first use', '' FROM m
 UNION ALL SELECT machine, 5, 'engine qwen3', NOT idle, CASE WHEN idle THEN 'installed, but can''t use the GPU' ELSE 'installed' END, CASE WHEN idle THEN 'install it again' ELSE '' END FROM m WHERE n > 0
 UNION ALL SELECT machine, 6, 'engine sopro', NOT idle, CASE WHEN idle THEN 'installed, but can''t use the GPU' ELSE 'installed' END, CASE WHEN idle THEN 'install it again' ELSE '' END FROM m WHERE n > 1
 UNION ALL SELECT machine, 7, 'engines', false, 'none installed', 'install one' FROM m WHERE n = 0)
 SELECT machine, (row_number() OVER (PARTITION BY machine ORDER BY position) - 1)::INT AS position, "check", ok, detail, fix FROM r""")
def machine_checks(spark, sf):
    k = F.col("s_suppkey")
    missing = F.when(k % 4 < 2, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("aac"), F.lit("flac")))
    x = table(spark, sf, "supplier").select(
        k.alias("machine"), (k % 25).cast("double").alias("free_gb"), (k % 90).cast("double").alias("busy"), missing.alias("missing"), F.array(F.lit("asr"), F.lit("vad")).alias("models"), F.array(F.lit("asr")).alias("ready"),
        F.slice(F.array(F.lit("qwen3"), F.lit("sopro")), F.lit(1), (k % 3).cast("int")).alias("families"), (k % 5 == 0).alias("gpu"), F.lit(False).alias("gpu_usable"),
    )
    return listings.machine_checks(x)


@query("""SELECT vec_id, (vec_id % 8 * 4)::INT AS first, list_transform(embedding[vec_id % 8 * 4 + 1 : vec_id % 8 * 4 + 8], lambda x: round(x::DOUBLE, 6)) AS samples FROM embeddings""")
def source_segments(spark, sf):
    sources = table(spark, sf, "embeddings").select(F.col("vec_id").alias("source"), F.col("embedding").alias("samples"), F.lit(8).alias("sr"))
    asked = table(spark, sf, "embeddings").select(F.col("vec_id").alias("source"), (F.col("vec_id") % 8 / 2.0).alias("begin"), (F.col("vec_id") % 8 / 2.0 + 1.0).alias("end"))
    out = files.segments(asked, sources)
    return out.select(F.col("source").alias("vec_id"), (F.col("begin") * 8).cast("int").alias("first"), vectors.rounded(F.col("samples"), 6).alias("samples"))


@query("""WITH f AS (SELECT vec_id, k, list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 16]::DOUBLE[], lambda x: x * x)) / 16 AS e FROM (SELECT *, unnest(range(7)) AS k FROM embeddings)) SELECT vec_id, k::INT AS k, round(20 * log10(greatest(1e-12, sqrt(e))), 5) AS db FROM f""")
def sliding_levels(spark, sf):
    frames = signal.sliding_frames(F.col("embedding").cast("array<double>"), 16, 8)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(frames).alias("k", "x")).select("vec_id", "k", F.round(signal.rms_db(F.col("x")), 5).alias("db"))


@query("SELECT 'url' AS kind, origin, count(*) AS taken, min(path) AS first FROM (SELECT s_nationkey AS origin, s_suppkey || '.ogg' AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE n <= 25 GROUP BY origin")
def downloads(spark, sf):
    x = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("origin"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".ogg")).alias("path"), F.lit("x").alias("sha256"), F.lit('{"title": "t"}').alias("json"), F.col("s_suppkey").alias("position"))
    return files.sidecar_rows(x).groupBy("kind", "origin").agg(F.count(F.lit(1)).alias("taken"), F.min("path").alias("first"))
