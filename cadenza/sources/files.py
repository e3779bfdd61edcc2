"""Scans: media files, sidecars, transcripts, entities, and container tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# File name endings of media.
MEDIA = ("wav", "flac", "mp3", "m4a", "aac", "ogg", "opus", "wma", "mp4", "mkv", "webm", "mov", "avi", "aiff")

# Fields taken over from a download's metadata, downloads of one address, and encoders that a build may have.
SIDECAR = "title string, uploader string, webpage_url string, upload_date string, duration double, language string"
MAX_ITEMS = 25
ENCODERS = ("libmp3lame", "aac", "libopus", "flac")

REFERENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "path", "text")]
    + [T.StructField("duration", T.DoubleType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("start", "score", "similarity", "snr_db", "f0_median", "rate_wps")]
)


def media_manifest(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """kind, origin, name, path, sha256, length of all media below a folder; sidecars and partial files are left out.

    path is the name that a copy takes, numbered in the order of origins within its folder: 000-first.wav, 001-second.wav, ...
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = rows.where(ending.isin(*MEDIA))
    digest = F.sha2("content", 256) if content else F.lit(None).cast("string")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    # names and digests alone meet in the window, never contents
    rows = rows.select(F.lit("file").alias("kind"), F.col("path").alias("origin"), name.alias("name"), digest.alias("sha256"), "length", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"))
    place = F.row_number().over(W.partitionBy("folder").orderBy("origin")) - 1
    return rows.withColumn("path", F.format_string("%03d-%s", place, "name")).select("kind", "origin", "name", "path", "sha256", "length")


def is_url(col: Column) -> Column:
    return col.rlike(r"^https?://")


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Left join of files to their metadata (stem, json)."""
    meta = sidecars.select(F.col("stem").alias("__stem"), F.from_json("json", SIDECAR).alias("meta"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.join(meta, stem == F.col("__stem"), "left").select(*files.columns, "meta.*")


def sidecar_rows(urls: DataFrame) -> DataFrame:
    """Downloads (origin, path, sha256, json, position) as source rows; at most 25 of an origin are taken, in order."""
    taken = urls.withColumn("__n", F.row_number().over(W.partitionBy("origin").orderBy("position"))).where(F.col("__n") <= MAX_ITEMS)
    meta = F.from_json("json", SIDECAR)
    return taken.withColumn("meta", meta).select(F.lit("url").alias("kind"), "origin", "path", "sha256", "meta.*")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Records of a ledger kept as JSON lines, in the order of writing: seq counts the lines of each voice, whatever their clocks say; broken lines fail.

    Lines are in order within a file, and files by name.  Where all lines of a voice carry a `seq`, that counts, ties included
    (`consent.current` takes the strictest of them).
    """
    schema = "voice string, at timestamp, kind string, status string, speaker string, speaker_match double, created timestamp, expires timestamp, attested_by string, evidence string, scope string, revoked_at timestamp, seq long"
    x = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumnsRenamed({"at": "ts", "speaker_match": "match", "seq": "__given"})
    # a task reads a stretch of a file from first to last, and stretches lie by their start
    x = x.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__line": F.monotonically_increasing_id()})
    w = W.partitionBy("voice")
    place = F.row_number().over(w.orderBy("__file", "__start", "__line")).cast("long")
    given = F.count("__given").over(w) == F.count(F.lit(1)).over(w)
    return x.withColumn("seq", F.when(given, F.col("__given")).otherwise(place)).drop("__given", "__file", "__start", "__line")


def centroid_rows(spark: SparkSession, path: str) -> DataFrame:
    """voice, centroid, holdout, anchor out of a table of vectors; the centroid stands for a holdout that is not there."""
    x = spark.read.parquet(path)
    at = lambda n: F.col(n) if n in x.columns else F.lit(None).cast("array<float>")
    return x.select("voice", at("centroid").alias("centroid"), F.coalesce(at("holdout"), at("centroid")).alias("holdout"), at("anchor").alias("anchor"))


def capabilities(encoders: Column, filters: Column) -> Column:
    """Which encoders and filters a media tool's listings name."""
    has = lambda text, name: F.coalesce(text.contains(f" {name} "), F.lit(False)).alias(name)
    return F.struct(*[has(encoders, n) for n in ENCODERS], has(filters, "ebur128"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """id, text of lines `id words`; the first letter large, the rest small."""
    parts = F.split("value", " ", 2)
    text = F.get(parts, F.lit(1))
    return spark.read.text(path).where("value <> ''").select(F.get(parts, F.lit(0)).alias("id"), F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**30))).alias("text"))


def entities(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON documents, one per file.  strict: a malformed one fails; else it is skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def metadata_tags(text: Column) -> Column:
    r"""`key=value` lines as a map: keys in lower case, both sides stripped, `\=` and `\;` unescaped, the last of a key wins.

    Lines that begin with `;` or `[`, and lines without `=`, are none.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains("=") & ~x.rlike(r"^[;\[]"))
    plain = lambda v: F.trim(F.replace(F.replace(v, F.lit("\\="), F.lit("=")), F.lit("\\;"), F.lit(";")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("key"), plain(F.regexp_replace(x, r"^[^=]*=", "")).alias("value")))
    later = lambda i: F.slice(pairs, i + 2, F.size(pairs))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(later(i), lambda q: q["key"] == p["key"])))


def banner_tags(banner: Column) -> Column:
    """Tags of a media banner's input section: lines `key : value` indented by four blanks at least.

    A line without key goes on with the value before; the first of a key wins; `Metadata:` is a header and no tag.
    """
    head = F.regexp_replace(banner, r"(?sm)^(?:Output #|Stream mapping:).*", "")
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[ \t]{4,}[^:]*:"))
    none = F.array().cast("array<string>")
    state = F.struct(F.lit("").alias("key"), F.map_from_arrays(none, none).alias("tags"))

    def step(acc, line):
        key, value = F.lower(F.trim(F.regexp_extract(line, r"^[ \t]{4,}([^:]*):", 1))), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
        header = (key == "metadata") & (value == "")
        more = (key == "") & (acc["key"] != "")
        fresh = (key != "") & ~header & ~F.map_contains_key(acc["tags"], key)
        longer = F.transform_values(acc["tags"], lambda k, v: F.when(k == acc["key"], F.concat_ws("\n", v, value)).otherwise(v))
        wider = F.map_concat(acc["tags"], F.when(fresh, F.create_map(key, value)).otherwise(F.map_from_arrays(none, none)))
        return F.struct(
            F.when(key == "", acc["key"]).when(fresh, key).otherwise(F.lit("")).alias("key"),
            F.when(more, longer).otherwise(wider).alias("tags"),
        )

    return F.aggregate(lines, state, step, lambda acc: acc["tags"])


def loudness(summary: Column) -> Column:
    """Integrated loudness and true peak of the last summary of a loudness log; `-inf` stays."""
    last = F.element_at(F.split(summary, "Summary:"), -1)
    number = lambda p: F.nullif(F.regexp_extract(last, p, 1), F.lit("")).try_cast("double")
    return F.struct(number(r"\bI:\s*(-?inf|-?[\d.]+) LUFS").alias("integrated"), number(r"Peak:\s*(-?inf|-?[\d.]+) dBFS").alias("true_peak"))


def segments(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """Asked stretches (source, begin, end in seconds) with their samples out of decoded sources (source, samples, sr).

    Sources that are asked for often may be persisted (memory and disk); what doesn't fit is read again, not held.
    """
    at = lambda c: F.floor(F.col(c) * F.col("sr")).cast("int")
    x = asked.join(sources, "source")
    cut = F.slice("samples", at("begin") + 1, F.greatest(at("end") - at("begin"), F.lit(0)))
    return x.withColumn("samples", cut)
