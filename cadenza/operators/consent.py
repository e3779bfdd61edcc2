"""The consent ledger: append-only records per voice, views over them, and the gate in front of delivery.

A record is (voice, seq, ts, kind, status, ...); the largest seq of a voice is in force, whatever the clocks say.  Records of one
seq, which no writer here makes, count in order of strictness: a revocation is in force before anything else, and what permits
nothing before what permits.  `kind` is how consent was given:
spoken, or attested by somebody else.  A spoken consent whose recording doesn't sound like the voice's references (`match`)
permits nothing.  Nothing here grants consent to an automated caller: `verified` needs the measures of a recording, `attested` a
named person and evidence; they return the records to append, with a reason where there is none.
"""

from __future__ import annotations

import secrets
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.files import filesystem
from .gates import first_failing

# States that permit, the least similarity of a recording to its voice, and days that a request is open.
USABLE = ("verified", "attested")
MATCH = 0.45
REQUEST_DAYS = 14

#: Fields of a record, all nullable but voice, seq, ts and status.
RECORD = (
    "voice", "seq", "ts", "kind", "status", "speaker", "statement", "code", "created", "expires", "match", "attested_by", "evidence", "scope", "revoked_at",
)
_TYPES = {"seq": "long", "match": "double"} | {c: "timestamp" for c in ("created", "expires", "revoked_at")}


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(_TYPES.get(name, "string"))


def refusal(status: Column, kind: Column, match: Column) -> Column:
    """Why a voice may not be used; empty if it may."""
    return first_failing((status.isNull(), "missing"), (~status.isin(*USABLE), status), ((kind == "spoken") & (match < MATCH), "another speaker"))


def strictness(status: Column, why: Column) -> Column:
    """Which of two records with one seq is in force: the larger one, so that ties fail closed."""
    return F.when(status == "revoked", 2).when(F.coalesce(why, F.lit("missing")) != "", 1).otherwise(0)


def _placed(ledger: DataFrame) -> DataFrame:
    """The ledger with `__place`, by which its records are in order; wholly equal ranks are told apart by time and a hash of the record."""
    why = refusal(F.col("status"), _field(ledger, "kind"), _field(ledger, "match"))
    return ledger.withColumn("__place", F.struct("seq", strictness(F.col("status"), why).alias("rank"), "ts", F.xxhash64(*ledger.columns).alias("own")))


def current(ledger: DataFrame) -> DataFrame:
    """The record in force of each voice, with `refusal` and `usable`."""
    cols = [c for c in ledger.columns if c not in ("voice", "seq")]
    last = _placed(ledger).groupBy("voice").agg(F.max_by(F.struct("seq", *cols), "__place").alias("r")).select("voice", "r.*")
    why = refusal(F.col("status"), _field(last, "kind"), _field(last, "match"))
    return last.withColumn("refusal", why).withColumn("usable", F.col("refusal") == "")


def as_of(ledger: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe (voice, at, probe) with the record in force then, the last one of those not after it: in_force, kind, created."""
    fields = F.struct("status", _field(ledger, "kind").alias("kind"), _field(ledger, "created").alias("created"))
    a = _placed(ledger).select("voice", F.col("ts").alias("at"), F.struct("__place", fields.alias("r")).alias("r"), F.lit(None).cast("long").alias("probe"))
    b = probes.select("voice", "at", F.lit(None).cast(a.schema["r"].dataType).alias("r"), F.col("probe").cast("long").alias("probe"))
    w = W.partitionBy("voice").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("r", F.max("r").over(w)["r"]).where("probe IS NOT NULL")
    return out.select("voice", "probe", "at", F.col("r.status").alias("in_force"), "r.kind", "r.created")


def permitted(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of voices whose current record is usable."""
    return rows.join(current(ledger).where("usable").select("voice"), "voice", "left_semi")


def unchanged(started: DataFrame, ledger: DataFrame) -> DataFrame:
    """Work begun under a grant (voice, kind, created, ...) with `problem`: why it may not be delivered now, or empty.

    The consent must still be usable, and be the one that the work began with.
    """
    now = current(ledger)
    now = now.select(F.col("voice").alias("__voice"), "refusal", _field(now, "kind").alias("__kind"), _field(now, "created").alias("__created"))
    same = F.col("kind").eqNullSafe(F.col("__kind")) & F.col("created").eqNullSafe(F.col("__created"))
    problem = first_failing((F.col("__voice").isNull(), "missing"), (F.col("refusal") != "", F.col("refusal")), (~same, "consent changed"))
    return started.join(now, F.col("voice") == F.col("__voice"), "left").withColumn("problem", problem).drop("__voice", "refusal", "__kind", "__created")


def attest_reason(by: Column, evidence: Column, previous: Column, override: Column) -> Column:
    """Why an attestation is refused."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return first_failing((blank(by), "name missing"), (blank(evidence), "evidence missing"), ((previous == "revoked") & ~F.coalesce(override, F.lit(False)), "revoked before"))


def verify_reason(status: Column, now: Column, expires: Column, seconds: Column, code_cer: Column, statement_cer: Column, match: Column) -> Column:
    """Why a recorded consent isn't verified: the checks in order; an unknown match is left to the gate."""
    return first_failing(
        (status.isNull() | (status == "revoked"), "request first"), (now > expires, "code expired"), (F.coalesce(seconds, F.lit(0.0)) < 4, "too short"),
        (F.coalesce(code_cer, F.lit(1.0)) > 0.25, "code not heard"), (F.coalesce(statement_cer, F.lit(1.0)) > 0.2, "statement not heard"), (match < MATCH, "another speaker"),
    )


def revocations(ledger: DataFrame) -> DataFrame:
    """Attestations with the status before them, and whether they needed an override."""
    w = W.partitionBy("voice").orderBy("seq")
    x = ledger.withColumn("previous", F.lag("status").over(w)).where("status = 'attested'")
    return x.withColumn("needs_override", F.coalesce(F.col("previous") == "revoked", F.lit(False)))


# --- appending -------------------------------------------------------------------------------------------------


def _beside(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """What is asked (voice, now, ..., one row of a voice) beside the record in force, as `old`."""
    now = current(ledger)
    old = F.struct("seq", *[_field(now, c).alias(c) for c in RECORD[3:]])
    return asked.join(now.select("voice", old.alias("old")), "voice", "left")


def _record(rows: DataFrame, keep: bool, **new: Column) -> DataFrame:
    """Rows as records one after the record in force; fields not given are kept from it, or empty; `reason` comes last."""
    fields = [F.coalesce(F.col("old.seq") + 1, F.lit(1)).cast("long").alias("seq"), F.col("now").alias("ts")]
    for c in RECORD[3:]:
        fields.append(new.get(c, F.col(f"old.{c}") if keep else F.lit(None).cast(_TYPES.get(c, "string"))).alias(c))
    return rows.select("voice", *fields, new.get("reason", F.lit("")).alias("reason"))


def statement(speaker: Column, code: Column) -> Column:
    """The sentence a speaker reads aloud."""
    return F.format_string("I, %s, agree that a synthetic voice is made of my own. It can say what I never said, and I can take this back. My code is %s.", speaker, code)


def new_code(words: list[str]) -> str:
    """Three words and a number from 10 to 99, drawn for one request; never from anything that can be guessed."""
    draw = secrets.SystemRandom()
    return " ".join([*(draw.choice(words) for _ in range(3)), str(draw.randint(10, 99))])


def requested(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pending records for asked (voice, now, speaker, code, scope); the code is drawn by the caller."""
    rows = _beside(asked, ledger)
    until = F.col("now") + F.make_dt_interval(F.lit(REQUEST_DAYS))
    return _record(rows, False, kind=F.lit("spoken"), status=F.lit("pending"), speaker=F.col("speaker"), code=F.col("code"), scope=F.col("scope"), statement=statement(F.col("speaker"), F.col("code")), created=F.col("now"), expires=until)


def verified(measured: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records out of recordings (voice, now, seconds, code_cer, statement_cer, match).

    All checks passed: verified.  Another speaker's voice: the match is put on record, the status stays.  Any other reason: no
    record belongs in the ledger (`appendable`).
    """
    rows = _beside(measured, ledger)
    asked = F.when(F.col("old.kind") == "spoken", F.col("old.status"))
    why = verify_reason(asked, F.col("now"), F.col("old.expires"), F.col("seconds"), F.col("code_cer"), F.col("statement_cer"), F.col("match"))
    return _record(rows, True, status=F.when(why == "", "verified").otherwise(F.col("old.status")), match=F.coalesce("match", "old.match"), reason=why)


def attested(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Attestations out of asked (voice, now, speaker, by, evidence, scope, override); with a reason where they are refused."""
    rows = _beside(asked, ledger)
    by, evidence = F.trim("by"), F.trim("evidence")
    said = F.format_string("%s attests that %s has authorised a synthetic voice: %s", by, F.col("speaker"), evidence)
    why = attest_reason(F.col("by"), F.col("evidence"), F.col("old.status"), F.col("override"))
    return _record(rows, False, kind=F.lit("attested"), status=F.lit("attested"), speaker=F.col("speaker"), created=F.col("now"), attested_by=by, evidence=evidence, scope=F.col("scope"), statement=said, reason=why)


def revoked(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Revocations out of asked (voice, now); a voice without a record has nothing to revoke."""
    rows = _beside(asked, ledger)
    return _record(rows, True, status=F.lit("revoked"), revoked_at=F.col("now"), reason=F.when(F.col("old.seq").isNull(), "missing").otherwise(""))


def matched(similarities: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records with a new match (voice, now, match) for spoken consents, after the references of a voice have changed."""
    rows = _beside(similarities, ledger).where((F.col("old.kind") == "spoken") & F.col("match").isNotNull())
    return _record(rows, True, match=F.round("match", 4))


def appendable(records: DataFrame) -> DataFrame:
    """The records that belong in the ledger, without their reason."""
    return records.where(F.col("reason").isin("", "another speaker")).drop("reason")


class LedgerConflict(RuntimeError):
    """Somebody else has written a record of the voice meanwhile; read the ledger again and ask anew."""


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All records of a ledger on disk as it is now.

    Commits are named one by one, so that a frame of an earlier state, cached by anybody, is never taken for this one.
    """
    schema = ", ".join(f"`{c}` {_TYPES.get(c, 'timestamp' if c == 'ts' else 'string')}" for c in RECORD)
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in _written(spark, path)])


def _written(spark: SparkSession, path: str) -> list[str]:
    """Commits, and files of ledgers that are older than commits."""
    fs, at = filesystem(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at(path))]
    return sorted(n for n in names if n.startswith("commit-") or n.endswith(".parquet"))


def append(records: DataFrame, path: str, tries: int = 50) -> None:
    """Adds records to the ledger on disk, all or none.  It is only ever added to, so a revocation stays on record whatever follows.

    Each append is a numbered commit: its rows are staged, then the stage takes the next number by a rename that never replaces.
    Who comes second reads the ledger again, and goes on with the number after it unless one of its voices has a record that
    it hadn't seen: that is a LedgerConflict, and nothing is written.
    """
    spark = records.sparkSession
    fs, at = filesystem(spark, path)
    stage, owner = f"{path}/_stage-{uuid.uuid4().hex}", f"_owner-{uuid.uuid4().hex}"
    try:
        appendable(records).select(*RECORD).write.parquet(stage)
        fs.create(at(f"{stage}/{owner}")).close()
        mine = spark.read.parquet(stage).groupBy("voice").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("n_seq"))
        if mine.where("n > n_seq").limit(1).count():
            raise LedgerConflict("two records of one voice in one append")
        if not mine.limit(1).count():
            return
        for _ in range(tries):
            if written := _written(spark, path):
                held = ledger(spark, path).groupBy("voice").agg(F.max("seq").alias("last"))
                if (late := mine.join(held, "voice").where("first <= last").select("voice").first()) is not None:
                    raise LedgerConflict(f"a record of {late['voice']!r} was written meanwhile")
            number = max((int(n.removeprefix("commit-")) for n in written if n.startswith("commit-")), default=0) + 1
            if _renamed(spark, at(stage), at(f"{path}/commit-{number:010d}"), fs, owner):
                return
        raise LedgerConflict(f"no commit in {tries} tries")
    finally:
        fs.delete(at(stage), True)


def _renamed(spark: SparkSession, source, target, fs, owner: str) -> bool:
    """Whether the folder is at the target now; a target that is there already is left alone."""
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)
    except Py4JJavaError:
        if not fs.exists(target):
            raise
    return fs.exists(jvm.org.apache.hadoop.fs.Path(target, owner))


def steps(asked: DataFrame, ledger: DataFrame) -> DataFrame:
    """voice, consent, steps: what people have to do before a voice can be used; a read-only view, empty where nothing is missing."""
    now = current(ledger).select("voice", "status", "usable")
    todo = F.array(
        F.format_string("request consent for %s", F.col("voice")), F.format_string("have %s read the statement aloud and keep the recording", F.col("speaker")),
        F.format_string("verify the recording for %s", F.col("voice")), F.format_string("or attest, by name and with evidence, that %s has authorised it", F.col("speaker")),
    )
    x = asked.join(now, "voice", "left")
    return x.select("voice", F.coalesce("status", F.lit("none")).alias("consent"), F.when(F.coalesce("usable", F.lit(False)), F.array().cast("array<string>")).otherwise(todo).alias("steps"))
