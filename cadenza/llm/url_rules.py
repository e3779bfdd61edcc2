"""URL allow and block rules by a bit-parallel wildcard automaton.

All glob patterns lie side by side in one multiword bit mask.  A Shift-And step takes one byte of every URL of
an Arrow batch at once: `D = ((D << 1) & B[byte]) | (D & L[byte])`, where B says which pattern elements the byte
fits and L which states may stay where they are (inside `*`, `**` or a multi-byte character).

Glob syntax: `*` is any run without `/`, `**` any run, `?` one character; all else stands for itself.

Results in special cases
------------------------
* null URL, or one without `://`: empty host and path, no rule, the default verdict;
* empty URL text, empty table, repeated rows: each row is judged alone, so all of these are ordinary;
* ties between rules of equal length: the smallest rule string wins (two verdicts for one rule string are refused);
* very long URLs: states are dropped as soon as nothing can change, memory is a few words per URL of the batch;
* further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str  # begins with /

    def __post_init__(self):
        if self.verdict not in (ALLOW, BLOCK) or not self.host or not self.path.startswith("/"):
            raise ValueError(f"not a rule: {self}")

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        """The host itself and all its subdomains; then any rest of the path."""
        return f"{self.text}**", f"*.{self.text}**"


#: The rules of the registered query.
RULES = (
    Rule(BLOCK, "com", "/en/"),
    Rule(ALLOW, "example.com", "/en/7"),
    Rule(ALLOW, "net", "/de/"),
    Rule(BLOCK, "example.net", "/de/8"),
    Rule(BLOCK, "org", "/es/"),
)


class Automaton:
    """Shift-And masks of many globs, matched against whole strings."""

    def __init__(self, globs: list[str]):
        goes: list[set[int]] = [set() for _ in range(256)]  # B, as bit numbers
        stays: list[set[int]] = [set() for _ in range(256)]  # L
        starts, self.final = [], []
        slash, tail = ord("/"), range(0x80, 0xC0)
        at = 0
        for glob in globs:
            starts.append(at)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    for c in range(256):
                        stays[c].add(at)
                    i += 2
                elif raw[i] == ord("*"):
                    for c in range(256):
                        if c != slash:
                            stays[c].add(at)
                    i += 1
                else:
                    at += 1
                    if raw[i] == ord("?"):
                        for c in range(256):
                            (stays if c in tail else goes)[c].add(at)
                    else:
                        goes[raw[i]].add(at)
                    i += 1
            self.final.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.start = self._mask(starts)
        self.goes = np.stack([self._mask(x) for x in goes])
        self.stays = np.stack([self._mask(x) for x in stays])
        #: Accepting bits that stay whatever comes: once only they are left, the URL is decided.
        self.fixed = np.bitwise_and.reduce(self.stays, axis=0) & self._mask(self.final)

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b >> 6] |= np.uint64(1 << (b & 63))
        return out

    def run(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix: text x glob."""
        raw = [t.encode() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(size) - size
        state = np.tile(self.start, (len(raw), 1))
        one, top = np.uint64(1), np.uint64(63)
        live, pos = np.arange(len(raw)), 0
        live = live[size > 0]
        while len(live):
            byte = flat[begin[live] + pos]
            now = state[live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[live] = now = (moved & self.goes[byte]) | (now & self.stays[byte])
            pos += 1
            on = size[live] > pos
            if pos % 8 == 0:
                on &= (now & ~self.fixed).any(axis=1)
            if not on.all():
                live = live[on]
        final = np.array(self.final)
        return (state[:, final >> 6] >> (final & 63).astype(np.uint64)) & one == one


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without a host part."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))]
    return host.encode().lower().decode(), path  # bytes.lower touches A-Z only


def apply_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """Judges every URL: key, host, path, rule, verdict.  The longest fitting rule wins."""
    if len({r.text for r in rules}) < len(rules):
        raise ValueError("a rule string stands twice")
    order = sorted(rules, key=lambda r: (-len(r.text), r.text))
    automaton = Automaton([g for r in order for g in r.globs()]) if order else None
    names = np.array([r.text for r in order] + [None], object)
    verdicts = np.array([r.verdict for r in order] + [default], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            best = np.full(len(parts), len(order))
            if automaton and parts:
                fits = automaton.run([h + p for h, p in parts]).reshape(len(parts), len(order), 2).any(axis=2)
                best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(order))
            texts = ([h for h, _ in parts], [p for _, p in parts], names[best].tolist(), verdicts[best].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in texts)], names=["key", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"))
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind)] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])
    return rows.mapInArrow(judge, schema).withColumnRenamed("key", key)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(common.table(spark, sf_dir, "pages"))


_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in RULES)
OP1_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{common.UPPER}', '{common.LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(r_host, r_path, r_text, r_verdict) AS (VALUES {_RULE_ROWS}
), fits AS (
  SELECT p.*, r_text, r_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_text) DESC NULLS LAST, r_text) AS place
  FROM parts p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, r_text AS rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
