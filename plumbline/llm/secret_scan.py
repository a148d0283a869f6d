"""Secret scan with corpus-wide ownership frequency.

Each text is scanned once. Fixed formats (assignments, access ids, long hexadecimal runs) are always reported. Opaque
tokens that only *might* be credentials are decided by the corpus: every candidate's hash is counted over the distinct
repositories and owners that hold it. A candidate held by few repositories and owners and looking random is live; one
that many share is an example copied around, and an opaque one is then not reported at all. Each kind looks random by its
own alphabet; a plain word behind ``password:`` does not, and neither does a long hexadecimal run that the text calls a
commit or a checksum.

Defined results: a null or empty text has no spans; a null repository or owner counts as one more repository or owner;
repeated rows are scanned each and count once in the frequencies, since those are over distinct holders; an empty table
gives an empty result. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import split_by
from plumbline.llm.rowkeys import fresh, row_key
from plumbline.scale import materialise

#: Fixed values of the base formats.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "opaque")

#: Opaque tokens: 32 or more characters of the base-64 alphabets with all three of upper case, lower case and digits.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
MIN_BITS = 4.0

#: Least bits per character of a hexadecimal run; random ones of 24 digits have about 3.5.
MIN_HEX_BITS = 2.8
#: Words before a hexadecimal run that make it a name of public content.
CHECKSUM = re.compile(
    r"(?:\b(?:commit|revision|rev|checksum|digest|md5|sha-?\d*|blob|tree|parent|merge|etag|git|hash|fingerprint|integrity)"
    r"[\s:=#@(\"'-]*|\b(?:git|commit|commits|blob|tree)/)$", re.I
)
BEFORE = 32

SPAN = "struct<kind:int,start:bigint,stop:bigint,hash:string,random:boolean>"


def bits_per_character(value: str) -> float:
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def looks_random(value: str) -> bool:
    classes = (str.isupper, str.islower, str.isdigit)
    return all(any(map(c, value)) for c in classes) and bits_per_character(value) >= MIN_BITS


def hex_looks_random(value: str) -> bool:
    return any(c > "9" for c in value) and any(c <= "9" for c in value) and bits_per_character(value) >= MIN_HEX_BITS


def value_looks_random(value: str) -> bool:
    """Whether an assigned value is no word, number, date or placeholder: evenly spread characters of mixed classes."""
    core = value.strip("._-=")
    letters, digits = (sum(map(c, core)) for c in (str.isalpha, str.isdigit))
    if len(core) < 6 or bits_per_character(core) < 0.75 * math.log2(min(len(core), 16)):
        return False
    if not letters:
        return digits >= 12
    if not digits:
        changes = sum(a.isupper() != b.isupper() for a, b in zip(core, core[1:], strict=False))
        return len(core) >= 12 and 4 * changes >= len(core)
    return True


def live_looking(kind: int, value: str, before: str) -> bool:
    if kind == 0:
        return value_looks_random(value)
    if kind == 1:
        return bits_per_character(value[4:]) >= 2.5 and "EXAMPLE" not in value
    return kind == 3 or (hex_looks_random(value) and not CHECKSUM.search(before))


def scan(text: str | None) -> list[tuple[int, int, int, str, bool]]:
    """(kind, start, stop, hash of the secret itself, whether it looks random), by start and then kind."""
    text = text or ""
    found = []
    if "=" in text or ":" in text:
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    inside = [(a, b) for _, a, b, _ in found]
    for m in OPAQUE.finditer(text):
        if looks_random(m[0]) and not any(a < m.end() and m.start() < b for a, b in inside):
            found.append((3, *m.span(), m[0]))
    return [
        (k, a, b, hashlib.sha256(v.encode()).hexdigest(), live_looking(k, v, text[max(0, a - BEFORE) : a]))
        for k, a, b, v in sorted(found, key=lambda x: (x[1], x[0]))
    ]


def _spans(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())])
    names = ("kind", "start", "stop", "hash", "random")
    return pa.array([[dict(zip(names, x, strict=True)) for x in scan(t)] for t in texts.to_pylist()], pa.list_(kind))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array ``candidates`` of all spans, base and opaque."""
    return docs.withColumn("candidates", F.arrow_udf(_spans, f"array<{SPAN}>")(F.col(text)))


def ownership(rows: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Per candidate hash: distinct repositories and distinct owners that hold it.

    Holders are made distinct before they are counted, and both steps combine before they shuffle, so a candidate
    that stands in a third of all rows arrives as a few rows per task.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    held = rows.select(
        F.explode("candidates.hash").alias("hash"), named(repository).alias("repository"), named(owner).alias("owner")
    ).distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"))
    repositories = held.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    return owners.join(repositories, "hash")


def span_text(spans: Column) -> Column:
    names = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(k))])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start, s.stop)), ",")


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: Column | None = None,
    owner: Column | None = None,
    max_owners: int = 2,
    max_repositories: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: key, base counts, ``spans`` with verdicts, and how many of them are live.

    ``spans`` is an array of (kind, start, stop, hash, n_repositories, n_owners, live). A span is live when it looks random
    and at most ``max_owners`` owners and ``max_repositories`` repositories hold its hash. Opaque spans that are not live are left out; base spans always stay.
    Only rows that have candidates are taken apart; the others are never shuffled.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    scanned = candidates(
        docs.select(
            F.col(key).alias("_key"), F.col(text).alias("_text"), repository.alias("_repo"), owner.alias("_owner")
        ),
        "_text",
    )
    scanned = scanned.select("_key", "_repo", "_owner", "candidates")
    with_any = F.size("candidates") > 0
    stored = materialise(scanned, "secret-candidates")
    held = ownership(stored.where(with_any), F.col("_repo"), F.col("_owner"))
    some = stored.where(with_any).withColumn("_row", row_key("_key", "_repo", "_owner", "candidates"))
    single = some.select("_row", F.explode("candidates").alias("c")).distinct()
    judged = single.join(held, single["c.hash"] == held["hash"], "left").withColumn(
        "live", F.col("c.random") & (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    )
    kept = judged.where((F.col("c.kind") < 3) | F.col("live"))
    span = F.struct("c.start", "c.kind", "c.stop", "c.hash", "n_repositories", "n_owners", "live")
    spans = kept.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    result = some.join(spans, "_row", "left").select("_key", "spans")
    none = stored.where(~with_any).select("_key", F.lit(None).cast(result.schema["spans"].dataType).alias("spans"))
    return result.unionByName(none).select(F.col("_key").alias(key), F.coalesce("spans", F.array()).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]", **how) -> DataFrame:
    """``docs`` with every live span of ``text`` replaced by ``mark``; overlapping spans by one. No row is dropped.

    Only rows whose key may be among those with live spans are shuffled. Rows are told apart by key and text.
    """
    row, spans = fresh("_row", docs.columns), fresh("spans", docs.columns)
    named = docs.withColumn(row, row_key(key, text))
    live = F.filter("spans", lambda s: s.live)
    found = scan_secrets(named, row, text, **how).select(row, live.alias(spans)).where(F.size(spans) > 0)
    found = materialise(found.distinct(), "live-secrets")
    certain, others = split_by(named, found.select(row), row)
    replaced = others.join(found, row, "left").withColumn(
        text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(_cut(F.col(text), F.col(spans), mark))
    )
    return certain.select(*docs.columns).unionByName(replaced.select(*docs.columns))


def _cut(t: Column, spans: Column, mark: str) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, (acc["at"] + 1).cast("int"), (s.start - acc["at"]).cast("int"))
        inside = F.struct(F.greatest(acc["at"], s.stop).alias("at"), acc["text"].alias("text"))
        return F.when(s.start < acc["at"], inside).otherwise(
            F.struct(s.stop.alias("at"), F.concat(acc["text"], gap, F.lit(mark)).alias("text"))
        )

    end = F.length(t)
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["text"], F.substring(t, (acc["at"] + 1).cast("int"), end)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and texts of the spans of ``scan_secrets``."""
    base = F.filter("spans", lambda s: s.kind < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"),
    )
