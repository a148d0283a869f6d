"""URL filter: a blocked Bloom filter in front of an exact hash join, in DataFrame functions only.

A list holds rules (host, path prefix) and whole canonical URLs. A page asks for every key that could be listed: each
suffix of its host with each directory prefix of its path, and its canonical URL. The Bloom filter of the listed keys is
a table of 256-bit blocks, one per hash of a key; a key is looked up in its one block, and only possible hits go on to the
exact join with the list, which removes false positives. Of the rules that fit, the longest decides; without one, a
listed URL is blocked and any other allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; an empty
list allows everything; repeated pages get one row each; columns of the input are not read beyond key and URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import block_count, bloom_blocks, possible_hits

#: The contract's rules: action, host, path prefix.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and path without a closing slash or ``.html``; no scheme, query or fragment."""
    bare = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.concat(F.lit("="), bare, F.regexp_replace(path_of(url), r"(/|\.html)+$", ""))


def keys_of(host: Column, path: Column, max_labels: int, max_slashes: int) -> Column:
    """Every ``host suffix + directory prefix`` with at most so many labels and slashes."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    last = F.least(F.size(labels), F.lit(max_labels))
    suffixes = F.when(
        last > 0, F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    ).otherwise(F.array().cast("array<string>"))
    depth = F.least(F.size(parts) - 1, F.lit(max_slashes))
    prefixes = F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def rule_list(spark, rules=RULES) -> DataFrame:
    """Rules as list rows. A rule's path ends in a slash."""
    if any(not p.startswith("/") or not p.endswith("/") for _, _, p in rules):
        raise ValueError("the path of a rule starts and ends with a slash")
    names = ("key", "rule", "action", "rank", "labels", "slashes")
    rows = [(h + p, h + p, a, len(h + p), h.count(".") + 1, p.count("/")) for a, h, p in rules]
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def url_list(urls: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs to block, as list rows. They rank below every rule."""
    return (
        urls.where(F.instr(url, "://") > 0)
        .select(canonical(F.col(url)).alias("key"))
        .distinct()
        .select(
            "key",
            F.lit(None).cast("string").alias("rule"),
            F.lit("block").alias("action"),
            F.lit(0).alias("rank"),
            F.lit(0).alias("labels"),
            F.lit(0).alias("slashes"),
        )
    )


def judge_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, rule and verdict for every row of ``pages``.

    Keys are asked for once per distinct URL. The number of listed keys and their greatest depth are one row.
    """
    n_keys, labels, slashes = listed.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    read = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    shown = read.select(
        "_key", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    n_blocks = block_count(n_keys)
    urls = read.where(F.instr("_url", "://") > 0).select("_url").distinct()
    u = F.col("_url")
    every = F.concat(keys_of(host_of(u), path_of(u), labels or 0, slashes or 0), F.array(canonical(u)))
    asked = urls.select("_url", F.explode(every).alias("key"))
    possible = possible_hits(asked, bloom_blocks(listed, n_blocks), n_blocks)
    hits = possible.join(listed.select("key", "rule", "action", "rank"), "key")
    best = hits.groupBy("_url").agg(F.max(F.struct("rank", "rule", "action")).alias("best"))
    judged = shown.join(best, "_url", "left")
    return judged.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
