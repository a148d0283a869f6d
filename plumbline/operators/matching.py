"""Entity matching between two systems by rules on their fields.

Everything is done on distinct values: records are reduced to the digest of the values that a rule
reads, digests are linked, and the links are brought back to the records. A value carried by a large
share of all records is therefore compared once, and the result has one row per right record and
matched left value, never one per pair of records. Similar texts are found by a segment that they
share unchanged, so only texts with an equal segment at nearly the same place are compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.scale import lookup_join, materialise, split_join

DEFAULT_THRESHOLD = 0.85


@dataclass(frozen=True)
class Term:
    """``op`` is direct, normalized or similarity."""

    left: str
    right: str
    op: str = "direct"
    threshold: float = DEFAULT_THRESHOLD


Rules = Sequence[Sequence[Term]]


def normalized(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(c.cast("string")), "[^A-Z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance relative to the longer text."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _fields(terms: Sequence[Term], side: str) -> tuple[list[Column], list[Column]]:
    """Columns that must be equal, as text, and columns that must be similar."""
    equal, similar = [], []
    for t in terms:
        c = F.col(getattr(t, side))
        if t.op == "direct":
            equal.append(c.cast("string"))
        elif t.op == "normalized":
            equal.append(normalized(c))
        elif t.op == "similarity":
            similar.append(normalized(c))
        else:
            raise SpecError(f"unknown matching operator {t.op!r}")
    if not equal:
        raise SpecError("a matching rule needs a direct or normalized term besides similarity")
    return equal, similar


def _records(df: DataFrame, id_column: str, rules: Rules, side: str) -> DataFrame:
    """``id, rule, key, text, value`` per record and rule; records with a null field are left out.

    ``key`` identifies the values that must be equal and ``value`` all values of the rule.
    """
    parts = []
    for i, terms in enumerate(rules):
        equal, similar = _fields(terms, side)
        key = F.sha2(F.to_json(F.struct(*[c.alias(f"k{j}") for j, c in enumerate(equal)])), 256)
        text = F.array(*similar).cast("array<string>")
        usable = F.lit(True)
        for c in [*equal, *similar]:
            usable = usable & c.isNotNull()
        parts.append(F.when(usable, F.struct(F.lit(i).alias("rule"), key.alias("key"), text.alias("text"))))
    rows = df.select(F.col(id_column).alias("id"), F.explode(F.array_compact(F.array(*parts))).alias("r"))
    value = F.sha2(F.concat("key", F.lit("|"), F.to_json("text")), 256)
    return rows.select("id", "r.*").withColumn("value", value)


def _values(records: DataFrame) -> DataFrame:
    """Distinct values with their number of records and least id; counted before the shuffle."""
    return records.groupBy("rule", "key", "value").agg(
        F.min("id").alias("id"), F.count("*").alias("records"), F.first("text").alias("text")
    )


def _links(left: DataFrame, right: DataFrame, rules: Rules) -> DataFrame:
    """Left and right values that meet a rule, with the similarity, and of both the least record and their number.

    Without similarity terms the equal fields decide. Else candidates share a segment of the text. Each side's distinct
    values are written once, as both kinds of rule and several steps read them.
    """
    l_side = materialise(_values(left), "values").withColumnsRenamed({"value": "left_value", "id": "left_id", "records": "left_records", "text": "a"})
    r_side = materialise(_values(right), "values").withColumnsRenamed({"value": "right_value", "id": "right_id", "records": "right_records", "text": "b"})
    fuzzy = [i for i, terms in enumerate(rules) if any(t.op == "similarity" for t in terms)]
    exact = [i for i in range(len(rules)) if i not in fuzzy]
    columns = ["rule", *(f"{s}_{c}" for s in ("left", "right") for c in ("value", "id", "records")), "confidence"]
    out = None
    if exact:
        same = l_side.filter(F.col("rule").isin(exact)).join(r_side, ["rule", "key"])
        out = same.withColumn("confidence", F.lit(1.0)).select(*columns)
    if fuzzy:
        first = {i: next(t.threshold for t in rules[i] if t.op == "similarity") for i in fuzzy}
        if min(first.values()) <= 0.5:
            raise SpecError("a similarity of one half or less would need all pairs")
        bound = F.coalesce(*[F.when(F.col("rule") == i, F.lit(t)) for i, t in first.items()])
        chosen = F.col("rule").isin(fuzzy)
        l_rows = l_side.filter(chosen).withColumns({"s": F.get("a", F.lit(0)), "t": bound})
        r_rows = r_side.filter(chosen).withColumns({"s": F.get("b", F.lit(0)), "t": bound})
        shared = _shared_ends(l_rows.select("rule", "key", "s").unionByName(r_rows.select("rule", "key", "s")))
        l_tokens = _segments(split_join(l_rows, shared, ["rule", "key"])).select(*l_side.columns, "token")
        r_tokens = _probes(split_join(r_rows, shared, ["rule", "key"])).select(*r_side.columns, "token")
        # one row per candidate pair, however many tokens it shares, before any distance is computed
        pairs = l_tokens.join(r_tokens, ["rule", "key", "token"]).drop("token").distinct()
        near = _similar(pairs, rules).select(*columns)
        out = near if out is None else out.unionByName(near)
    return out


def _shared_ends(texts: DataFrame) -> DataFrame:
    """``ends``: how many first and last letters all texts of a block share, without overlap.

    Shared ends don't change an edit distance, and segments of them would match everything. Those of the least and the
    greatest text are those of all.
    """
    block = texts.groupBy("rule", "key").agg(
        F.min("s").alias("lo"), F.max("s").alias("hi"), F.min(F.reverse("s")).alias("rlo"),
        F.max(F.reverse("s")).alias("rhi"), F.min(F.length("s")).alias("least"),
    )

    def common(a: str, b: str) -> Column:
        places = F.expr(f"CASE WHEN least(length({a}), length({b})) > 0 THEN sequence(1, least(length({a}), length({b}))) ELSE array() END")
        return F.size(F.filter(places, lambda i: F.substring(F.col(a), F.lit(1), i) == F.substring(F.col(b), F.lit(1), i)))

    found = block.withColumns({"head": common("lo", "hi"), "tail": common("rlo", "rhi")})
    return found.select("rule", "key", "head", F.least("tail", F.col("least") - F.col("head")).alias("tail"))


EDITS = "int(floor((1 - t) * {n} + 1e-9))"


def _segments(rows: DataFrame) -> DataFrame:
    """Tokens of the left texts: each is cut into one segment more than edits are allowed.

    Of two texts within k edits, one of the k + 1 segments of the first stands unchanged in the second, at most k
    letters from its place. k follows from the longer text, so a text is cut for every k that a partner may bring.
    """
    core = rows.withColumns({"n": F.length("s"), "m": F.expr("length(s) - head - tail")}).withColumn(
        "c", F.expr("substring(s, head + 1, m)")
    )
    edits = F.expr(f"sequence({EDITS.format(n='n')}, {EDITS.format(n='floor(n / t + 1e-9)')})")
    each = core.withColumn("k", F.explode(edits))
    cut = F.expr(
        """CASE WHEN m < k + 1 THEN array(concat_ws(' ', k, n, '*'))
        ELSE transform(sequence(0, k), i -> concat_ws(' ', k, n, i,
             substring(c, int(i * m div (k + 1)) + 1, int((i + 1) * m div (k + 1)) - int(i * m div (k + 1))))) END"""
    )
    return each.withColumn("token", F.explode(cut))


def _probes(rows: DataFrame) -> DataFrame:
    """Tokens of the right texts: for each length of a partner, the pieces that can be one of its segments.

    A segment at place p is looked for from p - k to p + k, as far as the letters behind it leave enough edits.
    """
    core = rows.withColumns({"n": F.length("s"), "m": F.expr("length(s) - head - tail")}).withColumn(
        "c", F.expr("substring(s, head + 1, m)")
    )
    lengths = F.expr("sequence(int(greatest(ceil(t * n - 1e-9), head + tail)), int(greatest(floor(n / t + 1e-9), head + tail)))")
    each = core.withColumn("ln", F.explode(lengths)).withColumns(
        {"k": F.expr(EDITS.format(n="greatest(n, ln)")), "lm": F.expr("ln - head - tail")}
    ).where("abs(n - ln) <= k")
    pieces = F.expr(
        """CASE WHEN lm < k + 1 THEN array(concat_ws(' ', k, ln, '*'))
        ELSE array_distinct(flatten(transform(sequence(0, k), i ->
          transform(filter(sequence(greatest(-k, m - lm - k), least(k, m - lm + k)),
                           d -> int(i * lm div (k + 1)) + d >= 0 AND int((i + 1) * lm div (k + 1)) + d <= m),
            d -> concat_ws(' ', k, ln, i, substring(c, int(i * lm div (k + 1)) + d + 1,
                 int((i + 1) * lm div (k + 1)) - int(i * lm div (k + 1)))))))) END"""
    )
    return each.withColumn("token", F.explode(pieces))


def _similar(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Pairs whose similar fields all reach their thresholds, with the least similarity."""
    bounds, confidence = F.lit(False), F.lit(None).cast("double")
    for i, terms in enumerate(rules):
        fuzzy = [t for t in terms if t.op == "similarity"]
        if not fuzzy:
            continue
        enough, scores = F.lit(True), []
        for j, t in enumerate(fuzzy):
            a, b = F.get("a", F.lit(j)), F.get("b", F.lit(j))
            longest = F.greatest(F.length(a), F.length(b))
            # A difference in length bounds the distance from below and is cheaper to test.
            close = F.abs(F.length(a) - F.length(b)) <= longest * (1 - t.threshold) + 1e-9
            enough = enough & close & (similarity(a, b) >= t.threshold)
            scores.append(similarity(a, b))
        score = scores[0] if len(scores) == 1 else F.least(*scores)
        bounds = F.when(F.col("rule") == i, enough).otherwise(bounds)
        confidence = F.when(F.col("rule") == i, score).otherwise(confidence)
    return pairs.filter(bounds).withColumn("confidence", confidence)


def match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Rules) -> DataFrame:
    """Global identity of every matched right record.

    ``left_id`` is the least of the left records that share the matched values, and
    ``left_records`` their number. Confidence is the best over all rules.
    """
    rows = _records(right, right_id, rules, "right")
    best = _partners(_links(_records(left, left_id, rules, "left"), rows, rules), rows, "right", "left")
    return best.withColumn("global_id", F.sha2(F.concat(F.lit("entity:"), F.col("left_id").cast("string")), 256))


def _partners(links: DataFrame, rows: DataFrame, side: str, other: str) -> DataFrame:
    """For each record of one side the partners on the other, from links of values: ``<side>_id, <other>_id,
    confidence, <other>_records``."""
    found = links.select(F.col(f"{side}_value").alias("value"), f"{other}_id", f"{other}_records", "confidence")
    # A frequent value is spread over many tasks by the lookup join.
    joined = lookup_join(rows.select(F.col("id").alias(f"{side}_id"), "value"), found, ["value"], "inner")
    return joined.groupBy(f"{side}_id", f"{other}_id").agg(
        F.max("confidence").alias("confidence"), F.max(f"{other}_records").alias(f"{other}_records")
    )


def conflicts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: Rules) -> DataFrame:
    """Records that need a decision: ``side, native_id, issue``.

    unmatched: no partner; one-to-many: several partners; low-confidence: a left record whose best
    candidate under a similarity rule stays below the threshold. Values are linked once; both directions and the weak
    candidates are read from the same links.
    """
    rows = {
        "left": materialise(_records(left, left_id, rules, "left"), "records"),
        "right": materialise(_records(right, right_id, rules, "right"), "records"),
    }
    links = materialise(_links(rows["left"], rows["right"], rules), "links")

    def report(df: DataFrame, side: str, issue: str) -> DataFrame:
        native = F.col("id").cast("string").alias("native_id")
        return df.select(F.lit(side).alias("side"), native, F.lit(issue).alias("issue"))

    out = None
    for side, other, frame, column in (("left", "right", left, left_id), ("right", "left", right, right_id)):
        counted = _partners(links, rows[side], side, other).groupBy(F.col(f"{side}_id").alias("id")).agg(
            F.count("*").alias("partners"), F.max(f"{other}_records").alias("copies")
        )
        lone = frame.select(F.col(column).alias("id")).join(counted.select("id"), "id", "left_anti")
        part = report(lone, side, "unmatched").unionByName(
            report(counted.filter("partners > 1 OR copies > 1"), side, "one-to-many")
        )
        out = part if out is None else out.unionByName(part)
    fuzzy = [i for i, terms in enumerate(rules) if any(t.op == "similarity" for t in terms)]
    if not fuzzy:
        return out
    chosen = F.col("rule").isin(fuzzy)
    weak = _below_threshold(rows["left"].filter(chosen), rows["right"].filter(chosen), links.filter(chosen))
    return out.unionByName(report(weak, "left", "low-confidence"))


def _below_threshold(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """Left records that share a rule's equal fields with some right record, none of them similar enough."""
    candidates = left.join(right.select("rule", "key").distinct(), ["rule", "key"], "left_semi").select("id", "value")
    enough = links.select(F.col("left_value").alias("value")).distinct()
    good = lookup_join(candidates, enough, ["value"], "inner").select("id").distinct()
    return candidates.select("id").distinct().join(good, "id", "left_anti")


def without_partner_near(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_day: str, right_day: str, days: int = 1
) -> DataFrame:
    """Left rows without any right row of the same key within ``days`` of their date.

    Dates are put in buckets as wide as the window. The distinct right dates are repeated in the two
    or three buckets that their window touches, so the join is an equality with a cheap extra test.
    """
    width = max(days, 1)

    def bucket(day: Column) -> Column:
        return F.floor(day / width)

    r_day = F.unix_date(F.col(right_day))
    reach = F.sequence(bucket(r_day - days), bucket(r_day + days))
    dates = right.select(*keys, right_day).distinct().select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], r_day.alias("_r_day"), F.explode(reach).alias("_r_bucket")
    )
    rows = left.withColumn("_day", F.unix_date(F.col(left_day))).withColumn("_bucket", bucket(F.col("_day")))
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    near = F.abs(F.col("_day") - F.col("_r_day")) <= days
    return rows.join(dates, [*same, F.col("_bucket") == F.col("_r_bucket"), near], "left_anti").drop("_day", "_bucket")
