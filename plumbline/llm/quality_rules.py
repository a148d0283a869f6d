"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger keeps each rule's verdict as one bit of ``fail_bits`` next to the
measurements it was made from. Policies are versioned masks over those bits: applying another policy, or asking what a
policy would keep without one of its rules, is integer arithmetic on the ledger and never reads the texts again.

Defined results: a null or empty text has no words, so every count is 0 and ``few_words`` fails; other columns of the
input, nulls in them and repeated rows pass through row by row; an empty table gives an empty ledger. A text is
measured as a whole, however long it is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rowkeys import fresh

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")
MEASURE_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


@dataclass(frozen=True)
class Rule:
    """One rule: the bit that it sets and the condition on the measurements under which a text fails it."""

    bit: int
    name: str
    fails: str


#: A bit keeps its meaning for ever; a changed condition gets a new bit, so that old policies stay what they were.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule(4, "stutter", "10 * n_stutters > 3 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
)


def mask(*names: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


#: Version to mask. ``base`` are the two rules that any policy has.
POLICIES: Mapping[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbols"),
    "v2": mask("few_words", "repeated_windows", "symbols", "duplicate_lines", "stutter", "long_words"),
}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many positions lie in windows of ``window`` word ids that occur at least twice.

    Windows are ranked by doubling: the rank of a window of 2k words comes from the ranks of its halves, so equal
    ranks mean equal words and no hash can collide. ``window`` is a power of two.
    """
    if len(ids) <= window:
        return 0
    ranks, width = ids.astype(np.int64), 1
    while width < window:
        left, right = ranks[:-width], ranks[width:]
        _, ranks = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
        width *= 2
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    data = (text or "").encode()
    words = data.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text or "") - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids) if len(known) < len(words) else 0,
        int(np.count_nonzero(ids[1:] == ids[:-1])),
    )


def _measures(texts: pa.Array) -> pa.Array:
    columns = zip(*map(measure, texts.to_pylist()), strict=True) if len(texts) else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def failure_bits(measures: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules over the measurements in struct column ``measures``, one bit each."""
    bits = F.lit(0).cast("long")
    for r in rules:
        condition = r.fails
        for m in MEASURES:
            condition = condition.replace(m, f"{measures}.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, measures: str = "measures", bits: str = "fail_bits"
) -> DataFrame:
    """``docs`` with two more columns, of the given names: the struct of measurements and the long of failure bits.

    No shuffle; one row per row. Columns of these names in the input are replaced.
    """
    measured = docs.drop(measures, bits).withColumn(measures, F.arrow_udf(_measures, MEASURE_TYPE)(F.col(text)))
    return measured.withColumn(bits, failure_bits(measures, rules))


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes the policy of that version."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def passing(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their columns whatever those are called."""
    measures, bits = fresh("measures", docs.columns), fresh("fail_bits", docs.columns)
    return ledger(docs, text, measures=measures, bits=bits).where(passes(policy, bits)).select(*docs.columns)


def only_rule(policy: str, bits: str = "fail_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the rule that alone keeps a row out; null for a row that passes, or that several rules keep out."""
    held = F.col(bits).bitwiseAND(F.lit(POLICIES[policy]))
    return F.coalesce(*[F.when(held == 1 << r.bit, F.lit(r.name)) for r in rules if POLICIES[policy] >> r.bit & 1])


def with_ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Written ledger rows with ``only_rule``, and for that rule the rows that fail it (``only_rule_failed``) and that it
    alone keeps out (``only_rule_rows``). The ablation joined has one row per rule."""
    cut = ablation(rows, policy).select(
        F.col("rule").alias("only_rule"), F.col("failed").alias("only_rule_failed"), F.col("only_by_rule").alias("only_rule_rows")
    )
    return rows.withColumn("only_rule", only_rule(policy)).join(F.broadcast(cut), "only_rule", "left")


def ablation(rows: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only this rule keeps out.

    ``only_by_rule`` is what the policy would keep in addition if the rule were dropped. The ledger is reduced to
    one count per distinct combination of bits, at most two to the number of rules, before anything else. Rows without
    bits count for no rule; repeated rows count each; an empty ledger has no rows; other columns are not read.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]))
    counted = rows.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    used = [r for r in rules if POLICIES[policy] >> r.bit & 1]
    rule = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used])
    )
    at = counted.select("bits", "n", rule.alias("r")).select("bits", "n", "r.*")
    failed = at.bits.bitwiseAND(at.bit) != 0
    return at.groupBy("rule").agg(
        F.sum(F.when(failed, at.n).otherwise(0)).alias("failed"),
        F.sum(F.when(at.bits == at.bit, at.n).otherwise(0)).alias("only_by_rule"),
    )
