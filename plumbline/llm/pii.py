"""Personal data by candidate gradient boosting, in DataFrame functions and Spark's own trees only.

High-recall generators propose spans, which may overlap: the four base formats, written-out mail addresses, and any
longer run of digits with separators. A boosted-tree classifier scores every candidate by its format and its context;
a threshold, calibrated for a stated precision on candidates that are no base spans, selects what is redacted beyond the
base spans.

The trees are fitted on all distinct candidates (of one kind, text and context each): base spans, and other candidates
with evidence for or against them (``evidence``); candidates without evidence are scored but teach nothing. Candidates
with equal features are folded into one row with their number, which is all that the trees see of them. A group of
candidates weighs at most ``GROUP_WEIGHT`` in the trees, so that a common one doesn't drown the others. The threshold
counts every candidate with evidence beyond the base, once, by the score of trees that were fitted without it: the
candidates are dealt into ``FOLDS`` parts by the hash of their text and context, whatever rows they lie in. The trees
that judge are fitted on all parts. Numbers are given to them as steps, one truth value for each number that they may
reach, as Spark would look for the cuts of plain numbers in some of the rows only.

Patterns are written with possessive quantifiers and anchored at the starts of runs: a match takes time in proportion
to its length and no stack, however long the text. They find the same spans as the plain patterns.

Defined results: a null or empty text has no spans; repeated rows have equal results; without evidence for and
against candidates beyond the base, no span is added; an empty table gives an empty result. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rowkeys import row_key
from plumbline.scale import materialise, together

KINDS = ("email", "ip", "card", "phone", "mail_words", "digits")
BASE_KINDS = 4

#: Pattern of each kind, and a quick test without which it can't match.
PATTERNS = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    (r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
        r"(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]++)++",
        r"[(\[]at[)\]]",
    ),
    (r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[\x20().-]{0,2}[0-9])++", r"[0-9](?:[\x20().-]{0,2}[0-9]){7}"),
)
BEFORE, AFTER = 24, 12
CHUNK = 256
GROUP_WEIGHT = 6_667
FOLDS = 3
PRECISION = 0.99
#: No candidate of a lower score is added, whatever the held-out ones say.
LEAST_SCORE = 0.5
FEATURES = (
    "n_chars", "n_digits", "n_letters", "n_separators", "n_dots", "has_plus", "has_at", "n_parts", "longest_part",
    "luhn", "two_cards", "dot_words", "octets", "letter_before", "letter_after", "digit_near", "says_mail", "says_phone", "says_card",
    "says_address", "says_other",
)
#: Features that are numbers; the others are truth values. Two cards with their separators have up to 39 characters.
NUMBERS = ("n_chars", "n_digits", "n_letters", "n_separators", "n_dots", "n_parts", "longest_part")
STEPS = 40


def running_totals(numbers: Column) -> Column:
    """Sums of all first n numbers. Two levels, so that a row with very many numbers stays close to linear."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all")
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    last = F.floor((F.size(numbers) - 1) / CHUNK)
    chunks = F.when(
        F.size(numbers) > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.slice(numbers, (k * CHUNK + 1).cast("int"), CHUNK)),
    ).otherwise(F.array().cast("array<array<bigint>>"))
    inside = F.transform(chunks, lambda c: F.aggregate(c, zero, step, lambda acc: acc["all"]))
    sums = F.transform(inside, lambda c: F.element_at(c, -1))
    before = F.aggregate(sums, zero, step, lambda acc: F.concat(F.array(F.lit(0).cast("long")), acc["all"]))
    return F.flatten(
        F.zip_with(inside, F.slice(before, F.lit(1), F.size(sums)), lambda c, b: F.transform(c, lambda x: x + b))
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn test."""
    digit = F.transform(F.split(F.reverse(digits_of(value)), ""), lambda x: x.try_cast("int"))
    doubled = F.transform(digit, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def two_cards(value: Column) -> Column:
    """Whether the digits of a text are two card numbers of equal length side by side."""
    digits = digits_of(value)
    half = F.floor(F.length(digits) / 2).cast("int")
    even = F.length(digits).between(28, 38) & (F.length(digits) % 2 == 0)
    return even & luhn(F.substring(digits, F.lit(1), half)) & luhn(F.substring(digits, half + 1, half))


def octets(value: Column) -> Column:
    """Whether all dotted parts are numbers of at most 255."""
    small = lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    return F.forall(F.split(value, r"\."), small)


def valid(kind: int, value: Column) -> Column:
    """Whether a match of a base kind counts."""
    n = F.length(digits_of(value))
    return {1: octets(value), 2: n.between(14, 19) & luhn(value), 3: n.between(10, 15)}.get(kind, F.lit(True))


def propose(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``found``: all candidates as (start, kind, stop, base, value, before, after), by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_t", t)
    none = F.array().cast("array<string>")
    may = [F.col("_t").contains(test) if len(test) == 1 else F.col("_t").rlike(test) for _, test in PATTERNS]
    rows = rows.withColumns({f"_may{k}": m for k, m in enumerate(may)})
    rows = rows.withColumns(
        {
            name: F.when(F.col(f"_may{k}"), made).otherwise(none)
            for k, (pattern, _) in enumerate(PATTERNS)
            for name, made in (
                (f"_values{k}", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))),
                (f"_gaps{k}", F.split("_t", pattern, -1)),
            )
        }
    )
    widths = {
        f"_ends{k}": F.zip_with(
            F.slice(f"_gaps{k}", F.lit(1), F.size(f"_values{k}")),
            f"_values{k}",
            lambda g, v: (F.length(g) + F.length(v)).cast("long"),
        )
        for k in range(len(KINDS))
    }
    rows = rows.withColumns(widths).withColumns({f"_ends{k}": running_totals(F.col(f"_ends{k}")) for k in range(len(KINDS))})

    def spans(k: int) -> Column:
        def one(stop: Column, value: Column) -> Column:
            start = stop - F.length(value)
            base = valid(k, value) if k < BASE_KINDS else F.lit(False)
            from_ = F.greatest(start - BEFORE, F.lit(0))
            return F.struct(
                start.alias("start"), F.lit(k).alias("kind"), stop.alias("stop"), base.alias("base"), value.alias("value"),
                F.substring(F.col("_t"), (from_ + 1).cast("int"), (start - from_).cast("int")).alias("before"),
                F.substring(F.col("_t"), (stop + 1).cast("int"), F.lit(AFTER)).alias("after"),
            )

        all_of = F.zip_with(f"_ends{k}", f"_values{k}", one)
        # runs with too few digits to be anything are no candidates; base spans never are that short
        return all_of if k in (0, 4) else F.filter(all_of, lambda s: s.base | (F.length(digits_of(s.value)) >= 8))

    found = F.array_sort(F.concat(*[spans(k) for k in range(len(KINDS))]))
    return rows.select(*docs.columns, found.alias("found"))


def features(c: str) -> dict[str, Column]:
    """Format and context of the candidate in struct column ``c`` as numbers."""
    value, before, after = (F.col(f"{c}.{x}") for x in ("value", "before", "after"))
    count = lambda pattern: F.length(value) - F.length(F.regexp_replace(value, pattern, ""))
    parts = F.split(value, r"[^0-9A-Za-z]+")
    said = F.lower(before)
    made = {
        "n_chars": F.length(value),
        "n_digits": count("[0-9]"),
        "n_letters": count("[A-Za-z]"),
        "n_separators": count(r"[\x20()-]"),
        "n_dots": count(r"\."),
        "has_plus": F.startswith(value, F.lit("+")),
        "has_at": F.contains(value, F.lit("@")),
        "n_parts": F.size(parts),
        "longest_part": F.array_max(F.transform(parts, F.length)),
        "luhn": luhn(value),
        "two_cards": two_cards(value),
        "dot_words": value.rlike(r"[(\[]dot[)\]]"),
        "octets": octets(value),
        "letter_before": before.rlike(r"\p{L}$"),
        "letter_after": after.rlike(r"^\p{L}"),
        "digit_near": before.rlike(r"[0-9][^\p{L}]?$") | after.rlike(r"^[^\p{L}]?[0-9]"),
        "says_mail": said.rlike("mail|contact|write"),
        "says_phone": said.rlike("phone|tel|call|mobile|fax"),
        "says_card": said.rlike("card|visa|credit|iban|account"),
        "says_address": said.rlike(r"\bip\b|host|server|addr"),
        "says_other": said.rlike("version|order|item|isbn|page|figure|token|id$"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()}


def evidence(c: str) -> Column:
    """Label of a candidate that is no base span, by evidence apart from the base formats; null if there is none.

    For it: a written-out mail that spells its dots, ends like a domain or follows a word for mail; a number of 8 to 15
    digits behind a word for phones; two card numbers side by side. Against it: a number behind a word for orders,
    versions and the like or grown together with letters, a run of a card's length that fails the Luhn test, a dotted
    number with a part over 255, and a written-out mail that ends in digits.
    """
    value, kind, said = F.col(f"{c}.value"), F.col(f"{c}.kind"), F.lower(F.col(f"{c}.before"))
    n = F.length(digits_of(value))
    mail, number = kind == 4, kind.isin(2, 3, 5)
    phone = said.rlike(r"\b(?:tele)?(?:phone|fon|tel|call|mobile|fax)")
    other = said.rlike(r"\b(?:version|order|item|isbn|page|figure|token|invoice|serial|id\b)")
    grown = said.rlike(r"\p{L}$") | F.col(f"{c}.after").rlike(r"^\p{L}")
    spelt = value.rlike(r"[(\[]dot[)\]]") | value.rlike(r"\.[A-Za-z]{2,6}$") | said.rlike("mail|contact|write")
    odd = value.rlike(r"[0-9]$")
    positive = (mail & spelt & ~odd) | (number & ~other & ~grown & (two_cards(value) | (phone & n.between(8, 15))))
    failed = n.between(14, 19) & ~luhn(value)
    negative = (mail & odd) | (number & (other | grown | (failed & ~phone))) | ((kind == 1) & ~octets(value))
    return F.when(positive, 1.0).when(negative, 0.0)


def codes(c: str) -> Column:
    """``features`` as one array of small whole numbers, up to ``STEPS``."""
    made = features(c)
    return F.array(*[F.least(made[f], F.lit(STEPS)).cast("int") for f in FEATURES])


def vector() -> Column:
    """The column ``codes`` as a vector of truth values: a number as one for each step that it reaches."""
    steps = [STEPS if f in NUMBERS else 1 for f in FEATURES]
    reached = lambda code, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (code >= x).cast("double"))
    parts = [reached(F.get("codes", F.lit(k)), n) for k, n in enumerate(steps)]
    attributes = {"attrs": {"binary": [{"idx": k, "name": str(k)} for k in range(sum(steps))]}, "num_attrs": sum(steps)}
    return array_to_vector(F.concat(*parts)).alias("features", metadata={"ml_attr": attributes})


def labelled(candidates: DataFrame) -> DataFrame:
    """All distinct candidates of column ``c`` with a label, folded: ``grp``, ``label``, ``fold``, ``codes`` and their ``n``.

    ``grp`` is 2 for base spans, else the label.
    """
    told = F.when(F.col("c.base"), 1.0).otherwise(evidence("c"))
    same = [F.col(f"c.{x}").alias(x) for x in ("kind", "value", "before", "after")]
    known = candidates.select("c", told.alias("label")).where("label IS NOT NULL")
    known = known.select("label", F.col("c.base").alias("base"), *same).distinct()
    each = known.select(
        F.when(F.col("base"), 2.0).otherwise(F.col("label")).alias("grp"),
        "label",
        F.pmod(F.xxhash64("kind", "value", "before", "after"), F.lit(FOLDS)).alias("fold"),
        F.struct("kind", "value", "before", "after").alias("c"),
    )
    folded = each.select("grp", "label", "fold", codes("c").alias("codes"))
    return folded.groupBy(*folded.columns).agg(F.count("*").alias("n"))


def fit(rows: DataFrame, sizes: dict[tuple[float, int], int], rounds: int, depth: int):
    """Trees and the threshold for ``PRECISION``, or None without labels of both kinds beyond the base.

    ``rows`` are those of ``labelled``, and ``sizes`` their numbers by group and fold. The threshold is the lowest score,
    ``LEAST_SCORE`` at least, at which the candidates from there on have the stated precision, each scored by trees of
    the other folds; base spans stay in any case and do not count.
    """
    of = lambda groups, folds: sum(n for (g, f), n in sizes.items() if g in groups and f in folds)
    every = range(FOLDS)
    if not of([0.0], every) or not of([1.0], every):
        return None
    given = rows.select("grp", "label", "fold", "n", vector())

    def trees_of(folds):
        weights = {g: min(1.0, GROUP_WEIGHT / max(1, of([g], folds))) for g in (0.0, 1.0, 2.0)}
        weight = F.col("n") * F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("grp"))
        taught = given.where(F.col("fold").isin(*folds)).withColumn("weight", weight)
        return GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=1, weightCol="weight").fit(taught)

    def steps_of(fold: int) -> list:
        """(score, number, sum of labels) beyond the base, at most 1,001 rows."""
        others = [f for f in every if f != fold]
        asked = given.where((F.col("fold") == fold) & (F.col("grp") < 2))
        if not of([0.0, 1.0], [fold]):
            return []
        if of([0.0], others) and of([1.0, 2.0], others):
            scored = trees_of(others).transform(asked).withColumn("score", F.round(vector_to_array("probability")[1], 3))
        else:  # the others know one label, or none
            scored = asked.withColumn("score", F.lit(0.0 if of([0.0], others) else 1.0))
        return scored.groupBy("score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("p")).collect()

    *steps, trees = together(*[lambda f=f: steps_of(f) for f in every], lambda: trees_of(list(every)))
    found: dict[float, tuple[float, float]] = {}
    for r in (r for some in steps for r in some):
        n, p = found.get(r["score"], (0.0, 0.0))
        found[r["score"]] = n + r["n"], p + r["p"]
    seen = hit = 0.0
    threshold = 2.0
    for score in sorted(found, reverse=True):
        seen, hit = seen + found[score][0], hit + found[score][1]
        if hit >= PRECISION * seen and score >= LEAST_SCORE:
            threshold = score
    return trees, threshold


def find_personal_data(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 10, depth: int = 3
) -> DataFrame:
    """One row per row of ``docs``: key and ``spans``, an array of (start, kind, stop, base, score).

    Base spans always stay. Others stay if their score reaches the threshold and they overlap no base span. Only rows
    with candidates beyond the base are taken apart; the others are never shuffled.
    """
    read = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    stored = materialise(propose(read, "_text").drop("_text"), "candidates")
    is_base = F.filter("found", lambda s: s.base)

    def free(s: Column) -> Column:
        return ~F.exists(F.col("sure"), lambda b: (b.start < s.stop) & (s.start < b.stop))

    parted = stored.withColumn("sure", is_base)
    parted = parted.withColumn("unsure", F.filter(F.filter("found", lambda s: ~s.base), free)).drop("found")
    known = materialise(labelled(parted.select(F.explode(F.concat("sure", "unsure")).alias("c"))), "labelled")
    # three rows a fold at most
    sizes = {(r["grp"], r["fold"]): r["n"] for r in known.groupBy("grp", "fold").agg(F.sum("n").alias("n")).collect()}
    model = fit(known, sizes, rounds, depth)
    kept = F.transform(
        "sure", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.stop.alias("stop"), F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    )
    sure = parted.select("_key", kept.alias("sure"), "unsure")
    if model is None:
        return sure.select(F.col("_key").alias(key), F.col("sure").alias("spans"))
    trees, threshold = model
    with_any = F.size("unsure") > 0
    some = sure.where(with_any).withColumn("_row", row_key("_key", "sure", "unsure"))
    open_ = some.select("_row", F.explode("unsure").alias("c")).distinct().withColumn("codes", codes("c"))
    scored = trees.transform(open_.select("_row", "c", vector())).withColumn("score", vector_to_array("probability")[1])
    added = scored.where(F.round("score", 3) >= threshold).groupBy("_row").agg(
        F.collect_list(F.struct("c.start", "c.kind", "c.stop", "c.base", "score")).alias("added")
    )
    none = F.array().cast(sure.schema["sure"].dataType)
    judged = some.join(added, "_row", "left").select(
        "_key", F.array_sort(F.concat("sure", F.coalesce("added", none))).alias("spans")
    )
    plain = sure.where(~with_any).select("_key", F.col("sure").alias("spans"))
    return plain.unionByName(judged).withColumnRenamed("_key", key)


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.stop)), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stays."""
    names = F.array(*[F.lit(k) for k in KINDS])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s.start - acc["at"]).cast("int"))
        more = F.concat(acc["text"], gap, F.lit("["), F.get(names, s.kind), F.lit("]"))
        return F.when(s.start < acc["at"], acc).otherwise(F.struct(s.stop.alias("at"), more.alias("text")))

    whole = F.length(text)
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["text"], F.substring(text, (acc["at"] + 1).cast("int"), whole)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and texts of the spans of ``find_personal_data``."""
    count = lambda k: F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("long")
    base = F.filter("spans", lambda s: s.base)
    return found.select(
        key,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
