"""Column expressions used by the cleansing jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.constants import CHARACTERISTIC_LABELS, RULES_OTHER, RULES_PRODUCT


def tidy(df: DataFrame, trimmed: Sequence[str] = (), upper: Sequence[str] = ()) -> DataFrame:
    """Trim text columns; those in ``upper`` are also put in upper case."""
    changes = {c: F.trim(F.col(c)) for c in trimmed}
    changes.update({c: F.upper(F.trim(F.col(c))) for c in upper})
    return df.withColumns(changes) if changes else df


def require(df: DataFrame, present: Sequence[str] = (), non_empty: Sequence[str] = ()) -> DataFrame:
    """Keep the rows whose key columns are set, and whose text columns hold some text."""
    for c in present:
        df = df.filter(F.col(c).isNotNull())
    for c in non_empty:
        df = df.filter(F.col(c) != "")
    return df


def first_missing(checks: Sequence[tuple[str, str]], valid: str = "VALID") -> Column:
    """Label of the first column in the list that is null, else ``valid``."""
    labels = [F.when(F.col(c).isNull(), F.lit(label)) for c, label in checks]
    return F.coalesce(*labels, F.lit(valid))


def millis_to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def days_to_date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def date_and_millis(day: Column, ms_of_day: Column) -> Column:
    """Instant from a date and the milliseconds since that date's midnight."""
    return F.timestamp_millis(F.unix_date(day).cast("long") * F.lit(86_400_000) + ms_of_day.cast("long"))


def day_key(day: Column) -> Column:
    """Eight-digit text of a date, null for a null date."""
    return F.replace(day.cast("date").cast("string"), F.lit("-"), F.lit(""))


def as_date(df: DataFrame, column: str) -> Column:
    """Date from a column that holds epoch days in some feeds and text or a date in others."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return days_to_date(F.col(column))
    if isinstance(kind, T.StringType):
        return F.try_to_date(F.col(column))
    return F.col(column).cast("date")


def characteristic_type(label: Column) -> Column:
    mapped = [F.when(label == k, F.lit(v)) for k, v in CHARACTERISTIC_LABELS.items()]
    return F.coalesce(*mapped, label)


def applicable_rules(char_type: Column) -> Column:
    return F.when(char_type == "product", F.lit(RULES_PRODUCT)).otherwise(F.lit(RULES_OTHER))


def safe_identifier(name: Column) -> Column:
    """Lower case with every run of other characters turned into one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def list_items(csv: Column) -> Column:
    """Non-empty trimmed items of a comma-separated text."""
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def longest_token(text: Column) -> Column:
    """The longest run of letters, digits and underscores, the first of equals; null without one."""
    tokens = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    longest = F.aggregate(tokens, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    return F.nullif(longest, F.lit(""))


def last_parts(name: Column, n: int = 2) -> Column:
    """The last ``n`` dotted parts of a name; the whole name if it has fewer."""
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")


def urn_parts(urn: Column) -> Column:
    """Platform, namespace and table of a dataset's URN, ``urn:..:(urn:..:<platform>,<namespace>.<table>,<stage>)``; null
    where the text has no such form."""
    shape = r"^urn:[^()]*:\(urn:[^(),]*:([^(),:]+),([^(),]+),[^(),]*\)$"
    path = F.regexp_extract(urn, shape, 2)
    made = F.struct(
        F.regexp_extract(urn, shape, 1).alias("platform"),
        F.regexp_extract(path, r"^(.*)\.[^.]*$", 1).alias("namespace"),
        F.regexp_extract(path, r"([^.]*)$", 1).alias("table"),
    )
    return F.when(urn.rlike(shape), made)


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over columns in which a null differs from every value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def sha_upper(value: Column) -> Column:
    return F.upper(F.sha2(value.cast("string"), 256))
