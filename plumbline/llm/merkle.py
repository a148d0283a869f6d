"""Merkle manifest of a table, and inclusion proofs by descent of a content-addressed DAG.

Each row is a leaf: the digest of its fields. The leaves of a group (a language) ascend by key; every eight consecutive
nodes become their parent until one is left, the group's subroot. The subroots, in the order of their groups, give the
root in the same way. Inner nodes are kept as records ``digest -> children``, each digest once, so equal subtrees are
stored once.

A proof is asked for by a leaf's place. Requests start together at the root and follow the octal digits of their ranks:
at each height the prefixes that are still asked for are joined with the records of that height, the child named by the
next digit is selected, and the children before and behind it are collected. Requests that share a prefix go down as
one row, so the upper heights are few rows and no record is read by more than eight. A path is gathered from the root
down, and reversed for use, as a proof is folded from the leaf up.

Ranks come from a range partitioning by group and key and the row counts of its partitions, so a group with most of the
rows is dealt over many tasks; repeated rows are told apart by their place in the written table. Three levels of the
tree are built per shuffle, from at most 512 digests each. Everything is DataFrame functions.

Defined results: a null field is ``-``, an empty one ``0:``; null groups are one group and come first, null keys come
first in their group; repeated rows are leaves of their own with equal digests; a lone leaf is its group's subroot, a
lone subroot the root; an empty table has no root and no proofs. Texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.scale import materialise, null_safe_join, split_join

ARITY = 8
LEVELS_AT_ONCE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of values read the same."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(size: Column) -> Column:
    """Levels above that many nodes: the number of octal digits of the last one's rank; none above a lone node."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, ARITY))).otherwise(0)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``_pos`` from 0 in the given order, written.

    ``rows`` is read from files, so that a row's number in its task is the same whenever it is read.
    """
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    here = dealt.drop("_tie").withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    written = materialise(here, "ranked")
    # one row per task
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = written.groupBy("_task").count().select("_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_from"))
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        written.join(F.broadcast(tasks), "_task").withColumn("_pos", F.col("_from") + within).drop("_task", "_row", "_from")
    )


def parents(nodes: Column) -> Column:
    """Records of an array of digests: each run of eight and its digest."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda i: F.slice(nodes, i * ARITY + 1, ARITY)
    )
    return F.transform(runs, lambda r: F.struct(F.sha2(F.array_join(r, ""), 256).alias("digest"), r.alias("children")))


def tagged(made: Column, base: int, k: int) -> Column:
    """Records of the k-th level above ``base`` in a block, with their level and place; none where the tree has ended."""
    per_block = ARITY ** (LEVELS_AT_ONCE - k)
    none = F.expr("cast(array() as array<struct<digest:string,children:array<string>>>)")

    def placed(record: Column, i: Column) -> Column:
        at = (F.col("_block") * per_block + i).alias("_pos")
        return F.struct(F.lit(base + k).alias("level"), at, record.digest.alias("digest"), record.children.alias("children"))

    return F.transform(F.coalesce(made, none), placed)


def climb(nodes: DataFrame, tallest: int) -> tuple[DataFrame, DataFrame]:
    """(records by level, the last node of each tree with its height) over ``_group, _pos, _leaf, _height``."""
    span = ARITY**LEVELS_AT_ONCE
    records, tops = [], [nodes.where("_height = 0").select("_group", "_height", F.col("_leaf").alias("_top"))]
    below = nodes.where("_height > 0").select("_group", "_height", "_pos", F.col("_leaf").alias("_node"))
    for base in range(0, tallest, LEVELS_AT_ONCE):
        blocks = below.groupBy("_group", "_height", F.floor(F.col("_pos") / span).cast("long").alias("_block")).agg(
            F.sort_array(F.collect_list(F.struct("_pos", "_node"))).alias("_nodes")
        )
        levels, column = blocks.withColumn("_l0", F.col("_nodes._node")), "_l0"
        for k in range(1, LEVELS_AT_ONCE + 1):
            made = F.when(F.col("_height") >= base + k, parents(F.col(column)))
            levels = levels.withColumn(f"_r{k}", made).withColumn(f"_l{k}", F.transform(f"_r{k}", lambda r: r.digest))
            column = f"_l{k}"
        every = F.concat(*[tagged(F.col(f"_r{k}"), base, k) for k in range(1, LEVELS_AT_ONCE + 1)])
        rows = levels.select("_group", "_height", F.inline(every))
        written = materialise(rows, "records", by=["level"])
        records.append(written)
        last = F.least(F.col("_height"), F.lit(base + LEVELS_AT_ONCE))
        ends = written.where(F.col("level") == last)
        tops.append(ends.where("level = _height").select("_group", "_height", F.col("digest").alias("_top")))
        below = ends.where("level < _height").select("_group", "_height", "_pos", F.col("digest").alias("_node"))
    all_tops = tops[0]
    for t in tops[1:]:
        all_tops = all_tops.unionByName(t)
    return _union(records), all_tops


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


@dataclass
class Manifest:
    """A table's leaves in their places, the records of both kinds of trees, and the root.

    ``leaves`` has the caller's columns and ``_group, _pos, _leaf``; ``groups`` has ``_group``, its rank ``_pos`` among
    the groups, ``_height`` and ``_subroot``. ``root`` is None for an empty table.
    """

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame | None
    group_records: DataFrame | None
    tallest: int
    group_tallest: int
    root: str | None


def build(leaves: DataFrame, group: str, key: str) -> Manifest:
    """The manifest of written rows that have their digest in ``_leaf``. Groups are ordered as bytes, null first."""
    ordered = ranked(leaves, [group, key, "_leaf"])
    firsts = ordered.groupBy(group).agg(F.min("_pos").alias("_first"), F.count("*").alias("_size"))
    sized = materialise(firsts.withColumn("_height", height(F.col("_size"))), "groups")
    tallest = sized.agg(F.max("_height")).first()[0] or 0
    # a group is named by the place of its first leaf
    placed = null_safe_join(ordered, sized, [group]).withColumns({"_group": F.col("_first"), "_pos": F.col("_pos") - F.col("_first")})
    nodes = materialise(placed.drop("_first", "_size"), "leaves")
    records, tops = climb(nodes, tallest)
    groups = materialise(ranked(materialise(tops, "tops"), ["_group"]).withColumnRenamed("_top", "_subroot"), "subroots")
    n_groups = groups.count()
    digits = len(f"{n_groups - 1:o}") if n_groups > 1 else 0
    forest = groups.select(
        F.lit(0).cast("long").alias("_group"), "_pos", F.col("_subroot").alias("_leaf"), F.lit(digits).alias("_height")
    )
    group_records, root = climb(forest, digits)
    top = root.first()
    return Manifest(
        nodes.drop("_height"), groups, records, group_records, tallest, digits, top["_top"] if top is not None else None
    )


def descend(tops: DataFrame, records: DataFrame | None, asked: DataFrame, tallest: int) -> DataFrame:
    """The rows of ``asked`` (``_group, _pos`` and more) with the path from their tree's top, root first.

    ``tops`` has ``_group, _height``, the digest ``_node`` of the last node and the path to it so far, ``_path``.
    """
    prefixes = {1: asked.select("_group", F.floor(F.col("_pos") / ARITY).cast("long").alias("_prefix")).distinct()}
    if tallest > 1:
        prefixes[1] = materialise(prefixes[1], "prefixes")
    for h in range(2, tallest):
        up = F.floor(F.col("_prefix") / ARITY).cast("long").alias("_prefix")
        prefixes[h] = prefixes[h - 1].select("_group", up).distinct()
    start = tops.withColumn("_at", F.lit(0).cast("long"))
    columns = ["_group", "_at", "_node", "_path"]
    found = asked.join(start.where("_height = 0").select("_group", "_path"), "_group")
    frontier = None
    for h in range(tallest, 0, -1):
        here = start.where(F.col("_height") == h).select(*columns)
        here = here if frontier is None else here.unionByName(frontier)
        held = records.where(F.col("level") == h).groupBy("digest").agg(F.first("children").alias("_children"))
        # equal subtrees share a digest, which may so be asked for by many
        opened = split_join(here.withColumnRenamed("_node", "digest"), held, ["digest"]).drop("digest")
        wanted = asked if h == 1 else prefixes[h - 1].withColumnRenamed("_prefix", "_pos")
        below = wanted.withColumn("_at", F.floor(F.col("_pos") / ARITY).cast("long")).join(opened, ["_group", "_at"])
        digit = (F.col("_pos") % ARITY).cast("int")
        step = F.struct(
            F.array_join(F.slice("_children", F.lit(1), digit), "").alias("before"),
            F.array_join(F.slice("_children", digit + 2, ARITY), "").alias("after"),
        )
        path = F.concat("_path", F.array(step)).alias("_path")
        if h == 1:
            found = found.unionByName(below.select(*asked.columns, path))
        else:
            node = F.element_at("_children", digit + 1).alias("_node")
            frontier = below.select("_group", F.col("_pos").alias("_at"), node, path)
    return found


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The requested leaves (rows of ``manifest.leaves``; None: all) with ``_subroot`` and ``_path``, leaf first.

    A step of the path is the digests before and behind the node in its run, as concatenated text.
    """
    asked = manifest.leaves if requests is None else requests
    root = F.lit(manifest.root).cast("string")
    empty = F.expr(f"cast(array() as array<{STEP}>)")
    spark = asked.sparkSession
    top = spark.range(1).select(
        F.lit(0).cast("long").alias("_group"), F.lit(manifest.group_tallest).alias("_height"), root.alias("_node"), empty.alias("_path")
    )
    wanted = manifest.groups.select(
        F.lit(0).cast("long").alias("_group"), "_pos", F.col("_group").alias("_tree"), "_height", "_subroot"
    )
    to_groups = descend(top, manifest.group_records, wanted.withColumnRenamed("_height", "_levels"), manifest.group_tallest)
    tops = materialise(
        to_groups.select(F.col("_tree").alias("_group"), F.col("_levels").alias("_height"), F.col("_subroot").alias("_node"), "_path"),
        "paths",
    )
    found = descend(tops, manifest.records, asked, manifest.tallest)
    named = found.join(tops.select("_group", F.col("_node").alias("_subroot")), "_group")
    return named.withColumn("_path", F.reverse("_path"))


def siblings(path: Column) -> Column:
    """All collected digests of a path, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give. A level at which the node was alone has no step."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s.before, node, s.after), 256))


def leaves_of(rows: DataFrame, fields: Sequence[str] = FIELDS, keep: Sequence[str] = (), **digests: Column) -> DataFrame:
    """``keep`` columns, ``_leaf`` and further digests of each row, written, so that texts are read once."""
    own = leaf([F.col(f) for f in fields]).alias("_leaf")
    return materialise(rows.select(*keep, own, *[c.alias(n) for n, c in digests.items()]), "digests")


def tampered(fields: Sequence[str] = FIELDS, key: str = "doc_id", text: str = "text") -> Column:
    """The digest of a row after the contract's tampering: where 3 divides the checksum of the key, A-Z are lower-cased."""
    chosen = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    # the short way gives the same for plain ASCII
    low = F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    changed = leaf([F.coalesce(low, F.lower(f)) if f == text else F.col(f) for f in fields])
    return F.when(chosen, changed).otherwise(leaf([F.col(f) for f in fields]))


def digest(found: DataFrame, root: str | None, key: str = "doc_id", presented: str = "_presented") -> DataFrame:
    """Proof checks: ``presented`` is the digest of the row that is held against the proof."""
    folded = found.withColumn("_folded", fold(F.col(presented), F.col("_path")))
    top = F.lit(root).cast("string")
    return folded.select(
        key,
        F.col("_leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        top.alias("root"),
        F.sha2(siblings(F.col("_path")), 256).alias("proof_sha256"),
        F.col("_folded").alias("folded_root"),
        (F.col("_folded") == top).alias("verified"),
    )
