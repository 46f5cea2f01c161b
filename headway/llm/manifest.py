"""Merkle manifest of a dataset: a node store of Parquet levels, proofs of every row, and their verification.

1. ``ordered`` sorts leaves by (group, key) into range-partitioned files and gives each its coordinate (group, idx): the
   row's place in its file plus the group's rows in the files before. No task holds a group, however large.
2. ``climb`` writes the store level by level: ``level=k`` has a row per run of ``FANOUT`` consecutive nodes, files in
   the order of the coordinates. A level reads the one before it once; runs are a 16th of its rows. The root of a group
   is its only node at some level; roots of all groups are the leaves of a second tree of the same form.
3. ``descend`` merges the levels from the top: a run meets the run that has its parent by coordinate, and takes over
   its way to the root. What is shuffled for that is a row per run of the level above, not a proof per leaf.

Digests are lowercase hex; a node is the digest of its run's digests in order. Null groups come first, then groups by
their bytes; null keys come first within a group, and rows of equal keys stand in the order of their digests, so that
reruns agree. Null fields have a leaf encoding of their own. Repeated rows are leaves of their own. An empty table has
no leaves, no root and no proofs. Other columns of the table don't matter, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, shared_dir, written_place

FANOUT = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def joined(nodes: Column) -> Column:
    """The digests of an array of nodes, one after another."""
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def ordered(leaves: DataFrame) -> DataFrame:
    """``grp``, ``key``, ``digest`` and other columns, with ``idx``, the place in the group, and ``n``, the group's rows."""
    placed = saved(leaves.orderBy(F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), "digest"), "leaves")
    placed = placed.withColumn("at", written_place(placed))
    placed = placed.withColumn("file", F.shiftright("at", 32)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 32) - 1)))
    parts = placed.groupBy("grp", "file").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("rows").over(group.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("grp").alias("p_grp"), F.col("file").alias("p_file"), (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    both = placed.join(parts, placed["grp"].eqNullSafe(parts["p_grp"]) & (placed["file"] == parts["p_file"]))
    return both.withColumn("idx", F.col("row") + F.col("shift")).drop("at", "file", "row", "p_grp", "p_file", "shift")


@dataclass
class Tree:
    """``levels[k]``: ``grp``, ``run``, ``n`` (the group's nodes at this level) and ``nodes`` (idx, digest and, at level 0,
    the leaf's other columns as ``item``); ``roots``: ``grp`` and ``digest`` of every group."""

    levels: list[DataFrame]
    roots: DataFrame


def _runs(nodes: DataFrame) -> DataFrame:
    fields = [c for c in nodes.columns if c not in ("grp", "n", "run")]
    by_place = nodes.withColumn("run", F.floor(F.col("idx") / FANOUT)).repartitionByRange(F.col("grp").asc_nulls_first(), "run")
    return by_place.groupBy("grp", "run").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", *[c for c in fields if c != "idx"]))).alias("nodes"))


def climb(leaves: DataFrame, items: list[str]) -> Tree:
    """The node store over ``ordered`` leaves; ``items``: columns of a leaf to be kept beside its digest."""
    store = f"{shared_dir(leaves.sparkSession)}/manifest-{uuid.uuid4().hex}"

    def written(df: DataFrame, level: int) -> DataFrame:
        df.write.parquet(f"{store}/level={level}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{store}/level={level}")

    bottom = leaves.select("grp", "n", "idx", "digest", F.struct(*items).alias("item") if items else F.lit(None).cast("string").alias("item"))
    levels = [written(_runs(bottom), 0)]
    left = levels[0].agg(F.max("n")).first()[0] or 0
    while left > FANOUT:
        upper = levels[-1].where(F.col("n") > FANOUT)
        above = F.ceil(F.col("n") / FANOUT)
        nodes = upper.select("grp", above.alias("n"), F.col("run").alias("idx"), F.sha2(joined(F.col("nodes")), 256).alias("digest"))
        levels.append(written(_runs(nodes), len(levels)))
        left = -(-left // FANOUT)
    digest = F.when(F.col("n") == 1, F.col("nodes")[0]["digest"]).otherwise(F.sha2(joined(F.col("nodes")), 256))
    tops = [level.where(F.col("n") <= FANOUT).select("grp", digest.alias("digest")) for level in levels]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return Tree(levels, roots)


def _step(nodes: Column, place: Column) -> Column:
    """The siblings before and after a node of a run."""
    return F.struct(joined(F.slice(nodes, F.lit(1), place)).alias("before"), joined(F.slice(nodes, place + 2, F.lit(FANOUT))).alias("after"))


def descend(tree: Tree, above: DataFrame) -> DataFrame:
    """Per leaf: ``grp``, ``digest``, ``item`` and ``path``, its siblings (``before``, ``after``) at every level up to the
    root of the dataset. ``above``: ``grp`` and ``way``, the steps from the root of a group upward."""
    rest = above.select(F.col("grp").alias("a_grp"), "way")
    higher = None
    for level in reversed(tree.levels):
        last = level.where(F.col("n") <= FANOUT)
        here = last.join(rest, last["grp"].eqNullSafe(rest["a_grp"])).select("grp", "run", "n", "nodes", "way")
        if higher is not None:
            inner = level.where(F.col("n") > FANOUT).withColumn("up", F.floor(F.col("run") / FANOUT))
            met = inner.join(higher, inner["grp"].eqNullSafe(higher["h_grp"]) & (inner["up"] == higher["h_run"]))
            step = _step(F.col("h_nodes"), (F.col("run") % FANOUT).cast("int"))
            here = here.unionByName(met.select("grp", "run", "n", "nodes", F.concat(F.array(step), F.col("h_way")).alias("way")))
        higher = here.select(*[F.col(c).alias(f"h_{c}") for c in ("grp", "run", "n", "nodes", "way")])
    each = here.select("grp", "n", "nodes", "way", F.posexplode("nodes").alias("place", "node"))
    path = F.when(F.col("n") == 1, F.col("way")).otherwise(F.concat(F.array(_step(F.col("nodes"), F.col("place"))), F.col("way")))
    return each.select("grp", F.col("node.digest").alias("digest"), F.col("node.item").alias("item"), path.alias("path"))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of a path."""
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["before"], s["after"]))), "")


def manifest(leaves: DataFrame, items: list[str]) -> DataFrame:
    """From leaves (``grp``, ``key``, ``digest`` and ``items``): ``grp``, ``digest``, ``item``, ``subroot`` (the group's
    root), ``root`` (the dataset's) and ``path`` of every leaf."""
    tree = climb(ordered(leaves), items)
    roots = saved(tree.roots, "subroots")
    way = F.array().cast("array<struct<before:string,after:string>>")
    upper = climb(ordered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest")), ["key"])
    root = upper.roots.select("grp", F.col("digest").alias("root"))
    of_roots = descend(upper, root.select("grp", way.alias("way")))
    of_roots = of_roots.join(root, "grp").select(F.col("item.key").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("path").alias("way"))
    of_roots = saved(of_roots, "ways")
    found = descend(tree, of_roots)
    named = of_roots.select(F.col("grp").alias("r_grp"), "subroot", "root")
    return found.join(named, found["grp"].eqNullSafe(named["r_grp"])).select("grp", "digest", "item", "subroot", "root", "path")


def verified(manifest: DataFrame, now: Column) -> DataFrame:
    """Adds ``proof_sha256``, ``folded_root`` (what the digest ``now`` gives with the stored siblings) and ``verified``."""
    out = manifest.withColumn("proof_sha256", F.sha2(siblings(F.col("path")), 256)).withColumn("folded_root", folded(now, F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())
