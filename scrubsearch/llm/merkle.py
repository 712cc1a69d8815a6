"""Operator 12: Merkle manifest of a dataset by nested-interval labels.

Each row is a leaf; within its group (``source``) leaves are ranked by id. A
node is labelled with its level and the interval [lo, hi) of leaf ranks that it
covers; a node of level L covers one bucket of FANOUT ** L ranks. So:

* the ancestor of a node at level L is the node of that level in bucket
  lo // FANOUT ** L whose interval contains the node's: an equi-join on
  (group, bucket) with a containment test, one per level;
* the siblings of a node are its parent's interval without the node's own: the
  children that end before it and those that begin after it.

A node's proof is the list of (digests left, digests right) from its own level
up. Only nodes of the first level (a sixteenth of the leaves) are joined with
their ancestors; a leaf joins its first-level node. The roots of the groups are
leaves of a second tree, built the same way. Every group of rows that meets in
a task is a bucket of at most FANOUT children, however large a source is; ranks
come from a range partitioning, and texts are hashed where they are read and
never shuffled.

Leaf: sha256 of doc_id, source, lang, n_chars and text, each ``-`` if null, else
its UTF-8 byte count, ``:`` and the value. Inner node: sha256 of its children's
hex digests. All digests are lowercase hex.

Rows are told apart by all of their values: rows with equal ids are ordered by
their digest, null ids come first; equal rows are equal leaves side by side. A
null source is a group of its own, before all others. A source of one row has
that leaf as its root. An empty table has no leaves and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import cut, global_rank, lookup

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"  # of the steps from a node up: digests left and right of it
CHILDREN = "array<struct<lo:long,hi:long,digest:string>>"
MAX_BROADCAST_GROUPS = 2000


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each ``-`` if null, else byte count, ``:``, value."""
    def put(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(put, fields)), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z alone in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_tampered(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of the decimal id; a null id is never tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and seen_leaf (the leaf after tampering) of every row."""
    cols = {c: F.col(c) for c in FIELDS}
    seen = {**cols, "text": F.when(is_tampered(F.col("doc_id")), lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       leaf_digest(list(cols.values())).alias("leaf"), leaf_digest(list(seen.values())).alias("seen_leaf"))


@dataclass
class Tree:
    """``nodes``: (grp, bucket, lo, hi, children, proof), one for each run of up to FANOUT leaves of a group, with
    the proof from there up; ``roots``: (grp, root)."""
    nodes: DataFrame
    roots: DataFrame


def bucket(rank: Column, level: int) -> Column:
    return F.floor(rank / F.lit(FANOUT ** level)).cast("long")


def build_tree(leaves: DataFrame, most: int) -> Tree:
    """The trees over (grp, rank, n_leaves, digest), one for each group of n_leaves rows.

    ``most`` is the largest n_leaves. Level by level, FANOUT neighbours become
    one node until a group has one node left; then every first-level node gets
    its proof from its ancestors. A group of one leaf is its own root; its node
    has no children and an empty proof.
    """
    below = leaves.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "n_leaves")
    lone = below.where("n_leaves = 1").select("grp", F.lit(0).cast("long").alias("bucket"), "lo", "hi", "n_leaves",
                                              F.array().cast(CHILDREN).alias("children"), "digest")
    roots = lone.select("grp", F.col("digest").alias("root"))
    levels: list[DataFrame] = []
    while FANOUT ** len(levels) < most:
        level = len(levels) + 1
        nodes = (below.where(F.col("n_leaves") > FANOUT ** (level - 1))
                 .groupBy("grp", bucket(F.col("lo"), level).alias("bucket"))
                 .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n_leaves").alias("n_leaves"),
                      F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
                 .withColumn("digest", F.sha2(F.array_join(F.col("children.digest"), ""), 256)))
        below = cut(nodes)
        levels.append(below)
        roots = roots.unionByName(below.where(F.col("n_leaves") <= FANOUT ** level)
                                  .select("grp", F.col("digest").alias("root")))
    first = levels[0].unionByName(lone) if levels else lone
    nodes = first.drop("digest", "n_leaves").withColumn("proof", F.array().cast(PROOF))
    for level, table in enumerate(levels[1:], 2):
        nodes = attach(nodes, table, level)
    return Tree(nodes, roots)


def siblings(children: Column, lo: Column, hi: Column) -> Column:
    """The digests of a parent's children outside [lo, hi): those before it and those after it."""
    before = F.filter(children, lambda c: c["hi"] <= lo)
    after = F.filter(children, lambda c: c["lo"] >= hi)
    return F.struct(F.array_join(before["digest"], "").alias("before"), F.array_join(after["digest"], "").alias("after"))


def contained(inner: DataFrame, lo: str, hi: str, level: int, ancestors: DataFrame, *carry: str) -> DataFrame:
    """Left containment join: each row's ancestor at ``level``, its ``carry`` columns as ``_up_<name>``.

    The bucket of the level makes it an equi-join; the intervals are compared too."""
    up = ancestors.select(*[F.col(c).alias(f"_up_{c}") for c in ("grp", "bucket", "lo", "hi", *carry)])
    on = ((F.col("grp") == F.col("_up_grp")) & (bucket(F.col(lo), level) == F.col("_up_bucket"))
          & (F.col("_up_lo") <= F.col(lo)) & (F.col(hi) <= F.col("_up_hi")))
    return inner.join(up, on, "left")


def attach(nodes: DataFrame, ancestors: DataFrame, level: int) -> DataFrame:
    """``nodes`` with the step below each one's ancestor at ``level`` added to its proof.

    The child on the way is the node's own ancestor one level lower, known by
    its interval; the ancestor's other children are the siblings of the step. A
    group that ended at a lower level has no ancestor here and keeps its proof."""
    keep = nodes.columns
    joined = contained(nodes, "lo", "hi", level, ancestors, "children")
    width = FANOUT ** (level - 1)
    way = bucket(F.col("lo"), level - 1) * F.lit(width)
    step = siblings(F.col("_up_children"), way, way + F.lit(width))
    proof = F.when(F.col("_up_grp").isNull(), F.col("proof")).otherwise(F.concat("proof", F.array(step).cast(PROOF)))
    return joined.withColumn("proof", proof).select(*keep)


def leaf_proofs(leaves: DataFrame, nodes: DataFrame, *carry: str) -> DataFrame:
    """``leaves`` (grp, rank, ...) with each one's proof, and its node's ``carry`` columns."""
    keep = leaves.columns
    joined = contained(leaves.withColumn("_next", F.col("rank") + 1), "rank", "_next", 1, nodes,
                       "children", "proof", *carry)
    step = siblings(F.col("_up_children"), F.col("rank"), F.col("_next"))
    proof = F.when(F.size("_up_children") == 0, F.col("_up_proof")).otherwise(
        F.concat(F.array(step).cast(PROOF), F.col("_up_proof")))
    return joined.withColumn("proof", proof).select(*keep, "proof", *[F.col(f"_up_{c}").alias(c) for c in carry])


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """The manifest and its proofs, one row per input row.

    doc_id, leaf, subroot, root, proof_sha256 of the rows as they are;
    folded_root from the leaf seen after tampering and the original siblings;
    verified: folded_root is the root. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")  # null is a group too
    rows = global_rank(manifest_leaves(docs), ["source", "doc_id", "leaf"], "at")
    sizes = cut(rows.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_leaves")))
    groups = cut(global_rank(sizes, ["source"], "grp").select(key, "grp", "first", "n_leaves"))
    most, n_groups = groups.agg(F.max("n_leaves"), F.count(F.lit(1))).first()
    if not n_groups:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, "
                                         "proof_sha256 string, folded_root string, verified boolean")
    leaves = cut(lookup(rows.select("*", key), groups, "key")
                 .select("doc_id", "leaf", "seen_leaf", "grp", (F.col("at") - F.col("first")).alias("rank"), "n_leaves"))
    tree = build_tree(leaves.withColumn("digest", F.col("leaf")), most)

    # the groups' roots are the leaves of one more tree
    tops = cut(tree.roots.select(F.col("grp").alias("rank"), F.col("root").alias("digest"),
                                 F.lit(0).cast("long").alias("grp"), F.lit(n_groups).cast("long").alias("n_leaves")))
    above = build_tree(tops, n_groups)
    root = above.roots.first()["root"]
    crown = cut(leaf_proofs(tops, above.nodes).select(
        F.col("rank").alias("grp"), F.col("digest").alias("subroot"), F.col("proof").alias("crown")))
    # a crown has some kB: few are broadcast, and to nodes, a sixteenth of the rows
    nodes = (lookup(tree.nodes, crown, "grp", MAX_BROADCAST_GROUPS)
             .withColumn("proof", F.concat("proof", "crown")).drop("crown"))

    out = leaf_proofs(leaves, nodes, "subroot")
    steps = F.transform("proof", lambda s: F.concat(s["before"], s["after"]))
    out = out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"),
                     F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"),
                     fold(F.col("proof"), F.col("seen_leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
