"""Merkle manifest of a dataset: leaf digests, one root for each group, one for all, and a proof for each row.

Method (slot pivot): within its group a node has a position; its parent is
``position div fanout`` and its slot ``position mod fanout``.  One grouping by
parent with a conditional aggregate for each slot spreads a parent's children
into ``fanout`` columns.  Concatenating the columns and hashing them gives the
parent; leaving out the own slot's column gives a child's siblings, those
before it and those after it.  So a level is one aggregation, and no child is
joined with another.  The roots of the groups, in order, are the leaves of one
more tree of the same kind.

Positions come from a range partitioning of (group, order, leaf), so a group
that holds most rows is spread over many tasks; only digests and the columns
that the caller carries along take part, never the texts.  The pivot's partial
aggregation joins most children within a task before any shuffle.  Each level
is written to the shared scratch folder (a fanout-th of the level below), which
cuts the lineage; the number of levels follows from the largest group.

Defined results: groups are ordered null first, then by UTF-8 bytes; rows by
the order column, null first, ties by the leaf's digest, so that repeated rows
(which have equal digests) give the same rows whichever stands first.  A group
of one row has this row's leaf as its root, and a single group's root is the
root of all.  An empty table has no roots and no rows.  A null field counts as
``-`` and an empty text as ``0:``.  Columns that are neither fields nor carried
are not read.  Names of carried columns may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import with_global_ordinal
from ..session import scratch_path

FANOUT = 16
_PATH = "array<struct<left:string,right:string>>"


def field_text(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The digest of a row: lowercase hex sha256 of its fields' texts."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, level by level from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def _digests(slots: range) -> str:
    """SQL: the digests of these slots' columns, joined; an empty slot has none."""
    return "concat('', " + ", ".join(f"coalesce(s{j}.digest, '')" for j in slots) + ")" if len(slots) else "''"


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes (g, n, pos, node) as one row for each parent: (g, n_children, pos, n, s0.., digest).

    ``node`` is a struct that holds ``digest``; ``n`` counts the nodes of the
    group's level.  A group of one node stays as it is: its row has the node's digest.
    """
    spread = [F.expr(f"first(if(pos % {fanout} = {i}, node, null), true) AS s{i}") for i in range(fanout)]
    parents = nodes.groupBy("g", F.col("n").alias("n_children"), F.expr(f"pos div {fanout}").alias("pos")).agg(*spread)
    return parents.selectExpr("g", "n_children", "pos", f"(n_children + {fanout - 1}) div {fanout} AS n",
                              *[f"s{i}" for i in range(fanout)],
                              f"if(n_children = 1, s0.digest, sha2({_digests(range(fanout))}, 256)) AS digest")


def _children(parents: DataFrame, fanout: int, *above: str) -> DataFrame:
    """The nodes of the parents' columns: (g, pos, node, path) and the columns ``above``, which parents pass on."""
    each = ", ".join(f"struct(s{i} AS node, pos * {fanout} + {i} AS pos, {_digests(range(i))} AS left, "
                     f"{_digests(range(i + 1, fanout))} AS right)" for i in range(fanout))
    nodes = parents.selectExpr("g", "n_children", "path", *above,
                               f"explode(filter(array({each}), x -> x.node IS NOT NULL)) AS c")
    return nodes.selectExpr("g", "c.pos", "c.node", "if(n_children = 1, path, "
                            "concat(array(struct(c.left AS left, c.right AS right)), path)) AS path", *above)


class _Forest:
    """The trees of all groups, as one written table for each level."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, path: str, fanout: int):
        self.spark, self.path, self.fanout, self.levels = spark, path, fanout, 0
        more = 2
        while more > 1:
            _pivot(nodes, fanout).write.parquet(f"{path}/{self.levels}")
            level = self.level(self.levels)
            self.levels += 1
            more = level.agg(F.max("n")).first()[0] or 0            # one number: the largest group's nodes
            nodes = level.filter("n > 1").select("g", "n", "pos", F.struct("digest").alias("node"))

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{k}")

    def roots(self) -> DataFrame:
        """(g, digest) of every group."""
        out = self.level(0).filter("n = 1").select("g", "digest")
        for k in range(1, self.levels):
            out = out.unionByName(self.level(k).filter("n = 1").select("g", "digest"))
        return out

    def leaves(self, base: DataFrame) -> DataFrame:
        """Each leaf with its path of siblings; ``base`` has (g, path) and what else a group passes on to its rows."""
        passed = [c for c in base.columns if c not in ("g", "path")]
        nodes = None
        for k in reversed(range(self.levels)):
            level = self.level(k)
            parents = level.filter("n = 1").drop("digest", "n").join(base, "g")
            if nodes is not None:
                known = nodes.select("g", "pos", "path", *passed)
                parents = parents.unionByName(level.filter("n > 1").drop("digest", "n").join(known, ["g", "pos"]))
            nodes = _children(parents, self.fanout, *passed)
        return nodes


class Manifest:
    """The trees over ``rows``: ``leaf`` is a row's digest, ``carry`` the columns that proofs return."""

    def __init__(self, rows: DataFrame, leaf: Column, group: Column, order: Column, carry: dict[str, Column],
                 fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a parent has two children at least")
        spark = rows.sparkSession
        path = scratch_path(spark, "manifest")
        self.carry = list(carry)
        kept = F.struct(*[c.alias(n) for n, c in carry.items()]) if carry else F.lit(None).cast("struct<none:int>")
        # 's' before a group's name: null comes first, and the bytes' order stays
        nodes = rows.select(F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("")).alias("g"),
                            order.alias("by"), leaf.alias("digest"), kept.alias("kept"))
        nodes = with_global_ordinal(nodes.withColumn("row", F.monotonically_increasing_id()), ["by", "digest", "row"], ["g"],
                                    name="nth", with_total=True)
        nodes = nodes.select("g", F.col("nth_total").alias("n"), (F.col("nth") - 1).alias("pos"),
                             F.struct("digest", "kept").alias("node"))
        self.groups = _Forest(spark, nodes, f"{path}/rows", fanout)
        tops = with_global_ordinal(self.groups.roots(), ["g"], name="nth", with_total=True)
        tops = tops.select(F.lit("").alias("g"), F.col("nth_total").alias("n"), (F.col("nth") - 1).alias("pos"),
                           F.struct("digest", F.col("g").alias("of")).alias("node"))
        self.top = _Forest(spark, tops, f"{path}/groups", fanout)

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return self.top.roots().select(F.col("digest").alias("root"))

    def subroots(self) -> DataFrame:
        """(group, subroot, root, path): each group's root and its siblings up to the root of all."""
        base = self.top.roots().select("g", F.col("digest").alias("root"), F.lit(None).cast(_PATH).alias("path"))
        base = base.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
        top = self.top.leaves(base)
        return top.select(F.when(F.col("node.of") != "", F.substring("node.of", 2, 2 ** 31 - 1)).alias("group"),
                          F.col("node.digest").alias("subroot"), "root", "path", F.col("node.of").alias("key"))

    def proofs(self) -> DataFrame:
        """The carried columns, leaf, subroot, root and path (the siblings up to the root) of every row."""
        base = self.subroots().select(F.col("key").alias("g"), "path", "subroot", "root")
        out = self.groups.leaves(base)
        return out.select(*[F.col("node.kept")[n].alias(n) for n in self.carry], F.col("node.digest").alias("leaf"),
                          "subroot", "root", "path")


def verify(proofs: DataFrame, leaf: str) -> DataFrame:
    """``proofs`` with folded_root, which column ``leaf`` and the siblings give, and verified: whether it is the root."""
    folded = proofs.withColumn("folded_root", fold(F.col(leaf), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
