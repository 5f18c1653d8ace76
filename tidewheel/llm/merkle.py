"""A Merkle manifest of a table, with stored checkpoints of levels and proofs from recomputed nodes.

Leaves are digests of rows, made by Spark's sha2. The leaves of a group stand in order of id; every ``FANOUT`` consecutive
nodes become one, level by level, up to the group's root; the groups' roots, in order of group, become the table's. Only
every ``STEP``-th level is stored. A stored node covers an aligned subtree of at most ``FANOUT ** STEP`` nodes of the stored
level below; building it and extracting proofs gather just that subtree in a task: the levels between are computed again,
their siblings emitted, and the nodes dropped. Proofs go down from the root: the siblings above a stored node are joined to its
subtree once, not to each leaf.

Positions come from one range sort over (group, id, leaf, salt) whose partitions are counted, so a group of most rows is in many
tasks. Nothing that grows with the table comes to the driver.

Defined results: a null field is ``-``; null ids come first in their group and are not tampered with; rows of the same id are in
order of their leaves; repeated rows are leaves of their own; a null group is a group and comes first; a lone leaf is its group's root, and a lone
group's root the table's; an empty table gives no rows. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workers import ship
from .shared import materialise

FANOUT, STEP = 8, 3
#: What a leaf is made of, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """sha256 of the fields, each as its UTF-8 byte count, a colon and its text, or ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def tampered(doc_id: Column, every: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(docs: DataFrame, tamper: int = 3) -> DataFrame:
    """(grp, id, leaf, other): a leaf for each row, and the one of the row as somebody may have changed it (A-Z of the text lower-cased)."""
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(tampered(F.col("doc_id"), tamper), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), leaf_of(fields).alias("leaf"), leaf_of([*fields[:-1], changed]).alias("other"))


def height(n: int) -> int:
    """Levels above the leaves of a tree of n of them."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _height(n: Column) -> Column:
    """The same as an expression: how many powers of FANOUT are below n."""
    most = math.ceil(63 / math.log2(FANOUT))
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(1, most)), F.when(n > 1, 1).otherwise(0)).cast("int")


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, from 0 within grp in ``order``, and h, the height of the tree of the group; sorted by ranges of all rows.

    A random salt from the written row numbers spreads equal rows over ranges. Partition and place are written with the rows, so they are fixed.
    """
    spark = rows.sparkSession
    salted = materialise(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    keys = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.xxhash64("salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("m", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.shiftright("m", 33)).drop("salt"), "placed")
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("first"))  # a row for a group and partition
    group = Window.partitionBy("grp")
    lower = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("grp").alias("g"), _height(F.sum("k").over(group)).alias("h"), "part", "first", F.coalesce(F.sum("k").over(lower), F.lit(0)).alias("before"))
    on = placed["grp"].eqNullSafe(starts["g"]) & (placed["part"] == starts["part"])
    pos = (placed["m"] - starts["first"] + starts["before"]).alias("pos")
    return placed.join(starts, on).select("grp", *[placed[c] for c in rows.columns if c != "grp"], pos, "h")


def levels_of(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them, at most ``levels``, of one aligned subtree."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest(*last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def siblings(levels: list[list[str]], i: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of node i, and of the nodes above it, within their runs."""
    for nodes in levels:
        s = i // FANOUT * FANOUT
        yield "".join(nodes[s:i]), "".join(nodes[i + 1 : s + FANOUT])
        i //= FANOUT


def _raised(step: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["pos", "digest", "h"]).to_pylist(), key=lambda r: r["pos"])
        h = rows[0]["h"]
        top = levels_of([r["digest"] for r in rows], min(step, h))[-1]
        return pa.table({"grp": table["grp"].slice(0, 1), "pos": pa.array([rows[0]["pos"] // FANOUT**step], pa.int64()), "digest": pa.array([top[0]]), "h": pa.array([max(h - step, 0)], pa.int32())})

    return run


_NODE = "grp string, pos long, digest string, h int"


@dataclass
class Tree:
    """Stored levels of all groups' trees: level k holds the nodes ``step * k`` levels above the leaves; tops are (grp, digest)."""

    stored: list[DataFrame]
    tops: DataFrame
    step: int


def build(nodes: DataFrame, step: int = STEP) -> Tree:
    """The stored levels above ``nodes`` (grp, pos, digest, h): each is made from the last and written."""
    ship(nodes.sparkSession)
    stored, tops = [nodes], []
    while True:
        tops.append(stored[-1].filter("h = 0").select("grp", "digest"))
        rest = stored[-1].filter("h > 0")
        if not rest.limit(1).count():
            break
        block = F.floor(F.col("pos") / FANOUT**step)
        stored.append(materialise(rest.groupBy("grp", block.alias("block")).applyInArrow(_raised(step), _NODE), "checkpoint"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return Tree(stored, materialise(top, "tops"), step)


def _lowered(step: int):
    """Proofs of the nodes of one subtree: their siblings up to its top, then those above it, which the row of role 0 brings."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("role", "ascending"), ("pos", "ascending")]).to_pylist()
        above, rows = rows[0]["proof"], rows[1:]
        levels = levels_of([r["digest"] for r in rows], min(step, rows[0]["h"]))[:-1]
        proofs = [",".join([*[f"{a}.{b}" for a, b in siblings(levels, i)], *([above] if above else [])]) for i in range(len(rows))]
        n = len(rows)
        keep = ["pos", "digest", "h", "id", "other"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        return pa.table({"grp": pa.array([rows[0]["grp"]] * n, pa.string()), **{c: pa.array([r[c] for r in rows], k) for c, k in zip(keep, kinds, strict=True)}, "proof": pa.array(proofs)})

    return run


_PROVED = "grp string, pos long, digest string, h int, id long, other string, proof string"


def prove(tree: Tree, tops: DataFrame) -> DataFrame:
    """Proofs of all nodes of the lowest stored level, given those of the trees' tops (grp, proof).

    A proof is a text: levels upwards, separated by commas, each the siblings left, a point, and those right.
    """
    proved = None
    for k in range(len(tree.stored) - 1, -1, -1):
        nodes = tree.stored[k]
        nodes = nodes.select(*[F.col(c) if c in nodes.columns else F.lit(None).cast(t).alias(c) for c, t in (("grp", "string"), ("pos", "long"), ("digest", "string"), ("h", "int"), ("id", "long"), ("other", "string"))])
        ends = nodes.filter("h = 0").join(tops.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).select("grp", "pos", "digest", "h", "id", "other", "proof")
        if proved is not None:
            parents = proved.select("grp", F.col("pos").alias("block"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("h", "int"), ("id", "long"), ("other", "string"))], "proof")
            below = nodes.filter("h > 0").select("grp", F.floor(F.col("pos") / FANOUT**tree.step).alias("block"), F.lit(1).alias("role"), "pos", "digest", "h", "id", "other", F.lit(None).cast("string").alias("proof"))
            ends = ends.unionByName(parents.unionByName(below).groupBy("grp", "block").applyInArrow(_lowered(tree.step), _PROVED))
        proved = ends if k == 0 else materialise(ends, "proofs")
    return proved


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its siblings give."""
    for level in proof.split(",") if proof else []:
        left, right = level.split(".")
        leaf = digest(left, leaf, right)
    return leaf


def _verify(batches):
    """Folds each row's other leaf by its proof, and hashes the siblings of the proof."""
    for batch in batches:
        proofs, others = batch.column("proof").to_pylist(), batch.column("other").to_pylist()
        hashes = [digest(p.replace(",", "").replace(".", "")) for p in proofs]
        folded = [fold(o, p) for o, p in zip(others, proofs, strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("grp", "id", "pos", "digest", "proof")], pa.array(hashes, pa.string()), pa.array(folded, pa.string())], names=["grp", "id", "pos", "leaf", "proof", "proof_sha256", "folded_root"])


@dataclass
class Manifest:
    """The trees of the groups, the tree of their roots, and the root: one row (root), none for an empty table."""

    groups: Tree
    above: Tree

    @property
    def root(self) -> DataFrame:
        return self.above.tops.select(F.col("digest").alias("root"))


def manifest(leaves_: DataFrame, step: int = STEP) -> Manifest:
    """The stored levels, ``step`` apart, for ``leaves_`` (grp, id, leaf, other)."""
    nodes = materialise(positioned(leaves_, ["id", "leaf"]).withColumnRenamed("leaf", "digest"), "level")
    groups = build(nodes, step)
    named = groups.tops.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), "digest")
    return Manifest(groups, build(materialise(positioned(named, ["name"]), "level"), step))


def proofs(m: Manifest) -> DataFrame:
    """(grp, id, pos, leaf, proof, proof_sha256, folded_root, subroot) of every leaf; folded_root comes from its other leaf."""
    spark = m.above.tops.sparkSession
    top = spark.createDataFrame([(None, "")], "grp string, proof string")
    # the tree above has one group, whose leaves are named by the groups below
    upper = prove(m.above, top).select("pos", "proof")
    named = m.above.stored[0].select("pos", F.col("name").alias("grp"), F.col("digest").alias("subroot"))
    tops = materialise(named.join(upper, "pos").select("grp", "proof", "subroot"), "tops")
    proved = prove(m.groups, tops.select("grp", "proof"))
    checked = proved.mapInArrow(_verify, "grp string, id long, pos long, leaf string, proof string, proof_sha256 string, folded_root string")
    sub = tops.select(F.col("grp").alias("g"), "subroot")
    return checked.join(sub, F.col("grp").eqNullSafe(F.col("g"))).drop("g")


def verified(docs: DataFrame, tamper: int = 3, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, some of whose texts were changed after the manifest."""
    m = manifest(leaves(docs, tamper), step)
    out = proofs(m).crossJoin(F.broadcast(m.root))  # one row
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
