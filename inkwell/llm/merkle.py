"""Operator 11: a Merkle manifest of a dataset by lag and lead windows.

Each row is a leaf: the hash of its columns.  Per lang the leaves ascend by
doc_id, and every FAN consecutive nodes become their hash until one is left,
the subroot; the subroots, by lang, become the root in the same way.

Positions within a lang come from ranges of (lang, doc_id) (see ordered), so a
lang that holds most rows spreads over tasks.  A pass then climbs LEVELS levels
at once: rows are dealt out by blocks of FAN**LEVELS positions, and within a
block the node of level l stands at the rows whose position divides by FAN**l.
There, lag and lead columns at the fixed offsets 1 to FAN-1 times FAN**l are
its siblings, masked by its slot (what lies before or after its run) and by
the length of the level (what lies beyond the last node); the row of the first
child hashes the parent.  All levels of a pass share one shuffle and one sort.
The next pass has one row a block.

On the way back each block's siblings above it are joined to its rows, so
every leaf gets its proof: per level the siblings on its left and right, from
its own run up to the root.  Folding the proof over a leaf made again from the
data gives the root if nothing has changed.

Defined results: a null column hashes as `-`; rows of a lang with equal doc_id
are ordered by their leaves; rows without a doc_id come first in their lang,
and rows without a lang are a lang of their own, the first; a lang of one row
is its own subroot; a dataset of one lang has its subroot as root; a leaf
without siblings anywhere has the hash of nothing as proof; a row without a
doc_id is never tampered with; an empty table gives an empty result; columns
that are not hashed are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.durable import durable
from inkwell.llm.ordered import numbered

FAN = 8
LEVELS = 3
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<l:string,r:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_hash(columns: dict[str, Column] | None = None) -> Column:
    """The hash of a row; columns replaces some of the hashed columns."""
    return _hash(*(_field((columns or {}).get(c, F.col(c))) for c in HASHED))


def tampered_text() -> Column:
    """The text of a copy of the dataset in which a third of the rows were changed."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def _glued(parts: list[Column]) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def _climb_block(rows: DataFrame) -> DataFrame:
    """rows (key, position, n, node, ...) after one pass: node is that of the block, in the row of its first leaf; steps are added."""
    around = Window.partitionBy("key", "block").orderBy("position")
    so_far = around.rowsBetween(Window.unboundedPreceding, 0)
    out, steps = rows.withColumn("block", F.floor(F.col("position") / FAN**LEVELS)), []
    for level in range(LEVELS):
        width = FAN**level
        at = F.floor(F.col("position") / width)  # the node's number on this level
        length = F.ceil(F.col("n") / width)  # how many nodes the level has
        slot = at % FAN
        own = F.col("position") % width == 0
        left = [F.when(slot >= j, F.lag("node", j * width).over(around)) for j in range(FAN - 1, 0, -1)]
        right = [F.when((slot + j < FAN) & (at + j < length), F.lead("node", j * width).over(around)) for j in range(1, FAN)]
        out = out.withColumns({f"l{level}": F.when(own, _glued(left)), f"r{level}": F.when(own, _glued(right))})
        sides = [F.last(f"{side}{level}", ignorenulls=True).over(so_far) if level else F.col(f"{side}0") for side in "lr"]
        out = out.withColumns({f"sl{level}": sides[0], f"sr{level}": sides[1]})
        parent = F.when(length > 1, _hash(F.col("node"), F.col(f"r{level}"))).otherwise(F.col("node"))
        out = out.withColumn("node", F.when(own & (slot == 0), parent))
        steps.append(F.when(length > 1, F.array(F.struct(F.col(f"sl{level}").alias("l"), F.col(f"sr{level}").alias("r")))).otherwise(F.array().cast(_STEPS)))
    return out.withColumn("steps", F.concat(*steps)).drop(*(f"{x}{level}" for x in ("l", "r", "sl", "sr") for level in range(LEVELS)))


def _climb(rows: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with steps, subroot and root; finish gives these three for the last node of each key."""
    most = rows.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return rows.drop("node").join(finish(rows.select("key", "node")), "key")
    climbed = _climb_block(rows)
    width = FAN**LEVELS
    blocks = durable(climbed.where(F.col("position") % width == 0).select("key", F.col("block").alias("position"), F.ceil(F.col("n") / width).alias("n"), "node"))
    above = _climb(blocks, finish).select("key", F.col("position").alias("block"), F.col("steps").alias("more"), "subroot", "root")
    return climbed.join(above, ["key", "block"]).withColumn("steps", F.concat("steps", "more")).drop("block", "more", "node")


def _over_keys(subroots: DataFrame) -> DataFrame:
    """key, subroot, steps, root of the tree over the subroots, a row each."""
    top = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "node", F.col("node").alias("own")), "key", ["lang_key"])
    ended = lambda last: last.select("key", F.array().cast(_STEPS).alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    return _climb(top, ended).select(F.col("lang_key").alias("key"), F.col("own").alias("subroot"), "steps", "root")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (the leaf of the changed copy), steps (the proof), subroot, root."""
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))  # never null; null comes first
    leaves = docs.select("doc_id", key.alias("key"), leaf_hash().alias("leaf"), leaf_hash({"text": tampered_text()}).alias("tampered"))
    placed = numbered(leaves.withColumn("node", F.col("leaf")), "key", ["doc_id", "leaf"])
    return _climb(placed, _over_keys).select("doc_id", "leaf", "tampered", "steps", "subroot", "root")


def proof_hash(steps: str = "steps") -> Column:
    return _hash(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def folded(leaf: str, steps: str = "steps") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, F.col(leaf), lambda node, s: _hash(s["l"], node, s["r"]))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the changed copy), verified."""
    told = manifest(docs).withColumn("folded_root", folded("tampered"))
    return told.select("doc_id", "leaf", "subroot", "root", proof_hash().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
