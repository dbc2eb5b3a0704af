"""Operator 12: exact duplicates by a tree merge of sorted digest runs.

Texts are equal if they are identical after lower-casing A-Z only.

1. Every partition of the table makes a run: its distinct digests in order,
   each with the best identifier and the number of rows behind it.  A digest
   is 64 bits; the SHA-256 and the length of the text stand beside it, and
   rows are taken for equal only if all three are (so rows of one digest that
   differ otherwise stay apart at every level).
2. In round r the runs whose numbers agree above their r * BITS lowest bits
   meet (the partners of a binomial exchange, 2**BITS at once).  A task gets
   the rows of a few digests from all of them, merges equal ones and keeps the
   best identifier; the merged run is written in order of its digests.  A
   digest that a third of all rows have is one row of every run, so no task of
   any round sees more of it than 2**BITS rows a merged run.
3. The last run knows every digest once.  Its answer goes down the same tree:
   runs ask the run they were merged into, rows ask the run of their own
   partition.  So rows of one digest are answered partition by partition.

Every round is a table in the shared folder, about 60 bytes a digest; a text
is read once and never leaves its task.

Defined results: a null text counts as empty; of equal texts the row with the
largest (or smallest) doc_id stays, of rows that repeat this id one stays, and
a row without an id stays only where no equal one has an id; keep_id is the id
of the row that stays; an empty table gives an empty result; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkwell.llm.columns import aside, back
from inkwell.llm.durable import durable

#: A round merges 2**BITS runs into one.
BITS = 3
SAME = ("digest", "check", "size")
OWN = ("keep_id", "group_size", "kept", "text_sha256")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def _order(number: Column, largest: bool) -> Column:
    """A number whose largest value belongs to the row that stays; turning bits reverses the order of all long values."""
    return number if largest else F.bitwise_not(number)


def _digests(docs: DataFrame, largest: bool) -> DataFrame:
    """docs with its row's run, digest, check, size, and `best`: its claim to stay."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column; give other ids a number first")
    row = F.monotonically_increasing_id()
    sized = docs.withColumn("norm", normalised()).withColumns({"digest": F.xxhash64("norm"), "check": F.unhex(F.sha2("norm", 256)), "size": F.octet_length("norm")})
    claim = F.struct(_order(F.col("doc_id").cast("long"), largest).alias("id"), _order(F.col("row"), largest).alias("row"))
    return sized.withColumn("row", row).withColumn("run", F.shiftright("row", 33)).withColumn("best", claim)


def _first_runs(rows: DataFrame) -> DataFrame:
    return _in_order(rows.groupBy("run", *SAME).agg(F.max("best").alias("best"), F.count("*").alias("n")))


def _merged(runs: DataFrame) -> DataFrame:
    """One round: 2**BITS neighbouring runs become one."""
    met = runs.withColumn("run", F.shiftright("run", BITS))
    return _in_order(met.groupBy("run", *SAME).agg(F.max("best").alias("best"), F.sum("n").alias("n")))


def _in_order(runs: DataFrame) -> DataFrame:
    return durable(runs.sortWithinPartitions("run", *SAME))


def rounds(rows: DataFrame) -> Iterator[DataFrame]:
    """The runs of every level, those of the partitions first; the last level has one run."""
    level = _first_runs(rows)
    left = level.agg(F.max("run")).first()[0] or 0
    yield level
    while left:
        level, left = _merged(level), left >> BITS
        yield level


def _asked(below: DataFrame, answers: DataFrame, shift: int) -> DataFrame:
    """below with best and n of the run that its run was merged into."""
    up = answers.select(F.col("run").alias("up"), *SAME, "best", "n")
    return below.drop("best", "n").withColumn("up", F.shiftright("run", shift)).join(up, ["up", *SAME]).drop("up")


def _answered(docs: DataFrame, largest: bool) -> DataFrame:
    """Rows of docs with the claim that won (best), their own (claim) and the size of their group (n)."""
    levels = list(rounds(docs))
    answers = levels.pop()
    while levels:
        answers = _asked(levels.pop(), answers, BITS)
    return _asked(docs.withColumn("claim", F.col("best")), answers, 0)


def _results(rows: DataFrame, largest: bool) -> DataFrame:
    kept = F.col("claim.row") == F.col("best.row")
    return rows.withColumns({"keep_id": _order(F.col("best.id"), largest), "group_size": F.col("n"), "kept": kept, "text_sha256": F.lower(F.hex("check"))})


def duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs; texts are read once and not kept."""
    largest = _largest(keep)
    rows = durable(_digests(docs.select("doc_id", "text"), largest).select("doc_id", "run", *SAME, "best"))
    return _results(_answered(rows, largest), largest).select("doc_id", *OWN)


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    largest, inner = _largest(keep), aside(docs, "doc_id", "text")
    rows = durable(_digests(inner, largest).drop("norm"))
    won = _results(_answered(rows, largest), largest).where("kept")
    return back(won, docs, ("doc_id", "text"))


def _largest(keep: str) -> bool:
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    return keep == "largest"
