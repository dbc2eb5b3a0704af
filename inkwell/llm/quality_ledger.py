"""Operator 1: a ledger of quality rules as bits.

Every rule is evaluated once per document.  The ledger row keeps the measured
numbers and one bit per failed rule; a policy is a named, versioned mask over
those bits, so a new policy, or what a policy would keep without one of its
rules, is a bitwise question over the ledger and never reads a text again.
store() keeps a ledger under the version of its rules.

Defined results: a null text has no words (all counts 0); repeated rows each
get their own ledger row; other columns, whatever their names, are not looked
at; an empty table gives an empty ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.durable import exists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Fixed bit numbers: a bit is never reused for another rule.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule(5, "shouting", "n_words > 0 AND 5 * n_shouted > 2 * n_words"),
    Rule(6, "few_letters", "n_words > 0 AND 2 * n_letter_words < n_words"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[x] for x in self.rules)


POLICIES = (
    Policy("base", 1, ("too_few_words", "repeated_windows")),
    Policy("strict", 1, tuple(r.name for r in RULES if r.name not in ("word_length", "few_letters"))),
    Policy("strict", 2, tuple(r.name for r in RULES)),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted", "n_letter_words")
_SYMBOL_FIND = re.compile(SYMBOLS).findall
_UPPER_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^a-z\x20\x09-\x0D]*[A-Z][^a-z\x20\x09-\x0D]*(?![^\x20\x09-\x0D])").findall
_LETTER = re.compile(r"[A-Za-z\x80-\U0010FFFF]").search


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0, 0, len(_SYMBOL_FIND(text))) + (0,) * (len(COUNTS) - 3)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = 0
    if n > WINDOW:
        ids: dict[str, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        group = seq
        for k in range(1, WINDOW - 1):  # exact: a window's number is made from its two parts' numbers
            group = np.unique(group[:-1] * (n + 1) + seq[k:], return_inverse=True)[1]
        _, inverse, times = np.unique(group[:-1] * (n + 1) + seq[WINDOW - 1 :], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[inverse] > 1)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        repeated = int(np.count_nonzero(np.cumsum(step)))
    shouted = len(_UPPER_WORD(text))
    letters = sum(1 for w in words if w.isalpha() or _LETTER(w))
    return (n, sum(map(len, words)), len(_SYMBOL_FIND(text)), len(lines), len(lines) - len(set(lines)), repeated, shouted, letters)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measure(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits; one row per row of docs, no shuffle."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(_measure_batches, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    bits = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END)" for r in RULES)
    return rows.withColumn("fail_bits", F.expr(bits))


def rules_version() -> str:
    """A name for the rules as they are now: a ledger of other rules does not answer for them."""
    return hashlib.sha256("\n".join(f"{r.bit} {r.name} {r.fails}" for r in RULES).encode()).hexdigest()[:16]


def _folder(path: str) -> str:
    return f"{path}/rules={rules_version()}"


def store(docs: DataFrame, path: str) -> None:
    """Measures all texts once and keeps the ledger; policies and ablations read it from there."""
    ledger(docs).write.mode("overwrite").parquet(_folder(path))


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a whole ledger of the present rules is kept there."""
    return exists(spark, f"{_folder(path)}/_SUCCESS")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_folder(path))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, version, without_rule (null: the whole policy), n_docs, n_kept.

    Rows are first counted by fail_bits (at most 2**rules groups, combined on
    the map side); each policy then filters those few groups bitwise.
    """
    groups = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    masks = [(p.name, p.version, None, p.mask) for p in policies]
    masks += [(p.name, p.version, r, p.mask & ~Policy(p.name, p.version, (r,)).mask) for p in policies for r in p.rules]
    cases = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(r).cast("string").alias("without_rule"), F.lit(m).cast("long").alias("mask")) for p, v, r, m in masks))
    each = groups.select("fail_bits", "n", F.inline(cases))
    kept = F.when(F.col("fail_bits").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0)
    return each.groupBy("policy", "version", "without_rule").agg(F.sum("n").alias("n_docs"), F.sum(kept).alias("n_kept"))
