"""Operator 4: repeated runs of lines, by winnowing over line hashes.

Lines are the \\n-split parts of a text that hold something besides white
space.  Over every RUN consecutive lines of a document the smallest line hash
(the last one of equals) is selected.  Two documents that share a run of RUN
lines select the same line of it, so a fingerprint that occurs once proves
that no run through it is repeated, and only positions whose fingerprint
occurs again are joined.  Around each such position the match is extended to
both sides: the RUN-line stretches that hold it, up to RUN - 1 lines back and
ahead, are compared in full (by all their line hashes, 64 bits a line).  A
stretch that equals an earlier one (a smaller doc_id, or further up in the
same document) is removed; neighbouring and overlapping stretches merge, so a
longer repeated run goes as a whole.  White-space lines stay where they are.

A line may be a whole paragraph, so a run of one or two lines that holds WORDS
words or more is a stretch as well, at every place: its lines are its
fingerprint.  With the RUN-line stretches this is the guarantee: a run of
lines goes if it has RUN lines or WORDS words and occurs earlier.

Only DataFrame functions are used.  Counting and finding the first of equal
stretches combine on the map side, so a line that is everywhere costs one row
a task there; the joins that bring the answers back are plain equi-joins whose
hot partitions adaptive execution splits.

Defined results: a null text stays null and has no lines; rows with one doc_id
and one text are one document (all get its result); a null doc_id counts as
the smallest; an empty table gives an empty result; other columns pass
through untouched whatever their names, except that the result's own n_lines,
n_removed and n_runs replace columns of those names in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.columns import aside, back, once

NEEDED = ("doc_id", "text")
RUN = 3
WORDS = 30
CONTENT = r"[^\x20\x09-\x0D]"


def _content_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(CONTENT))


def _line_hashes(text: Column) -> Column:
    return F.transform(_content_lines(text), lambda x: F.xxhash64(x))


def _identity(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("__lw_doc"), F.xxhash64(F.lit(1), F.col("text")).alias("__lw_key")]


def _rich_stretches(docs: DataFrame, run: int, words: int) -> DataFrame:
    """__lw_doc, __lw_key, at, n, h0, h1...: every stretch of n < run lines that holds `words` words (0: no line)."""
    lines = F.transform(_content_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(f"{CONTENT}+")).alias("w")))
    rows = docs.select(*_identity(docs), lines.alias("__lw_l")).where(F.size("__lw_l") > 0)
    line = lambda i, k: F.get(F.col("__lw_l"), i + k)

    def of(n: int) -> Column:
        held = lambda i: sum((line(i, k)["w"] for k in range(1, n)), line(i, 0)["w"])
        hashes = lambda i: (line(i, k)["h"] if k < n else F.lit(0).cast("long") for k in range(run))
        starts = F.filter(F.sequence(F.lit(0), F.size("__lw_l") - 1), lambda i: (i + n <= F.size("__lw_l")) & (held(i) >= words))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), *(x.alias(f"h{k}") for k, x in enumerate(hashes(i)))))

    found = F.concat(*(of(n) for n in range(1, run)))
    return rows.select("__lw_doc", "__lw_key", F.explode(found).alias("w")).select("__lw_doc", "__lw_key", "w.*")


def repeated_stretches(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """__lw_doc, __lw_key, __lw_at, __lw_n: where n lines start (counted from 0) that occur earlier as well; words None: RUN lines only."""
    h = F.col("__lw_h")
    window_min = lambda i: F.array_min(F.slice(h, i + 1, run))
    last_of_equals = lambda i: i + run - F.array_position(F.reverse(F.slice(h, i + 1, run)), window_min(i)).cast("int")
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - run), last_of_equals))
    rows = docs.select(*_identity(docs), _line_hashes(F.col("text")).alias("__lw_h")).where(F.size(h) >= run)
    first_line = lambda p: F.greatest(F.lit(0), p - (run - 1))
    prints = F.transform(places, lambda p: F.struct(F.get(h, p).alias("print"), first_line(p).alias("from"), F.slice(h, first_line(p) + 1, p - first_line(p) + run).alias("around")))
    selected = rows.select("__lw_doc", "__lw_key", F.explode(prints).alias("p")).select("__lw_doc", "__lw_key", "p.*")
    again = selected.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print")
    matched = selected.join(again, "print", "left_semi")
    inner = F.transform(F.sequence(F.lit(0), F.size("around") - run), lambda i: F.struct((F.col("from") + i).alias("at"), F.lit(run).alias("n"), *(F.element_at(F.col("around"), i + k + 1).alias(f"h{k}") for k in range(run))))
    stretches = matched.where(F.size("around") >= run).select("__lw_doc", "__lw_key", F.explode(inner).alias("w")).select("__lw_doc", "__lw_key", "w.*")
    if words is not None and run > 1:
        stretches = stretches.unionByName(_rich_stretches(docs, run, words))
    content = ["n", *(f"h{k}" for k in range(run))]
    place = F.struct("__lw_doc", "__lw_key", "at")
    firsts = stretches.groupBy(*content).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last")).select(*content, "first")
    later = stretches.join(firsts, content).where(place > F.col("first"))
    return later.select("__lw_doc", "__lw_key", F.col("at").alias("__lw_at"), F.col("n").alias("__lw_n"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """docs with text shortened, and n_lines, n_removed, n_runs; one row per row of docs."""
    rows = aside(docs, *NEEDED)
    starts = repeated_stretches(rows, run, words).groupBy("__lw_doc", "__lw_key").agg(F.collect_set(F.struct("__lw_at", "__lw_n")).alias("__lw_starts"))
    keyed = rows.withColumn("__lw_key2", F.xxhash64(F.lit(1), F.col("text")))
    joined = keyed.join(starts, F.col("doc_id").eqNullSafe(F.col("__lw_doc")) & (F.col("__lw_key2") == F.col("__lw_key")), "left")
    gone = F.array_distinct(F.flatten(F.transform("__lw_starts", lambda s: F.sequence(s["__lw_at"], s["__lw_at"] + s["__lw_n"] - 1))))

    def rest(lines: Column) -> Column:
        """The lines that stay.  Every step is linear: places of lines that hold something, those removed, all others."""
        places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(CONTENT))
        removed = once(places, lambda at: F.transform("__lw_gone", lambda k: F.get(at, k)))
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.get(lines, i))

    hit = F.col("__lw_starts").isNotNull()
    lines = F.split("text", "\n", -1)
    begins = F.size(F.array_except("__lw_gone", F.transform("__lw_gone", lambda k: k + 1)))
    shaped = (
        joined.withColumn("__lw_gone", F.when(hit, gone))
        .withColumn("n_lines", F.coalesce(F.size(_content_lines(F.col("text"))), F.lit(0)).cast("long"))
        .withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
        .withColumn("n_removed", F.when(hit, F.size("__lw_gone")).otherwise(0).cast("long"))
        .withColumn("n_runs", F.when(hit, begins).otherwise(0).cast("long"))
        .withColumn("text", F.when(hit, F.array_join(once(lines, rest), "\n")).otherwise(F.col("text")))
    )
    return back(shaped, docs, NEEDED, ("n_lines", "n_removed", "n_runs"))
