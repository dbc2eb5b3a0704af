"""The library's tables: intake, ownership, paging and idempotent replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.sources import replacing


def read_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows: path, checksum, size_bytes, storage_key, is_pdf."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    checksum = F.sha2("content", 256)
    return files.select("path", checksum.alias("checksum"), F.length("content").alias("size_bytes"), tx.storage_key(checksum, F.col("path")).alias("storage_key"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def accept_uploads(existing: DataFrame, uploads: DataFrame, most_bytes: int = 100 << 20) -> tuple[DataFrame, DataFrame]:
    """(new papers, refused uploads with a reason): one row per (workspace_id, checksum), put if absent."""
    keys = ["workspace_id", "checksum"]
    reason = F.when(F.col("size_bytes") <= 0, "empty").when(F.col("size_bytes") > most_bytes, "too large").when(~F.col("is_pdf"), "not a PDF")
    judged = uploads.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("filename"))
    fine = judged.where("reason IS NULL").withColumn("n", first)
    fresh = fine.where("n = 1").join(existing.select(*keys), keys, "left_anti")
    again = fine.where("n > 1").unionByName(fine.where("n = 1").join(existing.select(*keys), keys, "left_semi")).withColumn("reason", F.lit("already there"))
    new = fresh.select(*keys, tx.safe_filename(tx.nfkc("filename")).alias("filename"), "size_bytes", tx.storage_key(F.col("checksum"), F.col("filename")).alias("storage_key"), F.lit("pending").alias("status"))
    return new, judged.where("reason IS NOT NULL").select(*keys, "filename", "reason").unionByName(again.select(*keys, "filename", "reason"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """old without the keys that new has, and new: loading a paper twice gives the same table."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in this order: retried or repeated results merge without one replacing an earlier one."""
    kept = F.min(F.struct(*(F.col(c) for c in (*order, *(c for c in rows.columns if c not in order and c not in keys))))).alias("__first")
    return rows.groupBy(*keys).agg(kept).select(*(F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in rows.columns))


def untrusted_blocks(found: DataFrame, group: str, order: str = "n") -> DataFrame:
    """group, block: each group's results (title, url, snippet) as numbered, delimited data."""
    numbered = found.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    part = F.format_string("<<<EXTERNAL_RESULT %d>>>\ntitle: %s\nurl: %s\ncontent: %s\n<<<END_EXTERNAL_RESULT %d>>>", "__n", "title", "url", "snippet", "__n")
    listed = numbered.select(group, F.struct("__n", part.alias("part")).alias("z")).groupBy(group).agg(F.array_sort(F.collect_list("z")).alias("l"))
    return listed.select(group, F.array_join(F.transform("l", lambda z: z["part"]), "\n\n").alias("block"))


def write_replacing(new: DataFrame, path: str, key: str = "paper_id") -> None:
    """Stores rows; those of the keys that new has are replaced, all at once when the write commits (see sources.replacing)."""
    replacing.write(new, path, key)


def stored(spark, path: str, key: str = "paper_id") -> DataFrame:
    """The rows of a store as it is now."""
    return replacing.read(spark, path, key)


def _safe_key(key: str = "key"):
    """An error for a key that would leave its store: absolute, or with a part that is empty, . or .. ."""
    parts = F.split(F.replace(F.coalesce(F.col(key), F.lit("")), F.lit("\\"), F.lit("/")), "/")
    return F.when(F.exists(parts, lambda p: p.isin("", ".", "..")), F.raise_error(F.concat(F.lit("not a storage key: "), F.coalesce(F.col(key), F.lit("null"))))).otherwise(F.col(key))


def save_blobs(blobs: DataFrame, path: str) -> None:
    """Stores blobs (key, content) with checksum and size; a key that is there is replaced."""
    rows = blobs.select(_safe_key().alias("key"), "content", F.sha2("content", 256).alias("checksum"), F.length("content").cast("long").alias("size_bytes"))
    replacing.write(rows, path, "key")


def open_blobs(spark, path: str, keys: DataFrame | None = None) -> DataFrame:
    """key, content, checksum, size_bytes of these keys (all, if none are named)."""
    rows = replacing.read(spark, path, "key")
    return rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")


def blobs_exist(spark, path: str, keys: DataFrame) -> DataFrame:
    """key, is_there; contents are not read."""
    have = replacing.read(spark, path, "key").select("key", F.lit(True).alias("is_there"))
    return keys.select("key").distinct().join(have, "key", "left").fillna(False, ["is_there"])


def delete_blobs(keys: DataFrame, path: str) -> None:
    replacing.remove(keys.select(_safe_key().alias("key")), path, "key")


def delete_papers(tables: dict[str, DataFrame], gone: DataFrame, key: str = "paper_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted papers."""
    return {name: rows.join(gone.select(key), key, "left_anti") for name, rows in tables.items()}


def authorized(papers: DataFrame, workspaces: DataFrame, owner, requested: Sequence = ()) -> DataFrame:
    """The papers in workspaces of an owner; an empty request means all of them."""
    own = papers.join(workspaces.where(F.col("owner_id") == owner).select("workspace_id"), "workspace_id", "left_semi")
    return own.where(F.col("paper_id").isin(*requested)) if requested else own


def page(papers: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest first (no year last), with the total beside each row."""
    total = papers.agg(F.count("*").alias("total"))
    rows = papers.orderBy(F.desc(F.coalesce("published_year", F.lit(0))), F.desc("paper_id")).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))


def status_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("status").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: one scan and one row per table."""
    parts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def display_title(title: str = "title", fallback: str = "filename"):
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.nullif(F.col(fallback), F.lit("")), F.lit("Untitled"))
