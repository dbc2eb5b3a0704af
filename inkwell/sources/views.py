"""Tables and the research-shaped views over them. Every reader takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = {"A": "accuracy", "N": "f1", "R": "perplexity"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out over all cores if the files give fewer tasks than that; larger tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def _metric(flag: str = "l_returnflag") -> Column:
    return F.create_map(*(F.lit(x) for pair in METRICS.items() for x in pair))[F.col(flag)]


def workspaces(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_regionkey").alias("owner_id"))


def papers(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ready").otherwise("pending")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("paper_id"),
        F.col("c_nationkey").alias("workspace_id"),
        F.concat(F.lit("Paper "), F.col("o_orderkey").cast("string")).alias("title"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("published_year"),
        F.col("o_orderpriority").alias("venue"),
    )


def results(spark, sf_dir) -> DataFrame:
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    dataset = F.when(F.col("l_linenumber") % 7 != 0, F.col("p_brand"))
    return joined.select(
        F.col("l_orderkey").alias("paper_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        F.lower("s_name").alias("model_key"),
        F.col("s_name").alias("model_name"),
        F.lower(dataset).alias("dataset_key"),
        dataset.alias("dataset_name"),
        _metric().alias("metric_key"),
        F.col("l_quantity").alias("value"),
        F.col("l_linestatus").alias("split"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


def entities(spark, sf_dir) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    named = line.join(part, line["l_partkey"] == part["p_partkey"])
    # Shuffled as one row a line; the three names of a line are made, and grouped, where its paper then is.
    rows = named.select(F.col("l_orderkey").alias("paper_id"), "l_discount", "p_brand", "p_type", "l_returnflag").repartition("paper_id")
    each = rows.select(
        "paper_id",
        (1 - F.col("l_discount")).alias("confidence"),
        F.inline(F.array(*(F.struct(F.lit(label).alias("label"), name.alias("name")) for label, name in (("Dataset", F.col("p_brand")), ("Task", F.col("p_type")), ("Metric", _metric()))))),
    )
    return each.groupBy("paper_id", "label", F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.max("confidence").alias("confidence"))


def authors(spark, sf_dir) -> DataFrame:
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).select(F.col("l_orderkey").alias("paper_id"), F.col("s_name").alias("author")).distinct()


def citations(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_orderkey <> l_partkey")
    known = papers(spark, sf_dir).select(F.col("paper_id").alias("dst_paper"))
    return line.select(F.col("l_orderkey").alias("src_paper"), F.col("l_partkey").alias("dst_paper")).distinct().join(known, "dst_paper", "left_semi").select("src_paper", "dst_paper")


def references(spark, sf_dir) -> DataFrame:
    """Bibliography rows: the paper and the title it cites (title text varies in case and marks)."""
    line = table(spark, sf_dir, "lineitem")
    title = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("paper  "), F.col("l_partkey").cast("string"), F.lit("."))).otherwise(F.concat(F.lit("Paper "), F.col("l_partkey").cast("string")))
    return line.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("order"), title.alias("title"))


def edges(spark, sf_dir) -> DataFrame:
    """uid pairs: src, type, dst with the labels of both ends."""
    paper = lambda c: F.concat(F.lit("Paper:"), F.col(c).cast("string"))
    ent = entities(spark, sf_dir)
    kind = F.create_map(*(F.lit(x) for x in ("Dataset", "USES_DATASET", "Task", "ADDRESSES", "Metric", "REPORTS")))[F.col("label")]
    parts = [
        authors(spark, sf_dir).select(paper("paper_id").alias("src"), F.lit("AUTHORED_BY").alias("type"), F.concat(F.lit("Author:"), F.lower("author")).alias("dst")),
        ent.select(paper("paper_id").alias("src"), kind.alias("type"), F.concat("label", F.lit(":"), "key").alias("dst")),
        papers(spark, sf_dir).select(paper("paper_id").alias("src"), F.lit("PUBLISHED_IN").alias("type"), F.concat(F.lit("Venue:"), F.lower("venue")).alias("dst")),
        citations(spark, sf_dir).select(paper("src_paper").alias("src"), F.lit("CITES").alias("type"), paper("dst_paper").alias("dst")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def chunks(spark, sf_dir) -> DataFrame:
    """documents cut at line ends: paper_id, chunk_index, content, kind."""
    docs = spread(table(spark, sf_dir, "documents"))
    rows = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return rows.withColumn("kind", F.when(F.col("content").contains("|"), "table").otherwise("text"))


def turns(spark, sf_dir) -> DataFrame:
    """Question and answer pairs of conversations with the turns before them as context."""
    talk = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant", "system"))
    user = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pair = user.join(reply, ["conv_id", "turn"])
    earlier = talk.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("said"))
    context = pair.join(earlier, "conv_id").where(F.col("at") < F.col("turn")).groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda z: z["said"]).alias("contexts"))
    return pair.join(context, ["conv_id", "turn"], "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
