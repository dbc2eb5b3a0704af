"""Documents as a stream: chunked and stored by replacing each paper's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators import documents, library


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def store_chunks(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Runs through what is there and stops; a paper that comes again replaces its chunks."""

    def each(batch: DataFrame, _: int) -> None:
        library.write_replacing(documents.chunk_documents(batch.dropDuplicates([key]), key), path, key)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
