"""Files as they arrive: a stream of binary files, detected and written with their trees, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions.formats import detect_format
from pagemill.functions.text import base_name
from pagemill.plans.extract import Options, extract


def stream_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", base_name("path").alias("name"), "content", "length", F.col("modificationTime").alias("modified"), detect_format("content", base_name("path")).alias("file_format"))


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Writes the tree of every new file to output as Parquet, a folder for each batch; the checkpoint folder remembers what was read. Stops when all present files are done."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch, options=options).write.mode("overwrite").parquet(f"{output}/batch={number}")  # a batch that is repeated replaces itself

    return stream_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
