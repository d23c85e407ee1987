"""Documents as a stream: files of recognised lines that appear in a folder, a few at a time, to a table of rows.

A file is a whole document, so no state is kept between files and there is nothing to be late
for: each trigger runs the batch plan over its new files. The checkpoint makes each file
count once, also after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.operators import documents
from docfields.sources.ocr_json import lines_of

#: Files taken at a time, and the bounds of that.
FILES_AT_ONCE, FEWEST, MOST = 4, 1, 16


def extract_arrivals(spark: SparkSession, folder: str, table: str, checkpoint: str, *, at_once: int = FILES_AT_ONCE) -> None:
    """Reads what lies in a folder of JSON lines and hasn't been read, adds a row for each document to the Parquet
    table, and returns when all is done. For a service, run it again or give the query a trigger of its own."""
    files = spark.readStream.schema("value string").format("text").option("wholetext", True).option("maxFilesPerTrigger", max(FEWEST, min(MOST, at_once))).load(folder)
    named = files.select(F.col("_metadata.file_name").alias("name"), "value")

    def batch(some: DataFrame, number: int) -> None:
        rows = documents.extract_documents(lines_of(some)).drop("confidences")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")  # a batch that runs again replaces itself

    named.writeStream.foreachBatch(lambda some, number: batch(some, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
