"""Tables that a stream writes batch by batch, so that each batch counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommittedTables:
    """Tables in one shared folder that foreachBatch writes together.

    A batch writes its rows of each table to the table's `batch=<id>`, replacing what a run that stopped has left there,
    and then its commit record. Readers see the batches with a record only, so a batch is in all tables or in none,
    whenever the stream stops: a batch without a record has no rows, and runs again under the same id after a restart.
    One stream at a time writes to a folder, as its checkpoint sees to.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def last(self, spark: SparkSession) -> int:
        """The last batch with a commit record, or -1. Batches are committed in order, so all before it have one."""
        try:
            found = spark.read.schema("batch long").parquet(f"{self.folder}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return -1
        return found.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def read(self, spark: SparkSession, name: str, schema: str, before: int | None = None) -> DataFrame:
        """(schema, batch): the committed rows of a table, or those of the batches before a given one."""
        last = self.last(spark)
        last = last if before is None else min(last, before - 1)
        full = f"{schema}, batch long"
        if last < 0:
            return spark.createDataFrame([], full)
        return spark.read.schema(full).parquet(f"{self.folder}/{name}").where(F.col("batch") <= last)

    def write(self, spark: SparkSession, batch: int, tables: dict[str, DataFrame], on_written: Callable[[int, str], None] | None = None) -> None:
        """Writes a batch of each table, calls on_written(batch, name) after each, and commits."""
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
            if on_written is not None:
                on_written(batch, name)
        record = spark.range(1).select(F.current_timestamp().alias("at"))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")
