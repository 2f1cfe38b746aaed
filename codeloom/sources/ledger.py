"""A ledger of replies: what a model has answered stays answered, whatever happens to the run.

A ledger is a folder. Each slice of replies is a Parquet folder in it, and counts once its job has committed (``_SUCCESS``); what a
broken job left behind is ignored and replaced. A reply belongs to a key, the row and a hash of everything that was sent, so other
instructions or another text are other requests. Rows that are left to ask are found by an anti join on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY_COLUMNS = "raw_response string, llm_error string, attempts int, latency_seconds double, prompt_tokens bigint, completion_tokens bigint"


class Ledger:
    """Replies under ``(row_id, request_key)`` in the folder ``path``; ``row_type`` is the SQL type of row_id."""

    def __init__(self, spark: SparkSession, path: str, row_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"row_id {row_type}, request_key string, {REPLY_COLUMNS}, run int"
        self._jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def is_committed(self, name: str) -> bool:
        return self._files.exists(self._jvm_path(f"{self.path}/{name}/_SUCCESS"))

    def slices(self) -> list[str]:
        """Names of the committed slices."""
        if not self._files.exists(self._jvm_path(self.path)):
            return []
        names = sorted(status.getPath().getName() for status in self._files.listStatus(self._jvm_path(self.path)) if status.isDirectory())
        return [name for name in names if self.is_committed(name)]

    def next_run(self) -> int:
        return 1 + max((int(name.split("-")[1]) for name in self.slices() if name.startswith("run-")), default=0)

    def replies(self) -> DataFrame:
        """Every committed reply, also repeated ones of a request that failed before."""
        paths = [f"{self.path}/{name}" for name in self.slices()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """One reply for each key: one without an error if there is any, else that of the last run."""
        rest = [c.split()[0] for c in REPLY_COLUMNS.split(", ")]
        best = F.max_by(F.struct(*rest, "run"), F.struct((F.col("llm_error") == "").alias("ok"), F.col("run")))
        return self.replies().groupBy("row_id", "request_key").agg(best.alias("r")).select("row_id", "request_key", "r.*")

    def pending(self, requests: DataFrame, retry_failed: bool = True) -> DataFrame:
        """The requests without a committed reply; failed ones count as not asked if they are to be retried."""
        if not self.slices():
            return requests
        known = self.replies()
        known = known.where("llm_error = ''") if retry_failed else known
        return requests.join(known.select("row_id", "request_key"), ["row_id", "request_key"], "left_anti")

    def commit(self, replies: DataFrame, name: str, run: int) -> None:
        """Writes a slice. A slice of that name that was not committed is replaced; a committed one must not be written again."""
        if self.is_committed(name):
            raise ValueError(f"The slice {name} is committed already.")
        columns = [c.split()[0] for c in self.schema.split(", ")]
        replies.withColumn("run", F.lit(run)).select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}")
