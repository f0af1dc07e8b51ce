"""Evidence of a stream that can be taken back: versioned rows, withdrawals, and a read that leaves out what was withdrawn.

Each micro-batch has a folder of its own for its evidence and one for its withdrawals, named by its number and overwritten as a whole, so that a batch that
is run again changes nothing. Evidence of a query (session_id, asked_id) counts in its latest batch alone. A withdrawal holds for evidence of its own and
earlier batches. ``compact`` writes what counts into one folder and then deletes what that replaces; batches up to it are not taken again.

The reader joins by (session_id, asked_id) and needs neither state nor the order of batches. Evidence without asked_id, searched in advance, is
never withdrawn and counts in every batch.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["session_id", "asked_id"]
GONE = "session_id string, query_id string"


class EvidenceTable:
    """Rows in ``folder``, a path that all executors share. schema: of the evidence, with session_id and asked_id."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _found(self, what: str) -> dict[int, str]:
        """Complete folders by number."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        whole = [m for m in (re.fullmatch(r"batch-(\d+)", n) for n in names) if m and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}/{m[0]}/_SUCCESS"))]
        return {int(m[1]): f"{self.folder}/{what}/{m[0]}" for m in whole}

    def through(self) -> int:
        """The last batch that a compaction holds, or -1."""
        return max(self._found("base"), default=-1)

    def sink(self, evidence: DataFrame, gone: DataFrame, number: int) -> None:
        """For ``engine.search_stream``: store batch ``number``. Withdrawals are complete last, and without them the batch doesn't count."""
        if number <= self.through():
            return
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        evidence.select(*names).write.mode("overwrite").parquet(f"{self.folder}/evidence/batch-{number}")
        gone.select("session_id", "query_id").write.mode("overwrite").parquet(f"{self.folder}/withdrawn/batch-{number}")

    def _read(self, what: str, schema: str, numbers: list[int]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, batch long")
        own = self._found(what)
        for n in numbers:
            out = out.unionByName(self.spark.read.schema(schema).parquet(own[n]).withColumn("batch", F.lit(n).cast("long")))
        return out

    def current(self, through: int | None = None) -> DataFrame:
        """The evidence that counts, with its batch; as of batch ``through``, if given, which can't be before the last compaction."""
        base = self.through()
        if through is not None and through < base:
            raise ValueError(f"batches up to {base} are compacted")
        own, gone = self._found("evidence"), self._found("withdrawn")
        numbers = sorted(n for n in gone if n in own and n > base and (through is None or n <= through))
        rows = self._read("evidence", self.schema, numbers)
        if base >= 0:
            rows = rows.unionByName(self.spark.read.schema(f"{self.schema}, batch long").parquet(self._found("base")[base]))
        taken = self._read("withdrawn", GONE, numbers).groupBy("session_id", F.col("query_id").alias("asked_id")).agg(F.max("batch").alias("taken"))
        latest = rows.filter("asked_id IS NOT NULL").groupBy(*KEY).agg(F.max("batch").alias("batch"))
        live = latest.join(taken, KEY, "left").filter("taken IS NULL OR taken < batch").select(*KEY, "batch")
        ahead = rows.filter("asked_id IS NULL")
        return rows.join(live, [*KEY, "batch"], "left_semi").unionByName(ahead)

    def compact(self) -> int:
        """Fold all complete batches into one folder; returns the last of them, or -1 without any."""
        base = self.through()
        numbers = [n for n in self._found("withdrawn") if n in self._found("evidence")]
        last = max([base, *numbers])
        if last > base:
            self.current(last).write.mode("overwrite").parquet(f"{self.folder}/base/batch-{last}")
        for what, keep in (("base", last), ("evidence", last + 1), ("withdrawn", last + 1)):
            for n, path in self._found(what).items():
                if n < keep:
                    target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return last
