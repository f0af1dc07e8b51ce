"""Recorded events as a stream: a Python data source with offsets.

``stage`` writes events in their order, cut into steps of so many rows, each a folder whose rows are sorted by share, a hash range of sessions. The
source's offset is the number of steps given out. A micro-batch takes at most ``steps`` of them, a task each share, so a session's events
stay in one task and in order. Tasks open only their steps' files and skip the row groups of other shares. After a restart Spark tells the offset of its
checkpoint, so nothing is lost and nothing comes twice. Steps that are added later are read as they come.

    spark.dataSource.register(replay.ReplaySource)
    spark.readStream.format("evidora_replay").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from evidora.operators import scans

ORDER = ["timestamp_ms", "session_id", "seq"]


def stage(events: DataFrame, folder: str, rows: int = 100_000, shares: int = 8, width: int = scans.HOUR) -> None:
    """Write events (session_id, timestamp_ms, seq, ...) to a new folder that all executors share. Rows of equal places keep any order, but
    always a place in one step only, as the steps are written once."""
    placed = scans.numbered(events, [], "timestamp_ms", ORDER, "_n", width)
    cut = placed.withColumns({"step": F.expr(f"_n div {rows}"), "share": F.pmod(F.xxhash64(F.coalesce("session_id", F.lit(""))), F.lit(shares)).cast("int")})
    cut.repartition("step").sortWithinPartitions("step", "share", "_n").drop("_n").write.partitionBy("step").parquet(folder)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


def _folders(path: str, first: int, end: int) -> tuple[fs.FileSystem, list[str]]:
    store, root = _opened(path)
    return store, [f"{root.rstrip('/')}/step={k}" for k in range(first, end)]


@dataclass
class Share(InputPartition):
    share: int
    first: int
    end: int


class ReplayReader(DataSourceStreamReader):
    def __init__(self, path: str, steps: int, shares: int, schema: StructType):
        self.path, self.steps, self.shares, self.names = path, steps, shares, schema.names
        self.given = 0

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        """At most ``steps`` beyond what was planned last, as far as they have been staged without a gap."""
        store, folders = _folders(self.path, self.given, self.given + self.steps)
        there = [x.type == fs.FileType.Directory for x in store.get_file_info(folders)]
        return {"step": self.given + (there + [False]).index(False)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        """Also called with the offset of the checkpoint after a restart, before any other call."""
        self.given = end["step"]
        return [Share(k, start["step"], end["step"]) for k in range(self.shares)] if start["step"] < end["step"] else []

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, folders = _folders(self.path, partition.first, partition.end)
        for folder in folders:
            rows = ds.dataset(folder, filesystem=store, format="parquet")
            for batch in rows.to_batches(columns=self.names, filter=ds.field("share") == partition.share, use_threads=False, batch_readahead=1, fragment_readahead=1):
                if batch.num_rows:
                    yield batch

    def commit(self, end: dict) -> None:
        """Staged steps stay where they are."""


class ReplaySource(DataSource):
    """Options: path, steps (a micro-batch's most, 1), shares (those of ``stage``, 8)."""

    @classmethod
    def name(cls) -> str:
        return "evidora_replay"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        store, folders = _folders(self.options["path"], 0, 1)
        told = ds.dataset(folders[0], filesystem=store, format="parquet").schema
        return StructType([f for f in from_arrow_schema(told) if f.name != "share"])

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(self.options["path"], int(self.options.get("steps", 1)), int(self.options.get("shares", 8)), schema)
