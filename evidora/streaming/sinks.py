"""Where turns and traces go: records of five fields, a JSON log, a table in memory.

A streaming log is appended by file, with a checkpoint that makes each row arrive once; buffering and flushing are the
micro-batch's. Nothing is gathered on the driver but the table in memory, which is for tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evidora.config import DEGRADED_ANSWER, DEGRADED_DOUBT, RECORD_FIELDS
from evidora.operators.evaluate import TURN


def turn_results(rows: DataFrame) -> DataFrame:
    """(TURN, retrieval_events, sub_queries, reason, retrieval_required) of the engine's rows: what a turn searched, in order, and the texts of
    its queries that are still live at its end. A turn's queries are few, so they may be a list."""
    asked = rows.filter("row = 'query'").groupBy(*TURN).agg(F.array_sort(F.collect_list(F.struct("seq", "query_id", "ts_ms", "text", "trigger"))).alias("asked"))
    ended = rows.filter("row = 'turn'").select(*TURN, "live", "reason", "retrieval_required")
    event = lambda q: F.struct((q.ts_ms / 1000).alias("timestamp_s"), q.text.alias("query"), q.trigger.alias("trigger"))
    own = F.coalesce("asked", F.expr("CAST(array() AS array<struct<seq:bigint,query_id:string,ts_ms:bigint,text:string,trigger:string>>)"))
    made = ended.join(asked, TURN, "left").withColumn("asked", own)
    texts = F.transform(F.filter("asked", lambda q: F.array_contains("live", q.query_id)), lambda q: q.text)
    return made.select(*TURN, F.transform("asked", event).alias("retrieval_events"), texts.alias("sub_queries"), "reason", "retrieval_required")


def records(turns: DataFrame) -> DataFrame:
    """The fields of RECORD_FIELDS and no others; those that ``turns`` lacks are null. A degraded turn gets the fixed answer and doubt."""
    if "reason" in turns.columns:
        lost = F.col("reason").eqNullSafe("degraded")
        fixed = {"answer": DEGRADED_ANSWER, "uncertainty": DEGRADED_DOUBT}
        turns = turns.withColumns({c: F.when(lost, v).otherwise(F.col(c) if c in turns.columns else F.lit(None).cast("string")) for c, v in fixed.items()})
    return turns.select(*(F.col(c) if c in turns.columns else F.lit(None).cast("string").alias(c) for c in RECORD_FIELDS))


def json_log(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream's rows as JSON lines below ``path``; both folders are shared ones on a cluster."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def memory_log(rows: DataFrame, name: str) -> DataStreamWriter:
    return rows.writeStream.format("memory").queryName(name).outputMode("append")
