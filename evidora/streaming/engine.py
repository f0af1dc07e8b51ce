"""The engine's turns over batches and streams of events, hypotheses that agree, and event windows.

Both ways run the same step function. In batch, events are sorted by session inside partitions and go through
one by one, so memory holds a session's state and never a session's events. In a stream the state is
kept between micro-batches as JSON, keyed by session, and removed at session end or by a timeout.
"""

from collections.abc import Iterator
from json import dumps, loads

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.config import Controller
from evidora.functions import text as T
from evidora.operators import scans
from evidora.operators.controller import Session, Vocabulary, degraded, step

ROWS = (
    "session_id string, seq long, row string, utterance_id string, ts_ms long, decision string, turn_kind string, reason string, stability double, superseded array<string>, "
    "query_id string, text string, label string, trigger string, parent string, live array<string>, cancelled array<string>, retrieval_required boolean, request_id string, adopted boolean"
)
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_TYPES = [_KINDS[x.split()[1]] for x in ROWS.split(", ")]


def with_session(events: DataFrame, width: int = scans.HOUR) -> DataFrame:
    """Events without a session get the last one named before them, or 'default'; right only where a stream
    holds one session at a time, as (source, timestamp_ms, seq) orders them. A source is cut into stretches of ``width`` ms over tasks.
    ``streaming.sessions`` has the form for streams."""
    known = scans.last_known(events, ["source"], "timestamp_ms", ["timestamp_ms", "seq"], "session_id", "session_id", width)
    return known.withColumn("session_id", F.coalesce("session_id", F.lit("default")))


def replay(events: DataFrame, mode: str = "streaming", known: Vocabulary = Vocabulary(), own: Controller = Controller()) -> DataFrame:
    """Rows of ROWS for events (session_id, timestamp_ms, seq, event_type, utterance_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, session, n = None, Session(), 0
        for batch in batches:
            out: list[dict] = []
            for event in batch.to_pylist():
                if event["session_id"] != name:
                    name, session, n = event["session_id"], Session(), 0
                for row in step(session, event, mode, known, own):
                    out.append(row | {"session_id": name, "seq": n})
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    sorted_in = events.select("session_id", "timestamp_ms", "seq", "event_type", "utterance_id", "text").repartition("session_id").sortWithinPartitions("session_id", "timestamp_ms", "seq")
    return sorted_in.mapInArrow(run, ROWS)


def advance(key: tuple, parts: Iterator[pd.DataFrame], state, timeout_ms: int, mode: str, known: Vocabulary, own: Controller) -> pd.DataFrame:
    """Rows of a session's next events, its state brought up to date. At a timeout the state goes, and each utterance that is
    still open ends as a degraded turn."""
    session, n = Session(), 0
    if state.exists:
        saved, n = state.get
        session = Session.of_json(loads(saved))
    rows: list[dict] = []
    if state.hasTimedOut:
        rows = [row | {"session_id": key[0], "seq": n + k} for k, row in enumerate(degraded(session))]
        state.remove()
    else:
        pdf = pd.concat(list(parts)).sort_values(["timestamp_ms", "seq"], kind="stable")
        for event in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            for row in step(session, event, mode, known, own):
                rows.append(row | {"session_id": key[0], "seq": n})
                n += 1
        if not session.open and not session.answered and (pdf["event_type"] == "session_end").any():
            state.remove()
        else:
            state.update((dumps(session.to_json()), n))
            state.setTimeoutDuration(timeout_ms)
    made = pd.DataFrame([{c: r.get(c) for c in _NAMES} for r in rows], columns=_NAMES)
    return made.astype({"seq": "int64", "ts_ms": "Int64"})


def stream(events: DataFrame, timeout_ms: int = 15 * 60 * 1000, mode: str = "streaming", known: Vocabulary = Vocabulary(), own: Controller = Controller()) -> DataFrame:
    """The same over a streaming DataFrame. A session without events for ``timeout_ms`` loses its state, and its open turns
    are given out as degraded."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        yield advance(key, parts, state, timeout_ms, mode, known, own)

    return events.groupBy("session_id").applyInPandasWithState(run, ROWS, "state string, n long", "append", "ProcessingTimeTimeout")


def withdrawn(rows: DataFrame) -> DataFrame:
    """(session_id, query_id) of queries that a row takes back: superseded ones, parents that a clause has grown from, and those that an
    ended turn lists as cancelled."""
    none = F.array().cast("array<string>")
    own_parent = (F.col("row") == "query") & (F.split_part("parent", F.lit(".q"), F.lit(1)) == F.col("utterance_id"))
    ids = F.concat(F.coalesce("superseded", none), F.coalesce("cancelled", none), F.when(own_parent, F.array("parent")).otherwise(none))
    return rows.select("session_id", F.explode(ids).alias("query_id")).distinct()


def search_stream(queries: DataFrame, search, sink):
    """Starts answering a stream of the engine's rows: each micro-batch's distinct texts, asked or to be searched in advance, are searched
    once, by batch joins against static index tables; queries taken back in the same batch are left out. search: DataFrame
    (query_id, query) -> evidence; sink: (evidence, withdrawn (session_id, query_id), batch id) -> None, which takes back evidence of
    earlier batches. Evidence has row, session_id and asked_id, null for texts searched in advance."""

    def batch(rows: DataFrame, number: int) -> None:
        gone = withdrawn(rows)
        wanted = rows.filter("row IN ('query', 'prefetch')").join(gone, ["session_id", "query_id"], "left_anti")
        asked = wanted.select("row", "session_id", F.col("query_id").alias("asked_id"), F.xxhash64("text").alias("query_id"), F.col("text").alias("query"))
        found = search(asked.select("query_id", "query").distinct())
        sink(asked.drop("query").join(found, "query_id"), gone, number)

    return queries.writeStream.foreachBatch(batch)


def live_queries(rows: DataFrame) -> DataFrame:
    """Queries that were never superseded, neither by a grown clause nor as orphans: an anti-join."""
    gone = rows.select("session_id", F.explode(F.coalesce("superseded", F.array().cast("array<string>"))).alias("query_id"))
    grown = rows.filter("row = 'query' AND parent IS NOT NULL").filter(F.split_part("parent", F.lit(".q"), F.lit(1)) == F.col("utterance_id")).select("session_id", F.col("parent").alias("query_id"))
    return rows.filter("row = 'query'").join(gone.union(grown), ["session_id", "query_id"], "left_anti")


def agreed(hypotheses: DataFrame) -> DataFrame:
    """Words committed after each hypothesis (session_id, seq, words): the longest prefix that two hypotheses in a row
    share, as a running maximum, since a commitment is never taken back. Batch form by windows."""
    by = Window.partitionBy("session_id").orderBy("seq")
    shared = F.coalesce(T.common_prefix(F.lag("words").over(by), F.col("words")), F.lit(0))
    counted = hypotheses.withColumn("agreed", shared)
    total = F.max("agreed").over(by.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.lag("committed").over(by), F.lit(0))
    return counted.withColumn("committed", total).withColumn("new", F.when(F.col("committed") > before, F.slice("words", before + 1, F.col("committed") - before)).otherwise(F.array().cast("array<string>")))


def flushed(hypotheses: DataFrame) -> DataFrame:
    """(session_id, committed, tail): the words committed by agreement, and those that the last hypothesis adds at the
    end, from where it departs from the committed ones; a revised tail is appended, never put in place."""
    steps = agreed(hypotheses).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", "new"))).alias("steps"), F.max_by("words", "seq").alias("last"))
    known = steps.withColumn("committed", F.flatten(F.transform("steps", lambda x: x.new)))
    shared = T.common_prefix(F.col("committed"), F.col("last"))
    return known.select("session_id", "committed", F.slice("last", shared + 1, F.size("last")).alias("tail"))


def decode_clock(arrived: Column, durations: Column) -> Column:
    """When each of a sequence of decodings ends, one after another: a fold of max(clock, arrival) + duration."""
    pairs = F.zip_with(arrived, durations, lambda a, d: F.struct(a.cast("double").alias("a"), d.cast("double").alias("d")))
    start = F.array().cast("array<double>")
    return F.aggregate(pairs, start, lambda acc, p: F.concat(acc, F.array(F.greatest(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)), p.a) + p.d)))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user and activity session: an extension for late data, with a watermark in streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
