"""Sessions made again from what a recogniser gave, and answer spans chosen from a reader's scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.operators import scans

AFTER_END_MS = 1  # an utterance ends this long after its last chunk
AFTER_CLOSE_MS = 2000  # and its session that long after it


def restreamed(chunks: DataFrame, hypotheses: DataFrame, width: int = scans.HOUR) -> DataFrame:
    """(session_id, seq, timestamp_ms, event_type, text, committed_ms): a session for each one with chunks, in the order it would be heard.
    chunks and hypotheses: (session_id, timestamp_ms, seq, text). The session starts at 0 before all else; hypotheses count while a chunk is
    still to come and only with a text, and come after a chunk of the same time; ``committed_ms`` is the time of the last chunk that a
    hypothesis could know, null where there was none. Sessions without chunks give nothing."""
    kept = ["session_id", "timestamp_ms", "seq", "text"]
    heard = chunks.select(*kept).filter("timestamp_ms IS NOT NULL")
    last = heard.groupBy("session_id").agg(F.max("timestamp_ms").alias("last"))
    open_ = hypotheses.select(*kept).filter("text <> ''").join(last, "session_id").filter("timestamp_ms < last").drop("last")
    known = scans.as_of(open_, heard.withColumn("chunk_ms", F.col("timestamp_ms")), ["session_id"], "timestamp_ms", "chunk_ms", "committed_ms", width)

    def mark(kind: str, at: Column, rank: int) -> Column:
        return F.struct(at.cast("long").alias("timestamp_ms"), F.lit(kind).alias("event_type"), F.lit(rank).alias("rank"))

    marks = F.array(mark("session_start", F.least(F.lit(0), "first"), 0), mark("utterance_end", F.col("last") + AFTER_END_MS, 3), mark("session_end", F.col("last") + AFTER_CLOSE_MS, 4))
    edges = heard.groupBy("session_id").agg(F.min("timestamp_ms").alias("first"), F.max("timestamp_ms").alias("last")).select("session_id", F.inline(marks))
    events = (
        heard.withColumns({"event_type": F.lit("transcript_chunk"), "rank": F.lit(1)})
        .unionByName(known.withColumns({"event_type": F.lit("transcript_hypothesis"), "rank": F.lit(2)}), allowMissingColumns=True)
        .unionByName(edges, allowMissingColumns=True)
    )
    placed = scans.numbered(events.withColumnRenamed("seq", "own"), ["session_id"], "timestamp_ms", ["timestamp_ms", "rank", "own", "text"], "seq", width)
    return placed.select("session_id", "seq", "timestamp_ms", "event_type", "text", "committed_ms")


def longest_prefix(texts: DataFrame, titles: DataFrame) -> DataFrame:
    """texts (..., text) with ``title_id``, ``title``: the longest title that the text begins with, null where there is none. titles: (title_id,
    title); of equal titles the least id counts, and null or empty ones begin nothing. Lengths are of code points.

    Titles are put under their first characters, as many as the shortest has; each such stem gives the lengths of its titles, one row a stem. A text meets
    its stem, then only prefixes of those lengths, and each prefix one title at most. So no pairs are made beside those, texts of a hot stem can be
    split over tasks, as one row stands on the other side. Texts aren't multiplied, hashes of their prefixes are, and of a text only its beginning, as
    long as the longest title, is shuffled to find it."""
    known = titles.filter("title <> ''").groupBy("title").agg(F.min("title_id").alias("title_id"))
    bounds = known.agg(F.min(F.char_length("title")), F.max(F.char_length("title"))).first()  # two numbers
    shortest, longest = (n or 1 for n in bounds)
    stem = lambda c: F.xxhash64(F.left(c, F.lit(shortest)))
    lengths = known.groupBy(stem(F.col("title")).alias("_stem")).agg(F.collect_set(F.char_length("title")).alias("_lengths"))
    hashed = F.transform(
        F.filter("_lengths", lambda n: n <= F.char_length("_head")),
        lambda n: F.struct(n.alias("n"), F.xxhash64(F.left("_head", n)).alias("h"), F.xxhash64(F.lit("check"), F.left("_head", n)).alias("g")),
    )
    own = texts.withColumns({"_text_key": F.xxhash64("text"), "_text_check": F.xxhash64(F.lit("check"), "text")})
    heads = own.filter("text IS NOT NULL").select("_text_key", "_text_check", F.left("text", F.lit(longest)).alias("_head"), stem(F.col("text")).alias("_stem"))
    tried = heads.join(lengths, "_stem").select("_text_key", "_text_check", F.inline(hashed))
    keyed = known.select(F.char_length("title").alias("n"), F.xxhash64("title").alias("h"), F.xxhash64(F.lit("check"), "title").alias("g"), "title", "title_id")
    best = tried.join(keyed, ["n", "h", "g"]).groupBy("_text_key", "_text_check").agg(F.max_by(F.struct("title", "title_id"), "n").alias("_best"))
    found = own.join(best, ["_text_key", "_text_check"], "left")
    return found.select(*texts.columns, F.col("_best.title_id").alias("title_id"), F.col("_best.title").alias("title"))


def _highest(scores: Column, top: int) -> Column:
    """(score, place) of the ``top`` highest scores of a passage's tokens, the earlier of equals; nulls, NaN and place 0, the no-answer token, are none."""
    told = F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("low"), i.alias("i")))
    fit = F.filter(told, lambda x: x.low.isNotNull() & ~F.isnan(x.low) & (x.i > 0))
    return F.slice(F.array_sort(fit), 1, top)


def best_spans(passages: DataFrame, longest: int = 30, top: int = 20) -> DataFrame:
    """(query_id, margin, score, passage, first, last) of passages (query_id, passage, starts, ends), arrays of one score a token, the
    token 0 standing for no answer. A span's score is its start's plus its end's; only the ``top`` starts and ends of a passage make spans,
    of ``longest`` tokens at most. Of a query's spans the best one counts, of equals that of the least passage, then the least first and last
    token; margin is its score less the least no-answer score of its passages. Queries without a span aren't given.

    A passage makes top x top spans inside its row, so no row is multiplied and a query's passages are aggregated before they are shuffled."""
    from_, to = _highest(F.col("starts"), top), _highest(F.col("ends"), top)
    spans = F.flatten(
        F.transform(
            F.col("from"),
            lambda s: F.transform(F.filter("to", lambda e: (e.i >= s.i) & (e.i < s.i + longest)), lambda e: F.struct((-s.low - e.low).alias("score"), (-s.i).alias("first"), (-e.i).alias("last"))),
        )
    )
    none = F.get("starts", F.lit(0)).cast("double") + F.get("ends", F.lit(0)).cast("double")
    rows = passages.select("query_id", "passage", none.alias("none"), from_.alias("from"), to.alias("to")).withColumn("b", F.array_max(spans))
    best = F.max_by(F.struct("passage", "b"), F.when(F.col("b").isNotNull(), F.struct("b.score", -F.col("passage"), "b.first", "b.last")))
    found = rows.groupBy("query_id").agg(F.min("none").alias("least"), best.alias("t")).filter("t.b IS NOT NULL")
    return found.select("query_id", (F.col("t.b.score") - F.col("least")).alias("margin"), F.col("t.b.score").alias("score"), F.col("t.passage").alias("passage"), (-F.col("t.b.first")).alias("first"), (-F.col("t.b.last")).alias("last"))
