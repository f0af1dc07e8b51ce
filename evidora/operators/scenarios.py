"""Scenarios made from questions: what users say, turn by turn, and what is expected of an engine.

Nothing is drawn at random: a hash of a seed and an item's key orders the items, so any number of partitions makes the same scenarios. A question is
used once. Questions of one document are put together first, as a compound of unrelated questions cannot be resolved; what a document leaves over
is put together across documents. Numbers in a long document, and those of the rest, are counted over blocks of the hash, so no task sorts them all.
A blank or null question is left out; of rows with one key the least text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.operators import scans
from evidora.sources import corpus

HASH_BITS = 48
BLOCK_BITS = 36  # 4,096 blocks of the hash's range

# What users say beside their questions. Each is of a kind that the controller's patterns know.
GREETINGS = ["Hi", "Hello", "Thanks", "Thank you", "Okay", "Good morning"]
LEADS = ["Actually,", "Wait, one more thing —", "Also,", "It turns out"]
ASKS = ["Please repeat your last answer in two bullets.", "Can you shorten that to one sentence?", "Summarize what you just said as three bullet points."]

TEMPLATES = ["multi_intent", "late_detail", "suppression", "chit_chat"]
EARLY_WORDS = 6


def draw(seed: int, *keys: str) -> Column:
    """A whole number of 48 bits from the MD5 of the seed and the keys; a null key counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def one_of(lines: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, lines)), (number % len(lines)).cast("int"))


def bottom(rows: DataFrame, strata: list[str], keys: list[str], k: int, seed: int = 0) -> DataFrame:
    """A sample of ``k`` rows of each stratum, or all of a smaller one: those of the least hashes, ties by keys. Each task keeps k before the shuffle."""
    by = Window.partitionBy(*strata).orderBy(draw(seed, *keys), *keys)
    return rows.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def matched(questions: DataFrame, doc: str, key: str, size: str, seed: int = 0, apart: tuple[str, ...] = ()) -> DataFrame:
    """questions with (group_doc, group_no, place): each in one group of ``size`` questions of its document, which is one number in a document;
    those that a document leaves over in groups across documents (group_doc is null), of the same size and of equal columns ``apart``, which are
    a document's too. Less than a group is left out."""
    width = 1 << BLOCK_BITS
    at = questions.withColumn("_at", draw(seed, key))
    own = scans.numbered(at, [doc], "_at", ["_at", key], "_i", width)
    total = questions.groupBy(F.struct(doc).alias("_of")).agg(F.count("*").alias("_n"))
    own = own.withColumn("_of", F.struct(doc)).join(total, "_of").drop("_of")
    whole = F.col("_i") < F.col("_n") - F.col("_n") % F.col(size)
    alone = scans.numbered(own.filter(~whole).drop("_i", "_n"), [*apart, size], "_at", ["_at", key], "_i", width)
    rest = alone.groupBy(*apart, size).agg(F.count("*").alias("_n"))
    alone = alone.join(rest, [*apart, size]).filter(F.col("_i") < F.col("_n") - F.col("_n") % F.col(size))
    put = lambda rows, of: rows.select(*questions.columns, of.alias("group_doc"), F.expr(f"_i div {size}").alias("group_no"), (F.col("_i") % F.col(size)).cast("int").alias("place"))
    return put(own.filter(whole), F.col(doc)).unionByName(put(alone, F.lit(None).cast(questions.schema[doc].dataType)))


def planned(questions: DataFrame, doc: str, key: str, text: str, seed: int = 0) -> DataFrame:
    """(doc, key, text, template, size): clean questions, with the template of their document and how many a scenario takes: two or three for
    multi_intent, as the document's hash says, two for late_detail, one for the others."""
    clean = questions.filter(F.trim(text) != "").groupBy(doc, key).agg(F.min(text).alias(text))
    number = draw(seed + 1, doc)
    template = one_of(TEMPLATES, number)
    several = F.when(template == "multi_intent", 2 + F.expr("_d div 4") % 2).when(template == "late_detail", 2).otherwise(1)
    return clean.withColumn("_d", number).select(doc, key, text, template.alias("template"), several.cast("int").alias("size"))


def turns(questions: DataFrame, doc: str, key: str, text: str, seed: int = 0) -> DataFrame:
    """(scenario_id, template, utterance_id, kind, text, gold, docs, retrieval_required, early) of all scenarios that the questions give.
    ``key`` names a question among all; a scenario is called after its template and its first question. ``gold`` are the questions that the turn asks,
    ``docs`` their documents; ``early`` says whether the turn is long enough that a search could start before its end."""
    plan = planned(questions, doc, key, text, seed)
    dealt = matched(plan, doc, key, "size", seed, ("template",))
    item = F.struct("place", F.col(text).alias("text"), F.col(key).alias("key"), F.col(doc).cast("string").alias("doc"))
    groups = dealt.groupBy("template", "size", F.struct("group_doc").alias("_of"), "group_no").agg(F.array_sort(F.collect_list(item)).alias("q"))  # three at most
    first = groups.withColumn("first_key", F.col("q")[0]["key"]).withColumn("_h", draw(seed + 2, "first_key"))
    texts, docs = F.transform("q", lambda x: x["text"]), F.transform("q", lambda x: x["doc"])
    none = F.array().cast("array<string>")

    def turn(name: str, kind: str, said: Column, gold: Column, of: Column, required: bool, opens: bool) -> Column:
        early = F.lit(opens) & (F.size(F.filter(F.split(said, r"\s+"), lambda w: w != "")) > EARLY_WORDS)
        return F.struct(F.lit(name).alias("utterance_id"), F.lit(kind).alias("kind"), said.alias("text"), gold.alias("gold"), of.alias("docs"), F.lit(required).alias("retrieval_required"), early.alias("early"))

    compound = F.concat(texts[0], F.lit(", "), F.array_join(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(1))), " and "))
    opening = turn("u1", "new_request", texts[0], F.slice(texts, 1, 1), F.slice(docs, 1, 1), True, True)
    detail = turn("u2", "refinement", F.concat_ws(" ", one_of(LEADS, F.col("_h")), F.get(texts, F.lit(1))), F.slice(texts, 2, 1), F.slice(docs, 2, 1), True, False)
    made = (
        F.when(F.col("template") == "multi_intent", F.array(turn("u1", "new_request", compound, texts, docs, True, True)))
        .when(F.col("template") == "late_detail", F.array(opening, detail))
        .when(F.col("template") == "suppression", F.array(opening, turn("u2", "presentation_only", one_of(ASKS, F.col("_h")), none, none, False, False)))
        .otherwise(F.array(turn("u1", "chit_chat", one_of(GREETINGS, F.col("_h")), none, none, False, False), turn("u2", "new_request", texts[0], F.slice(texts, 1, 1), F.slice(docs, 1, 1), True, True)))
    )
    named = F.concat_ws("_", F.lit("gen"), F.col("template"), F.col("first_key").cast("string")).alias("scenario_id")
    return first.select(named, "template", F.explode(made).alias("t")).select("scenario_id", "template", "t.*")


def events(turns_: DataFrame, words: int = 6, wpm: int = 150, pause: int = 300, gap: int = 1500) -> DataFrame:
    """Timed chunk events of (scenario_id, utterance_id, text): a turn starts ``gap`` ms after the end of the one before; a session starts at its first
    event and ends two seconds after its last."""
    spoken = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) * (60_000 // wpm) + pause + gap
    by = Window.partitionBy("scenario_id").orderBy("utterance_id").rowsBetween(Window.unboundedPreceding, -1)  # two turns
    timed = turns_.withColumn("start_ms", F.coalesce(F.sum(spoken).over(by), F.lit(0)))
    said = corpus.utterance_events(timed.withColumnRenamed("scenario_id", "session_id"), words, wpm, pause)
    edges = said.groupBy("session_id").agg(F.min("timestamp_ms").alias("a"), (F.max("timestamp_ms") + 2000).alias("b"))
    ends = edges.select("session_id", F.expr("stack(2, 'session_start', a, 'session_end', b) AS (event_type, timestamp_ms)"))
    return said.unionByName(ends, allowMissingColumns=True)
