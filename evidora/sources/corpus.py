"""Sources: document folders, chunks, events, traces, relevance rows; and sinks.

Every reader goes through Spark's own readers, so any store that Spark can read will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.functions import text as T

ENVELOPE = "timestamp_ms long, event_type string, payload struct<session_id:string,utterance_id:string,text:string>"
TRACE = (
    "event string, ts_ms double, wall_ms double, session_id string, utterance_id string, component string, text_len int, is_final boolean, "
    "decision string, turn_kind string, reason string, stability double, n_sub_queries int, decision_latency_ms double, query_ids array<string>, "
    "queries array<string>, trigger string, request_id string, mode string, latency_ms double, chunk_ids array<string>, low_confidence_query_ids array<string>, "
    "version int, parent_version int, change_kind string, citations array<string>, n_claims int, retriever_calls_for_version int, n_supported int, "
    "fabricated_citations array<string>, unsupported_intents string, purpose string, model string, tokens_in long, tokens_out long, cost_usd double, "
    "kind string, error_type string, message string"
)
QRELS = "query string, relevant array<string>, answers array<string>, kind string"
EVENT_TYPES = ("session_start", "transcript_chunk", "transcript_hypothesis", "utterance_end", "session_end")
SKIPPED = r"(?i)^(readme|license|licence|source|notice)\b"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, raw) of all .md and then all .txt files below a folder, in path order, but for notes."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    named = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name")).filter(~F.col("name").rlike(SKIPPED))
    by = Window.orderBy(F.when(F.col("name").endswith(".md"), 0).otherwise(1), "path")
    numbered = named.select("path", F.when(F.col("name").endswith(".md"), 0).otherwise(1).alias("kind"), "name").withColumn("ord", F.row_number().over(by))
    return named.join(numbered.select("path", "ord"), "path").select("path", "name", "ord", F.col("value").alias("raw"))


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(map of its lines, body); the first colon of a line ends the key, and later lines win."""
    head = F.regexp_extract(raw, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p: F.lit(True))
    meta = F.aggregate(last, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p.k), F.create_map(p.k, p.v)))
    return meta, F.regexp_replace(raw, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def parse_sections(docs: DataFrame) -> DataFrame:
    """(ord, doc_id, section, heading, doc_title, text) of raw documents (ord, name, raw). Headings are '## §n title'; text before
    the first is dropped, a heading without a number takes its place, and a document without headings is one section."""
    meta, body = front_matter(F.col("raw"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    own_id = F.coalesce(F.nullif(F.col("meta")["doc_id"], F.lit("")), F.nullif(F.regexp_extract(stem, r"^(Doc_\w+?)(?:_|$)", 1), F.lit("")), stem)
    read = docs.select("ord", "name", meta.alias("meta"), body.alias("body")).select("ord", own_id.alias("doc_id"), F.coalesce(F.col("meta")["title"], F.lit("")).alias("title"), "body")
    parts = F.slice(F.split("body", r"(?m)^(?=##\s)"), 1, 2**31 - 1)
    heads = F.filter(parts, lambda x: x.rlike(r"\A##\s"))
    cut = read.select("*", heads.alias("heads"))
    one = cut.filter(F.size("heads") == 0).select("ord", "doc_id", F.lit(1).alias("place"), F.lit("1").alias("section"), F.col("title").alias("heading"), F.lit("").alias("doc_title"), F.trim(F.btrim("body", F.lit(" \n\t\r"))).alias("text"))
    many = cut.filter(F.size("heads") > 0).select("ord", "doc_id", "title", F.posexplode("heads").alias("at", "part"))
    line = r"\A##\s+(?:§\s*([\w.]+)\s+)?([^\n]*)"
    several = many.select(
        "ord", "doc_id", (F.col("at") + 1).alias("place"),
        F.coalesce(F.nullif(F.regexp_extract("part", line, 1), F.lit("")), (F.col("at") + 1).cast("string")).alias("section"),
        F.trim(F.regexp_extract("part", line, 2)).alias("heading"), F.col("title").alias("doc_title"), F.btrim(F.regexp_replace("part", r"\A[^\n]*\n?", ""), F.lit(" \n\t\r")).alias("text"),
    )
    return one.unionByName(several)


def pack_sentences(sentences: Column, max_chars: int = 600, overlap: int = 1) -> Column:
    """Groups of sentences: a group is closed before the sentence that would take it beyond max_chars (lengths
    of sentences only), and the next one starts with its last ``overlap`` sentences. No sentence is split."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

    def add(acc: Column, s: Column) -> Column:
        full = (F.size(acc.now) > 0) & (acc.size + F.length(s) > max_chars)
        carried = F.slice(acc.now, F.greatest(F.size(acc.now) - overlap + 1, F.lit(1)), overlap) if overlap else F.array().cast("array<string>")
        size = F.aggregate(carried, F.lit(0), lambda n, x: n + F.length(x))
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.now))).otherwise(acc.done).alias("done"),
            F.concat(F.when(full, carried).otherwise(acc.now), F.array(s)).alias("now"),
            (F.when(full, size).otherwise(acc.size) + F.length(s)).alias("size"),
        )

    return F.aggregate(sentences, start, add, lambda acc: F.when(F.size(acc.now) > 0, F.concat(acc.done, F.array(acc.now))).otherwise(acc.done))


def chunks(sections: DataFrame, max_chars: int = 600, overlap: int = 1) -> DataFrame:
    """One row per chunk of parsed sections. chunk_ord orders chunks by document and place in it: numbers are counted
    in each document and leave gaps between documents, so that no task orders all chunks."""
    packed = sections.filter("text <> ''").select("*", F.posexplode(pack_sentences(T.sentences(F.col("text")), max_chars, overlap)).alias("at", "group")).drop("text")
    n = F.col("at") + 1
    label = T.citation(F.col("doc_id"), F.col("section"))
    made = packed.select("ord", "place", "doc_id", "section", "heading", "doc_title", n.alias("n"), F.array_join("group", " ").alias("text"), label.alias("citation"), F.concat(label, F.lit(" #"), n.cast("string")).alias("chunk_id"))
    within = F.row_number().over(Window.partitionBy("ord").orderBy("place", "n"))
    return made.withColumn("chunk_ord", F.col("ord") * F.lit(1 << 32) + within)


def load_corpus(spark: SparkSession, path: str, max_chars: int = 600) -> DataFrame:
    return chunks(parse_sections(read_folder(spark, path)), max_chars)


def passages(pages: DataFrame) -> DataFrame:
    """(ord, title, heading, text) of HTML pages: the h1 and the paragraphs of the article, without tags."""
    article = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    paragraphs = F.filter(F.transform(F.regexp_extract_all(article, F.lit(r"(?s)<p>(.*?)(?=<p>|</p>|</article>|$)"), F.lit(1)), plain), lambda x: x != "")
    return pages.select(F.col("page_id").alias("ord"), plain(F.regexp_extract(article, r"(?s)<title>(.*?)</title>", 1)).alias("title"), plain(F.regexp_extract(article, r"(?s)<h1>(.*?)</h1>", 1)).alias("heading"), F.array_join(paragraphs, " ").alias("text"))


def utterance_events(utterances: DataFrame, words: int = 6, wpm: int = 150, pause: int = 300) -> DataFrame:
    """Timed chunk events of (session_id, utterance_id, start_ms, text): a chunk every ``words`` words, later ones with
    a leading blank, and the end after a pause; a blank utterance is its end alone."""
    own = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    cut = utterances.select("session_id", "utterance_id", "start_ms", own.alias("w")).withColumn("n", F.size("w"))
    per = 60_000 // wpm
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(words))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.struct((F.col("start_ms") + i * per).cast("long").alias("timestamp_ms"), F.lit("transcript_chunk").alias("event_type"), F.concat(F.when(i > 0, " ").otherwise(""), F.array_join(F.slice("w", i + 1, words), " ")).alias("text")))
    end = F.struct((F.col("start_ms") + F.when(F.col("n") > 0, F.col("n") * per + pause).otherwise(0)).cast("long").alias("timestamp_ms"), F.lit("utterance_end").alias("event_type"), F.lit(None).cast("string").alias("text"))
    return cut.select("session_id", "utterance_id", F.posexplode(F.concat(parts, F.array(end))).alias("seq", "e")).select("session_id", "utterance_id", "seq", "e.*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Envelope events of scenario files. The schema is the firewall: gold labels are never read."""
    files = spark.read.schema(f"scenario_id string, template string, events array<struct<{ENVELOPE.replace(' long', ':long').replace(' string', ':string').replace(' struct', ':struct')}>>").json(path, multiLine=True)
    return files.select("scenario_id", F.posexplode("events").alias("seq", "e")).select("scenario_id", "seq", "e.timestamp_ms", "e.event_type", "e.payload.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    turn = "struct<kind:string,retrieval_required:boolean,eligible_for_early_retrieval:boolean,gold_sub_intents:array<string>,expected_citation_docs:array<string>,expect_uncertainty:boolean>"
    files = spark.read.schema(f"scenario_id string, ground_truth struct<turns:map<string,{turn}>>").json(path, multiLine=True)
    return files.select("scenario_id", F.explode("ground_truth.turns").alias("utterance_id", "t")).select("scenario_id", "utterance_id", "t.*")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path).filter(F.col("event").isNotNull())


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each query text, by file and place in it."""
    rows = spark.read.schema(QRELS).json(path).select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    return rows.filter(F.col("query").isNotNull()).groupBy("query").agg(F.min_by(F.struct("relevant", "answers", "kind"), "place").alias("r")).select("query", "r.*")


def doc_titles(docs: DataFrame) -> DataFrame:
    """(doc_id, title) from front matter within the first 500 characters."""
    head = F.substring("raw", 1, 500)
    found = docs.select(F.regexp_extract(head, r"(?m)^doc_id:\s*(\S+)", 1).alias("doc_id"), F.trim(F.regexp_extract(head, r"(?m)^title:\s*(.+)$", 1)).alias("title"))
    return found.filter("doc_id <> '' AND title <> ''")


def routed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters with a reason); an event never stops a stream."""
    reason = F.when(F.col("event_type").isNull() | F.col("timestamp_ms").isNull(), "malformed").when(~F.col("event_type").isin(*EVENT_TYPES), "unknown event type")
    marked = events.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def corpus_from_contexts(rows: DataFrame) -> DataFrame:
    """Sections (title, section, text) of question rows (ord, title, context): the contexts of a title, once
    each, numbered in the order in which they came first."""
    first = rows.groupBy("title", "context").agg(F.min("ord").alias("first"))
    return first.select("title", F.dense_rank().over(Window.partitionBy("title").orderBy("first")).cast("string").alias("section"), F.col("context").alias("text"))


def fingerprint(texts: DataFrame) -> DataFrame:
    """A key for cached index tables, of content and order: changes with any text."""
    return texts.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), F.sum(F.xxhash64("ord", "text").cast("decimal(20,0)")).cast("string")), 256).alias("fingerprint"))


def cached_table(df: DataFrame, root: str, key: str) -> DataFrame:
    """``df`` kept as Parquet below root under a key: computed once, read afterwards."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{key}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
