"""Queries over single texts: tokens, sentences, chunks, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora import config as C
from evidora.functions import text as T
from evidora.plans import sql as S
from evidora.session import table
from evidora.sources import corpus

UTTERANCES = [
    (1, "I need the refund policy, the catering options, and parking"),
    (2, "What is the capacity of Venue B, and when was it built?"),
    (3, "Along with diesel engines, what engines have overtaken steam?"),
    (4, "hello there"),
    (5, "Thanks, that's all for today"),
    (6, "Can you repeat that in two bullets"),
    (7, "Summarize the travel reimbursement rule"),
    (8, "Actually, it was for forty people"),
    (9, "what does ABC stand for"),
    (10, "define IRQ"),
    (11, "shorten it please"),
    (12, "tl;dr"),
    (13, "tell me about the"),
    (14, "In 1905 the committee approved twelve million"),
    (15, "the museum in Paris and"),
    (16, ""),
    (17, "it's on that day, the former one"),
    (18, "Give me the last answer in 3 short sentences"),
    (19, "ok great"),
    (20, "What disease did Tesla catch?"),
]


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): authored English utterances, and user turns, whose words are invented."""
    own = spark.createDataFrame(UTTERANCES, "id long, text string")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.unionByName(turns)


UTTERANCES_SQL = S.values("own", "id, text", UTTERANCES) + ", u AS (SELECT CAST(id AS BIGINT) AS id, text FROM own UNION ALL SELECT 1000 + conv_id * 100 + turn, coalesce(text, '') FROM conversations WHERE role = 'user')"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"), T.content(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("c").cast("long").alias("n_content"), F.size(F.array_distinct("c")).cast("long").alias("n_distinct"), T.token_estimate(F.array_join("t", " ")).alias("estimate"))


def content_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("lang", F.size(T.content(F.col("text"))).alias("n"), F.get(T.bigrams(T.content(F.col("text"))), F.lit(0)).alias("b"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_content"), F.max("n").cast("long").alias("longest"), F.countDistinct("b").alias("n_openings"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def factual_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", F.round(T.factual_density(F.col("text")), 6).alias("density"))


TERMS = ["ABC", "IRQ", "GB", "BY"]


def definitional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the authored questions, and whether texts define a few terms."""
    asked = spark.createDataFrame(UTTERANCES, "id long, text string").select("id", T.definitional_target(F.col("text")).alias("target"), F.lit(False).alias("defined"))
    texts = docs_of(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" Active Border Control (ABC) and irq (interrupt request)")).alias("text"), F.explode(F.array(*map(F.lit, TERMS))).alias("target"))
    return asked.unionByName(texts.select((F.col("id") + 1000).alias("id"), "target", T.definitional_match(F.col("target"), F.col("text")).alias("defined")))


def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.array(F.substring_index("text", " ", 3), F.lit("The"), F.lit("zzz")).alias("answers"))
    return rows.select("item_id", T.normal_answer(F.col("text")).alias("normal"), T.has_answer(F.col("text"), F.col("answers")).alias("found"), F.size(T.informative(F.col("answers"), F.substring("text", 1, 40))).cast("long").alias("n_informative"))


def turn_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    kind = F.when(T.is_chit_chat(text), "chit_chat").when(T.is_presentation(text), "presentation_only").otherwise("new_request")
    return utterances(spark, sf_dir).select("id", kind.alias("kind"), T.is_refinement_cue(text).alias("refines"), T.opens_question(text).alias("question"), T.needs_context(text).alias("needs_context"), T.intent_label(text).alias("label"))


def clause_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return utterances(spark, sf_dir).select("id", T.clean_clause(text).alias("clean"), T.strip_discourse(text).alias("stripped"), T.self_contained(text).alias("self_contained"), T.ends_mid_thought(text).alias("dangling"))


def running_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text so far at each chunk of each user turn."""
    from pyspark.sql import Window

    events = chunk_events(spark, sf_dir).filter("event_type = 'transcript_chunk'")
    by = Window.partitionBy("session_id", "utterance_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("session_id", "utterance_id", "seq", F.array_join(F.collect_list("text").over(by), "").alias("so_far"))


def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    named = turns.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("utterance_id"), (F.col("turn") * 100_000).alias("start_ms"), F.coalesce("text", F.lit("")).alias("text"))
    return corpus.utterance_events(named)


def chunk_utterance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_events(spark, sf_dir).select("session_id", "utterance_id", "seq", "timestamp_ms", "event_type", "text")


EVENTS_SQL = r"""
t AS (SELECT 's' || conv_id AS session_id, 'u' || turn AS utterance_id, turn * 100000 AS start_ms,
  list_filter(regexp_split_to_array(coalesce(min(text), ''), '\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
c AS (SELECT *, unnest(range(0, len(w), 6)) AS i FROM t),
e AS (
  SELECT session_id, utterance_id, CAST(i // 6 AS INTEGER) AS seq, start_ms + i * 400 AS timestamp_ms, 'transcript_chunk' AS event_type,
    CASE WHEN i > 0 THEN ' ' ELSE '' END || array_to_string(w[i + 1:i + 6], ' ') AS text FROM c
  UNION ALL
  SELECT session_id, utterance_id, CAST((len(w) + 5) // 6 AS INTEGER), start_ms + CASE WHEN len(w) > 0 THEN len(w) * 400 + 300 ELSE 0 END, 'utterance_end', NULL FROM t)"""


def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir, T.stability)


def stability_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir, T.stability_model)


def _stability(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    from pyspark.sql import Window

    so_far = running_transcript(spark, sf_dir)
    before = F.coalesce(F.lag("so_far").over(Window.partitionBy("session_id", "utterance_id").orderBy("seq")), F.lit(""))
    turns = so_far.select(F.concat_ws("/", "session_id", "utterance_id", F.col("seq").cast("string")).alias("id"), F.col("so_far").alias("text"), before.alias("previous"))
    own = spark.createDataFrame([(f"own/{i}", x, "") for i, x in UTTERANCES], "id string, text string, previous string")
    never = F.lit(False)
    return turns.unionByName(own).select("id", F.round(rule(F.trim("text"), F.col("previous"), never, never, never), 6).alias("score"))


def _stability_sql(model: bool) -> str:
    own = S.content("x")
    strong = r"(regexp_matches(x, '\b\d+\b') OR len(list_filter(regexp_split_to_array(trim(x), '\s+')[2:], lambda w: regexp_matches(trim(w, '.,;:'), '^[A-Z][a-z]{2,}$'))) > 0)"
    weak = f"len({own}) >= 4"
    bare = "rtrim(regexp_replace(trim(x), ',+$', ''))"
    last = f"lower(list_last(regexp_extract_all({bare}, '[A-Za-z'']+')))"
    dangling = f"CASE WHEN {bare} = '' THEN true WHEN regexp_matches({bare}, '[.!?]$') THEN false ELSE coalesce(list_contains({S.words(C.DANGLING)}, {last}), true) END"
    settled = f"(p <> '' AND len(list_filter({own}, lambda y: NOT list_contains({S.content('p')}, y))) = 0)"
    if model:
        words = r"list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')"
        opener = f"len(list_filter({words}[1:3], lambda w: list_contains({S.words(C.QUESTION_WORDS)}, lower(trim(w, '?,.!;:'))))) > 0"
        values = [strong, "false", "false", weak, dangling, settled, f"least(len({own}) / 8.0, 2.0)", f"least(len({words}) / 20.0, 2.0)", opener, "ends_with(x, '?')"]
        z = " + ".join([str(C.STABILITY_BIAS), *(f"{w} * CAST({v} AS DOUBLE)" for w, v in zip(C.STABILITY_WEIGHTS, values, strict=True))])
        score = f"1 / (1 + exp(-greatest(-30.0, least(30.0, {z}))))"
    else:
        score = f"least(1.0, CASE WHEN {strong} THEN 0.5 WHEN {weak} THEN 0.25 ELSE 0.0 END + CASE WHEN NOT ({dangling}) THEN 0.3 ELSE 0.0 END + CASE WHEN {settled} OR len({own}) >= 5 THEN 0.2 ELSE 0.0 END)"
    return f"""WITH {EVENTS_SQL},
r AS (SELECT session_id, utterance_id, seq, string_agg(text, '' ORDER BY seq) OVER (PARTITION BY session_id, utterance_id ORDER BY seq) AS so_far FROM e WHERE event_type = 'transcript_chunk'),
{S.values("own", "id, text", UTTERANCES)},
q AS (SELECT session_id || '/' || utterance_id || '/' || seq AS id, trim(so_far) AS x, coalesce(lag(so_far) OVER (PARTITION BY session_id, utterance_id ORDER BY seq), '') AS p FROM r
  UNION ALL SELECT 'own/' || id, trim(text), '' FROM own)
SELECT id, round(CASE WHEN x = '' THEN 0.0 ELSE {score} END, 6) AS score FROM q"""


MARKDOWN = [
    ("Doc_7_notes.md", "---\ndoc_id: Doc_7\ntitle: Storage: rules\n---\n# Storage\nDropped preamble.\n## §2 Limits\nDisks hold 10 TB. Nobody may exceed it.\n## Backups\nKept for 30 days.\n"),
    ("Doc_8_plain.md", "No front matter here. One section only."),
    ("other.txt", "---\ntitle: Empty\n---\n## §a.1 First\n\n## §a.2 Second\nText of the second.\n"),
]


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(n, k + 1, r) for k, (n, r) in enumerate(MARKDOWN)], "name string, ord int, raw string")
    return corpus.parse_sections(raw).select("ord", F.col("doc_id"), "section", "heading", "doc_title", "text")


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.passages(table(spark, sf_dir, "pages"))
    return found.select(F.col("ord").alias("page_id"), F.length("title").cast("long").alias("title_chars"), F.md5(F.col("heading").cast("binary")).alias("heading"), F.length("text").cast("long").alias("text_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_PLAIN = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", F.posexplode(corpus.pack_sentences(T.sentences(F.col("text")))).alias("at", "group"))
    return rows.select("doc_id", (F.col("at") + 1).alias("n"), F.size("group").cast("long").alias("n_sentences"), F.md5(F.array_join("group", " ").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (
    tokenize_counts, content_token_stats, sentence_split, factual_density, definitional_match, answer_normalize, turn_classification, clause_cleaning,
    running_transcript, chunk_utterance, stability_score, stability_model, doc_sections, html_sections, chunk_sentences,
)}

_D = "d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)"
_WORDS = r"regexp_extract_all(lower({}), '[a-z0-9'']+')"
_PRESENT = _WORDS.format("replace(lower(text), 'tl;dr', 'tldr')")
_KNOWN = S.words([*C.STOPWORDS, *C.FORMAT_CUES, *C.ANAPHORA, *C.PRESENTATION_FILLER])


def _rx(pattern: str) -> str:
    return S.quoted("(?i)" + pattern)


_BARE = "rtrim(regexp_replace(trim(text), ',+$', ''))"

ORACLES = {
    "tokenize_counts": f"WITH {_D}, x AS (SELECT doc_id, {S.tokens('text')} AS t, {S.content('text')} AS c FROM d) SELECT doc_id, len(t) AS n_tokens, len(c) AS n_content, len(list_distinct(c)) AS n_distinct, greatest(1, length(array_to_string(t, ' ')) // 4) AS estimate FROM x",
    "content_token_stats": f"WITH {_D}, x AS (SELECT lang, {S.content('text')} AS c FROM d) SELECT lang, count(*) AS n_docs, CAST(sum(len(c)) AS BIGINT) AS n_content, max(len(c)) AS longest, count(DISTINCT CASE WHEN len(c) > 1 THEN c[1] || ' ' || c[2] END) AS n_openings FROM x GROUP BY lang",
    "sentence_split": f"WITH {_D}, x AS (SELECT doc_id, {S.sentences('text')} AS s FROM d) SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda y: length(y))) AS longest, md5(array_to_string(s, '|')) AS digest FROM x",
    "factual_density": f"WITH {_D}, x AS (SELECT doc_id, text, {S.content('text')} AS c FROM d) SELECT doc_id, round({S.density('text', 'c')}, 6) AS density FROM x",
    "definitional_match": f"""WITH {_D}, {S.values("own", "id, text", UTTERANCES)},
m AS (SELECT id, regexp_extract(text, {_rx(C.DEFINITIONAL)}, ['a', 'b', 'c']) AS g FROM own)
SELECT CAST(id AS BIGINT) AS id, coalesce(nullif(g.a, ''), nullif(g.b, ''), nullif(g.c, '')) AS target, false AS defined FROM m
UNION ALL
SELECT doc_id + 1000, target, regexp_matches(text || ' Active Border Control (ABC) and irq (interrupt request)', '(?i)(?:\\([^()]*\\b' || target || '\\b[^()]*\\))|(?:\\b' || target || '\\b\\s*\\([^()]*\\))')
FROM d, (SELECT unnest({S.words(TERMS)}) AS target)""",
    "answer_normalize": f"""WITH x AS (SELECT item_id, text, [array_to_string(string_split(text, ' ')[1:3], ' '), 'The', 'zzz'] AS a FROM benchmark),
y AS (SELECT *, {S.normal_answer('text')} AS normal, {S.normal_answer('substring(text, 1, 40)')} AS head, list_filter(list_transform(a, lambda v: {S.normal_answer('v')}), lambda v: v <> '') AS n FROM x)
SELECT item_id, normal, len(list_filter(n, lambda v: contains(' ' || normal || ' ', ' ' || v || ' '))) > 0 AS found, len(list_filter(n, lambda v: NOT contains(' ' || head || ' ', ' ' || v || ' '))) AS n_informative FROM y""",
    "turn_classification": f"""WITH {UTTERANCES_SQL}, w AS (SELECT id, text, {_WORDS.format('text')} AS cw, {_PRESENT} AS w, {S.content('text')} AS c FROM u),
x AS (SELECT *, list_filter(w, lambda v: NOT list_contains({S.words(C.SKIPPED_LEADERS)}, v))[1] AS leader FROM w)
SELECT id, CASE
  WHEN len(cw) > 0 AND len(list_filter(cw, lambda v: NOT list_contains({S.words(C.CHITCHAT_WORDS)}, v))) = 0 AND len(list_filter(cw, lambda v: list_contains({S.words(C.CHITCHAT_STRONG + C.CHITCHAT_WEAK)}, v))) > 0 THEN 'chit_chat'
  WHEN len(list_filter(w, lambda v: list_contains({S.words(C.FORMAT_CUES)}, v))) > 0
    AND len(list_filter(w, lambda v: NOT list_contains({_KNOWN}, v) AND NOT regexp_matches(v, '^\\d+$') AND length(v) > 1)) = 0
    AND (len(list_filter(w, lambda v: list_contains({S.words(C.ANAPHORA)}, v))) > 0 OR coalesce(list_contains({S.words(C.LEADING_VERBS)}, leader), false) OR regexp_matches(text, {_rx(C.QUANTIFIED_FORMAT)})) THEN 'presentation_only'
  ELSE 'new_request' END AS kind,
  regexp_matches(text, {_rx(C.REFINEMENT)}) AS refines, regexp_matches(trim(text), {_rx(C.QUESTION_START)}) AS question,
  regexp_matches(ltrim(text), {_rx(C.NEEDS_CONTEXT)}) AS needs_context,
  CASE WHEN len(c) > 0 THEN array_to_string(c[1:3], ' ') ELSE substring(text, 1, 30) END AS label FROM x""",
    "clause_cleaning": f"""WITH {UTTERANCES_SQL}
SELECT id, trim(regexp_replace(trim(regexp_replace(trim(trim(text), '.,;:'), {_rx(C.LEAD_FILLER)}, '')), {_rx(C.ARTICLE_LEAD)}, '')) AS clean,
  trim(regexp_replace(trim(text), {_rx(C.DISCOURSE)}, '')) AS stripped,
  regexp_matches(trim(text), {_rx(C.QUESTION_START)}) AND len({S.content('text')}) >= 2 AS self_contained,
  CASE WHEN {_BARE} = '' THEN true WHEN regexp_matches({_BARE}, '[.!?]$') THEN false ELSE coalesce(list_contains({S.words(C.DANGLING)}, lower(list_last(regexp_extract_all({_BARE}, '[A-Za-z'']+')))), true) END AS dangling
FROM u""",
    "running_transcript": f"WITH {EVENTS_SQL} SELECT session_id, utterance_id, seq, string_agg(text, '' ORDER BY seq) OVER (PARTITION BY session_id, utterance_id ORDER BY seq) AS so_far FROM e WHERE event_type = 'transcript_chunk'",
    "chunk_utterance": f"WITH {EVENTS_SQL} SELECT * FROM e",
    "stability_score": _stability_sql(False),
    "stability_model": _stability_sql(True),
    "doc_sections": "WITH " + S.values("v", "ord, doc_id, section, heading, doc_title, text", [(1, "Doc_7", "2", "Limits", "Storage: rules", "Disks hold 10 TB. Nobody may exceed it."), (1, "Doc_7", "2", "Backups", "Storage: rules", "Kept for 30 days."), (2, "Doc_8", "1", "", "", "No front matter here. One section only."), (3, "other", "a.1", "First", "Empty", ""), (3, "other", "a.2", "Second", "Empty", "Text of the second.")]) + " SELECT * FROM v",
    "html_sections": f"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
p AS (SELECT page_id, h, list_filter(list_transform(string_split(regexp_replace(h, '(?s)<p>|</p>|</article>', chr(1) || '\\0', 'g'), chr(1)), lambda x: CASE WHEN starts_with(x, '<p>') THEN {_PLAIN.format('substring(x, 4)')} ELSE '' END), lambda x: x <> '') AS ps FROM a)
SELECT page_id, length({_PLAIN.format("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")}) AS title_chars, md5({_PLAIN.format("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")}) AS heading,
  length(array_to_string(ps, ' ')) AS text_chars, md5(array_to_string(ps, ' ')) AS digest FROM p""",
    "chunk_sentences": f"""WITH RECURSIVE {_D}, s AS (SELECT doc_id, {S.sentences('text')} AS s FROM d),
g(doc_id, i, n, size, s) AS (
  SELECT doc_id, 1, 1, length(s[1]), s FROM s WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN size + length(s[i + 1]) > 600 THEN n + 1 ELSE n END,
    CASE WHEN size + length(s[i + 1]) > 600 THEN length(s[i]) ELSE size END + length(s[i + 1]), s FROM g WHERE i < len(s)),
m AS (SELECT doc_id, n, i, s[i] AS x FROM g UNION ALL
  SELECT a.doc_id, a.n + 1, a.i, a.s[a.i] FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND b.n = a.n + 1)
SELECT doc_id, n, count(*) AS n_sentences, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM m GROUP BY doc_id, n""",
}
