"""URL filter: fixed rules, and for what no rule decides a naive Bayes classifier over words of segmented hosts and of paths.

Parts of a url: the host is what stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; the path goes on
to the next ``?`` or ``#``. A rule (host, start of path) fits its host and all its subdomains; the longest rule wins, of equally long
ones the first.

Segmentation: runs of letters in hosts, such as ``cheappills``, are split into words by the Viterbi path of a unigram model. The
model counts the words of all pages' visible text, and those of host labels that hyphens or digits part into several (a label in one run may be
a concatenation itself). Nothing of it is held whole: each distinct run is exploded into its substrings of ``MAX_WORD`` letters at most, these are joined to the counts, and the
best path is found over the substrings that are words. A stretch that no word covers costs as much as a word seen never, the more
the longer (the usual 10 / (N 10**length)); ties go to fewer, then to longer last words. Costs are integers, so that ties are the same
everywhere. Runs of over ``MAX_RUN`` letters, which no host name can have, stay whole.

Classifier: multinomial, over words of the segmented host (``h:``) and of the path (``p:``, digits as ``#``), hashed to 2**BITS places,
so that the model has the same size whatever the corpus. No page is labelled, so the labels are made: a page of whose host some word is in ``seeds`` counts as
an example to block, any other as one to allow, as is usual for learning from positive and unlabelled examples; what seeds share hosts and paths with is learned
from that. Additive smoothing is shared out by the classes' sizes, which keeps rare words neutral where one class is small.
A page is blocked if the log odds exceed ``threshold``.

Edge cases: a null url and one without ``://`` have an empty host and path and no rule; a url without words is judged by the prior alone; without any example of a
class all is allowed. Repeated rows and ids are judged each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import written
from evidora.session import table

MAX_WORD, MAX_RUN = 24, 63
BITS = 18
SMOOTH = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of trades whose pages filters block.
SEEDS = "ads adult bet bets betting bingo casino escort gambling jackpot lottery malware payday phishing pills poker porn sex slots spam viagra warez xxx".split()

#: Fixed values of the query: (host, start of path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are looked up by each suffix of the host, so that their number costs nothing;
    they are held in the plan, tens of thousands at most."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[Column]] = {}
    for k, (h, p, verdict) in enumerate(rules):
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("size"), F.lit(-k).alias("order"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    held = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(held, s)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def runs(host: Column) -> Column:
    """The runs of letters of a host."""
    return F.regexp_extract_all(host, F.lit(r"(\p{L}+)"), 1)


def path_words(path: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.concat(F.lit("p:"), F.regexp_replace(w, r"\p{N}+", "#")))


def visible(html: Column) -> Column:
    return F.regexp_replace(F.lower(html), r"(?s)<[^>]*>", " ")


def word_counts(pages: DataFrame, host: str, html_col: str | None) -> DataFrame:
    """(word, n) over the visible texts and the hosts of all pages."""
    several = F.filter(F.transform(F.split(host, r"\."), runs), lambda own: F.size(own) > 1)
    words = F.flatten(several)
    if html_col:
        words = F.concat(words, F.regexp_extract_all(visible(F.coalesce(html_col, F.lit(""))), F.lit(r"(\p{L}+)"), 1))
    return pages.select(F.explode(words).alias("word")).filter(F.char_length("word") <= MAX_WORD).groupBy("word").agg(F.count("*").alias("n"))


def word_cost(n: int, total: int) -> int:
    """Thousandths of a nat."""
    return round(1000 * (math.log(total) - math.log(n)))


def unknown_cost(length: int, total: int) -> int:
    return round(1000 * (math.log(total) + (length - 1) * math.log(10)))


def split_run(run: str, words: dict[tuple[int, int], int], total: int) -> list[str]:
    """The cheapest words of a run. words: count by (start, length)."""
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # cost, words, start of the last one
    for end in range(1, len(run) + 1):
        ways = []
        for start in range(end):
            n = words.get((start, end - start))
            cost = word_cost(n, total) if n else unknown_cost(end - start, total)
            ways.append((best[start][0] + cost, best[start][1] + 1, start))
        best.append(min(ways))
    out, end = [], len(run)
    while end:
        start = best[end][2]
        out.append(run[start:end])
        end = start
    return out[::-1]


def segmented(hosts: DataFrame, host: str, counts: DataFrame, total: int) -> DataFrame:
    """(run, words) of each distinct run of letters in the hosts."""
    distinct = hosts.select(F.explode(runs(F.col(host))).alias("run")).distinct()
    fit = distinct.filter(F.char_length("run") <= MAX_RUN)
    lengths = F.sequence(F.lit(1), F.least(F.char_length("run") - F.col("start"), F.lit(MAX_WORD)))
    places = fit.select("run", F.explode(F.sequence(F.lit(0), F.char_length("run") - 1)).alias("start")).select("run", "start", F.explode(lengths).alias("length"))
    parts = places.select("run", "start", "length", F.substring("run", F.col("start") + 1, F.col("length")).alias("word"))
    # a run has at most MAX_RUN x MAX_WORD substrings
    found = parts.join(counts, "word").groupBy("run").agg(F.collect_list(F.struct("start", "length", "n")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            own = [split_run(r, {(x["start"], x["length"]): x["n"] for x in w or ()}, total) if len(r) <= MAX_RUN else [r] for r, w in zip(names, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.string()))], names=["run", "words"])

    return distinct.join(found, "run", "left").select("run", "words").mapInArrow(run, "run string, words array<string>")


def host_words(hosts: DataFrame, host: str, split: DataFrame) -> DataFrame:
    """(host, words) of each distinct host, in order."""
    distinct = hosts.select(host).distinct()
    rows = distinct.select(host, F.posexplode(runs(F.col(host))).alias("at", "run")).join(split, "run")
    own = rows.groupBy(host).agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("own"))
    return own.select(host, F.flatten(F.transform("own", lambda x: x["words"])).alias("words"))


def log_odds(counts: Sequence[tuple[int, int, int]], size: int, smooth: float = SMOOTH) -> tuple[np.ndarray, float]:
    """(weight of each place, weight of all words) from (place, examples to allow, examples to block), both counting words.

    With additive smoothing of ``smooth`` x the class's share of all words, P(word | class) is
    (n + smooth x share) / (N (1 + smooth places / all words)), whose last factor is the same for both classes."""
    allow, block = np.zeros(size), np.zeros(size)
    for place, a, b in counts:
        allow[place], block[place] = a, b
    share = block.sum() / max(1.0, allow.sum() + block.sum())
    if not 0 < share < 1:
        return np.zeros(size), -math.inf if share == 0 else math.inf
    weights = np.log((block + smooth * share) / share) - np.log((allow + smooth * (1 - share)) / (1 - share))
    weights[(allow == 0) & (block == 0)] = 0.0
    return weights, share


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", threshold: float = 0.0
) -> DataFrame:
    """(id_col, host, path, rule, verdict, host_words, log_odds) for each row of pages; html_col=None counts words of hosts alone."""
    spark = pages.sparkSession
    url = F.col(url_col)
    # distinct names inside, so that no column of the pages can clash
    every = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), *([F.col(html_col).alias("html")] if html_col else []))
    counts = written(word_counts(every, "host", "html" if html_col else None), "url-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    split = segmented(every, "host", counts, total)
    rows = every.drop("html").join(host_words(every, "host", split), "host", "left")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(rows.select("id", "host", "path", F.coalesce("words", F.array().cast("array<string>")).alias("words"), fit.alias("fit")), "url-parts")

    places = F.transform(F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), path_words(F.col("path"))), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << BITS)).cast("int"))
    seeded = F.arrays_overlap("words", F.array(*(F.lit(s) for s in seeds)).cast("array<string>"))
    examples = rows.select(seeded.alias("seeded"), places.alias("places"))
    pages_of = {r.seeded: r.n for r in examples.groupBy("seeded").agg(F.count("*").alias("n")).collect()}
    # a row for each of 2**BITS places at most, whatever the corpus
    found = examples.select("seeded", F.explode("places").alias("place")).groupBy("place").agg(F.count_if(~F.col("seeded")).alias("allow"), F.count_if("seeded").alias("block")).toPandas()
    weights, share = log_odds(list(found.itertuples(index=False)), 1 << BITS)
    none = not 0 < share < 1 or not pages_of.get(True) or not pages_of.get(False)
    prior = -math.inf if none else math.log(pages_of[True] / pages_of[False])
    held = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("places")
            starts = np.asarray(own.offsets)
            values = held.value[np.asarray(own.flatten())]
            sums = np.concatenate([[0.0], np.cumsum(values)])
            odds = sums[starts[1:] - starts[0]] - sums[starts[:-1] - starts[0]] + prior
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.round(odds, 9))], names=[*batch.schema.names[:-1], "log_odds"])

    narrow = rows.select("id", "host", "path", "words", "fit", places.alias("places"))
    kinds = narrow.drop("places").withColumn("log_odds", F.lit(0.0)).schema
    scored = narrow.mapInArrow(run, kinds)
    own = F.when(F.col("log_odds") > threshold, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.col("words").alias("host_words"), "log_odds")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {"op13_url_filter": op13_url_filter}
