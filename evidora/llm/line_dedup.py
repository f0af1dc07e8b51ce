"""Line deduplication over levelled sorted runs, DataFrame functions only.

A text is split at newlines. A line's key is the line without ASCII white space at either end, A-Z lower-cased;
keys of a code point or more that are found in ``min_docs`` rows or more lose all their lines in
every row. Keys are held as two 64-bit hashes.

The store: a batch of rows gives one run of (key, rows that have it), a table dealt to buckets by key
and sorted in them. A new batch is joined with all runs on the key, bucket by bucket and without a shuffle: keys that the
runs have counted ``min_docs`` times are settled and not added again (the merge anti-join), the others become a run of
level 0, and those that now reach ``min_docs`` are settled by this batch. ``fanout`` runs of a level are
compacted into one of the next by merging their buckets, so a store of n batches has about fanout log n runs. It lives
in a folder with a manifest, so that a later session opens it and adds to it. A hot line is one row of
each run, as batches are aggregated before they are dealt.

A table of documents is dealt to one batch for each ``batch_rows`` rows, ``MOST_BATCHES`` at most.

Dropping: lines whose key is settled are found by a join on the key, their places are gathered by row and
joined to the texts; texts that a bit array of 8 MB shows to have none stay where they are. Null and empty
texts are one empty line. Rows are identified by id and text; repeated rows count each, and get equal
results. All columns of the input are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import bitmap, bucketed, bucketed_at, perhaps, scratch_path, written
from evidora.session import table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z lower-cased; texts in ASCII take the quicker function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(folded(text), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


KEY = ["h1", "h2"]
RUN = "h1 BIGINT, h2 BIGINT, n BIGINT"
MOST_BATCHES = 8


class LineStore:
    """The levels of runs (h1, h2, n) and the settled keys (h1, h2) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder.rstrip("/"), min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str, DataFrame]] = []
        self.parts: list[str] = []
        self.turn = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineStore:
        """The store as its last manifest has it."""
        rows = spark.read.parquet(f"{folder.rstrip('/')}/manifest").collect()
        last = max(r.turn for r in rows)
        rows = [r for r in rows if r.turn == last]
        store = cls(spark, folder, rows[0].min_docs, rows[0].fanout, rows[0].buckets)
        store.turn = last
        store.parts = [r.path for r in rows if r.kind == "settled"]
        store.runs = [(r.level, r.path, bucketed_at(spark, f"{store.folder}/{r.path}", RUN, store.buckets, KEY)) for r in rows if r.kind == "run"]
        return store

    def _manifest(self) -> None:
        self.turn += 1
        rows = [("run", level, path) for level, path, _ in self.runs] + [("settled", 0, path) for path in self.parts]
        rows = [(*r, self.turn, self.min_docs, self.fanout, self.buckets) for r in rows]
        self.spark.createDataFrame(rows, "kind string, level int, path string, turn int, min_docs int, fanout int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def settled(self) -> DataFrame:
        """(h1, h2) of the keys found in ``min_docs`` rows or more, each once."""
        return self.spark.read.schema("h1 long, h2 long").parquet(*(f"{self.folder}/{p}" for p in self.parts))

    def joined(self, batch: DataFrame) -> DataFrame:
        """(h1, h2, n, before): a batch with what the runs have counted of its keys, those left out that are settled."""
        every = batch.select(*KEY, "n")
        before = F.lit(0).cast("long")
        for k, (_, _, run) in enumerate(self.runs):
            every = every.join(run.withColumnRenamed("n", f"n{k}"), KEY, "left")
            before = before + F.coalesce(f"n{k}", F.lit(0))
        return every.select(*KEY, "n", before.alias("before")).filter(F.col("before") < self.min_docs)

    def add(self, batch: DataFrame) -> None:
        """A batch (h1, h2, n) of distinct keys, dealt to the store's buckets."""
        name = f"run-0-{uuid.uuid4().hex}"
        steps = bucketed(self.joined(batch), f"{self.folder}/step-{name}", self.buckets, KEY)
        part = f"settled-{uuid.uuid4().hex}"
        steps.filter(F.col("n") + F.col("before") >= self.min_docs).select(*KEY).write.parquet(f"{self.folder}/{part}")
        self.parts.append(part)
        # the run is the step without its last column, which Parquet readers leave out
        self.runs.append((0, f"step-{name}", steps.select(*KEY, "n")))
        self.compact()
        self._manifest()

    def compact(self) -> None:
        """Merge ``fanout`` runs of a level into one of the next, from the lowest level up."""
        level = 0
        while any(x >= level for x, _, _ in self.runs):
            own = [r for r in self.runs if r[0] == level]
            if len(own) >= self.fanout:
                self.runs = [r for r in self.runs if r[0] != level]
                name, merged = own[0][1], own[0][2]
                for _, _, run in own[1:]:
                    total = (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")
                    name = f"run-{level + 1}-{uuid.uuid4().hex}"
                    merged = bucketed(merged.join(run.withColumnRenamed("n", "m"), KEY, "full_outer").select(*KEY, total), f"{self.folder}/{name}", self.buckets, KEY)
                self.runs.append((level + 1, name, merged))
            level += 1


def line_batches(docs: DataFrame, id_col: str, text_col: str, batches: int, buckets: int) -> DataFrame:
    """(h1, h2, n, batch): the rows of each batch that have a key, dealt to buckets by key."""
    keys = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(batches)).cast("int").alias("batch"), F.array_distinct(line_keys(F.col(text_col))).alias("keys"))
    lines = keys.select("batch", F.explode("keys").alias("key")).filter("key <> ''")
    counts = lines.select("batch", *hashes("key")).groupBy("batch", *KEY).agg(F.count("*").alias("n"))
    return bucketed(counts.select(*KEY, "n", "batch").repartition(buckets, *KEY), scratch_path(docs.sparkSession, "line-batches"), buckets, KEY, "batch")


def common_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, batch_rows: int) -> DataFrame:
    """(h1, h2) of the keys found in ``min_docs`` rows or more."""
    spark = docs.sparkSession
    batches = max(1, min(MOST_BATCHES, -(-docs.count() // batch_rows)))
    store = LineStore(spark, scratch_path(spark, "line-store"), min_docs)
    table = line_batches(docs, id_col, text_col, batches, store.buckets)
    for batch in range(batches):
        store.add(table.filter(F.col("batch") == batch))
    return store.settled()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batch_rows: int = 1 << 16) -> DataFrame:
    """One row per row of docs: (row, kept, n_lines, n_dropped), row a struct of all columns but the text, so that no name
    can clash."""
    settled = common_lines(docs, id_col, text_col, min_docs, batch_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(id_col, text_col).alias("r1"), F.xxhash64(F.lit(1), id_col, text_col).alias("r2")]
    places = docs.select(*key, F.posexplode(line_keys(text)).alias("at", "line")).filter("line <> ''").select("r1", "r2", "at", *hashes("line"))
    gone = written(places.join(settled, KEY, "left_semi").groupBy("r1", "r2").agg(F.collect_set("at").alias("gone")), "line-places")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = perhaps(docs.select(F.struct(*others).alias("row"), *key, text.alias("text")), bitmap(gone, "r1"), "r1")
    lines = F.split("text", "\n")
    n = F.size(lines)
    whole = rows.filter("NOT perhaps").select("row", F.col("text").alias("kept"), n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    found = rows.filter("perhaps").join(gone, ["r1", "r2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "gone")  # by hashing, in order
    # the outer lambda's variable holds the lines of a row, so that they are split once and not for each line that stays
    picked = F.transform(F.array(lines), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))[0]
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(picked)
    return whole.union(found.select("row", kept.alias("kept"), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batch_rows: int = 1 << 16) -> DataFrame:
    """docs with what is kept of its texts."""
    found = deduplicated(docs, id_col, text_col, min_docs, batch_rows)
    return found.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op7_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM c)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM c)), '')) AS kept_sha256
FROM k GROUP BY r"""
}

QUERIES = {"op7_line_dedup": op7_line_dedup}
