"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base: emails, IP addresses, payment cards and phone numbers, leftmost and non-overlapping for each
kind; a match that fails its check is dropped and not tried again.

Bootstrap: a *candidate* is a token with a digit or '@', or digit groups joined by blanks, brackets,
dots and hyphens, that no base span overlaps. An *instance* is the text of a base span or candidate, masked to a
*shape*: runs of letters, digits and others, or the length alone if letters and digits change
often. A *pattern* is the two lower-cased words or label marks that end within ``REACH`` characters before it.
Seeds are the base spans and, as kind 'secret', instances of a strong shape: ``STRONG`` characters or more of which
letters and digits change places six times. A strong shape alone gives no span, only a pattern does.

Patterns and instances form a bipartite graph. Each round scores a pattern for a kind by the share of its
instances that are known for that kind, others count as likely as their shape is; patterns
with ``min_seeds`` different known instances and a score of ``accept`` or more are accepted and
make the instances in their slot known, which scores further patterns in the next round. In the end
accepted patterns mark the candidates in their slot, whatever those look like.

Counts are aggregated by pattern, shape and instance first, and joins on a pattern are salted, so a context that a
third of all texts share is no single task. Null and empty texts have no spans. Every row of the input gives one
row; rows are keyed by id and text, so repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import giving_back, written
from evidora.session import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
REACH = 48  # characters before an instance in which its pattern is looked for
STRONG = 20  # characters of a secret that is known by its shape, at least
SALTS = 16
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TELLING = re.compile("[0-9@]")
#: what ends a token
BETWEEN = frozenset(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\"'<>,;=:()[]{}")
REST = re.compile(r"[^\s\"'<>,;=:()\[\]{}]*+")
#: a group of digits with others after blanks, brackets, dots and hyphens
GROUPS = re.compile(r"(?<![^\s\"'<>,;=:])\+?\(?[0-9]++(?:(?:[ .-]|\)[ .-]?|[ .-]?\()[0-9]++){1,7}+(?![^\s\"'<>,;=:()\[\]{}.!?-])")
LEFT = re.compile(r"([^\W\d_]+|[=:#@+(])\W{0,3}?([^\W\d_]*[=:#@+(]?)[\"'\s]*$")
MASK = re.compile(r"([A-Za-z]+)|([0-9]+)|([^A-Za-z0-9]+)")
CHANGES = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
WHOLE = re.compile(r"[A-Za-z0-9+/_=-]+")


def emails(text: str) -> list[tuple[int, int]]:
    """A local part is the run of its characters before an '@', from the last match on; found
    from the '@', so that long runs without one cost nothing."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    found = [("email", *s) for s in emails(text)]
    if not text.isascii() or _DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


_DIGIT = re.compile("[0-9]")


def context(text: str, start: int) -> str:
    """The two words or label marks before a place."""
    m = LEFT.search(text, max(0, start - REACH), start)
    return f"{m[1]} {m[2]}".lower() if m else ""


def shape(token: str) -> str:
    """Runs of letters, digits and other characters, digits with half their number; at most forty characters of
    that. Tokens in which letters and digits change six times or more have their length in eights only."""
    if len(CHANGES.findall(token)) >= 6:
        return f"mixed {len(token) // 8}"
    return MASK.sub(lambda m: "a" if m[1] else f"9{min(len(m[2]), 20) // 2}" if m[2] else m[3][:2], token)[:40]


def strong(token: str, form: str) -> bool:
    return len(token) >= STRONG and form.startswith("mixed") and bool(WHOLE.fullmatch(token))


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Places of tokens with a digit or '@' and of digit groups, found from that character, in linear time."""
    at = 0
    while m := TELLING.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in BETWEEN and not text[start - 1].isspace():
            start -= 1
        for back in (2, 1, 0):
            if start - back >= at and text[start - back : start] in ("+(", "(", "") and (groups := GROUPS.match(text, start - back)):
                start, at = groups.span()
                break
        else:
            at = REST.match(text, start).end()
        yield start, at


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[dict]:
    """The base spans and the tokens that none of them overlaps, each with its pattern, shape and hash; ``base`` is
    the kind of a base span, ``kind`` that of a seed."""
    import xxhash

    def found(kind: str | None, a: int, b: int) -> dict:
        token = text[a:b]
        form = shape(token)
        seed = kind or ("secret" if strong(token, form) else None)
        return {"base": kind, "kind": seed, "pattern": context(text, a), "shape": form, "start": a, "end": b, "value": xxhash.xxh64_intdigest(token.encode()) - (1 << 63)}

    out = [found(*x) for x in taken]
    spans = sorted((a, b) for _, a, b in taken)
    at = 0
    for a, end in tokens(text):
        b = end
        while b > a and text[b - 1] in ".!?-":
            b -= 1
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if b > a and not (at < len(spans) and spans[at][0] < b):
            one = found(None, a, b)
            if one["pattern"]:
                out.append(one)
    return out


_CANDIDATE = pa.list_(pa.struct([("base", pa.string()), ("kind", pa.string()), ("pattern", pa.string()), ("shape", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))
SCHEMA = "id long, row1 long, row2 long, candidates array<struct<base:string,kind:string,pattern:string,shape:string,start:int,end:int,value:long>>"


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(3):
                text = value.as_py() or ""
                out.append(candidates(text, base_spans(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, _CANDIDATE)], names=["id", "row1", "row2", "candidates"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text).alias("row1"), F.xxhash64(F.lit(1), id_col, text).alias("row2"), text.alias("text"))
    return rows.mapInArrow(giving_back(run), SCHEMA)


def salted(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with few on a key that many rows may share, dealt by ``by``."""
    spread = few.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"]).drop("salt")


def scored(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, score, seeds) from edges (pattern, shape, value, n) and known instances (value, kind)."""
    graded = edges.join(known, "value", "left")
    own = [(k, F.col("kind") == k) for k in KINDS]
    sums = [F.sum(F.when(is_k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k, is_k in own]
    seeds = [F.sum(F.when(is_k, 1).otherwise(0)).alias(f"seeds_{k}") for k, is_k in own]
    counts = graded.groupBy("pattern", "shape").agg(F.sum("n").alias("n"), *sums, *seeds)
    shapes = counts.groupBy("shape").agg(*((F.sum(f"n_{k}") / F.sum("n")).alias(f"s_{k}") for k in KINDS))
    other = F.col("n") - sum(F.col(f"n_{k}") for k in KINDS)
    weights = counts.join(shapes, "shape").select("pattern", "n", *(f"seeds_{k}" for k in KINDS), *((F.col(f"n_{k}") + other * F.col(f"s_{k}")).alias(f"w_{k}") for k in KINDS))
    patterns = weights.groupBy("pattern").agg(*(F.sum(f"seeds_{k}").alias(f"seeds_{k}") for k in KINDS), *((F.sum(f"w_{k}") / (F.sum("n") + 1)).alias(f"p_{k}") for k in KINDS))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p_{k}").alias("score"), F.col(f"seeds_{k}").alias("seeds")) for k in KINDS))
    return patterns.select("pattern", F.explode(rows).alias("r")).select("pattern", "r.*")


def accepted(seen: DataFrame, rounds: int = 3, min_seeds: int = 5, accept: float = 0.6) -> DataFrame:
    """(pattern, found): patterns and their kind, after ``rounds`` rounds over rows (pattern, shape, value, kind or
    null). An instance known for two kinds counts for the first in the alphabet."""
    rows = seen.filter("pattern <> ''")
    edges = written(rows.groupBy("pattern", "shape", "value").agg(F.count("*").alias("n"), F.min("kind").alias("kind")), "pii-edges")
    known = edges.filter("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind"))
    edges = edges.drop("kind")
    for turn in range(rounds):
        fit = scored(edges, known).filter((F.col("seeds") >= min_seeds) & (F.col("score") >= accept))
        best = written(fit.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b")).select("pattern", F.col("b.kind").alias("found")), "pii-patterns")
        if turn < rounds - 1:
            new = salted(edges, best, "pattern", "value").select("value", F.col("found").alias("kind"))
            known = written(known.withColumn("order", F.lit(0)).union(new.withColumn("order", F.lit(1))).groupBy("value").agg(F.min(F.struct("order", "kind")).alias("k")).select("value", "k.kind"), "pii-known")
    return best


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 5, accept: float = 0.6) -> DataFrame:
    """One row per row of docs: (id, spans), spans an array of (kind, start, end, base)."""
    rows = written(extract(docs, id_col, text_col), "pii-rows")
    seen = rows.select("row1", "row2", F.explode("candidates").alias("c")).select("row1", "row2", "c.*")
    best = accepted(seen, rounds, min_seeds, accept)
    new = salted(seen.filter("base IS NULL"), best, "pattern", "value").select("row1", "row2", F.struct(F.col("found").alias("kind"), "start", "end", F.lit(False).alias("base")).alias("s"))
    added = new.groupBy("row1", "row2").agg(F.collect_set("s").alias("added"))
    base = F.transform(F.filter("candidates", lambda c: c.base.isNotNull()), lambda c: F.struct(c.base.alias("kind"), c.start.alias("start"), c.end.alias("end"), F.lit(True).alias("base")))
    every = F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")))
    return rows.join(added, ["row1", "row2"], "left").select("id", F.sort_array(F.transform(every, _ranked)).alias("ranked")).select("id", F.transform("ranked", _plain).alias("spans"))


def _ranked(s):
    order = F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    return F.struct(order.alias("order"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.base.alias("base"))


def _plain(s):
    return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    added = F.filter("spans", lambda s: ~s.base)

    def counted(spans, kind: str):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    return found.select(F.col("id").alias("doc_id"), *(counted(base, k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counted(added, "secret"), F.size(added).cast("long").alias("n_added"))


QUERIES = {"op1_pii": op1_pii}
