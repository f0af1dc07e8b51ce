"""Quality rules: base rules on words, and compression bands.

Words are maximal runs of characters other than ASCII white space. Base rules: a text fails with
fewer than ``min_words`` words, or with over ``max_repeat`` in a hundred of its words in three-word
windows found twice or more. The method's rules: zstandard ratios (raw size by compressed size)
of the whole text and of each chunk must lie in a band; chunks cover the text, the last one ends
where it ends, and a text under a chunk's size is measured as a whole only. A text above the band repeats
itself, one below it cannot be compressed (random characters, encoded data). Short inputs compress
less well, so the limits depend on the length: ``BANDS`` for whole texts of any kind, or those that ``fit_bands`` learns from labelled texts of
the corpus itself, ``CHUNKS`` for chunks of two sizes; a
text is rejected by its chunks if over ``max_bad_chunks`` in a hundred of them lie outside.

Null and empty texts have no words and fail. Every row gives one row, repeated ones too; a null id
stays null. Columns other than the two named are ignored by ``measure``; ``keep_good`` returns its
input's columns as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import giving_back
from evidora.session import table

#: (bytes, least ratio, largest ratio) of whole texts; between two lengths the limits are interpolated
#: over the logarithm of the length, beyond the ends they stay. Wide limits, for texts of any kind.
BANDS = ((64, 0.7, 3.0), (256, 1.15, 3.2), (1024, 1.3, 4.0), (4096, 1.5, 5.0), (32768, 1.6, 6.0))
#: (bytes, least ratio, largest ratio) of chunks; short ones find encoded data, long ones repetition.
CHUNKS = ((1024, 1.3, 4.0), (4096, 1.35, 6.0))
SYMBOLS = re.compile(r"[#*$%&|<>]")

SCHEMA = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_bytes long, ratio double, bad_chunks double, kept boolean"
)


SPACES = " \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n = covered = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            n += at + width - max(at, covered)
            covered = at + width
    return n


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


Bands = tuple[tuple[int, float, float], ...]


def limits(size: int, bands: Bands) -> tuple[float, float]:
    """The least and the largest ratio of a text of ``size`` bytes."""
    at = bisect_right(bands, size, key=lambda x: x[0])
    if at in (0, len(bands)):
        return bands[max(0, at - 1)][1:]
    (lo, *a), (hi, *b) = bands[at - 1], bands[at]
    share = math.log(size / lo) / math.log(hi / lo)
    return tuple(x + share * (y - x) for x, y in zip(a, b, strict=True))


def band_verdict(raw: bytes, compress, bands: Bands = BANDS) -> tuple[float, float, bool]:
    """Ratio of the whole, the larger share of chunks outside their band, and whether both pass."""
    if not raw:
        return 1.0, 0.0, True
    ratio = len(raw) / len(compress(raw))
    least, most = limits(len(raw), bands)
    share = 0.0
    for size, low, high in CHUNKS:
        chunks = [raw[i : i + size] for i in range(0, len(raw) - size + 1, size)]
        if len(raw) > size and len(raw) % size:
            chunks.append(raw[-size:])
        bad = sum(not low <= size / len(compress(x)) <= high for x in chunks)
        share = max(share, bad / len(chunks) if chunks else 0.0)
    return ratio, share, least <= ratio <= most


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_bad_chunks: int = 5, bands: Bands = BANDS) -> DataFrame:
    """One row per row of docs with the columns of SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                raw = text.encode()
                words = raw.split()  # bytes split at ASCII white space only
                n, again = len(words), repeated_words(words)
                failed = n < min_words or 100 * again > max_repeat * n
                ratio, share, within = band_verdict(raw, compress, bands)
                kept = not failed and within and 100 * share <= max_bad_chunks
                rows.append((n, len(text) - sum(map(text.count, SPACES)), len(SYMBOLS.findall(text)), duplicate_lines(text), again, failed, len(raw), ratio, share, kept))
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            arrays = [pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=_NAMES)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]


def keep_good(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_bad_chunks: int = 5, bands: Bands = BANDS) -> DataFrame:
    """The rows of docs that pass, with all their columns, in one pass and without a shuffle."""
    from pyspark.sql import types as T

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            good = []
            for value in batch.column(names.index(text_col)):
                raw = (value.as_py() or "").encode()
                words = raw.split()
                if fine := len(words) >= min_words and 100 * repeated_words(words) <= max_repeat * len(words):
                    _, share, within = band_verdict(raw, compress, bands)
                    fine = within and 100 * share <= max_bad_chunks
                good.append(fine)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(giving_back(run), T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def fit_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", margin: float = 0.03, room: float = 0.1) -> Bands:
    """Bands for a corpus from all of its labelled rows: at each power of two
    the least ratio of texts with label 1 that are nearest to that length, less ``room``, and the largest, with
    ``margin`` more. Rows of the held-out fifth, where crc32 of the id as text leaves 0 when divided by 5, and
    those that fail the base rules are left out. Below and above the lengths that have 20 texts the limits are those of ``BANDS``."""
    learn = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter("_y = 1").filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0).dropDuplicates(["_id"])
    # texts are measured where they lie, and only their figures are joined to the labels
    eligible = docs.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)
    own = measure(eligible, id_col).filter("NOT base_failed").select("id", F.log2("n_bytes").alias("at"), "ratio")
    own = own.join(learn, own["id"] == learn["_id"], "left_semi")
    found = own.select(F.round("at").cast("int").alias("power"), "ratio")
    found = found.groupBy("power").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.count("*").alias("n")).filter("n >= 20").orderBy("power").collect()
    own = tuple((1 << int(r.power), round(r.low * (1 - room), 2), round(r.high * (1 + margin), 2)) for r in found)
    return tuple(b for b in BANDS if own and b[0] < own[0][0]) + own + tuple(b for b in BANDS if own and b[0] > own[-1][0])


def bands_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Bands:
    """Bands fitted to the labels beside the documents; ``BANDS`` where there are none or too few."""
    try:
        labels = table(spark, sf_dir, "labels")
    except AnalysisException:  # no such table
        return BANDS
    return fit_bands(docs, labels) or BANDS


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = measure(docs, bands=bands_of(spark, docs, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
