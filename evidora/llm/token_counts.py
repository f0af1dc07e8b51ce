"""Token counts of sections by offset-mapped attribution.

A document is the text of its fields joined by newlines, encoded once and as a whole. A section is
a field or, with one field, a line; it ends with its newline. The tokens' byte spans come from their
lengths and are interval-joined to the sections' spans, both being sorted. A token that crosses a
boundary is allocated by ``rule``: 'start' (the section of its first byte), 'end' (of its last), 'most' (of most of its
bytes, the earlier of equals). Counts of sections always add up to the document's.

Null fields are empty; a document without text has one empty section and no tokens. Each row gives one
row, repeated ones too. Columns other than those named are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.session import table

SCHEMA = "doc_id long, sections array<struct<start:long,end:long,n_tokens:long>>, n_tokens long, n_crossing long"
_SECTIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())]))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A byte-level encoding, with the length in bytes of each token; built once in a worker."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]


def allocate(ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. ends: the tokens' ends in bytes;
    cuts: the sections' ends, the last that of the text."""
    starts = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(cuts, starts, side="right")
    last = np.searchsorted(cuts, ends - 1, side="right")
    chosen = first.copy() if rule != "end" else last.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        edges = np.concatenate(([0], cuts))
        for t in crossing:  # a token has few bytes, so few sections
            parts = range(first[t], last[t] + 1)
            chosen[t] = max(parts, key=lambda s: (min(ends[t], edges[s + 1]) - max(starts[t], edges[s]), -s))
    return np.bincount(chosen, minlength=len(cuts)), len(crossing)


def attribute(docs: DataFrame, path: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "start") -> DataFrame:
    """Columns of SCHEMA; the sections' spans are code points of the joined text, end exclusive."""
    if rule not in ("start", "end", "most"):
        raise ValueError(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder.of(path)
        for batch in batches:
            rows = []
            for values in zip(*batch.columns[1:], strict=True):
                texts = [v.as_py() or "" for v in values]
                parts = "\n".join(texts).split("\n") if len(texts) == 1 else texts
                text = "\n".join(parts)
                tokens = np.array(own.encode(text), np.int64)
                chars = np.cumsum([len(p) + 1 for p in parts])
                chars[-1] -= 1
                cuts = np.cumsum([len(p.encode()) + 1 for p in parts])
                cuts[-1] -= 1
                counts, crossing = allocate(np.cumsum(own.sizes[tokens]), cuts, rule) if len(tokens) else (np.zeros(len(cuts), int), 0)
                edges = [0, *chars.tolist()]
                rows.append(([{"start": a, "end": b, "n_tokens": n} for a, b, n in zip(edges, edges[1:], counts.tolist(), strict=False)], len(tokens), crossing))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (_SECTIONS, pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "sections", "n_tokens", "n_crossing"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(f).alias(f"field{k}") for k, f in enumerate(fields)))
    return source.mapInArrow(run, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, lines, tokens across lines, and a digest of the tokens of each line."""
    found = attribute(table(spark, sf_dir, "documents"), vocabulary_path())
    counts = F.transform("sections", lambda s: s.n_tokens)
    return found.select(
        "doc_id",
        "n_tokens",
        F.size("sections").cast("long").alias("n_sections"),
        "n_crossing",
        F.array_max(counts).alias("most_tokens"),
        F.sha2(F.array_join(F.transform(counts, lambda n: n.cast("string")), ",").cast("binary"), 256).alias("counts_sha256"),
    )


QUERIES = {"op8_token_counts": op8_token_counts}
