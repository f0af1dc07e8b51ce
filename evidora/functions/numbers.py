"""Spoken numbers as digits, and word-level edit distance; both need state along the words."""

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ("million", "billion")
# End of fixed values.

_VALUE = {w: k for k, w in enumerate(UNITS)} | {w: 10 * k for k, w in enumerate(TENS, 2)}
_MARKS = ",.?!;:"

#: A letter for the part a word may play, so that runs and years are patterns over words: z zero, d other digits, t ten
#: to nineteen, w twenty, y other tens, h hundred, k thousand, o 'oh', a 'and', s a scale.
_PART = (
    dict.fromkeys(UNITS[1:10], "d") | dict.fromkeys(UNITS[10:], "t") | dict.fromkeys(TENS[1:], "y") | dict.fromkeys(SCALES, "s")
    | {UNITS[0]: "z", TENS[0]: "w", "hundred": "h", "thousand": "k", "oh": "o", "and": "a"}
)
_RUN = re.compile("[zdtwyhks](?:[zdtwyhksoa]*[zdtwyhks])?|o[zdtwyhksoa]*[zdtwyhks]")
_YEAR = re.compile("(?P<century>[tw]|wz)(?P<rest>h|o[zd]|t|[wy][zd]?)")
_CARDINAL = re.compile("[zdtwyhka]+")


def _read(parts: str, words: list[str]) -> int | None:
    """The value of a run: a year if it reads as one, else thousands of hundreds of sums."""
    if year := _YEAR.fullmatch(parts):
        head, tail = words[: year.end("century")], words[year.end("century") :]
        return 100 * sum(map(_VALUE.__getitem__, head)) + sum(_VALUE.get(w, 0) for w in tail)
    if not _CARDINAL.fullmatch(parts):
        return None
    total = 0
    *thousands, last = " ".join(w for w in words if w != "and").split("thousand")
    for place, group in [*((1000, g) for g in thousands), (1, last)]:
        first, *others = ([_VALUE[w] for w in part.split()] for part in group.split("hundred"))
        value = reduce(lambda acc, part: max(acc, 1) * 100 + sum(part), others, sum(first))
        total += place * (max(value, 1) if place > 1 else value)
    return total


def spoken_numbers(text: str) -> str:
    """Runs of number words as digits, joined by single spaces. A lone number below ten stays, a run never ends with 'and' or 'oh',
    and million and billion stay words."""
    said = text.split()
    words = [w.lower().strip(_MARKS) for w in said]
    parts = "".join(_PART.get(w, " ") for w in words)

    def digits(lo: int, hi: int) -> str | None:
        end = hi - (parts[hi - 1] == "s")
        value = _read(parts[lo:end], words[lo:end]) if lo < end else None
        if value is None or (hi - lo == 1 and value < 10):
            return None
        mark = said[hi - 1][-1] if said[hi - 1][-1] in _MARKS else ""
        return " ".join([str(value), *words[end:hi]]) + mark

    out: list[str] = []
    at = 0
    while at < len(said):
        run = _RUN.match(parts, at)
        made = digits(at, run.end()) if run else None
        out.append(said[at] if made is None else made)
        at = at + 1 if made is None else run.end()
    return " ".join(out)


@F.pandas_udf(T.StringType())
def spoken_numbers_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else spoken_numbers(x))


def word_errors(reference: list[str], heard: list[str]) -> tuple[int, set[int]]:
    """Edit distance of words, and the places of reference words that were not heard as they are. Of equal alignments the one
    that prefers, from the end, a pair of words, then a word left out, then a word added. Costs are made row by row on whole
    arrays: words added are a running minimum."""
    code = {w: k for k, w in enumerate({*reference, *heard})}
    other = np.array([code[w] for w in heard], np.int64)
    steps = np.arange(len(other) + 1)
    row, moves = steps, []
    for word in reference:
        pair, left_out = row[:-1] + (other != code[word]), row + 1
        best = left_out.copy()
        best[1:] = np.minimum(best[1:], pair)
        row = np.minimum.accumulate(best - steps) + steps
        moves.append(np.where(np.append(False, row[1:] == pair), "p", np.where(row == left_out, "l", "a")))
    wrong: set[int] = set()
    j = len(other)
    for i in reversed(range(len(reference))):
        while moves[i][j] == "a":
            j -= 1
        paired = moves[i][j] == "p"
        j -= paired
        if not paired or reference[i] != heard[j]:
            wrong.add(i)
    return int(row[-1]), wrong
