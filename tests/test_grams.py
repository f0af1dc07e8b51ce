"""Character n-grams of many texts against those of each word."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from evidora.operators import index


def plain(text):
    return Counter(g for word in text.split(" ") if word for g in index.char_grams(word))


def test_a_word_is_spelt_once_for_all_parts(monkeypatch):
    spelt = Counter()
    spell = index.Spelt.spell

    def seen(self, words):
        spelt.update(words)
        spell(self, words)

    monkeypatch.setattr(index.Spelt, "spell", seen)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeü🙂", k=draw.randint(1, 9))) for _ in range(200)]
    texts = [" ".join(draw.choices(words, k=60)) for _ in range(40)] + ["", " "]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 14)), pa.array(texts[k : k + 14])], names=["ord", "text"]) for k in range(0, 42, 14)]
    found = [Counter() for _ in texts]
    for ords, held, row, gram, tf in index.gram_parts(batches, size=5):
        names = list(held.grams)
        for r, g, t in zip(row, gram, tf, strict=True):
            found[ords[int(r)].as_py()][names[g]] += round(float(np.exp(t - 1)))
    assert found == [plain(t) for t in texts]
    assert set(spelt) <= set(words) and set(spelt.values()) == {1}


def test_more_letters_than_a_number_holds_and_words_given_up():
    draw = random.Random(4)
    texts = [" ".join("".join(draw.choices([chr(0x4E00 + c) for c in range(6000)], k=draw.randint(1, 7))) for _ in range(200)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["ord", "text"])
    found = [Counter() for _ in texts]
    for ords, held, row, gram, tf in index.gram_parts([batch], size=4, held=1000):
        names = list(held.grams)
        for r, g, t in zip(row, gram, tf, strict=True):
            found[ords[int(r)].as_py()][names[g]] += round(float(np.exp(t - 1)))
    assert found == [plain(t) for t in texts]
    one = index.Spelt()
    row, gram, times = one.counted(texts, 500)
    assert one.met > 1 << 12 and times.sum() == sum(sum(plain(t).values()) for t in texts)
