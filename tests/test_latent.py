"""The SVD of many terms, dealt out by term, against numpy."""

import random
from pathlib import Path

import numpy as np

from evidora.operators import index


def test_many_terms_are_dealt_out(spark):
    draw = random.Random(5)
    names = ["".join(draw.choices("bdfgklmnprstvz", k=7)) for _ in range(1500)]
    texts = [" ".join([*draw.choices(names[30 * (k % 4) : 30 * (k % 4) + 30], k=25), *names[200 + 30 * k : 230 + 30 * k]]) for k in range(40)]
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)] + [(500, ""), (501, None)], "ord long, text string")
    asked = spark.createDataFrame([(k, " ".join((names[200 + 30 * k + 7], names[k], "unknownword"))) for k in range(40)] + [(99, "unknownword")], "ord long, text string")
    plain = index.Lsa(rank=12, held=10_000).fit(docs)
    dense = np.zeros((40, plain.terms.count()))
    for r in plain._weights(docs).collect():
        dense[r.ord // 3, list(r.m)] = list(r.m.values())
    query = np.zeros((40, dense.shape[1]))
    for r in plain._weights(asked).collect():
        query[r.ord, list(r.m)] = list(r.m.values())
    axes = np.linalg.svd(dense)[2][:12].T
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    lsa = index.Lsa(rank=12, held=100).fit(docs)
    assert lsa.components is None  # nothing of terms x rank is on the driver
    found = {r.ord // 3: r.vector for r in lsa.transform(docs).collect()}
    looked = {r.ord: r.vector for r in lsa.transform(asked).collect()}
    assert sorted(found) == sorted(looked) == list(range(40))
    a, b = np.array([found[k] for k in range(40)]), np.array([looked[k] for k in range(40)])
    assert np.abs(a @ a.T - unit(dense @ axes) @ unit(dense @ axes).T).max() < 1e-3
    assert np.abs(b @ a.T - unit(query @ axes) @ unit(dense @ axes).T).max() < 1e-3


def test_passes_leave_one_matrix_behind(spark):
    """Disk does not grow with passes: of the documents' matrices the last two stay, of the terms' none."""
    draw = random.Random(6)
    names = ["".join(draw.choices("bdfgklmnprstvz", k=6)) for _ in range(300)]
    docs = spark.createDataFrame([(k, " ".join(draw.choices(names, k=40))) for k in range(60)], "ord long, text string")
    lsa = index.Lsa(rank=8, passes=4, held=100).fit(docs)
    folder = Path(lsa.latent.folder)
    assert sorted(p.name for p in folder.iterdir()) == ["pass-2", "pass-3", "vocabulary", "weights"]
    plain = index.Lsa(rank=8, passes=4, held=10_000).fit(docs)
    a, b = (np.array([r.vector for r in x.transform(docs).orderBy("ord").collect()]) for x in (lsa, plain))
    assert a.shape == b.shape and (np.abs(np.linalg.norm(a, axis=1) - 1) < 1e-6).all()
