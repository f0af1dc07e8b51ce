"""Heap Lloyd, structure repair and the url filter against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from evidora.llm import heap_lloyd, registry, structure_repair, url_filter
from tests.conftest import SMALL


def plain_lloyd(vectors, rounds=heap_lloyd.ROUNDS, entries=heap_lloyd.ENTRIES):
    """(codes, errors, codebooks) with Python's integers; vectors in the order of their ids."""
    q = [[math.floor(4096 * x) for x in v] for v in vectors]
    w = len(q[0]) // heap_lloyd.PARTS
    parts = [[v[p * w : (p + 1) * w] for v in q] for p in range(heap_lloyd.PARTS)]
    books = [own[:entries] for own in parts]

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(b)), key=lambda k: (dist(x, b[k]), k)) for x in own] for own, b in zip(parts, books, strict=True)]

    for _ in range(rounds):
        codes = assign()
        for p, own in enumerate(parts):
            for k in range(len(books[p])):
                if mine := [x for x, c in zip(own, codes[p], strict=True) if c == k]:
                    books[p] = [*books[p][:k], [sum(c) // len(mine) for c in zip(*mine, strict=True)], *books[p][k + 1 :]]
    codes = assign()
    errors = [sum(dist(parts[p][i], books[p][codes[p][i]]) for p in range(heap_lloyd.PARTS)) for i in range(len(q))]
    return ["".join(f"{codes[p][i]:02x}" for p in range(heap_lloyd.PARTS)) for i in range(len(q))], errors, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["random", "ties", "few", "large"])
def test_heap_lloyd_equals_plain(spark, kind):
    draw = random.Random(kind)
    n, width = {"few": (9, 16)}.get(kind, (300, 16))
    value = {"ties": lambda: draw.choice([0.0, 0.25, -0.25]), "large": lambda: draw.uniform(-3e4, 3e4)}.get(kind, lambda: draw.gauss(0, 1))
    vectors = [[value() for _ in range(width)] for _ in range(n)]
    vectors[n // 3] = vectors[0]
    labels = [draw.choice([None, 1, 2]) for _ in range(n)]
    rows = list(zip(range(n), vectors, labels, strict=True))
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    codes, errors, digest = plain_lloyd(vectors)
    got = {r.vec_id: r for r in heap_lloyd.compressed(table).collect()}
    totals = {x: sum(e for e, y in zip(errors, labels, strict=True) if y == x) for x in set(labels)}
    assert [(got[i].code, got[i].error, got[i].label_error) for i in range(n)] == [(codes[i], errors[i], totals[labels[i]]) for i in range(n)]
    assert {r.codebooks_sha256 for r in got.values()} == {digest}


def test_heaps_measure_less_and_blocks_do_not_matter(spark):
    """Later passes pop only a part of the heaps, and give what a whole search gives."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    one = heap_lloyd.fit(table)
    other = heap_lloyd.fit(table.repartition(5), block=64)
    assert one.books.digest() == other.books.digest() and one.measured == other.measured
    assert one.measured[0] == 8 * table.count() and one.measured[-1] < 0.9 * one.measured[0]
    got = {r.vec_id: (r.code, r.error) for r in heap_lloyd.encoded(one).collect()}
    rows = table.orderBy("vec_id").collect()
    books = one.books.entries
    q = heap_lloyd.quantised(np.array([r.embedding for r in rows])).reshape(len(rows), 8, -1)
    squares = np.stack([heap_lloyd.distances(q[:, p], books[p]) for p in range(8)])
    assert all(got[r.vec_id] == ("".join(f"{k:02x}" for k in squares[:, i].argmin(1)), int(squares[:, i].min(1).sum())) for i, r in enumerate(rows))


def test_heap_lloyd_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 8
    rows = [(1, good, 1), (1, good, 1), (None, [0.25] * 8, None), (2, None, 1), (3, [nan] * 8, 1), (4, [inf] * 8, 1), (5, [None] * 8, 1), (6, [1.0] * 16, 1), (7, [], 1), (8, [1.0] * 9, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "7 AS block", "'x' AS places", "1 AS id", "0 AS code")
    got = heap_lloyd.compressed(table).collect()
    assert sorted((r.vec_id or -1, r.error) for r in got) == [(-1, 0), (1, 0), (1, 0)] and {r.label_error for r in got} == {0}
    assert heap_lloyd.compressed(table.limit(0)).collect() == []
    assert heap_lloyd.compressed(table.filter("embedding IS NULL")).count() == 0


@cache
def cheapest(rows, i=0, state=0, inserted=0):
    """(cost, least audit) by trying all."""
    ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
    if i < len(rows):
        initial, fault, _ = rows[i]
        more = fault == "truncated"
        cost, audit = cheapest(rows, i + 1, state)
        ways.append((cost + 3, "D" + audit))
        if fault not in ("blank", "duplicate"):
            for letter, to, price in (("K", structure_repair._keep(initial, state), 0), ("R", structure_repair.NEXT[state], 2)):
                if to is not None:
                    cost, audit = cheapest(rows, i + 1, to)
                    ways.append((cost + price + more, letter + audit))
    if inserted < 3:
        cost, audit = cheapest(rows, i, structure_repair.NEXT[state], inserted + 1)
        ways.append((cost + 2, "I" + audit))
    return min(ways, default=(10**6, ""))


def test_layers_give_the_least_audit_in_parts_too():
    draw = random.Random(11)
    for _ in range(3000):
        rows = [(draw.choice(["s", "u", "u", "a", "a", "x", ""]), draw.choice(["", "", "", "truncated", "blank", "duplicate"]), 1) for _ in range(draw.randrange(14))]
        cost, audit = cheapest(tuple(rows))
        turns = structure_repair.layered(rows, structure_repair.pack(structure_repair.END))
        assert structure_repair.cost_of(*turns[0], 0) == cost and "".join(structure_repair.trace(rows, turns, 0, True)[0]) == audit
        cuts = [0, *sorted(draw.sample(range(1, len(rows)), min(2, len(rows) - 1))), len(rows)] if len(rows) > 2 else [0, len(rows)]
        parts = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        found = structure_repair.seams([structure_repair.summary(p) for p in parts])
        own = [structure_repair.trace(p, structure_repair.layered(p, structure_repair.pack(after)), state, k == len(parts) - 1)[0] for k, (p, (state, after)) in enumerate(zip(parts, found, strict=True))]
        assert "".join(itertools.chain(*own)) == audit


def plain_repair(rows):
    """What OUT has of one conversation; rows (turn, role, text) as they count."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, coded = set(), []
    for _, role, text in rows:
        own = text.strip(" \t\n\x0b\x0c\r")
        coded.append((role[:1], "blank" if not own else "duplicate" if (role, text) in seen else "" if own[-1] in ".!?" else "truncated", 1))
        seen.add((role, text))
    cost, audit = cheapest(tuple(coded)) if len(coded) < 200 else (None, None)
    if audit is None:
        turns = structure_repair.layered(coded, structure_repair.pack(structure_repair.END))
        cost, audit = structure_repair.cost_of(*turns[0], 0), "".join(itertools.chain(*structure_repair.trace(coded, turns, 0, True)[0]))
    out, k, state = [], 0, 0
    for letter in audit:
        if letter == "I":
            out.append(structure_repair.ROLES[state] + ":")
            state = structure_repair.NEXT[state]
            continue
        _, role, text = rows[k]
        if letter == "R":
            role = structure_repair.ROLES[state]
        if letter != "D":
            out.append(f"{role}:{text}")
            state = structure_repair.NEXT[state] if letter == "R" else structure_repair._keep(role[:1], state)
        k += 1
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(sum(f == kind for _, f, _ in coded) for kind in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def told(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_repair_of_odd_and_hot_conversations(spark):
    """Nulls, repeated rows, roles out of the grammar, and a conversation that covers all partitions."""
    draw = random.Random(12)
    role = lambda: draw.choice(["user", "assistant", "assistant", "system", "tool", "", None])
    rows = [(1, t, role(), f"t{t % 700}{draw.choice(['.', '!', '', ' '])}") for t in range(2500)]
    rows += [(2, None, "user", "a."), (2, None, "user", "a."), (2, 3, "assistant", None), (None, 0, None, "x."), (None, 5, "user", "  "), (None, 7, "user", "x")]
    rows += [(3, 2**62, "user", "Ü日。"), (3, -(2**62), "system", "s."), (4, 1, "user", "same")] + [(4, 1, "user", "same")] * 40 + [(5, t, "user", "") for t in range(6)]
    draw.shuffle(rows)
    table = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: r for r in structure_repair.repair(table).collect()}
        sizes = structure_repair.ordered(structure_repair.coded(table, "conv_id", "turn", "role", "text")).rdd.mapPartitions(lambda rows: [len({r.conv for r in rows})]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([n for n in sizes if n]) > 2
    for conv in (1, 2, None, 3, 4, 5):
        assert told(got[conv]) == plain_repair([r[1:] for r in rows if r[0] == conv]), conv
    assert structure_repair.repair(table.limit(0)).collect() == []


def test_op12_against_a_plain_version(spark):
    source = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        own, k = source.setdefault(r.conv_id, []), zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if k == 1 else re.sub(r"[.!?]", "", r.text) if k == 2 else r.text
        own += [(r.turn, "user" if k == 4 else r.role, text)] * {0: 0, 3: 2}.get(k, 1)
    got = registry.QUERIES["op12_structure_repair"](spark, SMALL).collect()
    assert {r.conv_id: told(r) for r in got} == {c: plain_repair(rows) for c, rows in source.items()} and len(got) == len(source)


def test_conversation_that_lost_all_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows, copies = structure_repair.damaged(spark.createDataFrame([(lost, 0, "user", "x.")], "conv_id long, turn long, role string, text string"))
    (r,) = structure_repair.repair(rows, copies=copies).collect()
    assert r.conv_id == lost and told(r) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def brute_split(run, words, total):
    """Every way to cut a run."""
    best = None
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        cost = sum(url_filter.word_cost(words[a, b - a], total) if words.get((a, b - a)) else url_filter.unknown_cost(b - a, total) for a, b in itertools.pairwise(cuts))
        # ties as documented, from the end on
        key = (cost, len(cuts), [cuts[i] for i in range(len(cuts) - 2, -1, -1)])
        best = min(best or key, key)
    return [run[a:b] for a, b in itertools.pairwise([*best[2][::-1], len(run)])]


def test_viterbi_is_cheapest():
    draw = random.Random(13)
    for _ in range(200):
        run = "".join(draw.choice("ab") for _ in range(draw.randrange(1, 10)))
        counts = {w: draw.randrange(1, 50) for w in {run[i : i + n] for i in range(len(run)) for n in (1, 2, 3, 4)} if draw.random() < 0.5}
        words = {(i, n): counts[run[i : i + n]] for i in range(len(run)) for n in range(1, len(run) + 1) if run[i : i + n] in counts}
        assert url_filter.split_run(run, words, 1000) == brute_split(run, words, 1000)


def test_parts_of_urls_and_rules(spark):
    cases = [
        (1, "http://A.Example.ORG/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"), (2, "x://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://org", "org", "", None, None), (4, "http://notorg/", "notorg", "/", None, None), (5, "https://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"),
        (6, "https://a.com/de/", "a.com", "/de/", "com/de/", "block"), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None), (9, "a://b.org?x/://c", "b.org", "", None, None),
        (10, "u://É.ORG/a/b#?", "É.org", "/a/b", "org/", "allow"), (11, "http://user@h.org:80/p", "user@h.org:80", "/p", None, None), (12, "http:///es/", "", "/es/", None, None), (None, "http://" + "z" * 90_000 + ".org/" + "y/" * 90_000, "z" * 90_000 + ".org", "/" + "y/" * 90_000, "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "h", "p") for i, u, *_ in cases] * 2, "page_id long, url string, html string, host string, words string")
    got = url_filter.judged(pages).collect()
    assert len(got) == 2 * len(cases)
    by = {r.page_id: r for r in got}
    for i, _, host, path, rule, verdict in cases:
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule) and by[i].verdict == (verdict or "allow"), i
    assert url_filter.judged(pages.limit(0)).collect() == []
    nothing = url_filter.judged(pages, rules=(), html_col=None).collect()
    assert {r.rule for r in nothing} == {None}


def test_filter_equals_a_plain_one_and_finds_concatenated_names(spark):
    draw = random.Random(14)
    text = "<p>cheap pills</p> and win at the casino <b class='x'>garden tools</b> for a quiet market " * 3
    hosts = [f"www.{a}-{b}.net" for a in ("cheap", "best") for b in ("pills", "garden", "tools", "market")] + ["winbigcasino.net", "cheappills.net", "gardentools.net", "quietmarket.net", "cheapwin.net"]
    rows = [(i, f"http://{draw.choice(hosts)}/{draw.choice(['en', 'shop'])}/{draw.randrange(50)}", text) for i in range(400)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=()).collect()
    by = {r.host: r for r in got}
    assert by["cheappills.net"].host_words[:2] == ["cheap", "pills"] and by["gardentools.net"].host_words[:2] == ["garden", "tools"]
    assert by["cheappills.net"].verdict == "block" and by["gardentools.net"].verdict == by["quietmarket.net"].verdict == "allow"
    tokens = {r.page_id: [f"h:{w}" for w in r.host_words] + ["p:" + re.sub(r"\d+", "#", w) for w in re.findall(r"\w+", r.path)] for r in got}
    seeded = {r.page_id: bool(set(r.host_words) & set(url_filter.SEEDS)) for r in got}
    counts = {c: {} for c in (True, False)}
    for i, own in tokens.items():
        for t in own:
            counts[seeded[i]][t] = counts[seeded[i]].get(t, 0) + 1
    n = {c: sum(counts[c].values()) for c in counts}
    prior = math.log(sum(seeded.values()) / (len(seeded) - sum(seeded.values())))
    for r in got:
        p = {c: sum(math.log((counts[c].get(t, 0) + url_filter.SMOOTH * n[c] / (n[True] + n[False])) / n[c]) for t in tokens[r.page_id]) for c in counts}
        assert r.log_odds == pytest.approx(prior + p[True] - p[False], abs=1e-6) and r.verdict == ("block" if r.log_odds > 0 else "allow")
