import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from streetflow.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    tally = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        tally.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * tally[b] > len(grams))


def plain_components(fps):
    low = {}
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    for i in ids:
        low.setdefault(find(i), []).append(i)
    return {i: min(low[find(i)]) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)


def test_matches_brute_force(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(50)]
    rows, base = [], [r.choice(words) for _ in range(400)]
    for i in range(60):
        t = list(base) if i % 2 else [r.choice(words) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            if t:
                t[r.randrange(len(t))] = r.choice(words)
        rows.append((i * 3, " ".join(t)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE\ttwo"), (504, "É é"), (505, "x " * 300_000)]
    check(spark, rows)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", "", "", 1), (4, "a b c d", "", "", 1), (4, "a b c d", "", "", 1)], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {4}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [8, 24])
def test_long_lists_lose_no_link(spark, spread):
    """Thousands of fingerprints that share bytes: the components equal those of all pairs."""
    r, low = random.Random(spread), 0x1234_5678_9ABC_0000_0000 >> 16
    fps = {(low << 24 ^ r.getrandbits(spread)) & (1 << 62) - 1 for _ in range(2500 if spread == 24 else 200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = simhash.connected_components(simhash.links(df), "a", "b").collect()
    want = plain_components({x: x for x in fps})
    assert {x.node: x.root for x in got} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("n", [2, 40, 200])
def test_top_bit_counts_like_any_other(spark, n):
    """Fingerprints that differ in bit 63, in short lists and in lists that are posted again."""
    r, low = random.Random(n), 0x1234_5678_9ABC_DE00
    fps = {low, low ^ (1 << 63 | 1), low ^ ((1 << 10) - 1) << 54}
    fps |= {low ^ r.getrandbits(1) << 63 ^ r.getrandbits(8) << 8 ^ r.getrandbits(6) << 57 for _ in range(n)}
    fps = sorted(signed(x) for x in fps)
    a = np.array(fps, np.int64)
    for x in fps:
        want = [(x % (1 << 64) ^ y % (1 << 64)).bit_count() <= 3 for y in fps]
        assert simhash.near(a, np.full_like(a, x)).tolist() == want
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = simhash.connected_components(simhash.links(df), "a", "b").collect()
    want = plain_components({x: x % (1 << 64) for x in fps})
    assert {x.node: x.root for x in got} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_components_in_rounds_and_in_one_task(spark, monkeypatch):
    from streetflow.llm import components

    r = random.Random(6)
    edges = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    low = {}
    for a, b in edges:
        if a != b:
            group = low.get(a, {a}) | low.get(b, {b})
            low.update(dict.fromkeys(group, group))
    want = sorted((i, min(g)) for i, g in low.items())
    for small in (components.SMALL_EDGES, 0):
        monkeypatch.setattr(components, "SMALL_EDGES", small)
        assert sorted(map(tuple, components.connected_components(df, "a", "b").collect())) == want
