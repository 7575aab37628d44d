import random
from collections import defaultdict

import numpy as np
import pytest

from streetflow.llm import longhash, pipeline, simhash

SF = "/root/testdata/sf0.01"


def plain_links(rows, least=longhash.LEAST):
    """All pairs of different shingle sets with a five-word Jaccard similarity of least or more, and the sets."""
    sets, lists, out = {i: frozenset(longhash.grams((t or "").encode())) for i, t in rows}, defaultdict(list), {}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    for i in sorted(first.values()):
        seen = defaultdict(int)
        for g in sets[i]:
            for j in lists[g]:
                seen[j] += 1
            lists[g].append(i)
        for j, both in seen.items():
            like = both / (len(sets[i]) + len(sets[j]) - both)
            if like >= least:
                out[j, i] = like
    return sets, first, out


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def plain_kept(rows, least=longhash.LEAST):
    sets, first, pairs = plain_links(rows, least)
    roots = components(first.values(), pairs)
    return {i for i in sets if roots[first[sets[i]]] == i}


def test_near_copies_by_brute_force(spark):
    """All that goes is a near copy of 0.8 or more, and nearly all near copies are found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[^\\\\s]'")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_kept(rows)
    got = {r.doc_id for r in simhash.keep_one(docs, classes=longhash.classes).collect()}
    assert got >= want and len(got - want) <= 0.05 * (len(rows) - len(want))
    assert got != {r.doc_id for r in simhash.keep_one(docs).collect()}


def test_recall_at_each_similarity():
    """Share of pairs that pass posting, count filter and distance, by exact similarity."""
    r = random.Random(3)
    hit, n = defaultdict(int), defaultdict(int)
    for _ in range(1200):
        size = r.choice([30, 80, 200, 500])
        a = [f"w{r.randrange(100000)}" for _ in range(size)]
        b = [w if r.random() > r.choice([0.003, 0.01, 0.02]) else "new" + w for w in a]
        x, y = (longhash.shingle_hashes(" ".join(t).encode()) for t in (a, b))
        like = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        pair = np.stack([longhash.fingerprint(x), longhash.fingerprint(y)])
        words, (c, d) = pair.view(np.uint64), longhash.keys_of(pair)
        rough = int(longhash.distances(words[0, :1], words[1, :1])) <= longhash.ROUGH
        close = rough and longhash.distances(words[0], words[1]) <= longhash.LOOSE and (pair[0] == pair[1]).sum() >= longhash.MIN_SHARED
        if like >= 0.8:
            k = round(like * 10) / 10 if like < 0.95 else 0.95
            n[k] += 1
            hit[k] += bool((c == d).any() and close)
    assert sum(hit.values()) / sum(n.values()) > 0.95 and hit[0.8] / n[0.8] > 0.8 and hit[0.9] / n[0.9] > 0.95, (hit, n)


@pytest.mark.parametrize("spread", [10, 60, 120])
def test_forest_connects_all_within_the_radius(spread):
    """Against all pairs, for tight and for diffuse groups and for two groups side by side."""
    r = np.random.default_rng(spread)
    base = r.integers(0, 2, longhash.BITS, dtype=np.uint8)
    rows = []
    for k in range(160):
        bits = base.copy()
        bits[r.choice(longhash.BITS, spread // 2 + (90 if k % 5 == 0 else 0), replace=False)] ^= 1
        rows.append(np.packbits(bits))
    sigs = np.stack(rows).view(np.uint64)
    links, hubs = longhash.forest(sigs)
    away = np.stack([longhash.distances(sigs, s) for s in sigs])
    pairs = [(i, j) for i in range(160) for j in range(i) if away[i, j] <= longhash.RADIUS]
    assert all(away[i, j] <= longhash.RADIUS for i, j in links) and len(links) < 160
    want = components(range(160), [(j, i) for i, j in pairs])
    assert components(range(160), links) == want


def test_long_lists(spark, monkeypatch):
    """A group of many edited copies hangs together, also where it is read in chunks; others are left alone."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(w if r.random() > 0.004 else f"x{k}" for w in base)) for k in range(300)]
    rows += [(1000 + k, " ".join(f"y{k}_{j % 60}" for j in range(100))) for k in range(40)] + [(k, rows[5][1]) for k in (2000, 2001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {0, *range(1000, 1040)}
    for chunk in (longhash.CHUNK, 50):
        monkeypatch.setattr(longhash, "CHUNK", chunk)
        assert {x.doc_id for x in simhash.keep_one(df, classes=longhash.classes).collect()} == want


def test_lists_are_cut_alike_however_they_come():
    import pandas as pd

    r = np.random.default_rng(0)
    key = np.sort(np.concatenate([r.integers(0, 60, 150), np.full(90, 7), np.full(40, 59)]))
    fp = np.arange(len(key)).astype(np.int64)
    key = key.astype(np.int32)
    results = []
    for size in (1, 7, 64, 1000):
        parts = [pd.DataFrame({"key": key[s : s + size], "fp": fp[s : s + size]}) for s in range(0, len(key), size)]
        out = pd.concat(list(longhash.scan(iter(parts))))
        hot = set(map(tuple, out[out.b.isna()][["key", "a"]].astype(int).to_numpy().tolist()))
        results.append((hot, set(map(tuple, out[out.b.notna()][["a", "b"]].astype(int).to_numpy().tolist()))))
    assert all(x == results[0] for x in results)
    assert {k for k, _ in results[0][0]} == {7, 59} and len(results[0][0]) == sum((key == 7) | (key == 59))


def test_stage_joins_copies_beyond_three_bits(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(n, " ".join(w if k // 9 != n else f"new{n}" for k, w in enumerate(words)), 1, 1, "x") for n in range(4)]
    rows += [(9, "some other text of few words", 1, 1, "x"), (10, None, 1, 1, "x"), (11, "", 1, 1, "x"), (9, "some other text of few words", 1, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, n int, sig string")
    assert len({simhash.fingerprint(t.encode()) for _, t, *_ in rows[:4]}) > 1
    got = pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [0, 9, 10]
    assert pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_the_length_of_a_list_changes_no_class(spark, monkeypatch):
    """Texts around the least similarity, some of which the fingerprints alone would link, have the classes of all pairs."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(90):
        places = set(r.sample(range(300), 2 + k % 7))
        rows.append((k, " ".join(f"x{k}_{i}" if i in places else w for i, w in enumerate(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = []
    for limit in (2, 8, 32, 1000):
        monkeypatch.setattr(longhash, "LIST_LIMIT", limit)
        fps, roots = longhash.classes(df, "doc_id", "text")
        ids = {x.fp: x.doc_id for x in fps.collect()}
        groups = defaultdict(set)
        for x in roots.collect():
            groups[x.root].add(ids[x.fp])
        told.append(sorted(map(sorted, groups.values())))
    assert all(x == told[-1] for x in told), [[len(g) for g in x] for x in told]
    _, first, pairs = plain_links(rows)
    linked = components(first.values(), pairs)
    assert all(len({linked[i] for i in g}) == 1 for x in told for g in x)
