import random
import re
from itertools import combinations

from streetflow.llm import decontaminate as dec


def split(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def plain(docs, items):
    """Every place of every text against all places of all items, by a table of the masked words."""
    out, table, split_items = {}, {}, {k: split(t) for k, t in items}
    for n, m in enumerate(dec.MASKS):
        on = [x for x, c in enumerate(m) if c == "1"]
        for k, i in split_items.items():
            for q in range(len(i) - len(m) + 1):
                table.setdefault((n, *(i[q + x] for x in on)), []).append((k, q))
    for d, t in docs:
        w = split(t)
        for n, m in enumerate(dec.MASKS):
            on = [x for x, c in enumerate(m) if c == "1"]
            for p in range(len(w) - len(m) + 1):
                for k, q in table.get((n, *(w[p + x] for x in on)), ()):
                    i = split_items[k]
                    size = min(dec.REGION, len(i))
                    same = 0
                    # All stretches of REGION words of the item that hold the start of the seed and end inside the item.
                    for f in range(max(0, q - 5), max(0, min(q, len(i) - dec.REGION)) + 1):
                        agree = sum(0 <= p - q + f + x < len(w) and w[p - q + f + x] == i[f + x] for x in range(size))
                        same = max(same, agree)
                    if same >= (dec.MIN_MATCH if size == dec.REGION else -(-size * 4 // 5)):
                        out[d, k] = max(out.get((d, k), 0), same)
    return out


def cases():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([5, 7, 9, 14, 30])))) for k in range(12)] + [(50, None), (51, "")]
    docs = [(100, None), (101, "")]
    for d in range(40):
        w = r.choices(vocab, k=r.randint(0, 30))
        if d % 2:
            part = split(r.choice(items)[1])
            for _ in range(r.randint(0, 3)):
                if part:
                    part[r.randrange(len(part))] = "zz"
            at = r.choice([0, len(w)])
            w[at:at] = part
        docs.append((d, " ".join(w).upper() if d % 3 else ", ".join(w)))
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = cases()
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert {(r.doc_id, r.item_id): r.best for r in dec.find_leaks(a, b).collect()} == want and len(want) > 5
    monkeypatch.setattr(dec, "BLOCK_WORDS", 90)
    monkeypatch.setattr(dec, "PIECE", 30)
    assert {(r.doc_id, r.item_id): r.best for r in dec.find_leaks(a, b.coalesce(1)).collect()} == want


def test_edges(spark):
    item = " ".join(f"b{i}" for i in range(20))
    a = spark.createDataFrame([(None, item, 1), (1, item, 2), (1, item, 2), (2, "clean", 3), (3, "z " * 300_000 + item, 4)],
                              "doc_id long, text string, hash int")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id for r in dec.find_leaks(a, b).collect()} == {None, 1, 3}
    assert [r.doc_id for r in dec.apply(a, b).collect()] == [2]
    assert dec.apply(a, b.limit(0)).count() == 5 and dec.apply(a.limit(0), b).count() == 0


def test_masks_meet_every_two_misses():
    """Wherever two of twelve words differ, some mask fits beside them."""
    for miss in combinations(range(dec.REGION), 2):
        fits = (
            all(a + o not in miss for o, c in enumerate(m) if c == "1")
            for m in dec.MASKS
            for a in range(dec.REGION - len(m) + 1)
        )
        assert any(fits), miss


def test_every_fifth_word_replaced(spark):
    words = [f"b{i}" for i in range(60)]
    docs = [(k, " ".join("zz" if i % 5 == k else w for i, w in enumerate(words))) for k in range(5)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert {r.doc_id for r in dec.find_leaks(a, b).collect()} == {0, 1, 2, 3, 4}


def test_long_items_equal_the_uncut_search(spark):
    """The cut of long items into pieces changes no result; a short tail of a piece has no threshold of its own."""
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    items = [(n, " ".join(r.choices(vocab, k=n))) for n in (1988, 1995, 2000, 2003, 2012, 4001, 4100)]
    docs = []
    for n, t in items:
        w = t.split()
        for at in (0, 1980, 1990, 1995, 2000, n - 7, n - 12, n - 20):
            for k in (7, 11, 12, 30):
                part = w[at : at + k]
                if len(part) > 8:
                    part[4] = "zz"
                docs.append((len(docs), " ".join(["x"] * r.randint(0, 3) + part + ["y"] * r.randint(0, 20))))
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert {(x.doc_id, x.item_id): x.best for x in dec.find_leaks(a, b).collect()} == want
    assert 20 < len({d for d, _ in want}) < len(docs) - 20
