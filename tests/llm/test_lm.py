import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetflow.llm import lm, scratch


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_base_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 15_000)
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*words(t), None])
    n, v = c.total(), len(c)
    got = {r.doc_id: r for r in lm.query(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        tokens, r = [*words(t), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(x in c for x in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in tokens))
        assert r.score < 0 and math.isfinite(r.score)


def test_model_beats_its_start_on_held_out_text(spark):
    """Trained attention predicts held-out classes better than the class shares alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    is_held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    trained = {r.doc_id: r for r in lm.score_documents(docs, is_held).where("held_out").collect()}
    steps, lm.ROUNDS = lm.ROUNDS, 0
    try:
        plain = {r.doc_id: r for r in lm.score_documents(docs, is_held).where("held_out").collect()}
    finally:
        lm.ROUNDS = steps
    a, b = (sum(r.score for r in x.values()) for x in (trained, plain))
    assert a > 0.97 * b


def small():
    m = lm.new_model(40)
    r = np.random.default_rng(1)
    return {k: v + r.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in m.items()}, r


def test_gradients_match_differences():
    m, r = small()
    m = {k: v.astype(np.float64) for k, v in m.items()}
    x, y = r.integers(0, 40, (3, 2 * lm.STEP)), r.integers(0, lm.CLASSES, (3, lm.STEP))
    weight = np.ones((3, lm.STEP))
    _, g = lm.gradients(m, x, y, weight)
    for k in m:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in m[k].shape)
            if k == "embed":
                at = (x[0, -3], at[1])
                mine = g[k][1][np.flatnonzero(g[k][0] == at[0])[0], at[1]]
            else:
                mine = g[k][at]
            old = m[k][at]
            side = []
            for d in (1e-5, -1e-5):
                m[k][at] = old + d
                side.append(lm.gradients(m, x, y, weight)[0])
            m[k][at] = old
            assert mine == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_windows_score_each_id_once_and_look_back_only():
    m, r = small()
    lens = np.array([0, 3, 16, 17, 50])
    seq = r.integers(0, 20, lens.sum()).astype(np.int32)
    id_lens, ids = np.full(20, 1, np.int32), np.arange(20, dtype=np.int32)
    cls, share = lm.classes_of(r.integers(0, 9, 40))
    flow = lm.streams(seq, lens, id_lens, ids, 39)
    assert list(flow[3]) == [1, 4, 17, 18, 51]
    got = lm.score_streams(m, cls, share, flow)
    # Plain scoring: for every id the window that its place falls into.
    inputs, target, begin, size = flow
    for d in range(5):
        total = 0.0
        for t in range(size[d]):
            start = begin[d] + max(0, t // lm.STEP * lm.STEP - lm.STEP)
            x = inputs[start : begin[d] + t + 1]
            offset = 2 * lm.STEP - (t // lm.STEP * lm.STEP + lm.STEP - (start - begin[d]))
            e = m["embed"][x] + m["place"][offset : offset + len(x)]
            s = (e[-1] @ m["q"]) @ (e @ m["k"]).T * lm.SCALE
            p = np.exp(s) / np.exp(s).sum()
            z = (e[-1] + p @ (e @ m["v"]) @ m["o"]) @ m["out"] + m["bias"]
            k = target[begin[d] + t]
            total += (z - np.log(np.exp(z).sum()))[cls[k]] / np.log(10) + share[k]
        assert got[d] == pytest.approx(total, rel=1e-4)


def test_ids_have_probability_one():
    cls, share = lm.classes_of(np.random.default_rng(0).integers(0, 1000, 5000) ** 2)
    assert np.bincount(cls, weights=10.0**share) == pytest.approx(np.ones(lm.CLASSES), rel=1e-3)


def test_edges(spark):
    rows = [(None, "A b", "x"), (1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "word " * 100_000, "x"), (5, "é" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm.score_documents(df, F.col("doc_id") == 3).collect()
    assert len(got) == 7 and {r.train_tokens for r in got} == {2 + 1 + 1 + 1 + 100_001 + 2}
    assert sorted((r.doc_id or 0, r.n_tokens, r.held_out) for r in got) == [
        (0, 3, False), (1, 1, False), (2, 1, False), (3, 3, True), (3, 3, True), (4, 100_001, False), (5, 2, False)]
    assert lm.score_documents(df.limit(0), F.lit(False)).count() == 0
    assert {r.train_tokens for r in lm.score_documents(df, F.lit(True)).collect()} == {0}


def test_every_document_is_learnt(spark, monkeypatch):
    """Training documents move the model: short ones, openings, in all blocks; held-out ones do not."""
    monkeypatch.setattr(lm, "BLOCK_DOCS", 4)
    monkeypatch.setattr(lm, "SHARE", 1)
    rows = [(i, f"{w} " * 40 if i % 2 else w, i == 7) for i, w in enumerate("apple bridge castle doctor engine forest garden hammer".split())]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").coalesce(1)
    ranks = lm.read_vocabulary()
    data = df.select("doc_id", "held", F.col("text").cast("binary").alias("data"))
    blocks = scratch.stage(lm.make_blocks(data, ranks), "blocks")
    assert blocks.count() == 2
    counts = np.ones(len(ranks) + 1, np.int64)
    cls, _ = lm.classes_of(counts)
    units = scratch.stage(lm.unit_windows(blocks, len(ranks), 3), "units")
    start, m = lm.start_model(counts, cls), lm.train(units, counts, cls)
    encode = lm.Subwords(ranks)
    for i, w, out in rows:
        # A one-word document teaches what follows its word: the end.
        _, ids = encode([w.encode()])
        assert bool((m["embed"][ids] != start["embed"][ids]).any()) != out, w


def test_share_of_windows_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", F.lit(False).alias("held"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    )
    ranks = lm.read_vocabulary()
    blocks = scratch.stage(lm.make_blocks(docs, ranks), "blocks")
    all_windows = sum(int((-(-lm.streams(*lm.unpack(b), len(ranks))[3] // lm.STEP)).sum()) for b in blocks.collect())
    got = lm.unit_windows(blocks, len(ranks), 5).agg(F.sum("n")).first()[0]
    assert got == pytest.approx(all_windows / lm.SHARE, rel=0.1)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "UNIT_BYTES", 60_000)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 15_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    is_held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scores = []
    for n in (1, 8, 64):
        got = lm.score_documents(docs.repartition(n), is_held).select("doc_id", "base_score", "score").collect()
        scores.append(sorted((r.doc_id, round(r.base_score, 6), r.score) for r in got))
    for other in scores[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in scores[0]]
        assert [x[2] for x in other] == pytest.approx([x[2] for x in scores[0]], abs=0.0021)


def test_passages_by_hand():
    words = [f"w{i}".encode() for i in range(200)]
    hashes = lm.hash_words(words)
    r = np.random.default_rng(2)
    lens = np.array([0, 1, 90, 200, 90])
    seq = r.integers(0, 200, lens.sum()).astype(np.int32)
    seq[-90:] = seq[1:91]
    found, doc, of_token = lm.passages(seq, lens, hashes)
    want, at = [], 0
    for d, n in enumerate(lens):
        part = []
        for w in [*seq[at : at + n].tolist(), None]:
            part.append(w)
            if w is None or hashes[w] % lm.PASSAGE == 0:
                want.append((d, tuple(part)))
                part = []
        at += n
    assert doc.tolist() == [d for d, _ in want] and len(of_token) == lens.sum() + len(lens)
    assert np.bincount(of_token).tolist() == [len(p) for _, p in want]
    same = lambda a: [[x == y for y in a] for x in a]
    assert same(found.tolist()) == same([p for _, p in want])


def test_texts_that_stand_elsewhere_score_apart(spark):
    """Held-out and training copies of a training document are recalled, whole; a document does not recall itself."""
    r = np.random.default_rng(1)
    text = lambda: " ".join("".join(r.choice(list("abcdefghij"), 6)) for _ in range(120))
    texts = [text() for _ in range(60)]
    rows = [(i, t, i % 10 == 0) for i, t in enumerate(texts)] + [(100, texts[1], True), (101, texts[2], False), (102, texts[10], True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_held boolean")
    got = {x.doc_id: x for x in lm.score_documents(df, F.col("is_held")).collect()}
    twice = {100, 2, 101}
    assert {i for i, x in got.items() if x.n_recalled == x.n_passages} == twice
    # A passage that is the end alone may stand elsewhere by chance.
    assert all(x.n_recalled <= 1 for i, x in got.items() if i not in twice)
    rate = {i: x.score / x.n_tokens for i, x in got.items()}
    assert min(rate[i] for i in twice) > 0.3 * max(rate[i] for i in set(got) - twice)


def test_subwords_of_many_words_are_those_of_each(monkeypatch):
    import tiktoken

    ranks = lm.read_vocabulary()
    one = tiktoken.Encoding("one", pat_str=r"(?s:.{1,64})", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words = ["a", "the", "é" * 70, "x" * 200, "zürich,", "12\u00a03", "日本語", "\u00a0", "don't"] * 3 + ["qqzzx"]
    for together in (lm.TOGETHER, 2):
        monkeypatch.setattr(lm, "TOGETHER", together)
        lens, ids = lm.Subwords(ranks)([w.encode() for w in words])
        parts = np.split(ids, np.cumsum(lens)[:-1])
        assert [p.tolist() for p in parts] == [one(" " + w) for w in words]
    assert [len(x) for x in lm.Subwords(ranks)([])] == [0, 0]


def test_every_window_teaches(spark):
    """A unit gets all ids of the training documents, and the rounds together cut each of their windows once."""
    texts = [" ".join(f"w{i}x{j}" for j in range(20 * i + 1)) for i in range(9)]
    df = spark.createDataFrame([(i, i == 4, t.encode()) for i, t in enumerate(texts)], "doc_id long, held boolean, data binary")
    ranks = lm.read_vocabulary()
    blocks = scratch.stage(lm.make_blocks(df, ranks), "blocks")
    want = 0
    for b in blocks.collect():
        size = lm.streams(*lm.unpack(b), len(ranks))[3]
        want += int(size[~np.array(b["held"], bool)].sum())
    got = 0
    for u in lm.unit_windows(blocks, len(ranks), 2).collect():
        target = np.concatenate([lm.unpack_array(x, np.int32) for x in u.ids])
        ids = lm.cut_windows(target, np.array(u.sizes), np.arange(u.n), len(ranks))
        places = ids[:, 2 * lm.STEP :] >= 0
        assert sorted(ids[:, 2 * lm.STEP :][places].tolist()) == sorted(target.tolist())
        got += int(places.sum())
    assert got == want
