import random

from streetflow.llm import linededup


def plain(docs, min_words):
    """Texts after deletion, from all pairs of places. docs: {id: text}."""
    lines = {d: [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs.items()}
    gone = {d: set() for d in docs}
    order = sorted(docs)
    for d in order:
        a = lines[d]
        for e in order:
            if e > d:
                break
            b = lines[e]
            for i in range(len(a)):
                for j in range(len(b)):
                    if e == d and j >= i:
                        break
                    n = words = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1] and not (e == d and j + n >= i):
                        words += len(a[i + n][1].split())
                        n += 1
                    if words >= min_words:
                        gone[d].update(range(a[i][0], a[i + n - 1][0] + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def random_docs(r):
    pool = [" ".join(r.choices("abcdefgh", k=r.randint(1, 30))) for _ in range(14)] + ["", "x " * 60]
    runs = [[r.choice(pool) for _ in range(r.randint(2, 8))] for _ in range(4)]
    docs = {}
    for i in range(30):
        lines = []
        for _ in range(r.randint(0, 5)):
            lines += r.choice(runs) if r.random() < 0.5 else [r.choice(pool) + f" {r.random()}" * (r.random() < 0.7)]
        docs[i] = "\n".join(lines)
    return docs


def test_matches_brute_force(spark):
    r = random.Random(11)
    for _ in range(2):
        docs = random_docs(r)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        cut, new = linededup._cut(df, "doc_id", "text")
        got = {x.doc_id: x.text if x[new] is None else x[new] for x in cut.collect()}
        assert got == plain(docs, linededup.MIN_WORDS)
        assert got != docs


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, "own line\n" + long, "en", "s", 5), (3, None, "en", "s", None),
            (4, "", "en", "s", 0), (5, long, "en", "s", 5), (None, "tiny", None, None, 4), (6, (long + "\n") * 20_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __runs string, n_chars long")
    got = sorted(map(tuple, linededup.apply(df).collect()), key=str)
    assert [x for x in got if x[0] == 1] == [rows[0], rows[1]]
    assert [x for x in got if x[0] == 2] == [(2, "own line", "en", "s", 8)]
    assert not [x for x in got if x[0] in (5, 6)] and len(got) == 6
    assert linededup.apply(df.limit(0)).count() == 0


def test_fingerprints_are_few_and_decide(spark):
    """Far fewer selected lines than lines; every repeated run shares one, and without shared ones nothing is found."""
    r = random.Random(8)
    lines = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", str(k)], k=8)) for k in range(400)]
    data = "\n".join(lines).encode()
    found = linededup.fingerprints(data)
    assert len(found) < 0.4 * len(lines) and len({f[1] for f in found}) == len(found)
    assert all(f[3][k] <= f[1] <= f[4][k] for f in found for k in range(len(f[2])))
    other = "\n".join(["own line", *lines[100:140], "another"]).encode()
    assert {f[0] for f in linededup.fingerprints(other)} & {f[0] for f in found}
    df = spark.createDataFrame([(1, data.decode()), (2, other.decode())], "doc_id long, text string")
    runs = linededup.repeated_runs(df).collect()
    assert [(x.doc_id, x.first, x.last, x.first_doc_id, x.first_line) for x in runs] == [(2, 1, 40, 1, 100)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n_lines = sum(len([x for x in (t or "").split("\n") if x.strip()]) for t, in docs.select("text").collect())
    assert linededup.selected(docs).count() < 0.7 * n_lines


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = random_docs(random.Random(12))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    texts = lambda: sorted(map(tuple, linededup.apply(df).collect()))
    want = texts()
    monkeypatch.setattr(linededup.scratch.broadcast_if_small, "__defaults__", (0,))
    monkeypatch.setattr(linededup.scratch, "SMALL_ROWS", 0)
    assert texts() == want
