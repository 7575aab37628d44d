from streetflow.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, domain string"


def fill(children, budget):
    """Shares by rounds: who cannot use its share is full and leaves the rest to its siblings."""
    grant, left, open_ = {}, budget, {k: v for k, v in children.items() if v[1] > 0}
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap * total <= left * w]
        if not full:
            return grant | {k: left * w // total for k, (_, w) in open_.items()}
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        grant[k] = open_[k][0]
        left -= open_.pop(k)[0]
    return grant


def test_grants_match_rounds(spark):
    leaves = [("web", "en", f"s{i}", 10 * (i + 1)) for i in range(5)] + [("web", "de", "s9", 7), ("books", "en", "s1", 500),
              ("code", "fr", "s2", 3), ("zero", "en", "s3", 1000)]
    weights = {"domain": {"web": 5, "books": 1, "zero": 0}, "language": {"en": 2}, "src": {"s0": 3}}
    df = spark.createDataFrame(leaves, "domain string, language string, src string, words long")
    for percent in (5, 40, 100, 900):
        got = {(r.domain, r.language, r.src): r.grant for r in mixing.budgets(df, percent, 2, weights).collect()}
        caps = {x[:3]: 2 * x[3] for x in leaves if weights["domain"].get(x[0], 1)}
        want = {(): min(sum(caps.values()), sum(x[3] for x in leaves) * percent // 100)}
        for depth, level in enumerate(mixing.LEVELS):
            now = {}
            for parent, budget in want.items():
                names = {k[depth] for k in caps if k[:depth] == parent}
                kids = {n: (sum(c for k, c in caps.items() if k[: depth + 1] == (*parent, n)), weights[level].get(n, 1)) for n in names}
                now |= {(*parent, n): g for n, g in fill(kids, budget).items()}
            want = now
        assert {k: v for k, v in got.items() if k in want} == want
        assert got["zero", "en", "s3"] == 0


def test_edges(spark):
    rows = [(1, "a b", "en", "src1", "x"), (1, "a b", "en", "src1", "x"), (None, "c", None, None, None), (2, None, "en", "src1", "x"),
            (3, "", "de", "src2", "x"), (4, "w " * 200_000, "en", "odd", "x"), (5, "q", "en", "src99999999999", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, percent=1000).collect()
    assert sorted((r.doc_id or 0, r.epochs) for r in got) == [(0, 4), (1, 4), (1, 4), (4, 4), (5, 4)]
    assert got[0].__fields__ == ["doc_id", "text", "lang", "source", "domain", "n_words", "epochs"]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, percent=0).count() == 0
