import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from streetflow.llm import langid


def test_held_out_accuracy(spark):
    got = langid.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert len(rows) > 150 and sum(r.ok for r in rows) / len(rows) > 0.97


def test_backoff_order():
    m = langid.Model([("a", "foo foo bar"), ("b", "qux qux quz")])
    assert m.predict("foo")[0] == "a" and m.predict("quzz")[0] == "b" and m.predict("ba")[0] == "a"
    assert m.predict("")[0] == m.predict(None)[0] == m.predict("123 --")[0] == m.predict("\u00b2\u00bd")[0] == "und"
    assert m.predict("ж")[0] == "a" and 0 < m.predict("foo qux")[1] <= 1


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    df = spark.createDataFrame([(None, "foo", "a"), (1, None, "a"), (2, "foo", None), (3, "bar bar", "a")], schema)
    model = langid.fit(df)
    assert model.langs == ["a"]
    assert [x.language.lang_pred for x in langid.predict(df, model).collect()].count("und") == 1
    none = langid.fit(df.limit(0))
    assert none.predict("foo") == ("und", 0.0)
    assert langid.predict(df.limit(0), model).count() == 0


def plain(rows, text):
    """Word-first backoff with plain dictionaries; {lang: log score}."""
    langs = sorted({x for x, _ in rows})
    words = {x: Counter(w for lang, t in rows if lang == x for w in langid.LETTERS.findall(t.lower())) for x in langs}

    def table(counts, most):
        keys = {k for c in counts.values() for k, _ in sorted(c.items(), key=lambda y: (-y[1], y[0]))[:most]}
        size = {x: sum(counts[x].values()) + 0.5 * (len(keys) + 1) for x in langs}
        return {k: {x: math.log((counts[x][k] + 0.5) / size[x]) for x in langs} for k in keys}

    known, grams = table(words, langid.MAX_WORDS), {}
    cut = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    for n in langid.ORDERS:
        counts = {x: Counter() for x in langs}
        for x in langs:
            for w, k in words[x].items():
                for g in cut(w, n):
                    counts[x][g] += k
        grams[n] = table(counts, langid.MAX_GRAMS)
    out = dict.fromkeys(langs, 0.0)
    for w in langid.LETTERS.findall(text.lower()):
        found = [known[w]] if w in known else next((f for n in langid.ORDERS if (f := [grams[n][g] for g in cut(w, n) if g in grams[n]])), [])
        for x in langs:
            out[x] += sum(f[x] for f in found) / max(1, len(found))
    return out


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_WORDS", 300)
    monkeypatch.setattr(langid, "MAX_GRAMS", 200)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null").collect()
    learn = [(r.lang, r.text) for r in rows[:60]]
    m = langid.Model(learn)
    for r in rows[60:120]:
        want = plain(learn, r.text)
        got = m.totals(Counter(langid.LETTERS.findall(r.text.lower())))
        assert got == pytest.approx([want[x] for x in m.langs], rel=1e-9)
        if m.predict(r.text)[0] != "und":
            assert want[m.predict(r.text)[0]] == pytest.approx(max(want.values()), abs=1e-6)


def test_every_language_is_learnt(spark):
    """No cap on the number of languages; names that the sampling uses inside may be columns."""
    rows = [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i:03}", 1, 2, 3.0, "x") for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank int, size int, share double, language string")
    m = langid.fit(df)
    assert len(m.langs) == 260 and all(m.predict(t)[0] == lang for _, t, lang, *_ in rows[::10])
    out = langid.predict(df, m)
    assert out.columns == df.columns and {r.language.lang_pred == r.lang for r in out.collect()} == {True}
    assert m.predict("wortaa " * 300_000) == ("l000", m.predict("wortaa " * 300_000)[1])
