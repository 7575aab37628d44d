import duckdb

from streetflow.llm import langid, linededup, mixing, pipeline, scratch
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_longhash import plain_kept

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark, tmp_path):
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id").fetchall()
    items = con.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    model = langid.Model([(x[2], x[1]) for x in docs if x[1] is not None and x[2] is not None])
    kept = {x[0]: x for x in docs if (p := model.predict(x[1]))[0] != "und" and p[1] >= pipeline.MIN_SCORE}
    cut = plain_lines({i: x[1] for i, x in kept.items()}, linededup.MIN_WORDS)
    assert cut != {i: x[1] for i, x in kept.items()}
    cut = {i: t for i, t in cut.items() if t.split() or t == kept[i][1]}
    low = plain_kept(list(cut.items()))
    cut = {i: t for i, t in cut.items() if i in low}
    bad = {d for d, _ in plain_leaks(list(cut.items()), items)}
    rows = [(i, t, kept[i][2], kept[i][3], len(t)) for i, t in cut.items() if i not in bad]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(f"select doc_id, epochs from ({mixing.ORACLE})").fetchall()
    got = pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.epochs) for r in got.collect()) == sorted(want)
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    assert all(texts[i] == (t, len(t)) for i, t, *_ in rows if i in texts)


def test_stages_on_odd_rows(spark, tmp_path):
    long = " ".join(f"the word{i}" for i in range(80))
    rows = [(None, long, "en", None, 1, "q"), (1, long, "en", "src1", 1, "q"), (1, long, "en", "src1", 1, "q"), (2, None, None, "src2", 1, "q"),
            (3, "", "en", "src1", 0, "q"), (4, "Der Text " * 30_000, "de", "src1", 1, "q"), (5, "short words here", "en", "src1", 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string")
    for n, rows_left in ((None, {None, 4, 5}), (0, set())):
        docs = df if n is None else df.limit(n)
        for name, stage in pipeline.STAGES[:4]:
            docs = scratch.stage(stage(spark, docs, SF), name)
            assert docs.columns == df.columns
        assert {r.doc_id for r in docs.collect()} == rows_left
        assert pipeline.STAGES[4][1](spark, docs, SF).columns[-1] == "epochs"
