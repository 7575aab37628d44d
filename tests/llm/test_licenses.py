import random
import re

from streetflow.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places.sort()
    return (
        len(words),
        len(places),
        places[0][0] if places else None,
        places[-1][0] if places else None,
        ",".join(sorted({x for _, x in places})),
    )


def test_base_matches_brute_force():
    r, scanner = random.Random(3), licenses.Scanner()
    vocab = "gnu general public license apache cc by mit the under licensed released Ünder x9".split()
    texts = [None, "", "—", "GNU General\nPublic-License", "cc by cc by-nc 4.0", "é" * 10]
    texts += [r.choice([" ", "-", "\n"]).join(r.choices(vocab, k=r.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        n, places, spans, best = scanner.scan((t or "").encode())
        got = (
            n,
            len(places),
            places[0][0] if places else None,
            places[-1][0] if places else None,
            ",".join(sorted({scanner.labels[k] for _, k in places})),
        )
        assert got == plain(t), t
        assert 0 <= best <= 1


def test_matching_statistics_are_longest():
    r, scanner = random.Random(4), licenses.Scanner()
    auto = scanner.auto
    strings = [[auto.vocab[w] for w in t] for t in scanner.templates]
    subs = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    ids = [r.choice(r.choice(strings)) for _ in range(200)] + strings[5][2:9] + strings[0] + strings[7]
    for i, (_, n) in enumerate(auto.statistics(ids)):
        assert n == max([k for k in range(1, i + 2) if tuple(ids[i + 1 - k : i + 1]) in subs], default=0)


def test_labels_survive_small_changes(spark):
    mit = next(t for t, k in licenses.NOTICES.items() if k == "mit-text").split()
    changed = [*mit[:10], "xyzzy", *mit[11:]]
    rows = [(1, " ".join(mit)), (2, "aaa " * 9 + " ".join(changed)), (3, " ".join(mit[:8])), (4, None), (5, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.license for x in licenses.scan_licenses(df).collect()}
    assert got[1].labels == "mit-text" and got[1].score == 1.0
    assert got[2].labels == "mit-text" and 0.9 <= got[2].score < 1 and got[2].span_starts == [9]
    assert got[3].labels == "" and 0 < got[3].score < 0.9
    assert got[4].n_words == 0 and got[4].labels == "" and got[4].first_word is None
    assert got[5].n_words == 200_000
    assert licenses.scan_licenses(df.limit(0)).count() == 0
