"""License scan with matching statistics from a generalised suffix automaton.

The automaton holds the token sequences of all templates: the four base phrases and the notices in ``NOTICES``. A file's
words stream through it once; after each word it gives the longest template substring that ends there (the matching
statistic). A phrase stands at a place if its state is on the suffix path of the match there and the match is long
enough. Matches that cannot grow are chained per template, with doc and template places both rising and gaps of at most
``MAX_GAP`` words; a chain that covers ``MIN_COVER`` of a template is a span and gives the template's label.

Words that occur in no template reset the automaton, so only runs of template words are walked.

Nulls: a null text is empty. Without words all counts are 0, both places null, both label strings empty, the score 0.
Repeated rows each get a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# Base phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices with the labels that the method adds.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "gpl-3.0-or-later",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at": "apache-2.0-header",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-deed",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
}
MIN_MATCH, MIN_COVER, MAX_GAP = 3, 0.9, 8
#: Lower-cases A-Z and turns every byte that cannot be part of a word into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, templates: list[list[bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for k, words in enumerate(templates):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                self.ends[last].add((k, at))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, ids: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest template substring that ends here) for each word."""
        out, s, n = [], 0, 0
        after, link, length = self.next, self.link, self.length
        for c in ids:
            while s and c not in after[s]:
                s = link[s]
                n = length[s]
            if c in after[s]:
                s, n = after[s][c], n + 1
            out.append((s, n))
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        self.templates = [t.encode().split() for t in [*phrases, *notices]]
        self.labels = [*phrases.values(), *notices.values()]
        self.base = len(phrases)
        self.auto = Automaton(self.templates)
        # For each state, the phrases (with lengths) on its suffix path: those that its longest string ends in.
        self.phrase_at = []
        for s in range(len(self.auto.length)):
            found, t = [], s
            while t > 0:
                low, high = self.auto.length[self.auto.link[t]], self.auto.length[t]
                for k in range(self.base):
                    size = len(self.templates[k])
                    if low < size <= high and (k, size - 1) in self.auto.ends[t]:
                        found.append((k, size))
                t = self.auto.link[t]
            self.phrase_at.append(found)

    def scan(self, data: bytes | None) -> tuple:
        """n_words, places [(start, phrase)], spans [(label, start, end, coverage)], the best coverage."""
        words = (data or b"").translate(WORD_BYTES).split()
        get = self.auto.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        places, found = [], {}
        if len(known) > 1:
            breaks = np.flatnonzero(np.diff(known) > 1)
            starts, stops = known[np.r_[0, breaks + 1]], known[np.r_[breaks, len(known) - 1]] + 1
            for a, b in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
                stats = self.auto.statistics(ids[a:b].tolist())
                for i, (s, n) in enumerate(stats):
                    if n < 2:
                        continue
                    # Of the suffix path only ends that the matched length reaches count.
                    places += [(a + i - size + 1, k) for k, size in self.phrase_at[s] if size <= n]
                    if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                        for k, at in self.auto.ends[s]:
                            found.setdefault(k, []).append((a + i, at, n))
        spans, best = [], float(bool(places))
        for k in sorted(found):
            if k >= self.base:
                for start, end, cover in self._chains(found[k], len(self.templates[k])):
                    best = max(best, cover)
                    if cover >= MIN_COVER:
                        spans.append((self.labels[k], start, end, cover))
        return len(words), sorted(places), spans, best

    @staticmethod
    def _chains(matches: list[tuple[int, int, int]], size: int):
        """Chains of matches (doc end, template end, length) that rise in both, as (first word, last word, coverage)."""
        open_chains: list[list[int]] = []  # first word, last word, last template place, covered words
        done: list[list[int]] = []
        for end, at, n in sorted(matches):
            # A chain this far behind cannot be continued by this match or a later one.
            done += [c for c in open_chains if c[1] < end - size - MAX_GAP]
            open_chains = [c for c in open_chains if c[1] >= end - size - MAX_GAP]
            start, best = end - n + 1, None
            for chain in open_chains:
                if end > chain[1] and at > chain[2] and start - chain[1] <= MAX_GAP + 1:
                    covered = chain[3] + min(n, at - chain[2], end - chain[1])
                    if best is None or covered > best[3]:
                        best = [chain[0], end, at, covered]
            open_chains.append(best if best is not None and best[3] > n else [start, end, at, n])
        # Of chains that start alike, the one that covers most.
        top: dict[int, list[int]] = {}
        for c in done + open_chains:
            if c[0] not in top or c[3] > top[c[0]][3]:
                top[c[0]] = c
        return [(c[0], c[1], min(1.0, c[3] / size)) for c in top.values()]


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("span_labels", T.ArrayType(T.StringType())),
        T.StructField("span_starts", T.ArrayType(T.LongType())),
        T.StructField("span_ends", T.ArrayType(T.LongType())),
    ]
)


def scan_licenses(df: DataFrame, text_col: str = "text", out: str = "license") -> DataFrame:
    """df with a struct column ``out``: word count, base places, labels, score and the spans with their labels."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        scanner, rows = Scanner(), []
        for data in texts:
            n, places, spans, best = scanner.scan(data)
            base = {scanner.labels[k] for _, k in places}
            rows.append(
                (
                    n,
                    len(places),
                    places[0][0] if places else None,
                    places[-1][0] if places else None,
                    ",".join(sorted(base)),
                    ",".join(sorted(base | {x[0] for x in spans})),
                    float(best),
                    [x[0] for x in spans],
                    [x[1] for x in spans],
                    [x[2] for x in spans],
                )
            )
        frame = pd.DataFrame(rows, columns=RESULT.names)
        for c in ("first_word", "last_word"):
            frame[c] = frame[c].astype("Int64")
        return frame

    return df.withColumn(out, run(F.col(text_col).cast("binary")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: base phrases and method labels of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select(
        "doc_id", *(f"license.{c}" for c in RESULT.names[:7])
    )
