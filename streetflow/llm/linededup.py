"""Deletion of repeated runs of lines by winnowing over line hashes.

A run is a stretch of consecutive lines (blank ones aside) with ``MIN_WORDS`` words or more in all. A line is deleted if
a run that contains it also stands at an earlier place, in the order (doc_id, hash of the text, line); within one
document a repeat that overlaps its first place is none. So the first copy of everything stays.

1. Winnowing. Every shortest window of consecutive lines that reaches ``MIN_WORDS`` words, from every start and to every
   end, selects the smallest of its line hashes (the first on a tie). A selected line is a fingerprint: one row per
   selected line, with the windows that selected it. Equal runs hold equal windows and select equal lines, so a repeated
   run is guaranteed a shared fingerprint. Most lines are selected by no window and most fingerprints occur once.
2. Join. Fingerprints are counted (a number per hash, summed where it arises), and positions of those that occur once are
   left out. Only for the others are the windows around the position unpacked.
3. Extension. A match grows both ways from the shared line: windows around it with equal content (128-bit hash) are one
   class, reduced to its first place by partial aggregation; no pairs are made, however often a run occurs. The later
   windows of a document that overlap are merged into maximal runs.
4. Deletion of the later runs. Only their places travel to the texts, by broadcast while they are few (counted).

Limits: the unit is the line, so a passage that starts or ends inside a line counts with its whole lines only.

Rows with the same id and text are one document and are treated alike. Nulls: a null text stays null; a null id sorts
first. Ties of hashes go to the first line of a window, ties of places are one place. A document of which no word stays is
left out by ``apply``. An empty table gives no rows. Very long texts are read line by line in one pass; a text's windows
are at most twice its lines. Lines are compared without surrounding white space. Other columns are passed through,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from streetflow.llm import scratch
from streetflow.llm.names import prefix

MIN_WORDS = 50
FINGERPRINTS = "doc_id long, text_hash long, fp long, line int, wins array<binary>, firsts array<int>, lasts array<int>"


def fingerprints(data: bytes, min_words: int = MIN_WORDS) -> list[tuple[int, int, list[bytes], list[int], list[int]]]:
    """(hash, line, and per window that selected it: content hash, first line, last line) of every selected line."""
    at, digest, words = [], [], []
    for i, line in enumerate(data.split(b"\n")):
        n = len(line.split())
        if n:
            at.append(i)
            digest.append(xxhash.xxh3_128_digest(line.strip()))
            words.append(n)
    total = [0, *accumulate(words)]
    if total[-1] < min_words:
        return []
    found = set()
    for i in range(len(at)):
        j = bisect_left(total, total[i] + min_words)
        if j < len(total):
            found.add((i, j - 1))
        k = bisect_right(total, total[i + 1] - min_words) - 1
        if k >= 0:
            found.add((k, i))
    out: dict[int, tuple] = {}
    for i, j in sorted(found):
        part = digest[i : j + 1]
        k = i + part.index(min(part))
        if k not in out:
            out[k] = (int.from_bytes(digest[k][:8], "big", signed=True), at[k], [], [], [])
        _, _, wins, firsts, lasts = out[k]
        wins.append(xxhash.xxh3_128_digest(b"".join(part)))
        firsts.append(at[i])
        lasts.append(at[j])
    return list(out.values())


def _select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FINGERPRINTS.split(", ")]

    def frame(rows):
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"doc_id": "Int64", "text_hash": "int64", "fp": "int64", "line": "int32"})

    for b in batches:
        rows = []
        for i, h, data in zip(b.doc_id, b.text_hash, b.data):
            rows += [(i, h, *x) for x in fingerprints(data)]
            if len(rows) > 50_000:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)


def selected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of all documents with their windows."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).cast("binary").alias("data"),
    )
    return rows.mapInPandas(_select, FINGERPRINTS)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, first, last, first_doc_id, first_line: the maximal later runs, and the first of the places that
    hold part of each."""
    found = scratch.stage(selected(docs, id_col, text_col), "fingerprints")
    # Equal rows (a document that is there twice) are one place.
    counted = found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    matched = found.join(scratch.broadcast_if_small(counted, "shared"), "fp", "left_semi")
    around = matched.select("doc_id", "text_hash", F.explode(F.arrays_zip("wins", "firsts", "lasts")).alias("w")).select(
        "doc_id", "text_hash", F.col("w.wins").alias("win"), F.col("w.firsts").alias("first"), F.col("w.lasts").alias("last")
    )
    place = F.struct("doc_id", "text_hash", "first", "last")
    heads = around.groupBy("win").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head != tail")
    heads = scratch.broadcast_if_small(heads.select("win", "head"), "heads")
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    later = around.join(heads, "win").where(~same | (F.col("first") > F.col("head.last")))
    # Windows that overlap are one run. A document has at most two windows per line, and its repeated rows are told once.
    windows = later.groupBy("doc_id", "text_hash", "first", "last").agg(F.min("head").alias("head"))
    order = W.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    windows = windows.withColumn("new", F.coalesce(F.col("first") > before, F.lit(True)).cast("int"))
    runs = windows.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("head").alias("head")
    )
    return runs.select(
        "doc_id", "text_hash", "first", "last", F.col("head.doc_id").alias("first_doc_id"), F.col("head.first").alias("first_line")
    )


@F.pandas_udf(T.StringType())
def cut_udf(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
    out = []
    for text, first, last in zip(texts, firsts, lasts):
        if text is None:
            out.append(None)
            continue
        lines, gone = text.split("\n"), set()
        for a, b in zip(first, last):
            gone.update(range(a, b + 1))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return pd.Series(out, dtype=object)


# The optimizer would copy a deterministic function into the filter on its result, and each text would be cut twice.
cut_udf = cut_udf.asNondeterministic()


def _cut(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the text without later repeats, null where nothing goes."""
    p = prefix(docs)
    runs = scratch.stage(repeated_runs(docs, id_col, text_col), "runs")
    by_doc = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    by_doc = by_doc.select(*(F.col(c).alias(p + c) for c in by_doc.columns))
    same = F.col(id_col).eqNullSafe(F.col(f"{p}doc_id")) & (F.xxhash64(text_col) == F.col(f"{p}text_hash"))
    # The count of runs bounds the arrays too.
    keyed = docs.join(F.broadcast(by_doc) if runs.count() <= scratch.SMALL_ROWS else by_doc, same, "left")
    old = F.when(F.col(f"{p}runs").isNotNull(), F.col(text_col))
    empty = F.array().cast("array<int>")
    bounds = [F.coalesce(F.col(f"{p}runs.{c}"), empty) for c in ("first", "last")]
    return keyed.select(*docs.columns, cut_udf(old, *bounds).alias(f"{p}cut")), f"{p}cut"


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts cut; columns as before, n_chars (if there) counted anew. Documents cut to nothing go."""
    cut, new = _cut(docs, id_col, text_col)
    done = cut.where(F.col(new).isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        counted = F.when(F.col(new).isNotNull(), F.char_length(new).cast(docs.schema["n_chars"].dataType))
        done = done.withColumn("n_chars", F.coalesce(counted, F.col("n_chars")))
    return done.withColumn(text_col, F.coalesce(new, text_col)).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document with its text after deletion, the line breaks it had and the characters that went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut, new = _cut(docs, "doc_id", "text")
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    gone = F.when(F.col(new).isNull(), F.lit(0)).otherwise(F.length("text") - F.length(new))
    return cut.select(
        "doc_id",
        F.coalesce(breaks, F.lit(0)).cast("long").alias("n_breaks"),
        gone.cast("long").alias("n_cut_chars"),
        F.coalesce(new, "text").alias("text"),
    )


ORACLE = rf"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents
), c as (
  select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as body,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l
), a as (
  select doc_id, i, body, n, row_number() over w as r, sum(n) over w as t from c where n > 0 window w as (partition by doc_id order by i)
), p as (
  select s.doc_id, s.i as f, e.i as z, s.r as fr, e.r as zr from a s join a e on s.doc_id = e.doc_id and s.r <= e.r
  and e.t - s.t + s.n >= {MIN_WORDS} and (e.t - s.t + s.n - e.n < {MIN_WORDS} or e.t - s.t < {MIN_WORDS})
), q as (
  select p.doc_id, f, z, string_agg(body, chr(10) order by r) as content
  from p join a on a.doc_id = p.doc_id and r between fr and zr group by p.doc_id, f, z
), h as (
  select *, first_value(doc_id) over w as hd, first_value(z) over w as hz from q window w as (partition by content order by doc_id, f, z)
), gone as (
  select distinct h.doc_id, c.i from h join c on c.doc_id = h.doc_id and c.i between f and z where h.doc_id <> hd or f > hz
), kept as (
  select c.doc_id, coalesce(string_agg(line, chr(10) order by c.i) filter (gone.i is null), '') as text, count(gone.i) as lost
  from c left join gone on gone.doc_id = c.doc_id and gone.i = c.i group by c.doc_id
)
select d.doc_id, coalesce(length(d.text) - length(replace(d.text, chr(10), '')), 0) as n_breaks,
       case when coalesce(lost, 0) > 0 then length(d.text) - length(k.text) else 0 end as n_cut_chars,
       case when lost > 0 then k.text else d.text end as text
from documents d left join kept k on k.doc_id = d.doc_id
"""
