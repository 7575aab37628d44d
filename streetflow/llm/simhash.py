"""Near-duplicate groups by SimHash, found through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least
``MIN_SHARED`` = 5 positional bytes. Posting lists of a single byte would hold 1/256 of a corpus each, so a posting key
is three positions with their bytes. The eight triples inside bytes 0-3 and 4-7 cover every set of five positions (five
positions put at least three into one half), hence each qualifying pair meets in at least one list. For the pairs that
meet, the shared positional bytes are tallied, pairs below five are dropped, and the rest are verified by Hamming
distance.

A posting list longer than ``LIST_LIMIT`` is not paired off: its members are posted again under every set of five
positions that belongs to the list's triple, which keeps all pairs that can pass the count filter. Members of such a
list differ in 24 bits only, so it holds at most 2**24 fingerprints, however many documents there are; it is linked by
probing the masks of up to three bits in a table of that size, in time linear in its length, and gives a spanning forest
instead of all pairs. Work per fingerprint is bounded, and no link is lost.

Nulls: a null text is empty. A text without words has fingerprint zero and links like any other. A null id takes part,
but a component's id is the smallest id that is not null. Repeated rows each get a row. Ties cannot occur: a bit set in
exactly half of the hashes is 0. An empty table gives no rows. Very long texts are hashed in pieces of bounded memory.
Only the id and text columns are read, and ``keep_one`` passes others through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType

from streetflow.llm import scratch
from streetflow.llm.components import connected_components
from streetflow.llm.names import prefix

SHINGLE_WORDS, SEED, MAX_BITS, MIN_SHARED = 3, 42, 3, 5
LIST_LIMIT = 16
CHUNK = 1 << 17
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
FIVES = list(combinations(range(8), 5))
#: The first triple inside each set of five: the list under which it is posted again.
OWNER = [next(t for t, x in enumerate(TRIPLES) if set(x) <= set(five)) for five in FIVES]


def fingerprint(data: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of a UTF-8 text; zero without words."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    n, counts = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : start + CHUNK + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 56 - 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _key(tag: int, positions: tuple[int, ...]) -> Column:
    out = F.lit(tag).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def distance(a: np.ndarray, b) -> np.ndarray:
    """Bits that differ. Unsigned: numpy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = shared >= MIN_SHARED
    out[out] = distance(x[out], 0) <= MAX_BITS
    return out


def _pairs(key: np.ndarray, fp: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys that have at most limit members."""
    left, right, at = [], [], np.flatnonzero((size > 1) & (size <= limit))
    for gap in range(1, limit):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        if not len(at):
            break
        hit = at[near(fp[at], fp[at + gap])]
        left.append(fp[hit])
        right.append(fp[hit + gap])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _run_sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[start, len(key)])
    return start, lengths


def scan_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Posting lists in key order: links of short lists (hot -1), members of long lists (hot = index of the triple)."""
    key, fp, hot_key = np.empty(0, np.int64), np.empty(0, np.int64), None

    def out(key, fp, limit_all):
        start, lengths = _run_sizes(key)
        size = np.repeat(lengths, lengths)
        a, b = _pairs(key, fp, size, LIST_LIMIT)
        long = size > LIST_LIMIT
        if limit_all is not None:
            long |= key == limit_all
        return pd.DataFrame(
            {
                "hot": np.r_[np.full(len(a), -1), key[long] >> 24].astype("int32"),
                "a": np.r_[a, fp[long]],
                "b": np.r_[b, fp[long]],
            }
        )

    for batch in batches:
        key, fp = np.r_[key, batch["key"].to_numpy()], np.r_[fp, batch["fp"].to_numpy()]
        if not len(key):
            continue
        start, lengths = _run_sizes(key)
        cut = start[-1]
        # A list that is long already is passed on at once, and its key remembered, so that it is never held whole.
        last_hot = key[-1] if lengths[-1] > LIST_LIMIT or key[-1] == hot_key else None
        if last_hot is not None:
            cut = len(key)
        if cut:
            yield out(key[:cut], fp[:cut], hot_key)
        hot_key = last_hot
        key, fp = key[cut:], fp[cut:]
    if len(key):
        yield out(key, fp, hot_key)


def _masks(bits: int = 24) -> np.ndarray:
    single = [1 << k for k in range(bits)]
    return np.array([sum(c) for r in (1, 2, 3) for c in combinations(single, r)], np.int64)


def forest(fp: np.ndarray, positions: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the members of one list of five shared bytes that link to others."""
    m = len(fp)
    lab = np.arange(m)
    if m <= 2048:
        for i in range(m):
            linked = np.unique(lab[distance(fp, fp[i]) <= MAX_BITS])
            if len(linked) > 1:
                lab[np.isin(lab, linked)] = linked[0]
    else:
        free = [p for p in range(8) if p not in positions]
        small = np.zeros(m, np.int64)
        for p in free:
            small = (small << 8) | ((fp.view(np.uint64) >> np.uint64(56 - 8 * p)) & np.uint64(255)).astype(np.int64)
        table = np.full(1 << 24, -1, np.int32)
        table[small] = np.arange(m)
        for mask in _masks():
            other = table[small ^ mask]
            i = np.flatnonzero(other >= 0)
            x, y = lab[i], lab[other[i]]
            differ = x != y
            if differ.any():
                parent = np.arange(m)

                def find(k):
                    while parent[k] != k:
                        parent[k] = parent[parent[k]]
                        k = parent[k]
                    return k

                for p, q in np.unique(np.c_[x[differ], y[differ]], axis=0):
                    p, q = find(p), find(q)
                    parent[max(p, q)] = min(p, q)
                while not np.array_equal(parent, parent[parent]):
                    parent = parent[parent]
                lab = parent[lab]
    moved = lab != np.arange(m)
    return fp[moved], fp[lab[moved]]


def scan_fives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists that share five bytes, in key order; each holds 2**24 members at most."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def out(key, fp):
        start, lengths = _run_sizes(key)
        a, b = _pairs(key, fp, np.repeat(lengths, lengths), LIST_LIMIT)
        found = [(a, b)]
        for s, n in zip(start[lengths > LIST_LIMIT], lengths[lengths > LIST_LIMIT]):
            found.append(forest(fp[s : s + n], FIVES[key[s] >> 40]))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

    for batch in batches:
        if not len(batch):
            continue
        key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
        if parts and parts[0][0][0] == key[-1]:
            parts.append((key, fp))
            continue
        key, fp = np.concatenate([*(x for x, _ in parts), key]), np.concatenate([*(x for _, x in parts), fp])
        cut = np.flatnonzero(key != key[-1])
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            yield out(key[:cut], fp[:cut])
        parts = [(key[cut:], fp[cut:])]
    if parts:
        yield out(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))


def links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: enough verified links to connect all that link."""
    postings = distinct_fps.select("fp", F.explode(F.array(*(_key(t, x) for t, x in enumerate(TRIPLES)))).alias("key"))
    first = scratch.stage(
        postings.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(scan_lists, "hot int, a long, b long"),
        "links",
    )
    again = F.lit(None).cast("array<long>")
    for t in range(len(TRIPLES)):
        again = F.when(
            F.col("hot") == t, F.array(*(_key(k, x) for k, x in enumerate(FIVES) if OWNER[k] == t))
        ).otherwise(again)
    hot = first.where("hot >= 0").select("hot", F.col("a").alias("fp"))
    fives = hot.select("fp", F.explode(again).alias("key"))
    more = fives.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(scan_fives, "a long, b long")
    return first.where("hot < 0").select("a", "b").union(more)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, root) for the fingerprints that link to others."""
    fps = scratch.stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("text_hash"),
            fingerprint_udf(F.col(text_col).cast("binary")).alias("fp"),
        ),
        "fps",
    )
    roots = connected_components(links(fps.select("fp").distinct()), "a", "b")
    return fps, roots.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (the smallest id that links reach, its own included)."""
    fps, roots = _classes(docs, id_col, text_col)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    # A fingerprint that is there once and links to nothing is its document's own component.
    classed = distinct.join(roots, "fp", "left").where("n > 1 or root is not null")
    classed = scratch.stage(classed.select("fp", "low", F.coalesce("root", "fp").alias("root")), "classed")
    lows = classed.groupBy("root").agg(F.min("low").alias("component"))
    named = scratch.broadcast_if_small(classed.join(lows, "root").select("fp", "component"), "classes")
    joined = fps.select("doc_id", "fp").join(named.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"), "left")
    return joined.select("doc_id", "fp", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=_classes) -> DataFrame:
    """docs with one row of each component: that of the smallest id that is not null, then of the smallest text hash.

    What travels to the texts are the ids and hashes of rows that go, and of rows that are there more than once; they are
    broadcast while they are few (counted).
    """
    fps, roots = classes(docs, id_col, text_col)
    p = prefix(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    # By fingerprint first, so that a group of a million copies joins as one row.
    by_fp = scratch.stage(fps.groupBy("fp").agg(first, F.count("*").alias("n")).join(roots, "fp", "left"), "by_fp")
    kept = by_fp.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    best = by_fp.where("root is null and n > 1").select("fp", F.col("first").alias("best"))
    best = best.union(by_fp.where("root is not null").join(kept, "root").select("fp", "best"))
    # Rows of fingerprints that are there once and link to nothing stay without a decision.
    rows = fps.join(scratch.broadcast_if_small(best, "best"), "fp")
    told = rows.groupBy("doc_id", "text_hash").agg(
        F.first(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("stays"),
        F.count("*").alias("n"),
    ).where("not stays or n > 1")
    told = told.select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"), F.col("stays").alias(f"{p}stays"))
    told = scratch.broadcast_if_small(told, "told")
    same = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text_col) == F.col(f"{p}hash"))
    decided = docs.join(told, same, "left")
    out = decided.where(F.col(f"{p}hash").isNull()).select(docs.columns)
    if told.where(f"{p}stays").limit(1).count():
        again = W.partitionBy(f"{p}id", f"{p}hash").orderBy(F.lit(1))
        several = decided.where(f"{p}stays").withColumn(f"{p}n", F.row_number().over(again)).where(f"{p}n = 1")
        out = out.union(several.select(docs.columns))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op1: fingerprint as 16 hex digits and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
