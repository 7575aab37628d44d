"""Near copies of five-word similarity 0.8 or more by long SimHash fingerprints and a byte-position inverted index.

Three bits of a 64-bit fingerprint hold near-identical texts only: at a Jaccard similarity of 0.8 about 15 % of all bits
differ. So this form has ``BITS`` = 512 bits over the set of five-word shingles. Its first 64 bits number the text: texts
that agree in all of them are copies.

1. Posting. A list of one byte holds 1/256 of a corpus, so a posting key is three positions with their bytes, for ``KEYS``
   fixed triples of the 64 positions. A pair of similarity 0.8 shares about 17 bytes and meets under 2.5 keys.
2. Count filter. Pairs of a list whose first 64 bits are more than ``ROUGH`` apart are dropped there; of the others the
   shared positional bytes are counted, ``MIN_SHARED`` at least (a pair of 0.8 has fewer with a probability of 1e-4).
3. Verification. Fingerprints at most ``LOOSE`` bits apart, and then the shingle sets themselves: Jaccard similarity of
   ``LEAST`` or more, exactly.

A list of more than ``LIST_LIMIT`` different fingerprints (copies of one text, edited) links by the same three conditions,
in two passes. First a spanning forest of its members at most ``RADIUS`` bits apart (the expected distance at 0.8) proposes
links, which are verified like all others: the member nearest to the majority is a hub that connects those around it, then
the next one among the others. Then the pairs of members that still do not hang together are all taken, as in a short
list. A pair inside one class needs no check, so the classes are those of all pairs, whatever the length of a list; the
work is linear in the list but for members that no verified link reaches. The first pass reads lists beyond ``CHUNK``
members in chunks that hand on their hubs, the second holds a list's fingerprints (80 bytes a member).

Not all pairs meet: see the README for the measured recall. Nulls: a null text is empty; texts without words are alike.
Texts of fewer than five words are one shingle. A bit that exactly half of the shingles set is 0, so there are no ties.
Repeated rows are one member. Empty tables give no classes. Very long texts are hashed in pieces of bounded memory. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructType

from streetflow.llm import scratch
from streetflow.llm.components import connected_components

WIDTH, SEED, LEAST = 5, 42, 0.8
BITS, KEYS, MIN_SHARED = 512, 128, 5
RADIUS, LOOSE, ROUGH = 78, 102, 22
LIST_LIMIT, CHUNK = 32, 1 << 16
_R = np.random.default_rng(SEED)
TIMES, PLUS = (_R.integers(0, 1 << 64, BITS // 64, np.uint64) | np.uint64(1) for _ in range(2))
TRIPLES = np.array([np.sort(_R.choice(BITS // 8, 3, replace=False)) for _ in range(KEYS)])
MIX = np.uint64(0xBF58476D1CE4E5B9)


def grams(data: bytes | None, width: int = WIDTH) -> list[bytes]:
    """Shingles of a text in order, repeats included."""
    words = (data or b"").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def shingle_hashes(data: bytes | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    found = grams(data)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in found), np.uint64, len(found)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BITS / 8 bytes of a set of shingles: each bit is set if more than half of the shingles set it."""
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for s in range(0, n, 255):
        x = hashes[s : s + 255, None] * TIMES + PLUS
        x ^= x >> np.uint64(29)
        x *= MIX
        x ^= x >> np.uint64(32)
        # At most 255 ones, so a byte holds the sum.
        counts += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n)


TOLD = StructType().add("fp", LongType()).add("sig", BinaryType())


@F.pandas_udf(TOLD)
def fingerprint_udf(texts: pd.Series) -> pd.DataFrame:
    sigs = [fingerprint(shingle_hashes(x)) for x in texts]
    return pd.DataFrame({"fp": [int(s[:8].view(np.int64)[0]) for s in sigs], "sig": [s.tobytes() for s in sigs]})


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """Posting keys of fingerprints (rows of bytes): number of the triple and its three bytes."""
    x = sigs.astype(np.int32)
    return (np.arange(KEYS, dtype=np.int32) << 24) | (x[:, TRIPLES[:, 0]] << 16) | (x[:, TRIPLES[:, 1]] << 8) | x[:, TRIPLES[:, 2]]


def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for s in range(0, len(b), 1024):
            part = b.iloc[s : s + 1024]
            sigs = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
            yield pd.DataFrame({"key": keys_of(sigs).ravel(), "fp": np.repeat(part["fp"].to_numpy(), KEYS)})


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Posting lists (key, fp) in key order: pairs of short lists (key null), members of long ones (b null).

    A list is known to be long once it has more than LIST_LIMIT members; from then on members are passed on as they come.
    """
    key, fp, hot = np.empty(0, np.int32), np.empty(0, np.int64), None

    def out(key, fp):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        size = np.repeat(size, size)
        long = (size > LIST_LIMIT) | (key == hot if hot is not None else False)
        left, right, at = [], [], np.flatnonzero(~long & (size > 1))
        for gap in range(1, LIST_LIMIT):
            at = at[at + gap < len(key)]
            at = at[key[at] == key[at + gap]]
            near = at[np.bitwise_count((fp[at] ^ fp[at + gap]).view(np.uint64)) <= ROUGH]
            left.append(fp[near])
            right.append(fp[near + gap])
        a, b = np.concatenate(left), np.concatenate(right)
        null = lambda n: [pd.NA] * n
        join = lambda kind, *parts: pd.concat([pd.Series(p, dtype=kind) for p in parts], ignore_index=True)
        return pd.DataFrame(
            {
                "key": join("Int32", null(len(a)), key[long]),
                "a": np.r_[np.minimum(a, b), fp[long]],
                "b": join("Int64", np.maximum(a, b), null(int(long.sum()))),
            }
        )

    for batch in batches:
        key, fp = np.r_[key, batch["key"].to_numpy()], np.r_[fp, batch["fp"].to_numpy()]
        if not len(key):
            continue
        last = np.searchsorted(key, key[-1])
        if len(key) - last > LIST_LIMIT or key[-1] == hot:
            yield out(key, fp)
            hot, key, fp = key[-1], key[:0], fp[:0]
        elif last:
            yield out(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
    if len(key):
        yield out(key, fp)


def distances(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit words differ from one row."""
    return np.bitwise_count(sigs ^ one).sum(axis=-1, dtype=np.int64)


def forest(sigs: np.ndarray, radius: int = RADIUS) -> tuple[list[tuple[int, int]], list[int]]:
    """(links that connect all that is at most radius bits apart, hubs). sigs: members x words of 64 bits."""
    m = len(sigs)
    open_, links, hubs, of_hub = np.ones(m, bool), [], [], np.full(m, -1)
    parent = list(range(m))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i, j):
        p, q = find(i), find(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((i, j))

    while open_.any():
        rest = np.flatnonzero(open_)
        ones = sum(np.unpackbits(sigs[rest[s : s + 4096]].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for s in range(0, len(rest), 4096))
        middle = np.packbits(2 * ones > len(rest)).view(np.uint64)
        hub = int(rest[np.argmin(distances(sigs[rest], middle))])
        away = distances(sigs, sigs[hub])
        for i in np.flatnonzero(away <= radius).tolist():
            link(hub, i)
        mine = open_ & (away <= radius)
        of_hub[mine] = len(hubs)
        open_ &= ~mine
        hubs.append(hub)
    # Members of two hubs can link only if the hubs are within three radii, and need not if they hang together already.
    groups = [np.flatnonzero(of_hub == h) for h in range(len(hubs))]
    for g in range(len(hubs)):
        near = np.flatnonzero(distances(sigs[hubs], sigs[hubs[g]]) <= 3 * radius)
        for h in near[near > g].tolist():
            small, large = sorted((groups[g], groups[h]), key=len)
            for i in small.tolist():
                if find(hubs[g]) == find(hubs[h]):
                    break
                # Hubs were compared with every member already.
                if i != hubs[g] and i != hubs[h]:
                    for j in large[distances(sigs[large], sigs[i]) <= radius].tolist():
                        link(i, j)
    return links, hubs


def scan_long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Likely links inside the long lists (key, fp, sig), which come in key order."""
    key, fps, sigs = None, [], []

    def close(keep):
        nonlocal fps, sigs
        links, hubs = forest(np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1))
        out = pd.DataFrame({"a": [fps[i] for i, _ in links], "b": [fps[j] for _, j in links]}, dtype="int64")
        fps, sigs = ([fps[h] for h in hubs], [sigs[h] for h in hubs]) if keep and len(hubs) < CHUNK // 2 else ([], [])
        return out

    for batch in batches:
        for k, f, s in zip(batch["key"], batch["fp"], batch["sig"]):
            if k != key or len(fps) >= CHUNK:
                if fps:
                    yield close(k == key)
                key = k
            fps.append(f)
            sigs.append(s)
    if fps:
        yield close(False)


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of 64-bit words pass the count filter and the distance."""
    shared = (x.view(np.uint8) == y.view(np.uint8)).sum(axis=1)
    return (shared >= MIN_SHARED) & (distances(x, y) <= LOOSE)


def scan_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All near pairs of different roots inside the long lists (key, fp, sig, root), which come in key order."""
    key, fps, sigs, roots = None, [], [], []

    def close():
        fp, root = np.array(fps, np.int64), np.array(roots, np.int64)
        sig = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(fp), -1)
        names, which, size = np.unique(root, return_inverse=True, return_counts=True)
        # The members of the largest class come last, and are compared with the others only.
        order = np.argsort(which == np.argmax(size), kind="stable")
        fp, root, sig = fp[order], root[order], sig[order]
        a, b, n = [], [], 0
        for i in range(len(fp) - int(size.max())):
            other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            other = other[np.bitwise_count((fp[other] ^ fp[i]).view(np.uint64)) <= ROUGH]
            other = other[near(sig[other], np.broadcast_to(sig[i], (len(other), sig.shape[1])).copy())]
            a.append(np.minimum(fp[other], fp[i]))
            b.append(np.maximum(fp[other], fp[i]))
            n += len(other)
            if n > CHUNK:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b, n = [], [], 0
        if n:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    for batch in batches:
        for k, f, s, r in zip(batch["key"], batch["fp"], batch["sig"], batch["root"]):
            if k != key:
                if fps:
                    yield from close()
                key, fps, sigs, roots = k, [], [], []
            fps.append(f)
            sigs.append(s)
            roots.append(r)
    if fps:
        yield from close()


@F.pandas_udf(BooleanType())
def close_enough(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    return pd.Series(near(*(np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))))


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = set(grams(x)), set(grams(y))
        both = len(x & y)
        out.append(both / max(1, len(x) + len(y) - both))
    return pd.Series(out, dtype="float64")


def _with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(table.select(F.col("fp").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def classes(docs: DataFrame, id_col: str, text_col: str, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of every row, and (fp, root) for the fingerprints that link to others."""
    told = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fingerprint_udf(F.col(text_col).cast("binary")).alias("m")
    )
    fps = scratch.stage(told.select("doc_id", "text_hash", "m.*"), "fps")
    # The first row of each number stands for it.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "sig")).alias("one")
    sets = scratch.stage(fps.groupBy("fp").agg(one).select("fp", "one", F.col("one.sig").alias("sig")), "sets")
    postings = sets.select("fp", "sig").mapInPandas(post, "key int, fp long").repartition("key").sortWithinPartitions("key", "fp")
    lists = scratch.stage(postings.mapInPandas(scan, "key int, a long, b long"), "lists")
    long = lists.where("b is null").select("key", F.col("a").alias("fp"))
    long = long.join(sets.select("fp", "sig"), "fp")
    hot = long.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", "sig").mapInPandas(scan_long, "a long, b long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("data"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = scratch.stage(_with(pairs, sets, "sig").where(close_enough("sig_a", "sig_b")).select("a", "b"), "pairs")
        need = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        need = sets.join(need, "fp").select("fp", F.col("one.doc_id").alias("need_id"), F.col("one.text_hash").alias("need_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("need_id")) & (F.col("text_hash") == F.col("need_hash"))
        texts = rows.join(scratch.broadcast_if_small(need, "need"), same).select("fp", "data").dropDuplicates(["fp"])
        return _with(pairs, texts, "data").where(jaccard("data_a", "data_b") >= least).select("a", "b")

    hot = hot.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= ROUGH)
    hot = scratch.stage(verified(hot.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "hot")
    # A pair whose members hang together already needs no check: large groups would bring many.
    together = scratch.broadcast_if_small(connected_components(hot, "a", "b"), "together")
    rooted = long.join(together.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = rooted.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", "sig", "root")
    pairs = lists.where("b is not null").select("a", "b").union(rooted.mapInPandas(scan_apart, "a long, b long")).distinct()
    for side in "ab":
        pairs = pairs.join(together.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    apart = F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True))
    links = verified(pairs.where(apart).select("a", "b")).union(hot)
    roots = connected_components(links, "a", "b")
    return fps.select("doc_id", "text_hash", "fp"), roots.withColumnRenamed("node", "fp")
