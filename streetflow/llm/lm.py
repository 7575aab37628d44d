"""Language-model scoring: corpus word counts, a causal self-attention model over subword ids, and a memory of passages.

One pass over the texts cuts them into blocks of about ``BLOCK_TOKENS`` words; a block is a row that holds its documents
as places in a list of its distinct words, and each distinct word's subword ids. Everything later starts from the blocks.

* Word counts. Each block gives one row per distinct word with its count in training documents. Summed per word, the
  totals go back to the blocks, so a word of every document moves once per block, not once per document. The base score
  of a text is the sum of log10((c + 1) / (N + V + 1)) over its tokens.
* Subword counts of all training documents, from the blocks. They put the ids into ``CLASSES`` classes of about equal
  weight, and give each id's share of its class (add-one), so all ids together have probability one.
* The model. One layer of causal self-attention (``WIDTH`` wide, learned positions inside the window) predicts the class
  of the next id. It is trained with Adam on every window of every training document, opening and partial ones included.
  Documents are dealt to units by a hash of their text, and a unit's windows are shuffled and split over the rounds. In each of ``ROUNDS`` rounds every unit starts from the shared model, and the
  moves of all units are averaged as whole numbers. Neither the units nor the sums depend on how the rows are dealt.
* The memory. Texts are cut into passages of about ``PASSAGE`` words where a word's hash says so. The number of times that
  each passage occurs in the training documents comes with the word totals, over the whole corpus. A passage's probability
  is the mixture of what the attention gives to its ids, and with weight ``RECALL`` its share of all passages. A training
  document's own occurrences do not count for it, so what it tells is whether the passage stands elsewhere, too.
* Scoring. Windows of ``2 * STEP`` inputs overlap by half: the first half is context, the second half's predictions are
  scored, so each id is scored once, with between STEP and 2 * STEP - 1 ids of context. Windows of a block are scored in
  batches with one masked attention each. Scores are rounded to three decimals.

A text is its lower-cased words (ASCII white space between), each with a space in front, then one end. The subword
vocabulary is a file of a public tokenizer, read on the driver (``vocabulary`` parameter; a missing file is an OSError);
nothing trains a tokenizer.

Nulls: a null text is empty and consists of its end; a null id is not held out. Without training documents all counts
are zero, the classes are uniform and the model stays untrained. Repeated rows each get a row, and are other documents to
each other. Ties (equal counts of ids) go to the smaller id. An empty table gives no rows. A single document is never
split over blocks, so the largest one bounds a block's size. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from streetflow.llm import scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS, BLOCK_DOCS, TOGETHER = 1_000_000, 50_000, 10_000
CLASSES, WIDTH, STEP, BATCH = 32, 16, 16, 128
#: Training: one of so many windows, which is all of them; bytes of text per unit; rounds, and passes over a unit's windows in all; windows a step.
SHARE, UNIT_BYTES, ROUNDS, PASSES, LEARN, RATE, SEED = 1, 16_000_000, 4, 1, 32, 0.02, 5
#: Moves are summed as whole numbers of this size, by at most so many at a time.
FIXED, FAN_IN = 2.0**-30, 6
PASSAGE, RECALL = 32, 0.05
PIECE = r" [^ ]{0,63}|[^ ]{1,64}"

BLOCK = (
    "base long, doc_ids array<long>, held array<boolean>, keys array<long>, lens array<long>, seq binary, words binary, "
    "passages binary, train binary, id_lens binary, ids binary, count_ids array<int>, counts array<long>"
)
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "n_subwords long, n_passages long, n_recalled long"
)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Subwords:
    """Ids of words. All words of a call are encoded as one text; the lengths of the ids tell where each word ends."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encode = tiktoken.Encoding("words", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        lens, ids = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for s in range(0, len(words), TOGETHER):
            part = words[s : s + TOGETHER]
            try:
                text = (b" " + b" ".join(part)).decode()
            except UnicodeDecodeError:
                part = [w.decode("utf-8", "replace").encode() for w in part]
                text = (b" " + b" ".join(part)).decode()
            found = np.array(self.encode(text), np.int32)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            # An id belongs to the word in which it ends; pieces never cross a space.
            word = np.searchsorted(ends, np.cumsum(self.size[found]))
            lens.append(np.bincount(word, minlength=len(part)).astype(np.int32))
            ids.append(found)
        return np.concatenate(lens), np.concatenate(ids)


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices values[start : start + len], one after the other."""
    if not len(lens):
        return values[:0]
    ends = np.cumsum(lens)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)
    return values[at]


def pack(values: np.ndarray) -> bytes:
    """values as a deflated blob, byte by byte place: the high bytes of small numbers are nearly free."""
    return zlib.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpack_array(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


# ---------------------------------------------------------------- blocks


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def passages(seq: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage hash, its document, passage of every token) of documents that are closed by their ends.

    A word whose hash is a multiple of PASSAGE closes a passage, and so does the end.
    """
    if not len(lens):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    closed = np.insert(seq, np.cumsum(lens), len(hashes))
    closes = np.r_[hashes % np.uint64(PASSAGE) == 0, True][closed]
    starts = np.r_[0, np.flatnonzero(closes)[:-1] + 1]
    of_token = np.cumsum(closes) - closes
    place = np.arange(len(closed)) - starts[of_token]
    power = np.cumprod(np.full(place.max() + 1, 0x9E3779B97F4A7C15, np.uint64))
    mixed = np.add.reduceat(np.r_[hashes, np.uint64(1)][closed] * power[place], starts)
    doc = np.repeat(np.arange(len(lens)), lens + 1)[starts]
    return mixed ^ (mixed >> np.uint64(31)), doc, of_token


def make_blocks(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Blocks of docs (doc_id, held, data)."""
    end, names = len(ranks), [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, number = Subwords(ranks), 0
        part = TaskContext.get().partitionId()
        # The next free number is that of a new word.
        new_index = lambda: defaultdict(count().__next__)
        index, seqs, ids, held, keys, size = new_index(), [], [], [], [], 0

        def block():
            nonlocal number
            lens = np.array([len(s) for s in seqs], np.int64)
            seq = np.concatenate(seqs).astype(np.int32)
            words, learn = list(index), ~np.array(held, bool)
            train = np.bincount(seq[np.repeat(learn, lens)], minlength=len(words)).astype(np.int64)
            found, doc, _ = passages(seq, lens, hash_words(words))
            known, at = np.unique(found, return_inverse=True)
            again = np.bincount(at[learn[doc]], minlength=len(known)).astype(np.int64)
            id_lens, flat = subwords(words)
            total = np.bincount(flat, weights=np.repeat(train, id_lens), minlength=end + 1).astype(np.int64)
            total[end] = learn.sum()
            seen = np.flatnonzero(total)
            row = (part << 33 | number, ids, held, keys, lens, pack(seq), b" ".join(words), pack(known),
                   pack(np.r_[train, again]), pack(id_lens), pack(flat), seen.astype(np.int32), total[seen])
            number += 1
            return pd.DataFrame([row], columns=names)

        for b in batches:
            for i, h, data in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["held"], b["data"]):
                words = data.lower().split()
                seqs.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                ids.append(None if i is None else int(i))
                held.append(bool(h))
                keys.append(xxhash.xxh64_intdigest(data, SEED) - (1 << 63))
                size += len(words)
                if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield block()
                    index, seqs, ids, held, keys, size = new_index(), [], [], [], [], 0
        if ids:
            yield block()

    return docs.mapInPandas(run, BLOCK)


def word_totals(blocks: DataFrame) -> DataFrame:
    """(base, at, total, first, word): for each distinct word of each block its count in all training documents, and after
    them the same for the block's distinct passages (word false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("base", "words", "passages", "train"))
            for base, words, known, train in zip(*columns):
                words = words.split(b" ") if words else []
                # No word holds a space.
                keys = pa.array([*words, *(b" " + x.tobytes() for x in unpack_array(known, np.uint64))], pa.binary())
                counts = pa.array(unpack_array(train, np.int64))
                at = pa.array(np.arange(len(keys), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), base)), at, keys, counts], names=["base", "at", "key", "train"]
                )

    rows = blocks.select("base", "words", "passages", "train").mapInArrow(run, "base long, at int, key binary, train long")
    # A window, not an aggregate and a join: one shuffle. A word has one row per block at most, which bounds its group,
    # and makes the smallest base its first row.
    key = W.partitionBy("key")
    return rows.select(
        "base", "at", F.sum("train").over(key).alias("total"), (F.min("base").over(key) == F.col("base")).alias("first"),
        (F.substring("key", 1, 1) != F.lit(b" ")).alias("word"),
    )


# ---------------------------------------------------------------- model


def classes_of(counts: np.ndarray, n: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log10 of each id's share of its class), for classes of about equal add-one weight."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    weight = counts[order] + 1.0
    # Frequent ids get classes of their own; then each class takes what is left over by the classes to come.
    cls, left, k, inside = np.empty(len(order), np.int32), weight.sum(), 0, 0.0
    bound = left / n
    for i, w in enumerate(weight.tolist()):
        if inside and inside + w / 2 > bound and k < n - 1:
            left -= inside
            k, inside = k + 1, 0.0
            bound = left / (n - k)
        cls[i] = k
        inside += w
    out = np.empty(len(order), np.int32)
    out[order] = cls
    total = np.bincount(out, weights=counts + 1.0, minlength=n)
    return out, (np.log10(counts + 1.0) - np.log10(total[out])).astype(np.float32)


#: The largest weight (a logarithm) of each place: later places get none.
HIGHEST = np.where(np.arange(2 * STEP)[None, :] <= np.arange(STEP)[:, None] + STEP, 30, -1e9).astype(np.float32)
SCALE = WIDTH**-0.5


def new_model(vocab: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(SEED)
    normal = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
    return {
        "embed": normal(vocab, WIDTH), "place": normal(2 * STEP, WIDTH), "q": normal(WIDTH, WIDTH) * 3,
        "k": normal(WIDTH, WIDTH) * 3, "v": normal(WIDTH, WIDTH) * 3, "o": normal(WIDTH, WIDTH) * 3,
        "out": normal(WIDTH, CLASSES), "bias": np.zeros(CLASSES, np.float32),
    }


def forward(m: dict, x_ids: np.ndarray, keep: bool = False):
    """Classes after each of the last STEP inputs: log probabilities and what led there, or else log weights and the log of
    their sum. x_ids: windows x (STEP or 2 * STEP)."""
    size, n = x_ids.shape
    x = m["embed"].take(x_ids.ravel(), axis=0).reshape(size, n, -1)
    x += m["place"][-n:]
    last = np.ascontiguousarray(x[:, -STEP:])
    through = lambda y, w: (y.reshape(-1, y.shape[-1]) @ w).reshape(*y.shape[:-1], -1)
    q, k, v = through(last, m["q"]), through(x, m["k"]), through(x, m["v"])
    s = np.matmul(q * SCALE, k.transpose(0, 2, 1))
    np.minimum(s, HIGHEST[:, -n:], out=s)
    p = np.exp(s, out=s)
    # Sums as products with ones, which are much faster over short rows.
    norm = through(p, np.ones((n, 1), np.float32))
    if keep:
        p /= norm
        a = np.matmul(p, v)
    else:
        a = np.matmul(p, v)
        a /= norm
    h = through(a, m["o"])
    h += last
    z = through(h, m["out"])
    z += m["bias"]
    np.minimum(z, 30, out=z)
    total = np.log(through(np.exp(z), np.ones((z.shape[-1], 1), np.float32)))
    return (z - total, (x, last, q, k, v, p, a, h)) if keep else (z, total)


def gradients(m: dict, x_ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean loss of the weighted predictions and its gradients (clipping counts as the identity)."""
    logp, (x, last, q, k, v, p, a, h) = forward(m, x_ids, keep=True)
    total = max(1.0, float(weight.sum()))
    rows = np.take_along_axis(logp, target[..., None], -1)[..., 0]
    loss = -float((rows * weight).sum()) / total
    dz = np.exp(logp)
    np.put_along_axis(dz, target[..., None], np.take_along_axis(dz, target[..., None], -1) - 1, -1)
    dz *= (weight / total)[..., None]
    flat = lambda y: y.reshape(-1, y.shape[-1])
    g = {"out": flat(h).T @ flat(dz), "bias": flat(dz).sum(0)}
    dh = dz @ m["out"].T
    g["o"] = flat(a).T @ flat(dh)
    da = dh @ m["o"].T
    dp = np.matmul(da, v.transpose(0, 2, 1))
    dv = np.matmul(p.transpose(0, 2, 1), da)
    ds = p * (dp - (dp * p).sum(axis=-1, keepdims=True)) * SCALE
    dq, dk = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q)
    g["q"], g["k"], g["v"] = flat(last).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
    dx = dk @ m["k"].T + dv @ m["v"].T
    dx[:, -STEP:] += dh + dq @ m["q"].T
    g["place"] = np.zeros_like(m["place"])
    g["place"][-x.shape[1] :] = dx.sum(0)
    # Rows of the embedding that take part, and their gradients.
    order = np.argsort(x_ids, axis=None, kind="stable")
    rows_of, first = np.unique(x_ids.ravel()[order], return_index=True)
    g["embed"] = rows_of, np.add.reduceat(flat(dx)[order], first)
    return loss, g


def windows(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first scored place, how many places are scored, document) of every window of streams in one flat array."""
    n = -(-lens // STEP)
    doc = np.repeat(np.arange(len(lens)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[doc] + k * STEP, np.minimum(STEP, lens[doc] - k * STEP), doc


def streams(seq: np.ndarray, lens: np.ndarray, id_lens: np.ndarray, ids: np.ndarray, end: int):
    """(inputs, targets, start and length per document): subword ids of the documents, each closed by the end."""
    # The end is one more word, put after each document's words.
    starts = np.cumsum(id_lens) - id_lens
    all_ids, id_lens = np.r_[ids, end], np.r_[id_lens, 1]
    starts = np.r_[starts, len(ids)]
    closed = np.insert(seq, np.cumsum(lens), len(id_lens) - 1)
    target = ragged(all_ids, starts[closed], id_lens[closed])
    per = id_lens[closed]
    ends = np.cumsum(np.r_[0, per])[np.cumsum(lens + 1)]
    begin = np.r_[0, ends[:-1]].astype(np.int64)
    inputs = np.r_[end, target[:-1]]
    inputs[begin] = end
    return inputs, target, begin, ends - begin


def start_model(counts: np.ndarray, cls: np.ndarray) -> dict:
    """Where training starts: the class shares of the whole corpus."""
    m = new_model(len(counts))
    share = np.bincount(cls, weights=counts + 1.0, minlength=CLASSES)
    m["bias"] = np.log(share / share.sum()).astype(np.float32)
    return m


def train_streams(b, end: int) -> pd.DataFrame:
    """(key, n, size, ids) of each of a block's training documents: its windows and ids, and the ids themselves, packed."""
    _, target, begin, size = streams(*unpack(b), end)
    learn = np.flatnonzero(~np.array(b["held"], bool))
    return pd.DataFrame(
        {"key": np.array(b["keys"], np.int64)[learn], "n": -(-size[learn] // STEP), "size": size[learn],
         "ids": [pack(target[begin[d] : begin[d] + size[d]].astype(np.int32)) for d in learn]}
    )


def unit_windows(blocks: DataFrame, end: int, units: int) -> DataFrame:
    """(unit, n, sizes, ids): one row per unit with the number of its windows and the ids of its documents, in the order of
    their hashes. Windows overlap, so they are cut from the ids where they teach."""

    def cut(batches):
        for batch in batches:
            for b in batch.to_dict("records"):
                yield train_streams(b, end)

    def gather(batches):
        some, sizes, number, n = [], [], None, 0

        def row():
            return pd.DataFrame({"unit": [number], "n": [n], "sizes": [sizes], "ids": [some]})

        for b in batches:
            for u, k, size, x in zip(b["unit"], b["n"], b["size"], b["ids"]):
                if u != number:
                    if some:
                        yield row()
                    some, sizes, number, n = [], [], u, 0
                some.append(x)
                sizes.append(size)
                n += k
        if some:
            yield row()

    wide = blocks.select("held", "keys", "lens", "seq", "id_lens", "ids").mapInPandas(cut, "key long, n long, size long, ids binary")
    dealt = wide.withColumn("unit", F.pmod("key", F.lit(units))).repartition("unit").sortWithinPartitions("unit", "key", "ids")
    return dealt.select("unit", "n", "size", "ids").mapInPandas(gather, "unit long, n long, sizes array<long>, ids array<binary>")


def cut_windows(target: np.ndarray, size: np.ndarray, pick: np.ndarray, end: int) -> np.ndarray:
    """The picked windows of documents that lie one after the other: context, inputs, then targets; -1 pads all three."""
    begin = np.cumsum(size) - size
    inputs = np.r_[end, target[:-1]].astype(np.int32)
    inputs[begin] = end
    at, n, doc = (x[pick] for x in windows(begin, size))
    opens, step = at == begin[doc], np.arange(STEP)
    here = np.minimum(at[:, None] + step, len(inputs) - 1)
    scored = step < n[:, None]
    before = np.maximum(at[:, None] + step - STEP, 0)
    return np.concatenate(
        [np.where(opens[:, None], -1, inputs[before]), np.where(scored, inputs[here], -1), np.where(scored, target[here], -1)], axis=1
    ).astype(np.int32)


def step_gradients(m: dict, cls: np.ndarray, ids: np.ndarray) -> dict:
    """Mean gradients of windows; opening ones have no context, partial ones count by their places. Those of the
    embedding are rows and values."""
    out, embed, places = {}, [], ids[:, 2 * STEP :] >= 0
    total, opens = float(places.sum()), ids[:, 0] < 0
    for first in (True, False):
        w = np.flatnonzero(opens == first)
        if not len(w):
            continue
        x = np.maximum(ids[w, (STEP if first else 0) : 2 * STEP], 0)
        weight = places[w].astype(np.float32)
        _, g = gradients(m, x, cls[ids[w, 2 * STEP :]], weight)
        part = np.float32(weight.sum() / total)
        rows, values = g.pop("embed")
        embed.append((rows, values * part))
        out = {k: v * part + out.get(k, 0) for k, v in g.items()}
    rows, values = (np.concatenate(x) for x in zip(*embed))
    order = np.argsort(rows, kind="stable")
    rows, first = np.unique(rows[order], return_index=True)
    return out | {"embed": (rows, np.add.reduceat(values[order], first))}


def train_unit(m: dict, cls: np.ndarray, unit: int, target: np.ndarray, size: np.ndarray, round_: int) -> dict:
    """The model after a round on a unit: Adam over the round's share of the unit's passes over its windows."""
    n = int((-(-size // STEP)).sum())
    order = np.concatenate([np.random.default_rng([SEED, unit, k]).permutation(n) for k in range(PASSES)])
    mine = order[round_ * PASSES * n // ROUNDS : (round_ + 1) * PASSES * n // ROUNDS]
    if not len(mine):
        return m
    ids = cut_windows(target, size, mine, len(m["embed"]) - 1)
    m = {k: v.copy() for k, v in m.items()}
    # The unit's own rows of the embedding stand together, so that a step touches no others.
    used = np.unique(ids[:, : 2 * STEP])
    used = used[used >= 0]
    whole, local = m["embed"], np.full(len(m["embed"]), 0, np.int32)
    local[used] = np.arange(len(used))
    m["embed"] = whole[used]
    ids[:, : 2 * STEP] = np.where(ids[:, : 2 * STEP] >= 0, local[np.maximum(ids[:, : 2 * STEP], 0)], -1)
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    steps = -(-len(mine) // LEARN)
    for step, pick in enumerate(np.array_split(np.arange(len(mine)), steps), 1):
        g = step_gradients(m, cls, ids[pick])
        rate = RATE * (1 - (round_ + step / (steps + 1)) / ROUNDS) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        rows, g["embed"] = g["embed"]
        for k in m:
            # Of the embedding only the rows that the step has seen move.
            at = rows if k == "embed" else slice(None)
            one[k][at] += 0.1 * (g[k] - one[k][at])
            two[k][at] += 0.01 * (g[k] * g[k] - two[k][at])
            m[k][at] -= (rate * one[k][at] / (np.sqrt(two[k][at]) + 1e-8)).astype(np.float32)
    whole[used] = m["embed"]
    m["embed"] = whole
    return m


def train(units: DataFrame, counts: np.ndarray, cls: np.ndarray) -> dict:
    """Rounds in which every unit trains from the shared model on its next share of windows; the moves are averaged.

    An embedding's move is averaged over the units that moved it. Moves are added as whole numbers, so their order does
    not matter; each task sums those of its units, and sums meet by FAN_IN at a time until one is left for the driver.
    """
    m = start_model(counts, cls)
    n_units = units.count()
    names, shapes = list(m), {k: v.shape for k, v in m.items()}
    spark = units.sparkSession

    def added(blobs):
        total = None
        for x in blobs:
            x = unpack_array(x, np.int64)
            total = x if total is None else total + x
        return total

    for r in range(ROUNDS if n_units else 0):
        shared = spark.sparkContext.broadcast((m, cls))

        def run(batches, r=r, shared=shared):
            m, cls = shared.value
            total = None
            for batch in batches:
                for unit, n, sizes, ids in zip(batch["unit"], batch["n"], batch["sizes"], batch["ids"]):
                    target = np.concatenate([unpack_array(x, np.int32) for x in ids])
                    after = train_unit(m, cls, int(unit), target, np.array(sizes, np.int64), r)
                    moves = {k: np.rint((after[k] - m[k]).astype(np.float64) * (n / FIXED)).astype(np.int64) for k in names}
                    moved = (moves["embed"] != 0).any(axis=1) * np.int64(n)
                    flat = np.concatenate([*(moves[k].ravel() for k in names), moved, [np.int64(n)]])
                    total = flat if total is None else total + flat
            if total is not None:
                yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "sums": [pack(total)]})

        def merge(batches):
            total = added(x for b in batches for x in b["sums"])
            if total is not None:
                yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "sums": [pack(total)]})

        sums, parts = units.mapInPandas(run, "slot int, sums binary"), units.rdd.getNumPartitions()
        # A shuffle even for few parts: without one the driver would fetch them one by one, and train on one core.
        while parts > 1:
            parts = -(-parts // FAN_IN)
            sums = sums.repartition(parts, F.pmod("slot", F.lit(parts))).mapInPandas(merge, "slot int, sums binary")
        total = added(x.sums for x in sums.toLocalIterator())
        shared.destroy()
        if total is None:
            continue
        n, moved, at = total[-1], total[-1 - len(counts) : -1], 0
        for k in names:
            size = int(np.prod(shapes[k]))
            move = total[at : at + size].reshape(shapes[k]) * FIXED
            move = move / np.maximum(moved, 1)[:, None] if k == "embed" else move / n
            m[k] = (m[k] + move).astype(np.float32)
            at += size
    return m


def unpack(b) -> tuple:
    at = lambda c, kind: unpack_array(b[c], kind)
    return at("seq", np.int32), np.array(b["lens"], np.int64), at("id_lens", np.int32), at("ids", np.int32)


def score_streams(m: dict, cls: np.ndarray, share: np.ndarray, streams_: tuple, group: np.ndarray | None = None) -> np.ndarray:
    """log10 probability that the attention gives to each document of a block, or to each group of its ids."""
    inputs, target, begin, size = streams_
    group = np.repeat(np.arange(len(begin)), size) if group is None else group
    got = np.zeros(len(inputs), np.float32)
    at, n, doc = windows(begin, size)
    opens = at == begin[doc]
    target_class, own = cls[target], share[target]
    for first in (True, False):
        todo = np.flatnonzero(opens == first)
        back = 0 if first else STEP
        for s in range(0, len(todo), BATCH):
            w = todo[s : s + BATCH]
            # Places past a document's end are computed, never counted, and seen by no earlier place.
            x = np.minimum(at[w, None] + np.arange(-back, STEP), len(inputs) - 1)
            y = x[:, -STEP:]
            z, total = forward(m, inputs[x])
            z = np.take_along_axis(z, target_class[y][..., None], -1)[..., 0] - total[..., 0]
            inside = np.arange(STEP) < n[w, None]
            got[y[inside]] = z[inside]
    return np.bincount(group, weights=got * np.log10(np.e) + own, minlength=int(group[-1]) + 1 if len(group) else 0)


def recall(attention: np.ndarray, elsewhere: np.ndarray, all_else: np.ndarray) -> np.ndarray:
    """log10 probability of passages: attention mixed with their share of all passages elsewhere."""
    out = attention + np.log10(1 - RECALL)
    seen = elsewhere > 0
    memory = np.log10(RECALL * elsewhere[seen] / all_else[seen])
    high, low = np.maximum(out[seen], memory), np.minimum(out[seen], memory)
    out[seen] = high + np.log10(1 + 10.0 ** (low - high))
    return out


# ---------------------------------------------------------------- operator


def score_documents(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords, n_passages, n_recalled of every row.

    held_out: column that is true for rows not to learn from.
    """
    ranks = read_vocabulary(vocabulary)
    end = len(ranks)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"),
    )
    blocks = scratch.stage(make_blocks(rows, ranks), "blocks")
    totals = scratch.stage(word_totals(blocks), "totals")
    once = F.col("first") & (F.col("total") > 0)
    sums = totals.agg(
        *(F.coalesce(F.sum(F.when(c, v)), F.lit(0)) for c, v in ((once & F.col("word"), F.lit(1)), (once & F.col("word"), F.col("total")),
                                                                  (once & ~F.col("word"), F.col("total"))))
    ).first()
    vocab, n_words, n_passages = map(int, sums)
    pairs = blocks.select(F.explode(F.arrays_zip("count_ids", "counts")).alias("p"))
    # At most one row per id of the vocabulary file reaches the driver.
    found = pairs.groupBy(F.col("p.count_ids").alias("id")).agg(F.sum("p.counts").alias("n")).collect()
    counts = np.zeros(end + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    n_end = int(counts[end])
    n_all, v_all = n_words + n_end, vocab + (n_end > 0)
    cls, share = classes_of(counts)
    size = rows.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    units = scratch.stage(unit_windows(blocks, end, max(1, -(-size // UNIT_BYTES))), "units", compression="none")
    model = train(units, counts, cls)
    scratch.drop(units)
    log_all = float(np.log10(float(n_all + v_all + 1)))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=names)
        b = left.iloc[0]
        seq, lens, id_lens, ids = unpack(b)
        all_totals = np.zeros(right["at"].max() + 1 if len(right) else 0, np.int64)
        all_totals[right["at"].to_numpy()] = right["total"].to_numpy()
        n_known, total = len(id_lens), np.zeros(len(id_lens) + 1, np.int64)
        total[:-1], total[-1] = all_totals[:n_known], n_end
        closed = np.insert(seq, np.cumsum(lens), n_known)
        starts = np.cumsum(lens + 1) - (lens + 1)
        flow = streams(seq, lens, id_lens, ids, end)
        # Passages, and how often each stands in other training documents.
        words = b["words"].split(b" ") if b["words"] else []
        found, doc, of_token = passages(seq, lens, hash_words(words))
        learn = ~np.array(b["held"], bool)
        number = np.searchsorted(unpack_array(b["passages"], np.uint64), found)
        _, which, times = np.unique(doc * (number.max() + 1) + number, return_inverse=True, return_counts=True)
        elsewhere = all_totals[n_known:][number] - np.where(learn[doc], times[which], 0)
        all_else = n_passages - np.where(learn, np.bincount(doc, minlength=len(lens)), 0)[doc]
        group = np.repeat(of_token, np.r_[id_lens, 1][closed])
        score = recall(score_streams(model, cls, share, flow, group), elsewhere, np.maximum(all_else, 1))
        out = pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in b["doc_ids"]], "Int64"),
                "held_out": list(b["held"]),
                "n_tokens": lens + 1,
                "n_known": np.add.reduceat((total > 0)[closed].astype(np.int64), starts),
                "train_tokens": n_all,
                "base_score": np.add.reduceat((np.log10(total + 1.0) - log_all)[closed], starts),
                "score": np.round(np.bincount(doc, weights=score, minlength=len(lens)), 3),
                "n_subwords": flow[3],
                "n_passages": np.bincount(doc, minlength=len(lens)),
                "n_recalled": np.bincount(doc, weights=elsewhere > 0, minlength=len(lens)).astype(np.int64),
            }
        )
        return out[names]

    wide = blocks.select("base", "doc_ids", "held", "lens", "seq", "words", "passages", "id_lens", "ids")
    return wide.groupBy("base").cogroup(totals.select("base", "at", "total").groupBy("base")).applyInPandas(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: unigram and attention scores of every document; crc32 of the id by 7 leaves 2 for held-out rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(docs, held)
