"""Media columns: PNG files in binary columns, written and read here, and perceptual hashes of their samples.

The writer chooses for every line the filter with the least sum of absolute differences (``None``, ``Sub``, ``Up``,
``Average``, ``Paeth``; the first on a tie), and makes signature, IHDR, IDAT chunks (one zlib stream) and IEND, each with
its CRC. The reader tests signature, every CRC and the sizes, inflates, undoes the filters with numpy and returns the
samples. Undoing a line needs the line above it and the sample to the left, so all lines of a batch of images are undone
together, one diagonal per step: the step that undoes sample x of a line follows the one that undid sample x of the line
above. Images are cut into bands of ``BAND`` lines for that, so memory follows the samples. The hash is the sign of the
8 x 8 lowest cosine-transform coefficients of the image reduced to 32 x 32, against their median.

Nulls: a null text is empty. An empty text becomes one line of bytes 255. Repeated rows each get a row; equal texts have
equal values. Ties of filters go to the lower number; a coefficient equal to the median gives a bit 0. An empty table
gives no rows. Very long texts are one image of many lines. An input column named as the result's (``media``,
``features``) gives way to it; others are passed through, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from streetflow.llm import scratch

WIDTH, PAD, LEVEL, SIGNATURE = 576, b"\xff", 6, b"\x89PNG\r\n\x1a\n"
CHUNK, KEEP, SIDE, ROWS = 1 << 20, 8, 32, 4096
#: Lines of an image that are undone at a time, and lines of a batch of images.
BAND, TOGETHER = 256, 1 << 16


def pad(data: bytes, block: int = WIDTH) -> bytes:
    """data with bytes 255 up to a positive multiple of block."""
    return data + PAD * (max(1, -(-len(data) // block)) * block - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The one of a (left), b (above), c (above left) that lies nearest to a + b - c; the first on a tie."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filter_rows(img: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Lines with their filter byte in front: given kinds, or per line the one of least differences. One byte a sample."""
    h, w = img.shape
    out = np.empty((h, w + 1), np.uint8)
    for y in range(0, h, ROWS):
        x = img[y : y + ROWS].astype(np.int16)
        above = np.zeros((1, w), np.int16) if y == 0 else img[y - 1 : y].astype(np.int16)
        up = np.concatenate([above, x[:-1]])
        left = np.pad(x, ((0, 0), (1, 0)))[:, :-1]
        corner = np.pad(up, ((0, 0), (1, 0)))[:, :-1]
        tried = [(x - guess).astype(np.uint8) for guess in (0, left, up, (left + up) >> 1, _paeth(left, up, corner))]
        if kinds is None:
            cost = [np.minimum(t, 0 - t).sum(axis=1, dtype=np.int64) for t in tried]
            mine = np.argmin(cost, axis=0).astype(np.uint8)
        else:
            mine = kinds[y : y + ROWS]
        out[y : y + ROWS, 0] = mine
        for k, t in enumerate(tried):
            out[y : y + ROWS, 1:][mine == k] = t[mine == k]
    return out


def _undo(kinds: np.ndarray, rows: np.ndarray, first: np.ndarray, above: np.ndarray) -> None:
    """Undo the filters of many bands at once, in place.

    rows: lines of all bands; kinds: their filters; first: number of each band's first line; above: the line over each
    band. A line's place in its band says how many steps it lags behind.
    """
    n, w = rows.shape
    lag = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    # In order of lag the lines that take part in a step stand together.
    order = np.argsort(lag, kind="stable")
    lag, place = lag[order], np.empty(n, np.int64)
    place[order] = np.arange(n)
    base, kind = order * w - lag, kinds[order]
    over = np.where(lag > 0, place[np.maximum(order - 1, 0)], -1)
    band = np.searchsorted(first, order, side="right") - 1
    top = above.astype(np.int16)
    flat = rows.reshape(-1)
    count = np.searchsorted(lag, np.arange(lag[-1] + 2))  # lines with a lag below each number
    now, corner = np.zeros(n, np.int16), np.zeros(n, np.int16)
    is_first = count[1]  # lines without a line of their own band above
    uses_left, uses_up = ((kind == 1) | (kind >= 3)).astype(np.int16), ((kind == 2) | (kind >= 3)).astype(np.int16)
    average, paeth = kind == 3, kind == 4
    some_average, some_paeth = average.any(), paeth.any()
    for step in range(w + int(lag[-1])):
        low, high = count[max(0, min(step - w + 1, len(count) - 1))], count[min(step + 1, len(count) - 1)]
        part = slice(low, high)
        a = now[part].copy()
        b = now[over[part]]
        if low < is_first:
            b[: is_first - low] = top[band[low:is_first], step]
        c = corner[part]
        guess = a * uses_left[part] + b * uses_up[part]
        if some_average:
            np.copyto(guess, (a + b) >> 1, where=average[part])
        if some_paeth:
            np.copyto(guess, _paeth(a, b, c), where=paeth[part])
        at = base[part] + step
        value = (flat[at] + guess) & 255
        flat[at] = value
        corner[part] = b
        now[part] = value


def unfilter_many(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of images given as lines with their filter byte in front; all of one width."""
    if any((lines[:, 0] > 4).any() for lines in images):
        raise ValueError("unknown line filter")
    out = [lines[:, 1:].copy() for lines in images]
    todo = [(i, y) for i, x in enumerate(out) for y in range(0, len(x), BAND)]
    todo.sort(key=lambda x: x[1])
    # Bands in order of their height in the image, so the line above a band is done before the band.
    at = 0
    while at < len(todo):
        some, size = [], 0
        while at < len(todo) and todo[at][1] == (some or todo[at:])[0][1] and size < TOGETHER:
            i, y = todo[at]
            some.append((i, y))
            size += min(BAND, len(out[i]) - y)
            at += 1
        parts = [out[i][y : y + BAND] for i, y in some]
        kinds = np.concatenate([images[i][y : y + BAND, 0] for i, y in some])
        if not kinds.any():
            continue
        rows = np.concatenate(parts)
        sizes = [len(x) for x in parts]
        first = np.cumsum([0, *sizes[:-1]])
        above = np.stack([out[i][y - 1] if y else np.zeros(rows.shape[1], np.uint8) for i, y in some])
        _undo(kinds, rows, first, above)
        for (i, y), f, n in zip(some, first, sizes):
            out[i][y : y + n] = rows[f : f + n]
    return out


def unfilter_rows(lines: np.ndarray) -> np.ndarray:
    """Samples of the filtered lines of one image."""
    return unfilter_many([lines])[0]


def encode(samples: bytes, width: int = WIDTH, filters: int | None = None, level: int = LEVEL) -> bytes:
    """Grey 8-bit PNG. filters: one type for all lines, or None to choose per line."""
    img = np.frombuffer(samples, np.uint8).reshape(-1, width)
    kinds = None if filters is None else np.full(len(img), filters, np.uint8)
    body = zlib.compress(filter_rows(img, kinds).tobytes(), level)
    parts = [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    head = struct.pack(">IIBBBBB", width, len(img), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def filtered_lines(data: bytes) -> np.ndarray:
    """Lines of a grey 8-bit PNG with their filter byte in front; ValueError if any check fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if len(data) < at + 12:
            raise ValueError("chunk is cut")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("chunk fails its checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
            if size[2:] != (8, 0, 0, 0, 0):
                raise ValueError("only grey 8-bit without interlace is read")
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("unknown critical chunk")
        at += 12 + n
    if size is None or not ended:
        raise ValueError("a chunk is missing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"samples do not inflate: {e}") from None
    if len(raw) != size[1] * (size[0] + 1):
        raise ValueError("wrong number of samples")
    return np.frombuffer(raw, np.uint8).reshape(size[1], size[0] + 1)


def decode_many(files: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Samples of grey 8-bit PNGs, in order; neighbours of one width are undone together."""
    some, size = [], 0
    for data in files:
        lines = filtered_lines(data)
        if some and (size >= TOGETHER or lines.shape[1] != some[0].shape[1]):
            yield from unfilter_many(some)
            some, size = [], 0
        some.append(lines)
        size += len(lines)
    yield from unfilter_many(some)


def decode(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG; ValueError if any check fails."""
    return next(decode_many([data]))


_REDUCED: dict[int, np.ndarray] = {}


def _reduce(n: int) -> np.ndarray:
    """8 x n: area means of n samples in 32 cells, then the 8 lowest cosine terms."""
    if n in _REDUCED:
        return _REDUCED[n]
    if len(_REDUCED) >= 64:
        _REDUCED.clear()
    edges = np.linspace(0, n, SIDE + 1)
    low, high, k = edges[:-1, None], edges[1:, None], np.arange(n)[None, :]
    area = np.clip(np.minimum(high, k + 1) - np.maximum(low, k), 0, None) * SIDE / n
    cos = np.cos(np.pi * np.arange(KEEP)[:, None] * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))
    out = _REDUCED[n] = cos @ area
    return out


def cosine_hash(img: np.ndarray) -> str:
    """64 bits in hex: which low coefficients lie above their median (the mean level is left out of it)."""
    down, across = _reduce(img.shape[0]), _reduce(img.shape[1]).T
    coef = np.zeros((KEEP, KEEP))
    for y in range(0, len(img), ROWS):
        coef += down[:, y : y + ROWS] @ (img[y : y + ROWS].astype(np.float64) @ across)
    flat = np.round(coef.ravel() / SIDE**2, 6)
    bits = flat > np.median(flat[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


@F.pandas_udf(T.BinaryType())
def encode_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([encode(pad(t or b"")) for t in texts], dtype=object)


FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


@F.pandas_udf(FEATURES)
def features_udf(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data, img in zip(media, decode_many(media)):
        payload = img.tobytes()
        rows.append(
            (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-32:]),
                len(data),
                hashlib.sha256(data).hexdigest(),
                cosine_hash(img),
            )
        )
    return pd.DataFrame(rows, columns=FEATURES.names)


def to_media(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """df with a binary column ``out``: the padded text as a PNG."""
    return df.withColumn(out, encode_udf(F.col(text_col).cast("binary")))


def media_features(df: DataFrame, media_col: str = "media", out: str = "features") -> DataFrame:
    """df with a struct column ``out`` of what the stored PNG gives when it is read."""
    return df.withColumn(out, features_udf(F.col(media_col)))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every text stored as a PNG in a table, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = scratch.stage(to_media(sizes).select("doc_id", "n_bytes", "media"), "media", compression="none")
    return media_features(stored).select("doc_id", "n_bytes", *(f"features.{c}" for c in FEATURES.names))
