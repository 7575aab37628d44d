"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writing: every row becomes one gzip member that holds one WARC/1.1 record. Members are gathered into chunks of about
``CHUNK_BYTES``; Spark's own text writer stores the chunks, so any file system and the usual task commit work: a chunk is
a line, and the line separator is an empty gzip member, which keeps each file a plain concatenation of members. A file has
at most ``FILE_CHUNKS`` chunks, so its size is bounded by bytes and the largest record, not by a number of records.

Reading: a member or bare record that fails a check (inflation, CRC, version line, length, block digest) is not the end.
What a damaged member inflates to before its fault is kept and searched for records, from version line to version line; of
a damaged member only records with a block digest that holds are trusted. Then the reader searches the file for the next
place where a valid member or version line starts, and goes on there. The bytes between are logged as a quarantined gap;
a gap inside a member's content gives the member's place in the file, and the gap's own place in the content.

Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the largest id is stored; the others refer to it. Nulls: a
null payload is empty; a null URL leaves its header out; a row with null id refers to the largest id of its payload, and
is stored itself if there is none. Ties: repeated rows each get a record, and those with the largest id are all stored. An
empty table gives archives without records. Very long payloads are records like others; one file is read into memory
whole, and Spark reads files of up to 2 GB. Only the id, URL and payload columns are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from streetflow.llm import scratch

MIN_REVISIT, CHUNK_BYTES, FILE_CHUNKS, LEVEL = 1000, 4 << 20, 16, 6
VERSION, MAGIC = b"WARC/1.1\r\n", b"\x1f\x8b\x08"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


SEPARATOR = _member(b"")
RECORD = (
    "file string, kind string, offset long, length long, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary, reason string, "
    "inner_offset long, inner_length long"
)


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record, uncompressed. page_id, refers_to: an int or None."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + b"\r\n" if revisit else head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id, digest)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _urn(refers_to, digest)),
            ("X-Refers-To-Page", refers_to),
        ]
    fields.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes, at: int, trusted: bool = True) -> tuple[dict, int]:
    """The record whose version line stands at ``at``, and where it ends. ValueError if a check fails."""
    if data[at : at + 7] != VERSION[:7]:
        raise ValueError("no version line")
    body = data.find(b"\r\n\r\n", at) + 4
    if body < 4:
        raise ValueError("header does not end")
    lines = data[at:body].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    end = body + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = data[body:end]
    want = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if want and hashlib.sha1(block).hexdigest() != want:
        raise ValueError("block fails its digest")
    if not want and not trusted:
        raise ValueError("no block digest in a damaged member")
    http = block.find(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    kind, payload = fields.get("warc-type"), block[http + 4 :] if http >= 0 else block
    digest = hashlib.sha1(payload).hexdigest()
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and told and told != digest:
        raise ValueError("payload fails its digest")
    return {
        "page_id": number("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_digest": told if kind == "revisit" else digest,
        "payload_bytes": number("x-payload-length") if kind == "revisit" else len(payload),
        "refers_to": number("x-refers-to-page"),
        "payload": None if kind == "revisit" else payload,
    }, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str | None]:
    """What the gzip member at ``at`` inflates to, where it ends, and what is wrong with it (then it has no known end)."""
    inflate, content, place = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and place < len(data):
            content.append(inflate.decompress(data[place : place + 65536]))
            place += 65536
    except zlib.error as e:
        return _before_fault(data, at, place), None, f"member: {e}"
    if not inflate.eof:
        return b"".join(content), None, "member does not end"
    return b"".join(content), min(place, len(data)) - len(inflate.unused_data), None


def _before_fault(data: bytes, at: int, place: int) -> bytes:
    """All that a member gives before its fault, which lies behind ``place``: the same bytes in ever smaller steps."""
    inflate, content = zlib.decompressobj(31), []
    content.append(inflate.decompress(data[at:place]))
    for step in (512, 1):
        while place < len(data):
            before = inflate.copy()
            try:
                content.append(inflate.decompress(data[place : place + step]))
            except zlib.error:
                inflate = before
                break
            place += step
    return b"".join(content)


def _inside(content: bytes, whole: bool) -> tuple[list[dict], list[dict]]:
    """(records, gaps) of a member's content. Gaps have inner_offset, inner_length and a reason."""
    records, gaps, at, bad, reason = [], [], 0, None, None
    while at < len(content):
        try:
            record, end = _parse(content, at, whole)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            next_line = content.find(VERSION[:7], at + 1)
            at = next_line if next_line >= 0 else len(content)
            continue
        if bad is not None:
            gaps.append({"inner_offset": bad, "inner_length": at - bad, "reason": reason})
            bad = None
        records.append(record)
        at = end
    if bad is not None:
        gaps.append({"inner_offset": bad, "inner_length": len(content) - bad, "reason": reason})
    return records, gaps


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one file, in order: dicts with kind, offset and length (of the member or bare record).

    A damaged member reaches to the next sound one, or to the next damaged one that gives records.
    """
    at, held = 0, None  # held: start, reason, records and inner gaps of what is damaged

    def flush(held, stop):
        if held:
            place = {"offset": held[0], "length": stop - held[0]}
            yield from (r | {"kind": "record"} | place for r in held[2])
            yield from (g | {"kind": "gap"} | place for g in held[3])
            yield {"kind": "gap", "reason": held[1]} | place

    while at < len(data):
        records, gaps, end, why = [], [], None, None
        if data[at : at + 3] == MAGIC:
            content, end, why = _inflate(data, at)
            records, gaps = _inside(content, end is not None)
        else:
            try:
                record, end = _parse(data, at)
                records = [record]
            except ValueError as e:
                why = str(e)
        if end is not None:
            yield from flush(held, at)
            held, place = None, {"offset": at, "length": end - at}
            yield from (r | {"kind": "record"} | place for r in records)
            yield from (g | {"kind": "gap"} | place for g in gaps)
            at = end
            continue
        if held is None or records:
            yield from flush(held, at)
            held = (at, why, records, gaps if records else [])
        places = [p for p in (data.find(MAGIC, at + 1), data.find(VERSION[:7], at + 1)) if p >= 0]
        at = min(places, default=len(data))
    yield from flush(held, len(data))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members one after the other, a separator between, in values of about CHUNK_BYTES."""
    some, size = [], 0
    for b in batches:
        for i, u, p, d, k, v in zip(b.page_id, b.url, b.payload, b.digest, b.keep, b.revisit):
            some.append(_member(build(None if pd.isna(i) else int(i), u, p, d, None if pd.isna(k) else int(k), bool(v))))
            size += len(some[-1])
            if size >= CHUNK_BYTES:
                yield pd.DataFrame({"value": [SEPARATOR.join(some)]})
                some, size = [], 0
    if some:
        yield pd.DataFrame({"value": [SEPARATOR.join(some)]})


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit: int = MIN_REVISIT, file_chunks: int = FILE_CHUNKS,
) -> None:
    """A folder of gzip WARC files with one record per row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Only payloads that occur twice are joined with, so most rows of the wide side meet nothing.
    keep = (
        rows.where(F.length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("keep"))
        .where("n > 1 and keep is not null")
        .select(F.col("digest").alias("twice"), "keep")
    )
    # Short payloads, empty ones above all, meet nothing; each gets a key of its own, so they do not meet in one task.
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.xxhash64("url")).cast("string"))
    key = F.when(F.length("payload") >= min_revisit, F.col("digest")).otherwise(own)
    rows = rows.withColumn("key", key).join(scratch.broadcast_if_small(keep, "twice"), F.col("key") == F.col("twice"), "left")
    rows = rows.withColumn("revisit", F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")))
    chunks = rows.select("page_id", "url", "payload", "digest", "keep", "revisit").mapInPandas(_chunks, "value binary")
    chunks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("latin-1")).option(
        "encoding", "ISO-8859-1"
    ).option("maxRecordsPerFile", file_chunks).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records (kind ``record``) and quarantined gaps (kind ``gap``) of all files in a folder."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.path, b.content):
                some, size = [], 0
                for x in salvage(data):
                    if not payloads:
                        x["payload"] = None
                    some.append(x | {"file": name})
                    size += len(x.get("payload") or b"") + 500
                    if size > 1 << 23:
                        yield _frame(some)
                        some, size = [], 0
                yield _frame(some)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in RECORD.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("offset", "length", "page_id", "payload_bytes", "refers_to", "inner_offset", "inner_length"):
        out[c] = out[c].astype("Int64")
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all pages written as archives and read back."""
    path = scratch.new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as n from pages
), k as (
  select body, max(page_id) as keep from p where n >= 1000 group by body having count(*) > 1
)
select p.page_id, cast(p.n as bigint) as payload_bytes, sha1(p.body) as payload_digest,
       case when k.keep is not null and k.keep is distinct from p.page_id then 'revisit' else 'response' end as record_type,
       case when k.keep is distinct from p.page_id then k.keep end as refers_to
from p left join k on p.body = k.body
"""
