import gzip
import hashlib
import random

import duckdb

from streetflow.llm import warc

SF = "/root/testdata/sf0.001"


def member(i, body):
    return warc._member(warc.build(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest()))


def test_files_are_plain_gzip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages, f"{tmp_path}/w")
    files = list((tmp_path / "w").glob("part-*"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"\r\nWARC-Record-ID: ") == pages.count()


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.ORACLE})").fetchall(), key=str)
    got = sorted(map(tuple, warc.query(spark, SF).collect()), key=str)
    assert got == want


def test_edge_rows(spark, tmp_path):
    big = "ä" * 600
    rows = [(1, None, big), (2, "u\r\nv", big), (2, "u", big), (None, "n", big), (3, "x", None), (4, "x", ""), (5, "x", "s"), (6, "x", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w", file_chunks=1)
    got = warc.read_archives(spark, f"{tmp_path}/w", payloads=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == 8
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted(
        [("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("None", "revisit", 2)]
        + [(str(k), "response", None) for k in (3, 4, 5, 6)]
    )
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {big, "", "s"}
    warc.write_archives(df.limit(0), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").count() == 0


def test_salvage_recovers_later_records():
    r = random.Random(5)
    parts = [member(i, bytes(r.choices(b"abc \r\n<>", k=r.randint(0, 4000)))) + warc.SEPARATOR for i in range(30)]
    for hurt in range(30):
        bad = bytearray(parts[hurt])
        at = r.randrange(0, len(bad) - len(warc.SEPARATOR))
        bad[at] ^= 0x55
        data = b"".join(parts[:hurt]) + bytes(bad) + b"".join(parts[hurt + 1 :])
        found = list(warc.salvage(data))
        ids = [x["page_id"] for x in found if x["kind"] == "record"]
        assert [i for i in ids if i != hurt] == [i for i in range(30) if i != hurt]
        gaps = [x for x in found if x["kind"] == "gap"]
        start = sum(map(len, parts[:hurt]))
        assert all(start <= g["offset"] and g["offset"] + g["length"] <= start + len(bad) for g in gaps)
        assert len(ids) == len(set(ids))
        assert hurt in ids or gaps


def test_bare_records_and_noise():
    bare = [warc.build(i, None, b"x" * i, hashlib.sha1(b"x" * i).hexdigest()) for i in range(4)]
    data = b"junk" + bare[0] + b"\0\0" + bare[1][:-3] + bare[2] + b"\x1f\x8b\x08oops" + bare[3]
    found = list(warc.salvage(data))
    assert [x["page_id"] for x in found if x["kind"] == "record"] == [0, 2, 3]
    assert sum(x["length"] for x in found) == len(data)


def test_damaged_members_give_their_sound_records():
    """One bad record, a cut, a wrong checksum: the other records of a member with five are recovered."""
    plain = [warc.build(i, None, (b"%d " % i) * 3000, hashlib.sha1((b"%d " % i) * 3000).hexdigest()) for i in range(5)]
    ids = lambda found: [x["page_id"] for x in found if x["kind"] == "record"]
    bad = plain[2].replace(b"2 2 2", b"2 x 2", 1)
    after = member(9, b"later")
    found = list(warc.salvage(warc._member(b"".join([*plain[:2], bad, *plain[3:]])) + after))
    assert ids(found) == [0, 1, 3, 4, 9]
    gap = next(x for x in found if x["kind"] == "gap")
    assert (gap["inner_offset"], gap["inner_length"]) == (len(plain[0] + plain[1]), len(bad))
    r = random.Random(1)
    noisy = [warc.build(i, None, p, hashlib.sha1(p).hexdigest()) for i, p in enumerate(r.randbytes(2000) for _ in range(5))]
    whole = warc._member(b"".join(noisy))
    found = list(warc.salvage(whole[:-9] + after))
    assert ids(found) == [0, 1, 2, 3, 4, 9] and any(x["kind"] == "gap" for x in found)
    hurt = bytearray(whole)
    hurt[-6] ^= 1
    assert ids(list(warc.salvage(bytes(hurt) + after))) == [0, 1, 2, 3, 4, 9]
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 1
    found = list(warc.salvage(bytes(hurt) + after))
    assert {0, 1, 9} <= set(ids(found)) and ids(found) == sorted(set(ids(found)))
    assert [x["offset"] + x["length"] for x in found if x["kind"] == "gap"][-1] == len(whole)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(i, f"http://x/{i}", r.randbytes(3000).hex(), "k", "t") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string, twice string").coalesce(1)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 10_000)
    warc.write_archives(df, f"{tmp_path}/w", file_chunks=2)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 3 and max(sizes) < 40_000
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert sorted(x.page_id for x in got) == list(range(40)) and {x.kind for x in got} == {"record"}
    assert all(b"".join([gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*")]).count(x[1].encode()) for x in rows)
