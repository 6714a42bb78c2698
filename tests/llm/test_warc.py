import base64
import gzip
import hashlib
import io
import random
import time

import __spark_entry__
from siftwork.llm import warc

SF = "/root/testdata/sf0.001"
DATE = "1970-01-01T00:00:00Z"


def records(n: int) -> list[bytes]:
    rng = random.Random(n)
    return [warc.record("response", i, f"http://x/{i}", "".join(rng.choice("abcdef <>\n") for _ in range(rng.randrange(2000))), None, DATE) for i in range(n)]


def read(data: bytes) -> tuple[list[int], list[warc.Item]]:
    items = list(warc.salvage(io.BytesIO(data), len(data)))
    return [int(x.headers["warc-record-id"][12:-1]) for x in items if not x.gap], [x for x in items if x.gap]


def test_whole_archives_have_no_gaps():
    raw = records(30)
    for data in (b"".join(raw), b"".join(map(warc.member, raw)), warc.member(b"".join(raw)), b"".join(raw[:9]) + warc.member(b"".join(raw[9:20])) + b"".join(map(warc.member, raw[20:]))):
        assert read(data) == (list(range(30)), [])
    assert read(b"") == ([], [])


def test_damaged_records_between_members():
    raw = records(20)
    parts = [warc.member(r) for r in raw]
    starts = [sum(map(len, parts[:i])) for i in range(21)]
    for bad in (0, 7, 19):
        broken = [*parts]
        broken[bad] = parts[bad][:-8] + bytes(4) + parts[bad][-4:]  # the checksum; the block digest still proves the record
        assert read(b"".join(broken))[0] == list(range(20))
        broken[bad] = parts[bad][: len(parts[bad]) // 2] + b"\xff" * (len(parts[bad]) - len(parts[bad]) // 2)
        ids, gaps = read(b"".join(broken))
        assert ids == [i for i in range(20) if i != bad]
        assert [(g.start, g.end) for g in gaps] == [(starts[bad], starts[bad + 1])]
        ids, gaps = read(b"".join(parts[:bad] + [parts[bad][:20]] + parts[bad + 1 :]))
        assert ids == [i for i in range(20) if i != bad] and len(gaps) == 1 and gaps[0].end - gaps[0].start == 20
    ids, gaps = read(b"junk" + b"".join(parts) + b"\x1f\x8b\x08tail")
    assert ids == list(range(20)) and [(g.start, g.end) for g in gaps] == [(0, 4), (starts[20] + 4, starts[20] + 11)]


def test_damage_inside_a_member_of_many_records():
    raw = records(40)
    at = [sum(map(len, raw[:i])) for i in range(41)]
    whole = bytearray(b"".join(raw))
    whole[at[7] + len(raw[7]) - 10] ^= 1
    ids, gaps = read(warc.member(bytes(whole)))
    assert ids == [i for i in range(40) if i != 7] and [g.inner for g in gaps] == [(at[7], at[8])] and "digest" in gaps[0].gap
    cut = warc.member(b"".join(raw))
    cut = cut[: len(cut) * 2 // 3]
    ids, gaps = read(cut + warc.member(raw[3]))
    assert len(ids) > 10 and ids[:-1] == list(range(len(ids) - 1)) and ids[-1] == 3
    assert len(gaps) == 1 and (gaps[0].start, gaps[0].end) == (0, len(cut)) and gaps[0].inner == (at[len(ids) - 1], -1)


def test_damage_in_uncompressed_records():
    raw = records(12)
    raw[4] = raw[4].replace(b"Content-Length", b"Kontent-Length")
    ids, gaps = read(b"".join(raw))
    assert ids == [i for i in range(12) if i != 4]
    assert [(g.start, g.end) for g in gaps] == [(sum(map(len, raw[:4])), sum(map(len, raw[:5])))]


def test_salvage_takes_time_in_proportion():
    def seconds(n: int) -> float:
        parts = [warc.member(r) for r in records(n)]
        data = b"".join(p if i % 2 else p[:30] + bytes(len(p) - 30) for i, p in enumerate(parts))
        began = time.process_time()
        ids, gaps = read(data)
        assert len(ids) == n // 2 and len(gaps) == n // 2
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 10 * max(0.05, seconds(2000))


def test_op5_against_its_rule(spark):
    rows = {r["page_id"]: r for r in __spark_entry__.queries()["op5_warc"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    best: dict[str, int] = {}
    for p in pages:
        best[p["html"] or ""] = max(best.get(p["html"] or "", -1), p["page_id"])
    for p in pages:
        payload, r = (p["html"] or "").encode(), rows[p["page_id"]]
        first = best[p["html"] or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == p["page_id"] else ("revisit", first))


def test_nulls_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (2, "u", "x", None), (2, "u", "x", 1), (3, "u v", "x", 1), (None, None, "x", 1), (4, "", "", 2), (5, "u", "é" * 3_000_000, 1)], "page_id long, url string, html string, name int")
    for few in (0, 1000):  # both ways to find revisits
        rows = warc.read_archives(warc.archive(pages, broadcast_revisits=few)).collect()
        assert all(r["gap"] is None for r in rows)
        assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in rows) == [(0, "response", 0), (1, "revisit", 4), (2, "revisit", 3), (2, "revisit", 3), (3, "response", 0), (4, "response", 0), (5, "response", 0)]
        assert next(r for r in rows if r["page_id"] == 5)["payload_bytes"] == 6_000_000
        rows = warc.read_archives(warc.archive(pages, least_bytes=1, broadcast_revisits=few)).collect()
        assert {(r["page_id"], r["record_type"]) for r in rows} >= {(1, "response"), (4, "response"), (2, "revisit")}
    assert warc.read_archives(warc.archive(pages.limit(0))).collect() == []


def test_damaged_files_through_spark(spark, tmp_path):
    raw = records(10)
    good = b"".join(map(warc.member, raw))
    (tmp_path / "a.warc.gz").write_bytes(good[:-40])
    (tmp_path / "b.warc").write_bytes(b"".join(raw))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"no archive"))
    paths = [f"file://{tmp_path}/{n}" for n in ("a.warc.gz", "b.warc", "c.warc.gz", "missing")]
    rows = warc.read_archives(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    own = {p: [r for r in rows if r["path"] == p] for p in paths}
    assert [r["page_id"] for r in own[paths[0]] if not r["gap"]] == list(range(9)) and sum(r["gap"] is not None for r in own[paths[0]]) == 1
    assert [r["page_id"] for r in own[paths[1]]] == list(range(10))
    assert [r["gap"] for r in own[paths[2]]] == ["no version line"] and own[paths[3]][0]["gap"].startswith("cannot be opened")
