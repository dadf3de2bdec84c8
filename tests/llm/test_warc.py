import base64
import glob
import gzip
import hashlib
import random
import uuid

import pytest

from sensorloom.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (1, "http://a b\r\nx", "p1"), (2, None, "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (6, "u", "ü" * 100), (6, "u", "ü" * 100),
    (None, "u", "same"), (7, "u", "WARC/1.0\r\nWARC-Type: x\r\n\r\n"), (8, "u", "long " * 200_000),
]


def written(spark, tmp_path, rows, **options):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record_type", "2 AS _key", "3 AS path")
    warc.write_archives(pages, path, **options)
    return path


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, tmp_path, min_bytes):
    path = written(spark, tmp_path, PAGES, min_bytes=min_bytes)
    got = [r.asDict() for r in warc.read_archives(spark, path).collect()]
    assert all(r["reason"] is None for r in got)
    want = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        peers = [p for p, _, h in PAGES if (h or "") == (html or "")]
        owner = max((p for p in peers if p is not None), default=None)
        revisit = len(data) >= min_bytes and len(peers) > 1 and key != owner
        want.append((str(key) if key is not None else "", len(data), digest(data), "revisit" if revisit else "response", str(owner) if revisit else None, None if revisit else data))
    have = [(r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] != b"" else b"") for r in got]
    clean = lambda rows: sorted((a, b, c, d, str(e), hashlib.sha1(f or b"").hexdigest()) for a, b, c, d, e, f in rows)
    assert clean(have) == clean(want)


def test_empty_table(spark, tmp_path):
    assert warc.read_archives(spark, written(spark, tmp_path, [])).count() == 0


def test_members_are_gzip(spark, tmp_path):
    path = written(spark, tmp_path, PAGES)
    for name in glob.glob(f"{path}/part-*"):
        with open(name, "rb") as file:
            assert gzip.decompress(data := file.read()).startswith(b"WARC/1.0") or not data


def plain(k, payload=None):
    data = payload if payload is not None else b"payload %d " % k * 20
    return warc.record_bytes("response", str(k), "u", data, digest(data), None, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_after_any_damage(packed):
    """One damaged byte costs at most its own record; gaps and records cover every byte once."""
    records = [gzip.compress(plain(k), mtime=0) if packed else plain(k) for k in range(6)]
    data, random_ = b"".join(records), random.Random(1)
    starts = [sum(map(len, records[:k])) for k in range(7)]
    for _ in range(150):
        at = random_.randrange(len(data))
        hurt = bytearray(data)
        hurt[at] ^= 1 << random_.randrange(8)
        rows = list(warc.salvage(bytes(hurt)))
        own = next(k for k in range(6) if starts[k] <= at < starts[k + 1])
        assert {str(k) for k in range(6) if k != own} <= {r.get("record_id") for r in rows}
        covered = [(r["offset"], r["offset"] + r["length"]) for r in rows]
        assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_salvage_junk_truncation_and_false_marks():
    data = b"junk" + plain(0, b"WARC/1.0\r\n inside \x1f\x8b\x08 too") + b"\x1f\x8b\x08 no member WARC/1.0 no record" + plain(1) + plain(2)[:-30]
    rows = list(warc.salvage(data))
    assert [r.get("record_id") for r in rows] == [None, "0", None, "1", None]
    assert rows[0]["length"] == 4 and rows[-1]["offset"] + rows[-1]["length"] == len(data)
    assert list(warc.salvage(b"")) == [] and [r["length"] for r in warc.salvage(b"nothing")] == [7]


def test_wrong_length_and_digest_are_noticed():
    good = plain(3)
    for bad in (good.replace(b"payload 3 p", b"payload X p"), good.replace(b"Content-Length: 2", b"Content-Length: 1", 2)):
        rows = list(warc.salvage(bad + plain(4)))
        assert rows[0]["reason"] and rows[-1]["record_id"] == "4"


def members_of(spark, path):
    return [r.asDict() for r in warc.read_archives(spark, path).collect()]


def test_long_headers_come_back(spark, tmp_path):
    rows = [(k, "http://x/" + "é" * n, f"page {k}") for k, n in enumerate([3, 22_000, 400_000])]
    got = members_of(spark, written(spark, tmp_path, rows))
    assert sorted(r["record_id"] for r in got) == ["0", "1", "2"] and all(r["reason"] is None for r in got)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    noise = random.Random(3)
    rows = [(k, "u", "".join(chr(noise.randrange(32, 1000)) for _ in range(900))) for k in range(60)]
    path = written(spark, tmp_path, rows)
    sizes = [len(open(name, "rb").read()) for name in glob.glob(f"{path}/part-*")]
    assert max(sizes) <= 4000 + len(warc.EMPTY_MEMBER) and len(sizes) > 10
    assert sorted(int(r["record_id"]) for r in members_of(spark, path)) == list(range(60))


def test_salvage_inside_one_member():
    """Six records in one member: a bad digest costs its own record, a member cut short those behind the cut."""
    inner = [plain(k) for k in range(6)]
    bad = b"".join([*inner[:2], inner[2].replace(b"payload 2 p", b"payload X p"), *inner[3:]])
    rows = list(warc.salvage(gzip.compress(bad, mtime=0)))
    assert [r.get("record_id") for r in rows] == ["0", "1", None, "3", "4", "5"]
    assert rows[2]["reason"] and (rows[2]["inner_offset"], rows[2]["inner_length"]) == (len(inner[0] + inner[1]), len(inner[2]))
    assert {(r["offset"], r["length"]) for r in rows} == {(0, len(gzip.compress(bad, mtime=0)))}

    many = [plain(k, random.Random(k).randbytes(300)) for k in range(200)]
    packed = gzip.compress(b"".join(many), mtime=0)
    behind = gzip.compress(plain(900), mtime=0)
    rows = list(warc.salvage(packed[:-20] + behind))
    ids = [r["record_id"] for r in rows if r.get("record_id")]
    assert ids[-1] == "900" and ids[:190] == [str(k) for k in range(190)]
    covered = [(r["offset"], r["offset"] + r["length"]) for r in rows]
    assert covered[0][0] == 0 and covered[-1][1] == len(packed) - 20 + len(behind) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    hurt = bytearray(packed)
    hurt[len(packed) // 2] ^= 4
    rows = list(warc.salvage(b"junk" + bytes(hurt) + behind))
    ids = [r["record_id"] for r in rows if r.get("record_id")]
    assert ids[-1] == "900" and len(ids) > 80 and set(map(str, range(90))) <= set(ids) and ids == sorted(ids, key=int)
    assert rows[0]["length"] == 4 and rows[0]["reason"]


def test_a_member_without_records_is_one_gap():
    data = gzip.compress(b"no record at all", mtime=0)
    assert [(r["offset"], r["length"], bool(r["reason"])) for r in warc.salvage(data + gzip.compress(plain(1), mtime=0)) if r.get("reason")] == [(0, len(data), True)]
