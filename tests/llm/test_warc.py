import base64
import hashlib

import pytest

from textlab.llm import warc


def rows():
    out = [(i, f"http://h/{i} x\ny", f"<p>page {i}é</p>" * (1 + i % 7), "c") for i in range(40)]
    out += [(50, "u", "<p>same</p>", "c"), (45, None, "<p>same</p>", "c"), (60, "u", "<p>same</p>", "c"), (60, "u", "<p>same</p>", "c"),
            (41, "u", None, "c"), (42, "u", "", "c"), (None, "u", "<p>same</p>", "c"), (70, "u", "\r\n\r\nWARC/1.1\r\n", "c"), (44, "v", "z" * 300_000, "c"),
            (-5, "u", "<p>page 3é</p>" * 4, "c")]
    return out


@pytest.mark.parametrize("least,shard,roll", [(0, warc.SHARD_BYTES, warc.ROLL_BYTES), (8, 3000, 900)])
def test_round_trip(spark, tmp_path, least, shard, roll):
    src = spark.createDataFrame(rows(), "page_id long, url string, html string, payload string").repartition(4)
    uri = warc.write_archives(src, str(tmp_path / "a"), min_bytes=least, shard_bytes=shard, roll_bytes=roll)
    got = warc.read_archives(spark, uri, payload=True).collect()
    payload = {}
    want = []
    first = {}
    for p, _, h, _ in sorted((r for r in rows() if r[0] is not None), key=lambda r: r[0]):
        raw = (h or "").encode()
        f = first.setdefault(raw, p) if len(raw) >= least else p
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = f != p or (p == 60 and (p, "seen") in payload)
        payload[(p, "seen")] = True
        want.append((p, len(raw), digest, "revisit" if again else "response", f if again else None))
    assert sorted((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got if g.page_id is not None) == sorted(want)
    assert all(g.verified for g in got) and len(got) == len(rows())
    texts = {r[0]: (r[2] or "").encode() for r in rows()}
    assert all(bytes(g.payload) == texts[g.page_id] for g in got if g.record_type == "response")
    assert [g.record_type for g in got if g.page_id is None] == ["response"]


def test_archives_are_deterministic_and_rolled(spark, tmp_path):
    def write(name, parts):
        src = spark.createDataFrame(rows(), "page_id long, url string, html string, c string").repartition(parts)
        uri = warc.write_archives(src, str(tmp_path / name), shard_bytes=3000, roll_bytes=900)
        return {r.file: (r.sha1, r.records, r.bytes) for r in spark.read.parquet(f"{uri}/_manifest").collect()}
    a, b = write("a", 2), write("b", 5)
    assert a == b and len(a) > 8
    files = sorted(x.name for x in (tmp_path / "a").iterdir() if not x.name.startswith("."))
    assert files == sorted([*a, "_manifest"])                            # no temporary names are left
    for f, (sha, _, n) in a.items():
        raw = (tmp_path / "a" / f).read_bytes()
        assert hashlib.sha1(raw).hexdigest() == sha and len(raw) == n
    with pytest.raises(FileExistsError):
        write("a", 2)                                                    # a manifest is never replaced


def test_empty_table(spark, tmp_path):
    src = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(src, str(tmp_path / "e"))).count() == 0


def test_shard_bounds_follow_from_the_rows(spark):
    df = spark.createDataFrame([(i, 10) for i in range(1000)] + [(10 ** 9 + i, 10) for i in range(1000)] + [(None, 10)], "k long, n long")
    a = warc.bounds(df.repartition(3), "k", "n", 1000)
    assert a == warc.bounds(df.repartition(7), "k", "n", 1000) and a[-1] == 10 ** 9 + 999 and 10 <= len(a) <= 60
    assert warc.bounds(df.limit(0), "k", "n", 1000) == []


def test_damage_is_seen():
    import io
    import zlib
    raw = warc.record(1, "http://x", b"abc", warc.b32(b"abc"), None)
    whole = zlib.decompress(raw, 31)
    assert warc.parse(whole)["verified"] and not warc.parse(whole.replace(b"abc", b"abd"))["verified"]
    assert list(warc.records(io.BytesIO(raw * 3), chunk=7)) == [whole] * 3
