import gzip
import hashlib
import io
import json
import random
import time
import zipfile

import pytest

from ohmlake.llm import warc as W


def source(data):
    return lambda at, n: data[at : at + n]


def test_directory_with_and_without_zip64():
    recs = [(str(i), W.record(str(i), "http://x/%0A\n", b"p" * i, "d", None)) for i in range(5)]
    for zip64 in (False, True):
        data = W.pack(recs, zip64)
        assert [data[a : a + n] for a, n in W.ranges(source(data), len(data))] == [r for _, r in recs]
    assert W.parsed(recs[3][1])[0][:3] == ("3", "http://x/%0A\n", 3)


def test_zip64_end_record_and_fields():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.warc", W.record("1", None, b"abc", "d", None))
        z.comment = b"PK\x05 a comment"
    data = bytearray(out.getvalue())
    end = data.rfind(b"PK\x05\x06")
    start = int.from_bytes(data[end + 16 : end + 20], "little")
    length = int.from_bytes(data[end + 12 : end + 16], "little")
    import struct

    entry = bytearray(data[start : start + length])
    full = int.from_bytes(entry[24:28], "little")
    extra = struct.pack("<HHQQQ", 1, 24, full, full, 0)
    entry[20:28] = b"\xff" * 8
    entry[42:46] = b"\xff" * 4
    entry[30:32] = struct.pack("<H", len(extra))
    entry = bytes(entry) + extra
    more = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, start + len(entry), 1)
    last = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = bytes(data[:start]) + entry + more + locator + last
    assert [m.name for m in W.directory(source(big), len(big))] == ["archive/data.warc"]
    (a, n), = W.ranges(source(big), len(big))
    assert W.parsed(big[a : a + n])[1] == b"abc"


def test_archive_without_index_and_gzip_members():
    recs = [W.record(str(i), "u", b"x" * 20_000 * i, "d", None) for i in range(3)]
    for name, body in (("a.warc", b"".join(recs)), ("a.warc.gz", b"".join(map(gzip.compress, recs)))):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("notes.txt", "n", zipfile.ZIP_DEFLATED)
            z.writestr(name, body)
        data = out.getvalue()
        assert [len(W.parsed(data[a : a + n])[1]) for a, n in W.ranges(source(data), len(data))] == [0, 20_000, 40_000]


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def test_foreign_index_lines():
    recs = [W.record(str(i), f"http://www.Example.com/{i} x?q={{", b"x" * i * 50, "d", None) for i in range(4)]
    zipped = list(map(gzip.compress, recs))
    lines, at = ['!meta {"format": "cdxj"}', ""], 0
    for i, r in enumerate(zipped):
        lines.append(f'com,example,www)/{i} 20200101000000 {{"url": "http://x/{{", "offset": "{at}", "length": "{len(r)}", "filename": "a.warc.gz"}}\r')
        at += len(r)
    data = archive(("archive/a.warc.gz", b"".join(zipped)), ("archive/b.warc", b"".join(recs[:2])), ("indexes/index.cdxj", "\n".join(lines)))
    assert [len(W.parsed(data[a : a + n])[1]) for a, n in W.ranges(source(data), len(data))] == [0, 50, 100, 150, 0, 50]  # the second member is in no index
    own = W.pack([(str(i), r) for i, r in enumerate(recs)])
    member = [m for m in W.directory(source(own), len(own)) if m.name == W.INDEX_MEMBER][0]
    for line in W.content(source(own), member).decode().split("\n"):
        key, when, entry = line.split(" ", 2)
        assert key.startswith("com,example,www)/") and when == "19700101000000" and json.loads(entry)["offset"].isdigit()
    assert sorted(len(W.parsed(own[a : a + n])[1]) for a, n in W.ranges(source(own), len(own))) == [0, 50, 100, 150]
    assert [W.surt(u) for u in ("-", "", "no host {", "http://[x", "http://a.b:8080")] == ["-", "-", "no%20host%20%7B", "http:/%5Bx".replace("http:/", "http://"), "b,a:8080)/"]


def test_large_gzip_members_in_pieces():
    """Many records, one that unpacks to far more than a piece, and a member that is cut off; only pieces are read, time in proportion."""
    rng = random.Random(7)
    recs = [W.record(str(i), "u", rng.randbytes(rng.randint(0, 6000)), "d", None) for i in range(400)] + [W.record("big", "u", b"0" * 5_000_000, "d", None)]
    zipped = list(map(gzip.compress, recs))
    data = archive(("a.warc.gz", b"".join(zipped)))
    asked = []
    got = list(W.ranges(lambda at, n: asked.append(n) or data[at : at + n], len(data)))
    assert [data[a : a + n] for a, n in got] == zipped
    assert max(asked) <= W.PIECE_BYTES + 100 and sum(asked) < len(data) + 3 * W.PIECE_BYTES
    cut = archive(("a.warc.gz", b"".join(zipped)[:-20]))
    *whole, (a, n) = W.ranges(source(cut), len(cut))
    assert len(whole) == 400
    with pytest.raises(EOFError):
        W.parsed(cut[a : a + n])
    times = []
    for n in (2000, 8000):
        many = archive(("a.warc.gz", gzip.compress(W.record("1", "u", rng.randbytes(1500), "d", None)) * n))
        began = time.perf_counter()
        assert sum(1 for _ in W.ranges(source(many), len(many))) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * times[0] + 0.1


def expected(rows):
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t in rows:
        body = (t or "").encode()
        f = first.get(t) if len(body) >= 100 else None
        revisit = f is not None and f != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_write_and_read_back(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.1 " * 20
    rows = [(1, "u", long), (2, "u2", long), (3, None, "short"), (4, "x\ny", "short"), (5, "", None), (6, "", ""), (None, "n", long), (2, "u2", long), (1, "u", long), (7, "w", "z" * 300_000), (8, "w", "z" * 99), (9, "w", "z" * 99), (None, "q", "only null " * 20), (None, "q", "only null " * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as id", "3 as size", "4 as first")
    archives = W.stored(W.write(df, "page_id", "url", "html", archive_bytes=500), "t")
    got = W.read(archives, payload=True).collect()
    assert sorted([(None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got], key=str) == expected(rows)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.url for r in got} == {r[1] for r in rows}
    for i, r in enumerate(archives.collect()):
        (tmp_path / f"{i}.zip").write_bytes(bytes(r.archive))
    files = W.write_files(df, "page_id", "url", "html", f"file://{tmp_path}/more", archive_bytes=700)
    assert sorted(map(str, W.records_of(files, payload=True).collect())) == sorted(map(str, got))
    assert sorted(map(str, W.read_files(spark, f"{tmp_path}/more").collect())) == sorted(map(str, W.read(archives).collect()))
    again = W.read_files(spark, str(tmp_path), tasks=3).where("true").collect()
    assert len(again) == 2 * len(rows)
    for r in tmp_path.glob("more/*"):
        r.unlink()
    again = W.read_files(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, W.read(archives).collect()))
    assert W.read(W.write(df.limit(0), "page_id", "url", "html")).count() == 0


def test_odd_ids_and_urls_come_back():
    for id_, url, refers in (("", "", None), (None, None, ""), (" a\t", "\u3000 x%20\r\ny \x1f", "%25"), ("7", "http://x/%41", "\n")):
        data = W.record(id_, url, b"abc", "d", refers)
        assert (W.parsed(data)[0][0], W.parsed(data)[0][1], W.parsed(data)[0][5]) == (id_, url, refers)
    assert W.parsed(b"WARC/1.0\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/%41\r\nContent-Length: 0\r\n\r\n")[0][1] == "http://x/%41"


def test_query(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{at}/pages.parquet").collect()]
    got = W.op7_warc_zip(spark, at).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(rows)
