import gzip
import hashlib
import io

import pytest

from tabwright.llm import warc as W


def test_records_survive_any_block_size(rnd, monkeypatch):
    bodies = [b"", b"x", b"\r\n\r\n", bytes(rnd.randrange(256) for _ in range(100_000)), b"WARC/1.1\r\n\r\n" * 50]
    raw = b"".join(W.record("response", f"urn:page:{i}", "http://h/\r\n x", b, hashlib.sha1(b).digest()) for i, b in enumerate(bodies))
    raw += W.record("revisit", "urn:page:9", None, bodies[3], hashlib.sha1(bodies[3]).digest(), "urn:page:3")
    for block in (1, 7, 4096, 1 << 20):
        monkeypatch.setattr(W, "BLOCK", block if block > 1 else 3)
        parts: dict[str, bytes] = {}
        got = list(W.read_records(io.BytesIO(raw), lambda r, p: parts.__setitem__(r.headers["warc-record-id"], parts.get(r.headers["warc-record-id"], b"") + p)))
        assert [r.payload_bytes for r in got] == [*map(len, bodies), len(bodies[3])]
        assert [r.payload_sha1 for r in got] == [hashlib.sha1(b).hexdigest() for b in (*bodies, bodies[3])]
        assert got[5].headers["warc-refers-to"] == "<urn:page:3>" and parts["<urn:page:3>"] == bodies[3]
    assert gzip.decompress(raw).count(b"WARC-Type: response") == 5


def test_damage_is_noticed():
    body = b"hello" * 300
    good = W.record("response", "urn:page:1", None, body, hashlib.sha1(body).digest())
    with pytest.raises(EOFError):
        list(W.read_records(io.BytesIO(good[:-20])))
    with pytest.raises(ValueError, match="digest"):
        list(W.read_records(io.BytesIO(W.record("response", "urn:page:1", None, body, hashlib.sha1(b"other").digest()))))
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(gzip.compress(gzip.decompress(good) + b"more"))))


def test_table(spark):
    big, small = "é" * 600, "s" * 999
    rows = [(1, "u", big), (2, "u", big), (5, None, big), (3, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "z" * 3000),
            (8, "u", "z" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    for roll in (1, 1 << 20):
        got = W.round_trip(df, roll_bytes=roll).collect()
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            ref = 5 if h == big and i != 5 else None
            want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref or 0))
        assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(want)
    assert W.round_trip(df.limit(0)).count() == 0
