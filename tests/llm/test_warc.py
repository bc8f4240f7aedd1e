import random
import struct

import pytest

from stridelake.llm import warc as W
from stridelake.llm.common import fresh_path

PAGES = "page_id long, url string, html string, payload string, refers_to long"


def archive(rows):
    return b"".join(next(W.archives(iter(rows))))


def test_frames_round_trip_and_dictionary_first():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i} ä\r\nX: y", "".join(rng.choice(["<p>", "wort ", "é"]) for _ in range(rng.randrange(300))).encode(), None if i % 3 else 7) for i in range(200)]
    data = archive(rows)
    assert struct.unpack_from("<I", data)[0] == W.SKIPPABLE_MAGIC
    got = [W.parse(x) for x in W.frames(data)]
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got] == [(i, len(p), W.digest_of(p), t) for i, _, p, t in rows]
    assert all(r["payload"] == (None if t is not None else p) for r, (_, _, p, t) in zip(got, rows))
    assert all("\n" not in r["url"] for r in got)
    # one frame per record, each complete by itself
    assert data.count(W.FRAME_MAGIC) >= len(rows)


@pytest.mark.parametrize("rows", [[(1, None, b"", None)], [(None, "u", b"x", None)], [(1, "u", b"tiny", 2)]])
def test_tiny_archives(rows):
    assert len([W.parse(x) for x in W.frames(archive(rows))]) == 1


def test_compressed_dictionary_is_read():
    import zstandard

    rows = [(i, "u", b"some text that repeats %d " % i * 20, None) for i in range(400)]
    data = archive(rows)
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.compress(data[8 : 8 + size])
    again = struct.pack("<II", W.SKIPPABLE_MAGIC, len(packed)) + packed + data[8 + size :]
    assert list(W.frames(again)) == list(W.frames(data))


def test_damage_is_found():
    data = archive([(1, "u", b"hello world", None), (2, "v", b"hello there", None)])
    for bad in (b"", data[:6], data[8:], data[:-3], data[:-9] + b"\x00" + data[-8:], data + b"junk!"):
        with pytest.raises(W.WarcError):
            [W.parse(x) for x in W.frames(bad)]
    raw = W.record(1, "u", b"hello world", None)
    for old, new in ((b"WARC/1.1", b"WARC/0.9"), (b"hello world", b"hellO world"), (b"WARC-Date", b"X-Date"), (b"Content-Length: 11", b"Content-Length: 12"), (b"response\r\nWARC", b"request\r\nWARC"), (b"\r\n\r\n", b"\r\n\r\nmore")):
        with pytest.raises(W.WarcError):
            W.parse(raw.replace(old, new, 1))
    with pytest.raises(W.WarcError):
        W.parse(W.record(1, "u", b"x", 2).replace(b"WARC-Refers-To", b"X"))


def test_archives_are_bounded(monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(W, "TRAINING_BYTES", 1000)
    rng = random.Random(9)
    rows = [(i, "u", rng.randbytes(150), None) for i in range(100)]
    made = [b"".join(a) for a in W.archives(iter(rows))]
    assert len(made) > 3 and [W.parse(x)["page_id"] for m in made for x in W.frames(m)] == list(range(100))


def test_table(spark):
    rng = random.Random(4)
    html = [None, "", "ü" * 100000, *[f"<p>{k % 5}</p>" * (k % 5) for k in range(40)], *["".join(rng.choices("abc ", k=200)) for _ in range(60)]]
    rows = [(i, None if i == 3 else f"http://h/{i}", h, "clash", 1) for i, h in enumerate(html)]
    rows += [(200, "u", "twice", "", 0), (200, "u", "twice", "", 0), (None, "u", "twice", "", 0), (None, "u", "alone", "", 0)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    listed = W.write_archives(W.with_revisits(pages), fresh_path(spark, "warc"))
    got = W.read_archives(listed).collect()
    best = {}
    for i, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, *_ in rows:
        p, b = (h or "").encode(), best[h or ""]
        refers = None if b == -1 or b == i else b
        want.append((i, len(p), W.digest_of(p), "response" if refers is None else "revisit", refers))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    none = W.write_archives(W.with_revisits(pages.limit(0)), fresh_path(spark, "warc"))
    assert W.read_archives(none).collect() == []
