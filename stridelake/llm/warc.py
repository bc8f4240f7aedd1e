"""WARC archives in Zstandard frames, written and read back.

An archive starts with a skippable frame that holds the dictionary, trained on
a bounded number of the archive's first payloads; then comes one frame per
record.  The reader loads the dictionary, decodes frame by frame, and validates
version, headers, lengths and digests; what doesn't hold raises ``WarcError``.
Records with equal payloads are one response and revisits that refer to it.

Archives lie in the shared folder.  A task that is run again writes files of
its own, and only the files its committed result lists are read.

Edge cases: null html counts as an empty payload; a null url leaves the target
out; null page_id is written and read back as null; rows that share both the
largest page_id and the payload are each a response; an empty table gives no
archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import fresh_path, materialize, trimmed

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bounds of an archive, its dictionary and the payload bytes it is trained on.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 16 << 10
TRAINING_BYTES = 1 << 20
CAPTURE_DATE = "2000-01-01T00:00:00Z"
_ID = "urn:x-page:"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_block(payload_bytes: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes + payload


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One serialised record; a revisit where ``refers_to`` is given."""
    revisit = refers_to is not None
    block = http_block(len(payload), b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", CAPTURE_DATE),
        ("WARC-Payload-Digest", "sha1:" + digest_of(payload)),
        ("WARC-Block-Digest", "sha1:" + digest_of(block)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    if revisit:
        fields += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too little to train on: the text itself
        return zstandard.ZstdCompressionDict((b"".join(samples) or b"WARC/1.1\r\n")[:DICTIONARY_BYTES].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, payload binary, refers_to)``; returns the
    committed list ``path, records``."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for rows in archives(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                count = 0
                for piece in rows:
                    out.write(piece)
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count - 1], pa.int64())], names=["path", "records"])

    return materialize(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "warc-list")


def archives(rows: Iterator[tuple]) -> Iterator[Iterator[bytes]]:
    """The frames of one bounded archive after another, dictionary first."""
    rows = iter(rows)
    pending: list[tuple] = []

    def one(first: list[tuple]) -> Iterator[bytes]:
        dictionary = train_dictionary([r[2] for r in first if r[2]])
        content = dictionary.as_bytes()
        yield struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content
        compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        size = 0
        for source in (first, rows):
            for row in source:
                frame = compressor.compress(record(*row))
                yield frame
                size += len(frame)
                if source is rows and size > ARCHIVE_BYTES:
                    return

    while True:
        pending, size = [], 0
        for row in rows:
            pending.append(row)
            size += len(row[2])
            if size > TRAINING_BYTES:
                break
        if not pending:
            return
        yield one(pending)


def frames(data: bytes) -> Iterator[bytes]:
    """Decode an archive: its dictionary, then each frame's content."""
    if len(data) < 8:
        raise WarcError("archive too short")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC or 8 + size > len(data):
        raise WarcError("no dictionary frame at the start")
    content = data[8 : 8 + size]
    if content[:4] == FRAME_MAGIC:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if view[at : at + 4] != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame, parts, step = decoder.decompressobj(), [], 1 << 12
        try:
            while not frame.eof:
                if at >= len(data):
                    raise WarcError("truncated frame")
                fed = view[at : at + step]
                parts.append(frame.decompress(fed))
                at += len(fed) - len(frame.unused_data)
                step = min(step * 2, 1 << 18)
        except zstandard.ZstdError as error:
            raise WarcError(f"broken frame before byte {at}: {error}") from None
        yield b"".join(parts)


def _header(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line without a name: {line[:60]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def _page(urn: str) -> int | None:
    if not (urn.startswith(f"<{_ID}") and urn.endswith(">")):
        raise WarcError(f"record id {urn!r}")
    return int(urn[len(_ID) + 1 : -1]) if len(urn) > len(_ID) + 2 else None


def parse(raw: bytes) -> dict:
    """One validated record."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != b"WARC/1.1" or not blank:
        raise WarcError("version line")
    h = _header(lines)
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys()
    if missing:
        raise WarcError(f"missing {sorted(missing)}")
    if h["warc-type"] not in ("response", "revisit"):
        raise WarcError(f"record type {h['warc-type']!r}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("content length")
    block = rest[:-4]
    if h.get("warc-block-digest", "sha1:" + digest_of(block)) != "sha1:" + digest_of(block):
        raise WarcError("block digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise WarcError("HTTP header")
    told = _header(lines).get("content-length", "")
    revisit = h["warc-type"] == "revisit"
    if not told.isdigit() or (payload if revisit else len(payload) != int(told)):
        raise WarcError("payload length")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if len(digest) != 32 or not revisit and digest != digest_of(payload):
        raise WarcError("payload digest")
    if revisit and (h.get("warc-profile") != PROFILE or "warc-refers-to" not in h):
        raise WarcError("revisit without profile or reference")
    return {
        "page_id": _page(h["warc-record-id"]),
        "url": h.get("warc-target-uri"),
        "record_type": h["warc-type"],
        "payload_bytes": int(told),
        "payload_digest": digest,
        "refers_to": _page(h["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload,
    }


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_SQL = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "binary"}


def read_archives(listed: DataFrame, columns: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    """Rows of the archives in ``listed(path, records)``, validated."""
    columns = list(columns)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], FIELDS[c]) for c in columns], names=columns)

    @trimmed
    def run(batches):
        for one in batches:
            for path, records in zip(*(c.to_pylist() for c in one.columns)):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    data = f.read()
                rows, seen, held = [], 0, 0
                for raw in frames(data):
                    rows.append(parse(raw))
                    seen, held = seen + 1, held + len(raw)
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if seen != records:
                    raise WarcError(f"{path}: {seen} records instead of {records}")
                yield batch(rows)

    return listed.select("path", "records").repartition(F.col("path")).mapInArrow(run, ", ".join(f"{c} {_SQL[c]}" for c in columns))


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``: who refers to whom among equal
    payloads; a payload that occurs once costs no lookup row."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("_sha", F.sha1("payload"))
    groups = rows.groupBy("_sha").agg(F.count("*").alias("_n"), F.max("page_id").alias("_best")).where("_n > 1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_best")), F.col("_best"))
    return rows.join(groups, "_sha", "left").select("page_id", "url", "payload", F.when(F.col("_best").isNotNull(), refers).alias("refers_to"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    listed = write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), fresh_path(spark, "warc"))
    return read_archives(listed, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
