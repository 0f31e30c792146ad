"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: records of equal payloads (SHA-1) are one response, that of the largest page_id, and revisits that refer to it.
Each task packs its rows into archives of bounded size, kept as rows of a binary column, so that any store that Spark writes
can hold them. Reading: load the dictionary, walk the frames by their block headers, inflate each alone, and test version
line, header fields, lengths, record ends and payload digests.

Defined cases: a null html is an empty payload. Rows of equal page_id and payload are one kind of record each (all with the
largest page_id of a payload are responses). A null page_id is smaller than any other and stays null. A null url is an empty
target. No pages: no archives, no rows. Broken archives raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table, thinned

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on so many pages at most, those with the least hashed ids; longer pages are used whole.
DICTIONARY_PAGES = 128
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "archive_id string, n_records long, data binary"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError(f"record name {name!r}")
    return int(name[10:-1]) if name != "<urn:page:>" else None


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record; a revisit holds the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(refers_to))]
    return f"{VERSION}\r\n{''.join(f'{k}: {v}\r\n' for k, v in fields)}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The columns of RECORD of one record, tested."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != VERSION or not gap:
        raise ValueError(f"version line {version[:40]!r}")
    fields = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if not colon or not k or k != k.strip():
            raise ValueError(f"header line {line[:80]!r}")
        fields[k.lower()] = v.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"} - fields.keys():
        raise ValueError(f"header fields missing: {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not http.startswith(b"HTTP/") or len(lengths) != 1:
        raise ValueError("no HTTP head")
    kind, said = fields["warc-type"], fields["warc-payload-digest"]
    if kind == "response" and (len(payload) != int(lengths[0]) or said != f"sha1:{digest(payload)}"):
        raise ValueError("the payload is not what its digest or length says")
    if kind not in ("response", "revisit") or kind == "revisit" and (payload or fields.get("warc-profile") != REVISIT):
        raise ValueError(f"record type {kind!r}")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri", ""), kind, refers, int(lengths[0]), said[5:], payload if kind == "response" else None


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; raw sample bytes where there is too little to train on; empty without samples."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, by its block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame where one should begin")
    checksum = data[at + 4] & 4
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 if checksum else 0
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def read_archive(data: bytes) -> Iterator[tuple]:
    """The records of one archive."""
    view, at, options = memoryview(data), 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8:at])
        if len(raw) != at - 8:
            raise ValueError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        options = {"dict_data": _loaded(raw)} if raw else {}
    inflate = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        end = frame_end(view, at)
        yield parse(inflate.decompress(view[at:end]))
        at = end


def marked(pages: DataFrame, payload_min: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: which pages repeat another's payload. Payloads below payload_min bytes never do.

    The payloads' digests are aggregated alone (partially before the shuffle); the pages then meet only the digests that occur
    more than once, in a join that Spark may broadcast by the measured size or split where one digest has many rows."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    large = F.length("payload") >= payload_min
    keep = rows.where(large).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = large & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(keep, "sha", "left").select("page_id", "url", "payload", F.when(repeats, F.col("keep")).alias("refers_to"), repeats.alias("revisit"))


def write_archives(pages: DataFrame, payload_min: int = 0, archive_bytes: int = ARCHIVE_BYTES, dictionary: bytes | None = None) -> DataFrame:
    """A frame of archives (ARCHIVE), not yet written: store it, or save its ``data`` cells as .warc.zst files."""
    if dictionary is None:
        sample = thinned(pages.where("html is not null").select("page_id", "html"), F.col("page_id"), DICTIONARY_PAGES).orderBy(F.xxhash64("page_id"), "page_id").select("html").limit(DICTIONARY_PAGES)
        dictionary = train_dictionary([r[0].encode("utf-8", "surrogatepass") for r in sample.collect()])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        options = {"dict_data": _loaded(dictionary)} if dictionary else {}
        deflate = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
        first = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary

        def archive(frames: list[bytes]) -> pd.DataFrame:
            data = first + b"".join(frames)
            return pd.DataFrame({"archive_id": [hashlib.sha256(data).hexdigest()[:32]], "n_records": [len(frames)], "data": [data]})

        frames, size = [], 0
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"]]
            refs = [None if pd.isna(x) else int(x) for x in batch["refers_to"]]
            for page_id, url, payload, ref, again in zip(ids, batch["url"], batch["payload"], refs, batch["revisit"], strict=True):
                frames.append(deflate.compress(record(page_id, url, bytes(payload), ref, bool(again))))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield archive(frames)
                    frames, size = [], 0
        if frames:
            yield archive(frames)

    return marked(pages, payload_min).mapInPandas(pack, ARCHIVE)


def read_archives(archives: DataFrame) -> DataFrame:
    """All records (RECORD) of the archives."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                out = pd.DataFrame(list(read_archive(bytes(data))), columns=[x.split()[0] for x in RECORD.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("data").mapInPandas(unpack, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(write_archives(table(spark, sf_dir, "pages")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32 has no function in this dialect, so the digest's 160 bits are dealt into 32 digits of 5 bits by arithmetic on its hex digits.
OP10_SQL = """
WITH a AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS keep,
         list_transform(range(1, 41), lambda i: instr('0123456789ABCDEF', substr(hex, CAST(i AS INTEGER), 1)) - 1) AS nibble FROM a
), c AS (
  SELECT *, list_transform(range(0, 160), lambda i: (nibble[(i // 4) + 1] // CAST(pow(2, 3 - i % 4) AS INTEGER)) % 2) AS bit FROM b
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * bit[5 * i + 1] + 8 * bit[5 * i + 2] + 4 * bit[5 * i + 3] + 2 * bit[5 * i + 4] + bit[5 * i + 5] AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM c"""
