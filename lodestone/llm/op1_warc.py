"""WARC archives whose records are compressed one by one against a trained dictionary.

Every archive file starts with a skippable Zstandard frame holding the dictionary, itself compressed;
each record then is a frame of its own, so any record can be read by its place. A payload that an
earlier page already has becomes a *revisit* that names that page's record and repeats its digest.

Files are written by Spark's text writer: rows are frames, and the separator after each row is an empty
skippable frame, which every Zstandard reader passes over. So retries and lost tasks are harmless, and
any file system that Spark knows will do. Copies are found on digests alone: one aggregate with partial
sums, one join that Spark can split at hot digests; a payload is shuffled once, to files of about
``FILE_BYTES`` of payload each, which a reader can take whole.

The dictionary is trained on the ``sample_records`` records with the smallest hashes, each up to
``sample_bytes``, its first bytes (a documented bound of training; the archives hold whole payloads). With too little to train on the
files have no dictionary.

Defined cases: a null html is an empty payload; a null page_id is larger than any other; of rows with one
page_id and payload one is written as the others are, the rest revisit it; a null url is left out; an
empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import parts_of, table
from lodestone.scratch import Scratch

#: Magic numbers of the dictionary's skippable frame and of the frame between records (fixed values).
DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
SEPARATOR_FRAME = "P*M\x18\0\0\0\0"  # 0x184D2A50 with length 0

SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, FILE_BYTES = 1000, 16384, 65536, 256 << 20
_LAST = -(1 << 63)  # stands for a null page_id in keys


def record(kind: str, page: str, url: str | None, digest: str, length: int, payload: bytes, refers_to: str | None, ordinal: int, date: str) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has the HTTP headers without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}:{digest}:{ordinal}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}:0>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, sample_records: int = SAMPLE_RECORDS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary from a bounded sample of records, the same on each run; empty if too few."""
    import zstandard

    payload = F.substring(F.coalesce(F.col("html").cast("binary"), F.lit(b"")), 1, sample_bytes)
    share = min(1.0, 4 * sample_records / max(1, pages.count()))  # so that tasks send about as many rows in all, not each
    hashed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url").alias("hash")).where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = hashed.select("page_id", "url", payload.alias("payload"), "hash").orderBy("hash", "page_id", "payload").limit(sample_records).collect()
    records = [record("response", str(r.page_id), r.url, "A" * 32, len(r.payload), bytes(r.payload), None, 0, "2024-01-01T00:00:00Z") for r in sample]
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(dictionary: bytes, date: str, level: int):
    def write(batches):
        import zstandard

        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        begun, run, ordinal = False, None, 0
        for batch in batches:
            frames = []
            if not begun and batch.num_rows:
                begun = True
                if dictionary:
                    held = zstandard.ZstdCompressor(level=19).compress(dictionary)
                    frames.append(DICTIONARY_MAGIC + len(held).to_bytes(4, "little") + held)
                about = b"format: WARC File Format 1.1\r\n"
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo:0>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
                frames.append(packer.compress(head.encode() + about + b"\r\n\r\n"))
            for page_id, url, html, sha, may_revisit, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "may_revisit", "first_id"))):
                ordinal = ordinal + 1 if run == (page_id, sha) else 0
                run = (page_id, sha)
                revisit = may_revisit and (first is not None or ordinal > 0)
                name = "null" if page_id is None else str(page_id)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                frames.append(packer.compress(record("revisit" if revisit else "response", name, url, digest, len(html), html, str(first) if first is not None else name, ordinal, date)))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    return write


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, dictionary: bytes | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write pages (page_id, url, html) as archives in ``path``; payloads of at least ``min_revisit_bytes`` are deduplicated."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dictionary = train_dictionary(pages) if dictionary is None else dictionary
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = keyed.select(F.coalesce("page_id", F.lit(_LAST)).alias("key"), "*", F.sha1("payload").alias("sha"), (F.length("payload") >= min_revisit_bytes).alias("may_revisit"))
    ids = keyed.where("may_revisit").select("key", "page_id", "sha")
    firsts = ids.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first_id is not null").drop("copies")
    later = ids.join(firsts, "sha").where("page_id is null or page_id <> first_id").select("key", "sha", "first_id").distinct()
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    dealt = keyed.repartition(parts_of(pages.sparkSession, total, file_bytes), "key", "sha")
    rows = dealt.join(later.hint("merge"), ["key", "sha"], "left").select("key", "page_id", "url", "payload", "sha", "may_revisit", "first_id").sortWithinPartitions("key", "sha", "url")
    frames = rows.drop("key").mapInArrow(_writer(dictionary, date, level), "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", SEPARATOR_FRAME).text(path)


def frames_of(data: bytes):
    """(magic, place, end) of each Zstandard or skippable frame of a file."""
    import zstandard

    at = 0
    while at < len(data):
        magic = data[at : at + 4]
        if magic[1:] == DICTIONARY_MAGIC[1:] and magic[0] & 0xF0 == 0x50:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        else:
            head = data[at : at + 18]
            end, last = at + zstandard.frame_header_size(head), False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        yield magic, at, end
        at = end


def parse_archive(data: bytes):
    """Header fields and block of each record of a file."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for magic, at, end in frames_of(data):
        if magic == DICTIONARY_MAGIC and not at:
            held = zstandard.ZstdDecompressor().decompress(data[8:end])
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        elif magic[0] & 0xF0 != 0x50 or magic[1:] != DICTIONARY_MAGIC[1:]:
            head, _, rest = unpacker.decompress(data[at:end]).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def _page(urn: str) -> int | None:
    name = urn.split(":")[2]
    return None if name == "null" else int(name)


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse_archive(content.as_py()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length, digest = int(http.rpartition(b"Content-Length: ")[2]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and (length, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
                    rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if with_payload and kind == "response" else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (responses)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_warc(table(spark, sf_dir, "pages"), scratch.at("archives"))
    return read_warc(spark, scratch.at("archives"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hex_column: str) -> str:
    """SQL for the base-32 form of 40 hexadecimal digits: four letters from each five digits."""
    letters = []
    for group in range(8):
        value = " + ".join(f"(instr('0123456789abcdef', substr({hex_column}, {5 * group + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({value}) // {32 ** (3 - k)}) % 32 AS INTEGER) + 1, 1)" for k in range(4)]
    return " || ".join(letters)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, lower(sha1(payload)) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_base32_sql("hex")} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
