"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame at the end of each bundle lists the frames'
compressed and decompressed sizes (the public seekable format), and an index maps each record to its frame and
its offset within that frame. Equal payloads are stored once: the rest are revisit records. Each bundle begins with a
warcinfo record, which the index leaves out. Pages carry no time of their own, so WARC-Date is the time of writing.

Bundles are written by tasks into a shared folder through pyarrow's file systems, under names of their attempt:
the index keeps the rows, and so the names, of the attempts that succeeded. What others left is never read.

Archives are the caller's in a folder that the caller names; without one they go when the application ends.

Edge cases: a null html is an empty payload; a null page_id gives a record with an empty id, which is never referred
to and never a revisit; line ends in a URL are escaped, and a null URL gives no header; payloads under MIN_REVISIT bytes are always stored; repeated rows
give repeated records; an empty table gives no bundle and no rows; further columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import SALTS, filesystem, scratch, table

#: Smaller payloads are never worth a revisit record.
MIN_REVISIT = 100
#: Decompressed bytes after which a frame ends.
FRAME_BYTES = 1 << 20
#: Bytes of compressed frames after which a bundle ends.
BUNDLE_BYTES = 256 << 20

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = {"bundle": "string", "frame": "int64", "frame_at": "int64", "frame_bytes": "int64", "offset": "int64", "length": "int64", "record_id": "int64"}
_READ = {"page_id": "int64", "payload_bytes": "int64", "payload_digest": "string", "record_type": "string", "refers_to": "int64", "intact": "bool"}


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A row per page: its payload, digest and, for revisits, the page that holds the payload.

    Digests are counted with map-side combination; only those that occur twice are joined back, and copies of
    that small side by salt keep a digest of very many pages from meeting in one task.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    first = (
        rows.where(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["payload_digest", "salt"], "left")
    refers = F.when(F.col("first_id") < F.col("page_id"), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _schema(columns: dict[str, str]) -> str:
    names = {"string": "string", "int64": "long", "bool": "boolean"}
    return ", ".join(f"{k} {names[v]}" for k, v in columns.items())


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    kinds = {"string": pa.string(), "int64": pa.int64(), "bool": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(values, columns.values(), strict=True)], list(columns))


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(urn: str) -> int | None:
    return int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def _info(name: str, date: str) -> bytes:
    """The warcinfo record of a bundle."""
    block = b"software: tracewell\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(date: str, page_id: int | None, url: str | None, payload: bytes, payload_bytes: int, payload_digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{payload_digest}",
        f"WARC-Payload-Length: {payload_bytes}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in data, in order."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class Bundle:
    """One seekable file: frames, then the table of their sizes."""

    def __init__(self, root: str, name: str, frame_bytes: int, level: int, date: str):
        import zstandard

        self.fs, base = filesystem(root)
        self.fs.create_dir(base, recursive=True)
        self.name, self.path, self.part = f"{name}.warc.zst", f"{base}/{name}.warc.zst", f"{base}/.{name}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame_bytes, self.at, self.sizes = frame_bytes, 0, []
        self.buffer, self.pending = bytearray(_info(self.name, date)), []

    def add(self, record_id: int, data: bytes) -> list[tuple]:
        self.pending.append((len(self.buffer), len(data), record_id))
        self.buffer += data
        return self.flush() if len(self.buffer) >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.pending:
            return []
        frame = self.zip.compress(bytes(self.buffer))
        self.out.write(frame)
        rows = [(self.name, len(self.sizes), self.at, len(frame), a, n, i) for a, n, i in self.pending]
        self.sizes.append((len(frame), len(self.buffer)))
        self.at += len(frame)
        self.buffer, self.pending = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        body = b"".join(struct.pack("<II", a, b) for a, b in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.out.close()
        self.fs.move(self.part, self.path)
        return rows


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, decompressed bytes) of every frame, from the end of an open file."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * n)
    out, at = [], 0
    for a, b in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, a, b))
        at += a
    return out


def write_archives(records: DataFrame, root: str, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Write the rows of plan_records as bundles under root; returns the index, a row per record, itself a table in root."""
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # The attempt is part of the name: the index that is kept names the files of the attempt that wrote it.
        task, serial, bundle = TaskContext.get(), 0, None
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if bundle is None:
                    bundle = Bundle(f"{root}/data", f"{name}-{serial:04d}", frame_bytes, level, date)
                rows += bundle.add(r["page_id"], _record(date, **r))
                if bundle.at >= BUNDLE_BYTES:
                    rows += bundle.close()
                    bundle, serial = None, serial + 1
            yield _batch(rows, _INDEX)
        if bundle is not None:
            yield _batch(bundle.close(), _INDEX)

    index = f"{root}/index"
    spark = records.sparkSession
    records.mapInArrow(write, _schema(_INDEX)).write.parquet(index)
    return spark.read.schema(_schema(_INDEX)).parquet(index)


def read_archives(index: DataFrame, root: str) -> DataFrame:
    """Every record of the bundles that index names, frame by frame; intact: the stored payload has its digest."""
    # Rows are few bytes for many that they stand for, so the number of tasks is given, not left to their size.
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by a hash of both: by the columns themselves Spark would take it for done by distinct(), and merge tasks.
    frames = index.select("bundle", "frame").distinct().repartition(n, F.xxhash64("bundle", "frame"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        fs, base = filesystem(f"{root}/data")
        for batch in batches:
            wanted: dict[str, list[int]] = {}
            for r in batch.to_pylist():
                wanted.setdefault(r["bundle"], []).append(r["frame"])
            for bundle, numbers in sorted(wanted.items()):
                with fs.open_input_file(f"{base}/{bundle}") as source:
                    places = seek_table(source)
                    for at, n, size in (places[k] for k in sorted(numbers)):
                        source.seek(at)
                        rows = []
                        for head, block in parse_records(unzip.decompress(source.read(n), max_output_size=size)):
                            if head["WARC-Type"] == "warcinfo":
                                continue
                            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                            kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
                            intact = kind == "revisit" or hashlib.sha256(block).hexdigest() == digest
                            rows.append((_number(head["WARC-Record-ID"]), int(head["WARC-Payload-Length"]), digest, kind, refers and _number(refers), intact))
                        yield _batch(rows, _READ)

    return frames.mapInArrow(read, _schema(_READ))


def read_record(index: DataFrame, root: str, record_id: int) -> bytes | None:
    """The raw record of one page by random access: one frame is read and decompressed, no more."""
    import zstandard

    row = index.where(F.col("record_id") == record_id).first()
    if row is None:
        return None
    fs, base = filesystem(f"{root}/data")
    with fs.open_input_file(f"{base}/{row['bundle']}") as source:
        at, n, size = seek_table(source)[row["frame"]]
        source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(source.read(n), max_output_size=size)
    return data[row["offset"] : row["offset"] + row["length"]]


def op5_warc(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    root = root or scratch(spark, "warc")
    index = write_archives(plan_records(table(spark, sf_dir, "pages")), root)
    out = read_archives(index, root)
    # A payload that came back changed must fail loudly, not pass as a row.
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload lost its digest")))
    return out.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
