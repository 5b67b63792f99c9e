"""Token files of directly addressable codes.

An id is cut into chunks of CHUNK bits. Level 0 holds the lowest chunk of every id, level k those of the ids that
go on; a bitmap at each level says which do, and a directory of ranks over the bitmap finds an id's place in the
next level. So any token is reached by one step a level, with no block to decode.

A shard file is: MAGIC, the length of a JSON header, the header, and the arrays it lists. Shards are written in
ascending document order: documents are dealt out by ranges of their id, and a task writes its range as one or
more shards. Only a total for each range reaches the driver.

Edge cases: a null text is empty and takes one token, the end id; a null id comes first; rows of one id stand in
the order of their texts; an empty table gives no shard and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe
from tracewell.llm._shared import filesystem, scratch, table

MAGIC = b"DACTOK01"
#: Bits of a chunk.
CHUNK = 8
#: Bits of a bitmap between two entries of its rank directory.
RANK_BITS = 512
#: Tokens after which a task begins a new shard; bounds its memory.
SHARD_TOKENS = 8_000_000
#: The id that ends each document.
END_ID = 0

_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Levels:
    """Directly addressable codes of a sequence of ids."""

    def __init__(self, n: int, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.chunks, self.bitmaps, self.ranks = n, chunks, bitmaps, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> Levels:
        chunks, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint32)
        while True:
            chunks.append((rest & (2**CHUNK - 1)).astype(np.uint8))
            rest = rest >> CHUNK
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            step = RANK_BITS // 8
            counts = np.add.reduceat(_POPULATION[bits].astype(np.uint64), np.arange(0, len(bits), step)) if len(bits) else np.zeros(0, np.uint64)
            bitmaps.append(bits)
            ranks.append((np.cumsum(counts) - counts).astype(np.uint32))
            if not more.any():
                return cls(len(ids), chunks, bitmaps, ranks)
            rest = rest[more]

    def __getitem__(self, i: int) -> int:
        """Token i, by a rank in each level it reaches."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << (CHUNK * k)
            byte, bit = divmod(i, 8)
            if not (self.bitmaps[k][byte] >> bit) & 1:
                break
            block = i // RANK_BITS
            inside = self.bitmaps[k][block * RANK_BITS // 8 : byte + 1].copy()
            inside[-1] &= (1 << bit) - 1
            i = int(self.ranks[k][block]) + int(_POPULATION[inside].sum())
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        out = self.chunks[0].astype(np.uint32)
        at = np.arange(self.n)
        for k in range(1, len(self.chunks)):
            at = at[np.unpackbits(self.bitmaps[k - 1], count=len(at), bitorder="little").astype(bool)]
            out[at] |= self.chunks[k].astype(np.uint32) << np.uint32(CHUNK * k)
        return out


def pack(levels: Levels, doc_ids: list[int | None], ends: list[int], before: int) -> bytes:
    """A shard: the codes, each document's id and end, and the tokens before it within its range."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    arrays = [("known", known), ("doc_ids", ids), ("ends", np.array(ends, np.int64))]
    for k in range(len(levels.chunks)):
        arrays += [(f"chunks{k}", levels.chunks[k]), (f"bits{k}", levels.bitmaps[k]), (f"ranks{k}", levels.ranks[k])]
    head = {"n": levels.n, "before": before, "chunk": CHUNK, "levels": len(levels.chunks), "arrays": [(k, a.dtype.str, len(a)) for k, a in arrays]}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *(a.tobytes() for _, a in arrays)])


class Shard:
    """A shard file in memory."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", data, 8)
        head, at, found = json.loads(data[12 : 12 + n]), 12 + n, {}
        for name, kind, count in head["arrays"]:
            found[name] = np.frombuffer(data, np.dtype(kind), count, at)
            at += found[name].nbytes
        of = lambda name: [found[f"{name}{k}"] for k in range(head["levels"])]
        self.levels = Levels(head["n"], of("chunks"), of("bits"), of("ranks"))
        self.before, self.ends = head["before"], found["ends"]
        self.doc_ids = [int(d) if k else None for d, k in zip(found["doc_ids"], found["known"], strict=True)]

    def token(self, i: int) -> int:
        return self.levels[i]


_MANIFEST = "part int, shard int, file string, n_tokens long"


def write_shards(docs: DataFrame, root: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts and write shards under root; returns the manifest, a row per shard, itself a table in root."""
    path = path or bpe.default_path()
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = bpe.encoder(path), TaskContext.get()
        fs, base = filesystem(f"{root}/data")
        fs.create_dir(base, recursive=True)
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        ends: list[int] = []
        before = size = 0
        end_id = np.array([END_ID], np.uint32)

        def flush() -> None:
            nonlocal before, size
            if not docs:
                return
            # The attempt is part of the name; the manifest keeps the names of the attempts that succeeded.
            name = f"tokens-{task.partitionId():06d}-{len(rows):04d}-{task.taskAttemptId()}.dac"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pack(Levels.build(np.concatenate(ids)), docs, ends, before))
            rows.append((task.partitionId(), len(rows), name, size))
            before += size
            size = 0
            for x in (ids, docs, ends):
                x.clear()

        for batch in batches:
            for part in bpe._bounded([batch], "text"):
                for doc_id, own in zip(part.column("doc_id").to_pylist(), enc.encode_texts(part.column("text").to_pylist()), strict=True):
                    ids += [own, end_id]
                    size += len(own) + 1
                    docs.append(doc_id)
                    ends.append(size)
                    if size >= SHARD_TOKENS:
                        flush()
        flush()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _MANIFEST.split(", ")])

    ranged.mapInArrow(run, _MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def read_shards(manifest: DataFrame, root: str) -> DataFrame:
    """Per document what its shard holds: doc_id, start among all tokens, n_tokens, and a checksum of the ids."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a number for each range
    starts, at = [], 0
    for r in totals:
        starts.append((r["part"], at))
        at += r["n"]
    ranges = spark.createDataFrame(starts, "part int, begin long")
    files = manifest.join(F.broadcast(ranges), "part").select("file", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(f"{root}/data")
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    shard = Shard(f.read())
                ids = shard.levels.decode().astype("<u4")
                begin = np.append(0, shard.ends[:-1])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), shard.ends.tolist(), strict=True)]
                columns = [shard.doc_ids, begin + (r["begin"] + shard.before), shard.ends - begin, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A task a file or so; files are at least as many as ranges with rows.
    return files.repartition(max(1, len(starts)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "tokens")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), root), root)
