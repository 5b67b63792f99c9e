"""Exact substring dedup over bytes: what a string of LENGTH bytes covers that also starts elsewhere goes.

The index is a logarithmic family of sparse suffix arrays. Every window of LENGTH bytes picks an anchor, the place in
it whose next GRAM bytes hash lowest (the leftmost of equals). The choice depends on the window's bytes alone, so
equal windows have anchors at the same offset with the same bytes after them: only suffixes that start at anchors
are kept. A record holds the first GRAM bytes of the suffix, by which arrays are ordered, a digest of all bytes
that the windows of its anchor cover, and where it stands.

1. Documents come in BATCHES batches. Each task sorts the suffixes of what it reads (its suffix array), settles the
   matches within, and passes on one record of each distinct beginning.
2. A batch is dealt to shares by a hash of the beginnings and sorted. It is then merge-scanned against every older
   level, all of them streams of sorted records in files of the shared folder. Suffixes with a common prefix of GRAM
   bytes or more meet there: equal digests are covered whole, others go to step 3.
3. The same scan merges the batch with the newest levels while these are less than twice its size, and writes the
   result as a new level: sizes grow geometrically, so a record is rewritten a logarithmic number of times.
4. Of suffixes that agree in part the bytes around the anchors are fetched, and their windows are compared by hash:
   within a task where a beginning has few contexts, by a distributed count where it has more than HOT.

A beginning known to have several contexts is held by one record, its contexts having gone to step 4 already, so a
level has one record of each beginning, and a scan holds no more than a block of each level. Hashes have 64 bits;
whole coverage needs equal bytes in the beginning and an equal digest.

Edge cases: a null or empty text has no bytes and nothing to remove; texts shorter than LENGTH are kept whole;
matches never cross texts; rows that are equal in id and text are copies of each other; rows with a null id count
like any; ids that are no integers raise; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import Workspace, filesystem, spread_join, table
from tracewell.llm.bpe import _bounded

LENGTH = 200
#: Bytes of a suffix that are kept, and that windows must share after their anchors.
GRAM = 32
#: Batches that a table of documents is entered in.
BATCHES = 4
#: Contexts of a beginning that one task compares.
HOT = 20_000
#: Bytes of texts whose anchors are found in one go; records of an array that a task sorts; records read at a time.
BLOCK, SORTED, CHUNK = 1_000_000, 200_000, 1 << 14

_MASK = 0xFFFFFFFFFFFFFFFF
_POSITION = np.uint64((1 << 20) - 1)
_RECORD = np.dtype([("key", f"S{GRAM + 8}"), ("did", "<i8"), ("rid", "<i8"), ("at", "<i4"), ("back", "u1"), ("less", "u1"), ("flags", "u1"), ("old", "u1")])
#: Flags of a record: its beginning has several contexts and this one has been sent to be compared; covered whole.
_MIXED, _COVERED = 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte value, and an odd one for each doubling.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _mix(np.arange(301, 309, dtype=np.uint64)) | np.uint64(1)


def _doubled(h: np.ndarray, size: int, upto: int) -> np.ndarray:
    """From hashes of all substrings of one size those of a size that is a power of two times as large."""
    while size < upto:
        h = h[:-size] * _ODD[size.bit_length() - 1] + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks in both directions."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    blocks = np.concatenate([x, np.full(full - len(x), np.uint64(_MASK))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _stretches(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of substrings of 128 to 384 bytes, from h, those of all substrings of 128."""
    return _mix(h[start] + _mix(h[np.minimum(start + 128, stop - 128)] + _mix(h[stop - 128] + (stop - start).astype(np.uint64))))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For texts of at most 1 MB together: records of the anchors that windows pick, and the text of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - LENGTH + 1
    if n < 1:
        return np.zeros(0, _RECORD), np.zeros(0, np.int64)
    gram = _doubled(_BYTES[data], 1, GRAM)
    packed = (_mix(gram) & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    pick = (_window_minimum(packed, LENGTH - GRAM + 1) & _POSITION).astype(np.int32)
    del packed
    edge = np.zeros(n + LENGTH, np.int32)
    np.add.at(edge, ends[:-1], 1)
    owner = np.cumsum(edge, dtype=np.int32)
    inside = owner[:n] == owner[LENGTH - 1 : LENGTH - 1 + n]
    fresh = np.ones(n, bool)
    fresh[1:] = (pick[1:] != pick[:-1]) | ~inside[:-1]
    lo = np.flatnonzero(fresh & inside)
    stop = np.ones(n, bool)
    stop[:-1] = fresh[1:] | ~inside[1:]
    hi = np.flatnonzero(stop & inside)
    at, text = pick[lo].astype(np.int64), owner[lo]
    del pick, owner, inside, fresh, stop
    long = _doubled(gram, GRAM, 128)
    digest = _mix(_stretches(long, lo, hi + LENGTH) + ((at - lo).astype(np.uint64) << np.uint64(32)))
    out = np.zeros(len(lo), _RECORD)
    key = np.empty((len(lo), GRAM + 8), np.uint8)
    key[:, :GRAM] = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]
    key[:, GRAM:] = digest.astype(">u8").view(np.uint8).reshape(-1, 8)
    out["key"] = key.view(f"S{GRAM + 8}").ravel()
    out["at"], out["back"], out["less"] = at - (ends - sizes)[text], at - lo, at - hi
    return out, text


def _words(rec: np.ndarray) -> np.ndarray:
    """Keys as numbers, a row per record; they sort as the bytes do."""
    return np.ascontiguousarray(rec["key"]).view(">u8").reshape(len(rec), GRAM // 8 + 1).astype(np.uint64)


def suffix_sorted(rec: np.ndarray) -> np.ndarray:
    """Records in order of their suffixes, then of their digests."""
    return rec[np.lexsort(_words(rec).T[::-1])]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays as one: every record goes to its rank."""
    if not len(a) or not len(b):
        return a if len(a) else b
    place = np.searchsorted(np.ascontiguousarray(a["key"]), np.ascontiguousarray(b["key"]), "right") + np.arange(len(b))
    from_b = np.zeros(len(a) + len(b), bool)
    from_b[place] = True
    out = np.empty(len(from_b), _RECORD)
    out[from_b], out[~from_b] = b, a
    return out


def neighbours(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan sorted records: covered whole and not yet reported, to be compared and not yet sent, number of the beginning.

    Flags of the records are brought up to date.
    """
    words = _words(rec)
    first = np.ones(len(rec), bool)
    first[1:] = (words[1:, :-1] != words[:-1, :-1]).any(axis=1)
    fresh = first.copy()
    fresh[1:] |= words[1:, -1] != words[:-1, -1]
    gram, same = np.cumsum(first) - 1, np.cumsum(fresh) - 1
    sent = rec["flags"] & _MIXED > 0
    twice = np.bincount(same)[same] > 1
    mixed = ((np.bincount(gram, weights=fresh) > 1) | (np.bincount(gram, weights=sent) > 0))[gram]
    whole = twice & (rec["flags"] & _COVERED == 0)
    part = mixed & fresh & ~(np.bincount(same, weights=sent) > 0)[same]
    rec["flags"] |= np.where(mixed, _MIXED, 0).astype(np.uint8) | np.where(twice, _COVERED, 0).astype(np.uint8)
    return whole, part, gram


def _last(gram: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The last record of each beginning among the records listed in of."""
    return of[np.append(gram[of][1:] != gram[of][:-1], True)] if len(of) else of


def merge_scan(runs: list[Iterator[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted runs, read side by side: records covered whole, records to be compared, and what a level of them keeps.

    Records marked old are scanned but not kept. Only a block of each run is in memory, and of a beginning that
    goes on beyond a block two records at most.
    """
    heads: list[np.ndarray | None] = [np.zeros(0, _RECORD) for _ in runs]
    carry = np.zeros(0, _RECORD)
    while True:
        for k, run in enumerate(runs):
            while heads[k] is not None and not len(heads[k]):
                heads[k] = next(run, None)
        live = [k for k, head in enumerate(heads) if head is not None]
        if not live:
            break
        bound = min(heads[k]["key"][-1] for k in live)
        rec = carry
        for k in live:
            n = int(np.searchsorted(np.ascontiguousarray(heads[k]["key"]), bound, "right"))
            rec, heads[k] = merged(rec, heads[k][:n].copy()), heads[k][n:]
        whole, part, gram = neighbours(rec)
        own = _last(gram, np.flatnonzero(rec["old"] == 0))
        done = own[gram[own] < gram[-1]]
        yield rec[whole], rec[part], rec[done]
        carry = rec[np.unique(np.append(own[len(done) :], len(rec) - 1))]
    own = carry[carry["old"] == 0]
    yield carry[:0], carry[:0], own[-1:]


_COLUMNS = {"kind": pa.int8(), "batch": pa.int32(), "share": pa.int32(), "rec": pa.binary(), "did": pa.int64(), "rid": pa.int64(), "a": pa.int32(), "b": pa.int32(), "at": pa.int32(), "gram": pa.int64(), "path": pa.string()}
_ROW = "kind byte, batch int, share int, rec binary, did long, rid long, a int, b int, at int, gram long, path string"
#: Kinds of rows: records for the index, spans covered whole, contexts to be compared, files of a level.
_INDEX, _WHOLE, _PART, _FILE = 0, 1, 2, 3


def _rows(kind: int, n: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    columns = {"kind": np.full(n, kind, np.int8), "batch": np.full(n, -1, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _COLUMNS.items()], names=list(_COLUMNS))


def _gram(rec: np.ndarray) -> np.ndarray:
    """A number for the beginning of each suffix."""
    out = np.zeros(len(rec), np.uint64)
    for w in _words(rec).T[:-1]:
        out = _mix(out + w)
    return out


def _whole_rows(rec: np.ndarray) -> pa.RecordBatch:
    """Spans of records covered whole; those of one document that meet are one span."""
    rec = rec[np.lexsort((rec["at"], rec["rid"], rec["did"]))]
    a = rec["at"] - rec["back"].astype(np.int32)
    b = rec["at"] - rec["less"].astype(np.int32) + LENGTH
    new = np.ones(len(rec), bool)
    new[1:] = (rec["did"][1:] != rec["did"][:-1]) | (rec["rid"][1:] != rec["rid"][:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rec)) - 1
    return _rows(_WHOLE, len(first), did=rec["did"][first], rid=rec["rid"][first], a=a[first], b=b[last])


def _part_rows(rec: np.ndarray) -> pa.RecordBatch:
    a = rec["at"] - rec["back"].astype(np.int32)
    b = rec["at"] - rec["less"].astype(np.int32) + LENGTH
    return _rows(_PART, len(rec), did=rec["did"].copy(), rid=rec["rid"].copy(), a=a, b=b, at=rec["at"].copy(), gram=_gram(rec).view(np.int64))


def _index_rows(rec: np.ndarray, batch: int, shares: int) -> pa.RecordBatch:
    offsets = np.arange(len(rec) + 1, dtype=np.int32) * _RECORD.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(rec), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rec.tobytes())])
    share = ((_gram(rec) >> np.uint64(20)) % np.uint64(shares)).astype(np.int32)
    return _rows(_INDEX, len(rec), batch=np.full(len(rec), batch, np.int32), share=share, rec=packed)


def _records(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], _RECORD, len(column), int(offsets[0])).copy()


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that overlap by LENGTH - 1 bytes, so each window lies in one of them."""
    for a in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
        yield a, data[a : a + BLOCK + LENGTH - 1]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Records of all anchors of documents (did, rid, text, batch), and the batch they belong to, a block of text at a time."""
    for batch in batches:
        for part in _bounded([batch], "text", 4 * BLOCK):
            held: dict[int, list[tuple[int, int, int, bytes]]] = {}
            size: dict[int, int] = {}
            for did, rid, text, b in zip(*(part.column(c).to_pylist() for c in ("did", "rid", "text", "batch")), strict=True):
                for a, piece in _pieces(text.encode()):
                    if size.get(b, 0) + len(piece) > BLOCK + LENGTH:
                        yield b, _of_pieces(held.pop(b))
                        size[b] = 0
                    held.setdefault(b, []).append((did, rid, a, piece))
                    size[b] = size.get(b, 0) + len(piece)
            for b, pieces in held.items():
                yield b, _of_pieces(pieces)


def _of_pieces(pieces: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    rec, text = anchors([p for *_, p in pieces])
    did, rid, shift, _ = zip(*pieces, strict=True)
    rec["did"], rec["rid"] = np.array(did, np.int64)[text], np.array(rid, np.int64)[text]
    rec["at"] += np.array(shift, np.int32)[text]
    return rec


def _find(shares: int):
    """Per batch, sorted suffixes of bounded arrays: what they settle among themselves, and records for the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def settle(b: int) -> Iterator[pa.RecordBatch]:
            rec = suffix_sorted(np.concatenate(held.pop(b)))
            whole, part, gram = neighbours(rec)
            if whole.any():
                yield _whole_rows(rec[whole])
            if part.any():
                yield _part_rows(rec[part])
            yield _index_rows(rec[_last(gram, np.arange(len(rec)))], b, shares)

        for b, rec in _found(batches):
            if len(rec):
                held.setdefault(b, []).append(rec)
                if sum(map(len, held[b])) >= SORTED:
                    yield from settle(b)
        for b in list(held):
            yield from settle(b)

    return run


class _Feed:
    """Rows sorted by share, for each share its levels' files (rec is null) before its records."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.rest = batches, None

    def share(self) -> int | None:
        while self.rest is None or not self.rest.num_rows:
            self.rest = next(self.batches, None)
            if self.rest is None:
                return None
        return self.rest.column("share")[0].as_py()

    def _take(self, share: int, files: bool) -> pa.RecordBatch | None:
        """Rows of the share at hand that are files, or that are records; None if the next row is none of them."""
        if self.share() != share or self.rest.column("rec")[0].is_valid == files:
            return None
        same = (self.rest.column("share").to_numpy() == share) & (np.asarray(self.rest.column("rec").is_null()) == files)
        n = len(same) if same.all() else int(np.argmin(same))
        out, self.rest = self.rest.slice(0, n), self.rest.slice(n)
        return out

    def files(self, share: int) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        while (rows := self._take(share, True)) is not None:
            out += [(p, m) for p, m in zip(rows.column("path").to_pylist(), rows.column("merge").to_pylist(), strict=True) if p]
        return out

    def records(self, share: int) -> Iterator[np.ndarray]:
        while (rows := self._take(share, False)) is not None:
            yield _records(rows.column("rec"))


def _read_level(path: str, old: bool) -> Iterator[np.ndarray]:
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as raw, pa.CompressedInputStream(raw, "zstd") as stream:
        while data := stream.read(CHUNK * _RECORD.itemsize):
            rec = np.frombuffer(data, _RECORD).copy()
            rec["old"] = old
            yield rec


def _scan(folder: str, keep: bool):
    """Per share: merge-scan the batch and all levels; write the records of the batch and of merged levels as a new one.

    Files have names of their own attempt; only rows of attempts that succeeded name a file that is read again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = _Feed(batches)
        while (share := feed.share()) is not None:
            runs = [_read_level(path, not merge) for path, merge in feed.files(share)]
            path, n = f"{folder}/{share}-{uuid.uuid4().hex}.zst", 0
            stream = None
            for whole, part, kept in merge_scan([feed.records(share), *runs]):
                if len(whole):
                    yield _whole_rows(whole)
                if len(part):
                    yield _part_rows(part)
                if keep and len(kept):
                    if stream is None:
                        fs, at = filesystem(path)
                        raw = fs.open_output_stream(at, compression=None)
                        stream = pa.CompressedOutputStream(raw, "zstd")
                    stream.write(kept.tobytes())
                    n += len(kept)
            if stream is not None:
                stream.close()
                raw.close()
                yield _rows(_FILE, 1, share=np.array([share], np.int32), path=pa.array([path]))

    return run


class SuffixIndex:
    """The family of levels: for each its number of records and the table of its files, one of each share."""

    def __init__(self, work: Workspace, shares: int):
        self.work, self.shares, self.added = work, shares, 0
        self.levels: list[tuple[int, DataFrame, str]] = []

    def add(self, rows: DataFrame, size: int, keep: bool = True) -> DataFrame:
        """Scan a batch of records (share, rec) against all levels and enter it; returns what the scan settled.

        Without keep the batch is scanned but not entered, as the last one of a table that no other follows.
        """
        spark, self.added = self.work.spark, self.added + 1
        due = 0
        while keep and due < len(self.levels) and self.levels[-1 - due][0] < 2 * size:
            due += 1
            size += self.levels[-due][0]
        feed = rows.select("share", "rec", F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("merge"))
        # Every share is visited, so that its levels merge even if the batch has nothing there.
        feed = feed.unionByName(spark.range(self.shares).select(F.col("id").cast("int").alias("share"), F.lit(None).cast("binary").alias("rec"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("boolean").alias("merge")))
        for k, (_, files, _) in enumerate(self.levels):
            feed = feed.unionByName(files.select("share", F.lit(None).cast("binary").alias("rec"), "path", F.lit(k >= len(self.levels) - due).alias("merge")))
        folder = self.work.folder(f"level-{self.added}")
        if keep:
            fs, at = filesystem(folder)
            fs.create_dir(at, recursive=True)
        dealt = feed.repartitionById(self.shares, F.col("share")).sortWithinPartitions("share", F.col("rec").asc_nulls_first())
        out = self.work.put(dealt.mapInArrow(_scan(folder, keep), _ROW), f"scan-{self.added}")
        merged_away = [self.levels.pop()[2] for _ in range(due)]
        self.work.drop(*merged_away)
        if keep:
            self.levels.append((size, out.where(F.col("kind") == _FILE).select("share", "path"), f"level-{self.added}"))
        return out.where(F.col("kind") != _FILE)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that the windows of each listed anchor cover."""
    kinds = {"gram": pa.int64(), "did": pa.int64(), "rid": pa.int64(), "lo": pa.int32(), "at": pa.int32(), "data": pa.binary()}
    out: dict[str, list] = {c: [] for c in kinds}

    def sent() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in kinds.items()], names=list(kinds))
        for v in out.values():
            v.clear()
        return batch

    for batch in batches:
        for part in _bounded([batch], "text", 4 * BLOCK):
            for k in range(part.num_rows):
                data = part.column("text")[k].as_py().encode()
                did, rid = part.column("did")[k].as_py(), part.column("rid")[k].as_py()
                for x in part.column("parts")[k].as_py():
                    for c, v in zip(kinds, (x["gram"], did, rid, x["a"], x["at"], data[x["a"] : x["b"]]), strict=True):
                        out[c].append(v)
                    if len(out["did"]) >= 10_000:
                        yield sent()
    if out["did"]:
        yield sent()


def _window_hashes(data: list[bytes], offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start within it, hash) of every window of contexts; the hash takes in the anchor's place in the window."""
    sizes = np.array([len(d) for d in data], np.int64)
    h = _doubled(_BYTES[np.frombuffer(b"".join(data), np.uint8)], 1, 128)
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(data)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(sizes) - sizes, n) + start
    return row, start, _mix(_stretches(h, begin, begin + LENGTH) + (offset[row] - start).astype(np.uint64))


def _span_batch(did: np.ndarray, rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(rid, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["did", "rid", "a", "b"])


def _repeated_windows(data: list[bytes], offset: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start within it) of windows that occur twice; their hashes are held, all else is worked out a block at a time."""

    def block(a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, start, h = _window_hashes(data[a : a + 2000], offset[a : a + 2000])
        return row + a, start, _mix(h + gram[a : a + 2000][row])

    starts = range(0, len(data), 2000)
    every = np.concatenate([block(a)[2] for a in starts])
    every.sort()
    twice = np.append(np.unique(every[1:][every[1:] == every[:-1]]), np.uint64(_MASK))
    rows, places = [], []
    for a in starts:
        row, start, h = block(a)
        hit = twice[np.searchsorted(twice, h)] == h
        rows.append(row[hit])
        places.append(start[hit])
    return np.concatenate(rows), np.concatenate(places)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by beginning: spans of the windows that two contexts of one share."""
    held: list[pa.RecordBatch] = []

    def settle(part: pa.Table) -> pa.RecordBatch:
        key = part.column("gram").to_numpy()
        lo, at = part.column("lo").to_numpy().astype(np.int64), part.column("at").to_numpy().astype(np.int64)
        spans = []
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        data = part.column("data").to_pylist()
        # Beginnings in one go, by a number of rows that bounds the memory.
        a = 0
        while a < len(cuts) - 1:
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + 2000, "right")) - 1)
            i, j = int(cuts[a]), int(cuts[b])
            row, start = _repeated_windows(data[i:j], at[i:j] - lo[i:j], key[i:j].view(np.uint64))
            row += i
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1 if len(row) else first
            spans.append((row[first], lo[row[first]] + start[first], lo[row[last]] + start[last] + LENGTH))
            a = b
        rows = np.concatenate([s[0] for s in spans])
        did, rid = part.column("did").to_numpy()[rows], part.column("rid").to_numpy()[rows]
        return _span_batch(did, rid, np.concatenate([s[1] for s in spans]), np.concatenate([s[2] for s in spans]))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("gram").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield settle(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts as a row per window."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            lo, at = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "at"))
            row, start, h = _window_hashes(part.column("data").to_pylist(), at - lo)
            h = _mix(h + part.column("gram").to_numpy().view(np.uint64)[row])
            did, rid = part.column("did").to_numpy()[row], part.column("rid").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(did), pa.array(rid), pa.array(at[row], pa.int32()), pa.array(lo[row] + start, pa.int32())], names=["window", "did", "rid", "at", "a"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of windows around one anchor as spans."""
    for batch in batches:
        out: dict[str, list[int]] = {"did": [], "rid": [], "a": [], "b": []}
        for r in batch.to_pylist():
            starts = np.unique(r["starts"])
            cuts = np.flatnonzero(np.diff(starts) > 1)
            for a, b in zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True):
                for c, v in zip(out, (r["did"], r["rid"], a, b + LENGTH), strict=True):
                    out[c].append(v)
        yield _span_batch(*(np.array(v, np.int64) for v in out.values()))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans of each document as maximal runs."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        out = []
        for found in batch.column("spans").to_pylist():
            runs: list[dict[str, int]] = []
            for x in found:
                if runs and x["a"] <= runs[-1]["b"]:
                    runs[-1]["b"] = max(runs[-1]["b"], x["b"])
                else:
                    runs.append(x)
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(out, kind)], names=["did", "rid", "spans"])


def repeated_spans(rows: DataFrame, hot: int = HOT, batches: int = BATCHES) -> DataFrame:
    """did, rid and spans (arrays of start and stop) of documents with repeats; rows: did, rid, text."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = Workspace(spark)
    batch = F.pmod(F.col("rid"), F.lit(batches)).cast("int")
    found = work.put(rows.withColumn("batch", batch).mapInArrow(_find(n), _ROW), "suffixes", ("batch",))
    sizes = {r["batch"]: r["n"] for r in found.where("batch >= 0").groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each batch
    index = SuffixIndex(work, n)
    settled = [index.add(found.where(F.col("batch") == b), sizes[b], keep=b < max(sizes)) for b in sorted(sizes)]
    fields = ("kind", "did", "rid", "a", "b", "at", "gram")
    done = found.where("batch < 0").select(*fields)
    for x in settled:
        done = done.unionByName(x.select(*fields))
    whole = done.where(F.col("kind") == _WHOLE).select("did", "rid", "a", "b")
    parts = done.where(F.col("kind") == _PART).select("did", "rid", "gram", "a", "b", "at")
    # A record of an old level is sent again by each later scan that meets its beginning; a set holds it once.
    by_doc = work.put(parts.groupBy("did", "rid").agg(F.collect_set(F.struct("gram", "a", "b", "at")).alias("parts")), "parts")
    contexts = _with_text(rows, by_doc, "inner").mapInArrow(_contexts, "gram long, did long, rid long, lo int, at int, data binary")
    crowded = work.put(by_doc.select(F.explode("parts.gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("gram"), "crowded")
    if crowded.limit(1).count():
        contexts = work.put(contexts, "contexts")
        sides = spread_join(contexts, crowded.withColumn("crowd", F.lit(True)), "gram", "rid")
        windows = work.put(sides.where("crowd").drop("crowd").mapInArrow(_windows, "window long, did long, rid long, at int, a int"), "windows")
        again = work.put(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "again")
        starts = spread_join(windows, again, "window", "rid", "inner").groupBy("did", "rid", "at").agg(F.collect_list("a").alias("starts"))
        whole = whole.unionByName(starts.mapInArrow(_runs, "did long, rid long, a int, b int"))
        contexts = sides.where("crowd IS NULL").drop("crowd")
    shared = contexts.repartition(n, "gram").sortWithinPartitions("gram", "did", "rid", "lo").mapInArrow(_compare, "did long, rid long, a int, b int")
    spans = whole.unionByName(shared).groupBy("did", "rid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    out = work.put(spans.mapInArrow(_merge_spans, "did long, rid long, spans array<struct<a:int,b:int>>"), "spans")
    work.close(keep=("spans",))
    return out


def _with_text(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """rows with what lists holds for them: both sides are dealt by document, at every size.

    An id and text that occur twice are two rows of rows, but one of lists.
    """
    return rows.join(lists.hint("merge"), ["did", "rid"], how)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """data without the union of sorted spans, and the number of maximal runs removed."""
    out, at, runs = [], 0, 0
    stop = -1
    for a, b in spans:
        if a > stop:
            if stop >= 0:
                at = stop
            out.append(data[at:a])
            runs += 1
        stop = max(stop, b)
    out.append(data[stop:] if stop >= 0 else data)
    return b"".join(out), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    spans = repeated_spans(rows.select("did", "rid", "text"), hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _bounded([whole], "text", 8 * BLOCK):
                n, gone, runs, kept = [], [], [], []
                for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    data = t.encode()
                    rest, k = _cut(data, [(x["a"], x["b"]) for x in found or []])
                    n.append(len(data))
                    gone.append(len(data) - len(rest))
                    runs.append(k)
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_text(rows, spans, "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
