"""Benchmark decontamination: an FM-index for each training shard, searched for the windows of the benchmark.

A shard is one Arrow batch of documents. Words outside the benchmark's vocabulary can't be part of a match, so
the index is built over the maximal runs of vocabulary words that are long enough, and over all of those. It
holds the Burrows-Wheeler transform of the runs as a wavelet matrix, whose ranks drive the backward search of
all windows at once; occurrences are located by walking to sampled suffix positions. Places of hits are merged
into spans.

The benchmark's windows are coded in blocks of at most BLOCK_WORDS words, each a file of the shared folder, written
by the tasks that read the benchmark. A task searches its shard for one block after another and holds one at a time;
nothing of the benchmark is sent to the driver or broadcast but the blocks' paths.

Edge cases: a null text has no words; an item of fewer words than a window is one window, an item without words
has none; items with equal ids count once; null ids are one empty id; repeated rows give repeated results; an empty table on either side
gives no hits; further columns are kept by decontaminate() and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import filesystem, lean, scratch, table

#: Consecutive words of a window.
WINDOW = 10
#: Words of benchmark text that are searched in one go.
BLOCK_WORDS = 200_000
#: Every so many positions of a suffix array are kept.
SAMPLE = 8

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Lower-cased words in UTF-8."""
    return (text or "").encode().translate(_TO_WORDS).split()


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Sorted suffixes of x by prefix doubling; a shorter suffix comes before a longer one that it starts."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        if n == 0 or fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of the symbols."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = (x >> k) & 1
            zeros = np.zeros(len(x) + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.before.append(zeros)
            self.zeros.append(int(zeros[-1]))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i stands after the last level, if it followed the bits of c."""
        for k, before, zeros in zip(range(self.bits - 1, -1, -1), self.before, self.zeros, strict=True):
            z = before[i]
            i = np.where((c >> k) & 1, zeros + i - z, z)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i."""
        return self.place(c, i) - self.place(c, np.zeros_like(i))


class FMIndex:
    """Backward search over a sequence of symbols from 1 to top; 0 separates what no match may cross."""

    def __init__(self, x: np.ndarray, top: int):
        # Symbols move up by one, and the only 0 ends the sequence: rotations then sort as suffixes do.
        x = np.append(np.asarray(x, np.int64) + 1, 0)
        order = suffix_array(x)
        self.last = x[order - 1]
        self.tree = WaveletMatrix(self.last, int(top + 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=top + 2))])
        self.n = len(x)
        self.kept = order % SAMPLE == 0
        self.at_kept = order[self.kept]
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the sorted suffixes that begin with each pattern; patterns are rows of one length."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k] + 1
            low = self.first[c] + self.tree.rank(c, low)
            high = self.first[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of sorted suffixes: steps back until a sampled one is met."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[rows[todo]]
            done = todo[hit]
            out[done] = self.at_kept[self.kept_before[rows[done]]] + steps
            todo = todo[~hit]
            c = self.last[rows[todo]]
            rows[todo] = self.first[c] + self.tree.rank(c, rows[todo])
            steps += 1
        return out


class Phrases:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, split in items:
            coded = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split]
            for k in range(max(min(1, len(coded)), len(coded) - window + 1)):
                owners[tuple(coded[k : k + window])].add(item)
        self.owners = list(owners.values())
        by_size: dict[int, list[int]] = defaultdict(list)
        listed = list(owners)
        for k, p in enumerate(listed):
            by_size[len(p)].append(k)
        self.groups = [(n, np.array([listed[k] for k in ks], np.int64), np.array(ks)) for n, ks in sorted(by_size.items())]
        self.shortest = min(by_size, default=0)

    def find(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence in texts (lists of words): its place in the joined words, its size, its window, its text."""
        edges = np.cumsum([0, *map(len, texts)])
        none = (np.zeros(0, np.int64),) * 4
        if not self.groups:
            return none
        get = self.vocabulary.get
        coded = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, edges[-1])
        first = np.zeros(len(coded) + 1, bool)
        first[edges] = True
        inside = coded > 0
        begins = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return none
        # The runs with a 0 after each, and where each symbol came from.
        size = ends - begins + 1
        place = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
        run = np.where(place < np.repeat(ends, size), coded[np.minimum(place, len(coded) - 1)], 0)
        index = FMIndex(run, len(self.vocabulary))
        at, n, which = [], [], []
        for length, patterns, ks in self.groups:
            low, high = index.search(patterns)
            count = high - low
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            at.append(place[index.locate(rows)])
            n.append(np.full(len(rows), length))
            which.append(np.repeat(ks, count))
        at = np.concatenate(at)
        return at, np.concatenate(n), np.concatenate(which), np.searchsorted(edges, at, "right") - 1


def _stretches(split: list[bytes], window: int, limit: int) -> Iterator[list[bytes]]:
    """A text's words in stretches of about limit words that overlap so that each window lies in one of them."""
    step = max(1, limit - window + 1)
    for k in range(0, max(1, len(split) - window + 1), step):
        yield split[k : k + step + window - 1]


def phrase_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int | None = None) -> list[str]:
    """Paths of the benchmark's blocks, files written by the tasks that succeeded."""
    folder, limit = scratch(benchmark.sparkSession, "phrases"), block or BLOCK_WORDS
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[bytes]]] = []
        size = 0

        def written() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}"
            fs, at = filesystem(path)
            with fs.open_output_stream(at) as out:
                out.write(pickle.dumps(Phrases(held, window)))
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _stretches(words(text), window, limit):
                    if held and size + len(part) > limit:
                        yield written()
                        held, size = [], 0
                    if part:
                        held.append((item, part))
                        size += len(part)
        if held:
            yield written()

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return sorted(r["path"] for r in items.mapInArrow(lean(run), "path string").collect())  # a path for each block


@lru_cache(maxsize=1)
def _block(path: str) -> Phrases:
    """A block, kept until the task's worker asks for another."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as stream:
        return pickle.loads(stream.read())


def _hits(blocks: list[str], texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[set[str]]]:
    """For each text: its words, a flag for each word that is hit, and the items that occur."""
    split = [words(t) for t in texts]
    edges = np.cumsum([0, *map(len, split)])
    change = np.zeros(edges[-1] + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for path in blocks:
        block = _block(path)
        at, n, which, text = block.find(split)
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        for t, w in np.unique(np.stack([text, which], 1), axis=0).tolist():
            items[t] |= block.owners[w]
    hit = np.cumsum(change[:-1]) > 0
    return list(map(len, split)), np.split(hit, edges[1:-1]), items


def _sliced(batches: Iterator[pa.RecordBatch], limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    from tracewell.llm.bpe import _bounded

    return _bounded(batches, "text", limit)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = phrase_blocks(benchmark, window=window)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            n, hits, items = _hits(blocks, batch.column("text").to_pylist())
            n_hit = [int(h.sum()) for h in hits]
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            columns = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in n_hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def _without(text: str, hit: np.ndarray) -> str:
    """text without the spans from the first to the last word of each run of hit words."""
    places = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with every hit span cut out of text_col, until nothing is left to hit; texts without hits stay as they are."""
    blocks = phrase_blocks(benchmark, window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracewell.llm.bpe import _bounded

        for batch in _bounded(batches, text_col, 8_000_000):
            texts = batch.column(text_col).to_pylist()
            todo = [k for k, t in enumerate(texts) if t]
            while todo:
                _, hits, _ = _hits(blocks, [texts[k] for k in todo])
                found = [(k, h) for k, h in zip(todo, hits, strict=True) if h.any()]
                for k, h in found:
                    texts[k] = _without(texts[k], h)
                todo = [k for k, _ in found]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(lean(run), docs.schema)


#: The same rows by SQL: words, windows of either side, and the words that occurrences cover.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, size, hash(w[k + 1 : k + size]) AS h, w[k + 1 : k + size] AS words
  FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, unnest(range(len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size),
coded AS (SELECT p.r, p.size, p.k, hash(d.w[p.k + 1 : p.k + p.size]) AS h, d.w[p.k + 1 : p.k + p.size] AS words FROM places p JOIN d USING (r)),
found AS (SELECT c.r, c.size, c.k, x.item FROM coded c JOIN windows x ON c.h = x.h AND c.size = x.size AND c.words = x.words),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS j FROM (SELECT DISTINCT r, k, size FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY encode(item))) AS items_sha256 FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
