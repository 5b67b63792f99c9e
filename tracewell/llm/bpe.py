"""Byte-level BPE encoding and decoding over Arrow batches.

Short texts: the places where the tokenizer splits are found for a whole batch of texts at once in numpy, equal
pieces are encoded once, and their ids are gathered. Long texts: tree concatenation. A text is cut into leaves,
the leaves are encoded side by side, and neighbours are joined pairwise up the tree: a window around each join
is encoded anew and grown until its outermost tokens agree with both sides. The parts of a text over LONG bytes are
encoded by different tasks, in parallel, and joined by the same tree.

Why agreement makes a join exact: a sequence of tokens is the encoding of its piece if and only if each pair of
neighbours is the encoding of its own bytes. The pairs left and right of the window are then pairs that one
side or the window already holds. Agreement counts only GUARD characters or more from the join, so a special
token or a contraction that the cut went through lies within the window.

The ids are those of the tokenizer file's library; the split classes of characters are asked of that library,
so they follow its Unicode version.

Edge cases: a null text counts as empty and gives no ids; repeated rows give repeated results; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.llm._shared import lean, table

#: Characters of a leaf; longer texts are encoded as trees.
LEAF = 16_384
#: Bytes from which on a text's parts are encoded in different tasks, and characters of such a part at most.
LONG, PART = 1 << 20, 1 << 18
#: Characters next to a join whose tokens prove nothing: more than any special token or contraction has.
GUARD = 32
#: Characters of texts that are split in one go; bounds the memory of the arrays.
BLOCK = 500_000
#: Distinct pieces whose ids are remembered within a worker.
REMEMBERED = 150_000

_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = 0, 1, 2, 3, 255
_CONTRACTED = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}


def default_path() -> str:
    """Where the public byte-level vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """The tokenizer of one vocabulary file; encodes and decodes batches."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {k: v for k, v in model["vocab"].items() if k not in self.special}
        ranks = {bytes(letters[c] for c in k): v for k, v in plain.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"]) >= GUARD]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"] or odd or order != sorted(order):
            raise ValueError("not a byte-level BPE file of the supported form")
        self._piece = tiktoken.Encoding("file", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        size = max([*ranks.values(), *self.special.values()]) + 1
        words = [b""] * size
        for k, v in ranks.items():
            words[v] = k
        for k, v in self.special.items():
            words[v] = k.encode()
        self.words = words
        self.decimals = [str(i).encode() for i in range(size)]
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known: dict[bytes, bytes] = {}
        self._class = np.full(0x110000, _UNKNOWN, np.uint8)
        self._learn(np.arange(0x250, dtype=np.uint32))

    def _learn(self, points: np.ndarray) -> None:
        """Ask the library how it splits around characters that are new here."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            if p == 0x20:
                self._class[p] = _SPACE
                continue
            c = chr(p)
            starts = {a for _, (a, _) in split(f"a{c}a1{c}1-{c}-")}
            self._class[p] = _LETTER if 1 not in starts else _NUMBER if 4 not in starts else _OTHER if 7 not in starts else _SPACE

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the pieces in characters, characters, starts of the texts) for texts laid end to end."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=edges[1:])
        kind = self._class[points]
        if kind.size and kind.max() == _UNKNOWN:
            self._learn(np.unique(points[kind == _UNKNOWN]))
            kind = self._class[points]
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), points, edges
        first = np.zeros(n, bool)
        first[edges[:-1][edges[:-1] < n]] = True
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last character of white space before something else stands alone, or goes with what follows if a blank.
        after = np.flatnonzero(start & (kind != _SPACE) & ~first)
        after = after[kind[after - 1] == _SPACE]
        start[after - 1] = True
        start[after[points[after - 1] == 0x20]] = False
        quotes = np.flatnonzero((points == 0x27) & start)
        for q in quotes.tolist():
            end = edges[np.searchsorted(edges, q, "right")]
            tail = "".join(map(chr, points[q + 1 : min(q + 3, end)].tolist()))
            k = _CONTRACTED.get(tail[:1]) or _CONTRACTED.get(tail)
            if k and start[q]:
                start[q + 1 : q + 1 + k] = False
                if q + 1 + k < end:
                    start[q + 1 + k] = True
        return np.flatnonzero(start), points, edges

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of the texts in ids) of texts without special tokens."""
        starts, points, edges = self._pieces(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = "".join(texts).encode()
        if len(data) == len(points):
            at = starts
        else:
            # Bytes beyond one a character, summed up to each start.
            wide = (points >= 0x80).view(np.uint8)
            for limit in (0x800, 0x10000):
                if points.max() >= limit:
                    wide = wide + (points >= limit)
            at = starts + np.cumsum(wide, dtype=np.int32)[starts] - wide[starts]
        offsets = np.append(at, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        known, piece = self._known, self._piece
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        _, places, held = coded.dictionary.buffers()
        cuts = np.frombuffer(places, np.int32, len(coded.dictionary) + 1).tolist()
        held = held.to_pybytes()
        for a, b in zip(cuts, cuts[1:], strict=False):
            w = held[a:b]
            ids = known.get(w)
            if ids is None:
                ids = known[w] = array("I", piece(w)).tobytes()
            found.append(ids)
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[codes] - (ends - n), n) + np.arange(ends[-1])]
        last = np.searchsorted(starts, edges[1:])
        return ids, np.where(last > 0, ends[last - 1], 0)

    def _encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special tokens in a text are found first, as the library does."""
        parts, owner, fixed = [], [], []
        for k, t in enumerate(texts):
            if self._special is not None and self._special.search(t):
                for x in self._special.split(t):
                    parts.append("" if x in self.special else x)
                    fixed.append(self.special.get(x))
                    owner.append(k)
            else:
                parts.append(t)
                fixed.append(None)
                owner.append(k)
        ids, ends = self._encode_plain(parts)
        split = np.split(ids, ends[:-1])
        if len(parts) == len(texts):
            return split
        own: list[list[np.ndarray]] = [[] for _ in texts]
        for k, x, special in zip(owner, split, fixed, strict=True):
            own[k].append(x if special is None else np.array([special], np.uint32))
        return [np.concatenate(x) for x in own]

    def _in_blocks(self, leaves: list[str]) -> list[np.ndarray]:
        """Ids of each leaf; a text of any length takes the memory of one block at a time."""
        out: list[np.ndarray] = []
        begin = size = 0
        for k, t in enumerate(leaves):
            size += len(t)
            if size >= BLOCK or k + 1 == len(leaves):
                out += self._encode_block(leaves[begin : k + 1])
                begin, size = k + 1, 0
        return out

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text in order; texts longer than a leaf become trees."""
        leaves: list[str] = []
        plan: list[tuple[str, list[int]]] = []
        size = 0

        def done() -> Iterator[np.ndarray]:
            parts, at = self._in_blocks(leaves), 0
            for text, cuts in plan:
                mine = parts[at : at + len(cuts) - 1]
                at += len(cuts) - 1
                yield mine[0] if len(mine) == 1 else self._tree(text, cuts, mine)

        for text in texts:
            n = max(1, -(-len(text) // LEAF))
            cuts = [len(text) * k // n for k in range(n + 1)]
            leaves += [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            plan.append((text, cuts))
            size += len(text)
            if size >= BLOCK:
                yield from done()
                leaves, plan, size = [], [], 0
        if plan:
            yield from done()

    def concatenated(self, parts: list[np.ndarray]) -> np.ndarray:
        """Ids of a text from the ids of its consecutive parts, each encoded on its own."""
        texts = [self.decode(ids.tolist()) for ids in parts]
        return self._tree("".join(texts), [0, *accumulate(map(len, texts))], parts)

    def _tree(self, text: str, cuts: list[int], parts: list[np.ndarray]) -> np.ndarray:
        """Join neighbours pairwise until one sequence is left."""
        spans = list(zip(cuts, cuts[1:], strict=False))
        while len(parts) > 1:
            joined, wider = [], []
            for k in range(0, len(parts) - 1, 2):
                (lo, mid), (_, hi) = spans[k], spans[k + 1]
                joined.append(self.join(text, lo, mid, hi, parts[k], parts[k + 1]))
                wider.append((lo, hi))
            if len(parts) % 2:
                joined.append(parts[-1])
                wider.append(spans[-1])
            parts, spans = joined, wider
        return parts[0]

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        reach = 2 * GUARD
        while True:
            a, drop = self._back(left, mid, lo, reach)
            b, take = self._forth(right, mid, hi, reach)
            # A token that ends within a character gives no place to cut the text at.
            window = next(iter(self._encode_block([text[a:b]])))
            ok_left = a == lo or (len(window) > 0 and window[0] == left[drop] and a + self._chars(window[:1]) <= mid - GUARD)
            ok_right = b == hi or (len(window) > 0 and window[-1] == right[take - 1] and b - self._chars(window[-1:]) >= mid + GUARD)
            if ok_left and ok_right:
                return np.concatenate([left[:drop], window, right[take:]])
            reach *= 2

    def _chars(self, ids: np.ndarray) -> int:
        return sum((x & 0xC0) != 0x80 for i in ids.tolist() for x in self.words[i])

    def _back(self, left: np.ndarray, mid: int, lo: int, reach: int) -> tuple[int, int]:
        """(character, index) of the last token of left that starts a character at least reach before mid, else lo and 0."""
        at, best = mid, None
        for k in range(len(left) - 1, -1, -1):
            w = self.words[left[k]]
            at -= sum((x & 0xC0) != 0x80 for x in w)
            if mid - at >= reach and (w[0] & 0xC0) != 0x80:
                best = (at, k)
                break
        return best if best and best[0] > lo else (lo, 0)

    def _forth(self, right: np.ndarray, mid: int, hi: int, reach: int) -> tuple[int, int]:
        """(character, count) after the first token of right that ends a character at least reach after mid, else hi and all."""
        at = mid
        for k in range(len(right)):
            w = self.words[right[k]]
            at += sum((x & 0xC0) != 0x80 for x in w)
            whole = k + 1 == len(right) or (self.words[right[k + 1]][0] & 0xC0) != 0x80
            if at - mid >= reach and whole and at < hi:
                return at, k + 1
        return hi, len(right)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.words.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _coded(docs: DataFrame, path: str, keep: tuple[str, ...], digest: Callable[[Encoder, list[np.ndarray]], list[pa.Array]], out: list[StructField], long_bytes: int, part_chars: int) -> DataFrame:
    """The columns keep, and those that digest makes of the ids of docs' column _text.

    A text of up to long_bytes is encoded within its row's task. Of a longer one, equal rows are counted first, so
    that each stands once; its parts are dealt to all tasks and encoded there, and what goes on to the joins is ids,
    since they hold the text. A group is one text.
    """
    fields = [docs.select(*keep).schema[k] for k in keep]
    schema = StructType([*fields, *out])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in _bounded(batches, "_text", 4 * BLOCK):
            found = digest(enc, list(enc.encode_texts([t or "" for t in batch.column("_text").to_pylist()])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *found], names=schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text = row.column("_text")[0].as_py()
                key = hashlib.sha256(text.encode()).hexdigest()
                n = -(-len(text) // part_chars)
                for j in range(n):
                    piece = text[len(text) * j // n : len(text) * (j + 1) // n]
                    yield pa.RecordBatch.from_arrays([*(row.column(c) for c in (*keep, "_copies")), pa.array([key]), pa.array([j], pa.int64()), pa.array([piece])], names=[*keep, "_copies", "_key", "_part", "_piece"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in _bounded(batches, "_piece", 4 * BLOCK):
            found = [ids.astype(np.uint32).tobytes() for ids in enc.encode_texts(batch.column("_piece").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "_copies", "_key", "_part")), pa.array(found, pa.binary())], names=[*keep, "_copies", "_key", "_part", "_ids"])

    def joined(group: pa.Table) -> pa.Table:
        enc = encoder(path)
        group = group.sort_by("_part")
        found = digest(enc, [enc.concatenated([np.frombuffer(x, np.uint32) for x in group.column("_ids").to_pylist()])])
        own = group.slice(0, 1).combine_chunks()
        return pa.Table.from_arrays([*(own.column(c) for c in (*keep, "_copies")), *found], names=[*keep, "_copies", *schema.names[len(keep) :]])

    is_long = F.coalesce(F.octet_length("_text"), F.lit(0)) > long_bytes
    copies = StructField("_copies", LongType())
    marks = [*fields, copies, StructField("_key", StringType()), StructField("_part", LongType())]
    distinct = docs.where(is_long).groupBy(*keep, "_text").agg(F.count(F.lit(1)).alias("_copies"))
    parts = distinct.mapInArrow(lean(cut), StructType([*marks, StructField("_piece", StringType())])).repartition("_key", "_part")
    ids = parts.mapInArrow(lean(leaves), StructType([*marks, StructField("_ids", BinaryType())]))
    far = ids.groupBy(*keep, "_key").applyInArrow(joined, StructType([*fields, copies, *out]))
    # Equal rows come back in two steps, so that no row holds a long list.
    far = far.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_copies"), F.lit(4096))))
    far = far.withColumn("_from", F.explode(F.sequence("_from", F.least(F.col("_copies"), F.col("_from") + 4095))))
    return docs.where(~is_long).mapInArrow(lean(near), schema).unionByName(far.select(*schema.names))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", long_bytes: int = LONG, part_chars: int = PART) -> DataFrame:
    """The columns keep (of types that Spark can group by), and ids: an array of the text's token ids."""
    docs = docs.select(*keep, F.col(text_col).alias("_text"))
    return _coded(docs, path or default_path(), keep, lambda _, parts: [_lists(parts)], [StructField("ids", ArrayType(IntegerType()))], long_bytes, part_chars)


def decode(tokens: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns keep, and text: what the ids stand for; special tokens are written out."""
    path = path or default_path()
    schema = tokens.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return tokens.select(*keep, ids_col).mapInArrow(lean(run), schema)


def _bounded(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about limit bytes of text; no row is cut or left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0))
        cell = (np.cumsum(each) - each) // limit
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, long_bytes: int = LONG, part_chars: int = PART) -> DataFrame:
    """Encode each text, decode the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    out = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def digest(enc: Encoder, parts: list[np.ndarray]) -> list[pa.Array]:
        n, coded, plain = [], [], []
        for ids in parts:
            listed = ids.tolist()
            n.append(len(listed))
            coded.append(hashlib.sha256(b",".join(map(enc.decimals.__getitem__, listed))).hexdigest())
            plain.append(hashlib.sha256(enc.decode(listed).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string()), *([_lists(parts)] if with_ids else [])]

    return _coded(docs, path or default_path(), ("doc_id",), digest, [*out, *([StructField("ids", ArrayType(IntegerType()))] if with_ids else [])], long_bytes, part_chars)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
