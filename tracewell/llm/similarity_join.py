"""Exact n-gram Jaccard join, reported as connected components.

1. A document's set is its distinct hashed shingles. Equal sets are one class from here on: copies cost nothing.
2. Classes that can reach the threshold are brought together. Sizes fall into levels whose ends are a factor of
   the threshold apart; linked sets meet in the level of the larger one. There they differ in at most D shingles,
   so of the slices of the hash range all but D are equal in both, and the sum over a slice is a shared key. Of its
   keys a class uses only the D + 1 that fewest classes have (prefix filter), so what common passages share is set
   aside and brings nothing together. Keys are counted exactly but in crowded buckets of BUCKETS, where the bucket's
   size takes the place of the count: no task meets a key with more rows than that. Of the keys used, each batch
   passes on one class of each, and what ties the others to it.
3. Classes that share keys, directly or in chains, form a block. Within a block a T-occurrence search finds every
   link: inverted lists by shingle, the short ones merged, the long ones (T - 1 at most, so nothing is missed)
   probed by binary search for the candidates that are left, and those reaching the overlap are kept.
   Blocks of more than CELL classes are dealt to chunks, each searched along with a few hubs of the block. That
   ties most of a family together. Classes outside the block's largest component, and they alone, are then searched
   for among the classes of every chunk: pairs within one component need no search.
4. Components of the links, by alternating large and small stars, labelled with the smallest doc_id.

Hashes have 64 bits; set identity has 128.

Edge cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; fewer words
than a shingle make one shingle of all of them; a null id has a null component; rows of one id are one node, linked
if any of them is; an empty table gives an empty result; further columns are ignored (or kept by deduplicate()).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.llm._shared import Workspace, lean, release, spread_join, staged, table
from tracewell.llm.bpe import _bounded

#: Words of a shingle and the threshold in percent.
WORDS, PERCENT = 3, 90
#: Classes that one task searches at a time, and classes of a larger block that go to each of its tasks.
CELL, HUBS = 250, 4
#: Buckets that keys are first counted in, and rows from which a bucket is crowded (or four times the mean, if that is more).
BUCKETS, CROWD = 1 << 20, 50_000
#: Ids up to which a list of them is sent to all tasks.
ID_ROWS = 1_000_000
#: Edges a task holds before it sends on the forest they span, and edges that one task settles.
HELD_EDGES = 500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: dict, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of n words, or of all words if they are fewer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _A + h[k : len(h) - size + 1 + k])
    return np.unique(out)


class Levels:
    """Levels of set sizes: linked sets differ by one level at most. slices[level] is one more than the shingles
    in which linked sets of the level can differ."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, np.int64)
        self.slices = [2 * (top - 1) * (100 - percent) // (100 + percent) + 1 for top in low[1:]]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1


def keys(h: np.ndarray, levels: Levels) -> list[tuple[int, np.ndarray]]:
    """For a set (sorted hashes), in its own level and the next: how many more keys than its own it may use, and its keys.

    A fifth more slices than could differ are cut. Linked sets agree in all but D of the slices that hold something,
    so, in any one order of keys, they meet among the first D + 1 of each (prefix filter). A set with fewer such
    slices keeps all its keys, those of its empty slices too: two such sets may share nothing else.
    """
    out = []
    if not len(h):
        return out
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h), dtype=np.uint64)])
    top = h >> np.uint64(32)
    own = levels.of(len(h))
    for level in (own, own + 1):
        need = levels.slices[level]
        k = need + need // 5 + 2 if need > 1 else 1
        cuts = np.searchsorted((top * np.uint64(k)) >> np.uint64(32), np.arange(k + 1))
        part = _mix(sums[cuts[1:]] - sums[cuts[:-1]] + np.arange(k, dtype=np.uint64) * _A + np.uint64((level + 1) * int(_C) & 0xFFFFFFFFFFFFFFFF))
        full = cuts[1:] > cuts[:-1]
        part = part[full] if full.sum() >= need else part
        out.append((need - len(part) if full.sum() >= need else k, part.view(np.int64)))
    return out


class Forest:
    """Union-find; roots are the smallest of their tree."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: a spanning forest of the ids that share keys, in streams of bounded size."""
    forest, last_key, last_id = Forest(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if last_key == key[0] and last_id != ids[0]:
            forest.join(last_id, int(ids[0]))
        same = np.flatnonzero((key[1:] == key[:-1]) & (ids[1:] != ids[:-1]))
        for a, b in np.unique(np.stack([ids[same], ids[same + 1]], 1), axis=0).tolist():
            forest.join(a, b)
        last_key, last_id = key[-1], int(ids[-1])
        if len(forest.up) > HELD_EDGES:
            yield _edge_batch(forest.edges())
            forest = Forest()
    yield _edge_batch(forest.edges())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of a partition."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.join(u, v)
    yield _edge_batch(forest.edges())


def components(edges: DataFrame, label: str = "components", few: int = HELD_EDGES) -> DataFrame:
    """(u, v) for each node but the smallest of its component, v being that smallest; edges has columns u and v.

    Edges that are counted to be few are settled by one task; more than that by alternating large and small stars,
    where a hub's edges are spread over tasks.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = staged(now, label), None
    if now.limit(few + 1).count() <= few:
        return staged(now.repartition(1).mapInArrow(lean(_forest), "u long, v long"), label)
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = spread_join(both, staged(low, label), "u", "v", "inner").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = staged(large, label)
        low = staged(large.groupBy("u").agg(F.min("v").alias("low")), label)
        down = spread_join(large, low, "u", "v", "inner").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = staged(down.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), label)


def search(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect whatever is linked among the sets, by T-occurrence search (DivideSkip).

    sides: if given, only pairs of different sides are looked for.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    flat = np.concatenate([sets[k] for k in order]) if len(order) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(flat, kind="stable")
    values, begin, count = np.unique(flat[by], return_index=True, return_counts=True)
    lists = owner[by]
    ends = np.cumsum(sizes)
    which = np.searchsorted(values, flat)
    forest = Forest()
    linked: list[tuple[int, int]] = []
    for q in range(len(order)):
        n = int(sizes[q])
        if not n:
            continue
        mine = which[ends[q] - n : ends[q]]
        need = -(-percent * n // 100)
        smallest = need
        mine = mine[np.argsort(count[mine], kind="stable")]
        # The T - 1 longest lists can be set aside: whoever is only there lacks the overlap.
        aside = need - 1
        short, long = mine[: n - aside], mine[n - aside :]
        parts = [lists[begin[s] : begin[s] + count[s]] for s in short]
        # Partners come earlier in the order of sizes, and are no smaller than the overlap asks.
        first = int(np.searchsorted(sizes, smallest))
        parts = [p[np.searchsorted(p, first) : np.searchsorted(p, q)] for p in parts]
        total = sum(map(len, parts))
        if not total:
            continue
        if total <= 64:
            merged = [(k, len(list(g))) for k, g in groupby(heapq.merge(*(p.tolist() for p in parts)))]
            cand, have = np.array([k for k, _ in merged]), np.array([c for _, c in merged])
        else:
            cand, have = np.unique(np.concatenate(parts), return_counts=True)
        if sides is not None:
            other = sides[order[cand]] != sides[order[q]]
            cand, have = cand[other], have[other]
        top = forest.root(q)
        apart = np.array([forest.root(c) != top for c in cand.tolist()], bool)
        cand, have = cand[apart], have[apart]
        # 100 * i >= percent * (n + m - i)
        want = -(-percent * (n + sizes[cand]) // (100 + percent))
        for k, s in enumerate(long.tolist()):
            left = len(long) - k
            alive = have + left >= want
            if not alive.all():
                cand, have, want = cand[alive], have[alive], want[alive]
            if not len(cand):
                break
            p = lists[begin[s] : begin[s] + count[s]]
            at = np.searchsorted(p, cand)
            have = have + ((at < len(p)) & (p[np.minimum(at, len(p) - 1)] == cand))
        for c in cand[have >= want].tolist():
            if forest.root(c) != forest.root(q):
                forest.join(c, q)
                linked.append((ids[order[c]], ids[order[q]]))
    return linked


def _schema(docs: DataFrame, *fields: tuple[str, str]):
    out = docs.schema
    for name, kind in fields:
        out = type(out)([*out.fields]).add(name, kind)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, size of the set, its identity, and its keys; written once, since all that follows is read from it."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, levels = _WordHashes(), Levels(percent)
        for batch in batches:
            size, same, found, spare, lows = [], [], [], [], []
            for t in batch.column("text"):
                h = shingles(t.as_py(), hashes, n)
                size.append(len(h))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                own = keys(h, levels) or [(0, np.zeros(0, np.int64))] * 2
                found.append(np.concatenate([x for _, x in own]))
                spare.append([x for x, _ in own])
                lows.append(len(own[0][1]))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(same, pa.binary()), rows, pa.array(lows, pa.int32()), pa.array(spare, pa.list_(pa.int32()))], names=["id", "n_shingles", "same", "keys", "n_low", "spare"])

    return staged(docs.mapInArrow(lean(run), "id long, n_shingles long, same binary, keys array<long>, n_low int, spare array<int>"), "classes")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows of wanted (by id) with the shingles of the id's texts as data."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    few = wanted.limit(ID_ROWS + 1).count() <= ID_ROWS
    found = texts.join(F.broadcast(wanted) if few else wanted, "id")
    keep = wanted.columns

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in _bounded(batches, "text", 8_000_000):
            data = [shingles(t.as_py(), hashes, n).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(data, pa.binary())], names=[*keep, "data"])

    found = found.select(*keep, "text")
    return found.mapInArrow(lean(sets), _schema(found.drop("text"), ("data", "binary")))


def _search_cells(cells: DataFrame, percent: int, sided: bool) -> DataFrame:
    """Edges within each cell (block, i, j), or between its two sides; big says that the block has several chunks."""

    def run(part: pa.Table) -> pa.Table:
        rows = part.select(["id", "side", "data"]).to_pylist()
        # Rows in one order whatever the order of arrival, and one node for rows of one id.
        rows.sort(key=lambda r: (r["id"], r["side"], r["data"]))
        sides = np.array([r["side"] for r in rows]) if sided else None
        found = _edge_batch(search([r["id"] for r in rows], [np.frombuffer(r["data"], np.uint64) for r in rows], percent, sides))
        if part.nbytes > 1 << 20:
            del rows
            release()
        return pa.Table.from_batches([found]).append_column("big", pa.array([part.column("big")[0].as_py()] * found.num_rows, pa.bool_()))

    return cells.groupBy("block", "i", "j").applyInArrow(run, "u long, v long, big boolean")


def links(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Edges (u, v) that connect whatever is linked; members: id and block of every class that shares a key with another."""
    hubs = F.array(*(F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"] for k in range(HUBS)))
    sizes = staged(members.groupBy("block").agg(F.count(F.lit(1)).alias("n_ids"), hubs.alias("hubs")), "blocks")
    chunked = spread_join(members, sizes, "block", "id", "inner").withColumn("n_chunks", F.ceil(F.col("n_ids") / F.lit(cell)).cast("int"))
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("n_chunks")).cast("int")
    chunked = staged(chunked.select("id", "block", "n_chunks", chunk.alias("chunk"), F.array_contains("hubs", F.col("id")).alias("hub")), "chunks")
    every = F.sequence(F.lit(0), F.col("n_chunks") - 1)
    cells = _sets(docs, chunked, id_col, text_col, n).withColumn("i", F.explode(F.when(F.col("hub"), every).otherwise(F.array("chunk"))))
    cells = cells.select("id", "block", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), (F.col("n_chunks") > 1).alias("big"), "data")
    found = staged(_search_cells(cells, percent, False), "links")
    big = chunked.where("n_chunks > 1").select("id", "block", "n_chunks", "chunk")
    if not big.limit(1).count():
        return found.select("u", "v")
    tied = components(found.where("big").select("u", "v"), "tied")
    rooted = staged(spread_join(big, tied.select(F.col("u").alias("id"), "v"), "id", "chunk").select("id", "block", "n_chunks", "chunk", F.coalesce("v", "id").alias("root")), "rooted")
    largest = rooted.groupBy("block", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    largest = staged(largest.select("block", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / F.lit(cell)).cast("int").alias("n_rest")).where("n_rest > 0"), "largest")
    placed = spread_join(rooted, largest, "block", "id", "inner")
    rest = placed.where("root <> top").withColumn("j", F.pmod(F.xxhash64("id", F.lit("rest")), F.col("n_rest")).cast("int"))
    rest = rest.select("id", "block", F.explode(every).alias("i"), "j", F.lit(1).alias("side"))
    whole = placed.select("id", "block", F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("j"), F.lit(0).alias("side"))
    where = staged(rest.unionByName(whole).withColumn("big", F.lit(True)), "cells")
    more = staged(_search_cells(_sets(docs, where, id_col, text_col, n), percent, True), "links")
    return found.unionByName(more).select("u", "v")


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) for one id of each key in a batch, and edges (u, v) that tie the others to it: hot keys stay small."""
    for batch in batches:
        key, ids = (batch.column(c).to_numpy() for c in ("key", "id"))
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = ids[new][np.cumsum(new) - 1] if len(ids) else ids
        apart = first != ids
        forest = Forest()
        for x, y in np.unique(np.stack([first[apart], ids[apart]], 1), axis=0).tolist():
            forest.join(x, y)
        edges = np.array(forest.edges(), np.int64).reshape(-1, 2)
        n = int(new.sum())
        rows = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(edges), pa.int64())]) for x in (key[new], ids[new])]
        rows += [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(edges[:, c])]) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays(rows, names=["key", "id", "u", "v"])


def _bucket_sizes(keys: DataFrame) -> np.ndarray:
    """How many keys fall into each bucket; an array of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flat = batch.column("keys").flatten().to_numpy()
            if len(flat):
                total += np.bincount(flat & (BUCKETS - 1), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    got = keys.select("keys").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, cell: int = CELL, crowd: int = CROWD) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = classes(docs, id_col, text_col, n, percent)
    known = every.where("id IS NOT NULL AND n_shingles > 0")
    # The first id of each class with copies; copies meet within their tasks first.
    copies = known.groupBy("same").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").drop("n_rows")
    copies = staged(copies, "copies")
    first = staged(spread_join(known.select("id", "same"), copies, "same", "id").select("id", "same", F.coalesce("first_id", "id").alias("first_id")), "first")
    # Keys of one row a class: the others are taken out by their ids.
    others = first.where("id <> first_id").select("id", "same").distinct()
    few = others.limit(ID_ROWS + 1).count() <= ID_ROWS
    one = known.join(F.broadcast(others) if few else others, ["id", "same"], "left_anti")
    # Keys of crowded buckets come last, by the buckets' sizes; no other key has more rows than a bucket that isn't crowded.
    load = _bucket_sizes(one)
    crowded = np.flatnonzero(load > max(crowd, 4 * load.mean()))  # a quarter of the buckets at most
    # Texts of one id are classes of their own: the nth of an id has levels 2 n and 2 n + 1.
    several = known.groupBy("id").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a <> b").select("id")
    several = known.select("id", "same").join(several, "id", "left_semi").distinct().withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("same")))
    several = staged(several, "several")
    few_several = several.limit(ID_ROWS + 1).count() <= ID_ROWS
    one = one.join(F.broadcast(several) if few_several else several, ["id", "same"], "left")
    level = 2 * F.coalesce("nth", F.lit(0)) + (F.col("at") >= F.col("n_low")).cast("int")
    every_key = one.select("id", "nth", "n_low", "spare", F.posexplode("keys").alias("at", "key")).select("key", "id", level.alias("level"), "spare")
    every_key = every_key.select("key", "id", "level", F.get("spare", F.col("level") % 2).alias("spare"))
    # How many classes have a key; those that one class has alone bring nothing together, but count as the rarest.
    counted = F.count(F.lit(1)).over(W.partitionBy("key"))
    if len(crowded):
        sizes = spark.createDataFrame(list(zip(crowded.tolist(), load[crowded].tolist(), strict=True)), "bucket int, size long")
        bucket = F.col("key").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        every_key = every_key.withColumn("bucket", bucket).join(F.broadcast(sizes), "bucket", "left").drop("bucket")
        rare = every_key.where("size IS NULL").drop("size").withColumn("n", counted).where("n > 1")
        rare = rare.unionByName(every_key.where("size IS NOT NULL").withColumnRenamed("size", "n"))
    else:
        rare = every_key.withColumn("n", counted).where("n > 1")
    # Of each class and level the first D + 1: spare is that number less all of its keys.
    rare = rare.groupBy("id", "level").agg(F.first("spare").alias("spare"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("k"))
    rare = rare.where(F.size("k") + F.col("spare") > 0).select("id", F.explode(F.slice("k", F.lit(1), F.size("k") + F.col("spare"))["key"]).alias("key"))
    work = Workspace(spark)
    used = work.put(rare.mapInArrow(lean(_tied), "key long, id long, u long, v long"), "keys")
    shared = used.where("key IS NOT NULL").select("key", "id").repartition(n_parts, "key").sortWithinPartitions("key", "id").mapInArrow(lean(_chains), "u long, v long")
    shared = shared.unionByName(used.where("key IS NULL").select("u", "v"))
    stars = components(shared, "blocks")
    members = staged(stars.select(F.col("u").alias("id"), F.col("v").alias("block")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("block"))).distinct(), "members")
    work.close()
    # An id with several texts joins all that their copies stand for.
    bridges = first.where("id <> first_id").join(F.broadcast(several) if few_several else several, "id", "left_semi")
    found = links(docs, members, id_col, text_col, n, percent, cell).unionByName(bridges.select(F.col("id").alias("u"), F.col("first_id").alias("v")))
    joined = components(found, "linked")
    out = spread_join(every.select("id", "n_shingles", "same"), copies, "same", "id").select(
        "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("first_id", "id")).otherwise(F.col("id")).alias("u")
    )
    out = spread_join(out, joined, "u", "id")
    return out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("v", "u")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest id; null ids stay, repeated rows become one."""
    found = link_components(docs, id_col, text_col, n, percent).where("id IS NOT NULL AND id <> component_id").select(F.col("id").alias(id_col)).distinct()
    gone = staged(found, "gone")
    few = gone.limit(ID_ROWS + 1).count() <= ID_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows by SQL: all pairs that share a shingle, and the smallest id that links lead to. For small tables.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 90 * (x.n + y.n - i)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reached(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.v, r.root FROM reached r JOIN both_ways b ON b.u = r.id WHERE r.root < b.v),
c AS (SELECT id, min(root) AS root FROM reached GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""


def op9_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
