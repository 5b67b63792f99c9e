"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

Inverse document frequencies come from all rows that may be learned from. The weights are trained by
follow-the-regularised-leader with L1 and L2 penalties on a bounded sample of those rows: of each language MAX_FIT
rows at most and its share of FIT_CHARS characters, both in the mean of a draw by id. Tasks turn the sample into
counts of n-grams; the driver gets those. A temperature fitted on a part of the sample that training leaves out
calibrates the probabilities. Every language that occurs is learned; the weights take 0.25 MB for each.

n-grams of 1 to 3 characters are hashed to BUCKETS; characters are lower-cased and what isn't a letter counts as
a blank. Term frequencies are relative to a text's n-grams, so a text's logits are the mean over its n-grams of
idf times weight: they are gathered, never counted, and texts of any length take a block of memory at a time.

Edge cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing could be
learned; rows whose language, id or text is null aren't learned from; of languages that are equally likely the
first in the alphabet is taken; repeated rows give repeated results; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import table
from tracewell.llm.bpe import _bounded

#: Rows of each language that the weights are trained on at most, about; chosen by a hash of the id.
MAX_FIT = 1200
#: Characters that the weights are trained on at most, about, in equal shares for the languages.
FIT_CHARS = 64_000_000
#: log2 of the number of n-gram buckets.
BITS = 16
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
#: Follow-the-regularised-leader: rate, smoothing, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 1e-3, 1e-3, 2
#: One in so many rows of the sample is kept for the temperature.
CALIBRATE = 8
#: Characters that are turned into n-grams in one go.
BLOCK = 1_000_000

UNKNOWN = "und"


def learns_from(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Code points of a lower-cased text with blanks for what isn't a letter, and two blanks after it."""
    p = np.frombuffer((text.lower() + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[p], p, np.uint32(32))


def ngrams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that start at each character but the two blanks at the end, a size at a time."""
    n = len(points) - 2
    mixed = np.zeros(n, np.uint32)
    for size in SIZES:
        mixed = (mixed + points[size - 1 : size - 1 + n] + np.uint32(1)) * np.uint32(0x9E3779B1)
        yield (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)


def presence(texts: Iterator[str | None]) -> np.ndarray:
    """How many texts each bucket occurs in; the last entry counts the texts."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for text in texts:
        if text is None:
            continue
        seen = np.zeros(BUCKETS, bool)
        for a in range(0, max(1, len(text)), BLOCK):
            for h in ngrams(_points(text[a : a + BLOCK + 2])):
                seen[h] = True
        out[:-1] += seen
        out[-1] += 1
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # idf times weight: language by bucket
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """A row per text; texts are laid end to end in blocks, a long one over several."""
        out = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts))
        points: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def add() -> None:
            sizes = np.array([len(p) for p in points])
            starts = np.cumsum(sizes) - sizes
            joined = np.concatenate([*points])
            used = np.ones(len(joined), bool)
            # n-grams that start on the blanks after a text are none of its own.
            used[starts + sizes - 1] = False
            used[starts + sizes - 2] = False
            for h in ngrams(joined):
                own = used[: len(h)]
                for k, weights in enumerate(self.table):
                    sums = np.add.reduceat(np.where(own, weights[h], 0.0), np.minimum(starts, len(h) - 1), dtype=np.float64)
                    np.add.at(out[:, k], owner, sums)
            np.add.at(n, owner, (sizes - 2) * len(SIZES))

        for k, text in enumerate(texts):
            for a in range(0, max(1, len(text)), BLOCK):
                p = _points(text[a : a + BLOCK])
                if len(p) > 2:
                    points.append(p)
                    owner.append(k)
                    held += len(p)
                if held >= BLOCK:
                    add()
                    points, owner, held = [], [], 0
        if points:
            add()
        return out / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its calibrated probability."""
        letters = _letters()
        known = [k for k, t in enumerate(texts) if t and letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known and self.langs:
            z = self.logits([texts[k] for k in known]) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k, best, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                langs[k], scores[k] = self.langs[best], s
        return langs, scores


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for a in range(0, max(1, len(text)), BLOCK):
        for h in ngrams(_points(text[a : a + BLOCK])):
            total += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def train(sample: Iterable[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Weights by FTRL-proximal over documents (language, buckets, counts) in the given order, then the temperature."""
    sample = [x for x in sample if len(x[1])]
    names = sorted({lang for lang, *_ in sample})
    if not names:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    which = {v: k for k, v in enumerate(names)}
    # A constant feature last, for the bias.
    rows = [(np.append(at, BUCKETS), np.append(count / count.sum() * idf[at], 1.0), which[lang]) for lang, at, count in sample]
    held, used = rows[::CALIBRATE], [r for k, r in enumerate(rows) if k % CALIBRATE]
    if len(rows) < 4 * CALIBRATE:
        held = used = rows
    z = np.zeros((len(names), BUCKETS + 1))
    n = np.zeros((len(names), BUCKETS + 1))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, x, y in used:
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[:, at] = zs + g - sigma * w
            n[:, at] = ns + g * g
    w = weights(z, n)
    logits = np.array([w[:, at] @ x for at, x, _ in held])
    truth = np.array([y for *_, y in held])

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(s)), truth]).sum())

    grid = np.exp(np.linspace(math.log(0.05), math.log(20), 121))
    temperature = float(min(grid, key=loss)) if len(held) else 1.0
    return Model(names, (w[:, :BUCKETS] * idf).astype(np.float32), w[:, BUCKETS], temperature)


def document_frequencies(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """presence() over all rows of a DataFrame; each task sends its counts by bucket, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            total += presence(t.as_py() for t in batch.column(text_col))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    parts = rows.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in parts.collect():  # BUCKETS + 1 rows at most
        out[r["bucket"]] = r["n"]
    return out


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = MAX_FIT) -> Model:
    """The model from the rows that may be learned from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learns_from(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()  # a row for each language
    if not sizes:
        return train([], np.ones(BUCKETS))
    share = FIT_CHARS / len(sizes)
    rates = [(r["lang"], min(1.0, max_fit / r["n"], share / max(1, r["chars"]))) for r in sizes]
    rates = docs.sparkSession.createDataFrame(rates, "lang string, rate double")
    # Drawn by id and text, so that rows of one id aren't all in or out.
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select(F.xxhash64("doc_id", F.lit("order")).alias("place"), F.col("doc_id").cast("string").alias("id"), "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, n = counted(batch.column("text")[k].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("place", "id", "lang")), pa.array([at.astype("<u2").tobytes()]), pa.array([n.astype("<u4").tobytes()])], names=["place", "id", "lang", "at", "n"])

    found = sample.mapInArrow(run, "place long, id string, lang string, at binary, n binary").toPandas()
    found = found.sort_values(["place", "id", "at", "n"])
    counts = document_frequencies(rows)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    numbers = ((np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)) for at, n in zip(found["at"], found["n"], strict=True))
    return train(((lang, *x) for lang, x in zip(found["lang"].tolist(), numbers, strict=True)), idf)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns keep, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, "_text", 16 * BLOCK):
            langs, scores = [], []
            for a in range(0, batch.num_rows, 500):
                own = shared.value.predict(batch.column("_text").slice(a, 500).to_pylist())
                langs += own[0]
                scores += own[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_model(docs))
    return out.select("doc_id", (~F.coalesce(learns_from(F.col("doc_id")), F.lit(False))).alias("held_out"), "lang_pred", "score")
