"""Toxicity by maximum-scoring segments.

Fit, on a bounded sample of labelled documents, by Spark jobs of which the driver sees features, not texts: log-odds
of words and of word beginnings between the two classes, with a Dirichlet prior from the pooled counts. Two
departures from taking every word's log-odds: a feature counts only if its documents are too many for chance, and
every other word costs the same, DRIFT. lambda and K of the extreme-value law of segment scores come from the clean
documents, and a logistic curve turns a document's aggregated evidence into a probability.

Score (tasks, whole texts): one linear scan finds all maximal scoring segments (disjoint, none extendable).
Each has an E-value K n exp(-lambda S); a document is scored on its best segment, on the sum over its
significant ones, and on how many there are.

Edge cases: a null or empty text has no segments and scores as such; documents whose label or id is null are not
fitted on; several labels of a document count as their largest; without both classes in the labels every score is
0; repeated rows give repeated results; an empty table gives an empty result; further columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import Workspace, lean, table
from tracewell.llm.bpe import _bounded

#: Labelled rows of each class, and characters of them, that the model is fitted on at most, about; drawn by hash.
MAX_FIT, FIT_CHARS = 3000, 32_000_000
#: Tasks that the sample is dealt to.
FIT_TASKS = 32
#: Weight of the prior in pseudo-words.
PRIOR = 50.0
#: Log-likelihood ratio from which a feature counts, before the share for the number of features tried.
SURPRISE = 6.0
#: Documents a feature must occur in.
MIN_DOCS = 3
#: What any other word costs a segment.
DRIFT = 0.05
#: Lengths of the word beginnings that stand in for words never seen.
STEMS = (4, 5, 6)
#: E-value up to which a segment is significant.
E_MAX = 0.05

_WORD = re.compile(r"[^\W\d_]+")


def learns_from(doc_id: Column) -> Column:
    """Rows that models may be fitted on; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of a sequence, in one linear pass.

    Candidates are kept with the cumulative scores left and right of them; the nearest candidate with a lower
    left sum is found by links, so that each is visited a bounded number of times overall.
    """
    found: list[list] = []  # start, stop, left sum, right sum
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new_link = j
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
        found.append([*new, new_link])
    return [(a, b, right - left) for a, b, left, right, _ in found]


@dataclass
class Model:
    """Weights of features, the extreme-value law, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    k: float = 0.1
    curve: list[float] | None = None
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        s = self._memo.get(word)
        if s is None:
            if len(self._memo) > 100_000:
                self._memo.clear()
            get = self.weights.get
            s = self._memo[word] = max((get(f, -DRIFT) for f in _features(word)), default=-DRIFT)
        return s

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(start, stop, score, E-value) of each maximal segment; runs of words that only cost are taken as one."""
        scored = np.fromiter(map(self.word_score, words), np.float64, len(words))
        up = np.flatnonzero(scored > 0)
        if not len(up):
            return []
        # Words that score, and between them one step for all the words that cost.
        gaps = np.diff(up) - 1
        steps, at = [], []
        for k, i in enumerate(up.tolist()):
            steps.append(float(scored[i]))
            at.append(i)
            if k < len(gaps) and gaps[k]:
                steps.append(-DRIFT * float(gaps[k]))
                at.append(i + 1)
        n = len(words)
        return [(at[a], at[b - 1] + 1, s, self.k * n * math.exp(-self.scale * s)) for a, b, s in maximal_segments(steps)]

    def evidence(self, words: list[str]) -> list[float]:
        """What the curve is fitted on: the best segment, the sum over significant ones, their number, the length."""
        found = self.segments(words)
        if not found:
            return [0.0, 0.0, 0.0, math.log1p(len(words))]
        bits = [-math.log(max(e, 1e-300)) for *_, e in found]
        strong = [b for b, (*_, e) in zip(bits, found, strict=True) if e <= E_MAX]
        return [math.log1p(max(0.0, max(s for _, _, s, _ in found))), math.log1p(sum(strong)), math.log1p(len(strong)), math.log1p(len(words))]

    def score(self, words: list[str]) -> float:
        if self.curve is None:
            return 0.0
        x = self.curve[0] + sum(w * v for w, v in zip(self.curve[1:], self.evidence(words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _law(model: Model, scores: Counter) -> float:
    """lambda with E[exp(lambda s)] = 1 over the scores of clean words."""
    total = sum(scores.values()) or 1
    # Weights that clean words never showed keep a small probability.
    p = {s: n / total for s, n in scores.items()}
    for s in set(model.weights.values()):
        p.setdefault(s, 0.1 / total)
    mean = lambda x: sum(q * math.exp(min(500.0, x * s)) for s, q in p.items())
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic curve, intercept first, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.append(0, w[1:])
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _sketch(words: list[str]) -> list[int]:
    """Four numbers, each from the lowest hashes in three of twelve classes of 3-word shingles."""
    hashes = np.array([hash_of(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    low = np.full(12, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, (hashes % np.uint64(12)).astype(np.int64), hashes)
    return [hash_of(f"{k}:{low[k : k + 3].tolist()}") >> 1 for k in range(0, 12, 3)]


def _copies(found: list[tuple[int, int, list[int]]]) -> set[int]:
    """Keys of documents (key, label, sketch) of which another of the class agrees in a number of the sketch."""
    seen: set[tuple[int, int]] = set()
    out = set()
    for key, label, sketch in sorted(found):
        own = {(label, x) for x in sketch}
        if own & seen:
            out.add(key)
        else:
            seen |= own
    return out


def _surprise(k1: int, n1: int, k0: int, n0: int) -> float:
    """Log-likelihood ratio of a feature that k1 of n1 and k0 of n0 documents have."""
    both = (k1 + k0) / (n1 + n0)
    part = lambda k, n: sum(o * math.log(o / e) for o, e in ((k, n * both), (n - k, n * (1 - both))) if o)
    return 2 * (part(k1, n1) + part(k0, n0))


def _weigh(rows: list[tuple[str, int, int, int, int]], n: list[int], n_docs: list[int], n_features: int) -> dict[str, float]:
    """Weights from (feature, its words and documents among clean ones, among toxic ones) and the totals of both."""
    # Many features are tried, so chance finds grow with their number; the bar grows with its logarithm.
    bar = SURPRISE + 2 * math.log(max(2, n_features))
    out = {}
    for f, c0, d0, c1, d1 in rows:
        a = PRIOR * (c0 + c1) / sum(n)
        up, down = c1 + a, c0 + a
        delta = math.log(up / max(1e-9, n[1] + PRIOR - up)) - math.log(down / max(1e-9, n[0] + PRIOR - down))
        if delta > 1.0 and _surprise(d1, n_docs[1], d0, n_docs[0]) >= bar:
            out[f] = min(delta, 12.0)
    return out


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_fit: int) -> DataFrame:
    """key, label, text of about max_fit rows and FIT_CHARS / 2 characters of each class at most; equal texts of a class are one."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learns_from(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    texts = docs.where(learns_from(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.select("doc_id", F.length("text").alias("chars")).join(known, "doc_id")
    rates = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    rates = rates.select("label", F.least(F.lit(1.0), F.lit(float(max_fit)) / F.col("n"), F.lit(FIT_CHARS / 2) / F.greatest(F.lit(1), "chars")).alias("rate"))
    rates = {r["label"]: r["rate"] for r in rates.collect()}  # two rows
    # Drawn by id and text, so that rows of one id aren't all in or out; ids are drawn first, so few labels are joined.
    by_id = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = F.when(F.col("label") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    drawn = texts.join(F.broadcast(known.where(by_id < 2 * rate)), "doc_id")  # 4 * max_fit ids at most, about
    by_row = F.pmod(F.xxhash64("doc_id", "text", F.lit("row")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = drawn.where(by_row < F.greatest(F.lit(0.5), rate)).select(F.xxhash64("text").alias("key"), "label", "text")
    return drawn.dropDuplicates(["key", "label"])


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """Fit on a bounded sample of the labelled rows; held-out rows are left alone."""
    spark = docs.sparkSession
    work = Workspace(spark)
    sample = work.put(_sample(docs, labels, id_col, text_col, label_col, max_fit).repartition(FIT_TASKS, "key"), "toxic-sample")
    model = Model()

    def rows_of(run, schema: str) -> DataFrame:
        """What run makes of the sample's (key, label, words); the sample is bounded, and so is this."""

        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = ((k, y, tokens(t)) for b in _bounded(found, "text", 2_000_000) for k, y, t in zip(*(b.column(c).to_pylist() for c in ("key", "label", "text")), strict=True))
            out = list(run(each))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        return sample.select("key", "label", "text").mapInArrow(lean(batches), schema)

    found = rows_of(lambda docs: ((k, y, _sketch(w)) for k, y, w in docs), "key long, label long, sketch array<bigint>")
    found = [(r["key"], r["label"], r["sketch"]) for r in found.collect()]
    out = _copies(found)
    n_docs = [sum(y == c and k not in out for k, y, _ in found) for c in (0, 1)]
    if not all(n_docs):
        work.close()
        return model

    def count(docs: Iterator[tuple[int, int, list[str]]]) -> Iterator[tuple]:
        total: dict[str, list[int]] = {}
        for key, label, words in docs:
            if key not in out:
                own: Counter = Counter()
                for w, n in Counter(words).items():
                    for f in _features(w):
                        own[f] += n
                for f, n in own.items():
                    x = total.setdefault(f, [0, 0, 0, 0])
                    x[2 * label] += n
                    x[2 * label + 1] += 1
                x = total.setdefault("", [0, 0, 0, 0])
                x[2 * label] += len(words)
        return ((f, *x) for f, x in total.items())

    counts = rows_of(count, "feature string, c0 long, d0 long, c1 long, d1 long")
    counts = work.put(counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("c0", "d0", "c1", "d1"))), "toxic-features")
    n = next(([r["c0"], r["c1"]] for r in counts.where("feature = ''").collect()), [0, 0])
    n_features = counts.where("feature <> '' AND d1 > 0").count()
    model.weights = _weigh([tuple(r) for r in counts.where(f"feature <> '' AND d1 >= {MIN_DOCS} AND c1 * {n[0]} > c0 * {n[1]}").orderBy("feature").collect()], n, n_docs, n_features)

    floor = 2.0

    def clean(docs: Iterator[tuple[int, int, list[str]]]) -> Iterator[tuple]:
        scores: Counter = Counter()
        seen: Counter = Counter()
        for key, label, words in docs:
            if key not in out and not label:
                scores.update(map(model.word_score, words))
                seen["segments"] += sum(s >= floor for _, _, s, _ in model.segments(words))
        yield from (("score", s, n) for s, n in scores.items())
        yield from (("segments", 0.0, n) for n in seen.values())

    law = rows_of(clean, "what string, score double, n long").groupBy("what", "score").agg(F.sum("n").alias("n")).collect()
    scores = Counter({r["score"]: r["n"] for r in sorted(law) if r["what"] == "score"})
    model.scale = _law(model, scores)
    seen = 1.0 + sum(r["n"] for r in law if r["what"] == "segments")
    model.k = min(1.0, max(1e-4, seen / (1.0 + sum(scores.values()) * math.exp(-model.scale * floor))))
    evidence = rows_of(lambda docs: ((k, y, model.evidence(w)) for k, y, w in docs if k not in out), "key long, label long, evidence array<double>").collect()
    evidence = sorted((r["key"], r["label"], r["evidence"]) for r in evidence)
    model.curve = _logistic(np.array([x for *_, x in evidence]), np.array([y for _, y, _ in evidence], float))
    model._memo.clear()
    work.close()
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a probability in a new column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Built field by field: DataFrame.schema is cached, and StructType.add would change it.
    schema = type(docs.schema)([*docs.schema.fields]).add(out_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in _bounded(batches, text_col, 2_000_000):
            scores = [own.score(tokens(t.as_py())) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """docs without those that score cut or more; columns and other rows as they are."""
    model = fit_model(docs, labels, id_col, text_col)
    name = "_toxic_score"
    while name in docs.columns:
        name += "_"
    return score_documents(docs, model, text_col, name).where(F.col(name) < F.lit(cut)).drop(name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs.select("doc_id", "text"), model)
    held = ~F.coalesce(learns_from(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
