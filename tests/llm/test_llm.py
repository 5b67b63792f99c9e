"""Training-data operators against brute force, round trips, held-out accuracy, and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, language_id, quality_rules, queries, secret_scan, similarity_join, suffix_dedup, token_codes, toxicity, warc
from tracewell.llm._shared import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.toPandas()


def odd(spark):
    """Nulls in any column, ties, repeated rows, empty and long texts."""
    long = " ".join(f"word{i % 700} the of" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", "one two", long, long, "Ünï çödé 漢字 😀 'tis don't", "a" * 5000, "token = abcdef123456 x", "same same same same", "same same same same"]
    data = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[5], (None, "no id at all", None, None, 1), (None, None, None, None, None)], DOCS)


def folder(spark, tmp_path, frame, **more):
    """A folder of tables, with further columns whose names clash with the operators' own."""
    for c in ("host", "words", "ids", "_base", "spans", "keys", "label", "did"):
        frame = frame.withColumn(c, F.lit(1))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    for k, v in more.items():
        v.write.parquet(str(tmp_path / f"{k}.parquet"))
    return str(tmp_path)


def ops():
    return {k: v for k, v in queries.queries().items() if k != "op5_warc"}


def others(spark):
    return {"benchmark": spark.createDataFrame([(0, "one two"), (1, None), (2, "")], "item_id long, text string"), "labels": spark.createDataFrame([(0, 1, 1), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"), "pages": spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u\r\nx", "y" * 200), (4, "v", "y" * 200), (None, "w", "y" * 200), (3, "u\r\nx", "y" * 200)], "page_id long, url string, html string")}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), odd(spark), **others(spark))


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), odd(spark).limit(0), **{k: v.limit(0) for k, v in others(spark).items()})


@pytest.mark.parametrize("name", sorted(ops()))
def test_odd_tables(spark, odd_dir, name):
    got = ops()[name](spark, odd_dir).collect()
    assert len(got) == 15 and sum(r.doc_id is None for r in got) == 2
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(tuple(r))
    if name != "op4_token_codes":
        assert by[5][0] == by[5][1]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert queries.queries()[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = queries.queries()[name](spark, small).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    key = got.columns[0]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    for c in want.columns:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


def test_host_verdicts(spark):
    bad, good = [(i, "x", "en", "bad", 1) for i in range(40)], [(100 + i, " ".join(f"w{j}" for j in range(60)), "en", "good", 1) for i in range(200)]
    mixed = [(900, good[0][1], "en", "bad", 1), (901, "x", "en", "good", 1), (902, good[0][1], "en", None, 1)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(bad + good + mixed, DOCS)).collect()}
    assert not got[900] and not got[901] and got[902] and got[100]


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = bpe.default_path()
    enc, lib = bpe.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "'ll", "12", "é", "漢", " ", "　", "😀", "!", "...", "<|endoftext|>", "<|", "|>", "́", "Don't", "_", "'S"]
    texts = ["".join(rng.choice(rng.sample(bits, rng.randint(1, 8))) for _ in range(rng.choice([3, 30, 150]))) for _ in range(300)]
    texts += ["a" * 3000, " " * 2000, "\n" * 999 + "x", "漢字" * 900, "!" * 1500 + "'s", "<|endoftext|>" * 90, ""]
    leaf = bpe.LEAF
    try:
        for bpe.LEAF in (10**9, 50, 333):
            for t, ids in zip(texts, enc.encode_texts(texts), strict=True):
                assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
                assert enc.decode(ids.tolist()) == lib.decode(ids.tolist(), skip_special_tokens=False)
    finally:
        bpe.LEAF = leaf


def test_bpe_digests_equal_library(spark, odd_dir, rows):
    """The query's columns, over a table of prose and over odd texts."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    frames = [spark.createDataFrame(list(zip(rows.doc_id.tolist(), rows.text, strict=True)), "doc_id long, text string"), spark.read.parquet(f"{odd_dir}/documents.parquet")]
    for df in frames:
        want = []
        for doc_id, text in (tuple(r) for r in df.select("doc_id", "text").collect()):
            ids = tok.encode(text or "", add_special_tokens=False).ids
            want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((tuple(r) for r in bpe.round_trip(df).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("part", [40, 3000])
def test_bpe_parts_in_tasks(spark, odd_dir, part):
    """Parts of one text encoded in several tasks, joins through special tokens and runs of blanks, repeated rows and null ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(11)
    bits = ["a", "the", " ", "  ", "\n", "'ll", "12", "é", "漢", "😀", "!", "<|endoftext|>", "Don't", " word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([5, 300, 4000]))) for _ in range(20)]
    texts += ["a" * 9000, " " * 7000 + "x", "<|endoftext|>" * 300, texts[3], None, ""]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20])] * 2 + [(21, texts[21])] * 2 + [(21, texts[20])]
    df = spark.createDataFrame(data, "doc_id long, text string").unionByName(spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text"))
    want, want_ids = [], []
    for doc_id, text in (tuple(r) for r in df.collect()):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        want_ids.append((doc_id, ids))
    got = bpe.round_trip(df, with_ids=True, long_bytes=200, part_chars=part).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want_ids, key=str)
    assert sorted(((r.doc_id, r.ids) for r in bpe.encode(df, long_bytes=200, part_chars=part).collect()), key=str) == sorted(want_ids, key=str)


def test_bpe_many_equal_long_rows(spark):
    """Equal rows over several steps of copies come back whole."""
    df = spark.range(9001).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three " * 20).alias("text"))
    got = bpe.round_trip(df, long_bytes=100, part_chars=60)
    assert got.count() == 9001 and got.distinct().count() == 1


def test_bpe_frames(spark, docs):
    coded = bpe.encode(docs)
    back = bpe.decode(coded).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("text = was").count() == docs.count()


def _repeats(texts):
    data = [t.encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, hot):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, tail = word(260), word(199)
    texts = [word(500), shared, word(90) + shared + word(70), shared[:230] + word(40), word(30) + shared[20:], tail + "x", tail + "y", "z" * 450, word(150) * 4, "", "short"]
    texts += [word(100) + shared + word(rng.randint(0, 50)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == _repeats(texts)


def test_suffix_dedup_small_table(spark, small, rows):
    got = suffix_dedup.op3_suffix_dedup(spark, small).toPandas().set_index("doc_id")
    want = _repeats(rows.text)
    assert [tuple(got.loc[i]) for i in rows.doc_id] == want


def _one_text(text, did):
    rec, _ = suffix_dedup.anchors([text.encode()])
    rec["did"] = rec["rid"] = did
    return rec


def test_suffixes_are_sorted():
    rng = random.Random(5)
    text = "".join(rng.choice("ab\0é") for _ in range(20_000))
    rec = suffix_dedup.suffix_sorted(_one_text(text, 1))
    data = text.encode()
    got = [data[a : a + suffix_dedup.GRAM] for a in rec["at"].tolist()]
    assert len(got) > 100 and got == sorted(got)


def test_merge_scan_by_small_blocks():
    """Whatever the blocks of the runs, the scan keeps one record of each beginning and reports what a plain count does."""
    rng = np.random.default_rng(2)
    rec = np.zeros(600, suffix_dedup._RECORD)
    rec["key"] = [b"%032d%08d" % (g, d) for g, d in zip(rng.integers(0, 90, 600), rng.integers(0, 4, 600), strict=True)]
    rec["did"] = np.arange(600)
    runs = []
    for k in range(3):
        own = suffix_dedup.suffix_sorted(rec[k::3])
        own["old"] = k == 2
        runs.append([own[i : i + 1 + 6 * k].copy() for i in range(0, len(own), 1 + 6 * k)])
    whole, part, kept = (np.concatenate(x) for x in zip(*suffix_dedup.merge_scan([iter(r) for r in runs]), strict=True))
    count = collections.Counter(rec["key"].tolist())
    kinds = collections.Counter(k[:32] for k in count)
    assert sorted(whole["did"]) == [i for i, k in enumerate(rec["key"].tolist()) if count[k] > 1]
    assert sorted(part["key"].tolist()) == sorted(k for k in count if kinds[k[:32]] > 1)
    young = {k[:32] for i, k in enumerate(rec["key"].tolist()) if i % 3 < 2}
    assert [k[:32] for k in kept["key"].tolist()] == sorted(young)


def test_matches_are_found_in_older_levels(spark):
    """Levels grow geometrically, and the last batch meets texts of the first one, which lies in an older level."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde ") for _ in range(6000)) for _ in range(8)]
    texts[6] = texts[6][:3000] + texts[0][:1000]
    work = Workspace(spark)
    index = suffix_dedup.SuffixIndex(work, 3)
    for k, text in enumerate(texts):
        rows = spark.createDataFrame([(k, k, text, 0)], "did long, rid long, text string, batch int").mapInArrow(suffix_dedup._find(3), suffix_dedup._ROW)
        got = index.add(rows, rows.count()).where("kind IN (1, 2)").select("did", "a", "b").collect()
        sizes = [x[0] for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        if k == 6:
            assert len(sizes) == 3, "the first text is in the oldest of three levels, which this batch was not merged with"
            assert {r.did for r in got} == {0, 6} and max(r.b for r in got if r.did == 0) <= 1200 and min(r.a for r in got if r.did == 6) >= 2800
        else:
            # The last merge brings the two texts' levels together, and may say so again.
            assert not {r.did for r in got} - ({0, 6} if k == 7 else set())
    assert len(index.levels) == 1
    files = [r.path for r in index.levels[0][1].collect()]
    level = [np.concatenate(list(suffix_dedup._read_level(f, False))) for f in files]
    assert sum(map(len, level)) == sizes[0] - len({r["key"][:32] for r in _one_text(texts[0], 0)} & {r["key"][:32] for r in _one_text(texts[6], 6)})
    assert all((x["key"][1:] >= x["key"][:-1]).all() for x in level)
    work.close()


def test_anchors_use_little_memory():
    import tracemalloc

    data = np.random.default_rng(1).integers(97, 123, suffix_dedup.BLOCK).astype(np.uint8).tobytes()
    tracemalloc.start()
    suffix_dedup.anchors([data])
    assert tracemalloc.get_traced_memory()[1] < 100 * suffix_dedup.BLOCK
    tracemalloc.stop()


def test_token_codes():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 50_257, 5000), rng.integers(0, 200, 700), rng.integers(0, 1 << 30, 3000), np.zeros(0, int), np.array([0])):
        levels = token_codes.Levels.build(ids.astype(np.uint32))
        shard = token_codes.Shard(token_codes.pack(levels, [None, 7], [0, len(ids)], 3))
        assert (shard.levels.decode() == ids).all() and shard.doc_ids == [None, 7] and shard.before == 3
        assert [shard.token(int(i)) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        shard.token(1)


def test_token_files(spark, small, rows, monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    monkeypatch.setattr(token_codes, "SHARD_TOKENS", 5000)
    got = token_codes.op4_token_codes(spark, small).toPandas().set_index("doc_id")
    at = 0
    for i, t in sorted(zip(rows.doc_id, rows.text, strict=True)):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got.loc[i])[:3] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_warc(spark, odd_dir, tmp_path):
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op5_warc(spark, odd_dir).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 200, "response", None), (3, 200, "response", None), (4, 200, "revisit", 3), (None, 200, "response", None)], key=str)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * (i % 50 + 1)) for i in range(300)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.plan_records(pages), root, frame_bytes=2000)
    assert index.select("bundle", "frame").distinct().count() > 20
    ((head, block),) = warc.parse_records(warc.read_record(index, root, 123))
    assert block.decode() == "<p>123</p>" * 24 and head["WARC-Target-URI"] == "u123" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"])
    read = warc.read_archives(index, root)
    assert read.withColumn("task", F.spark_partition_id()).select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.page_id for r in read.collect()) == list(range(300))
    assert warc.read_record(index, root, -1) is None
    import zstandard

    data = next((tmp_path / "w/data").glob("*.zst")).read_bytes()
    records = list(warc.parse_records(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()))
    assert [h["WARC-Type"] for h, _ in records].count("warcinfo") == 1 and records[0][0]["WARC-Type"] == "warcinfo" and all("WARC-Date" in h for h, _ in records)


def test_warc_long_payloads_and_further_columns(spark, tmp_path):
    text = "é" * 3_000_000
    pages = spark.createDataFrame([(1, None, text, "x", 1), (2, "u", text, None, 2), (3, "v", "\r\n\r\nWARC/1.1" * 20, "y", 3)], "page_id long, url string, html string, payload string, payload_digest int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in warc.op5_warc(spark, str(tmp_path), f"file://{tmp_path}/kept").collect()}
    assert [(got[k].payload_bytes, got[k].record_type, got[k].refers_to) for k in (1, 2, 3)] == [(6_000_000, "response", None), (6_000_000, "revisit", 1), (240, "response", None)]
    assert got[1].payload_digest == hashlib.sha256(text.encode()).hexdigest()
    assert list((tmp_path / "kept/data").glob("*.warc.zst"))


def _segments(s):
    """Maximal segments by definition: the best one, then those left and right of it."""
    best = None
    for i in range(len(s)):
        t = 0.0
        for j in range(i, len(s)):
            t += s[j]
            if t > 0 and (best is None or t > best[0] + 1e-12):
                best = (t, i, j + 1)
    return [] if best is None else [*_segments(s[: best[1]]), best[1:], *((a + best[2], b + best[2]) for a, b in _segments(s[best[2] :]))]


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.choice([-2.5, -1.2, -0.7, 0.3, 1.1]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        assert [x[:2] for x in toxicity.maximal_segments(s)] == _segments(s)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95


def test_toxicity_of_one_class(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["a b", None, "", "c"] * 5)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(20)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    assert toxicity.score_documents(docs, toxicity.fit_model(docs, labels)).where("score <> 0").count() == 0


def test_toxicity_scores_by_hand(spark, small, docs, rows):
    """Scores of the query's model from the definition of maximal segments and the formulas, over whole texts."""
    model = toxicity.fit_model(docs, spark.read.parquet(f"{small}/labels.parquet"))
    got = toxicity.score_documents(docs, model).toPandas().set_index("doc_id").score
    for doc_id, text in zip(rows.doc_id, rows.text, strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if len(words) > 400:
            continue
        s = [max([model.weights.get(f, -toxicity.DRIFT) for f in [w, *(w[:n] + "*" for n in toxicity.STEMS if len(w) > n)]]) for w in words]
        found = [(sum(s[a:b]), model.k * len(words) * math.exp(-model.scale * sum(s[a:b]))) for a, b in _segments(s)]
        strong = [-math.log(max(e, 1e-300)) for _, e in found if e <= toxicity.E_MAX]
        x = [1.0, math.log1p(max([0.0, *(v for v, _ in found)])), math.log1p(sum(strong)), math.log1p(len(strong)), math.log1p(len(words))]
        assert math.isclose(got[doc_id], 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.curve, x, strict=True)))), rel_tol=1e-6, abs_tol=1e-9), doc_id


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def _leaks(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(_lower(t))
        for k in range(max(min(1, len(w)), len(w) - 9)):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = WORD.findall(_lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 12, 30])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(11)
    texts = [" ".join(rng.choice("a b c D Éa x".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "solo", "q a b"]
    items = [(i, " ".join(rng.choice("a b c d Éa".split()) for _ in range(rng.randint(0, 13)))) for i in range(40)] + [(40, texts[0]), (41, None), (42, "solo!")]
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.find_leaks(df, bench).collect()}
    assert [got[i] for i in range(len(texts))] == _leaks(texts, items)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and decontaminate.find_leaks(clean, bench).where("contaminated").count() == 0


def test_benchmark_of_many_blocks_is_held_one_at_a_time(spark):
    """A benchmark of one long item and many short ones: no block has more words than it may, and one is cached."""
    items = [("a", " ".join(f"w{i}" for i in range(5000))), *((f"b{k}", f"x{k} y{k} z{k}") for k in range(300)), (None, "no id here")]
    blocks = decontaminate.phrase_blocks(spark.createDataFrame(items, "item_id string, text string"), block=100)
    assert len(blocks) > 50
    sizes = []
    for path in blocks:
        block = decontaminate._block(path)
        sizes.append(len(block.vocabulary))
        assert decontaminate._block.cache_info().currsize == 1
    assert max(sizes) <= 100
    split = [t or "" for t in ["w41 " + " ".join(f"w{i}" for i in range(95, 110)) + " x7 y7 z7 no id here", None]]
    _, hits, found = decontaminate._hits(blocks, split)
    assert hits[0].tolist() == [False] + [True] * 21 and found == [{"a", "b7", ""}, set()]


def test_decontamination_small_table(spark, small, rows):
    got = decontaminate.op7_decontaminate(spark, small).toPandas().set_index("doc_id")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [tuple(got.loc[i]) for i in rows.doc_id] == _leaks(rows.text, items)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def _secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def test_secrets(spark, rows):
    rng = random.Random(13)
    bits = ["token", "API_KEY", "apikey", " ", "=", ": ", '"', "abc123", "secret=short", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3, "é😀", "passwd:", "x.y/z", "KEY"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", *rows.text[:50]]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = _secrets(t)
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def _suspects(t):
    """Entropy spans from their definition: every window of every candidate is looked at anew."""
    out, base = [], _secrets(t)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
        hit = m.group()
        if any(a < m.end() and m.start() < b for a, _, b in base) or any(re.search(x, hit) for x in secret_scan.ALLOW):
            continue
        left = re.sub(secret_scan.UUID, " ", hit)
        if re.search(secret_scan.PATH, hit):
            left = re.sub(secret_scan.SEGMENT, " ", left)
        for part in left.split(" "):
            for w in (part[k : k + 20] for k in range(len(part) - 19)):
                if not re.search("[0-9]", w) or not re.search("[A-Za-z]", w):
                    continue
                kind = "base64" if re.search("[+/_=-]", w) else "hex" if not re.search("[g-zG-Z]", w) else "alnum" if re.search("[a-z]", w) and re.search("[A-Z]", w) else "one case"
                if -sum(n / 20 * math.log2(n / 20) for n in collections.Counter(w).values()) >= secret_scan.LIMITS[kind] - 1e-9:
                    out.append((m.start(), 3, m.end()))
                    break
            else:
                continue
            break
    return out


def test_many_spans_of_one_text(spark):
    """A text of 60,000 matches: their places come from sums by block, not from appending to all that went before."""
    text = "é token=abc123 " * 60_000
    (r,) = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_assign == 60_000
    assert r.spans == ",".join(f"assign:{15 * k + 2}:{15 * k + 14}" for k in range(60_000))


def test_all_spans(spark, rows):
    """The query's spans against brute force: candidates, classes, limits, allow-list and overlaps together."""
    rng = random.Random(29)
    letters = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789", "aab1"]
    bits = [lambda: "".join(rng.choices(rng.choice(letters), k=rng.randint(5, 45)))] * 4
    bits += [lambda: rng.choice(["/v1/keys/", "com/some/path/", "0123abcd-12ab-12ab-12ab-0123456789ab", "EXAMPLE", "xxxx", "1234567", "-", "_", "=", " ", " ", "é", "token=", "AKIA"])] * 3
    texts = ["".join(rng.choice(bits)() for _ in range(rng.randint(1, 8))) for _ in range(600)] + [None, "", *rows.text]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = [",".join(f"{secret_scan._KINDS[k]}:{a}:{b}" for a, k, b in sorted(_secrets(t) + _suspects(t))) for t in texts]
    assert [got[i] for i in range(len(texts))] == want and sum("entropy" in w for w in want) > 100


def test_entropy(spark):
    def peak(s, w=20):
        h = lambda x: -sum(c / w * math.log2(c / w) for c in collections.Counter(x).values())
        return max([0.0, *(h(s[i : i + w]) for i in range(len(s) - w + 1))])

    texts = ["aB3dE5gH7jK9mN1pQ2rS", "a" * 30, "ab" * 20, "abcdefghijklmnopqrst" + "a" * 20, "short", "x9Kq2LmZ8wTr5VbN1cYd7Hf3Gs"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "s string").select(secret_scan.peak_entropy(F.col("s")).alias("p")).collect()]
    assert got == pytest.approx([peak(t) for t in texts])
    df = spark.createDataFrame([(0, "key x9Kq2LmZ8wTr5VbN1cYd7Hf3Gs end"), (1, "id 123e4567-e89b-12d3-a456-426614174000"), (2, "internationalization of responsibilities"), (3, "a path/to/some/file2/of/mine")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secret_scan.scan(df).collect()} == {0: "entropy:4:30", 1: "", 2: "", 3: ""}
    assert secret_scan.redact(df.withColumn("_base", F.lit(1))).orderBy("doc_id").first().text == "key [SECRET] end"


def _spared(spark, keys):
    """The share of the keys that no entropy span covers."""
    df = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys)], "doc_id long, text string")
    return secret_scan.scan(df).where("spans NOT LIKE '%entropy%'").count() / len(keys)


def _keys(rng, chars, n, before="", k=400):
    """Random keys with a digit; without one they are taken for words."""
    return [before + w for w in ("".join(rng.choices(chars, k=n)) for _ in range(k)) if re.search("[0-9]", w)]


LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@pytest.mark.parametrize(
    ("chars", "n", "before"),
    [(DIGITS + UP[:6], 32, "ID-"), (DIGITS + UP[:6], 40, "SN_"), (DIGITS + LOW, 24, "sk_live_"), (DIGITS + LOW, 20, ""), (DIGITS + UP, 32, ""), (DIGITS + LOW + UP, 24, "id="), (DIGITS + LOW + UP + "-_", 40, "")],
)
def test_random_keys(spark, chars, n, before):
    # 20-character keys have one window only, and one in a hundred is under its limit.
    assert _spared(spark, _keys(random.Random(17), chars, n, before)) < (0.03 if n == 20 else 0.015)


def test_windows_of_one_kind(spark):
    """Words and numbers on either side of a sign are no keys."""
    assert _spared(spark, ["invoice-2000003333444455", "internationalization_of_2", "0" * 30 + "a", "9021090210-9021090211-x", "abcabcabcabcabcabcabc1"]) == 1


@pytest.mark.parametrize(("n", "before", "after"), [(40, "/v1/keys/", ""), (40, "com/v1/keys/", "/versions/2"), (40, "xxxx", ""), (40, "", "-1234567-x"), (40, "example-", ""), (64, "", "="), (40, "", "")])
def test_keys_in_paths(spark, n, before, after):
    signs = "" if before or after and n == 40 else "+/"
    assert _spared(spark, [k + after for k in _keys(random.Random(19), DIGITS + LOW + UP + signs, n, before)]) < 0.015


def test_allowed(spark):
    known = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "1234567890abcdefghij", "example-key-1234567890-xxxxxxxx", "/usr/share/doc/2024-report_v2/MyFileName3", "src/main/java/com/acme2/util/StringHelper"]
    ids = ["123e4567-e89b-12d3-a456-426614174000", "/users/123e4567-e89b-12d3-a456-426614174000/profile", "id_9f1c2b7e-05d4-4a86-b3e9-7c60d8f52a1b"]
    assert _spared(spark, known + ids) == 1
    long = ["=" * 30_000, "a1/" * 10_000, "1234567-" * 4_000, "/x/" + "ab-" * 10_000, "/x/y/" + "Abc" * 10_000]
    assert _spared(spark, long) == 1


def _groups(texts, n, percent):
    def shingles(t):
        w = [x for x in re.split(r"[ \t-\r]+", _lower(t)) if x]
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(a), root(i)) for i, a in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent", "cell", "crowd"), [(3, 90, 4000, 50_000), (3, 90, 7, 2), (5, 80, 3, 50_000), (5, 80, 30, 1)])
def test_similarity_join(spark, monkeypatch, n, percent, cell, crowd):
    if crowd == 2:
        monkeypatch.setattr(similarity_join, "BUCKETS", 64)
    rng = random.Random(17)
    texts = [None, "", "one", "one two", "One  two"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 12, 40, 150]))]
        for _ in range(8):
            own = base[:]
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 400)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in similarity_join.link_components(df, n=n, percent=percent, cell=cell, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == _groups(texts, n, percent)
    kept = {r.doc_id for r in similarity_join.deduplicate(df, n=n, percent=percent).collect()}
    assert kept == {c for _, c in got.values()}


@pytest.mark.parametrize("n_family", [3, 40])
def test_similarity_join_texts_of_one_id(spark, n_family):
    """Rows of one id with different texts are one node, whichever of them is linked."""
    rng = random.Random(23)
    small, *large = ([f"{c}{rng.randint(0, 10**6)}" for _ in range(k)] for c, k in (("s", 60), *[("l", 800)] * 8))

    def near(base, k):
        own = base[:]
        for i in rng.sample(range(len(own)), k):
            own[i] = f"new{rng.randint(0, 10**6)}"
        return " ".join(own)

    rows = [(i, near(small, 1)) for i in range(n_family)]
    for j, base in enumerate(large):
        rows += [(500 + j, near(base, 3)), (500 + j, near(small, 1)), (600 + j, near(base, 3))]
    rows += [(700, "a b c d e f"), (701, "a b c d e f"), (701, "g h i j k l"), (702, "g h i j k l m n o p"), (703, "q r s t u v"), (703, "w x y z")]
    want, groups = {i: i for i, _ in rows}, _groups([t for _, t in rows], 5, 80)
    for _ in rows:
        for (i, _), (_, c) in zip(rows, groups, strict=True):
            a, b = want[i], want[rows[c][0]]
            want = {k: min(a, b) if v in (a, b) else v for k, v in want.items()}
    got = similarity_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80).collect()
    assert sorted((r.id, r.component_id) for r in got) == sorted((i, want[i]) for i, _ in rows)


def test_similarity_join_small_table(spark, small, rows):
    rows = rows.sort_values("doc_id").reset_index(drop=True)
    got = similarity_join.op9_similarity_join(spark, small).toPandas().set_index("doc_id")
    assert [tuple(got.loc[i]) for i in rows.doc_id] == [(n, rows.doc_id[c]) for n, c in _groups(rows.text, 3, 90)]


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, few):
    rng = random.Random(19)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 540)] + [(900, 900 + i) for i in range(30)]
    forest = similarity_join.Forest()
    for a, b in edges:
        forest.join(a, b)
    got = similarity_join.components(spark.createDataFrame(edges, "u long, v long"), few=few)
    assert sorted(map(tuple, got.collect())) == sorted(forest.edges())


def test_languages_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op10_language_id(spark, d).toPandas().merge(spark.read.parquet(f"{d}/documents.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and (held.lang_pred == held.lang).mean() > 0.97
    model = language_id.train([("de", *language_id.counted("der die das und")), ("en", *language_id.counted("the and of to"))] * 200, np.ones(language_id.BUCKETS))
    langs, scores = model.predict(["THE of 12", None, "", "123 !?", "und das " * 400_000])
    assert langs == ["en", "und", "und", "und", "de"] and scores[1:4] == [0, 0, 0]


def test_every_language_is_learned(spark):
    """201 languages, each of letters of its own; the 101 rarer ones have half the rows and must not be given up for the others."""
    rng = random.Random(8)
    rows = []
    for k in range(201):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        rows += [(f"l{k:03d}", "".join(rng.choices(letters, k=60))) for _ in range(24 if k < 100 else 12)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.fit_model(df)
    learned = {r.lang for r in df.where(language_id.learns_from(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(model.langs) == learned and len(learned) == 201
    got = language_id.identify(df, model, ("doc_id", "lang")).toPandas()
    rare = got[got.lang >= "l100"]
    assert (rare.lang_pred == rare.lang).mean() > 0.9


def test_language_scores_by_hand(spark, docs, rows):
    """Scores of the query's model from the formula, n-gram by n-gram, over whole texts."""
    model = language_id.fit_model(docs)
    got = language_id.identify(docs, model).toPandas().set_index("doc_id")
    for doc_id, text in list(zip(rows.doc_id, rows.text, strict=True))[:60]:
        points = [ord(c) if c.isalpha() else 32 for c in text.lower()] + [32, 32]
        z = np.array(model.bias, float)
        for k in range(len(points) - 2):
            h = 0
            for size in range(3):
                h = (h + points[k + size] + 1) * 0x9E3779B1 % 2**32
                bucket = ((h ^ h >> 15) * 0x85EBCA77 % 2**32) >> 16
                z = z + model.table[:, bucket] / (3 * (len(points) - 2))
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        assert got.lang_pred[doc_id] == model.langs[p.argmax()] and math.isclose(got.score[doc_id], p.max(), rel_tol=1e-4), doc_id


def _without_leaks(t, items):
    """t with the spans of hit words cut out until nothing is left to hit."""
    while True:
        w = [(m.start(), m.end()) for m in WORD.finditer(_lower(t))]
        low = [_lower(t[a:b]) for a, b in w]
        hit = [False] * len(w)
        for _, item in items:
            own = WORD.findall(_lower(item or ""))
            for k in range(max(min(1, len(own)), len(own) - 9)):
                window = own[k : k + 10]
                for j in range(len(low) - len(window) + 1):
                    if low[j : j + len(window)] == window:
                        hit[j : j + len(window)] = [True] * len(window)
        if not any(hit):
            return t
        out, at, k = [], 0, 0
        while k < len(w):
            if hit[k]:
                out.append(t[at : w[k][0]])
                while k < len(w) and hit[k]:
                    at = w[k][1]
                    k += 1
            else:
                k += 1
        t = "".join(out) + t[at:]


def _masked(t):
    out, at = [], 0
    for a, _, b in sorted(_secrets(t) + _suspects(t)):
        if a >= at:
            out += [t[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def test_pipeline_row_by_row(spark, small, docs, rows):
    """run() against the stages in plain Python; only the toxicity scores are taken from the fitted model."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    model = toxicity.fit_model(docs, spark.read.parquet(f"{small}/labels.parquet"))
    score = toxicity.score_documents(docs, model).toPandas().set_index("doc_id").score
    left = [(i, t) for i, t in sorted(zip(rows.doc_id, rows.text, strict=True)) if score[i] < 0.5]
    first = {}
    for (i, t), (_, c) in zip(left, _groups([t for _, t in left], 5, 80), strict=True):
        first.setdefault(c, (i, t))
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    tok = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, t in first.values():
        clean = _masked(_without_leaks(t, items))
        ids = tok.encode(clean, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, small).collect()}
    assert got == want and 100 < len(want) < len(left) <= len(rows)


def test_pipeline(spark, small, odd_dir, empty_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    last = docs
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, last, small).cache()
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 1:
            assert {r.doc_id for r in out.collect()} == {last_ids[c] for _, c in _groups(last_texts, 5, 80)}
        if k == 3:
            assert secret_scan.scan(out).where("n_access + n_hex > 0").count() == 0
        last = out
        if k < 4:
            pairs = sorted((r.doc_id, r.text) for r in out.collect())
            last_ids, last_texts = [i for i, _ in pairs], [t for _, t in pairs]
    assert last.count() == len(pairs) > 100
    assert p.run(spark, empty_dir).count() == 0
    assert p.run(spark, odd_dir).count() > 5
