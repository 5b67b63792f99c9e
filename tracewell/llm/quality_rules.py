"""Quality rules: document rules, failure rates of hosts shrunk by an empirical beta prior, verdicts joined back.

Only DataFrame functions run on the main path. A text is one row throughout, so nothing is exploded or
shuffled but a few numbers a document; hosts are pre-aggregated before their shuffle.

Edge cases: a null or empty text has no words and fails the rules; a null host is a host of its own, never
rejected as a host; repeated rows count once each; an empty table gives an empty result; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import spread_join, staged, table

#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength in pseudo-documents.
PRIOR_STRENGTH = (2.0, 1000.0)

_SPACE = r"[ \t-\r]"


def _tri_hash(words: str) -> Column:
    """64-bit hash of every window of three words; null where there is none."""
    w = F.col(words)
    return F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
    )


def _covered(positions: Column) -> Column:
    """Words covered by windows of three that start at the given ascending positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p"))
    return F.aggregate(
        positions,
        start,
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["p"])).alias("n"), x.alias("p")),
        lambda a: a["n"],
    )


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: counts, base_failed and the host."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    a = base.select(
        "doc_id",
        "host",
        F.array_remove(F.split("text", f"{_SPACE}+"), "").alias("words"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.length(F.regexp_replace("text", f"{_SPACE}+", "")).cast("long").alias("word_chars"),
    )
    b = a.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _tri_hash("words").alias("h"),
    )
    # Equal windows are neighbours once sorted; the rest is linear.
    c = b.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    ).drop("h")
    s = F.col("s")
    again = F.filter(
        s,
        lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
    )
    d = c.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(_covered(F.array_sort(F.transform(again, lambda x: x["p"]))), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, the rate shrunk by a beta prior fitted to all hosts, the verdict.

    The prior's mean is the overall rate; its strength comes from the hosts' weighted variance less what
    binomial sampling explains (method of moments). Three sums are all that reaches the driver.
    """
    hosts = rules.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = staged(hosts, "hosts")
    r = F.col("n_failed") / F.col("n_docs")
    one = hosts.agg(
        F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_docs") * r * r).alias("sq")
    ).first()
    n, f, k = one["n"] or 0, one["f"] or 0, one["k"] or 0
    mean = f / n if n else 0.0
    low, high = PRIOR_STRENGTH
    spread = mean * (1 - mean)
    between = (one["sq"] / n - mean * mean - spread * k / n) if n else 0.0
    strength = min(high, max(low, spread / between - 1)) if between > 0 else high
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_failed", F.col("host_rate") > F.lit(max_rate))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document its counts, base_failed, host_rate and kept (neither it nor its host failed)."""
    rules = staged(document_rules(docs, id_col, text_col, host_col), "rules")
    verdicts = host_verdicts(rules).select("host", "host_rate", "host_failed")
    out = spread_join(rules, verdicts, "host", "doc_id")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).drop("host_failed")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM t),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
a AS (SELECT w.doc_id, source, len(ws) AS n_words,
        coalesce(list_sum([length(x) FOR x IN ws]), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS k, sum(n * (f / n) * (f / n)) / sum(n) AS sq FROM h),
p AS (SELECT mean, CASE WHEN sq - mean * mean - mean * (1 - mean) * k / n > 0
        THEN least(1000, greatest(2, mean * (1 - mean) / (sq - mean * mean - mean * (1 - mean) * k / n) - 1)) ELSE 1000 END AS s FROM m),
v AS (SELECT source, (f + mean * s) / (n + s) > 0.5 AS bad FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, FALSE) AS kept
FROM b LEFT JOIN v USING (source)
"""
