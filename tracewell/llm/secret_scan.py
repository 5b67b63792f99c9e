"""Secret scans: three fixed patterns, and strings with a sliding window whose entropy is high for the
window's character class.

Only DataFrame functions run on the main path, and no row is shuffled. Places come from cutting a text at a
pattern: what lies between the matches and the matches themselves, in turn, make up the text. Only texts that
hold a match are cut.

Edge cases: a null text counts as empty, an empty text has no spans; spans of one kind never overlap, those of
different kinds may; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import table

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What may be a secret at all: long runs of the characters that keys are written with.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters in the window over which entropy is taken.
WINDOW = 20
#: Entropy in bits from which a window of a class is suspect, from the narrowest class up; 99 of 100 random windows
#: of 16, 36, 62 and 64 characters reach it. A window without a letter or without a digit is in no class.
LIMITS = {"hex": 2.9, "one case": 3.4, "alnum": 3.64, "base64": 3.64}
#: Groups repeat possessively, which takes no stack however long a candidate is.
#: Candidates that are never reported: documented examples, as a whole or by how they end.
ALLOW = (
    r"^(?:EXAMPLE|example|KEY|key|x{4,}|X{4,}|0{7,}|0?1234567(?:89?)?0?|abcdef(?:ghij)?|ABCDEF(?:GHIJ)?|[-_=/+]+)++$",
    r"(?:EXAMPLE|example)[-_]?(?:KEY|key)?=*$",
)
#: Within a candidate, no window reaches into a UUID.
UUID = r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"
#: What has the shape of a file path, and those of its segments that are words and numbers: no window reaches into them.
PATH = r"^/?(?:[A-Za-z0-9_.-]*[a-z][A-Za-z0-9_.-]*/){2,}+[A-Za-z0-9_.-]*$"
_PIECE = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*+|[A-Z]+)?[0-9]{0,8}"
SEGMENT = rf"(?<![^/]){_PIECE}(?:[-_=]{_PIECE})*+(?![^/])"

#: Entries of a block when lengths are summed up.
_BLOCK = 128

_KINDS = ("assign", "access", "hex", "entropy")
_NONE = "CAST(array() AS array<struct<start:int,kind:int,stop:int,hit:string>>)"


def _once(value: Column, use) -> Column:
    """use(value), value being worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _sums_before(a: Column) -> Column:
    """Of each entry of an array that isn't empty the sum of those before it.

    Sums of blocks come first, so an entry costs a block at most, not the whole array.
    """

    def spread(blocks: Column, sums: Column) -> Column:
        def within(block, k):
            start = F.struct(_total(F.slice(sums, F.lit(1), k)).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
            return F.aggregate(block, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

        return F.flatten(F.transform(blocks, within))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / F.lit(_BLOCK)).cast("int")), lambda k: F.slice(a, k * _BLOCK + 1, F.lit(_BLOCK)))
    return _once(blocks, lambda x: _once(F.transform(x, _total), lambda sums: spread(x, sums)))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Every leftmost non-overlapping match with its place in code points."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A last piece follows the last match: it has no match after it.
    step = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("b"), h.alias("h")))

    def placed(x, at):
        start = at + x["b"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["h"])).alias("stop"), x["h"].alias("hit"))

    def found(steps: Column) -> Column:
        before = _once(F.transform(steps, lambda x: x["b"] + F.coalesce(F.length(x["h"]), F.lit(0))), _sums_before)
        return F.filter(F.zip_with(steps, before, placed), lambda y: y["hit"].isNotNull())

    return F.when(text.rlike(pattern), _once(step, found)).otherwise(F.expr(_NONE))


def _weight(n: Column) -> Column:
    """n log2 n, 0 for 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


#: Kinds of characters that tell the classes of windows apart.
_MARKS = {"digit": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "beyond": "ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "sign": "+/_=-"}


def _limit(has: dict[str, Column]) -> Column:
    """The limit of a window that has such characters; null if it is in no class."""
    kind = F.when(has["sign"], LIMITS["base64"]).when(~has["beyond"], LIMITS["hex"]).when(has["lower"] & has["upper"], LIMITS["alnum"]).otherwise(LIMITS["one case"])
    return F.when(has["digit"] & (has["lower"] | has["upper"]), kind)


def _slide(s: Column, window: int, first: float, height) -> Column:
    """The most that height(entropy, has) comes to over the windows of s, first at least.

    H = log2 w - (sum of c log2 c) / w; the sum is carried from window to window, by counts that change by one
    character in and one out. has tells by kind of character whether the window has one, from where it last stood.
    """
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    # Each character beside the one that leaves as it comes, so that no step looks into the whole string.
    left = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
    steps = F.zip_with(codes, left, lambda c, g: F.struct(c.alias("code"), g.alias("gone")))
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(first).alias("peak"), F.lit(0).alias("i"), *[F.lit(-window).alias(m) for m in _MARKS]
    )

    def slide(a, x):
        code, gone = x["code"], x["gone"]
        was_in = F.get(a["n"], code)
        # A character that comes and goes in one step leaves the counts as they are.
        was_out = F.coalesce(F.get(a["n"], gone), F.lit(0))
        moved = F.when(gone == code, F.lit(0.0)).otherwise(
            _weight(was_in + 1) - _weight(was_in) + F.when(gone >= 0, _weight(was_out - 1) - _weight(was_out)).otherwise(F.lit(0.0))
        )
        total = a["sum"] + moved
        n = F.transform(a["n"], lambda c, k: c + F.when(k == code, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
        last = {m: F.when(code.isin([ord(c) for c in chars]), a["i"]).otherwise(a[m]) for m, chars in _MARKS.items()}
        h = height(F.log2(F.lit(float(window))) - total / F.lit(float(window)), {m: at > a["i"] - window for m, at in last.items()})
        return F.struct(
            n.alias("n"),
            total.alias("sum"),
            F.when((a["i"] >= window - 1) & (h > a["peak"]), h).otherwise(a["peak"]).alias("peak"),
            (a["i"] + 1).alias("i"),
            *[at.alias(m) for m, at in last.items()],
        )

    return F.aggregate(steps, start, slide, lambda a: a["peak"])


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest entropy in bits of any window of s. Shorter strings: 0."""
    return _slide(s, window, 0.0, lambda h, has: h)


def _suspect(hit: Column) -> Column:
    """A window of hit reaches the limit of its class, and no allow-list entry covers hit or cuts into the window."""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | hit.rlike(pattern)
    left = F.regexp_replace(hit, UUID, " ")
    left = F.when(hit.rlike(PATH), F.regexp_replace(left, SEGMENT, " ")).otherwise(left)
    # The carried sum is off by rounding.
    keys = F.exists(F.split(left, " "), lambda s: (F.length(s) >= WINDOW) & s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (_slide(s, WINDOW, -9.0, lambda h, has: h - _limit(has)) >= -1e-9))
    return F.when(allowed, F.lit(False)).otherwise(keys)


def secret_spans(docs: DataFrame, text_col: str = "text", base: str = "_base", more: str = "_entropy") -> DataFrame:
    """docs with two columns of spans (start, kind, stop, hit): those of the patterns, and those that entropy adds.

    Kinds are numbered in the order assign, access, hex, entropy. An entropy span that overlaps a pattern's span
    is left out: it says nothing new.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
    found = docs.withColumn(base, F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2))))
    entropy = F.filter(
        _spans(text, CANDIDATE, 3),
        lambda x: ~F.exists(F.col(base), lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])) & _suspect(x["hit"]),
    )
    return found.withColumn(more, entropy)


def _digest(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of each pattern and the spans as text."""
    found = secret_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_base", "_entropy")

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_digest(F.col("_base")), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("_base", "_entropy"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text_col replaced by mask; a null text stays null, other columns stay as they are."""
    text = F.col(text_col)
    # Names of our own that no column of docs has, in any case.
    base, more, every = "_base", "_entropy", "_all"
    while {base, more, every} & {c.lower() for c in docs.columns}:
        base, more, every = base + "_", more + "_", every + "_"
    found = secret_spans(docs, text_col, base, more).withColumn(every, F.array_sort(F.concat(base, more)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(a, x):
        kept = F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["stop"]).alias("at"), kept.alias("out"))

    clean = F.aggregate(every, start, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(every) > 0, clean).otherwise(text)).drop(base, more, every)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
