"""Secret scan: known shapes, and a battery of randomness tests.

Known shapes (``BASE``) are found by expressions.  Besides, every run of 20 or
more encoding characters is a candidate: its encoding is inferred from its
characters (hexadecimal, base 32, base 64), and it is tested within it.

* chi-squared uniformity over the encoding's alphabet;
* the number of runs above and below the middle of the alphabet;
* the serial correlation of neighbouring characters.

These three test against randomness (Bonferroni at ``FIT``).  Against ordinary
text a candidate has its likelihood ratio: how much likelier its characters
are when drawn evenly than as text, whose characters stay within their class
(lower case, upper case, digits, others) and whose letters are those of
English.  One over that ratio bounds the probability that text looks as random
as the candidate does, at every length.  That is the candidate's probability;
it is 1 where one of the three tests rejects randomness (rulers, counted
sequences, repeated patterns).  A candidate is a secret if its probability is
below a threshold that controls the false-discovery rate (Benjamini-Hochberg
at ``RATE``), found over all candidates of the corpus for each encoding and
doubling of length.  The probabilities are counted in bins first, so the
thresholds come from a small table of fixed bound and hold to the edge of a
bin, on the strict side.

Only DataFrame functions are used.  Spans are code points, end exclusive.

Defined results: null texts count as empty and have no spans; repeated rows
are scanned each; ties in start go by kind, then end; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import scratch

#: Kinds, expressions, the group that is measured, least length.
#: Upper and lower case are spelled out, so that only ASCII letters fold.  The
#: runs of ``access`` and ``hex`` hold their least length in the expression: a
#: run that falls short holds no longer one.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What a text must hold for the expression to be worth running.
WORTH = {"assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
KINDS = ("assign", "access", "hex", "random")
CANDIDATE, WORTH_TESTING = r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+/_-]{20}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: English letters in a thousand, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Share of evenly drawn letters mixed in, for other languages and names.
OTHER_LETTERS = 0.1
#: Text by encoding: the classes a character goes to, from the start and from each class.
CLASSES = {"hex": ("digit", "lower"), "base32": ("upper", "digit"), "base64": ("lower", "upper", "digit", "other")}
STEPS = {
    "hex": {"start": (0.8, 0.2), "digit": (0.95, 0.05), "lower": (0.1, 0.9)},
    "base32": {"start": (0.85, 0.15), "upper": (0.95, 0.05), "digit": (0.2, 0.8)},
    "base64": {"start": (0.6, 0.2, 0.15, 0.05), "lower": (0.93, 0.02, 0.02, 0.03), "upper": (0.44, 0.5, 0.03, 0.03),
               "digit": (0.1, 0.05, 0.75, 0.1), "other": (0.5, 0.15, 0.15, 0.2)},
}
FIT, RATE = 0.001, 0.01
#: Bins of a probability's logarithm, per power of ten, and their last.
BINS, LAST_BIN = 20, 400
MASK = "[SECRET]"

SPAN = "array<struct<start: int, end: int, kind: int>>"


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the matches of ``pattern``.

    The pieces between the matches and the matches themselves add up to the
    positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.zip_with(F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("value"))),
                       F.split(text, pattern, -1),
                       lambda m, p: F.struct(F.length(p).alias("gap"), m["n"].alias("n"), m["value"].alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + F.coalesce(x["n"], F.lit(0))
        one = F.struct(lo.alias("start"), hi.alias("end"), x["value"].alias("value"))
        return F.struct(hi.alias("at"), F.when(x["n"].isNull(), acc["out"])
                        .otherwise(F.concat(acc["out"], F.array(one))).alias("out"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one known shape."""
    k = [x[0] for x in BASE].index(kind)
    _, pattern, group, least = BASE[k]
    long = F.filter(occurrences(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(long, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("kind")))
    return F.when(text.rlike(WORTH[kind]), spans).otherwise(F.array().cast(SPAN))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (a rational approximation of the
    scaled complementary error function, relative error below 2e-7)."""
    def half(z: Column, t: Column) -> Column:
        poly = F.lit(0.0)
        for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
                  -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
            poly = poly * t + c
        return 0.5 * t * F.exp(-z * z / 2 + poly)

    def at(z: Column) -> Column:
        t = 1 / (1 + 0.5 * F.abs(z) / F.sqrt(F.lit(2.0)))
        return let(let(t, lambda t: half(z, t)), lambda h: F.when(z >= 0, h).otherwise(1 - h))
    return let(z, at)


def _class(c: str) -> str:
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"


def text_model(encoding: str) -> tuple[list[int], list[float]]:
    """The class of each character of the alphabet (from 1; the start is 0), and
    by class before and character the logarithm of how much likelier an even
    draw gives it than text."""
    alphabet, classes = ALPHABETS[encoding], CLASSES[encoding]
    weight = {c: (1 - OTHER_LETTERS) * LETTERS[ord(c.lower()) - 97] / sum(LETTERS) + OTHER_LETTERS / 26 if c.isalpha() else 1.0
              for c in alphabet}
    within = {k: sum(w for c, w in weight.items() if _class(c) == k) for k in classes}
    scores = [-math.log(len(alphabet) * STEPS[encoding][before][classes.index(_class(c))] * weight[c] / within[_class(c)])
              for before in ("start", *classes) for c in alphabet]
    return [classes.index(_class(c)) + 1 for c in alphabet], scores


def _of(encoding: Column, values: dict) -> Column:
    return F.when(encoding == "hex", F.lit(values["hex"])).when(encoding == "base32", F.lit(values["base32"])) \
        .otherwise(F.lit(values["base64"]))


def _coded(x: Column) -> Column:
    def coded(e: str) -> Column:
        return F.transform(x["chars"], lambda c: F.instr(F.lit(ALPHABETS[e]), c).cast("double") - 1)
    return F.when(x["encoding"] == "hex", coded("hex")).when(x["encoding"] == "base32", coded("base32")).otherwise(coded("base64"))


def _p_text(x: Column, codes: Column) -> Column:
    """One over the likelihood ratio of an even draw to text, 1 at most."""
    def ratio(e: str) -> Column:
        classes, scores = (F.array(*map(F.lit, v)) for v in text_model(e))
        zero = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
        return F.aggregate(codes, zero, lambda acc, c: F.struct(
            F.get(classes, c.cast("int")).alias("before"),
            (acc["sum"] + F.get(scores, acc["before"] * len(ALPHABETS[e]) + c.cast("int"))).alias("sum")), lambda acc: acc["sum"])
    total = F.when(x["encoding"] == "hex", ratio("hex")).when(x["encoding"] == "base32", ratio("base32")).otherwise(ratio("base64"))
    return F.exp(-F.greatest(F.lit(0.0), total))


def _p_random(x: Column, p_even: Column, codes: Column) -> Column:
    """The three tests against randomness, combined.  One pass over neighbours
    gives the sums for the runs and the serial correlation."""
    zero = F.struct((x["k"] / 2).alias("half"), F.lit(-1.0).alias("last"),
                    *[F.lit(0.0).alias(c) for c in ("high", "turns", "x", "xx", "xy")], F.lit(-1.0).alias("first"))

    def step(acc: Column, c: Column) -> Column:
        begins, above = acc["last"] < 0, c >= acc["half"]
        turn = ~begins & ((acc["last"] >= acc["half"]) != above)
        return F.struct(acc["half"].alias("half"), c.alias("last"),
                        (acc["high"] + F.when(above, 1.0).otherwise(0.0)).alias("high"),
                        (acc["turns"] + F.when(turn, 1.0).otherwise(0.0)).alias("turns"), (acc["x"] + c).alias("x"),
                        (acc["xx"] + c * c).alias("xx"),
                        (acc["xy"] + F.when(begins, 0.0).otherwise(acc["last"] * c)).alias("xy"),
                        F.when(begins, c).otherwise(acc["first"]).alias("first"))

    def judge(s: Column) -> Column:
        n, m = x["n"], s["x"] / x["n"]
        mean = 2 * s["high"] * (n - s["high"]) / n + 1
        p_runs = let(mean, lambda mean: let((mean - 1) * (mean - 2) / (n - 1), lambda var: F.when(var <= 0, F.lit(0.0)).otherwise(
            2 * upper_tail(F.abs(s["turns"] + 1 - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))))
        # sum of (x_i - m)(x_(i+1) - m) over neighbours, and of (x_i - m)^2
        cross = s["xy"] - m * (2 * s["x"] - s["first"] - s["last"]) + (n - 1) * m * m
        p_serial = let(s["xx"] - n * m * m, lambda spread: F.when(spread <= 0, F.lit(0.0)).otherwise(
            2 * upper_tail(F.abs(cross / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))))
        return F.least(F.lit(1.0), 3 * F.least(p_even, p_runs, p_serial))
    return F.aggregate(codes, zero, step, judge)


def _battery(x: Column) -> Column:
    """struct<encoding, length, p_text, p_random> from a candidate's facts."""
    n, k = x["n"], x["k"]
    squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(
        n - F.length(F.replace(x["plain"], c, F.lit(""))), F.lit(2.0)))

    def with_chi(chi: Column, codes: Column) -> Column:
        # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal
        d = k - 1
        p_even = upper_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d)))
        return F.struct(x["encoding"].alias("encoding"), n.cast("int").alias("length"), _p_text(x, codes).alias("p_text"),
                        _p_random(x, p_even, codes).alias("p_random"))
    return let(_coded(x), lambda codes: let(k / n * squares - n, lambda chi: with_chi(chi, codes)))


def tested(token: Column) -> Column:
    """struct<encoding, length, p_text, p_random> of a candidate."""
    encoding = F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32") \
        .otherwise("base64")

    def facts(e: Column, plain: Column) -> Column:
        return F.struct(
            e.alias("encoding"), plain.alias("plain"), F.split(plain, "").alias("chars"), F.length(plain).cast("double").alias("n"),
            _of(e, {a: float(len(x)) for a, x in ALPHABETS.items()}).alias("k"))

    def as_encoded(e: Column) -> Column:
        plain = F.when(e == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
        return let(let(plain, lambda p: facts(e, p)), _battery)
    return let(encoding, as_encoded)


def scan(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the spans of the known shapes and the tested
    candidates (``_base``, ``_candidates``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_text = docs.withColumn("_text", text)
    t = F.col("_text")
    with_found = with_text.select(
        *docs.columns,
        F.concat(*[base_spans(t, kind) for kind in KINDS[:3]]).alias("_base"),
        F.when(t.rlike(WORTH_TESTING), occurrences(t, CANDIDATE))
        .otherwise(F.array().cast("array<struct<start: int, end: int, value: string>>")).alias("_runs"))
    one = F.transform("_runs", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), tested(m["value"]).alias("test")))
    return with_found.withColumn("_candidates", one).drop("_runs")


def _stratum(test: Column) -> Column:
    """An encoding and a doubling of length, as text."""
    return F.concat(test["encoding"], F.lit(":"), F.floor(F.log2(test["length"].cast("double"))).cast("string"))


def _bin(test: Column, fit: float) -> Column:
    """The bin of a candidate's probability: it lies in (10^-((bin + 1) / BINS), 10^-(bin / BINS)]."""
    p = F.when(test["p_random"] >= fit, F.greatest(test["p_text"], F.lit(1e-300))).otherwise(1.0)
    return F.least(F.lit(LAST_BIN), F.greatest(F.lit(0), F.floor(-F.log10(p) * BINS))).cast("int")


def thresholds(scanned: DataFrame, rate: float = RATE, fit: float = FIT) -> dict[str, int]:
    """Per stratum the least bin whose candidates are discoveries.  Strata and
    bins are bounded: three encodings, the doublings of a text's length."""
    c = scanned.select(F.explode("_candidates.test").alias("test")).select(
        _stratum(F.col("test")).alias("stratum"), _bin(F.col("test"), fit).alias("bin"))
    counts = c.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    below = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("n").over(below)) \
        .withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS) <= rate * F.col("rank") / F.col("all"))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def with_spans(scanned: DataFrame, least_bins: dict[str, int], fit: float = FIT) -> DataFrame:
    """``_spans``: all spans in order; known shapes and discoveries."""
    random = KINDS.index("random")
    if least_bins:
        known = F.create_map(*[F.lit(x) for kv in sorted(least_bins.items()) for x in kv])
        secret = F.filter("_candidates", lambda c: F.coalesce(
            _bin(c["test"], fit) >= F.element_at(known, _stratum(c["test"])), F.lit(False)))
    else:
        secret = F.filter("_candidates", lambda c: F.lit(False))
    found = F.transform(secret, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(random).alias("kind")))
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return scanned.withColumn("_spans", order(F.concat("_base", found))).withColumn("_base", order(F.col("_base")))


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row of ``docs``."""
    light = materialize(scan(docs.select("doc_id", "text")).drop("text"))
    spans = with_spans(light, thresholds(light))

    def number(k: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select("doc_id", number(0), number(1), number(2), F.sha2(as_text(F.col("_base")), 256).alias("base_sha256"),
                        as_text(F.col("_spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every span, or run of overlapping spans, as ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        between = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, between).otherwise(acc["out"]).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in their texts masked, n_chars kept true.

    Null and empty texts and repeated rows stay as they are; columns may have
    any names; an empty table gives none."""
    names = docs.columns
    docs = docs.select(*[F.col(c).alias("text" if c == "text" else f"in_{k}") for k, c in enumerate(names)])
    # stored once: the thresholds read the candidates, the masking all of it
    path = scratch(docs.sparkSession, "secrets")
    scan(docs).write.parquet(path)
    scanned = docs.sparkSession.read.parquet(path)
    spans = with_spans(scanned, thresholds(scanned))
    hit = F.size("_spans") > 0
    out = spans.withColumn("_masked", F.when(hit, masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
    return out.select(*[
        F.col("_masked").alias(c) if c == "text"
        else F.when(hit, F.length("_masked").cast("long")).otherwise(F.col(f"in_{k}")).alias(c) if c == "n_chars"
        else F.col(f"in_{k}").alias(c) for k, c in enumerate(names)])
