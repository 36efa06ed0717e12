"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Strings that could be keys are runs of key characters whose mix of classes infers an
encoding (hex, base32, base36, base64).  Over the symbols of that encoding three tests ask
whether the string is random: chi-squared against a uniform alphabet, runs above and below
the middle symbol, and lag-1 serial correlation.  Fisher's method combines their p-values.
Natural strings fail (small p); failures are rejected by the Benjamini-Hochberg rule at
level ``LEVEL`` within each class of encoding and length, so that long strings, where the
tests see more, and short ones do not share a bound.  What is not rejected is a secret.

The rule needs ranks of p-values over all documents.  They are counted per class in
``BINS`` bins of log p (a count table of bounded size), and a bin passes as a whole by the
larger p at its edge, which only rejects less.  The bounds, one per class, are some tens of
numbers and enter the second pass as literals.

Only DataFrame and SQL functions are used.  Positions come from the pieces between
matches, in code points; texts without a match skip that work.

Defined results: null and empty texts have no spans; a base pattern is matched leftmost
and without overlap, and matches that fail its length are dropped after they have used up
their characters; spans of the battery that lie in a base span are left out; spans are
ordered by start, then kind; repeated rows get equal results.  Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import free_name


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns, whose letters match in either case where so written.
KEYWORDS = "|".join([*map(_either, ["password", "passwd", "secret", "token"]), _either("api") + "_?" + _either("key")])
ASSIGN = f"""({KEYWORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

#: A run of key characters with a digit in it, from the run's start to its end.
KEY_RUN = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+"
# Symbols of the encodings, in order.
SYMBOLS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LEVEL = 0.05
BIN_WIDTH, BINS = 0.1, 200

SPANS = "array<struct<start: int, end: int, text: string>>"


def matches(text: Column, pattern: str, cheap: Column | None = None) -> Column:
    """All matches of a pattern with their places; ``cheap`` tells texts that have any."""
    none = F.array().cast(SPANS)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    both = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["hit"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("text"))
        # The last piece has no match behind it.
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(x["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(hit))).alias("out"),
        )

    found = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern) if cheap is None else cheap, found).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of each base kind that meet its length."""
    return {
        "assign": F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 8),
        "access": F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda m: F.length(m["text"]) >= 16),
        "hex": matches(text, HEX),
    }


def encoding_of(s: Column) -> Column:
    """The encoding that a string's classes of characters infer; null if none."""
    lower, upper, digit = (s.rlike(c) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return (
        F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & digit & (lower | upper), "hex")
        .when(s.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(s.rlike("^[a-z0-9]+$") & digit & lower, "base36")
        .when(digit & lower & upper, "base64")
    )


def _upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic of a cubic."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def random_p(s: Column, encoding: Column) -> Column:
    """Combined p-value of the three tests for one string, over its encoding's symbols."""
    plain = F.translate(F.when(encoding == "hex", F.lower(s)).otherwise(s), "-_", "+/")
    alphabet = F.coalesce(*[F.when(encoding == name, symbols) for name, symbols in SYMBOLS.items()])
    place = lambda c: F.call_function("locate", c, alphabet).cast("double")
    x = F.transform(F.split(plain, ""), place)
    bound = F.struct(x.alias("x"), F.length(alphabet).cast("double").alias("k"), F.length(plain).cast("double").alias("n"))
    return F.transform(F.array(bound), _battery)[0]


def _total(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))


def _battery(b: Column) -> Column:
    x, k, n = b["x"], b["k"], b["n"]
    squares = _total(F.array_distinct(x), lambda s: F.pow(F.size(F.filter(x, lambda y: y == s)).cast("double"), 2))
    freedom = k - 1.0
    chi = k / n * squares - n
    spread = 2.0 / (9.0 * freedom)
    uniform = _upper_tail((F.pow(chi / freedom, 1.0 / 3.0) - (1.0 - spread)) / F.sqrt(spread))

    after = F.slice(x, 2, F.size(x))
    pairs = F.filter(
        F.zip_with(x, after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull()
    )
    half = k / 2.0
    high = F.size(F.filter(x, lambda y: y > half)).cast("double")
    low = n - high
    runs = 1.0 + _total(pairs, lambda p: F.when((p["a"] > half) != (p["b"] > half), 1.0).otherwise(0.0))
    expected = 2.0 * high * low / n + 1.0
    variance = (expected - 1.0) * (expected - 2.0) / (n - 1.0)
    runs_p = F.when(variance > 0, 2.0 * _upper_tail(F.abs(runs - expected) / F.sqrt(variance))).otherwise(0.0)

    mean = _total(x) / n
    around = _total(x, lambda y: (y - mean) * (y - mean))
    lagged = _total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean))
    serial_p = F.when(around > 0, 2.0 * _upper_tail(F.abs(lagged / around + 1.0 / n) * F.sqrt(n))).otherwise(0.0)

    safe = [F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p)) for p in (uniform, runs_p, serial_p)]
    s = -(F.ln(safe[0]) + F.ln(safe[1]) + F.ln(safe[2]))
    return F.exp(-s) * (1.0 + s + s * s / 2.0)


KEYS = "array<struct<start: int, end: int, encoding: string, size: int, bin: int>>"


def length_class(n: Column) -> Column:
    return F.least(F.lit(12), F.floor(F.log2(n.cast("double")) * 2.0).cast("int"))


def key_runs(text: Column) -> Column:
    """Strings that could be keys: place, encoding, length class and bin of -log10 p."""
    found = matches(text, KEY_RUN)
    coded = F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), encoding_of(m["text"]).alias("encoding"))
    )
    kept = F.filter(coded, lambda m: m["encoding"].isNotNull())

    def judged(m: Column) -> Column:
        p = F.greatest(F.lit(1e-300), random_p(m["text"], m["encoding"]))
        # Small bins have large p: bin b holds p in (10^-(b+1)w, 10^-bw].
        place = F.least(F.lit(BINS - 1), F.floor(-F.log10(p) / BIN_WIDTH).cast("int"))
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["encoding"].alias("encoding"),
            length_class(m["end"] - m["start"]).alias("size"), place.alias("bin"),
        )

    return F.transform(kept, judged).cast(KEYS)


def rejection_bounds(docs: DataFrame, text: str = "text", level: float = LEVEL) -> dict[tuple[str, int], int]:
    """Per encoding and length class the least bin that is rejected, by the Benjamini-Hochberg rule over all texts."""
    run = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).select(F.explode(key_runs(F.col("_t"))).alias("k"))
    counts = run.groupBy("k.encoding", "k.size", "k.bin").count().collect()  # classes x BINS rows at most
    bounds: dict[tuple[str, int], int] = {}
    for group in sorted({(r["encoding"], r["size"]) for r in counts}):
        bins = sorted(((r["bin"], r["count"]) for r in counts if (r["encoding"], r["size"]) == group), reverse=True)
        total, seen, least = sum(c for _, c in bins), 0, BINS
        for place, count in bins:
            seen += count
            if 10.0 ** (-place * BIN_WIDTH) <= level * seen / total:
                least = place
        bounds[group] = least
    return bounds


def _placed(found: Column, kind: str) -> Column:
    place = F.lit(KINDS.index(kind))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), place.alias("kind"), m["end"].alias("end")))


def scanned(docs: DataFrame, text: str = "text", name: str = "secrets", level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` with one more column: an array of (start, place of the kind in KINDS, end), sorted."""
    bounds = rejection_bounds(docs, text, level)
    table = F.create_map(*[F.lit(x) for (e, s), b in bounds.items() for x in (f"{e}:{s}", b)]) if bounds else None
    t, spans = free_name(docs.columns, "_text"), {}
    for kind, found in base_spans(F.col(t)).items():
        spans[kind] = _placed(found, kind)
    b, k = free_name([*docs.columns, t], "_base"), free_name([*docs.columns, t], "_keys")
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(b, F.concat(*spans.values()))
    if table is None:
        return out.withColumn(name, F.array_sort(b)).drop(t, b)
    keys = F.filter(
        key_runs(F.col(t)),
        lambda m: m["bin"] < F.coalesce(F.element_at(table, F.concat_ws(":", m["encoding"], m["size"].cast("string"))), F.lit(BINS)),
    )
    apart = F.filter(k, lambda m: ~F.exists(b, lambda s: (s["start"] <= m["start"]) & (s["end"] >= m["end"])))
    every = F.concat(F.col(b), _placed(apart, "random"))
    return out.withColumn(k, keys).withColumn(name, F.array_sort(every)).drop(t, b, k)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", level: float = LEVEL) -> DataFrame:
    """The documents with every secret replaced by a mark; the columns of ``docs``."""
    name = free_name(docs.columns, "_secrets")
    found = scanned(docs, text, name, level)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], between, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(longer)

    rest = F.aggregate(
        F.col(name), start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text))))
    )
    return found.withColumn(text, F.when(F.size(name) > 0, rest).otherwise(F.col(text))).drop(name)
