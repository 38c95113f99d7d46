"""Secret scan: fixed patterns, and a battery of randomness tests for other tokens.

A token's alphabet is inferred from its characters. Chi-squared uniformity over that alphabet, runs
above and below its middle and lag-one correlation say whether the token may be random. How often an
ordinary word passes for uniform is counted over the corpus, for each band of lengths by itself, and
each band gets the threshold that keeps the share of false discoveries below ``FALSE_SHARE``.

All of it is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regatta.llm.spans import apart_from, masked, no_spans, pattern_spans, tagged

# Fixed values of the contract, in its order.
KINDS = ("assign", "access", "hex")
RANDOM = "random"
_ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = r"AKIA[A-Z0-9]{16,}+"
_HEX = r"[0-9a-f]{24,}+"

# Shortest token that is tested, lower ends of the length bands, and the share of false discoveries.
MIN_LENGTH = 20
BANDS = (20, 24, 32, 48, 96)
FALSE_SHARE = 0.01
# A test rejects randomness beyond this many standard deviations.
REJECT = 3.0
# Width of a bin of the uniformity score, and the scores the bins reach.
BIN, LOW, HIGH = 0.25, -10.0, 50.0
_TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets of the encodings by the characters that may occur, the narrowest first.
ALPHABETS = {
    "digits": ("^[0-9]+$", _DIGITS),
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    "hex_upper": ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "lower": ("^[a-z]+$", _LOWER),
    "upper": ("^[A-Z]+$", _UPPER),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567"),
    "base36": ("^[0-9a-z]+$", _DIGITS + _LOWER),
    "letters": ("^[A-Za-z]+$", _UPPER + _LOWER),
    "alphanumeric": ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    "base64": ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64_url": ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
}
_ANY = _UPPER + _LOWER + _DIGITS + "+/-_"


def pattern_secrets(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns in one whole text."""
    assign = F.when(text.rlike(_ASSIGN), F.filter(
        pattern_spans(text, F.lit(_ASSIGN)),
        lambda s: F.char_length(F.regexp_extract(s["value"], _ASSIGN, 1)) >= 6,
    )).otherwise(no_spans())
    access = F.when(text.contains("AKIA"), pattern_spans(text, F.lit(_ACCESS))).otherwise(no_spans())
    found = F.when(text.rlike(_HEX), pattern_spans(text, F.lit(_HEX))).otherwise(no_spans())
    return dict(zip(KINDS, (assign, access, found)))


def _alphabet(token: Column) -> Column:
    chain = None
    for pattern, letters in ALPHABETS.values():
        held = token.rlike(pattern)
        chain = F.when(held, letters) if chain is None else chain.when(held, letters)
    return chain.otherwise(_ANY)


def battery(value: Column) -> Column:
    """``(length, uniform, runs, serial)`` of a token: its length and three standard scores."""
    token = F.rtrim(value, F.lit("="))
    parts = F.transform(F.array(F.struct(token.alias("t"), _alphabet(token).alias("a"))), _scores)
    return parts[0]


def _scores(p: Column) -> Column:
    token, letters = p["t"], p["a"]
    n = F.char_length(token).cast("double")
    m = F.char_length(letters).cast("double")
    squares = F.aggregate(
        F.split(letters, ""), F.lit(0.0),
        lambda s, c: s + F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), 2),
    )
    chi = m / n * squares - n
    uniform = (chi - (m - 1)) / F.sqrt(2 * (m - 1))
    half = F.floor(m / 2).cast("int")
    sides = F.call_function(
        "translate", token, letters,
        F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), (m - half).cast("int"))),
    )

    def times(what: str) -> Column:
        return (n - F.char_length(F.replace(sides, F.lit(what), F.lit("")))) / len(what)

    ones = times("1")
    zeros = n - ones
    expected = 2 * ones * zeros / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    changes = 1 + times("01") + times("10")
    runs = F.when(variance > 0, (changes - expected) / F.sqrt(variance)).otherwise(99.0)
    places = F.transform(F.split(token, ""), lambda c: F.instr(letters, c).cast("double"))
    mean = F.aggregate(places, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.aggregate(places, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    pairs = F.zip_with(F.slice(places, 1, (n - 1).cast("int")), F.slice(places, 2, (n - 1).cast("int")),
                       lambda x, y: x * y)
    product = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (n - 1)
    serial = F.when(spread > 0, (product - mean * mean) / spread * F.sqrt(n)).otherwise(99.0)
    return F.struct(n.alias("length"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"))


def _band(length: Column) -> Column:
    found = F.lit(0)
    for low in BANDS:
        found = F.when(length >= low, low).otherwise(found)
    return found


def _bin(score: Column) -> Column:
    held = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), score))
    return F.floor(held / BIN).cast("int")


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def thresholds(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``(band, limit)``: up to which uniformity score a mixed token of a length band is a discovery.

    Words of letters alone stand for ordinary tokens. At a limit the share of false discoveries is
    the share of ordinary tokens below it times all tokens, over the tokens below it. At most one row
    for each of the few bands and bins leaves the corpus.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = docs.select(F.explode(F.when(
        text.rlike(_TOKEN), F.regexp_extract_all(text, F.lit(_TOKEN), 0)
    )).alias("value")).where(_mixed(F.col("value")) | F.col("value").rlike("^[A-Za-z]+$"))
    scored = tokens.select(_mixed(F.col("value")).cast("int").alias("mixed"),
                           battery(F.col("value")).alias("b"))
    bins = scored.groupBy(_band(F.col("b.length")).alias("band"), _bin(F.col("b.uniform")).alias("bin")).agg(
        F.sum("mixed").alias("mixed"), F.sum(1 - F.col("mixed")).alias("plain")
    )
    by_band = W.partitionBy("band")
    below = by_band.orderBy("bin")
    false = (
        F.sum("plain").over(below) / F.greatest(F.sum("plain").over(by_band), F.lit(1))
        * F.sum("mixed").over(by_band) / F.greatest(F.sum("mixed").over(below), F.lit(1))
    )
    rated = bins.select("band", "bin", false.alias("false"))
    return rated.where(F.col("false") <= false_share).groupBy("band").agg(
        F.least(F.lit(REJECT), (F.max("bin") + 1) * F.lit(BIN)).alias("limit")
    )


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with an array of spans ``_llm_<kind>`` for every kind and ``_llm_random``.

    A null text is an empty one; null ids, repeated rows, ties and empty tables need nothing special.
    Random tokens that share a character with a pattern's span are not listed again. Other columns stay.
    """
    limits = {r["band"]: r["limit"] for r in thresholds(docs, false_share).collect()}
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_llm_text", text)
    rows = rows.withColumns({f"_llm_{k}": c for k, c in pattern_secrets(F.col("_llm_text")).items()})

    def discovered(span: Column) -> Column:
        scores = F.transform(F.array(battery(span["value"])), lambda b: _is_random(b, limits))
        return _mixed(span["value"]) & scores[0]

    whole = F.col("_llm_text")
    tokens = F.when(whole.rlike(_TOKEN), F.filter(
        F.filter(pattern_spans(whole, F.lit(_TOKEN)), lambda s: _mixed(s["value"])), discovered
    )).otherwise(no_spans())
    base = F.concat(*[F.col(f"_llm_{k}") for k in KINDS])
    return rows.withColumn("_llm_random", apart_from(tokens, base))


def _is_random(b: Column, limits: dict[int, float]) -> Column:
    limit = F.lit(None).cast("double")
    for band, value in sorted(limits.items()):
        limit = F.when(_band(b["length"]) == band, F.lit(float(value))).otherwise(limit)
    return F.coalesce(
        (b["uniform"] < limit) & (F.abs(b["runs"]) <= REJECT) & (F.abs(b["serial"]) <= REJECT),
        F.lit(False),
    )


def _joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then by kind as listed."""
    def ranked(rank: int, kind: str) -> Column:
        return F.transform(F.col(f"_llm_{kind}"), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")
        ))

    spans = F.concat(*[ranked(n, k) for n, k in enumerate(kinds)])
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = find_secrets(docs)
    return found.select(
        "doc_id", *[F.size(f"_llm_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(KINDS), 256).alias("base_sha256"),
        _joined((*KINDS, RANDOM)).alias("spans"),
        F.size(f"_llm_{RANDOM}").cast("long").alias("n_random"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``[KIND]``; a null text stays null."""
    found = find_secrets(docs)
    tags = F.concat(*[tagged(k, F.col(f"_llm_{k}")) for k in (*KINDS, RANDOM)])
    clean = F.when(docs["text"].isNotNull(), masked(F.col("_llm_text"), tags))
    return found.withColumn("text", clean).select(*docs.columns)
