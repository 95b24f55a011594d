"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

Expressions only. A pattern's matches and the text between them come from one extraction and
one split, and their lengths give the positions; only texts that hold a match are searched
for positions.

Candidates are long runs of token characters that hold a digit and a letter. The narrowest
alphabet that covers a candidate is taken as its encoding, and three tests ask whether its
characters are random draws from it: chi-squared uniformity over the alphabet, the number of
runs above and below the middle of the alphabet, and the correlation of neighbours. The
smallest of the three p-values, corrected for being the smallest of three, is the candidate's p-value for
being random. Ordinary identifiers are rejected, secrets are not.

Which rejections stand is decided over all candidates of the corpus, for each length class
on its own, since tests are stronger on longer tokens, and from both sides. Of the candidates
thrown out, at most the rate is expected to be random after all (Benjamini-Hochberg). Of those
kept, at most the rate is expected not to be random: p-values of random tokens are uniform, so
those above one half tell how many random tokens a class has (with two standard errors on
top, as a class with a handful of candidates cannot tell), and the limit goes up until what is
kept is explained by them. Candidates too short for their alphabet to be rejected by any test are no
candidates. P-values are counted in fine bins of their logarithm, so the rules need a few
hundred counts, not a sort.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import whole_row, with_text
from palisade.session import settle

# The patterns of the base kinds and the least lengths of their matches.
ASSIGN = (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# The same kinds with the least length inside, and cheap signs that a text may hold one.
HEX_LONG = r"[0-9a-f]{32,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")
REDACTED = "[secret]"

RUN = r"[A-Za-z0-9+/_=-]{20,}"
CANDIDATE_SIGN = r"[A-Za-z0-9+/_=-]{20}"
# Alphabets from narrow to wide, in the order of their characters, and the least length at
# which the battery can reject.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (
    ("hex", _DIGITS + "abcdef", 24),
    ("upper hex", _DIGITS + "ABCDEF", 24),
    ("base32", _UPPER + "234567", 24),
    ("base36", _DIGITS + _LOWER, 24),
    ("upper base36", _DIGITS + _UPPER, 24),
    ("base62", _UPPER + _LOWER + _DIGITS, 20),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 20),
    ("url base64", _UPPER + _LOWER + _DIGITS + "-_", 20),
)
RATE = 0.05
BINS_PER_DECADE = 50
LEAST_P = 1e-12
HIGH_BIN = -15  # p-values of about one half and more
CHUNK = 256  # matches of a text whose places are added up together

_SPAN = "struct<start: int, kind: string, until: int>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda, an expression is computed for each element."""
    return F.transform(F.array(value), use)[0]


def _chunks(values: Column) -> Column:
    """An array in arrays of ``CHUNK`` values."""
    return _once(values, lambda own: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))),
        lambda k: F.slice(own, k * CHUNK + 1, CHUNK)))


def _scan(values: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``join`` makes of each value and all before it, without the value itself; 0 for the first.

    Growing an array one by one copies it each time, so it is done in chunks, and once
    more over the chunks: the cost of a text with very many matches stays near their number.
    """
    def grown(array: Column, first: Column) -> Column:
        return F.aggregate(
            array, F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("seen")),
            lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))

    zero = F.lit(0).cast(kind)
    return _once(_chunks(values), lambda chunks: F.flatten(F.zip_with(
        chunks, grown(F.transform(chunks, lambda c: F.aggregate(c, zero, join)), zero)["seen"], lambda c, first: grown(c, first)["seen"])))


def _positions(text: Column, pattern: str, value: Column | None = None) -> Column:
    """All matches of ``pattern`` as structs ``start, until, value``, in code points."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(whole))
    lengths = F.transform(whole, F.length)
    before = _scan(F.zip_with(between, lengths, lambda b, w: b + w), lambda a, b: a + b, "int")
    values = whole if value is None else value
    return F.zip_with(
        F.arrays_zip(whole.alias("w"), values.alias("v")), F.zip_with(before, between, lambda a, b: a + b),
        lambda m, s: F.struct(s.alias("start"), (s + F.length(m["w"])).alias("until"), m["v"].alias("value")))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["until"].alias("until")))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of spans of the three base kinds; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    assigned = F.filter(
        _positions(text, ASSIGN.replace("([", "(?:[")),
        lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 1)) >= ASSIGN_LEAST)
    either = lambda sign, found, kind: F.when(sign, _spans(found, kind)).otherwise(_none())
    return {
        "assign": either(text.rlike(ASSIGN), assigned, "assign"),
        "access": either(text.contains("AKIA"), _positions(text, ACCESS_LONG), "access"),
        "hex": either(text.rlike(HEX_LONG), _positions(text, HEX_LONG), "hex"),
    }


def _candidates(scanned: DataFrame) -> DataFrame:
    """``_row, start, until, value, encoding`` of the runs that the battery can judge."""
    runs = scanned.where(F.col("text").rlike(CANDIDATE_SIGN)).select("_row", F.explode(_positions(F.col("text"), RUN)).alias("m"))
    value = F.rtrim(F.col("m.value"), F.lit("="))
    held = lambda alphabet, least: value.rlike(f"^[{alphabet.replace('-', '')}{'-' if '-' in alphabet else ''}]{{{least},}}$")
    encoding = F.coalesce(*[F.when(held(a, least), F.lit(name)) for name, a, least in ALPHABETS])
    return (
        runs.select("_row", "m.start", F.col("m.until").alias("until"), value.alias("value"), encoding.alias("encoding"))
        .where(F.col("encoding").isNotNull() & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    )


def _upper_tail(z: Column) -> Column:
    """The normal upper tail, by the usual five-term approximation of the error function."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # Coefficients of the approximation.
    terms = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = terms * F.exp(-x * x / 2) / (2 * pi) ** 0.5
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``p_uniform, p_runs, p_serial`` and the combined ``p`` of being random."""
    alphabet = F.coalesce(*[F.when(F.col("encoding") == name, F.lit(a)) for name, a, _ in ALPHABETS])
    size = F.length(alphabet).cast("double")
    n = F.length("value").cast("double")
    chars = F.split(F.col("value"), "")
    counts = F.transform(F.split(alphabet, ""), lambda c: F.length("value") - F.length(F.replace(F.col("value"), c)))
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)
    ready = tokens.withColumns({
        "n": n, "size": size,
        "ranks": F.transform(chars, lambda c: F.position(c, alphabet).cast("double")),
        "chi": total(F.transform(counts, lambda k: (k - n / size) * (k - n / size) / (n / size))),
    })
    # Chi-squared to normal by its cube root.
    free = F.col("size") - 1
    spread = 2 / (9 * free)
    uniform = _upper_tail((F.pow(F.col("chi") / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    high = F.transform("ranks", lambda r: (r > (F.col("size") + 1) / 2).cast("int"))
    tested = ready.withColumns({
        "p_uniform": uniform,
        "high": high,
        "ups": F.aggregate(high, F.lit(0), lambda acc, x: acc + x).cast("double"),
    }).withColumns({
        "runs": 1 + F.aggregate(
            F.zip_with("high", F.slice("high", 2, F.length("value")), lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))),
            F.lit(0), lambda acc, x: acc + x).cast("double"),
        "downs": F.col("n") - F.col("ups"),
        "mean": total(F.col("ranks")) / F.col("n"),
    })
    expected = 2 * F.col("ups") * F.col("downs") / F.col("n") + 1
    variance = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    centred = F.transform("ranks", lambda r: r - F.col("mean"))
    products = F.zip_with(centred, F.slice(centred, 2, F.length("value")), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    squares = total(F.transform(centred, lambda d: d * d))
    two_sided = lambda z: 2 * _upper_tail(F.abs(z))
    serial = F.when(squares > 0, (total(products) / squares + 1 / F.col("n")) * F.sqrt("n")).otherwise(99.0)
    # All characters on one side of the middle: the other tests decide.
    runs = F.when(variance > 0, two_sided((F.col("runs") - expected) / F.sqrt(variance))).otherwise(1.0)
    return tested.withColumns({"p_runs": runs, "p_serial": two_sided(serial)}).withColumn(
        "p", 1 - F.pow(1 - F.least(F.lit(1.0), "p_uniform", "p_runs", "p_serial"), F.lit(3.0))).drop(
        "ranks", "high", "chi", "ups", "downs", "runs", "mean")


def _bin(p: Column) -> Column:
    return F.floor(F.log10(F.greatest(p, F.lit(LEAST_P))) * BINS_PER_DECADE).cast("int")


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)), F.lit(9)).cast("int")


def random_tokens(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """The candidates that the corpus-wide rules do not reject as not random.

    ``tokens`` is read twice: pass a written table.
    """
    placed = tokens.withColumn("bin", _bin(F.col("p"))).withColumn("class", _length_class(F.col("n")))
    counts = placed.groupBy("class", "bin").agg(F.count("*").alias("k"))
    every = Window.partitionBy("class")
    high = F.sum(F.when(F.col("bin") >= HIGH_BIN, F.col("k")).otherwise(0)).over(every) + 1
    # The upper edge of a bin stands for its p-values, which errs on the side of keeping.
    edge = F.least(F.lit(1.0), F.pow(F.lit(10.0), (F.col("bin") + 1) / BINS_PER_DECADE))
    ranked = counts.withColumns({
        "rank": F.sum("k").over(every.orderBy("bin")), "m": F.sum("k").over(every), "edge": edge,
        "random": (high + 2 * F.sqrt(high)) / (1 - 10 ** (HIGH_BIN / BINS_PER_DECADE)),
    })
    explained = (F.col("m") - F.col("rank")) * (1 - rate) <= F.col("random") * (1 - F.col("edge"))
    limits = ranked.groupBy("class").agg(
        F.max(F.when(F.col("edge") <= rate * F.col("rank") / F.col("m"), F.col("bin"))).alias("not_random"),
        F.min(F.when(explained & (F.col("m") * (1 - rate) > F.col("random")), F.col("bin"))).alias("not_explained"),
    ).select("class", F.greatest("not_random", "not_explained").alias("rejected"))
    # One row per length class.
    return placed.join(F.broadcast(limits), "class", "left").where(
        F.col("rejected").isNull() | (F.col("bin") > F.col("rejected"))).drop("bin", "class", "rejected")


def _row(docs: DataFrame) -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("\n", part("doc_id"), part("text")))


def _random_spans(docs: DataFrame, rate: float) -> DataFrame:
    """``_row, random``: the spans the battery adds, for the rows that have any."""
    scanned = docs.select(_row(docs).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    judged = settle(battery(_candidates(scanned)), "token-tests")
    span = F.struct("start", F.lit("random").alias("kind"), "until")
    return random_tokens(judged, rate).groupBy("_row").agg(F.collect_set(span).alias("random"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``_row, doc_id`` and arrays of spans ``assign, access, hex, random``, one row per row of ``docs``.

    Null and empty texts have no spans; rows that repeat an id and a text repeat their spans; a
    null id stays null. An empty table gives no rows; other columns are ignored. A random
    span that overlaps a base span is left out: the base span has it.
    """
    based = docs.select(
        _row(docs).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
        *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    known = F.concat("assign", "access", "hex")
    apart = lambda s: ~F.exists(known, lambda b: (s["start"] < b["until"]) & (b["start"] < s["until"]))
    return based.join(_random_spans(docs, rate), "_row", "left").withColumn(
        "random", F.coalesce(F.filter("random", apart), _none()))


def _listed(spans: Column) -> Column:
    """``kind:start:end``, by start, then kind in the order of KINDS."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["until"].alias("until"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["until"].cast("string"))), ",")


def report(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``scan`` as counts, a digest of the base spans and the list of all spans."""
    base = _listed(F.concat("assign", "access", "hex"))
    return scan(docs, rate).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"),
        _listed(F.concat("assign", "access", "hex", "random")).alias("spans"))


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in their own columns, each span (overlapping ones as one) replaced by a mark.

    ``n_chars``, where there is one, is counted anew for the texts that change. The cases are those of
    ``scan``; an empty table gives no rows, and other columns stay, whatever their names.
    """
    found = scan(docs, rate).withColumn("spans", F.array_sort(F.concat(*map(F.col, KINDS)))).where(F.size("spans") > 0)
    spans = settle(found.select("_row", "spans").dropDuplicates(["_row"]), "secret-spans")
    marked = docs.select(whole_row(docs), _row(docs).alias("_row")).join(spans, "_row", "left")
    text = F.col("row.text")
    # A span's own piece is the text since the last span's end, and a mark, if it does not lie in that one.
    ends = F.transform("spans", lambda x: x["until"])
    since = _scan(ends, lambda a, b: F.greatest(a, b), "int")
    cuts = F.zip_with("spans", since, lambda x, last: F.struct(x["start"].alias("start"), last.alias("last")))
    # Finding a place in a long text takes its length, so pieces are taken from the text of a chunk of spans.
    whole = F.transform(_chunks(cuts), lambda c: F.struct(
        c.alias("cuts"), c[0]["last"].alias("at"),
        F.substring(text, c[0]["last"] + 1, F.array_max(F.transform(c, lambda x: x["start"])) - c[0]["last"]).alias("text")))
    pieces = F.transform(whole, lambda w: F.array_join(F.transform(w["cuts"], lambda x: F.when(x["start"] < x["last"], F.lit("")).otherwise(
        F.concat(F.substring(w["text"], x["last"] - w["at"] + 1, x["start"] - x["last"]), F.lit(REDACTED)))), ""))
    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))  # the last span's end is the largest
    spliced = F.concat(F.array_join(pieces, ""), rest)
    return marked.select(with_text(docs, spliced, F.col("spans").isNotNull())).select("row.*")
