"""Secret scans: patterns and a randomness test battery, DataFrame functions only.

Base spans come from three patterns (assignments, access keys, hex digests).  The
battery adds spans ``random``: runs of code characters are candidates; each gets the
smallest encoding that holds it (digits, hex, base32, base36, letters and digits,
base64; the first four in one case of either kind, hex also as a UUID) and three
figures under that encoding's alphabet of k symbols:

* ``x2``: chi-squared distance of its symbol counts from uniform counts.  A random
  string has mean k - 1; a word of a language, whose letters have the squared
  frequencies of ``LETTER_EXCESS``, lies higher by excess * (n - 1);
* runs of digits, capitals, small letters and signs (of digits above and below 4.5),
  which ordinary writing changes at a rate of ``CHANGES`` at most, a random string
  more often;
* the serial correlation of neighbouring symbols, at least ``SERIAL`` in writing that
  keeps to a class for a while, 0 in a random string.

Each gives the p-value of ordinary writing looking as random as this; they are
combined as normal scores, weighted by how far writing and random strings lie apart
at that length (runs and serial correlation counted as fully dependent).  Candidates
whose runs or correlation no random string has, or that lack the classes of their
encoding, can't be reported and are no tests.

p-values are judged per stratum of encoding and length by Benjamini-Hochberg at
level ``FDR``: short candidates, where the tests say little, must pass among their
like, and a flood of one kind doesn't loosen the bar of another.  The bar of a
stratum follows from a histogram of its p-values (two small aggregations); no
candidate is moved.

Cases: null text is empty; a document without spans is returned with an empty list
and the digest of the empty string; repeated rows are scanned alike; columns other
than id and text are ignored by the query and passed through by ``scanned``.  Work
per document is linear in its text but for candidates, each held against all base
spans of the text; spans are placed by blocked running sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import let, table, text_of

ASSIGN_RE = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_RE = r"AKIA[A-Z0-9]+"
# runs are maximal and start where none runs already, so shorter ones need no match to be dropped
HEX_RE = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "random")

CANDIDATE_RE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FDR = 0.01
MAX_Z = 3.3  # two-sided bound on runs and serial correlation of a random string
# excess over uniform counts, k * sum of squared symbol frequencies - 1, of the evenest ordinary writing
# (identifiers of many words in mixed case; running text lies higher)
LETTER_EXCESS = {"digits": 0.8, "hex": 0.8, "base32": 0.8, "base36": 1.0, "alnum": 1.6, "base64": 1.8}
# changes of class per neighbouring pair of the most varied ordinary writing, and its least serial correlation
CHANGES = {"digits": 0.5, "hex": 0.25, "base32": 0.2, "base36": 0.2, "alnum": 0.45, "base64": 0.5}
SERIAL = {"digits": 0.0, "hex": 0.1, "base32": 0.0, "base36": 0.0, "alnum": 0.1, "base64": 0.0}
# (name, its strings in capitals where they have one case, alphabet in order); the first that fits is taken
ENCODINGS = (
    ("digits", r"[0-9]+", "0123456789"),
    ("hex", r"[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", r"[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"[A-Z0-9]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("alnum", r"[A-Za-z0-9]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
UUID_RE = r"^(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9A-F]{8}(?:-[0-9A-F]{4}){3}-[0-9A-F]{12})$"
_CLASSES = (("0", "0123456789"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("a", "abcdefghijklmnopqrstuvwxyz"), ("-", "+/-_"))


def _classes(name: str) -> tuple[tuple[str, str], ...]:
    return (("0", "01234"), ("A", "56789")) if name == "digits" else _CLASSES


def random_changes(name: str, letters: str) -> float:
    """Chance that neighbouring symbols of a random string differ in class."""
    return 1 - sum((sum(c in own for c in letters) / len(letters)) ** 2 for _, own in _classes(name))


BINS = 400  # of -ln p, 0.1 each
_BLOCK = 128


def running_starts(lengths: Column) -> Column:
    """Exclusive running sums of an int array, in blocks: O(n * block), not O(n * n)."""

    def within(block: Column, base: Column) -> Column:
        return F.transform(block, lambda _, i: base + F.aggregate(F.slice(block, F.lit(1), i), F.lit(0), lambda t, x: t + x))

    def blocks(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK)))

    def bases(parts: Column) -> Column:  # running sums over block totals
        return F.aggregate(
            parts, F.array(F.lit(0)),
            lambda t, p: F.concat(t, F.array(F.element_at(t, -1) + F.aggregate(p, F.lit(0), lambda a, x: a + x))),
        )

    whole = let(lengths, lambda n: let(blocks(n), lambda p: let(bases(p), lambda b: F.flatten(F.zip_with(p, F.slice(b, F.lit(1), F.size(p)), lambda q, base: let(q, lambda block: within(block, base)))))))
    return whole


def spans_of(text: Column, regex: str, kind: str, keep=None) -> Column:
    """Array of struct(start, order, end, kind, piece) of the matches; code points, end exclusive.

    Text between matches (split) and matches (extract) alternate, so positions are
    running sums of their lengths.
    """
    order = KINDS.index(kind)

    def place(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, regex, -1), F.lit(1), F.size(m)), lambda g: F.length(g))
        steps = F.zip_with(gaps, m, lambda g, x: g + F.length(x))
        return let(
            gaps,
            lambda g: F.zip_with(
                F.zip_with(running_starts(steps), g, lambda s, q: s + q), m,
                lambda s, x: F.struct(s.alias("start"), F.lit(order).alias("ord"), (s + F.length(x)).alias("end"), F.lit(kind).alias("kind"), x.alias("piece")),
            ),
        )

    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,piece:string>>)")
    found = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(place(m)))
    return F.filter(found, keep) if keep else found


def base_spans(text: Column) -> Column:
    value = lambda x: F.regexp_extract(x["piece"], ASSIGN_RE, 2)
    assign = spans_of(text, ASSIGN_RE, "assign", lambda x: F.length(value(x)) >= ASSIGN_MIN)
    access = spans_of(text, ACCESS_RE, "access", lambda x: F.length(x["piece"]) >= ACCESS_MIN)
    return F.array_sort(F.concat(assign, access, spans_of(text, HEX_RE, "hex")))


def _normal_cdf(z: Column) -> Column:
    """Normal distribution function by its logistic approximation (error under 2e-4), stable in both tails."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.070565988)))


def battery(piece: Column) -> Column:
    """struct(encoding, n, p, runs_z, serial_z, mixed) of a candidate."""

    def formed(core: Column) -> Column:
        form = F.when(core.rlike(UUID_RE), F.lit("uuid")).when(core.rlike("^[a-z0-9]*[a-z][a-z0-9]*$"), F.lit("lower")).otherwise(F.lit(""))
        return F.struct(form.alias("form"), core.alias("core"))

    def figures(x: Column) -> Column:
        plain = F.when(x["form"] == "uuid", F.upper(F.replace(x["core"], F.lit("-"), F.lit("")))).when(x["form"] == "lower", F.upper(x["core"])).otherwise(x["core"])
        return let(plain, lambda s: let(_encoding(s), lambda e: _tested(s, e, x["form"])))

    return let(let(F.regexp_replace(piece, "=+$", ""), formed), figures)


def _encoding(s: Column) -> Column:
    encoding = F.lit(None).cast("string")
    for name, regex, _ in reversed(ENCODINGS):
        encoding = F.when(s.rlike(f"^(?:{regex})$"), F.lit(name)).otherwise(encoding)
    return encoding


def _tested(s: Column, e: Column, form: Column) -> Column:
    pick = lambda of: F.create_map(*[x for name, _, letters in ENCODINGS for x in (F.lit(name), F.lit(of(name, letters)))])[e]
    alphabet = pick(lambda _, a: a)
    k = F.length(alphabet).cast("double")
    n = F.length(s).cast("double")
    excess, often, writing, serial = (pick(of) for of in (lambda x, _: LETTER_EXCESS[x], random_changes, lambda x, _: CHANGES[x], lambda x, _: SERIAL[x]))
    symbols = F.split(s, "")
    squares = F.aggregate(
        F.array_distinct(symbols), F.lit(0.0), lambda t, c: t + F.pow((F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0))
    )
    values = F.transform(symbols, lambda c: F.instr(alphabet, c) - (k + 1) / 2)
    products = let(values, lambda v: F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda t, q: t + q))
    fold = lambda name: F.translate(s, "".join(own for _, own in _classes(name)), "".join(c * len(own) for c, own in _classes(name)))
    runs = F.length(F.regexp_replace(F.when(e == "digits", fold("digits")).otherwise(fold("")), r"(.)\1+", "$1"))
    counts = F.struct(squares.alias("squares"), (runs - 1).cast("double").alias("changes"), (products / ((k * k - 1) / 12)).alias("products"))

    def scores(q: Column) -> Column:
        pairs = n - 1
        noncentral = excess * pairs
        sd = F.sqrt(2 * (k - 1) + 4 * noncentral)
        spread = F.sqrt(writing * (1 - writing) * pairs)
        # scores under ordinary writing, low where it looks random, and how far random strings lie from it
        of_counts, w_counts = (k / n * q["squares"] - n - (k - 1 + noncentral)) / sd, noncentral / sd
        of_runs, w_runs = (writing * pairs - q["changes"]) / spread, (often - writing) * pairs / spread
        of_serial, w_serial = q["products"] / F.sqrt(pairs) - serial * F.sqrt(pairs), serial * F.sqrt(pairs)
        z = (w_counts * of_counts + w_runs * of_runs + w_serial * of_serial) / F.sqrt(w_counts * w_counts + (w_runs + w_serial) * (w_runs + w_serial))
        digits = F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))
        upper = F.length(s) - F.length(F.regexp_replace(s, "[A-Z]", ""))
        lower = F.length(s) - F.length(F.regexp_replace(s, "[a-z]", ""))
        mixed = F.when(e == "digits", F.lit(True)).when(e.isin("hex", "base32", "base36"), (digits > 0) & (upper > 0)).otherwise((digits > 0) & (upper > 1) & (lower > 1))
        return F.struct(
            F.concat(e, form).alias("encoding"), n.cast("int").alias("n"), _normal_cdf(z).alias("p"),
            ((q["changes"] - often * pairs) / F.sqrt(often * (1 - often) * pairs)).alias("runs_z"), (q["products"] / F.sqrt(pairs)).alias("serial_z"), mixed.alias("mixed"),
        )

    return let(counts, scores)


def stratum(t: Column) -> Column:
    """Encoding and length class (factor 1.5 from 20 on)."""
    return F.concat_ws("/", t["encoding"], F.floor(F.log(t["n"] / 20.0) / math.log(1.5)).cast("int"))


def candidates(text: Column) -> Column:
    """Array of struct(start, ord, end, kind, stratum, bin, fits) of the tested candidates."""

    def judged(x: Column) -> Column:
        return let(
            battery(x["piece"]),
            lambda t: F.struct(
                x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"), stratum(t).alias("stratum"),
                F.least(F.lit(BINS - 1), F.floor(-F.log(F.greatest(t["p"], F.lit(1e-18))) * 10)).cast("int").alias("bin"),
                (t["mixed"] & (F.abs(t["runs_z"]) <= MAX_Z) & (F.abs(t["serial_z"]) <= MAX_Z)).alias("fits"),
            ),
        )

    return F.transform(spans_of(text, CANDIDATE_RE, "random"), judged)


def bars(tested: DataFrame) -> DataFrame:
    """(stratum, bar): the smallest bin of -ln p that Benjamini-Hochberg accepts at FDR.

    ``tested``: the candidates that can be reported, each a test.  One row per stratum and bin: at most
    BINS per stratum, whatever the documents.
    """
    bins = tested.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    tail = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    m = F.sum("n").over(Window.partitionBy("stratum"))
    # p of the bin's least extreme member against its rank
    ok = F.exp(-F.col("bin") / 10.0) <= F.lit(FDR) * F.sum("n").over(tail) / m
    return bins.withColumn("ok", ok).filter("ok").groupBy("stratum").agg(F.min("bin").alias("bar"))


def scanned(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array column ``out`` of struct(start, ord, end, kind), sorted by start, then kind."""
    text = text_of(text_col)
    tested = docs.select(F.explode(candidates(text)).alias("c")).filter("c.fits").select("c.stratum", "c.bin")
    # a row per encoding and length class (a factor of 1.5): a few dozen at most
    level = {r["stratum"]: r["bar"] for r in bars(tested).collect()}
    bar = F.lit(BINS)
    plain = lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"))

    def passes(c: Column) -> Column:
        known = F.create_map(*[F.lit(v) for pair in level.items() for v in pair]) if level else None
        return c["fits"] & (c["bin"] >= (F.coalesce(F.try_element_at(known, c["stratum"]), bar) if level else bar))

    def together(base: Column) -> Column:
        inside = lambda c: F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
        more = F.filter(candidates(text), lambda c: passes(c) & ~inside(c))
        return F.array_sort(F.concat(F.transform(base, plain), F.transform(more, plain)))

    return docs.withColumn(out, let(base_spans(text), together))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda kinds: F.array_join(
        F.transform(F.filter("spans", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans")
    )
