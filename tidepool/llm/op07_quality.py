"""Quality rules: line-first cleaning, DataFrame functions only.

Each line of a document is judged by three rules; lines that fail are taken
out, and a document that loses too much of its text is rejected:

* punctuation - the line has no letter or digit, or too many symbols
   (``#*$%&|<>``);
* navigation  - four or more short entries between separators, or a few
  menu words and nothing else;
* boilerplate - a line with a stock phrase (cookies, copyright, scripts to be
  enabled, placeholder text), or a line of some length seen before in the
  document.

Before that, the base rule rejects documents of under 10 words and documents in
which over 20 % of the words lie in repeated 5-word windows.

Cases: null text counts as empty text (no words, so the base rule rejects it);
repeated rows are judged alike, row by row; columns other than the text pass
through untouched, whatever their names.  One pass over the rows, no shuffle; a
row's work is O(n log n) in its words.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import let, table, text_of, words_of

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5

# a document is rejected when the failing lines hold more than this share of its characters
MAX_LOST = 0.5
# a line fails when symbols are more than this share of its characters
MAX_SYMBOL_SHARE = 0.15
# repeated lines fail from this many characters on (shorter ones occur in verse, tables, dialogue)
MIN_REPEAT_CHARS = 20
# longer lines are prose, whatever they mention
MENU_CHARS, BOILERPLATE_CHARS = 60, 400
# a menu: this many entries, of at most so many characters on average
MIN_ENTRIES, ENTRY_CHARS = 4, 30

SYMBOLS_RE = r"[#*$%&|<>]+"
HAS_WORD_RE = r"[^\x20\x09-\x0D]"
HAS_LETTER_RE = r"[\p{L}\p{N}]"
SEPARATORS = ("|", "»", "›", "•", "·", "→", "::", ">")
SEPARATORS_RE = r"(?:\||»|›|•|·|→|::|>)"
MENU_RE = (
    r"(?i)^\W*(?:(?:home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|"
    r"previous|prev|back|top|back to top|share|tweet|print|sitemap|faq|help|read more|more|skip to content|"
    r"click here)\b\W*)+$"
)
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "uses cookies",
    "accept cookies", "accept all cookies", "enable javascript", "javascript is disabled", "javascript is required", "lorem ipsum",
    "subscribe to our newsletter", "sign up for our", "follow us on",
)


def n_symbols_of(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS_RE, ""))


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def has_phrase(lower: Column) -> Column:
    return has_any(lower, BOILERPLATE)


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more (first included).

    Rows whose window hashes all differ have none and stop there; equal windows
    always have equal hashes.  The others sort their windows themselves, so the
    result doesn't rest on hashes.
    """

    def windows(w: Column, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: make([F.get(w, i + k) for k in range(WINDOW)], i))

    def covered(s: Column) -> Column:  # s: sorted (window, start)
        n = F.size(s)
        is_repeated = lambda j: (F.get(s, j)["w"] == F.get(s, j - 1)["w"]) | (F.get(s, j)["w"] == F.get(s, j + 1)["w"])
        starts = F.transform(
            F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(is_repeated(j), F.lit(False))), lambda j: F.get(s, j)["i"]
        )
        return let(
            F.sort_array(starts),
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
                F.lit(0),
                lambda t, x: t + x,
            ),
        )

    def exact(w: Column) -> Column:
        return let(
            F.sort_array(windows(w, lambda c, i: F.struct(F.concat_ws(" ", *c).alias("w"), i.alias("i")))), covered
        )

    def gate(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: windows(h, lambda c, i: F.xxhash64(*c)))
        has_repeat = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).when(~has_repeat, F.lit(0)).otherwise(exact(w))

    return let(words, gate)


def bad_line(line: Column, seen: Column, doc: Column) -> Column:
    """True if the line fails a rule.

    ``seen``: an equal line stands before it; ``doc``: whether the whole text has
    symbols, separators and stock phrases at all, so that most lines skip those
    searches.
    """
    chars = F.length(line)
    symbols = F.when(doc["symbols"], n_symbols_of(line)).otherwise(0)
    punctuation = (symbols > chars * MAX_SYMBOL_SHARE) | ~line.rlike(HAS_LETTER_RE)
    entries = let(F.size(F.split(line, SEPARATORS_RE)), lambda n: (n >= MIN_ENTRIES) & (chars <= n * ENTRY_CHARS))
    navigation = ((chars <= MENU_CHARS) & line.rlike(MENU_RE)) | (doc["separators"] & entries)
    boilerplate = (doc["phrase"] & (chars <= BOILERPLATE_CHARS) & has_phrase(F.lower(line))) | (seen & (chars >= MIN_REPEAT_CHARS))
    return line.rlike(HAS_WORD_RE) & (punctuation | navigation | boilerplate)


def judged(docs: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out`` of the base figures, the cleaned text and the verdict.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_bad_lines, lost_chars, base_failed, kept, cleaned (the text without its
    failing lines).
    """
    text = text_of(text_col)

    def seen_before(lines: Column) -> Column:
        # equal lines meet in sorted order: no pair of lines is compared twice
        order = F.sort_array(F.transform(lines, lambda x, i: F.struct(x.alias("l"), i.alias("i"))))
        again = let(
            order,
            lambda s: F.transform(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: F.struct(F.get(s, j)["i"].alias("i"), F.coalesce(F.get(s, j)["l"] == F.get(s, j - 1)["l"], F.lit(False)).alias("seen")),
            ),
        )
        none = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lit(False).alias("seen")))
        return F.when(F.size(lines) == F.size(F.array_distinct(lines)), none).otherwise(F.sort_array(again))

    def judge_lines(lines: Column, doc: Column) -> Column:
        marked = let(seen_before(lines), lambda a: F.zip_with(lines, a, lambda x, s: F.struct(x.alias("l"), bad_line(x, s["seen"], doc).alias("bad"))))
        with_words = F.filter(lines, lambda x: x.rlike(HAS_WORD_RE))
        return let(
            marked,
            lambda m: F.struct(
                let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(m, lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
                F.aggregate(m, F.lit(0), lambda t, x: t + F.when(x["bad"], F.length(x["l"])).otherwise(0)).cast("long").alias("lost_chars"),
                F.array_join(F.transform(F.filter(m, lambda x: ~x["bad"]), lambda x: x["l"]), "\n").alias("cleaned"),
            ),
        )

    def judge_words(words: Column) -> Column:
        return let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0), lambda t, x: t + F.length(x)).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
            ),
        )

    def judge(text: Column) -> Column:
        return let(
            F.struct(
                n_symbols_of(text).cast("long").alias("n_symbols"), has_phrase(F.lower(text)).alias("phrase"), has_any(text, SEPARATORS).alias("separators")
            ),
            lambda d: F.struct(
                judge_words(words_of(text)).alias("words"),
                d["n_symbols"].alias("n_symbols"),
                let(F.struct((d["n_symbols"] > 0).alias("symbols"), d["phrase"].alias("phrase"), d["separators"].alias("separators")), lambda doc: let(F.split(text, "\n"), lambda x: judge_lines(x, doc))).alias("lines"),
                F.length(text).cast("long").alias("chars"),
            ),
        )

    # a generator of one row: no filter on the verdict is pushed below it, where all of this would run once more
    base = docs.select(*[c for c in docs.columns if c != out], F.explode(F.array(let(text, judge))).alias(out))
    q = F.col(out)
    words, lines = q["words"], q["lines"]
    failed = (words["n_words"] < MIN_WORDS) | (words["n_repeat_words"] * 100 > words["n_words"] * MAX_REPEAT_PCT)
    return base.withColumn(
        out,
        F.struct(
            words["n_words"], words["word_chars"], q["n_symbols"], lines["n_dup_lines"], words["n_repeat_words"], lines["n_bad_lines"],
            lines["lost_chars"], lines["cleaned"], failed.alias("base_failed"),
            (~failed & (lines["lost_chars"] <= q["chars"] * MAX_LOST)).alias("kept"),
        ),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bad_lines", "lost_chars", "base_failed", "kept")],
    )
