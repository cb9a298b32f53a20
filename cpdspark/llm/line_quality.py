"""Line-first cleaning: judge every line, remove those that fail, reject texts that lose too much.

Lines are split at ``\\n``. A line with words fails a rule if

- punctuation: a third or more of its words end in doubled marks (``!!``, ``??``) or carry symbols, or
  it is long and has no sentence mark at all;
- navigation: it is a list of links (separators ``|``, ``»``, ``>`` or ``·`` between at least three
  parts), or a few words that are all menu words;
- boilerplate: it has a phrase of notices (cookies, log in, all rights reserved, ...);
- repetition: at least ten words, of which fewer than a third are different.

Lines without words stay and count as no loss. A text is rejected if the removed lines hold more than
``max_loss`` of the characters that are in words, or no line with words is left.

Everything is DataFrame functions within a row: no shuffle, no Python.

Defined cases: a null text has no words, fails the base rules and stays null when cleaned; an empty
text likewise stays empty; every row is judged alone, so repeated rows and null ids need no rule; an
empty table gives no rows; further columns pass through ``clean`` and are left out by ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.llm.names import others

SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    noisy_share: float = 1 / 3  # of words with doubled marks or symbols
    unpunctuated_words: int = 60  # from so many words on a line needs a sentence mark
    separators: int = 3
    menu_words: int = 6  # so many words at most in a menu line
    repeated_from: int = 10
    distinct_share: float = 1 / 3
    max_loss: float = 0.3
    noise: str = r"[!?]{2,}$|[#*$%&<>]{2,}"
    separator: str = r"^[|»>·•]$"
    sentence_mark: str = r"[.!?:;。！？…]"
    menu: str = r"(?i)^(home|menu|about|contact|login|log|in|sign|up|search|next|previous|back|top|share|more|read|faq|help|terms|privacy|policy|subscribe|register)$"
    boilerplate: str = r"(?i)cookie policy|accept (all )?cookies|all rights reserved|terms of (use|service)|privacy policy|enable javascript|javascript is disabled|lorem ipsum|click here|powered by|sign up for our newsletter|please log in"


def words_of(text: Column) -> Column:
    """Maximal runs without white space; an empty array for null."""
    return F.coalesce(F.filter(F.split(text, SPACE), lambda w: w != ""), F.array().cast("array<string>"))


def characters_in_words(text: Column) -> Column:
    return F.length(F.translate(text, _SPACES, "")).cast("long")


def _fails(line: Column, words: Column, rules: LineRules) -> Column:
    n = F.size(words)
    noisy = F.size(F.filter(words, lambda w: w.rlike(rules.noise)))
    parts = F.size(F.filter(words, lambda w: w.rlike(rules.separator)))
    return (
        (noisy >= n * rules.noisy_share)
        | ((n >= rules.unpunctuated_words) & ~line.rlike(rules.sentence_mark))
        | (parts >= rules.separators)
        | ((n <= rules.menu_words) & ~F.exists(words, lambda w: ~w.rlike(rules.menu)))
        | line.rlike(rules.boilerplate)
        | ((n >= rules.repeated_from) & (F.size(F.array_distinct(words)) < n * rules.distinct_share))
    )


def judged_lines(text: Column, rules: LineRules = LineRules()) -> Column:
    """Array of ``(line, n_words, failed)`` in order."""
    split = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words")))
    return F.transform(
        split,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.size(x["words"]).alias("n_words"),
            ((F.size(x["words"]) > 0) & _fails(x["line"], x["words"], rules)).alias("failed"),
        ),
    )


def _verdict(documents: DataFrame, rules: LineRules) -> DataFrame:
    """Add ``_lines``, ``_lost_chars`` and ``_passes`` (the method's own verdict); the table has none of these."""
    judged = documents.withColumn("_lines", judged_lines(F.coalesce("text", F.lit("")), rules))
    failed = F.array_join(F.transform(F.filter("_lines", lambda x: x["failed"]), lambda x: x["line"]), "\n")
    left = F.exists("_lines", lambda x: ~x["failed"] & (x["n_words"] > 0))
    total = characters_in_words(F.coalesce("text", F.lit("")))
    return judged.withColumn("_lost_chars", characters_in_words(failed)).withColumn(
        "_passes", left & (F.col("_lost_chars") <= total * rules.max_loss)
    )


def clean(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, without their failed lines. Reads and returns all columns."""
    columns = documents.columns
    lines = F.filter("_lines", lambda x: ~x["failed"])
    rest = others(columns, "text", "n_chars")  # in one struct, where their names cannot clash
    kept = _verdict(documents.select("text", *([F.struct(*rest).alias("_rest")] if rest else [])), rules).filter("_passes")
    kept = kept.withColumn("text", F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    value = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[value[c].alias(c) if c in value else F.col("_rest")[c].alias(c) for c in columns])


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: the words inside windows of five that the text has twice or more.

    Windows are compared by 64-bit hashes. Only a text in which some window repeats sorts them.
    """
    hashed = rows.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.size("_h") - WINDOW
    hashed = hashed.withColumn(
        "_windows",
        F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    ).withColumn("_any", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("_sorted", F.when(F.col("_any"), pairs))
    # get() is null outside the array
    twice = F.transform(
        "_sorted",
        lambda x, k: F.when(
            (F.get(F.col("_sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), k + 1)["h"] == x["h"]), x["i"]
        ),
    )
    hashed = hashed.withColumn("_at", F.array_sort(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("_at", lambda i, k: F.least(F.lit(WINDOW), F.get(F.col("_at"), k + 1) - i)),
        F.lit(0).cast("long"),
        lambda total, c: total + c,
    )
    return hashed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def measure(documents: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The base figures of every row, what cleaning removes, and the verdict."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_words", words_of(F.col("text")))
    rows = _verdict(_repeated_words(rows), rules)
    with_words = F.transform(F.filter("_lines", lambda x: x["n_words"] > 0), lambda x: x["line"])
    rows = rows.withColumn("_with_words", with_words)
    n_words = F.size("_words").cast("long")
    failed = (n_words < 10) | (F.col("n_repeat_words") * 100 > n_words * 20)
    return rows.select(
        "doc_id",
        n_words.alias("n_words"),
        characters_in_words(F.col("text")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_with_words") - F.size(F.array_distinct("_with_words"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("_passes")).alias("kept"),
        F.col("_lost_chars").alias("lost_chars"),
        F.size(F.filter("_lines", lambda x: x["failed"])).cast("long").alias("n_failed_lines"),
    )
