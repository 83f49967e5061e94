"""Line-first cleaning: rules per line, failing lines go, documents that lose too much go.

Only SQL functions; a document's words and lines live in arrays of its own row, so nothing is
shuffled.  A line with a word fails where one of these holds:

* punctuation: symbols ``#*$%&|<>`` make more than a tenth of its characters other than white
  space, or a quarter of its words carry doubled ``!`` or ``?``;
* shouting: at least four words and twenty letters' worth of text, all in capitals;
* navigation: at least two separators standing alone between words, one for each four words;
* boilerplate: at most 40 words and one of the phrases of notices, consent banners and page furniture.

Null text is empty: all counts 0, failed for lack of words.  Lines without a word are kept and
never counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrosheaf.llm.tables import SPACE, WORD, body

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50      # per cent of words in repeated three-word windows
MOST_LOST = 30          # per cent of word characters in failing lines
BLANK = " \t\n\x0b\x0c\r"
SEPARATORS = "(^| )[|»›·•>]( |$)"
NOTICES = (
    "all rights reserved", "licensed under", "released under the", "terms of (use|service)", "privacy policy",
    "cookie (policy|settings|consent)", "accept (all )?cookies", "we use cookies", "enable javascript",
    "subscribe to (our|the) newsletter", "sign up for", "click here to", "share (this )?on (facebook|twitter|x|linkedin)",
    "skip to (main )?content", "powered by", "copyright ©", "copyright \\(c\\)", "© [0-9]{4}",
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _chars(text: Column) -> Column:
    return F.char_length(F.translate(text, BLANK, ""))


def line_fails(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(WORD))
    solid = _chars(line)
    symbols = F.regexp_count(line, F.lit("[#*$%&|<>]"))
    loud = F.regexp_count(line, F.lit("[!?]{2,}"))
    shouting = (line == F.upper(line)) & (line != F.lower(line)) & (n >= 4) & (solid >= 20)
    furniture = (F.regexp_count(line, F.lit(SEPARATORS)) >= 2) & (F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= n)
    notice = (n <= 40) & F.rlike(F.lower(line), F.lit("|".join(NOTICES)))
    return (symbols * 10 > solid) | ((loud * 4 >= n) & (loud > 0)) | shouting | furniture | notice


def _repeated(words: str, hashes: str) -> Column:
    """Words inside three-word windows that occur twice or more in the document."""
    at = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twin = F.filter(
        F.transform(F.col("_sorted"), lambda x, k: F.when(
            (x["h"] == F.get(F.col("_sorted"), k - 1)["h"]) | (x["h"] == F.get(F.col("_sorted"), k + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    return at, F.size(F.array_distinct(F.flatten(F.transform(twin, lambda i: F.array(i, i + 1, i + 2)))))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and ``lost_chars`` (word characters in failing lines)."""
    lines = F.filter(F.split(body(), "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    tri = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.xxhash64(F.get(F.col("_words"), i), F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)),
    ))
    at, covered = _repeated("_words", "_tri")
    return (
        docs.withColumn("_words", words_of(body()))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("_tri", tri)
        .withColumn("_twice", F.size(F.array_distinct("_tri")) < F.size("_tri"))
        .withColumn("_sorted", F.when(F.col("_twice"), at))
        .withColumn("n_repeat_words", F.when(F.col("_twice"), covered).otherwise(0).cast("bigint"))
        .drop("_words", "_tri", "_sorted", "_twice")
        .withColumn("_lines", lines)
        .withColumns({
            "word_chars": _chars(body()).cast("bigint"),
            "n_symbols": F.regexp_count(body(), F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "lost_chars": F.aggregate(
                F.filter("_lines", line_fails), F.lit(0).cast("bigint"), lambda a, x: a + _chars(x)),
        })
        .drop("_lines")
    )


def judged(docs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return measured(docs).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MOST_LOST)
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that stay, their text without the failing lines; columns of ``docs``."""
    names = docs.columns
    lines = F.filter(F.split(body(), "\n"), lambda x: ~(F.rlike(x, F.lit(WORD)) & line_fails(x)))
    return judged(docs).filter("kept").withColumn("text", F.array_join(lines, "\n")).select(*names)
