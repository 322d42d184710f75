"""Line-first quality rules (DataFrame functions only).

Every line is judged by itself: punctuation (a sentence must end a short one), navigation
(menu separators, or many short pieces) and boilerplate (phrases that sites repeat, where
the line is short or they make up a share of it).
Lines that fail go.  A document goes if its statistics fail (``base_failed``) or if
the failed lines held more than ``max_lost`` of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import SPACE, as_row, unpacked, word_count, word_list

#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "this site uses cookies",
    "we use cookies",
    "use of cookies",
    "cookie policy",
    "cookie settings",
    "accept all cookies",
    "privacy policy",
    "terms of service",
    "terms of use",
    "terms and conditions",
    "enable javascript",
    "javascript is disabled",
    "browser does not support",
    "click here",
    "read more",
    "learn more about our",
    "skip to content",
    "skip to main",
    "back to top",
    "share on facebook",
    "share on twitter",
    "follow us on",
    "like us on",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "enter your email",
    "log in to",
    "create an account",
    "add to cart",
    "free shipping",
    "leave a comment",
    "post a comment",
    "powered by",
    "lorem ipsum",
)
#: Every phrase holds one of these: a text without any is searched for no phrase.
STEMS = (
    "cookie", "rights reserved", "privacy policy", "terms ", "javascript", "does not support", "click here", "read more", "learn more", "skip to", "back to top",
    "share on", "us on", "newsletter", "enter your", "log in", "an account", "add to cart", "free ship", "a comment", "powered by", "lorem",
)
#: A phrase fails a long line only if there is one for so many of its words.
WORDS_OF_PHRASE = 8
#: A line passes if it ends like a sentence, closing quotes and brackets allowed,
SENTENCE_END = r"[.!?…。！？:;;][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
#: or is longer than headings and menu entries are (in words).
LONG = 15
#: Pieces between these make a line a menu.
MENU = r"[|•·›»>][\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words")
#: Share of a document's words that failing lines may hold.
MAX_LOST = 0.5


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever loops it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _may_hold_phrases(lowered: Column) -> Column:
    found = F.contains(lowered, F.lit(STEMS[0]))
    for stem in STEMS[1:]:
        found = found | F.contains(lowered, F.lit(stem))
    return found


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def line_passes(line: Column, words: Column | None = None, symbols: Column | None = None, phrased: Column | None = None) -> Column:
    """Whether a line of ``words`` words stays. A line without words stays: it holds nothing to lose.

    The cheapest tests come first, and the patterns run on the lines that these leave
    open; phrases are only looked for where ``phrased`` says that there may be some.
    """
    words = word_count(line) if words is None else words
    symbols = symbol_count(line) if symbols is None else symbols
    menus = F.regexp_count(line, F.lit(MENU))
    menu = (menus > 0) & (menus * 3 >= words)
    phrases = F.regexp_count(F.lower(line), F.lit("|".join(BOILERPLATE)))
    boilerplate = (phrases > 0) & ((words < LONG) | (phrases * WORDS_OF_PHRASE >= words))
    if phrased is not None:
        boilerplate = phrased & boilerplate
    return (words == 0) | (((words >= LONG) | line.rlike(SENTENCE_END)) & (symbols <= words) & ~menu & ~boilerplate)


def _repeated(df: DataFrame) -> DataFrame:
    """Adds __repeat: words in 3-word windows that occur twice or more in __words.

    A window's first word stands for it: the windows of equal hash are adjacent once
    sorted, and a window adds as many words as it lies beyond the one before, 3 at most.
    """
    n = F.size("__words")
    at = lambda i: F.get("__words", i.cast("int"))
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    df = df.withColumn("__windows", F.when(n >= 4, windows))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pairs = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(repeats, F.sort_array(pairs)))
    same = lambda x, i: F.get("__sorted", i)["h"] == x["h"]
    again = F.transform("__sorted", lambda x, i: F.when(F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)), x["i"]))
    df = df.withColumn("__again", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.filter(again, lambda i: i.isNotNull()))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    total = F.aggregate("__again", start, step, lambda acc: acc["n"])
    return df.withColumn("__repeat", F.coalesce(total, F.lit(0).cast("long"))).drop("__windows", "__sorted", "__again")


def judge(docs: DataFrame, *, max_lost: float = MAX_LOST) -> DataFrame:
    """``row`` (all columns of ``docs``), the columns of its judgement, and ``clean``, the text without its failed lines.

    The judgement is n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lost_words, kept.  A null or empty text has no words, so it fails.
    Rows are judged one by one: equal rows get equal results, and an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(as_row(docs).alias("row"), text.alias("__text"), word_list(F.col("text")).alias("__words"))
    df = _repeated(df).drop("__words")
    # words don't cross lines, so each is counted once, with its line
    counted = F.transform(F.split("__text", "\n"), lambda x: F.struct(x.alias("line"), word_count(x).alias("n"), symbol_count(x).alias("symbols")))
    df = df.withColumn("__counted", counted)
    good = lambda x, p: line_passes(x["line"], x["n"], x["symbols"], p)
    judged = lambda p: F.transform("__counted", lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), x["symbols"].alias("symbols"), good(x, p).alias("good")))
    df = df.withColumn("__judged", _once(_once(F.lower("__text"), _may_hold_phrases), judged))
    total = lambda lines, what="n": F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + x[what])
    spoken = F.transform(F.filter("__judged", lambda x: x["n"] > 0), lambda x: x["line"])
    df = df.withColumns({"__n": total("__judged"), "__spoken": spoken})
    df = df.withColumn("__lost", total(F.filter("__judged", lambda x: ~x["good"])))
    failed = (F.col("__n") < 50) | (100 * F.col("__repeat") > 50 * F.col("__n"))
    found = {
        "n_words": F.col("__n"),
        "word_chars": F.length(F.regexp_replace("__text", SPACE + "+", "")).cast("long"),
        "n_symbols": total("__judged", "symbols"),
        "n_dup_lines": (F.size("__spoken") - F.size(F.array_distinct("__spoken"))).cast("long"),
        "n_repeat_words": F.col("__repeat"),
        "base_failed": failed,
        "n_lost_words": F.col("__lost"),
        "kept": ~failed & (F.col("__lost") <= F.lit(max_lost) * F.col("__n")),
        "clean": F.array_join(F.transform(F.filter("__judged", lambda x: x["good"]), lambda x: x["line"]), "\n"),
    }
    # a generator gives the results out: a later filter on them stays above it, where else
    # it would be pushed down and copies of their expressions evaluated for every word
    return df.select("row", F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))


def quality(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, the statistics, base_failed, kept, n_lost_words.

    Needs doc_id and text; other columns are ignored, whatever their names.
    """
    judged = judge(docs.select("doc_id", "text"), **options)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"]
    return judged.select(F.col("row.doc_id").alias("doc_id"), *names)


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, without their failed lines; same columns, n_chars counted anew.

    Needs text; other columns pass through, whatever their names.  Documents with a null
    or empty text go, repeated rows all stay or all go, an empty table stays empty.
    """
    judged = judge(docs, **options).filter("kept")
    return unpacked(judged, docs.columns, {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")})
