"""Quality rules, line first, in DataFrame functions only.

Each line is judged alone. It fails without a mark of punctuation at its end, as menus,
headings and word lists do; if bars part it into cells of few words (navigation); if it
matches a boilerplate pattern such as license, copyright and cookie lines; if it has symbols
instead of words; or if it repeats an earlier line. Failed lines are removed. A document is
rejected if the lines removed hold too much of its text, or by the base rules (too few
words, or too many words in repeated three-word windows).

Defined cases: null text is empty and has no words; empty texts fail the base rules; very
long texts are judged whole; of equal lines the first is judged and the others are removed;
null ids are kept and repeated rows judged alike; an empty table gives an empty result;
other columns are carried by `measure` and `clean`, but for those that `measure` adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared
from readloom.llm.shared import let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words in repeated windows
#: A line fails beyond this share of symbols, with cells of so few words, and a document beyond this share of removed characters.
MAX_LINE_SYMBOLS, NAV_WORDS, MAX_REMOVED = 0.2, 3, 0.5
#: What a line of prose ends with, closing quotes and brackets included.
LINE_END = r"""[.!?:;…。！？"'”’»)\]][\x20\x09-\x0D]*\z"""
#: Patterns of boilerplate lines; a parameter.
BOILERPLATE = (
    r"(released|licen[sc]ed|distributed|published|available|provided) under (the |a |an )?[^.]{0,60}licen[sc]e",
    r"licen[sc]ed under",
    r"all rights reserved",
    r"(copyright|\(c\)|©) *(\(c\)|©)? *[0-9]{4}",
    r"terms (of (service|use)|and conditions)",
    r"privacy policy",
    r"(accept|use|uses) (all )?cookies",
    r"(subscribe to|sign up for) (our|the) newsletter",
    r"click here",
    r"(enable|requires?) javascript|javascript is (disabled|required)",
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def without(text: Column, chars: str) -> Column:
    """`text` without the characters of an expression class."""
    return F.regexp_replace(text, chars, "")


def repeated_words(ws: Column) -> Column:
    """Words in three-word windows that occur twice or more in the array `ws`.

    Windows are hashed with 64 bits and sorted with their places, so equal ones are neighbours; the places of
    those, in order, cover min(3, gap to the next) words each.
    """
    zipped = F.arrays_zip(ws.alias("a"), F.slice(ws, 2, F.size(ws)).alias("b"), F.slice(ws, 3, F.size(ws)).alias("c"))
    windows = F.slice(zipped, 1, F.size(ws) - 2)
    hashes = F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def places(h: Column) -> Column:
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)

    def repeated(placed: Column) -> Column:

        hs = F.transform(placed, lambda p: p["h"])
        none = F.array(F.lit(None).cast("bigint"))
        neighbours = F.arrays_zip(placed.alias("x"), F.concat(none, hs).alias("before"), F.concat(F.slice(hs, 2, F.size(hs)), none).alias("after"))
        twice = F.filter(neighbours, lambda n: n["x"].isNotNull() & (F.coalesce(n["x"]["h"] == n["before"], F.lit(False)) | F.coalesce(n["x"]["h"] == n["after"], F.lit(False))))
        return F.sort_array(F.transform(twice, lambda n: n["x"]["i"]))

    def covered(at: Column) -> Column:
        after = F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(2**30)))
        return F.aggregate(F.zip_with(at, after, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda acc, x: acc + x)

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(places(h), covered)))
    return F.when(F.size(ws) < 4, 0).otherwise(counted)


def line_fails(line: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """Whether a line with words fails alone."""
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|")))
    cells = F.regexp_count(F.replace(line, F.lit("|")), F.lit(WORD)) <= NAV_WORDS * (bars + 1)
    phrase = line.rlike("(?i)" + "|".join(boilerplate)) if boilerplate else F.lit(False)
    return ~line.rlike(LINE_END) | (symbols > MAX_LINE_SYMBOLS * F.length(line)) | (F.contains(line, F.lit("|")) & cells) | phrase


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "removed_chars", "clean_text")


def measure(docs: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """`docs`, without columns of these names, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines removed and text kept.

    Adds also line_chars and removed_chars (characters of lines with words, and of those that failed or repeat)
    and clean_text.
    """
    docs = docs.drop(*MEASURES)
    text = shared.text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def judge_lines(ls: Column) -> Column:
        first = F.array_distinct(ls)
        kept = F.filter(first, lambda x: ~line_fails(x, boilerplate))
        total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + F.length(x))
        return F.struct((F.size(ls) - F.size(first)).cast("long").alias("n_dup_lines"), total(ls).alias("line_chars"), total(kept).alias("kept_chars"), F.array_join(kept, "\n").alias("clean_text"))

    by_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words")))
    w, l = (shared.free_name(docs, n) for n in ("of_words", "of_lines"))
    out = docs.withColumn(w, by_words).withColumn(l, let(lines, judge_lines))
    out = out.withColumn("word_chars", F.length(without(text, r"[\x20\x09-\x0D]")).cast("long")).withColumn("n_symbols", (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"))
    out = out.select(*docs.columns, "word_chars", "n_symbols", f"{w}.*", f"{l}.*")
    return out.withColumn("removed_chars", F.col("line_chars") - F.col("kept_chars")).drop("kept_chars")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def kept() -> Column:
    """False if a base rule fails, or the failed lines hold too much of the text."""
    return ~base_failed() & (F.col("removed_chars") <= MAX_REMOVED * F.col("line_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that pass, each with its remaining lines as text."""
    measured = measure(docs.select(F.struct(*docs.columns).alias("__row"), "text")).filter(kept())
    return measured.select(*[F.col("clean_text").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def digest(measured: DataFrame) -> DataFrame:
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept().alias("kept"))
