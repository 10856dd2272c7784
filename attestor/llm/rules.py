"""Quality rules as a short-circuit cascade, with DataFrame functions alone.

Each rule is a condition that rejects a document. Its cost and its share of rejected documents
are estimated on a bounded sample; the cascade then tries rules in falling order of rejection
per cost and stops at the first that rejects, so dear rules see few documents. The verdict does
not depend on the order, only the effort and the name of the rule that rejected do.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import BLANKS, prepared, stored, texts

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
_SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words, runs of characters that are no blanks."""
    return F.filter(F.split(text, _SPLIT), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def duplicate_lines(text: Column) -> Column:
    """How many lines with a word are equal to an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
               lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that occur at least twice.

    Windows are sorted by hash and position, so equal ones are neighbours; the positions of
    repeated ones are sorted again and each adds the words that the one before does not cover.
    """
    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                                        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        repeated = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(repeated, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                           lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
                           lambda a: a["n"])

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0))
               .otherwise(let(windows(w), lambda s: let(positions(s), covered))))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", **more: Column) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of whole texts.

    A null or empty text has no words and all counts are 0. Repeated rows give repeated rows, a
    null key stays null, other columns are ignored. ``more`` are further columns over ``text``.
    """
    t = F.col("text")
    plain = texts(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    return plain.select("doc_id", word_array(t).alias("_w"), word_chars(t).cast("bigint").alias("word_chars"),
                        count_chars(t, SYMBOLS).cast("bigint").alias("n_symbols"),
                        duplicate_lines(t).cast("bigint").alias("n_dup_lines"), *[c.alias(k) for k, c in more.items()]).select(
        "doc_id", F.size("_w").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("_w")).cast("bigint").alias("n_repeat_words"), *more)


@dataclass(frozen=True)
class Rule:
    """A name, the condition that rejects, and the feature that must be computed for it."""
    name: str
    rejects: Column
    needs: Column


def standard_rules(text: str = "text") -> list[Rule]:
    """The rules over a text: short, repetitive, symbols, repeated lines, odd mean word length."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, chars = F.size(word_array(t)), word_chars(t)
    symbols, lines, repeats = count_chars(t, SYMBOLS), duplicate_lines(t), repeated_words(word_array(t))
    return [Rule("short", n < 50, n), Rule("repetitive", 100 * repeats > 50 * n, repeats),
            Rule("symbols", 10 * symbols > n, symbols),
            Rule("lines", 5 * lines > n, lines),
            Rule("word_length", (chars < 2 * n) | (chars > 15 * n), chars)]


def ordered(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per row, share rejected) by falling rejection per cost.

    Both are measured on about ``sample_rows`` rows at most, taken by a hash of the row and written
    to a table of their own, so no text comes to the driver; an empty sample leaves the given order.
    """
    n = docs.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = docs.filter(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = stored(drawn.limit(sample_rows).coalesce(1), "rules-sample")
    n_rows = sample.count()
    if not n_rows:
        return [(r, 0.0, 0.0) for r in rules]
    shares = sample.agg(*[F.avg(r.rejects.cast("int")).alias(str(i)) for i, r in enumerate(rules)]).first()
    measured = []
    for i, r in enumerate(rules):
        start = time.perf_counter()
        sample.agg(F.sum(r.needs.cast("bigint"))).collect()
        measured.append((r, (time.perf_counter() - start) / n_rows, float(shares[i] or 0)))
    return sorted(measured, key=lambda m: -m[2] / max(m[1], 1e-9))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules are not computed then."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def filtered(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their columns as they are."""
    rules = rules or standard_rules()
    order = [r for r, _, _ in ordered(docs, rules, sample_rows)]
    return docs.filter(cascade(order).isNull())


def digest(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The features of every document, the base verdict, and the verdict of the cascade over its text."""
    prepared(docs.sparkSession)
    order = [r for r, _, _ in ordered(texts(docs), standard_rules(), sample_rows)]
    n = F.col("n_words")
    return (features(docs, kept=cascade(order).isNull())
            .withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
