"""Quality rules as a short-circuit cascade.

Every rule rejects a document by a few text features. Which rules reject, and the
work that each would take, are counted on a sample; rules are put in order of
rejections per work among the rows that the rules before them leave. A document
leaves the cascade at the first rule that rejects it, so later rules never
compute their features for it. A document is kept if no rule rejects it: the
verdict doesn't depend on the order, hence not on the sample.

Work is counted, not timed, so that the same sample always gives the same order:
a rule states its nanoseconds a row from the row's characters, words and lines.

Defined results: a null text counts as empty (no words), so ``min_words``
rejects it. Rows are judged one by one: repeated rows get the same verdict, null
ids and other null columns play no part, an empty table gives an empty result
(and the rules' given order). Other columns are never looked at, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bind, words

SYMBOLS = r"[#*$%&|<>]"
BULLET = r"^[\x20\x09-\x0D]*[-*\x{2022}\x{B7}\x{25AA}]"
ELLIPSIS = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"
# A word without a letter: ASCII digits and signs only.
NO_LETTER = r"^[\x21-\x40\x5B-\x60\x7B-\x7E]+\z"
WINDOW = 3
# Up to so many different repeated windows of a text are looked for one by one.
FEW_WINDOWS = 32
# Rows that work and selectivity are estimated on; the verdict doesn't depend on them.
SAMPLE_ROWS = 2048

# Nanoseconds a character or word (see ``default_rules``), as timed on one core after the words were cut; only the order depends on them.
WORK = {
    "repeated_words": 1200.0,
    "symbols": 20.0,
    "dup_lines": 25.0,
    "word_length": 100.0,
    "bullets": 20.0,
    "ellipses": 80.0,
    "no_letter": 150.0,
    "top_word": 400.0,
}

# What ``report`` gives of every row.
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

Features = Callable[[str], Column]


def _lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeated_windows(w: Column) -> Column:
    """Sorted starts of the windows of words that are found twice or more in ``w``."""
    empty = F.array().cast("array<int>")
    # Only hashes are compared and sorted; the last windows of the transform are short.
    hashed = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])), F.lit(1), F.size(w) - WINDOW + 1)

    def starts(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), empty).otherwise(bind(_repeated(h), lambda r: placed(h, r)))

    def placed(h: Column, repeated: Column) -> Column:
        few = F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)))
        return F.when(F.size(repeated) <= FEW_WINDOWS, few).otherwise(_starts_by_sort(h))

    return F.when(F.size(w) > WINDOW, bind(hashed, starts)).otherwise(empty)


def _repeated(h: Column) -> Column:
    """The different values that stand twice or more in an array."""
    return bind(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))))


def _starts_by_sort(h: Column) -> Column:
    """The same starts where many different windows are repeated: hashes are sorted with their places."""

    def repeated(s: Column) -> Column:
        found = F.filter(
            s,
            lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    return bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)


def _covered(starts: Column) -> Column:
    """Words in the windows at these sorted starts, each counted once."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def _top_count(w: Column) -> Column:
    """How often the most frequent word occurs."""

    def longest_run(s: Column) -> Column:
        ends = F.array_compact(F.transform(s, lambda x, k: F.when(~F.equal_null(x, F.get(s, k + 1)), k + 1)))
        return bind(ends, lambda e: F.array_max(F.transform(e, lambda x, j: x - F.coalesce(F.get(e, j - 1), F.lit(0)))))

    return F.coalesce(bind(F.sort_array(F.transform(w, lambda x: F.xxhash64(x))), longest_run), F.lit(0)).cast("long")


def _count(values: Column, pattern: str) -> Column:
    return F.size(F.filter(values, lambda x: x.rlike(pattern))).cast("long")


def features(text: Column, split: Column | None = None) -> dict[str, Column]:
    """Every feature as an expression over the text; ``split`` is the text's words where they are at hand."""
    w = words(text) if split is None else split
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(_lines(text)).cast("long"),
        "n_dup_lines": bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": bind(w, lambda x: _covered(_repeated_windows(x))),
        "n_bullets": _count(_lines(text), BULLET),
        "n_ellipses": _count(_lines(text), ELLIPSIS),
        "n_no_letter": _count(w, NO_LETTER),
        "n_top_word": _top_count(w),
    }


def _with_words(text: Column, body: Callable[[Features], Column]) -> Column:
    """``body`` of the text's features, where the words are cut once and each feature is computed when it is asked for."""
    return bind(words(text), lambda w: body(features(text, w).__getitem__))


@dataclass(frozen=True)
class Work:
    """Nanoseconds of one core that a rule takes a character, a word and a row."""

    per_char: float = 0.0
    per_word: float = 0.0
    per_row: float = 100.0


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], Column]
    work: Work = Work(per_char=10.0)


@dataclass(frozen=True)
class Outcome:
    """Sampled rows that the same rules reject: which, how many rows, and the rows' total work for each rule."""

    rejected: tuple[bool, ...]
    rows: int
    work: tuple[float, ...]


def default_rules(
    min_words: int = 50,
    max_repeated_pct: int = 50,
    max_symbols_pct: int = 25,
    max_dup_lines_pct: int = 50,
    word_length: tuple[int, int] = (2, 20),
    max_bullets_pct: int = 90,
    max_ellipses_pct: int = 30,
    max_no_letter_pct: int = 50,
    max_top_word_pct: int = 30,
) -> tuple[Rule, ...]:
    """Length, repeated windows, symbols per word, repeated lines, mean word length, lines that are bullets or break
    off, words without a letter, one word over and over; percentages are exact integers."""
    shortest, longest = word_length

    def share(part: str, of: str, most: int) -> Callable[[Features], Column]:
        return lambda f: 100 * f(part) > most * f(of)

    return (
        Rule("min_words", lambda f: f("n_words") < min_words, Work()),
        Rule("repeated_words", share("n_repeat_words", "n_words", max_repeated_pct), Work(per_word=WORK["repeated_words"])),
        Rule("symbols", share("n_symbols", "n_words", max_symbols_pct), Work(per_char=WORK["symbols"])),
        Rule("dup_lines", share("n_dup_lines", "n_lines", max_dup_lines_pct), Work(per_char=WORK["dup_lines"])),
        Rule(
            "word_length",
            lambda f: (f("word_chars") < shortest * f("n_words")) | (f("word_chars") > longest * f("n_words")),
            Work(per_word=WORK["word_length"]),
        ),
        Rule("bullets", share("n_bullets", "n_lines", max_bullets_pct), Work(per_char=WORK["bullets"])),
        Rule("ellipses", share("n_ellipses", "n_lines", max_ellipses_pct), Work(per_char=WORK["ellipses"])),
        Rule("no_letter", share("n_no_letter", "n_words", max_no_letter_pct), Work(per_word=WORK["no_letter"])),
        Rule("top_word", share("n_top_word", "n_words", max_top_word_pct), Work(per_word=WORK["top_word"])),
    )


def estimate(
    docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[Outcome]:
    """What the rules do to a random sample of about ``sample_rows`` rows, in one pass."""
    texts = docs.select(F.col(text_col).alias("text"))
    total = texts.count()
    sample = texts.sample(min(1.0, sample_rows / max(total, 1)), seed)

    def judged(f: Features) -> Column:
        chars = F.coalesce(F.length("text"), F.lit(0))
        work = [r.work.per_row + r.work.per_char * chars + r.work.per_word * f("n_words") for r in rules]
        return F.struct(
            F.array(*[F.coalesce(r.rejects(f), F.lit(False)) for r in rules]).alias("rejected"), F.array(*work).alias("work")
        )

    rows = sample.select(_with_words(F.col("text"), judged).alias("row")).groupBy("row.rejected")
    # At most as many groups as sampled rows.
    found = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("row.work", F.lit(k))).alias(f"w{k}") for k in range(len(rules))])
    return [Outcome(tuple(r[0]), r[1], tuple(r[2:])) for r in found.collect()]


def in_order(rules: Sequence[Rule], outcomes: Sequence[Outcome]) -> list[Rule]:
    """Most rejections per work among the rows left first; ties in the given order."""
    left, open_rules, ordered = list(outcomes), list(range(len(rules))), []
    while open_rules:

        def worth(k: int) -> float:
            work = sum(o.work[k] for o in left)
            return sum(o.rows for o in left if o.rejected[k]) / work if work else 0.0

        best = max(open_rules, key=lambda k: (worth(k), -k))
        open_rules.remove(best)
        ordered.append(rules[best])
        left = [o for o in left if not o.rejected[best]]
    return ordered


def rejected_by(rules: Sequence[Rule], feature: Features) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't computed."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.rejects(feature), F.lit(rule.name))
    return verdict.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text") -> Column:
    """The cascade over ``text_col``, its rules ordered by estimates on ``docs``."""
    rules = default_rules() if rules is None else rules
    ordered = in_order(rules, estimate(docs, rules, text_col))
    return _with_words(F.col(text_col), lambda f: rejected_by(ordered, f))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their columns as they are."""
    return docs.where(judge(docs, rules, text_col).isNull())


def report(
    docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ``BASE`` features and the verdict of every row.

    These features are columns here, as they are asked for; the cascade reads
    them. It computes those of its other rules for the rows that get there.
    """
    rules = default_rules() if rules is None else rules
    ordered = in_order(rules, estimate(docs, rules, text_col))
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("w", words(F.col("text")))
    found = features(F.col("text"), F.col("w"))
    measured = split.select("doc_id", "text", "w", *[found[name].alias(name) for name in BASE])
    lazy = features(F.col("text"), F.col("w")) | {name: F.col(name) for name in BASE}
    return measured.select("doc_id", *BASE, rejected_by(ordered, lazy.__getitem__).alias("rejected_by"))
