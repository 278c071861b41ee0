"""Quality rules as weak supervision, with DataFrame functions only.

Rules vote good or bad, or abstain.  The counts of vote patterns over the whole table, of which there are at most
three to the number of rules, feed an expectation-maximisation that estimates each rule's accuracy and how many
texts are good; the posterior probability of "good" under these replaces a demand that all rules pass.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no word and fail the base rules; an empty table gives an
empty result.  Repeated rows are judged each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.llm.shared import stored

SYMBOLS = r"[#*$%&|<>]"
GOOD, BAD = 1, -1
#: Steps of the expectation-maximisation, and the change at which it ends.
EM_STEPS, EM_CHANGE = 200, 1e-9
#: Prior weight of a rule's starting accuracy, in votes, and share of good texts to start from.
PRIOR_VOTES, PRIOR_ACCURACY, PRIOR_GOOD = 10.0, 0.8, 0.8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns named by ``keep`` and counts of each whole text, without a shuffle.

    Windows of five words are compared by 64-bit hashes first; only in texts where two hashes agree are the words
    themselves compared, so that no collision counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, text.alias("t"), words.alias("w"))
    rows = rows.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col("h"), i + k)
    windows = F.when(F.size("h") >= 5, F.transform(F.sequence(F.lit(0), F.size("h") - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)])))
    rows = rows.withColumn("g", windows)
    maybe = F.col("g").isNotNull() & (F.size(F.array_distinct("g")) < F.size("g"))
    # Where hashes repeat: windows' words with their places, sorted, so that equal windows are neighbours.
    spelled = F.when(maybe, F.sort_array(F.transform("g", lambda _, i: F.struct(F.array_join(F.slice("w", i + 1, 5), " ").alias("s"), i.alias("i")))))
    rows = rows.withColumn("sp", spelled)
    same = lambda a, b: F.coalesce(F.get("sp", a)["s"] == F.get("sp", b)["s"], F.lit(False))
    repeated = F.filter(F.transform("sp", lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda x: x.isNotNull())
    rows = rows.withColumn("r", F.sort_array(repeated))
    covered = F.aggregate(F.transform("r", lambda x, j: F.least(F.lit(5), F.coalesce(F.get("r", j + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.split("t", "\n")
    rows = rows.withColumn("lines", F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rest = lambda pattern: F.length(F.regexp_replace("t", pattern, ""))
    return rows.select(
        "doc_id",
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        rest(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        rest(r"[^\p{L}]+").cast("long").alias("n_letters"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, GOOD).when(bad, BAD).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: each votes good (1) or bad (-1), or abstains (0) between its two bounds or where it can't tell."""
    n = F.col("n_words")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "length": _vote(n >= 30, n < 10),
        "repeats": _vote(share("n_repeat_words", "n_words") <= 0.05, share("n_repeat_words", "n_words") > 0.2),
        "symbols": _vote(share("n_symbols", "n_words") <= 0.05, share("n_symbols", "n_words") > 0.5),
        "symbol_chars": _vote(share("n_symbols", "word_chars") <= 0.01, share("n_symbols", "word_chars") > 0.1),
        "letters": _vote(share("n_letters", "word_chars") >= 0.9, share("n_letters", "word_chars") < 0.6),
        "word_length": _vote(share("word_chars", "n_words").between(2.5, 12), ~share("word_chars", "n_words").between(1.5, 25)),
        "lines": F.when(F.col("n_lines") >= 3, _vote(share("n_dup_lines", "n_lines") <= 0.1, share("n_dup_lines", "n_lines") > 0.4)).otherwise(0),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], k: int) -> tuple[float, list[tuple[float, float]]]:
    """Share of good texts, and for each of ``k`` rules the shares of right votes on good and on bad texts, from pattern counts.

    A rule's votes are taken as independent given the text's class; abstentions say nothing.  Starting accuracies
    count as ``PRIOR_VOTES`` votes of each class, so a rule that never votes keeps them.
    """
    good, rules = PRIOR_GOOD, [(PRIOR_ACCURACY, PRIOR_ACCURACY)] * k
    total = sum(n for _, n in patterns)
    for _ in range(EM_STEPS if total else 0):
        weights = [n * _posterior(v, good, rules) for v, n in patterns]
        new = []
        for j in range(k):
            right_good, all_good = PRIOR_VOTES * PRIOR_ACCURACY, PRIOR_VOTES
            right_bad, all_bad = PRIOR_VOTES * PRIOR_ACCURACY, PRIOR_VOTES
            for (v, n), w in zip(patterns, weights, strict=True):
                if v[j]:
                    all_good, all_bad = all_good + w, all_bad + n - w
                    right_good += w if v[j] == GOOD else 0
                    right_bad += n - w if v[j] == BAD else 0
            new.append((right_good / all_good, right_bad / all_bad))
        new_good = (sum(weights) + PRIOR_VOTES * PRIOR_GOOD) / (total + PRIOR_VOTES)
        change = max([abs(new_good - good), *(abs(a - b) for x, y in zip(new, rules, strict=True) for a, b in zip(x, y, strict=True))])
        good, rules = new_good, new
        if change < EM_CHANGE:
            break
    return good, rules


def _posterior(pattern: tuple[int, ...], good: float, rules: list[tuple[float, float]]) -> float:
    odds = math.log(good) - math.log(1 - good) + sum(_weight(v, *r) for v, r in zip(pattern, rules, strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def _weight(vote: int, on_good: float, on_bad: float) -> float:
    """Log odds that a vote adds."""
    return math.log(on_good / (1 - on_bad)) if vote == GOOD else math.log((1 - on_good) / on_bad)


def judged(counts: DataFrame, least: float = 0.5) -> DataFrame:
    """``counts`` (a table that is cheap to read twice) with ``quality``, ``base_failed`` and ``kept``."""
    rules = votes()
    voted = counts.select("*", *[c.cast("int").alias(f"_vote_{r}") for r, c in rules.items()])
    names = [f"_vote_{r}" for r in rules]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]
    good, fitted = fit_rules(patterns, len(names))
    odds = F.lit(math.log(good) - math.log(1 - good))
    for name, rule in zip(names, fitted, strict=True):
        odds = odds + F.when(F.col(name) == GOOD, _weight(GOOD, *rule)).when(F.col(name) == BAD, _weight(BAD, *rule)).otherwise(0.0)
    scored = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop(*names)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality`` of each text."""
    done = judged(stored(features(docs, id_col, text_col), "quality"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns as they are.

    Texts and counts are stored together once, so that the second pass, which knows the rules' accuracies, neither
    counts again nor shuffles texts.
    """
    counted = stored(features(docs.select(F.struct("*").alias("_doc")), "_doc.doc_id", "_doc.text", ("_doc",)), "quality-docs")
    return judged(counted).where("kept").select("_doc.*")
