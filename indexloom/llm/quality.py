"""Quality rules as weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm.common import fresh, let, words
from indexloom.session import written

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for with on by are at from this it was be as an or "
    "der die das und in den von zu mit ist sich des auf für im nicht ein eine als auch dem "
    "de la le et les des en un du une que est pour qui dans par sur au ne se pas avec "
    "el los y del las con una su para al lo como más por no"
).split()


SYMBOLS = "[#*$%&|<>]"


def _count_of(text: Column, *signs: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in signs), F.lit(0)).cast("long")


def _count_in(text: Column, signs: str) -> Column:
    """Characters of a class that most texts have few of."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{signs}+", ""))).cast("long")


def _repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(0), n - 3)
        return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        )

    def spread(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def by_position(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            last = F.size(p) - 1
            same = F.transform(
                p,
                lambda x, k: F.when(
                    ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(p, k + 1)["h"] == x["h"])), x["i"]
                ).otherwise(F.lit(-1)),
            )
            return spread(F.filter(same, lambda i: i >= 0))

        return let(pairs, repeats)

    def covered(h: Column) -> Column:
        # a few repeated windows are looked up, many are sorted together with their places
        several = let(F.sort_array(h), lambda s: F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x)))
        return let(
            F.array_distinct(several),
            lambda d: F.when(
                F.size(d) <= 12,
                spread(
                    F.filter(
                        F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i).otherwise(F.lit(-1))), lambda i: i >= 0
                    )
                ),
            ).otherwise(by_position(h)),
        )

    # a text without a repeated window, as most are, needs no sorting
    return let(hashed(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def _about_words(ws: Column) -> Column:
    """What the rules need of the words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    different = let(
        F.array_distinct(ws),
        lambda d: F.struct(
            F.size(d).cast("long").alias("n_distinct"), F.size(F.array_intersect(d, stop)).cast("long").alias("n_stop")
        ),
    )
    joined = F.array_join(ws, "")
    symbolic = F.filter(ws, lambda w: w.rlike(SYMBOLS))
    return F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.when(joined.rlike(SYMBOLS), F.size(symbolic)).otherwise(0).cast("long").alias("n_symbol_words"),
        _repeated_words(ws).cast("long").alias("n_repeat_words"),
        different.alias("d"),
    )


def _about_lines(text: Column) -> Column:
    def counted(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    full = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(full, counted)


def measures(text: Column) -> Column:
    """All counts of one text as a struct; those of a null text are zero."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(
        _count_in(whole, SYMBOLS).alias("n_symbols"),
        _count_in(whole, "[A-ZÀ-Þ]").alias("n_upper"),
        _count_of(whole, "!").alias("n_shouts"),
        _count_of(whole, ".", "?").alias("n_ends"),
        let(words(whole), _about_words).alias("w"),
        _about_lines(whole).alias("l"),
    )


@dataclass(frozen=True)
class Rules:
    """few_words, repeat_percent: the fixed rules; keep_above: the least posterior; the rest: how the model is fitted."""

    few_words: int = 50
    repeat_percent: int = 50
    keep_above: float = 0.5
    rounds: int = 12
    smoothing: float = 0.002
    settled: float = 0.001
    text_col: str = "text"


def votes(m: Column) -> dict[str, Column]:
    """The rules' votes on a text with these measures.

    Most rules know one kind of bad text and abstain on all others, so that a text is not called good for the faults it
    lacks; each kind of fault is seen by two rules or more. A few rules know good prose.
    """
    n = F.greatest(m["w"]["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(m["w"]["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(m["l"]["n_lines"], F.lit(1)).cast("double")

    def bad(when: Column) -> Column:
        return F.when(when, -1).otherwise(0)

    def good(when: Column) -> Column:
        return F.when(when, 1).otherwise(0)

    w = m["w"]
    return {
        "symbols": bad(m["n_symbols"] / n > 0.1),
        "dense_symbols": bad(m["n_symbols"] / chars > 0.02),
        "symbol_words": bad(w["n_symbol_words"] / n > 0.1),
        "shouts": bad(m["n_shouts"] / n > 0.1),
        "capitals": bad(m["n_upper"] / chars > 0.25),
        "repeats": bad(w["n_repeat_words"] / n > 0.2),
        # different words grow like a power of all words in prose of any length, and stop growing in junk
        "variety": bad(w["d"]["n_distinct"].cast("double") * w["d"]["n_distinct"] < 6 * n),
        "lines": bad((m["l"]["n_dup_lines"] / lines > 0.3) & (m["l"]["n_dup_lines"] > 1)),
        "word_length": bad((chars / n < 2.5) | (chars / n > 15)),
        "stop_words": good(w["d"]["n_stop"] >= 3),
        "sentences": good((m["n_ends"] / n > 0.01) & (m["n_ends"] / n < 0.3)),
        "length": good(w["n_words"] >= 100),
    }


GOOD_RULES = ("stop_words", "sentences", "length")


def _first_guess() -> tuple[float, dict[int, tuple[float, float]]]:
    """Share of good texts; for each vote its chance on a good and on a bad text."""
    return 0.85, {1: (0.5, 0.3), -1: (0.01, 0.25)}


def _log_odds(table: dict[str, tuple[int, tuple[float, float]]], prior: float, vote_of: Callable[[str], Column]) -> Column:
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (vote, (good, bad)) in table.items():
        weight = [math.log(good / bad), math.log((1 - good) / (1 - bad))]
        odds = odds + F.when(vote_of(name) == vote, weight[0]).otherwise(weight[1])
    return odds


def posterior(table: dict[str, tuple[int, tuple[float, float]]], prior: float, vote_of: Callable[[str], Column] = F.col) -> Column:
    """Probability that a text is good, given its votes; `vote_of` gives the vote of a rule."""
    return 1 / (1 + F.exp(-_log_odds(table, prior, vote_of)))


def label_model(voted: DataFrame, sides: dict[str, int], how: Rules = Rules()):
    """Expectation-maximisation: for each rule the chance of its vote on good and on bad texts; the share of good ones.

    `sides` has the vote of each rule's column, 1 or -1. Texts are first counted by their combination of votes (two per
    rule, so the table is bounded whatever the corpus); each round is one aggregation over that table. Chances are
    smoothed towards the first guess, which also says which of the two classes is the good one.
    """
    combinations = written(voted.groupBy(*sides).agg(F.count("*").alias("__n")), "votes")
    prior, guess = _first_guess()
    table = {name: (vote, guess[vote]) for name, vote in sides.items()}
    total = combinations.agg(F.sum("__n")).first()[0] or 0
    strength = how.smoothing * total
    for _ in range(how.rounds if total else 0):
        good = posterior(table, prior) * F.col("__n")
        hits = [
            F.sum(F.when(F.col(name) == vote, c)).alias(f"{name}:{side}")
            for name, vote in sides.items()
            for side, c in (("good", F.col("__g")), ("bad", F.col("__n") - F.col("__g")))
        ]
        got = combinations.withColumn("__g", good).agg(F.sum("__g").alias("good"), *hits).first().asDict()
        got["bad"] = total - got["good"]
        before = dict(table)
        for name, vote in sides.items():
            pair = tuple(
                ((got[f"{name}:{side}"] or 0) + strength * guess[vote][k]) / (got[side] + strength)
                for k, side in enumerate(("good", "bad"))
            )
            table[name] = (vote, pair)
        prior = (got["good"] + strength * prior) / (total + strength)
        moved = max(abs(table[n][1][k] - before[n][1][k]) for n in table for k in (0, 1))
        if moved < how.settled:
            break
    return table, prior


def judged(docs: DataFrame, keep: list[str], at: str, how: Rules = Rules()) -> DataFrame:
    """The columns `keep` of `docs` and one named `at` that holds measures, verdict and posterior of the row's text.

    Two fixed rules reject a text outright: fewer than `few_words` words, or more than `repeat_percent` percent of them
    in repeated windows. All others are judged by the posterior probability of the label model, fitted on every row.
    Null texts count as empty and are rejected; equal texts get equal verdicts; an empty table stays empty; texts of any
    length are measured whole. Columns of `docs` may have any names: those of helpers are chosen beside them.
    """
    name, votes_at = fresh(docs, "__measures"), fresh(docs, "__votes")
    m = F.col(name)
    measured = docs.select(*[F.col(f"`{c}`") for c in keep], measures(F.col(f"`{how.text_col}`")).alias(name))
    rules = {k: v.cast("byte") for k, v in votes(m).items()}
    cast = F.struct(*[v.alias(k) for k, v in rules.items()])
    voted = written(measured.withColumn(votes_at, cast), "quality-measures")
    table, prior = label_model(voted.select(f"{votes_at}.*"), {n: 1 if n in GOOD_RULES else -1 for n in rules}, how)
    n_words = m["w"]["n_words"]
    failed = (n_words < how.few_words) | (100 * m["w"]["n_repeat_words"] > how.repeat_percent * n_words)
    chance = posterior(table, prior, lambda rule: F.col(votes_at)[rule])
    result = F.struct(
        n_words.alias("n_words"),
        m["w"]["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (chance >= how.keep_above)).alias("kept"),
        chance.alias("posterior"),
    )
    return voted.select(*[F.col(f"`{c}`") for c in keep], result.alias(at))


def verdicts(docs: DataFrame, id_col: str = "doc_id", how: Rules = Rules()) -> DataFrame:
    """One row per document: its id, counts, whether a fixed rule failed, verdict and posterior."""
    at = fresh(docs, "__judged")
    return judged(docs, [id_col], at, how).select(id_col, f"{at}.*")


def filtered(docs: DataFrame, how: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with the columns of the input."""
    at = fresh(docs, "__judged")
    return judged(docs, docs.columns, at, how).filter(F.col(at)["kept"]).drop(at)
