"""Document quality by weak supervision: rules vote or abstain, EM weighs them.

Everything a document goes through is a DataFrame or SQL function. The rules'
votes are counted by pattern with a combined aggregate; with R rules there are
at most 3**R patterns whatever the number of documents, and only this small
table comes to the driver, where expectation-maximisation over it estimates
each rule's hit rates in good and in bad documents. The posterior is then an
SQL expression with these rates as literals.

Nulls and empty texts have no words and fail the base checks. Ties need no rule
(no step orders rows), repeated rows are judged alike, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.session import cut

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"
#: Words that end a sentence, and words with a symbol; both are looked for once a word, so long words cost no more.
STOP = r"[.!?][\"')]?(?![^\x20\x09-\x0D])"
MARKED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>]"

#: Very frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it with as was on be by at are this from "
    "der die und das den von zu mit ist des auf für nicht ein eine "
    "le la les et des est que dans pour un une sur au par "
    "el los las en del se por con una para no lo y de"
).split()


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    split = base.select(
        "doc_id",
        "t",
        F.filter(F.split("t", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = split.select("*", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    windows = hashed.withColumn(
        "win",
        F.expr("if(n_words >= 5, transform(sequence(0, cast(n_words as int) - 5), i -> xxhash64(wh[i], wh[i + 1], wh[i + 2], wh[i + 3], wh[i + 4])), array())").cast("array<bigint>"),
    )
    # Positions of windows that occur twice; the sort is reached only if there are any.
    repeated = windows.withColumn("sorted", F.expr("if(size(array_distinct(win)) = size(win), null, sort_array(transform(win, (h, i) -> struct(h as h, i as i))))"))
    repeated = repeated.withColumn(
        "at",
        F.expr("sort_array(transform(filter(sorted, (x, k) -> x.h <=> get(sorted, k - 1).h or x.h <=> get(sorted, k + 1).h), x -> x.i))"),
    )
    return repeated.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(transform(at, (p, k) -> least(5, coalesce(get(at, k + 1) - p, 5))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect(F.transform(F.array_distinct("words"), F.lower), F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("t", F.lit(STOP)).cast("long").alias("n_stops"),
        F.regexp_count("t", F.lit(MARKED)).cast("long").alias("n_marked"),
    )


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The voting rules over ``with_counts``' columns."""
    c = {n: F.col(n).cast("double") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_function", "n_upper", "n_letters", "n_stops", "n_marked")}
    n = F.greatest(c["n_words"], F.lit(1.0))
    mean = c["word_chars"] / n
    return {
        "length": _rule(c["n_words"] < 20, c["n_words"] >= 60),
        "word_size": _rule((mean < 2.5) | (mean > 14), mean.between(3.5, 9)),
        "symbols": _rule(c["n_symbols"] > 0.15 * n, c["n_symbols"] <= 0.01 * n),
        "marked_words": _rule(c["n_marked"] > 0.15 * n, c["n_marked"] == 0),
        "lines": _rule(c["n_dup_lines"] > 0.3 * c["n_lines"], (c["n_dup_lines"] == 0) & (c["n_lines"] >= 2)),
        "repeats": _rule(c["n_repeat_words"] > 0.1 * n, c["n_repeat_words"] <= 0.01 * n),
        "function_words": _rule((c["n_function"] < 2) & (c["n_words"] >= 30), c["n_function"] >= 5),
        "capitals": _rule(c["n_upper"] > 0.4 * c["n_letters"], c["n_upper"] < 0.15 * c["n_letters"]),
        "letters": _rule(c["n_letters"] < 0.65 * c["word_chars"], c["n_letters"] > 0.9 * c["word_chars"]),
        "sentences": _rule((c["n_stops"] * 60 < n) & (c["n_words"] >= 60), c["n_stops"] * 25 >= n),
    }


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.85, start: float = 0.8, weight: float = 10.0) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, number of documents): share of good documents, and per rule the chance
    that its vote is 'good' in a good document and 'bad' in a bad one, given that it votes.

    ``weight`` documents' worth of the starting values are mixed into each estimate, so that
    rules that never vote, and empty tables, keep them. Rates stay between 0.5 and 0.99: a
    rule can lose its say but not turn round.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    rates = [(start, start)] * n_rules
    share = prior
    for _ in range(rounds):
        sums = [[0.0] * 4 for _ in range(n_rules)]
        good_mass = total = 0.0
        for votes, count in patterns:
            p = posterior(votes, share, rates)
            good_mass += count * p
            total += count
            for k, v in enumerate(votes):
                if v:
                    sums[k][0] += count * p
                    sums[k][1] += count * p * (v > 0)
                    sums[k][2] += count * (1 - p)
                    sums[k][3] += count * (1 - p) * (v < 0)
        before = (share, rates)
        share = min(0.99, max(0.5, (good_mass + weight * prior) / (total + weight)))
        rates = [tuple(min(0.99, max(0.5, (s[i + 1] + weight * start) / (s[i] + weight))) for i in (0, 2)) for s in sums]
        if abs(before[0] - share) + sum(abs(a - b) for x, y in zip(before[1], rates, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
    return share, rates


def posterior(votes: Sequence[int], share: float, rates: Sequence[tuple[float, float]]) -> float:
    log_odds = math.log(share / (1 - share))
    for v, (good, bad) in zip(votes, rates, strict=True):
        if v > 0:
            log_odds += math.log(good / (1 - bad))
        elif v < 0:
            log_odds += math.log((1 - good) / bad)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, log_odds))))


def _posterior_column(share: float, rates: Sequence[tuple[float, float]], names: Sequence[str]) -> Column:
    log_odds = F.lit(math.log(share / (1 - share)))
    for name, (good, bad) in zip(names, rates, strict=True):
        log_odds = log_odds + F.when(F.col(name) > 0, F.lit(math.log(good / (1 - bad)))).when(F.col(name) < 0, F.lit(math.log((1 - good) / bad))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-log_odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The contract's counts, every rule's vote (vote_<rule>), the posterior and ``kept``."""
    said = {f"vote_{k}": v for k, v in rules().items()}
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = with_counts(docs).withColumns(said).select("doc_id", *counts, *[F.col(v).cast("tinyint").alias(v) for v in said])
    voted = cut(counted, "votes")
    seen = voted.groupBy(*said).agg(F.count("*").alias("n")).collect()  # at most 3**len(said) rows
    share, rates = fit(sorted((tuple(int(r[v]) for v in said), int(r["n"])) for r in seen))
    if not seen:
        rates = [(0.8, 0.8)] * len(said)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.withColumn("posterior", _posterior_column(share, rates, list(said)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))
        .select("doc_id", *counts, "base_failed", "kept", "posterior", *said)
    )


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
