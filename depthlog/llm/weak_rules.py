"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how often each is
right, and the posterior probability of quality decides. DataFrame functions only.

Input: documents with doc_id and text. Defined cases: a null or empty text has no words and fails the base rule; a
repeated row is judged each time; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from depthlog.operators.staging import stage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: How often a rule votes against, for, or abstains (Dirichlet means), on good and on bad documents: a rule is believed
#: to be better than chance, so that the two classes cannot change places. Then the prior's weight in documents.
ON_GOOD, ON_BAD, PRIOR_WEIGHT, PRIOR_QUALITY = (0.01, 0.79, 0.2), (0.25, 0.55, 0.2), 20.0, 0.85
AGAINST, FOR, ABSTAINS = 0, 1, 2


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the base rule and the votes use; native functions over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = split.select("*", F.when(F.size("words") >= 8, F.transform(
        F.sequence(F.lit(1), F.size("words") - 7), lambda i: F.xxhash64(F.slice("words", i, 8)))).otherwise(
        F.array().cast("array<bigint>")).alias("windows"))
    return hashed.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[!?]{2}")).cast("long").alias("n_shouts"),
        F.regexp_count("text", F.lit(r"[.,;:](?=\s|$)")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit(r" \| ")).cast("long").alias("n_bars"))


def repeat_words(windows: Column) -> Column:
    """Words inside 8-word windows whose hash occurs at least twice: the sorted windows show the repeated ones, and the
    union of their spans is summed. Texts without a repeated window (the usual case) skip the sort."""
    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))

    def starts(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        twice = F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
        return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

    # The array around the sorted windows gives them a name, so that they are sorted once.
    at = F.get(F.transform(F.array(F.array_sort(numbered)), starts), 0)
    covered = F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("last")), lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(8), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, AGAINST).when(good, FOR).otherwise(ABSTAINS)


def votes() -> list[Column]:
    """The rules; each sees its own statistic, thresholds are relative to the text's length."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    never = F.lit(False)
    return [
        vote(F.col("n_repeat_words") > 0.2 * n, F.col("n_repeat_words") < 0.05 * n),
        vote(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") < 0.02 * n),
        vote(F.col("n_distinct") < 0.12 * n, (F.col("n_distinct") > 0.3 * n) & (n >= 50)),
        vote(F.col("n_upper") > 0.25 * chars, F.col("n_upper") < 0.1 * chars),
        vote(F.col("n_shouts") > 0.1 * n, never),
        vote(F.col("n_stops") < 0.01 * n, F.col("n_stops").between(0.03 * n, 0.4 * n)),
        vote(F.col("n_bars") > 0.1 * n, never),
        vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        vote(n < 20, n >= 60),
        vote((chars < 2.0 * n) | (chars > 12.0 * n), chars.between(3.5 * n, 8.0 * n)),
    ]


def posterior(ballot: Column, evidence: list[float], prior: float) -> Column:
    """Probability of quality of an array of votes; evidence: log-odds of vote o of rule j at 3 j + o."""
    each = F.transform(ballot, lambda o, j: F.get(F.lit(evidence), 3 * j + o))
    return 1 / (1 + F.exp(-(F.lit(math.log(prior / (1 - prior))) + F.aggregate(each, F.lit(0.0), lambda a, x: a + x))))


def fit_accuracies(patterns: DataFrame, rules: int, rounds: int = 12) -> tuple[list[float], float]:
    """Expectation-maximisation over vote patterns (`ballot` and its count `n`; at most 3 ** rules rows): how often each
    rule votes each way on good and on bad documents. At most 3 * rules sums reach the driver each round. Documents that
    fail the base are decided already and left out: they would teach what the base knows."""
    good, bad, prior = [list(ON_GOOD)] * rules, [list(ON_BAD)] * rules, PRIOR_QUALITY

    def evidence():
        return [math.log(g / b) for gs, bs in zip(good, bad) for g, b in zip(gs, bs)]

    for _ in range(rounds):
        p = patterns.select("n", posterior(F.col("ballot"), evidence(), prior).alias("p"), F.posexplode("ballot").alias("j", "o"))
        sums = {(r["j"], r["o"]): (r["g"], r["b"]) for r in p.groupBy("j", "o").agg(
            F.sum(F.col("p") * F.col("n")).alias("g"), F.sum((1 - F.col("p")) * F.col("n")).alias("b")).collect()}
        if not sums:
            break
        n_good, n_bad = (sum(sums.get((0, o), (0.0, 0.0))[k] for o in range(3)) for k in (0, 1))
        prior = (n_good + PRIOR_QUALITY * PRIOR_WEIGHT) / (n_good + n_bad + PRIOR_WEIGHT)
        good, bad = ([[(sums.get((j, o), (0.0, 0.0))[k] + PRIOR_WEIGHT * mean[o]) / (n + PRIOR_WEIGHT) for o in range(3)]
                      for j in range(rules)] for k, n, mean in ((0, n_good, ON_GOOD), (1, n_bad, ON_BAD)))
    return evidence(), prior


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document the counts, the `ballot` of votes, `base_failed`, `posterior`, and `kept`: the base holds and the
    posterior reaches the threshold."""
    rules = votes()
    voted = stage(document_counts(docs).select("*", F.array(*rules).alias("ballot")))
    patterns = stage(voted.filter(~base_failed()).groupBy("ballot").agg(F.count("*").cast("double").alias("n")).coalesce(1))
    evidence, prior = fit_accuracies(patterns, len(rules))
    judged = voted.select("*", base_failed().alias("base_failed"), posterior(F.col("ballot"), evidence, prior).alias("posterior"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
