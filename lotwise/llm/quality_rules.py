"""Operator 1 [native]: quality rules as weak supervision.

Each rule votes bad (1), good (0) or abstains (null). Expectation-maximisation over the counts of vote patterns estimates
which share of documents is bad, how often each rule votes bad of bad documents (sensitivity) and of good ones (false
alarms). A document is kept where its posterior probability of being good is at least `threshold`, so a failed rule whose
vote the others contradict doesn't drop it, and one that they bear out does. The rules overlap on purpose: each kind of
bad text makes several of them fire, and each of them also fires on good texts now and then. The fit runs from several
starts until it settles, with priors of a few pseudo-documents instead of limits; the most probable outcome is taken.

Everything on documents is DataFrame expressions: features are array functions within one row (no shuffle), patterns are
counted with partial aggregation, and scoring is arithmetic with the fitted numbers. The counts are at most 3 ** rules
numbers however many documents there are; the rounds of the fit are plain arithmetic on those.

Only documents that pass the base rule take part in the fit. Null and empty texts have no words and fail the base rule.
Texts of any length are one row each: their features take memory in proportion to the text. Repeated rows get equal
results and count as often as they come. An empty table gives no rows. Extra columns are kept by score(); names beginning
with "_q_" are reserved. Runs of words are compared by 64-bit hashes within one text (two different runs of a text of n
words meet with a chance of about n * n / 2 ** 65).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import Scratch, read_table, words_of

RUN, MIN_WORDS, MAX_REPEAT_PERCENT, KEEP = 5, 10, 20, 0.5
#: Where the fit begins, each: share of bad documents, sensitivity, false alarms.
STARTS = ((0.1, 0.6, 0.05), (0.2, 0.3, 0.02), (0.05, 0.8, 0.1))
#: Pseudo-documents of the priors, (bad votes, good votes): of the share of bad documents, of sensitivities, of false alarms.
SHARE_PRIOR, SENSITIVITY_PRIOR, ALARM_PRIOR = (1.0, 9.0), (1.0, 1.0), (1.0, 20.0)
#: The fit has settled where its numbers move less than this in a round, all together; rounds at most.
SETTLED, ROUNDS = 1e-9, 1000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims", "n_plain", "n_stops", "n_marked", "n_digits", "n_distinct")
#: Frequent words of the corpus's languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les en un du une que pour est par qui dans avec sur pas au "
    "el y los se del las por con no su una para es al lo"
).split()
STOPS = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
PLAIN, MARKED, DIGIT = r"\A\p{L}+[.,;:?!…]?\z", r"[^\p{L}\p{N}]\z", "[0-9]"


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns FEATURES of its texts (long each).

    Columns that a lambda refers to are used more than once, so that the optimiser computes each once per row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    h = F.col("_q_h")
    runs = F.when(F.size(h) >= RUN, F.transform(F.slice(h, 1, F.greatest(F.size(h) - RUN + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, RUN)))))
    s, p = F.col("_q_sorted"), F.col("_q_at")
    same = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(RUN)), F.lit(RUN))), F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda c: F.size(c).cast("long")
    count = lambda c, test: size(F.filter(c, test))
    out = df.withColumns({"_q_w": words_of(F.col(text)), "_q_lines": lines})
    out = out.withColumns({
        "n_words": size("_q_w"),
        "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "n_dup_lines": size("_q_lines") - size(F.array_distinct("_q_lines")),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
        "n_exclaims": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
        "n_plain": count("_q_w", lambda x: x.rlike(PLAIN)),
        "n_stops": count("_q_w", lambda x: x.isin(STOPS)),
        "n_marked": count("_q_w", lambda x: x.rlike(MARKED)),
        "n_digits": count("_q_w", lambda x: x.rlike(DIGIT)),
        "_q_h": F.transform("_q_w", lambda x: F.xxhash64(x)),
    }).drop("_q_w", "_q_lines")
    out = out.withColumn("n_distinct", size(F.array_distinct("_q_h")))
    out = out.withColumn("_q_g", runs).drop("_q_h")
    out = out.withColumn("_q_sorted", F.when(F.size(F.array_distinct("_q_g")) < F.size("_q_g"), F.sort_array(F.transform("_q_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_q_g")
    out = out.withColumn("_q_at", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("_q_sorted")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_q_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: name: (condition of a bad vote, condition of a good vote), SQL over FEATURES; a rule abstains where neither holds.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "upper_case": ("10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    "exclamations": ("10 * n_exclaims > n_words", "50 * n_exclaims <= n_words"),
    "plain_words": ("10 * n_plain < 8 * n_words", "10 * n_plain >= 9 * n_words"),
    "stop_words": ("n_words >= 20 and 100 * n_stops < 8 * n_words", "n_words >= 20 and 100 * n_stops >= 15 * n_words"),
    "marked_ends": ("10 * n_marked > 4 * n_words", "4 * n_marked <= n_words"),
    "distinct_words": ("n_words between 20 and 1000 and 10 * n_distinct < 5 * n_words", "n_words between 20 and 1000 and 10 * n_distinct >= 6 * n_words"),
    "digits": ("20 * n_digits > n_words", "100 * n_digits <= n_words"),
    "word_length": ("10 * word_chars < 43 * n_words or 10 * word_chars > 65 * n_words", "10 * word_chars between 45 * n_words and 60 * n_words"),
}


def votes() -> list[Column]:
    """One column per rule: 1 bad, 0 good, null abstains."""
    return [F.expr(f"case when {bad} then 1 when {good} then 0 end").alias(f"_q_{name}") for name, (bad, good) in RULES.items()]


#: Share of bad documents, sensitivity of each rule, false alarms of each rule.
Fitted = tuple[float, list[float], list[float]]


def bad_probability(model: Fitted, columns: list[Column]) -> Column:
    """Posterior probability of bad, from the log odds of each rule's vote."""
    prior, sensitivity, alarms = model
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, s, f in zip(columns, sensitivity, alarms):
        odds = odds + F.when(v == 1, math.log(s / f)).when(v == 0, math.log((1 - s) / (1 - f))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def settle(cast: list[tuple[int | None, ...]], counts: list[int], start: tuple[float, float, float]) -> tuple[float, Fitted]:
    """(log of the posterior density, fitted numbers) of expectation-maximisation from one start over vote patterns."""
    n_rules, total = len(RULES), sum(counts)
    prior, s, f = start[0], [start[1]] * n_rules, [start[2]] * n_rules
    density = 0.0
    for _ in range(ROUNDS):
        bad, density = 0.0, 0.0
        tallies = [[0.0] * 4 for _ in range(n_rules)]  # bad and good votes of bad documents, of good ones
        for pattern, n in zip(cast, counts):
            of_bad, of_good = math.log(prior), math.log(1 - prior)
            for k, v in enumerate(pattern):
                if v is not None:
                    of_bad += math.log(s[k] if v else 1 - s[k])
                    of_good += math.log(f[k] if v else 1 - f[k])
            top = max(of_bad, of_good)
            density += n * (top + math.log(math.exp(of_bad - top) + math.exp(of_good - top)))
            q = n / (1 + math.exp(of_good - of_bad)) if of_good - of_bad < 700 else 0.0
            bad += q
            for k, v in enumerate(pattern):
                if v is not None:
                    tallies[k][0 if v else 1] += q
                    tallies[k][2 if v else 3] += n - q
        for p, (a, b) in ((prior, SHARE_PRIOR), *((x, SENSITIVITY_PRIOR) for x in s), *((x, ALARM_PRIOR) for x in f)):
            density += a * math.log(p) + b * math.log(1 - p)
        after = [(bad + SHARE_PRIOR[0]) / (total + sum(SHARE_PRIOR))]
        after += [(t[0] + SENSITIVITY_PRIOR[0]) / (t[0] + t[1] + sum(SENSITIVITY_PRIOR)) for t in tallies]
        after += [(t[2] + ALARM_PRIOR[0]) / (t[2] + t[3] + sum(ALARM_PRIOR)) for t in tallies]
        moved = sum(abs(x - y) for x, y in zip(after, [prior, *s, *f]))
        prior, s, f = after[0], after[1 : 1 + n_rules], after[1 + n_rules :]
        if moved < SETTLED:
            break
    return density, (prior, s, f)


def fit(features: DataFrame) -> Fitted:
    """The numbers of the most probable outcome in which bad documents get more bad votes than good ones."""
    names = [f"_q_{n}" for n in RULES]
    patterns = features.where(~base_failed()).select(*votes()).groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    cast, counts = [tuple(p[v] for v in names) for p in patterns], [p["n"] for p in patterns]
    outcomes = [settle(cast, counts, start) for start in STARTS]
    return max(outcomes, key=lambda o: (sum(o[1][1]) > sum(o[1][2]), o[0]))[1]


def score(features: DataFrame, model: Fitted, threshold: float = KEEP) -> DataFrame:
    """features with base_failed, p_good and kept. Row-local."""
    good = 1 - bad_probability(model, votes())
    return features.withColumns({"base_failed": base_failed(), "p_good": good}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality-rules")
    features = scratch.save(with_features(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "features")
    scored = score(features, fit(features))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; columns stay as they are."""
    scratch = Scratch(spark, "quality-rules")
    clash = [c for c in docs.columns if c in (*FEATURES, "base_failed", "p_good", "kept") or c.startswith("_q_")]
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text")) if clash else docs
    features = scratch.save(with_features(packed), "features")
    kept = score(features, fit(features)).where("kept")
    return kept.select("_doc.*") if clash else kept.select(*docs.columns)
