"""Quality rules by weak supervision (DataFrame functions only).

Each rule votes *bad*, *good* or abstains on a document. Expectation-maximisation
estimates, from the table of vote patterns, how often each rule calls a bad and a
good document bad; the posterior probability of being good then decides, so that
one stumble does not reject a document and two independent ones usually do.

Edge cases: a null or empty text has no words, so the base rule rejects it; null or
repeated ids do not matter, as every row is judged on its own text; an empty table
gives an empty result; input columns named like an output are replaced. The text is
read whole, however long it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.native import let, text_of, total, words_of

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats")
#: Symbols counted by the symbol rule.
SYMBOLS = "[#*$%&|<>]"
#: EM: steps, and the ranges that keep "bad" meaning bad (sensitivity above false alarms).
STEPS, SENSITIVITY, ALARM, PRIOR = 25, (0.3, 0.98), (0.002, 0.2), (0.5, 0.99)
START = {"sensitivity": 0.6, "alarm": 0.02, "prior": 0.9}


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in ``w``.

    Each window becomes one number: its hash, with the lowest bits replaced by its
    start. Sorting brings equal windows together; neighbours are compared by words.
    """
    n = F.size(w)
    low = (F.pow(F.lit(2.0), F.ceil(F.log2(n + F.lit(2)))).cast("long") - 1)

    def covered(mask: Column) -> Column:
        high = F.bitwise_not(mask)
        packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))))

        def same(a: Column, b: Column) -> Column:
            i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            equal = a.bitwiseAND(high) == b.bitwiseAND(high)
            for k in range(3):
                equal = equal & (F.get(w, i + k) == F.get(w, j + k))
            return F.coalesce(equal, F.lit(False))

        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda x, j: same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1)))
            return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))

        def length(s: Column) -> Column:
            return total(F.transform(s, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, j + 1), x + 3) - x)))

        return let(let(packed, starts), length)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(low, covered))


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns SIGNALS (long), measured on the whole text."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")
    kept = docs.drop(*SIGNALS)
    wide = kept.select("*", of_words.alias("__w"), of_lines.alias("__l"), symbols.alias("n_symbols"))
    return wide.select(*kept.columns, "__w.n_words", "__w.word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Rule -> (bad, good) as SQL over the signals; neither: the rule abstains.
VOTES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "word_length": ("2 * word_chars < 5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 10 * n_words and n_words > 0"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
}


def with_votes(signals: DataFrame) -> DataFrame:
    """Adds ``__vote_<rule>``: 1 good, -1 bad, 0 abstains."""
    return signals.withColumns({f"__vote_{r}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for r, (bad, good) in VOTES.items()})


@dataclass(frozen=True)
class VoteModel:
    """What EM found: the share of good documents, and per rule P(bad vote | bad) and P(bad vote | good)."""

    prior: float
    sensitivity: dict[str, float]
    alarm: dict[str, float]

    def log_odds(self) -> Column:
        """Log odds of *good*, from the vote columns."""
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for r in RULES:
            s, f, v = self.sensitivity[r], self.alarm[r], F.col(f"__vote_{r}")
            out = out + F.when(v == -1, math.log(f / s)).when(v == 1, math.log((1 - f) / (1 - s))).otherwise(0.0)
        return out


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def fit_votes(votes: DataFrame) -> VoteModel:
    """EM over the counts of vote patterns: at most 3^5 = 243 rows, whatever the input."""
    cols = [f"__vote_{r}" for r in RULES]
    patterns = [(tuple(x[c] for c in cols), x["n"]) for x in votes.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(*cols).collect()]
    prior, sens, alarm = START["prior"], [START["sensitivity"]] * len(RULES), [START["alarm"]] * len(RULES)
    rows = sum(n for _, n in patterns)
    for _ in range(STEPS):
        good = []
        for v, _n in patterns:
            z = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                z += math.log(alarm[j] / sens[j]) if x < 0 else math.log((1 - alarm[j]) / (1 - sens[j])) if x > 0 else 0.0
            good.append(1 / (1 + math.exp(-z)))
        prior = _within((sum(q * n for q, (_, n) in zip(good, patterns)) + 9) / (rows + 10), PRIOR)
        for j in range(len(RULES)):
            voted = [(v[j], n, q) for q, (v, n) in zip(good, patterns) if v[j]]
            bad = [(n, q) for x, n, q in voted if x < 0]
            sens[j] = _within((sum(n * (1 - q) for n, q in bad) + 6) / (sum(n * (1 - q) for _, n, q in voted) + 10), SENSITIVITY)
            alarm[j] = _within((sum(n * q for n, q in bad) + 0.2) / (sum(n * q for _, n, q in voted) + 10), ALARM)
    return VoteModel(prior, dict(zip(RULES, sens)), dict(zip(RULES, alarm)))


def judge(signals: DataFrame) -> DataFrame:
    """Measured rows with ``base_failed``, ``p_good`` and ``kept`` (base passed and p_good at least one half)."""
    votes = with_votes(signals)
    z = fit_votes(votes).log_odds()
    scored = votes.withColumns({"base_failed": base_failed(), "p_good": 1 / (1 + F.exp(-z))})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop(*[f"__vote_{r}" for r in RULES])


def quality(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with signals, ``base_failed``, ``p_good`` and ``kept``; the text is read once."""
    measured = with_signals(docs, text)
    return judge(cut(measured if keep_text else measured.drop(text)))
