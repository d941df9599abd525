"""Quality rules with risk-controlled thresholds.

Word and line statistics of each text feed five directed rules. Each rule has a fixed
grid of cutoffs, from lenient to strict. In each stratum (a language) a path of combinations,
each rejecting all that the one before rejects, is laid out without a look at good labels:
from bad labelled and from unlabelled documents, at each step the cutoff that catches the most
bad ones for what it rejects of all. The good labelled documents are the holdout. Combinations
are tested on it in the path's order: one passes if the exact (Clopper-Pearson) upper bound on the
share of good documents that it rejects stays within `limit`, and the first that fails ends the
tests. Fixed-sequence testing needs no further correction along the path; for the strata the
confidence is corrected by Bonferroni. Of the combinations that passed, all of which keep the
limit at once, that with the most bad documents caught is taken, each good one lost counting as
`good_cost` bad ones. A stratum with too few labels to prove the bound gets no cutoffs and keeps
what passes the base rules.

Defined results: a null text has no words and fails the base; a null stratum is a
stratum of its own (""); labels that are null or name no document are passed over, and
of several labels of one document the worst counts; repeated rows each get the verdict;
an empty table gives no rows. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dimspark.llm.common import read_table, settle

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

#: Rule: (whether high values are bad, cutoffs from lenient to strict).
RULES: dict[str, tuple[bool, tuple[float, ...]]] = {
    "symbol_share": (True, (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2)),
    "dup_line_share": (True, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "repeat_share": (True, (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "mean_word_chars": (True, (20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0)),
    "short_word_chars": (False, (1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0)),
}
#: Strata up to this many make a table of thresholds that is small enough to broadcast.
BROADCAST_STRATA = 10_000


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of a text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    body = text.encode()
    words = body.split()
    n = len(words)
    chars = len(text) - (len(body) - len(body.translate(None, BLANKS)))
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list) -> int:
    """Words inside windows of three words that stand twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * len(place) + ids[1:]
    if len(place) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(place) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    covered = np.zeros(n, bool)
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def _statistics(texts: pd.Series) -> pd.DataFrame:
    rows = [text_statistics(t) for t in texts]
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"], dtype="int64")


def statistics(text: str = "text") -> Column:
    """A struct column of the statistics of a text column."""
    return pandas_udf(_statistics, STATISTICS)(F.col(text))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def rule_values(s: Column) -> dict[str, Column]:
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "symbol_share": s["n_symbols"] / words,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)).cast("double"),
        "repeat_share": s["n_repeat_words"] / words,
        "mean_word_chars": s["word_chars"] / words,
        "short_word_chars": s["word_chars"] / words,
    }


def trips_of(value: Column, grid: tuple[float, ...], high: bool) -> Column:
    """How many cutoffs of a grid reject a value."""
    total = F.lit(0)
    for cutoff in grid:
        total = total + F.when((value >= cutoff) if high else (value <= cutoff), 1).otherwise(0)
    return total


def upper_bound_within(rejected: int, total: int, limit: float, delta: float) -> bool:
    """Whether the exact upper confidence bound, at 1 - delta, on the rate behind rejected of total is at most limit.

    That is so exactly if a binomial of rate limit has at most `rejected` with probability delta or less.
    """
    if total <= 0 or rejected >= limit * total:
        return False
    top = math.lgamma(total + 1) - math.lgamma(rejected + 1) - math.lgamma(total - rejected + 1) + rejected * math.log(limit) + (total - rejected) * math.log1p(-limit)
    tail = term = 1.0  # relative to the greatest term; below the mode terms only fall
    k = rejected
    while k > 0 and term > 1e-17 * tail:
        term *= k / (total - k + 1) * (1 - limit) / limit
        tail += term
        k -= 1
    return top + math.log(tail) <= math.log(delta)


def lay_path(hits: dict[str, np.ndarray], bad: np.ndarray, unlabelled: np.ndarray) -> list[dict[str, int]]:
    """Combinations (rule: how many of its strictest-first cutoffs reject), each rejecting more than the one before.

    hits, bad and unlabelled have an entry for each group of documents; good labels are not among them.
    """
    size = {rule: len(grid) for rule, (_, grid) in RULES.items()}
    now, out, path = dict.fromkeys(RULES, 0), np.zeros(len(bad), bool), []
    while True:
        best = None
        for rule in RULES:
            for strict in range(now[rule] + 1, size[rule] + 1):
                more = ~out & (size[rule] - hits[rule] < strict)
                caught = int(bad[more].sum())
                if caught:
                    worth = (caught / (1 + int(unlabelled[more].sum())), caught)
                    if best is None or worth > best[0]:
                        best = worth, rule, strict
        if best is None:
            return path
        _, rule, strict = best
        now = now | {rule: strict}
        out = out | (size[rule] - hits[rule] < strict)
        path.append(now)


def choose_cutoffs(counts: pd.DataFrame, n_strata: int, limit: float, delta: float, good_cost: float) -> dict:
    """The cutoffs of one stratum.

    counts: a column for each rule with the number of its cutoffs that reject (the strictest first),
    quality (0 or 1; -1: not labelled) and n (documents).
    """
    hits = {rule: counts[rule].to_numpy() for rule in RULES}
    quality, n = counts["quality"].to_numpy(), counts["n"].to_numpy()
    good, bad = np.where(quality == 1, n, 0), np.where(quality == 0, n, 0)
    total = int(good.sum())
    best, pick, kept = 0.0, dict.fromkeys(RULES, 0), (0, 0)
    for combination in lay_path(hits, bad, np.where(quality < 0, n, 0)):
        out = np.zeros(len(counts), bool)
        for rule, strict in combination.items():
            out |= len(RULES[rule][1]) - hits[rule] < strict
        lost, caught = int(good[out].sum()), int(bad[out].sum())
        if not upper_bound_within(lost, total, limit, delta / max(1, n_strata)):
            break
        if caught - good_cost * lost > best:
            best, pick, kept = caught - good_cost * lost, combination, (lost, caught)
    cutoffs = {rule: float(RULES[rule][1][strict - 1]) if strict else None for rule, strict in pick.items()}
    return cutoffs | {"n_good": total, "n_bad": int(bad.sum()), "lost_good": kept[0], "caught_bad": kept[1]}


def learn_thresholds(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "stratum", limit: float = 0.02, delta: float = 0.05, good_cost: float = 10.0) -> DataFrame:
    """One row for each labelled stratum: its cutoffs (null: none) and what they do to the holdout.

    stats has doc_id, stratum and the struct s of `statistics`; labels has doc_id and quality.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min("quality").alias("quality"))
    s = F.col("s")
    trips = [trips_of(rule_values(s)[rule], grid, high).alias(rule) for rule, (high, grid) in RULES.items()]
    judged = stats.where(~base_failed(s)).select(doc_id, stratum, *trips).join(marks, doc_id, "left")
    counted = settle(judged.groupBy(stratum, F.coalesce("quality", F.lit(-1)).alias("quality"), *RULES).agg(F.count(F.lit(1)).alias("n")))
    labelled = counted.where("quality = 1").select(stratum).distinct()
    n_strata = labelled.count()
    names = [*RULES, "n_good", "n_bad", "lost_good", "caught_bad"]

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = choose_cutoffs(part.sort_values([*RULES, "quality"]), n_strata, limit, delta, good_cost)
        return pd.DataFrame([{stratum: key[0]} | {k: found[k] for k in names}]).astype({r: "float64" for r in RULES})

    schema = f"{stratum} string, " + ", ".join(f"{r} double" for r in RULES) + ", n_good long, n_bad long, lost_good long, caught_bad long"
    return settle(counted.join(labelled, stratum, "left_semi").groupBy(stratum).applyInPandas(choose, schema))


def verdict(stats: DataFrame, thresholds: DataFrame, stratum: str = "stratum") -> DataFrame:
    """stats with base_failed, kept and failed_rule (the first rule that rejects; null: none)."""
    cutoffs = thresholds.select(F.col(stratum).alias("__stratum"), *[F.col(r).alias(f"__cut_{r}") for r in RULES])
    if thresholds.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    s = F.col("s")
    failed = F.when(base_failed(s), F.lit("base"))
    for rule, (high, _) in RULES.items():
        v, c = rule_values(s)[rule], F.col(f"__cut_{rule}")
        failed = failed.when(F.coalesce((v >= c) if high else (v <= c), F.lit(False)), F.lit(rule))
    joined = stats.join(cutoffs, F.col(stratum) == F.col("__stratum"), "left")
    return joined.withColumn("__failed", failed).withColumns({"base_failed": base_failed(s), "kept": F.col("__failed").isNull(), "failed_rule": F.col("__failed")}).drop("__stratum", "__failed", *[f"__cut_{r}" for r in RULES])


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and s (the statistics) of each row, computed once."""
    return settle(docs.select(doc_id, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), statistics(text).alias("s")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the base and the learnt rules keep.

    The statistics are computed again in the filtering pass: cheaper than moving whole texts to a join.
    """
    thresholds = learn_thresholds(document_statistics(docs), labels)
    own = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__doc"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), statistics("text").alias("s"))
    return verdict(marked, thresholds).where("kept").select("__doc.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = document_statistics(read_table(spark, sf_dir, "documents"))
    judged = verdict(stats, learn_thresholds(stats, read_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "kept", "failed_rule")
