"""Quality score from a sparse ensemble of rules that compiles into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import filled, held_out, words

#: At most so many labelled rows are fitted on, the first by a hash of their id.
FIT_ROWS = 20_000


def statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and one double per statistic of ``text``; null texts count as empty. All shares of empty texts are 0."""
    text = F.col("_text")
    rows = docs.select(*keys, filled(F.col("text")).alias("_text"))
    rows = rows.withColumn("_words", words(text))
    rows = rows.withColumns({"_n": F.size("_words"), "_lines": F.split("_text", "\n"), "_chars": F.length("_text")})
    share = lambda top, whole: F.coalesce(F.try_divide(top.cast("double"), whole.cast("double")), F.lit(0.0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    n, chars = F.col("_n"), F.col("_chars")
    repeats = F.size(F.filter("_words", lambda w, i: F.coalesce(F.get("_words", i - 1) == w, F.lit(False))))
    values = {
        "log_words": F.log1p(n.cast("double")),
        "mean_word": share(F.length(F.array_join("_words", "")), n),
        "upper_share": share(count("[A-Z]"), chars),
        "digit_share": share(count("[0-9]"), chars),
        "symbol_share": share(count("[#*$%&|<>]"), chars),
        "alarm_share": share(count("[!?]"), chars),
        "stop_share": share(count("[.,;:]"), chars),
        "distinct_words": share(F.size(F.array_distinct("_words")), n),
        "repeat_share": share(repeats, n),
        "distinct_lines": share(F.size(F.array_distinct("_lines")), F.size("_lines")),
        "words_a_line": share(n, F.size("_lines")),
    }
    return rows.select(*keys, *[v.alias(k) for k, v in values.items()])


FEATURES = ("log_words", "mean_word", "upper_share", "digit_share", "symbol_share", "alarm_share", "stop_share",
            "distinct_words", "repeat_share", "distinct_lines", "words_a_line")

#: A rule is a set of conditions (feature, is it greater, threshold); all must hold.
Rule = frozenset[tuple[int, bool, float]]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for feature, greater, at in sorted(rule):
                c = F.col(FEATURES[feature])
                test = test & ((c > F.lit(at)) if greater else (c <= F.lit(at)))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _support(x: np.ndarray, rule: Rule) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for feature, greater, at in rule:
        held &= (x[:, feature] > at) if greater else (x[:, feature] <= at)
    return held


def _tree_rules(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, rule: Rule = frozenset(),
                rows: np.ndarray | None = None) -> tuple[list[Rule], np.ndarray]:
    """Paths of one regression tree, inner nodes included, and the tree's prediction."""
    rows = np.arange(len(x)) if rows is None else rows
    fit = np.zeros(len(x))
    y = residual[rows]
    fit[rows] = y.mean() if len(rows) else 0.0
    best = None
    if depth and len(rows) >= 2 * least:
        for j, at in enumerate(cuts):
            bins = np.searchsorted(at, x[rows, j], side="left")  # rows with x <= at[k] have a bin of k at most
            n, s = np.bincount(bins, minlength=len(at) + 1)[:-1].cumsum(), np.bincount(bins, y, len(at) + 1)[:-1].cumsum()
            rest, other = len(rows) - n, y.sum() - s
            ok = (n >= least) & (rest >= least)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + other**2 / np.maximum(rest, 1), -1.0)
            if len(gain) and gain.max() > (best[0] if best else y.sum()**2 / len(rows) + 1e-9):
                best = (gain.max(), j, float(at[gain.argmax()]))
    if not best:
        return [], fit
    _, j, at = best
    rules = []
    for greater in (False, True):
        side = rows[(x[rows, j] > at) == greater]
        path = rule | {(j, greater, at)}
        below, values = _tree_rules(x, residual, cuts, depth - 1, least, path, side)
        rules += [path, *below]
        fit[side] = values[side]
    return rules, fit


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights that minimise mean log loss + penalty * sum |w|, by accelerated proximal gradient; the intercept is free."""
    a = np.hstack([np.ones((len(z), 1)), z])
    step = 4.0 / max(np.linalg.eigvalsh(a.T @ a / len(a)).max(), 1e-12)
    w = momentum = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ momentum, -30, 30)))
        later = momentum - step * (a.T @ (p - y)) / len(y)
        later[1:] = np.sign(later[1:]) * np.maximum(np.abs(later[1:]) - step * penalty, 0)
        t_later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = later + (t - 1) / t_later * (later - w), later, t_later
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, rate: float = 0.3) -> RuleModel:
    """Boosted shallow trees propose rules; a lasso logistic regression keeps few of them."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    cuts = [np.unique(np.quantile(c, np.linspace(0.005, 0.995, 100))) for c in x.T]
    score, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rules, values = _tree_rules(x, y - p, cuts, depth, max(5, len(y) // 500))
        found.update(dict.fromkeys(rules))
        score = score + rate * 4 * values
    held = {}
    for rule in found:  # rules that hold for the same rows are one; the shorter stays
        key = _support(x, rule).tobytes()
        if key not in held or len(rule) < len(held[key]):
            held[key] = rule
    rules = list(held.values())
    z = np.stack([_support(x, r) for r in rules], axis=1).astype(float)
    spread = np.maximum(z.std(axis=0), 0.05)
    intercept, w = _lasso_logistic(z / spread, y, penalty)
    kept = [i for i in np.argsort(-np.abs(w)) if abs(w[i]) > 1e-6]
    return RuleModel(intercept, [(rules[i], float(w[i] / spread[i])) for i in kept])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, *more: str) -> DataFrame:
    """``doc_id``, ``text``, ``y`` and columns ``more`` of at most ``limit`` labelled documents; of
    several labels of one id the largest, of several texts the smallest. The
    look-up table has at most ``limit`` rows and is broadcast."""
    drawn = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
             .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    found = docs.select("doc_id", "text", *more).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct("text", "y", *more)).alias("row")).select("doc_id", "row.*")


def rule_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``, learnt from ``labels`` (``doc_id``, ``quality``).

    Only statistics of the text enter a score. Labels count where the id's CRC
    modulo 5 is not 0. Null and empty texts are scored by their statistics, all
    of them 0; without usable labels every score is 0.5. Repeated rows score
    alike; other columns are not read.
    """
    seen = labels.filter(~held_out(F.col("doc_id"), 5, 0))
    sample = statistics(labelled_sample(docs, seen, "quality", fit_rows), "y").toPandas()
    sample = sample.sort_values(list(sample.columns))  # sums in one order, however the rows arrive
    model = fit_rules(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float))
    scored = statistics(docs, "doc_id").select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
