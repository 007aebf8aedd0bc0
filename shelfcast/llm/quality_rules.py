"""Quality rules: a decision list learned from labelled statistics.

Sequential covering finds one rule after the other: a conjunction of thresholds that covers documents labelled bad.
A rule is grown on two thirds of the sample, condition by condition, by information gain; it is pruned on the last
third by dropping conditions from its end while its worth there does not fall; it joins the list if it is precise
enough, and what it covers is taken out. The list is emitted as one ordered conditional expression over the statistics
of a document, so applying it is a plain projection.

The list is learned on a bounded sample of labelled documents (``labelled.SAMPLE_ROWS``); the statistics cover all
documents and whole texts.

Defined results: a null or empty text has no words and fails the base rule; without labelled rows, or with one class
only, the list is empty and every document that passes the base rules is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from shelfcast.llm.common import map_text, unused
from shelfcast.llm.labelled import SAMPLE_ROWS, labelled_ids, labelled_texts
from shelfcast.llm.textstats import COUNTS, FEATURES, measure

MIN_WORDS = 50
#: Precision on the pruning rows that a rule must reach, and bad documents that it must cover there.
MIN_PRECISION = 0.9
MIN_COVER = 3
MAX_CONDITIONS = 4
MAX_RULES = 40
CUTS = 64


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: tuple[str, ...] = FEATURES) -> np.ndarray:
        column = x[:, names.index(self.feature)]
        return column >= self.threshold if self.above else column < self.threshold

    def column(self, stat: dict[str, str]) -> Column:
        value = F.col(stat[self.feature])
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        if not p or not n:
            break
        before = np.log2(p / (p + n))
        best, found = 1e-9, None
        for j, name in enumerate(FEATURES):
            column = x[inside, j]
            cuts = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1), method="higher"))
            order = np.sort(column[bad[inside]]), np.sort(column[~bad[inside]])
            under = [np.searchsorted(side, cuts, side="left") for side in order]
            for above in (True, False):
                tp = p - under[0] if above else under[0]
                fp = n - under[1] if above else under[1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / (tp + fp)) - before), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = float(gain[k]), Condition(name, above, float(cuts[k]))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return tuple(rule)


def worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    inside = covered(rule, x)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return (p - n) / max(p + n, 1)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop conditions from the end while the worth on other rows does not fall."""
    while len(rule) > 1 and worth(rule[:-1], x, bad) >= worth(rule, x, bad):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list: rules that reject, in order; what no rule covers is kept."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3
    while len(rules) < MAX_RULES:
        fit, test = part < 2, part == 2
        if not bad[fit].any() or bad.all():
            break
        rule = prune(grow(x[fit], bad[fit]), x[test], bad[test])
        inside = covered(rule, x)
        held = inside & test
        hits = int(bad[held].sum())
        if not rule or hits < MIN_COVER or hits < min_precision * held.sum() or bad[inside].mean() < min_precision:
            break
        rules.append(rule)
        x, bad, part = x[~inside], bad[~inside], part[~inside]
    return rules


def verdict(rules: list[Rule], stat: dict[str, str]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        condition = rule[0].column(stat)
        for more in rule[1:]:
            condition = condition & more.column(stat)
        out = F.when(condition, F.lit(i)).otherwise(out)
    return out


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The documents with the counts and features of their whole texts, and the names of these columns."""
    names = {n: unused(n, docs.columns) for n in (*COUNTS, *FEATURES)}
    fields = [StructField(names[n], LongType()) for n in COUNTS] + [StructField(names[n], DoubleType()) for n in FEATURES]

    def make():
        def kernel(texts):
            both = [measure(raw) for raw in texts]
            counts = np.array([c for c, _ in both], np.int64).reshape(len(texts), len(COUNTS))
            values = np.array([f for _, f in both], np.float64).reshape(len(texts), len(FEATURES))
            return [pa.array(np.ascontiguousarray(m[:, i])) for m in (counts, values) for i in range(m.shape[1])]

        return kernel

    return map_text(docs, make, fields, text=text, keep=docs.columns), names


def base_failed(names: dict[str, str]) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    n_words, repeat = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)


def fit_rules(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", text: str = "text",
    doc_id: str = "doc_id", limit: int = SAMPLE_ROWS,
) -> list[Rule]:
    """A list from the labelled documents for which ``train`` holds (all by default); label 0 is bad."""
    ids = labelled_ids(labels, label, F.lit(True) if train is None else train, limit, doc_id)
    stats, names = with_statistics(labelled_texts(docs, ids, text, doc_id), "body")
    # The list only decides about documents that pass the base rules, so it is learned on those.
    own = stats.where(~base_failed(names)).orderBy(F.xxhash64("doc_id"), "doc_id", names["log_words"])
    rows = own.select("label", *[F.col(names[f]).alias(f) for f in FEATURES]).toArrow()
    x = np.column_stack([rows[f].to_numpy() for f in FEATURES]).reshape(rows.num_rows, len(FEATURES))
    return learn(x, rows["label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds the counts, ``base_failed``, ``rule`` (number of the rejecting rule, null if none) and ``kept``."""
    out, names = with_statistics(docs, text)
    for n in ("base_failed", "rule", "kept"):
        names[n] = unused(n, out.columns)
    out = out.withColumn(names["base_failed"], base_failed(names))
    out = out.withColumn(names["rule"], verdict(rules, names))
    kept = ~F.col(names["base_failed"]) & F.col(names["rule"]).isNull()
    return out.withColumn(names["kept"], kept), names
