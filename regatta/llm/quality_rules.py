"""Quality rules: an ordered decision list learned from labelled text statistics.

Sequential covering on a bounded sample of labelled documents: a rule grows by the threshold condition
of the best information gain until it covers good documents no more, is pruned on rows kept apart, and
stays if it is precise there; the rows it covers go, and the next rule is learned from the rest. The
list becomes one Spark ``CASE WHEN`` over the statistics of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regatta.llm.common import uniform
from regatta.operators.common import cut_lineage

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
WHITE = "\t\n\x0b\x0c\r "
# Labelled documents a rule list is learned from, in expectation half of each class at most.
SAMPLE_ROWS = 6000
# Lowest share of bad documents among those a rule covers, on the rows kept for pruning.
PRECISION = 0.95
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 4, 32

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_distinct_words", "n_upper", "n_marks", "n_lines")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of ``BASE`` and ``EXTRA`` of one whole text; null: an empty one."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    white = sum(map(text.count, WHITE))
    seen: set[str] = set()
    dup_lines = lines = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeat = 0
    if len(counts) < len(windows):
        covered = np.zeros(n, bool)
        twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
        for shift in range(WINDOW):
            covered[shift: shift + len(windows)] |= twice
        repeat = int(covered.sum())
    return (
        n, len(text) - white, sum(map(text.count, SYMBOLS)), dup_lines, repeat,
        len(set(words)), len(_UPPER.findall(text)), text.count("!") + text.count("?"), lines,
    )


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*BASE, *EXTRA]
    for batch in batches:
        counted = pd.DataFrame([text_statistics(t) for t in batch["text"]], columns=names)
        yield pd.concat([batch.drop(columns="text").reset_index(drop=True), counted], axis=1)


def document_statistics(docs: DataFrame, with_hash: bool = False) -> DataFrame:
    """``doc_id`` (null stays null) and the counts of every whole text, one row per document."""
    keys = [F.struct(F.col("doc_id").cast("long").alias("id")).alias("key")]
    if with_hash:
        keys.append(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    # A null id would turn a pandas column into doubles, so ids travel as text.
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), *keys[1:], F.col("text").alias("text")
    )
    names = "doc_id string, " + ("text_hash long, " if with_hash else "")
    schema = names + ", ".join(f"{c} long" for c in (*BASE, *EXTRA))
    counted = rows.mapInPandas(_statistics, schema)
    return counted.withColumn("doc_id", F.col("doc_id").cast("long"))


def features() -> dict[str, Column]:
    """What rules may compare: shares, so that a rule means the same for short and long texts."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "upper_share": F.col("n_upper") / chars,
        "distinct_share": F.col("n_distinct_words") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        values = table[self.feature].to_numpy()
        return values >= self.threshold if self.above else values < self.threshold

    def column(self) -> Column:
        value, limit = features()[self.feature], F.lit(self.threshold)
        return value >= limit if self.above else value < limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: pd.DataFrame) -> np.ndarray:
    held = np.ones(len(table), bool)
    for condition in rule:
        held &= condition.holds(table)
    return held


def _candidates(table: pd.DataFrame) -> list[Condition]:
    found = []
    for name in table.columns:
        values = np.unique(table[name].to_numpy())
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > THRESHOLDS:
            spots = np.linspace(0, len(middle) - 1, THRESHOLDS).round().astype(int)
            middle = middle[spots]
        found += [Condition(name, above, float(t)) for t in middle for above in (True, False)]
    return found


def _grow(table: pd.DataFrame, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(table), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), inside.sum()
        best, best_gain = None, 0.0
        for condition in _candidates(table[inside]):
            after = inside & condition.holds(table)
            p, n = (after & bad).sum(), after.sum()
            if p and n < n0:
                gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                if gain > best_gain:
                    best, best_gain = condition, gain
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(table)
    return rule


def _pruned(rule: Rule, table: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (precision, coverage) on rows it has not seen."""
    best: tuple[Rule, float, int] = ((), 0.0, 0)
    for size in range(1, len(rule) + 1):
        held = _covers(rule[:size], table)
        p, n = int((held & bad).sum()), int(held.sum())
        worth = (p - (n - p)) / n if n else -1.0
        if n and worth > best[1]:
            best = (rule[:size], worth, p)
    rule, worth, p = best
    return rule, (worth + 1) / 2, p


def learn_rules(table: pd.DataFrame, bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules whose conjunctions mark bad rows; two rows of three grow, the third prunes."""
    rules: list[Rule] = []
    if not len(table):
        return rules
    grow = np.arange(len(table)) % 3 != 2
    left = np.ones(len(table), bool)
    while len(rules) < MAX_RULES and (left & grow & bad).any():
        rule = _grow(table[left & grow], bad[left & grow])
        if not rule:
            break
        rest = left & ~grow
        rule, right, hits = _pruned(rule, table[rest], bad[rest])
        if not rule or right < precision or hits < 3:
            break
        rules.append(rule)
        left &= ~_covers(rule, table)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the position of the first rule that holds, else null."""
    chain = None
    for n, rule in enumerate(rules):
        held = F.lit(True)
        for condition in rule:
            held = held & condition.column()
        chain = F.when(held, n) if chain is None else chain.when(held, n)
    return F.lit(None).cast("int") if chain is None else chain.otherwise(F.lit(None)).cast("int")


def labelled_sample(
    statistics: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS
) -> tuple[pd.DataFrame, np.ndarray]:
    """At most ``rows`` labelled documents in hash order, as features and a mark for bad ones.

    Labels without an id or quality are left out; of several labels of one id the least holds.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.min("quality").alias("quality"))
    counts = {r["bad"]: r["n"] for r in marked.groupBy((F.col("quality") == 0).alias("bad"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for bad, n in counts.items():
        share = F.when((F.col("quality") == 0) == F.lit(bad), min(1.0, rows / 2 / n)).otherwise(share)
    chosen = marked.where(uniform(F.col("doc_id"), seed="quality") < share)
    sample = statistics.join(chosen, "doc_id").select(
        "doc_id", "quality", *(c.alias(n) for n, c in features().items())
    ).orderBy(uniform(F.col("doc_id"), seed="order"), "doc_id", *features()).limit(rows).toPandas()
    bad = (sample["quality"] == 0).to_numpy()
    return sample.drop(columns=["doc_id", "quality"]), bad


def judge_documents(
    docs: DataFrame, labels: DataFrame, with_hash: bool = False, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per document: counts, ``base_failed``, the rule that rejects it, ``kept``.

    Null and wordless texts fail the base. Repeated rows and null ids are judged like any other row;
    an empty table gives no rows, and without usable labels the list is empty and rejects nothing.
    Only ``doc_id``, ``text``, and ``doc_id``, ``quality`` of the labels are read.
    """
    statistics = cut_lineage(document_statistics(docs, with_hash))
    rules = learn_rules(*labelled_sample(statistics, labels, sample_rows))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return statistics.withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass; all columns stay."""
    judged = judge_documents(docs, labels, with_hash=True).where("kept").select(
        F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_of")
    ).distinct()
    hashed = docs.withColumn("_llm_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = hashed["doc_id"].eqNullSafe(judged["_llm_id"]) & (
        hashed["_llm_hash"] == judged["_llm_of"]
    )
    return hashed.join(judged, same, "left_semi").drop("_llm_hash")
