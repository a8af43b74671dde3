"""Quality rules as a learned decision list.

Each text gives counts (words, symbols, repeated lines and windows, letter cases). Sequential covering
learns from the counts of labelled rows: a conjunction of thresholds grows by information gain on one part of
the rows and is pruned on the other, the rows it covers go, and the next one grows on the rest. The list
becomes one conditional expression over the counts, which Spark evaluates for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, materialize
from .toxicity import held_out

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 3
#: At most so many labelled rows are learned from; of three hash values of a row one is for pruning.
SAMPLE_ROWS, PRUNE_SHARE = 20_000, 3
MOST_CONDITIONS, LEAST_ROWS, LEAST_PRECISION = 4, 8, 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_stops")
#: What rules may test; every one is a plain expression over COUNTS, with 0 for an empty text.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "mean_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_UPPER, _MARKS, _STOPS = range(65, 91), [ord(c) for c in "!?"], [ord(c) for c in ".,;:"]


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that occurs twice or more; ids are below distinct."""
    if len(ids) <= window:
        return 0
    code = ids[: len(ids) - window + 1]
    for k in range(1, window):
        if distinct and int(code.max(initial=0)) > (1 << 62) // distinct:
            code = np.unique(code, return_inverse=True)[1]
        code = code * distinct + ids[k : len(ids) - window + 1 + k]
    order = np.argsort(code, kind="stable")
    same = np.concatenate([[False], np.diff(code[order]) == 0, [False]])
    often = np.zeros(len(code), bool)
    often[order] = same[1:] | same[:-1]
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : k + len(code)] |= often
    return int(covered.sum())


def counts_of(data: bytes) -> list[int]:
    """COUNTS of a text in UTF-8. bytes.split and strip know the six ASCII signs of white space only."""
    words = data.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    signs = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(signs.sum() - signs[0x80:0xC0].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        len(words), points - int(sum(signs[ord(c)] for c in SPACES)), int(sum(signs[ord(c)] for c in SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids, len(known)),
        len(lines), len(known), int(signs[_UPPER].sum()), int(signs[_MARKS].sum()), int(signs[_STOPS].sum()),
    ]


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(batches):
            table = np.array([counts_of(v.as_py() or b"") for v in batch.column("body")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in table.T.copy())], ["doc_id", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self) -> Column:
        value, limit = F.expr(FEATURES[self.feature]), F.lit(self.threshold)
        return value > limit if self.above else value <= limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row is rejected by the first whose conditions all hold, and kept if none do."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        """The number, from 1, of the rule that rejects a row, null if none does."""
        out = None
        for number, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for condition in rule[1:]:
                test = test & condition.column()
            out = F.when(test, number) if out is None else out.when(test, number)
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "\n".join(f"{k}. " + " and ".join(map(str, rule)) for k, rule in enumerate(self.rules, 1))


def covered(rule: tuple[Condition, ...], table: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def best_condition(table: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold with the greatest information gain on the rows `at`: bad rows kept times the bits that purity rises."""
    best, p0, total = None, int(bad[at].sum()), int(at.sum())
    for feature in FEATURES:
        values, hits = table[feature][at], bad[at]
        order = np.argsort(values, kind="stable")
        values, below = values[order], np.cumsum(hits[order])
        cut = np.flatnonzero(values[1:] > values[:-1])
        if not len(cut):
            continue
        for above in (False, True):
            p = p0 - below[cut] if above else below[cut]
            n = total - cut - 1 if above else cut + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - np.log2(p0 / total)), 0.0)
            k = int(gain.argmax())
            if gain[k] > (best[0] if best else 1e-9):
                low, high = float(values[cut[k]]), float(values[cut[k] + 1])
                middle = low + (high - low) / 2
                best = (float(gain[k]), Condition(feature, above, middle if low <= middle < high else low))
    return best


def grow(table: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS and bad[at].sum() and not bad[at].all():
        found = best_condition(table, bad, at)
        if found is None:
            break
        rule.append(found[1])
        at = at & found[1].holds(table)
    return tuple(rule)


def prune(rule: tuple[Condition, ...], table: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray) -> tuple[tuple[Condition, ...], int, int]:
    """(the leading conditions that reject best, bad rows, rows) on the rows `at`; fewer conditions where equal."""
    best = (-2.0, rule, 0, 0)
    for size in range(1, len(rule) + 1):
        own = at & covered(rule[:size], table, len(bad))
        n, p = int(own.sum()), int(bad[own].sum())
        if n and (2 * p - n) / n > best[0]:
            best = ((2 * p - n) / n, rule[:size], p, n)
    return best[1:]


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray, for_pruning: np.ndarray, least_precision: float = LEAST_PRECISION) -> DecisionList:
    """Rules until one is not right often enough on the pruning rows, or no bad rows are left to grow on."""
    left, rules = np.ones(len(bad), bool), []
    while bad[left & ~for_pruning].sum() >= LEAST_ROWS:
        rule = grow(table, bad, left & ~for_pruning)
        if not rule:
            break
        rule, p, n = prune(rule, table, bad, left & for_pruning)
        own = left & covered(rule, table, len(bad))
        if p < LEAST_ROWS // 2 or p < least_precision * n or bad[own].sum() < least_precision * own.sum():
            break
        rules.append(rule)
        left &= ~own
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def train(counts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """The list from at most sample_rows labelled rows that pass the base rules, chosen by a hash of doc_id
    outside the held-out fold. Without such rows, or with one quality only, it is empty."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = named.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    features = [F.expr(sql).alias(name) for name, sql in FEATURES.items()]
    # at most sample_rows rows are broadcast, and at most as many come back; of repeated ids the smallest counts stand
    rows = counts.where(~base_failed()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "quality", "c.*")
    seen = rows.select("quality", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(PRUNE_SHARE)) == 0).alias("later"), *features).orderBy("doc_id").toPandas()
    bad = (seen["quality"] == 0).to_numpy(bool)
    if not bad.any() or bad.all():
        return DecisionList(())
    return learn_list({f: seen[f].to_numpy(np.float64) for f in FEATURES}, bad, seen["later"].to_numpy(bool))


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, COUNTS, base_failed, rule (that rejects, else null), kept.

    Only doc_id and text of docs, doc_id and quality of labels are read. Null and empty texts have no
    words and fail the base rules. Repeated rows get equal results; rows without doc_id stay. Without
    labels only the base rules reject; an empty table gives an empty result.
    """
    counts = materialize(text_counts(docs), "quality-counts")
    found = train(counts, labels, sample_rows).column()
    marked = counts.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), found))
    return marked.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
