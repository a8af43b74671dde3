"""Toxicity by weak supervision.

Many voters, the words of a lexicon and word-beginning patterns found in labelled rows, vote for toxic
or abstain. A generative model with a latent class estimates their rates and their correlations, as a
tree of dependences, by EM; the given labels only pick the voters. A linear classifier is trained on the posterior labels
and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, materialize, text_or_empty

#: Insults that vote whatever the labels say.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")

SAMPLE_ROWS = 20_000
MINED_VOTERS = 400
PREFIXES = (4, 5, 6, 7)
#: How many toxic rows a mined voter must have at least: chosen on one fold of five of the learning rows.
SUPPORTS = (2, 3, 5, 8)
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def normal_form(text: str) -> str:
    """Lower-case words of letters, each between single spaces."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


class Voters:
    """Counts the words that equal a voter (' word ') or begin with it (' word')."""

    def __init__(self, names: list[str]):
        self.names = names
        self.machine = ahocorasick.Automaton()
        for i, name in enumerate(names):
            self.machine.add_word(name, i)
        self.machine.make_automaton()

    def counts(self, text: str) -> np.ndarray:
        normal = normal_form(text)
        found = [i for _, i in self.machine.iter(normal)]
        return np.bincount(found, minlength=len(self.names)) if found else np.zeros(len(self.names), np.int64)


def word_forms(labelled: DataFrame) -> DataFrame:
    """form, and in how many rows and toxic rows it stands: hits and n, without those of the inner fold fit_hits and fit_n."""
    words = F.array_distinct(F.split(F.lower("body"), r"[^\p{L}]+"))
    forms = F.transform(
        F.filter(words, lambda w: w != ""),
        lambda w: F.concat(
            F.array(F.concat(F.lit(" "), w, F.lit(" "))),
            F.transform(F.filter(F.array(*[F.lit(n) for n in PREFIXES]), lambda n: n <= F.length(w)), lambda n: F.concat(F.lit(" "), F.substring(w, F.lit(1), n))),
        ),
    )
    each = labelled.select("toxic", "inner", F.explode(F.array_distinct(F.flatten(forms))).alias("form"))
    fit = (~F.col("inner")).cast("int")
    counted = each.groupBy("form").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic") * fit).alias("fit_hits"), F.sum(fit).alias("fit_n"))
    return counted.where(F.col("hits") >= min(SUPPORTS))


def mine_voters(forms: DataFrame, support: int, hits: str = "hits", n: str = "n", limit: int = MINED_VOTERS) -> list[str]:
    """At most `limit` words and word beginnings whose rows are toxic far above the base rate."""
    strength = (F.col(hits) + 0.2) / (F.col(n) + 2)
    best = forms.where((F.col(hits) >= support) & (strength > 0.6)).orderBy(F.desc(strength * F.log(hits)), "form").limit(limit)
    base = {f" {w} " for w in LEXICON}
    return [*(f" {w} " for w in LEXICON), *(r["form"] for r in best.collect() if r["form"] not in base)]


def dependence_tree(votes: np.ndarray, p: np.ndarray, least: float = 0.02) -> np.ndarray:
    """The parent of each voter, or -1, in the tree (forest) of the strongest dependences given the class.

    A pair's strength is its mutual information given the class, as that of normal variables of the same
    correlations; pairs below `least` stay apart.
    """
    strength = np.zeros((votes.shape[1], votes.shape[1]))
    for w in (p, 1 - p):
        total = w.sum() + 1e-9
        mean = w @ votes / total
        joint = (votes * w[:, None]).T @ votes / total - np.outer(mean, mean)
        spread = np.sqrt(np.clip(np.diag(joint), 1e-12, None))
        strength -= total / len(p) * np.log1p(-np.clip((joint / np.outer(spread, spread)) ** 2, 0, 0.9999)) / 2
    parent = np.full(votes.shape[1], -1)
    best, source, out = np.full(votes.shape[1], least), np.full(votes.shape[1], -1), np.zeros(votes.shape[1], bool)
    for _ in range(votes.shape[1]):
        at = int(np.where(out, -1.0, best).argmax())
        out[at], parent[at] = True, source[at]
        closer = ~out & (strength[at] > best)
        best[closer], source[closer] = strength[at][closer], at
    return parent


def class_rates(votes: np.ndarray, above: np.ndarray, both: np.ndarray, w: np.ndarray, extra: float) -> np.ndarray:
    """(2, voters): how often each votes in a class of row weights w, where its parent abstains and where it votes."""
    total, up, hit, with_up = w.sum(), w @ above, w @ votes, w @ both
    rates = np.stack([(hit - with_up + extra) / (total - up + 1), (with_up + extra) / (up + 1)])
    return np.clip(rates, 1e-4, 1 - 1e-4)


def log_odds(votes: np.ndarray, above: np.ndarray, both: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Sum over voters of the log ratio of what they do in the two classes, given their parents' votes."""
    on, off = np.log(toxic / clean), np.log((1 - toxic) / (1 - clean))
    return votes @ (on[0] - off[0]) + above @ (off[1] - off[0]) + both @ (on[1] - on[0] - off[1] + off[0]) + off[0].sum()


def label_model(votes: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior probability of toxic for each row by EM over a latent class, without any given label.

    Each voter's rates depend on the class and on the vote of its parent in the dependence tree, which
    is estimated with them: voters that say the same count once. It starts from whether anybody votes.
    """
    votes = votes.astype(np.float32)
    p = np.where(votes.any(axis=1), 0.9, 0.02)
    above, both = np.zeros_like(votes), np.zeros_like(votes)
    for k in range(rounds):
        if k in (4, 10, 16):
            parent = dependence_tree(votes, p)
            above = np.where(parent >= 0, votes[:, parent], 0).astype(np.float32)
            both = above * votes
        toxic, clean = class_rates(votes, above, both, p, 0.5), class_rates(votes, above, both, 1 - p, 0.05)
        odds = np.log((p.sum() + 1) / ((1 - p).sum() + 1)) + log_odds(votes, above, both, toxic, clean)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def features(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 3).astype(np.float64)


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities by damped Newton steps; weights and intercept."""
    table = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(table.shape[1])

    def loss(v: np.ndarray) -> float:
        odds = table @ v
        return float((np.logaddexp(0, odds) - p * odds).sum() + (penalty * v * v).sum() / 2)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(table @ w, -30, 30)))
        slope = table.T @ (q - p) + penalty * w
        move = np.linalg.solve((table * (q * (1 - q) + 1e-9)[:, None]).T @ table + np.diag(penalty), slope)
        size = 1.0
        while size > 1e-3 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def counted_votes(rows: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of each voter, toxic, inner fold) of the rows of the sample, in order of doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [np.minimum(voters.counts(t), 255).astype(np.uint8).tobytes() for t in batch["body"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "inner": batch["inner"], "counts": lines})

    seen = rows.mapInPandas(run, "doc_id long, toxic int, inner boolean, counts binary").toPandas().sort_values("doc_id")
    return np.frombuffer(b"".join(seen["counts"]), np.uint8).reshape(len(seen), len(voters.names)), seen["toxic"].to_numpy(int), seen["inner"].to_numpy(bool)


def fitted(counts: np.ndarray) -> tuple[np.ndarray, float]:
    return fit_linear(features(counts), label_model(counts > 0))


def right_calls(counts: np.ndarray, toxic: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """The F1 of calling rows toxic; 0 where none is found."""
    called = features(counts) @ weights + intercept >= 0
    hits = float((called & (toxic == 1)).sum())
    return 2 * hits / max(called.sum() + (toxic == 1).sum(), 1)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Voters, np.ndarray, float]:
    """(voters, weights, intercept), from at most sample_rows labelled rows outside the held-out fold,
    chosen by a hash of doc_id. Without such rows the lexicon alone scores.

    The least support of a mined voter is the one that does best on an inner fold, a fifth of the learning
    rows, when voters come from the rest; of equal ones the larger. Of several texts of a doc_id the smallest is read.
    """
    learn = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows rows are broadcast
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("body")).join(F.broadcast(chosen), "doc_id")
    inner = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("inner")), F.lit(5)) == 0
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("body").alias("body")).withColumn("inner", inner), "toxic-sample")
    forms = materialize(word_forms(rows), "toxic-forms")
    known = {s: (mine_voters(forms, s, "fit_hits", "fit_n"), mine_voters(forms, s)) for s in SUPPORTS}
    every = list(dict.fromkeys(v for pair in known.values() for names in pair for v in names))
    counts, toxic, inside = counted_votes(rows, Voters(every))
    lexicon = Voters(known[SUPPORTS[0]][0][: len(LEXICON)])
    if len(set(toxic.tolist())) < 2:
        return lexicon, np.full(len(LEXICON), 4.0), -2.0
    place = {name: k for k, name in enumerate(every)}
    best, support = -1.0, SUPPORTS[-1]
    for s in reversed(SUPPORTS):
        own = counts[:, [place[v] for v in known[s][0]]]
        if inside.any() and not inside.all():
            score = right_calls(own[inside], toxic[inside], *fitted(own[~inside]))
            if score > best:
                best, support = score, s
    names = known[support][1]
    return Voters(names), *fitted(counts[:, [place[v] for v in names]])


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score at least 0.5) for each row of docs.

    Only doc_id and text of docs and doc_id and toxic of labels are read, and only the text makes the
    score. Null and empty texts are scored like a text without any vote; rows without doc_id are
    scored, and not held out; repeated rows get equal scores.
    """
    voters, weights, intercept = train(docs, labels, sample_rows)
    names = voters.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(names)
        for batch in given_back(batches):
            odds = np.array([float(features(own.counts(t.as_py())) @ weights) + intercept for t in batch.column("body")])
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5; one pass over the texts after training.

    Rows pass as they are, repeated ones and those without doc_id too; a null text is scored as empty.
    An empty table gives an empty result, and columns may have any names.
    """
    voters, weights, intercept = train(docs, labels, sample_rows)
    names = voters.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(names)
        for batch in given_back(batches):
            odds = np.array([float(features(own.counts(t.as_py() or "")) @ weights) + intercept for t in batch.column("text")])
            yield batch.filter(pa.array(odds < 0, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
