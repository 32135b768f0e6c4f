"""Toxicity categories by a chain of linear classifiers.

A document is its set of words and word prefixes, and of those that are dense in it. All features that
favour toxic documents are selected from counts over the labelled rows. Logistic models are fitted
one category after another; each later one also sees the probabilities of the earlier ones, which for
training are predicted out of fold, so that it learns from values as good as it meets later. The last
category decides.

Labels name one category only (toxic). The categories before it are found in the labelled rows: groups
of toxic documents whose features occur together, such as the vocabulary of one language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import carried

#: Labelled documents the chain is fitted on, at most (about; chosen by a hash of doc_id).
SAMPLE = 8_000
#: Toxic documents that must hold a feature, and how much likelier it must be in them.
SUPPORT, LIFT = 3, 6.0
FOLDS = 5
THRESHOLD = 0.5
#: Words that a worker remembers before it starts anew.
MEMO = 500_000
#: A feature is dense in a document if one word in so many has it.
DENSE = 100
#: Categories found before the last one, and the share of a feature's toxic documents that must lie in a group for it to join.
GROUPS, TOGETHER = 3, 0.6
CATEGORIES = [*(f"group_{k + 1}" for k in range(GROUPS)), "toxic"]
WORD = re.compile(r"[^\W\d_]+")
SCORED = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"


def features_of(word: str) -> list[str]:
    """The word itself and its prefixes of four to six letters."""
    return ["=" + word] + [word[:n] for n in (4, 5, 6) if len(word) > n]


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def all_features(text: str | None) -> set[str]:
    """Every feature of a document; a dense one's name ends in +."""
    words, got = words_of(text), Counter()
    for w, k in words.items():
        for f in features_of(w):
            got[f] += k
    n = words.total()
    return {*got, *(f + "+" for f, k in got.items() if k * DENSE >= n)}


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents; the hash filter holds on both sides before the join. Of rows that repeat an id
    the smallest text counts, so that no id takes up the sample."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000)) < int(min(1.0, sample / max(n, 1)) * 1_000_000)
    some = docs.select("doc_id", "text").where("text is not null").where(part)
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"))
    return some.join(known.where(part), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))


def select_features(rows: DataFrame) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # "" counts the documents themselves
        got = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                got[toxic > 0].update({"", *all_features(text)})
        for toxic, c in enumerate(got):
            keys = list(c)
            for at in range(0, len(keys), 10_000):
                k = keys[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([toxic] * len(k), pa.int32()), pa.array([c[x] for x in k], pa.int64())], ["f", "toxic", "n"])

    one = lambda v: F.sum(F.when(F.col("toxic") == v, F.col("n")).otherwise(0))
    counts = rows.mapInArrow(count, "f string, toxic int, n long").groupBy("f").agg(one(1).alias("bad"), one(0).alias("good"))
    useful = counts.where((F.col("bad") >= SUPPORT) | (F.col("f") == "")).persist()
    total = useful.where("f = ''").first()
    if total is None or not total["bad"]:
        useful.unpersist()
        return []
    bad = F.col("bad") / total["bad"]
    good = (F.col("good") + 0.5) / (total["good"] + 1)
    top = useful.where("f <> ''").where(bad > LIFT * good).orderBy(F.desc((bad - good) * F.log(bad / good)), "f")
    names = [r["f"] for r in top.select("f").collect()]
    useful.unpersist()
    return names


class Rows:
    """Turns texts into rows of 0 and 1 over the selected features."""

    def __init__(self, names: list[str]):
        self.place, self.memo = {f: i for i, f in enumerate(names)}, {}

    def hits(self, text: str | None) -> set[int]:
        memo, place = self.memo, self.place
        if len(memo) > MEMO:
            memo.clear()
        got: dict[str, int] = {}
        words = words_of(text)
        for w, k in words.items():
            if (known := memo.get(w)) is None:
                known = memo[w] = tuple(f for f in features_of(w) if f in place or f + "+" in place)
            for f in known:
                got[f] = got.get(f, 0) + k
        n = words.total()
        found = {place[f] for f in got if f in place}
        found.update(place[f + "+"] for f, k in got.items() if k * DENSE >= n and f + "+" in place)
        return found


def find_groups(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A column of 0 and 1 for each of GROUPS groups of toxic rows of x; row i stands for n[i] documents.

    A group starts with the feature that most toxic documents outside earlier groups have, takes in the
    features that occur with it mostly, and holds the toxic documents with any of them.
    """
    weight = toxic * n
    y, free = np.zeros((len(x), GROUPS)), weight.copy()
    for k in range(GROUPS):
        have = free @ x
        if not len(have) or have.max() <= 0:
            break
        first = x[:, have.argmax()]
        total = np.maximum(weight @ x, 1e-9)
        inside = (weight * first) @ x / total >= TOGETHER
        y[:, k] = toxic * (x[:, inside].any(axis=1) | (first > 0))
        free *= 1 - y[:, k]
    return y


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last one: intercept) by accelerated gradient steps; row i stands for n[i] equal ones."""
    share = n / n.sum()
    x = np.column_stack([x, np.ones(len(x))])
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.25 * float(v @ (x.T @ (share * (x @ v)))) + ridge)
    w = look = np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, ridge), 0]
    for k in range(rounds):
        new = look - step * (x.T @ (share * (sigmoid(x @ look) - y)) + keep * look)
        look, w = new + k / (k + 3) * (new - w), new
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


class Chain:
    def __init__(self, names: list[str], weights: list[np.ndarray]):
        self.names, self.weights, self.rows = names, weights, Rows(names)

    def scores(self, hits: set[int]) -> list[float]:
        """Probability of each category, each seeing those before it."""
        at, n, out = list(hits), len(self.names), []
        for w in self.weights:
            z = w[at].sum() + w[-1] + sum(w[n + k] * p for k, p in enumerate(out))
            out.append(float(sigmoid(z)))
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """One weight vector for each column of y, later ones over features and out-of-fold probabilities; n counts the documents of a row."""
    weights = []
    for k in range(y.shape[1]):
        weights.append(logistic(x, y[:, k], n))
        if k + 1 < y.shape[1]:
            out = np.zeros(len(x))
            for f in range(FOLDS):
                test = folds == f
                if test.any() and not test.all():
                    out[test] = apply(logistic(x[~test], y[~test, k], n[~test]), x[test])
            x = np.column_stack([x, out])
    return weights


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits on at most about `sample` labelled documents; with no toxic one, nothing is ever toxic."""
    rows = sample_rows(docs, labels, sample)
    names = select_features(rows)
    if not names:
        return Chain([], [np.array([*[0.0] * k, -40.0]) for k in range(len(CATEGORIES))])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rows(names)
        for b in batches:
            found = [sorted(r.hits(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32())), b.column("toxic")], ["doc_id", "hits", "toxic"])

    got = rows.mapInArrow(hits, "doc_id long, hits array<int>, toxic int").toArrow()
    found = sorted(zip(got.column("doc_id").to_pylist(), got.column("hits").to_pylist(), got.column("toxic").to_pylist()))
    # equal documents of a fold are one row with a count: most have no feature at all
    equal = Counter((tuple(at), t > 0, i % FOLDS) for i, (_, at, t) in enumerate(found))
    x, toxic, n = np.zeros((len(equal), len(names))), np.zeros(len(equal)), np.array(list(equal.values()), dtype=float)
    for i, (at, t, _) in enumerate(equal):
        x[i, list(at)], toxic[i] = 1, t
    y = np.column_stack([find_groups(x, toxic, n), toxic])
    return Chain(names, fit_chain(x, y, np.array([f for _, _, f in equal]), n))


def classify(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """doc_id, a probability for each category, and toxic (the last one reaches the threshold).

    Whole texts are read, however long. Null and empty texts have no features and get the base rates.
    Rows are independent: repeated rows get equal values, an empty table gives no rows, other columns are
    ignored. carry: the columns of docs come first, in place of doc_id. Features of equal score are
    selected in the order of their names.
    """
    held = docs.sparkSession.sparkContext.broadcast((chain.names, chain.weights))
    made = SCORED.split(", ", 1)[1]
    names = [x.split()[0] for x in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, memo = Chain(*held.value), {}
        for b in batches:
            got = []
            for t in b.column("text").to_pylist():
                h = frozenset(c.rows.hits(t))
                if h not in memo:
                    if len(memo) > 50_000:
                        memo.clear()
                    memo[h] = c.scores(h)
                got.append(memo[h])
            cols = [pa.array([g[k] for g in got], pa.float64()) for k in range(len(CATEGORIES))]
            flag = pa.array([g[-1] >= threshold for g in got], pa.bool_())
            old = b.schema.names if carry else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in old), *cols, flag], [*old, *names])

    if carry:
        carried(docs, names)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{fields}, {made}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
