"""Quality scores from a weak-label model (operator 10).

Overlapping heuristic labellers vote good (1), bad (0) or abstain (-1) on each
text; those that look for a defect say nothing where they find none. Expectation-maximisation over the counts of vote patterns estimates how
accurate each labeller is, without labels; the posterior of a document's
pattern is its soft label. A linear scorer over hashed byte trigrams and shape
features learns the soft labels from a bounded sample (``MAX_DOCS``,
``MAX_BYTES``) and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.samples import sample_texts
from tessera.llm.shared import cut

LABELLERS = ("symbols", "capitals", "shouting", "stutter", "variety", "bars", "punctuation", "sentences", "word_length", "length")
BUCKETS, SHAPE_BUCKETS = 1 << 15, 16
#: Bounds of the scorer's training sample.
MAX_DOCS, MAX_BYTES = 4000, 12_000_000
ROUNDS, STEPS, RATE = 100, 100, 0.5
START, BELIEF = (0.8, 0.2, 0.85), 0.2
#: Trigrams are looked up in runs of so many bytes.
RUN = 1 << 20

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = ~W.WORD_BYTE
_PUNCTUATION[[*range(9, 14), 32]] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True


def shapes(found: W.Words) -> np.ndarray:
    """For each text, by the columns of ``SHAPES``."""
    total = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), found.offsets[:-1]) * (np.diff(found.offsets) > 0)
    size = np.maximum(np.diff(found.offsets), 1)
    n = found.counts
    words = np.maximum(n, 1)
    hashes = found.hashes()
    again = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        again[1:-1] = hashes[1:] == hashes[:-1]
        starts = found.first[:-1][n > 0]
        again[starts] = 0
    sums = np.concatenate(([0], np.cumsum(again[:-1])))
    stutter = (sums[found.first[1:]] - sums[found.first[:-1]]) / words
    lengths = np.concatenate(([0], np.cumsum(found.end - found.start)))
    mean_length = (lengths[found.first[1:]] - lengths[found.first[:-1]]) / words
    capitals = total(_UPPER[found.data]) / np.maximum(total(_LETTER[found.data]), 1)
    text = found.text_of_word()
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    variety = np.bincount(text[order][fresh], minlength=found.n) / np.sqrt(words)
    return np.stack([total(_SYMBOL[found.data]) / size, capitals, total(found.data == ord("!")) / words, stutter, variety, total(found.data == ord("|")) / words,
                     total(_PUNCTUATION[found.data]) / size, total(found.data == ord(".")) / words, mean_length, n], axis=1).astype(np.float64)


def votes(shape: np.ndarray) -> np.ndarray:
    """One vote of each labeller on each text: 1 good, 0 bad, -1 abstain."""
    symbols, capitals, shouting, stutter, variety, bars, marks, stops, length, n = shape.T
    pick = lambda good, bad: np.where(bad, 0, np.where(good, 1, -1))
    return np.stack([
        pick(False, symbols > 0.05), pick(False, capitals > 0.5), pick(False, shouting > 0.2), pick(False, stutter > 0.1),
        pick((variety > 5) | (variety > 0.6 * np.sqrt(n)), (variety < 2) & (n >= 20)), pick(False, bars > 0.2), pick(marks < 0.08, marks > 0.12),
        pick((stops > 0.01) & (stops < 0.34), (stops == 0) & (n > 40)), pick((length >= 3) & (length <= 12), (length < 2) | (length > 20)),
        pick(n >= 8, n < 4)], axis=1).astype(np.int8)


def pattern_of(vote: np.ndarray) -> np.ndarray:
    """One number for each row of votes, in base 3."""
    return ((vote.astype(np.int64) + 1) * 3 ** np.arange(vote.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


@dataclass
class LabelModel:
    """P(good), and for each labeller P(vote | class) as a (labeller, class, vote + 1) table."""

    prior: float
    table: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        vote = votes_of(np.asarray(pattern, dtype=np.int64)) + 1
        logs = np.log([1 - self.prior, self.prior])[None] + np.log(self.table[np.arange(vote.shape[1])[None], :, vote]).sum(axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        odds = np.exp(logs)
        return odds[:, 1] / odds.sum(axis=1)

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.table[:, 0, 1] + p[1] * self.table[:, 1, 2]
        return dict(zip(LABELLERS, (right / (p[:, None] * self.table[:, :, 1:].sum(axis=2).T).sum(axis=0)).tolist(), strict=True))


def estimate(pattern: np.ndarray, count: np.ndarray) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    At first, ``START`` is the share of good documents among all, and among
    those that one labeller calls bad or good. These first tables keep the
    weight of ``BELIEF`` of all documents, so that a class can't shrink to a
    few odd texts.
    """
    overall, bad, good = START
    if not len(pattern):
        return LabelModel(overall, np.full((len(LABELLERS), 2, 3), 1 / 3))
    vote = votes_of(pattern)
    table = np.zeros((len(LABELLERS), 2, 3))
    for v, share in ((-1, overall), (0, bad), (1, good)):
        seen = ((vote == v) * count[:, None]).sum(axis=0) + 0.5
        table[:, 0, v + 1], table[:, 1, v + 1] = seen * (1 - share) / (1 - overall), seen * share / overall
    start = table / table.sum(axis=2, keepdims=True)
    model = LabelModel(overall, start)
    before = BELIEF * count.sum() * np.array([1 - overall, overall])
    for _ in range(ROUNDS):
        good = model.posterior(pattern)
        mass = np.stack([count * (1 - good), count * good])
        new = np.stack([(mass[:, :, None] * (vote == v)[None]).sum(axis=1) for v in (-1, 0, 1)], axis=2)  # class, labeller, vote
        new = new.transpose(1, 0, 2) + before[None, :, None] * start
        model = LabelModel(float(np.clip(mass[1].sum() / max(count.sum(), 1), 0.01, 0.99)), new / new.sum(axis=2, keepdims=True))
    return model


def features(found: W.Words, row: int, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and their weights for one text: trigrams by their share, shapes by one each."""
    data = found.data[found.offsets[row]:found.offsets[row + 1]].astype(np.uint32)
    shape_ids = BUCKETS + np.arange(shape.shape[1]) * SHAPE_BUCKETS + np.clip(shape[row] * _SCALE, 0, SHAPE_BUCKETS - 1).astype(np.int64)
    if len(data) < 3:
        return shape_ids, np.ones(len(shape_ids))
    counts = np.zeros(BUCKETS)
    for at in range(0, len(data) - 2, RUN):
        x = data[at:at + RUN + 2]
        counts += np.bincount(((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return np.concatenate([at, shape_ids]), np.concatenate([np.sqrt(counts[at] / (len(data) - 2)), np.ones(len(shape_ids))])


#: Shape features and their steps.
SHAPES = {"symbol share": 100, "capital share": 16, "exclamation marks a word": 16, "repeated words": 50, "distinct words by root of words": 1,
          "bars a word": 16, "punctuation share": 64, "full stops a word": 40, "word length": 1, "words": 0.1}
_SCALE = np.array(list(SHAPES.values()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (and a bias, last) that fit soft targets by full gradient steps on the log loss."""
    size = BUCKETS + len(LABELLERS) * SHAPE_BUCKETS
    rows = np.repeat(np.arange(len(texts)), [len(i) for i, _ in texts])
    ids, values = np.concatenate([i for i, _ in texts]), np.concatenate([v for _, v in texts])
    w, squares = np.zeros(size + 1), np.full(size + 1, 1e-6)
    weight = weight / weight.sum()
    for _ in range(STEPS):
        z = np.bincount(rows, w[ids] * values, minlength=len(texts)) + w[-1]
        error = (_sigmoid(z) - target) * weight
        grad = np.append(np.bincount(ids, error[rows] * values, minlength=size), error.sum()) + np.append(1e-6 * w[:-1], 0)
        squares += grad ** 2
        w -= RATE * grad / np.sqrt(squares)
    return w


def voted(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for row, stop, found in W.chunks(batch.column(1)):
                out[row:stop] = pattern_of(votes(shapes(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, pattern long")


def label_model(patterns: DataFrame) -> LabelModel:
    """The model of all rows' votes; there are no more than 3**10 different patterns."""
    counts = patterns.groupBy("pattern").count().orderBy("pattern").toPandas()
    return estimate(counts["pattern"].to_numpy(), counts["count"].to_numpy(dtype=np.float64))


def fit_scorer(docs: DataFrame, patterns: DataFrame, model: LabelModel, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> np.ndarray | None:
    """Weights of the linear scorer, from a sample of both likely good and likely bad documents."""
    known = patterns.select("pattern").distinct().toPandas()["pattern"].to_numpy()
    if not len(known):
        return None
    # one line for each pattern, 3**10 at most
    likely = docs.sparkSession.createDataFrame(list(zip(known.tolist(), (model.posterior(known) >= 0.5).astype(int).tolist(), strict=True)), "pattern long, target int")
    target = patterns.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("pattern").alias("pattern")) \
        .join(F.broadcast(likely), "pattern").select("doc_id", "target")
    got = sample_texts(docs, target, max_docs, max_bytes)
    if got.empty:
        return None
    texts, soft = [], []
    for _, _, found in W.chunks(pa.array(got["text"], type=pa.string())):
        shape = shapes(found)
        soft.append(model.posterior(pattern_of(votes(shape))))
        texts += [features(found, i, shape) for i in range(found.n)]
    weight = (got["n_target"] / got.groupby("target")["doc_id"].transform("count")).to_numpy(dtype=np.float64)
    return train(texts, np.concatenate(soft), weight)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) for every row of ``docs`` (doc_id, text; others are ignored).

    votes has one sign for each labeller (+ good, - bad, . abstain), posterior
    is the label model's, score the scorer's; documents with score >= 0.5 are
    kept. Null texts are empty texts. Repeated rows repeat; of rows that share
    a doc_id one may teach the scorer. An empty table gives an empty result.
    """
    patterns = cut(voted(docs), "votes")
    model = label_model(patterns)
    weights = fit_scorer(docs, patterns, model)

    @F.arrow_udf("struct<votes:string,posterior:double,score:double>")
    def judge(column: pa.Array) -> pa.Array:
        signs, posteriors, scores = [], [], []
        for _, _, found in W.chunks(column):
            shape = shapes(found)
            vote = votes(shape)
            signs += ["".join(".-+"[v + 1] for v in row) for row in vote.tolist()]
            posterior = model.posterior(pattern_of(vote))
            posteriors.append(posterior)
            if weights is None:
                scores.append(posterior)
                continue
            z = np.zeros(found.n)
            for i in range(found.n):
                ids, values = features(found, i, shape)
                z[i] = (weights[ids] * values).sum() + weights[-1]
            scores.append(_sigmoid(z))
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.float64())
        return pa.StructArray.from_arrays([pa.array(signs, pa.string()), flat(posteriors), flat(scores)], names=["votes", "posterior", "score"])

    got = docs.select("doc_id", judge(F.col("text").cast("string")).alias("x"))
    return got.select("doc_id", "x.votes", "x.posterior", "x.score", (F.col("x.score") >= 0.5).cast("int").alias("keep"))
