"""Toxicity scores by a convolutional text classifier trained in numpy (operator 9).

A word's vector is the sum of three hashed embeddings: of the whole word and of
its first 4 and first 5 bytes (so inflected forms share evidence). Filters of
widths 1, 2 and 3 run over the whole text; each filter's largest response is
kept (max pooling) and a logistic layer makes the score. Training runs on the
driver over a bounded sample (``MAX_DOCS``, ``MAX_BYTES``); scoring runs where
the texts are, over all of them. Thresholds are set for each language on all
labelled rows that weren't trained on; they turn scores into decisions and are no input of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.samples import sample_texts
from tessera.llm.shared import cut

BUCKETS = 1 << 15
PREFIXES = (None, 4, 5)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Bounds of the training sample.
MAX_DOCS, MAX_BYTES = 6000, 16_000_000
STEPS, RATE, BATCH = 900, 0.02, 32
#: Prior documents behind each bucket's first estimate.
PRIOR = 2.0
#: Steps in which scores are counted for the thresholds.
BINS = 1 << 12
#: A language gets its own threshold from so many calibration rows of either class.
LEAST_ROWS = 10


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One logit for each text; text d has the words first[d]:first[d+1] of ``buckets`` (words x 3)."""
        x, begin = self.padded(buckets, first)
        return np.concatenate([pool for _, pool in self.pools(x, begin)], axis=1) @ self.out + self.bias

    def padded(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors with PAD empty ones after each text, and where each text begins."""
        n = len(first) - 1
        begin = first[:-1] + PAD * np.arange(n)
        x = np.zeros((len(buckets) + PAD * n + PAD, DIM), dtype=np.float32)
        place = np.arange(len(buckets)) + np.repeat(PAD * np.arange(n), np.diff(first))
        x[place] = self.embedding[buckets[:, 0]] + self.embedding[buckets[:, 1]] + self.embedding[buckets[:, 2]]
        return x, begin

    def pools(self, x: np.ndarray, begin: np.ndarray):
        """For each width: the responses at every place and their maximum within each text (at least 0).

        Places from which a window would reach into the next text don't count.
        """
        rows = len(x) - PAD
        stop = np.append(begin[1:], rows)
        for width in WIDTHS:
            y = x[:rows] @ self.filters[width][0]
            for o in range(1, width):
                y += x[o:rows + o] @ self.filters[width][o]
            y += self.biases[width]
            for o in range(1, width):
                y[stop - o] = -np.inf
            yield y, np.maximum(np.maximum.reduceat(y, begin, axis=0), 0)


def word_buckets(found: W.Words) -> np.ndarray:
    """Three bucket numbers for each word."""
    return np.stack([(found.hashes(most) >> np.uint64(20 + j)).astype(np.int64) % BUCKETS + j * BUCKETS
                     for j, most in enumerate(PREFIXES)], axis=1) if len(found.start) else np.zeros((0, 3), dtype=np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_array(column: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(column), dtype=np.float64)
    for row, stop, found in W.chunks(column):
        out[row:stop] = _sigmoid(model.logits(word_buckets(found), found.first).astype(np.float64))
    return out


def _start(texts: list[np.ndarray], target: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Embeddings whose first component is each bucket's shrunken log-odds over the sample's documents."""
    counts = np.zeros((2, len(PREFIXES) * BUCKETS))
    for buckets, y in zip(texts, target, strict=True):
        counts[y, np.unique(buckets)] += 1
    share = target.mean()
    odds = np.log((counts[1] + PRIOR * share) / (counts[0] + PRIOR * (1 - share))) - np.log(share / (1 - share))
    embedding = rng.normal(0, 0.05, (len(PREFIXES) * BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = odds / 2
    return embedding


def _train(texts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, seed: int) -> Model:
    """Gradient steps on the weighted log loss; pooling passes each gradient to one window of a text."""
    rng = np.random.default_rng(seed)
    filters = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, ::2] += 0.5  # half of the filters start on the log-odds
    model = Model(_start(texts, target, rng), filters, {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS},
                  np.full(FILTERS * len(WIDTHS), 0.1, dtype=np.float32), -1.0)
    scale = {name: 1e-8 for name in ("out", "bias")}  # running squares for step sizes
    square_f = {w: np.full_like(filters[w], 1e-8) for w in WIDTHS}
    square_b = {w: np.full(FILTERS, 1e-8, dtype=np.float32) for w in WIDTHS}
    square_e = np.full(len(model.embedding), 1e-4, dtype=np.float32)
    scale["out"] = np.full_like(model.out, 1e-8)
    per_pass = -(-len(texts) // BATCH)
    for _ in range(-(-STEPS // per_pass)):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            buckets = np.concatenate([texts[i] for i in rows])
            first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in rows])))
            x, begin = model.padded(buckets, first)
            ys, pools = zip(*model.pools(x, begin), strict=True)
            h = np.concatenate(pools, axis=1)
            error = (_sigmoid(h @ model.out + model.bias) - target[rows]) * weight[rows] / len(rows)
            grad_h = np.outer(error, model.out) * (h > 0)
            grad = h.T @ error
            scale["out"] += grad * grad
            scale["bias"] += error.sum() ** 2
            model.out -= (RATE * grad / np.sqrt(scale["out"])).astype(np.float32)
            model.bias -= RATE * float(error.sum()) / float(np.sqrt(scale["bias"]))
            grad_x, touched = {}, []
            stop = np.append(begin[1:], len(x) - PAD)
            for j, width in enumerate(WIDTHS):
                best = np.stack([a + ys[j][a:b].argmax(axis=0) for a, b in zip(begin, stop, strict=True)])
                g = grad_h[:, j * FILTERS:(j + 1) * FILTERS].astype(np.float32)
                before = filters[width].copy()
                for o in range(width):
                    grad_f = np.einsum("df,dfk->kf", g, x[best + o])
                    square_f[width][o] += grad_f * grad_f
                    filters[width][o] -= RATE * grad_f / np.sqrt(square_f[width][o])
                    touched.append((best + o, g[:, :, None] * before[o].T[None]))
                square_b[width] += g.sum(axis=0) ** 2
                model.biases[width] -= RATE * g.sum(axis=0) / np.sqrt(square_b[width])
            word_at = np.full(len(x), -1)
            word_at[np.arange(len(buckets)) + np.repeat(PAD * np.arange(len(rows)), np.diff(first))] = np.arange(len(buckets))
            place = np.concatenate([p.ravel() for p, _ in touched])
            delta = np.concatenate([d.reshape(-1, DIM) for _, d in touched])
            real = word_at[place] >= 0
            ids = buckets[word_at[place[real]]]
            used, slot = np.unique(ids, return_inverse=True)
            sums = np.zeros((len(used), DIM), dtype=np.float32)
            np.add.at(sums, slot.reshape(ids.shape), delta[real][:, None, :])
            square_e[used] += (sums ** 2).mean(axis=1)
            model.embedding[used] -= RATE * sums / np.sqrt(square_e[used])[:, None]
    return model


def _best_threshold(counts: np.ndarray) -> float:
    """The score that gives the best F1, from (target, bin) counts or weights of scores in ``BINS`` equal steps.

    It lies in the middle between the lowest rejected bin and the next lower bin with rows.
    """
    hits, all_ = (np.cumsum(x[::-1]) for x in (counts[1], counts.sum(axis=0)))
    used = np.flatnonzero(counts.sum(axis=0)[::-1])
    best = int((2 * hits[used] / (all_[used] + counts[1].sum())).argmax())
    low = BINS - 1 - used[best]
    below = BINS - 1 - used[best + 1] + 1 if best + 1 < len(used) else 0
    return float((low + below) / 2 / BINS)


def not_held_out(doc_id) -> F.Column:
    """Rows that labels may be learned from: crc32 of the id as text leaves a remainder by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _calibrate(model: Model, docs: DataFrame, target: DataFrame, fitted: DataFrame) -> None:
    """Set the model's thresholds from the scores of all rows of ``target`` (doc_id, target) that aren't ``fitted`` (doc_id).

    Spark counts scores by language, target and bin. Each class weighs as it
    does among all rows of ``target``, since the fitted rows were drawn evenly
    from both. Of rows that share a doc_id one counts.
    """
    text = F.col("text").cast("string")
    each = docs.filter(F.col("doc_id").isNotNull() & not_held_out(F.col("doc_id"))) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("h"), scores(text, model).alias("score"), "lang").alias("x"))
    scored = each.groupBy("doc_id").agg(F.min("x").alias("x"))
    step = F.least(F.floor(F.col("x.score") * BINS), F.lit(BINS - 1)).cast("int")
    got = scored.join(target, "doc_id").join(F.broadcast(fitted), "doc_id", "left_anti") \
        .groupBy(F.col("x.lang").alias("lang"), "target", step.alias("step")).count().toPandas()
    totals = {r["target"]: r["count"] for r in target.groupBy("target").count().collect()}
    seen = got.groupby("target")["count"].sum()
    if len(seen) < 2:
        return

    def best(rows) -> float:
        counts = np.zeros((2, BINS))
        np.add.at(counts, (rows["target"].to_numpy(), rows["step"].to_numpy()), rows["count"].to_numpy(dtype=np.float64))
        return _best_threshold(counts * [[totals[y] / seen[y]] for y in (0, 1)])

    model.threshold = best(got)
    for name, rows in got.groupby("lang"):  # without rows whose lang is null
        sizes = rows.groupby("target")["count"].sum()
        if len(sizes) == 2 and sizes.min() >= LEAST_ROWS:
            model.thresholds[name] = best(rows)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, seed: int = 7) -> Model | None:
    """Train on ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text, lang).

    Only ids outside the held-out fold are used; a fifth of the sample and all
    that aren't in it set the thresholds. Ids labelled twice count as
    toxic if one label says so. None if there are not two classes to learn.
    """
    target = labels.filter(not_held_out(F.col("doc_id")) & F.col("toxic").isNotNull()) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("target"))
    target = cut(target, "targets")
    got = sample_texts(docs, target, max_docs, max_bytes)
    if len(set(got["target"])) < 2:
        return None
    y = got["target"].to_numpy(dtype=np.int64)
    texts = []
    for _, _, found in W.chunks(pa.array(got["text"], type=pa.string())):
        buckets = word_buckets(found)
        texts += [buckets[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    # each class weighs as in the population, so 0.5 is the even bet there
    weight = (got["n_target"] / got.groupby("target")["doc_id"].transform("count")).to_numpy(dtype=np.float64)
    weight /= weight.mean()
    rest = np.random.default_rng(seed).permutation(len(y))[len(y) // 5:]
    if len(set(y[rest])) < 2:
        rest = np.arange(len(y))
    model = _train([texts[i] for i in rest], y[rest], weight[rest], seed)
    _calibrate(model, docs, target, docs.sparkSession.createDataFrame(got.iloc[rest][["doc_id"]], "doc_id long"))
    return model


def scores(text, model: Model | None) -> F.Column:
    """Score column (0 to 1) of a text column; null texts score like empty ones; 0 without a model."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(score_array(column, model))

    return score(text)


def threshold_for(lang, model: Model | None) -> F.Column:
    """The score from which a document of this language is rejected."""
    if model is None:
        return F.lit(1.1)
    cases = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        cases = F.when(lang == name, value).otherwise(cases)
    return cases


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, threshold, rejected) for every row of ``docs`` (doc_id, text, lang; others are ignored).

    Repeated rows repeat; empty tables give none; a null or wordless text is
    scored as a text without words. rejected: score >= its language's threshold.
    """
    marked = docs.select("doc_id", scores(F.col("text").cast("string"), model).alias("score"), threshold_for(F.col("lang"), model).alias("threshold"))
    return marked.withColumn("rejected", F.col("score") >= F.col("threshold"))


def keep_accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rejected rows; all columns as they were."""
    mark = "__toxicity"
    marked = docs.withColumn(mark, scores(F.col("text").cast("string"), model))
    return marked.filter(F.col(mark) < threshold_for(F.col("lang"), model)).drop(mark)
