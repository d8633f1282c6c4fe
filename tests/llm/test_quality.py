"""Quality: the label model recovers planted accuracies, and the query the table's labels."""

import numpy as np

from tessera.llm import quality
from tessera.llm.queries import queries
from tests.llm.helpers import SF01, frame, odd_rows, prose


def test_votes_of_clear_cases():
    import pyarrow as pa
    from tessera.llm import words as W

    good = prose(1, 60).replace(" ba", ". ba")
    texts = [good, good.upper(), good.replace(" ", "!! "), good.replace(" ", " | "), good.replace(" ", "$$$ "), "same " * 80, "", None, "a"]
    found = next(W.chunks(pa.array(texts)))[2]
    vote = quality.votes(quality.shapes(found))
    names = list(quality.LABELLERS)
    assert not (vote[0] == 0).any()
    for row, name in ((1, "capitals"), (2, "shouting"), (3, "bars"), (4, "symbols"), (5, "stutter"), (6, "length"), (8, "length")):
        assert vote[row][names.index(name)] == 0
    assert (quality.votes_of(quality.pattern_of(vote)) == vote).all()


def test_estimates_follow_planted_accuracies():
    pick = np.random.default_rng(4)
    n, k = 20_000, len(quality.LABELLERS)
    truth = (pick.random(n) < 0.8).astype(int)
    accuracy = np.linspace(0.65, 0.95, k)
    right = pick.random((n, k)) < accuracy
    vote = np.where(right, truth[:, None], 1 - truth[:, None])
    vote[pick.random((n, k)) < 0.3] = -1
    pattern, count = np.unique(quality.pattern_of(vote), return_counts=True)
    model = quality.estimate(pattern, count.astype(float))
    assert abs(model.prior - 0.8) < 0.05
    assert np.abs(np.array(list(model.accuracies().values())) - accuracy).max() < 0.06
    assert ((model.posterior(quality.pattern_of(vote)) >= 0.5) == truth).mean() > 0.93


def test_query_agrees_with_the_labels_it_never_saw(spark):
    got = {r["doc_id"]: r for r in queries()["op10_quality"](spark, SF01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(got) == 1000
    assert sum(got[i]["keep"] == y for i, y in labels.items()) >= 0.97 * len(labels)
    assert sum(got[i]["keep"] for i, y in labels.items() if y == 1) >= 0.98 * sum(labels.values())


def test_odd_rows_and_empty_tables(spark):
    docs = frame(spark, odd_rows())
    got = quality.score(docs).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert quality.score(frame(spark, [])).collect() == []
