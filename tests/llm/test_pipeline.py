"""The pipeline against a plain run of its stages, and the driver contract of its queries."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import packing, toxicity
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries, tokenizer_path
from tessera.llm.shared import table
from tests.llm.helpers import SF001, frame, odd_rows, words
from tests.llm.test_decontamination import plain as plain_hits
from tests.llm.test_packing import reference_ids
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_names_and_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    numbers = sorted(int(re.fullmatch(r"op(\d+)_\w+", n)[1]) for n in queries())
    assert numbers == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert set(queries()) | {"pipeline"} <= set(entry.queries())


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = table(spark, SF001, "documents")
    columns, before = docs.columns, None
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF001).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        left = {r["doc_id"]: r for r in out.collect()}
        if name == "toxicity":
            found = toxicity.classify(docs, toxicity.fit(docs, table(spark, SF001, "labels"))).collect()
            assert set(left) == {r["doc_id"] for r in found if not r["rejected"]}
        elif name == "simhash_near_dedup":
            groups = plain_components({i: plain_fingerprint(r["text"]) for i, r in rows.items()})
            assert set(left) == {i for i, g in groups.items() if i == g}
        elif name == "substring_dedup":
            # what is left of a text are words of it, in order; the first document of a passage keeps it
            for i, r in left.items():
                rest = iter(words(rows[i]["text"]))
                assert all(w in rest for w in words(r["text"])) and (r["n_chars"] == len(r["text"]) or r["text"] == rows[i]["text"])
            grams, at = set(), 60
            for i in sorted(left):
                w = words(left[i]["text"])
                own = {" ".join(w[j:j + at]) for j in range(len(w) - at + 1) if len(set(w[j:j + at])) > 20}
                assert not own & grams, i
                grams |= own
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in table(spark, SF001, "benchmark").collect()]
            assert set(left) == {i for i, r in rows.items() if plain_hits(r["text"], items)[1] == 0}
        if name != "packing":
            assert out.columns == columns and all(rows[i] == r for i, r in left.items() if name != "substring_dedup")
            before = left
        else:
            ids = dict(zip(before, reference_ids([r["text"] for r in before.values()])))
            pieces = out.collect()
            assert {i: sum(p["length"] for p in pieces if p["doc_id"] == i) for i in before} == {i: len(x) + 1 for i, x in ids.items()}
        docs = out


def test_run_and_odd_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF001)
    assert out.count() > 0 and "ids_crc32" in out.columns
    for rows in (odd_rows(), []):
        docs = frame(spark, rows, extra=False)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF001)
        got = docs.collect()
        assert {r["doc_id"] for r in got} == ({0, 2, 3, 5, 6, None} if rows else set())


def test_packing_takes_the_path_as_a_parameter(spark):
    assert packing.Encoder(tokenizer_path()).vocabulary == 50257
