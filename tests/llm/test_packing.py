"""Packing: exact round trip, few cuts of padding, Hilbert order."""

import itertools
import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import tokenizer_path
from tests.llm.helpers import SF001, frame, odd_rows, prose


def reference_ids(texts):
    slow = Tokenizer.from_file(tokenizer_path())
    return [slow.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_hilbert_visits_each_cell_once_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_encoder_gives_the_ids_of_the_vocabulary_file(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    texts += ["", "  two  spaces \n\n\t x", "it's 1234 café́ ßİ² z", "<|endoftext|> inside", "日本語 \U0001f600‍ x", "a" * 5000, "\x00\x85 "]
    encode = packing.Encoder(tokenizer_path())
    assert [encode(t) for t in texts] == reference_ids(texts)


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark):
    rows = odd_rows() + [(10 + i, prose(i, 50 + 13 * i), "en", "s", 1) for i in range(60)]
    docs = frame(spark, rows)
    got = packing.pieces(docs, tokenizer_path()).collect()
    ids = [x + [packing.END_ID] for x in reference_ids([r[1] for r in rows])]
    whole = sorted(np.array(x, "<u4").tobytes() for x in ids)
    sequences = {}
    for r in got:
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append(r)
    order = []
    for number in sorted(sequences):
        parts = sorted(sequences[number], key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == [0, *np.cumsum([p["length"] for p in parts])[:-1]]
        size = sum(p["length"] for p in parts)
        assert size == parts[0]["sequence_length"] and size & (size - 1) == 0 and size <= 1024
        order += parts
    assert sorted(sequences) == list(range(len(sequences)))
    # along the line, each document's pieces follow one another
    rebuilt, at = [], 0
    for p in order:
        at = at if p["start"] else 0
        assert p["start"] == at
        rebuilt.append(p["ids"]) if p["start"] == 0 else rebuilt.append(rebuilt.pop() + p["ids"])
        at += p["length"]
        assert len(rebuilt[-1]) <= 4 * p["doc_tokens"]
    assert sorted(rebuilt) == whole
    joined = packing.sequences(packing.pieces(docs, tokenizer_path())).orderBy("sequence_id").collect()
    assert b"".join(r["ids"] for r in joined) == b"".join(rebuilt)


def test_copies_lie_side_by_side_and_empty_tables_pack_nothing(spark):
    rows = [(i, prose(i % 5, 40), "en", "s", 1) for i in range(30)]
    got = packing.pieces(frame(spark, rows), tokenizer_path()).orderBy("sequence_id", "offset").collect()
    run = [r["doc_id"] % 5 for r in got if r["start"] == 0]
    assert len([1 for a, b in zip(run, run[1:]) if a != b]) == 4
    assert packing.pieces(frame(spark, []), tokenizer_path()).collect() == []
