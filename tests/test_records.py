"""Records of quoted files, however the files are split."""

import csv
import io
import random

import pytest

from tessera.sources import files, records


def a_file(seed, rows, end="\n"):
    pick = random.Random(seed)
    cells = ["plain", "", "a,b", 'say "it"', "two\nlines", '"', '\n"\n', "x" * 300, "é", "many\n" * 40 + "end", "\n\n"]
    table = [["id", "note", "more"]] + [[str(i), pick.choice(cells), pick.choice(cells)] for i in range(rows)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(table)
    return out.getvalue(), table


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_split_files(spark, small_splits, tmp_path, end):
    wanted = []
    for n in range(3):
        text, table = a_file(n, 120, end)
        (tmp_path / f"t{n}.csv").write_bytes(text.encode())
        wanted += table[1:]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
    got = files.read_table(spark, f"{tmp_path}/t0.csv")
    assert got.columns == ["id", "note", "more"]
    found = files.read_table(spark, str(tmp_path) + "/*.csv")
    rows = sorted((r["id"], r["note"], r["more"]) for r in [r.asDict() for r in found.na.fill("").collect()])
    assert rows == sorted((int(a), b, c) for a, b, c in wanted)


def test_one_cell_over_many_splits(spark, small_splits, tmp_path):
    long = "line, with a comma\n" * 1500
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n\n2,"x"\n3,"open\nto the end')
    got = {r["a"]: r["b"] for r in files.read_table(spark, str(tmp_path / "t.csv")).collect()}
    assert got[1] == long and got[2] == "x" and len(got) == 3


def test_header_over_two_lines_and_no_rows(spark, small_splits, tmp_path):
    (tmp_path / "t.csv").write_text('"a\nb",c\n')
    assert [tuple(r)[1:] for r in records.records(spark, str(tmp_path / "t.csv")).collect()] == [(True, '"a\nb",c')]
    assert files.read_table(spark, str(tmp_path / "t.csv")).collect() == []


def test_files_of_two_encodings(spark, small_splits, tmp_path):
    for name, encoding in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes(("k,v\n" + 'é,"ü\n""ß"""\n' * 400).encode(encoding))
    got = {tuple(r) for r in files.read_table(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {("é", 'ü\n"ß"')}
