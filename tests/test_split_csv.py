"""CSV files with line breaks in fields, read in byte ranges of any size, against Python's reader."""

import csv
import random

import pytest

from textloom.sources import readers, split_csv


@pytest.fixture()
def ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def split(size):
        for n, v in zip(names, (str(size), "0", "1"), strict=True):
            spark.conf.set(n, v)

    yield split
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def write(path, rows, ending):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=ending).writerows(rows)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_any_split_gives_the_same_rows(spark, tmp_path, ranges, monkeypatch, ending):
    rnd = random.Random(5)
    piece = lambda: rnd.choice(["a", "é", '"', '""', ",", "\n", "\n\n", " ", ";", "long " * 9])
    field = lambda: "".join(piece() for _ in range(rnd.randint(1, 6)))
    want = []
    for i in range(3):
        rows = [(str(i), field(), field()) for _ in range(9)] + [(str(i), "x" + "\ny" * 60, "end")]
        rnd.shuffle(rows)
        want += rows
        write(tmp_path / f"{i}.csv", [("k", "one", "it`s")] + rows, ending)
    whole = None
    for size, bound in ((30, 20_000), (64, 0), (10**6, 20_000)):
        ranges(size)
        monkeypatch.setattr(split_csv, "BROADCAST_ROWS", bound)
        got = sorted(map(tuple, readers.read_csv(spark, str(tmp_path), ["k", "one"]).collect()))
        whole = whole or sorted(map(tuple, spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"').select("k", "one").collect()))
        assert len(got) == len(want) and got == whole, size


def test_one_file_is_many_tasks(spark, tmp_path, ranges):
    write(tmp_path / "big.csv", [("k", "t")] + [(str(i), f"line\nof {i}") for i in range(2000)], "\n")
    ranges(4000)
    lines = split_csv.lines_of(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    assert sorted(int(r["k"]) for r in readers.read_csv(spark, str(tmp_path), ["k"]).collect()) == list(range(2000))


def test_odd_files(spark, tmp_path, ranges):
    ranges(5)
    (tmp_path / "a.csv").write_text('"k","t"\n\n1,\n,"x"\n"",""\n2,"un\nclosed')
    got = {(r["k"], r["t"]) for r in readers.read_csv(spark, str(tmp_path), ["k", "t"]).collect()}
    assert got == {(r["k"], r["t"]) for r in spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"').collect()}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "only.csv").write_text("k,t\n")
    assert readers.read_csv(spark, str(tmp_path / "b"), ["t"]).count() == 0
    with pytest.raises(ValueError, match="missing"):
        readers.read_csv(spark, str(tmp_path / "b"), ["u"])


def test_the_sample_of_lines_is_the_same_for_any_split(spark, tmp_path, ranges):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("k,t\n" + "".join(f"{name}{i},{'x' * (i % 9)}\n" for i in range(200)) + "\n")
    found = set()
    for size in (100, 999, 10**6):
        ranges(size)
        found.add(tuple(sorted(r["k"] for r in readers.sample_lines(spark, str(tmp_path), 15, ["k"]).collect())))
        lines = split_csv.numbered_lines(spark, str(tmp_path)).filter("line LIKE 'b%'").collect()
        assert {r["line"].split(",")[0]: r["number"] for r in lines} == {f"b{i}": i + 1 for i in range(200)}
    assert len(found) == 1 and len(set(*found)) == 15
