"""The export reader against Python's csv module, with ranges so small that quotes, fields and records cross them."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from citegrid.sources import exports


@pytest.fixture
def tiny_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "100"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(rng):
    kind = rng.random()
    if kind < 0.2:
        return ""
    if kind < 0.3:
        return 'say "hi", twice ""'
    if kind < 0.45:
        return "\n".join(rng.choice(("", "line", 'a "quoted" one', ",,", '"', "x" * rng.randint(0, 200))) for _ in range(rng.randint(2, 7)))
    return "w" * rng.randint(1, 30) + " é漢"


def rows_of(rng, n):
    return [[str(i), *[value(rng) for _ in range(3)]] for i in range(n)]


def as_csv(rows, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "Title, full", "b", "c"])
    w.writerows(rows)
    return out.getvalue()


def read(spark, path):
    df = exports.read_csv(spark, str(path))
    assert df.columns == ["id", "Title, full", "b", "c", "row_order"]
    got = df.collect()
    assert sorted(r.row_order for r in got) == list(range(len(got)))
    return [["" if x is None else x for x in r[:4]] for r in sorted(got, key=lambda r: r.row_order)]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_csv_module(spark, tmp_path, tiny_ranges, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 100)
    text = as_csv(rows, "\r\n" if seed == 2 else "\n")
    if seed == 1:
        text = text.rstrip("\n")
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 15
    assert read(spark, path) == [[x.replace("\r\n", "\n") for x in r] for r in rows]


def test_same_as_the_plain_reader(spark, tmp_path, tiny_ranges):
    """Quotes in unquoted fields, text after a closing quote, blank lines, short rows, a field that its file does not end."""
    text = 'id,t,b,c\n1,5" disk,"x ""y"" ",z\n\n2,"a\n\nb",,\n3,"q" tail,u,v\n\n\n4\n5,"' + "long\n" * 100 + '",e,f\n6,un"cl,o"sed,g\n7,"no end,\nlast line,x'
    path = tmp_path / "odd.csv"
    path.write_text(text)
    plain = spark.read.csv(str(path), header=True, multiLine=True, quote='"', escape='"')
    want = [tuple(r) for r in plain.collect()]
    got = [tuple(r)[:4] for r in sorted(exports.read_csv(spark, str(path)).collect(), key=lambda r: r.row_order)]
    assert got == want


def test_several_files_and_none(spark, tmp_path, tiny_ranges):
    rng = random.Random(9)
    parts = [rows_of(rng, n) for n in (40, 0, 25)]
    folder = tmp_path / "with blank"
    folder.mkdir()
    for i, rows in enumerate(parts):
        (folder / f"part {i}.csv").write_text(as_csv(rows))
    assert read(spark, folder) == [r for p in parts for r in p]
    assert read(spark, folder / "part 1.csv") == []


def test_states_of_lines():
    """Composed states are those of one line after the other."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 2, 30).astype(np.int8), rng.integers(0, 2, 30).astype(np.int8)
        for start in (0, 1):
            state, want = start, []
            for x, y in zip(a, b, strict=True):
                state = int(y if state else x)
                want.append(state)
            assert exports._states(a, b, start).tolist() == want


def test_a_record_over_many_ranges(spark, tmp_path, tiny_ranges):
    rows = [["1", "x\n" * 1500, "b", "c"], ["2", "", "", ""], ["3", '"\n' * 500, "\n", ","]]
    path = tmp_path / "wide.csv"
    path.write_text(as_csv(rows))
    assert read(spark, path) == rows


def test_walk_feeds_in_any_parts():
    rng = random.Random(3)
    lines = as_csv(rows_of(rng, 60)).split("\n")[:-1]
    for start in (0, 1):
        whole = exports.Walk(start)
        texts = whole.feed(pa.array(lines), *exports._steps(pa.array(lines)), keep=True)
        parts, got = exports.Walk(start), []
        at = 0
        while at < len(lines):
            n = rng.randint(1, 9)
            part = pa.array(lines[at : at + n])
            got += parts.feed(part, *exports._steps(part), keep=True).to_pylist()
            at += n
        assert (got, parts.head, parts.tail, parts.ends, parts.state) == (texts.to_pylist(), whole.head, whole.tail, whole.ends, whole.state)
