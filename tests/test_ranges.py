"""Large single files by byte ranges: equal to Spark's own one-task readers, whatever the ranges."""

import json
import random

import numpy as np
import pytest

from scriptorium.sources import ranges as G
from scriptorium.sources import readers as R

FIELDS = ["plain", "", '"', '""', 'a "quoted" word', "two\nlines", "\n", '\n"\n', ",", ',"', '",', "x,y\n,z", "é日本", "  edge  ", "\r\n inside", '","', "long " * 40, "5 o'clock", "tab\t"]


def _csv(rows, newline="\n"):
    def cell(v, rng):
        if v is None:
            return ""
        if v == "" or any(c in v for c in ',"\n\r') or rng.random() < 0.3:
            return '"' + v.replace('"', '""') + '"'
        return v

    rng = random.Random(1)
    return newline.join(["ID,note,TEXT", *(",".join([str(i), cell(a, rng), cell(b, rng)]) for i, a, b in rows)]) + newline


def _rows(n, seed=2):
    rng = random.Random(seed)
    return [(i, rng.choice([*FIELDS, None]), "".join(rng.choice(FIELDS) for _ in range(rng.randint(1, 4)))) for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [150, 1_000, 20_000])
def test_csv_in_ranges(spark, tmp_dir, small_ranges, size):
    rows = _rows(1500 if size > 500 else 120)
    path = f"{tmp_dir}/notes.csv"
    with open(path, "w", newline="") as f:
        f.write(_csv(rows))
    want = sorted(map(tuple, R.read_csv_notes(spark, path).collect()))
    small_ranges(size)
    assert G._units(spark, path, G.CsvUnits()).rdd.getNumPartitions() > 3
    out = G.read_csv_ranges(spark, path)
    assert out.columns == ["ID", "note", "TEXT"]
    got = sorted(map(tuple, out.collect()))
    assert got == want and sorted((int(i), b) for i, _, b in got) == [(i, b) for i, _, b in rows]


def test_many_tasks_hold_records(spark, tmp_dir, small_ranges):
    from pyspark.sql import functions as F

    path = f"{tmp_dir}/notes.csv"
    with open(path, "w", newline="") as f:
        f.write(_csv(_rows(3000)))
    small_ranges(30_000)
    units = G._units(spark, path, G.CsvUnits())
    states = G._range_states(units, G.CsvUnits())
    tasks = G._records(units, G.CsvUnits(), states, 0).where("begins AND ends").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == units.rdd.getNumPartitions() > 5


def test_a_record_longer_than_ranges(spark, tmp_dir, small_ranges):
    rows = [(0, "a", "first"), (1, "b", 'line "x"\n,' * 800), (2, None, "last")]
    with open(f"{tmp_dir}/a.csv", "w", newline="") as f:
        f.write(_csv(rows))
    small_ranges(1_000)
    got = sorted(map(tuple, G.read_csv_ranges(spark, f"{tmp_dir}/a.csv", "ID long, note string, TEXT string").collect()))
    assert got == rows


def test_crlf_several_files_and_no_last_line_break(spark, tmp_dir, small_ranges):
    a, b = _rows(60, 5), [(i + 100, n, t) for i, n, t in _rows(60, 6)]
    for name, rows, newline in (("a", a, "\r\n"), ("b", b, "\n")):
        with open(f"{tmp_dir}/{name}.csv", "w", newline="") as f:
            f.write(_csv(rows, newline).rstrip("\r\n"))
    want = sorted(map(tuple, R.read_csv_notes(spark, tmp_dir).collect()))
    small_ranges(400)
    got = [tuple(r) for r in G.read_csv_ranges(spark, tmp_dir).collect()]
    assert sorted((int(i), b) for i, _, b in got) == [(i, t) for i, _, t in a + b]  # values stay byte for byte
    # the one-task reader turns CRLF inside of quotes into LF where the file's lines end in CRLF
    plain = [tuple(v and v.replace("\r\n", "\n") for v in r) for r in got]
    assert sorted(plain, key=str) == sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in want), key=str) and len(want) == 120


def test_data_rows_that_look_like_the_header_and_blank_lines(spark, tmp_dir, small_ranges):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write("A,B\nA,B\n\n1,2\n\n")
    small_ranges(6)
    assert sorted(map(tuple, G.read_csv_ranges(spark, f"{tmp_dir}/a.csv").collect())) == [("1", "2"), ("A", "B")]
    open(f"{tmp_dir}/empty.csv", "w").close()
    assert G.read_csv_ranges(spark, f"{tmp_dir}/empty.csv", "A string, B string").count() == 0


STRINGS = ["plain", "", "}", "{", "]}", '"', '\\"', "\\", '\\\\"}', "a\nb", "é日本 ", '{"x": [1, 2]}', "tail\\"]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [70, 900, 30_000])
def test_json_arrays_in_ranges(spark, tmp_dir, small_ranges, indent, size):
    rng = random.Random(size)

    def value():
        return "".join(rng.choice(STRINGS) for _ in range(rng.randint(0, 4)))

    rows = [{"id": i, "text": value(), "more": [{"a": value(), "b": [value()]} for _ in range(rng.randint(0, 2))]} for i in range(1200 if size > 100 else 80)]
    with open(f"{tmp_dir}/a.json", "w") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=bool(indent))
    schema = "id long, text string, more array<struct<a: string, b: array<string>>>"
    want = sorted(map(str, R.read_json_array(spark, f"{tmp_dir}/a.json", schema).collect()))
    small_ranges(size)
    units = G._units(spark, f"{tmp_dir}/a.json", G.JsonUnits())
    assert units.rdd.getNumPartitions() > 2
    got = G.read_json_array_ranges(spark, f"{tmp_dir}/a.json", schema).collect()
    assert sorted(map(str, got)) == want
    assert sorted(r.id for r in got) == list(range(len(rows))) and {r.id: r.text for r in got} == {r["id"]: r["text"] for r in rows}


def test_empty_and_single_json_arrays(spark, tmp_dir):
    for name, body in (("a", "[]"), ("b", ""), ("c", ' [ {"id": 7} ] \n')):
        with open(f"{tmp_dir}/{name}.json", "w") as f:
            f.write(body)
    assert [r.id for r in G.read_json_array_ranges(spark, tmp_dir, "id long").collect()] == [7]


@pytest.mark.parametrize("kind,alphabet", [(G.CsvUnits(), '"",\na'), (G.JsonUnits(), '"\\\\{}[]a')])
def test_states_compose(kind, alphabet):
    """The state after a text is the same however it is cut into ranges at its units."""
    rng = random.Random(9)
    for _ in range(300):
        units = ["".join(rng.choice(alphabet.replace(kind.separator, "")) for _ in range(rng.randint(0, 8))) + kind.separator for _ in range(rng.randint(1, 12))]
        if "\\" in alphabet:
            units = [u[:-1].rstrip("\\") + u[-1] for u in units]

        def parts(pieces):
            data = np.frombuffer("".join(pieces).encode(), np.uint8)
            return data, np.cumsum([len(p) for p in pieces]) - 1

        cut, whole = kind.cut(*parts(units), kind.start)
        state, k, flags = kind.start, 0, []
        while k < len(units):
            n = rng.randint(1, 4)
            piece = parts(units[k : k + n])
            known = None
            for u in units[k : k + n]:
                known = kind.summary(*parts([u]), known)
            assert known == kind.summary(*piece, None)
            done, after = kind.cut(*piece, state)
            state = kind.apply(known, state)
            assert state == after
            flags += done.tolist()
            k += n
        assert state == whole and flags == cut.tolist()
