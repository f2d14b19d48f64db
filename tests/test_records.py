import csv
import random

import pytest
from pyspark.sql import functions as F

from prepkit.sources import csv as c
from prepkit.sources import records as r

SCHEMA = "a string, b string, n bigint"


@pytest.fixture
def ranged(spark):
    """Ranges of 150 bytes, so that records are cut at many places."""
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def written(path, rows, end="\n", header=("a", "b", "n")):
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)


def cells(chance):
    return "".join(chance.choice(["x", "word ", '"', ",", "\n", "\n\n", "é", " ", "\r\n", "long " * 40]) for _ in range(chance.randint(0, 6)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(2))
def test_cut_anywhere(ranged, tmp_path, seed, end):
    chance, want = random.Random(seed), []
    for f in range(3):
        rows = [(cells(chance), cells(chance), str(i)) for i in range(chance.choice([0, 3, 25]))]
        rows += [("a\nb", "z", "1")]
        written(tmp_path / f"{f}.csv", rows, end)
        want += [(a or None, b or None, int(n)) for a, b, n in rows]
    found = r.ranges(ranged, str(tmp_path))
    assert found and found.number > 3
    for read in (c.scan_csv, c.read_csv_tolerant, c.read_csv_strict):
        got = [tuple(x) for x in read(ranged, str(tmp_path), SCHEMA).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    inferred = c.read_csv_null_set(ranged, str(tmp_path), markers=())
    assert dict(inferred.dtypes)["n"] == "bigint" and inferred.count() == len(want)


def test_many_tasks_for_one_file(ranged, tmp_path):
    rows = [(f"line\nbreak {i}", "x", i) for i in range(120)]
    written(tmp_path / "one.csv", rows)
    df = c.scan_csv(ranged, str(tmp_path), SCHEMA)
    tasks = r.records(ranged, str(tmp_path), r.ranges(ranged, str(tmp_path))).filter("length(value) > 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 10 and df.count() == 120
    found = r.ranges(ranged, str(tmp_path))
    shuffled = r.Ranges(found.states, r.SENT_RANGES + 1)
    assert sorted(x["value"] for x in r.records(ranged, str(tmp_path), shuffled).collect()) == sorted(x["value"] for x in r.records(ranged, str(tmp_path), found).collect())


def test_a_cell_over_many_ranges(ranged, tmp_path):
    rows = [("x" * 500 + "\n" + "y\n" * 400, "b", 1), ("c", "d\n", 2)]
    written(tmp_path / "one.csv", rows)
    assert sorted(map(tuple, c.scan_csv(ranged, str(tmp_path), SCHEMA).collect())) == sorted(rows)


@pytest.mark.parametrize("body", ['5" pipe,x,1\n"a\nb",y,2\n', '"a\nb",5",2\n"c",y,3\n', 'a"b,x,1\n"a\nb",y,2\n', '"a\nb",y,2\n"open\n'])
def test_other_quotes_are_left_to_the_parser(ranged, tmp_path, body):
    (tmp_path / "one.csv").write_text("a,b,n\n" + body)
    assert r.ranges(ranged, str(tmp_path)) is None
    whole = c.scan_csv(ranged, str(tmp_path), SCHEMA, multi_line=True).collect()
    assert c.scan_csv(ranged, str(tmp_path), SCHEMA).collect() == whole


def test_strict_still_stops(ranged, tmp_path):
    for bad in ("1,2", "1,2,3,4", "1,2,x"):
        (tmp_path / "one.csv").write_text(f'a,b,n\n"l\nb",x,1\n{bad}\n')
        with pytest.raises(Exception):
            c.read_csv_strict(ranged, str(tmp_path), SCHEMA).collect()
        assert c.read_csv_tolerant(ranged, str(tmp_path), SCHEMA).count() == 2


def test_header_with_a_line_break(ranged, tmp_path):
    written(tmp_path / "one.csv", [("x", "y\n", 1)], header=("a\nb", "c", "n"))
    df = c.read_csv_tolerant(ranged, str(tmp_path))
    assert df.columns == ["a\nb", "c", "n"] and [tuple(x) for x in df.collect()] == [("x", "y\n", 1)]


def test_blank_lines_and_no_rows(ranged, tmp_path):
    (tmp_path / "one.csv").write_text("\n" * 200 + '  \na,b,n\n\n"x\n\ny",z,1\n \n')  # the first range has blank lines only
    assert [tuple(x) for x in c.scan_csv(ranged, str(tmp_path), SCHEMA).collect()] == [("x\n\ny", "z", 1)]
