"""CSV and JSON files read by byte ranges, against reading them whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from watchpanel.sources import ranges as rg
from watchpanel.sources import readers as rd

D = "file://"


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of the wanted size in this test only."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in zip(names, before):
        spark.conf.set(n, v)


CELLS = ["a", "b,c", 'q"x"y', "l1\nl2\n\nl3", "", None, "é\r\nz", "x" * 300, '"', "\n", '""\n"', " lead", "tr ", " ", "NaN"]


@pytest.mark.parametrize("size", [1 << 27, 3000, 257, 61])
def test_csv_equals_the_one_task_read(spark, tmp_path, small_ranges, size):
    draw = random.Random(size)
    rows = [(str(i), draw.choice(CELLS), draw.choice(CELLS)) for i in range(120)]
    path = f"{D}{tmp_path}/c"
    df = spark.createDataFrame(rows, "id string, t string, `u.v` string")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    want = sorted(map(repr, spark.read.csv(path, header=True, multiLine=True, escape='"').collect()))
    small_ranges(size)
    found = rg.read_csv_ranges(spark, path)
    assert found.columns == ["id", "t", "u.v"]
    assert sorted(map(repr, found.collect())) == want
    if size < 300:
        assert rg._segments(spark, path, "\n").rdd.getNumPartitions() > 20
    numbers = sorted(r.number for r in rg.csv_records(spark, path).collect())
    assert numbers == list(range(121))


def test_csv_of_several_files_line_ends_and_blank_lines(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes(b'x,y\r\n1,"a\r\nb"\r\n\r\n2,c')
    (tmp_path / "b.csv").write_bytes('x,y\n3,"d""\n\ne"\n4,\n'.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    for size in (1 << 27, 3):
        small_ranges(size)
        paths = [f"{D}{tmp_path}/{n}.csv" for n in ("a", "b", "empty")]
        found = rg.read_csv_ranges(spark, paths).collect()
        assert sorted(map(tuple, found), key=str) == [("1", "a\r\nb"), ("2", "c"), ("3", 'd"\n\ne'), ("4", None)]


def test_quotes_that_do_not_close_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a\n2,b\n')
    with pytest.raises(Exception, match="quotes are not closed"):
        rg.read_csv_ranges(spark, f"{D}{tmp_path}/a.csv").collect()


@pytest.mark.parametrize("size", [1 << 27, 400, 37, 1])
def test_json_members_in_any_layout(spark, tmp_path, small_ranges, size):
    draw = random.Random(size)
    items = ["000001", "a,b", 'q"{x', '\\"', "\\", "]}", " é", "", "[[", "\n"]
    days = {f"2024-01-{i:02d}": [draw.choice(items) for _ in range(draw.randint(0, 6 if size == 1 else 40))] for i in range(1, 20 if size > 1 else 4)}
    for name, text in (
        ("indent", json.dumps(days, ensure_ascii=False, indent=2)), ("line", json.dumps(days)), ("none", "{}"), ("blank", " {\n } \n"),
        ("one", '{"k" : [ ] }'),
    ):
        (tmp_path / name).write_text(text)
        small_ranges(size)
        members = rg.json_members(spark, f"{D}{tmp_path}/{name}")
        found = members.select(F.from_json(F.concat(F.lit("{"), "member", F.lit("}")), "map<string,array<string>>").alias("m"))
        made = found.select(F.explode("m").alias("k", "v")).collect()
        assert {r.k: r.v for r in made} == json.loads(text) and len(made) == len(json.loads(text))


def test_lists_of_one_file_and_by_line_agree(spark, tmp_path, small_ranges):
    import datetime as dt

    days = {"2024-01-01": ["1", "000001.SZ", "2"], "2024-01-02": [], "bad": ["3"], "2024/1/3": ["ABC", "4"]}
    (tmp_path / "x.json").write_text(json.dumps(days, indent=2))
    small_ranges(16)
    period = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    found = {(str(r.date), r.entity) for r in rd.scan_daily_watchlist(spark, f"{D}{tmp_path}/x.json", *period).collect()}
    assert found == {("2024-01-01", "000001"), ("2024-01-01", "000002"), ("2024-01-03", "ABC"), ("2024-01-03", "000004")}
