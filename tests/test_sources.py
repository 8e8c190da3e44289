import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.sources import readers as rd
from watchpanel.sources import writers as wr

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def test_documents_by_year(spark, tmp_path):
    """Several years, a column that is not mapped, quoted line breaks and quotes, a missing code."""
    header = ",".join([*fv.DOCUMENT_COLUMNS, "多余列"])
    row = '{i},{d},"标题""引号""",源,1,"第一行\n第二行",{c},简称,01,公告,2,x'
    for year in (2022, 2023, 2024):
        lines = [row.format(i=f"{year}-{k}", d=d, c=c) for k, (d, c) in enumerate(
            [(f"{year}-03-05", "000001.SZ"), (f"{year}/3/6", ""), ("bad", "600000")])]
        (tmp_path / f"announcements_{year}.csv").write_text("\n".join([header, *lines]), encoding="utf-8")
    df = rd.scan_documents(
        spark, str(tmp_path), output_start=dt.date(2024, 1, 15), output_end=dt.date(2024, 12, 31), lookback_days=60
    )
    rows = {r.id: r for r in df.collect()}
    assert sorted(rows) == ["2023-0", "2023-2", "2024-0", "2024-2"]
    r = rows["2024-0"]
    assert (r.entity, r.title, r.content, r.has_full_text) == ("000001", '标题"引号"', "第一行\n第二行", 1)
    assert r.publish_date == dt.datetime(2024, 3, 5) and rows["2024-2"].publish_date is None
    head = rd.scan_documents(
        spark, str(tmp_path), output_start=dt.date(2024, 1, 15), output_end=dt.date(2024, 12, 31), lookback_days=60, head=1
    )
    assert sorted(r.id for r in head.collect()) == ["2023-0", "2024-0"]
    landed = str(tmp_path / "landed")
    rd.land_documents(df.where(F.col("publish_date").isNotNull()), landed)
    back = rd.scan_landed_documents(
        spark, landed, output_start=dt.date(2024, 3, 1), output_end=dt.date(2024, 12, 31), lookback_days=20
    )
    assert [r.id for r in back.collect()] == ["2024-0"]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_status_intervals(spark, tmp_path):
    path = tmp_path / "st.csv"
    path.write_text(
        "s_info_windcode,other,entry_dt,remove_dt,s_type_st\n000001.SZ,x,20200102,20210304.0,S\n 2.SH ,x,20200102,,S\n3,x,,20200101,S\n",
        encoding="utf-8",
    )
    df = rd.scan_status_intervals(spark, [str(tmp_path / "none.csv"), str(path)])
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0] == ("000001", dt.date(2020, 1, 2), dt.date(2021, 3, 4), "S")
    assert rows[1] == ("000002", dt.date(2020, 1, 2), None, "S") and rows[2][1] is None
    with pytest.raises(FileNotFoundError):
        rd.scan_status_intervals(spark, [str(tmp_path / "none.csv")])


def test_label_matrix(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("day,1,600000.SH\n2024-01-01,0.5,NaN\n2024-01-02,7,0\n2030-01-01,1,1\n", encoding="utf-8")
    df = rd.scan_label_matrix(spark, str(path), D, day(5))
    rows = {(r.date, r.entity): (r.label_in_file, r.y_label_empty, r.y_label_value) for r in df.collect()}
    assert rows == {
        (day(0), "000001"): (1, 0, 0.5), (day(0), "600000"): (1, 1, None),
        (day(1), "000001"): (1, 0, 1.0), (day(1), "600000"): (1, 0, 0.0),
    }
    truth = {(r.date, r.entity): r.y_status for r in rd.truth_rows(df).collect()}
    assert truth[(day(0), "600000")] == 1 and sum(truth.values()) == 1


def test_watchlist_documents_in_any_layout(spark, tmp_path):
    document = {"2024-01-01": ["1", "000001", "600000.SH"], "2024-01-02": [], "nonsense": ["9"], "2025-01-01": ["9"]}
    for name, indent in (("wide.json", None), ("tall.json", 2)):
        path = tmp_path / name
        path.write_text(json.dumps(document, indent=indent), encoding="utf-8")
        rows = rd.scan_daily_watchlist(spark, str(path), D, day(9)).collect()
        assert sorted((r.date, r.entity) for r in rows) == [(D, "000001"), (D, "600000")]
    reasons = {"2024-01-01": [{"stock_code": "1", "risk_score": 70, "is_st": 0, "ann_daily": "文]}, {"}, {"stock_code": "2", "risk_score": 66, "is_st": 0, "ann_daily": ""}], "2024-01-02": []}
    path = tmp_path / "reasons.json"
    path.write_text(json.dumps(reasons, indent=2, ensure_ascii=False), encoding="utf-8")
    rows = sorted(tuple(r) for r in rd.scan_reasoned_watchlist(spark, str(path)).collect())
    assert rows == [(D, 1, "1", 70, 0, "文]}, {"), (D, 2, "2", 66, 0, "")]


def test_written_document_is_one_json_object(spark, tmp_path):
    days = spark.createDataFrame(
        [(day(i), 0, [f"{i:06d}", "x]}"] if i % 2 else []) for i in range(30)], "date date, part int, entities array<string>"
    ).repartition(5)
    path = str(tmp_path / "doc")
    wr.write_document(days, "entities", path)
    files = sorted((tmp_path / "doc").glob("part-*"))
    document = json.loads("".join(f.read_text() for f in files))
    assert list(document) == [str(day(i)) for i in range(30)]
    assert document["2024-01-02"] == ["000001", "x]}"] and document["2024-01-01"] == []
    rows = rd.scan_daily_watchlist(spark, path, D, day(40), by_line=True).collect()
    assert {(r.date, r.entity) for r in rows} == {
        (day(i), e) for i in range(1, 30, 2) for e in (f"{i:06d}", "x]}")
    }


def test_days_in_parts_are_one_value_of_the_document(spark, tmp_path):
    days = spark.createDataFrame([(D, 0, ["a"]), (D, 1, ["b"])], "date date, part int, entities array<string>")
    long = days.unionByName(spark.createDataFrame([(day(1), 0, []), (day(2), 0, ["c"]), (day(2), 1, ["d"]), (day(2), 2, ["]}"])], days.schema))
    wr.write_document(long.repartition(4), "entities", str(tmp_path / "doc"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "doc").glob("part-*")))
    assert json.loads(text) == {"2024-01-01": ["a", "b"], "2024-01-02": [], "2024-01-03": ["c", "d", "]}"]}
    maps = spark.createDataFrame([(D, 1, {"a": 0.5}), (D, 4, {"b": None})], "date date, part int, labels map<string,double>")
    wr.write_document(maps, "labels", str(tmp_path / "maps"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "maps").glob("part-*")))
    assert json.loads(text) == {"2024-01-01": {"a": 0.5, "b": None}}
    wr.write_day_objects(days, str(tmp_path / "rows"))
    rows = rd.scan_watchlist_rows(spark, str(tmp_path / "rows"), D, D).collect()
    assert {r.entity for r in rows} == {"a", "b"}


@pytest.mark.parametrize("files", [1, 3])
def test_days_in_parts_are_read_back_whole(spark, tmp_path, files):
    from watchpanel.operators import watchlist as wl

    listed = spark.createDataFrame(
        [(day(d), i + 1, f"{d}{i:05d}") for d, n in enumerate((7, 0, 1, 4, 5, 2)) for i in range(n)], "date date, rank int, entity string"
    )
    want = sorted((r.date, r.entity) for r in listed.collect())
    path = str(tmp_path / "doc")
    wr.write_document(wl.daily_arrays(listed, D, day(6), part_size=2), "entities", path)
    if files == 1:
        lines = [line for f in sorted((tmp_path / "doc").glob("part-*")) for line in f.read_text().splitlines()]
        path = str(tmp_path / "one.json")
        (tmp_path / "one.json").write_text("\n".join(lines) + "\n")
    rows = rd.scan_daily_watchlist(spark, path, D, day(6), by_line=True).collect()
    assert sorted((r.date, r.entity) for r in rows) == want
    texts = ("", 'a "{[,]}" \\ of', "]},", "[]", "x],")
    told = listed.select(
        "date", "rank", "entity", F.col("rank").cast("bigint").alias("risk_score"), F.lit(0).alias("is_st"),
        F.element_at(F.array(*map(F.lit, texts)), F.col("rank") % 5 + 1).alias("ann_daily"),
    )
    reasons = wl.daily_arrays(told, D, day(6), element=wl.reason_struct(), part_size=2)
    wr.write_document(reasons, "entities", str(tmp_path / "reasons"))
    rows = rd.scan_reasoned_watchlist(spark, str(tmp_path / "reasons"), by_line=True).collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in told.collect())


@pytest.mark.parametrize("text", [
    '{"2024-01-01":["a"],\n "2024-01-02":["b" "c"]}\n',
    '{"2024-01-01":["a",\n "2024-01-02":["b"]}\n',
    '{"2024-01-01":["a"],\n"b"]}\n',
])
def test_broken_document_is_no_result(spark, tmp_path, text):
    (tmp_path / "doc.json").write_text(text)
    with pytest.raises(Exception, match="no part of a document|a part of a day is missing"):
        rd.scan_daily_watchlist(spark, str(tmp_path / "doc.json"), D, day(9), by_line=True).collect()


def test_peek_nonzero(spark):
    df = spark.createDataFrame(
        [("b", D, 0.0, 1.0, 0.0, 0.0), ("a", D, 0.0, 0.0, 0.0, 0.0), ("a", day(1), 0.0, 0.0, 0.0, 5.0)],
        "entity string, date date, financial_risk double, normative_risk double, illegal_risk double, other_risk double",
    )
    assert [(r.entity, r.date) for r in rd.peek_nonzero(df, 20).collect()] == [("a", day(1)), ("b", D)]
    assert tuple(rd.nonzero_counts(df).first()) == (3, 2)


def test_label_matrix_of_a_whole_market_plans_fast(spark, tmp_path):
    import time

    n = 5400
    lines = ["date," + ",".join(f'"{i:06d}.SZ"' for i in range(n))]
    for k in range(1, 4):
        lines.append(f"2024/1/{k}," + ",".join("" if i % 7 == 0 else "2.5" if i % 11 == 0 else str(i / n) for i in range(n)))
    lines += ["2024-01-04,1", "2025-01-01," + ",".join(["1"] * n), ""]
    (tmp_path / "m.csv").write_bytes("\r\n".join(lines).encode())
    best = 9e9
    for _ in range(3):
        began = time.perf_counter()
        df = rd.scan_label_matrix(spark, f"file://{tmp_path}/m.csv", dt.date(2024, 1, 1), dt.date(2024, 12, 31))
        df._jdf.queryExecution().executedPlan()
        best = min(best, time.perf_counter() - began)
    assert best < 3  # under one second on a quiet machine
    rows = df.collect()
    assert len(rows) == 4 * n
    found = {(r.entity, str(r.date)): (r.y_label_empty, r.y_label_value) for r in rows}
    assert found["000007", "2024-01-01"] == (1, None) and found["000011", "2024-01-02"] == (0, 1.0)
    assert found["000027", "2024-01-03"] == (0, 27 / n) and found["000000", "2024-01-04"] == (0, 1.0)
    assert found["000001", "2024-01-04"] == (1, None)


def test_one_csv_file_from_many_tasks(spark):
    import os

    from watchpanel.sources import readers as rd
    from watchpanel.sources import writers as wr
    from watchpanel.sources.storage import scratch_path

    rows = [(str(i), f'a "{i}"\nline, two' * (i % 5) or None) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, `a ""text""` string".replace('""', "'")).repartition(7)
    path = scratch_path(spark, "one") + "/all.csv"
    wr.write_csv_file(df, path)
    assert os.path.isfile(path.removeprefix("file:"))
    for by_ranges in (False, True):
        back = rd.read_csv(spark, path, by_ranges=by_ranges)
        assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(rows)
    stages = spark.sparkContext.statusTracker()
    # no stage of the write has all the rows in one task
    spark.sparkContext.setJobGroup("one-file", "one-file")
    wr.write_csv_file(df, scratch_path(spark, "one") + "/again.csv")
    ran = [stages.getStageInfo(s) for j in stages.getJobIdsForGroup("one-file") for s in stages.getJobInfo(j).stageIds]
    assert 7 in [s.numTasks for s in ran if s]
    empty = scratch_path(spark, "one") + "/none.csv"
    wr.write_csv_file(df.limit(0), empty)
    assert rd.read_csv(spark, empty).collect() == []
