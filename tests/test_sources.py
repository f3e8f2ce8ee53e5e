"""Readers on files written here, and news lines worked out by hand."""

import zipfile
from datetime import datetime

import pytest

from ripplegraph.sources import files, newswire


def test_jsonl_tolerant_drops_only_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "s": "a"}\n{"k": 2, "s":\nnot json\n{"k": 3}\n')
    assert sorted((r.k, r.s) for r in files.read_jsonl_tolerant(spark, str(tmp_path), "k int, s string").collect()) == [(1, "a"), (3, None)]
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt"):
        files.read_jsonl(spark, str(tmp_path), "k int, s string").collect()


def test_jsonl_round_trip_and_parquet_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "j"), "k int, s string").collect()) == sorted(df.collect())
    df.write.parquet(str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p"), "s string").columns == ["s"]
    with pytest.raises(ValueError, match="k, x"):
        files.read_parquet(spark, str(tmp_path / "p"), "k long, s string, x int")


def test_dated_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Made by hand\n\n,mkt,rf\n20200102, 1.50, 0.01\n20200103,-2.00,\n Notes: 2020\n")
    got = files.read_dated_csv(spark, str(tmp_path / "f.csv"), ["mkt", "rf"]).orderBy("date").collect()
    assert [(str(r.date), r.mkt, r.rf) for r in got] == [("2020-01-02", 0.015, 0.0001), ("2020-01-03", -0.02, None)]


def line(**fields):
    cells = [""] * newswire.COLUMNS
    for name, value in fields.items():
        cells[newswire.PLACES[name]] = value
    return "\t".join(cells)


def test_records_from_zipped_slices(spark, tmp_path):
    good = line(record_id="r1", published="20240102030405", kind="1", v2orgs="Acme, Inc,12;;no place;Bolt,90", themes="ECON_A;;B;", tone="-1.5,1,2,7.25", amounts="3.5,dollars,40;bad;", extras="<X><PAGE_TITLE>Hello</PAGE_TITLE>", translation="srclc:fra")
    odd = line(record_id="r2", published="someday", tone="")
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.csv", f"{good}\n{odd}\nshort\tline\n".encode() + b"\xff\n")
    rows = {r.record_id: r for r in newswire.parse_records(newswire.read_slices(spark, str(tmp_path))).collect()}
    assert set(rows) == {"r1", "r2"}
    r = rows["r1"]
    assert [(o.name, o.off) for o in r.v2orgs] == [("Acme, Inc", 12), ("Bolt", 90)] and r.themes == ["ECON_A", "B"]
    assert (r.published_ts, r.tone, r.polarity, r.title, r.is_web, r.is_translingual) == (datetime(2024, 1, 2, 3, 4, 5), -1.5, 7.25, "Hello", True, True)
    assert [(a.value, a.object, a.off) for a in r.amounts] == [(3.5, "dollars", 40)]
    assert (rows["r2"].published_ts, rows["r2"].tone, rows["r2"].title, rows["r2"].v2orgs) == (None, None, None, [])
