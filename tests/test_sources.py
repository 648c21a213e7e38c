"""Registry files, exports and the streaming upsert."""

import json
import zipfile

import pytest

from quillon.sources import readers, sinks
from quillon.streaming import ingest


def test_csv_aliases_and_bom(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿NCES School ID,School Name,State,WEBSITE\n001,NORTH HS,tx,www.n.example.org\n002,\"A \"\"B\"\" C\",KS,N\n".encode())
    df = readers.read_directory(spark, str(p))
    assert df.columns == ["NCESSCH", "SCH_NAME", "ST", "WEBSITE"]
    assert [r["SCH_NAME"] for r in df.orderBy("NCESSCH").collect()] == ["NORTH HS", 'A "B" C']


def test_html_xls(spark, tmp_path):
    p = tmp_path / "a.xls"
    p.write_bytes("<html><table><tr><td>Note</td></tr><tr></tr><tr><th>School ID</th><th>School Name</th></tr><tr><td>1</td><td>Caf\xe9 &amp; Co</td></tr></table></html>".encode("windows-1252"))
    assert [tuple(r) for r in readers.read_directory(spark, str(p)).collect()] == [("1", "Café & Co")]


def test_html_without_header(spark, tmp_path):
    p = tmp_path / "a.xls"
    p.write_bytes(b"<html><table><tr><td>x</td></tr></table></html>")
    with pytest.raises(ValueError, match="header"):
        readers.read_directory(spark, str(p))


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "North <HS>", None), ("2", "South", "https://s.example.org")], "`School ID` string, `School Name` string, WEBSITE string")
    assert sinks.export_xlsx(df, str(tmp_path / "a.xlsx"), links=(2,)) == 2
    got = readers.read_directory(spark, str(tmp_path / "a.xlsx"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "North <HS>", ""), ("2", "South", "https://s.example.org")]


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        readers.read_directory(spark, "a.txt")


def test_pick_member(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b\n")
        z.writestr("y.csv", "NCESSCH,SCH_NAME\n")
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert readers.pick_member(z) == "y.csv"


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert sinks.export_csv(df, str(tmp_path / "out")) == 1
    assert sinks.export_csv(df.limit(0), str(tmp_path / "none")) == 0
    assert not (tmp_path / "none").exists()


def test_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    doc = {"school": {"nces_id": "7", "school_name": "North", "state": "tx"}, "status": "OK", "records": [{"name": "GRETA HOLM", "title": "Art", "email": "g@example.org"}, {"name": " ", "title": "x"}]}
    blank = {"school": {"nces_id": "", "school_name": "None"}, "records": [{"name": "Hugo Marsh"}]}
    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps(doc) + "\n" + json.dumps(blank) + "\n")
        ingest.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    s = spark.read.parquet(str(tmp_path / "out" / "schools")).collect()
    t = spark.read.parquet(str(tmp_path / "out" / "staff")).collect()
    assert [(r["nces_id"], r["state"]) for r in s] == [("7", "TX")]
    assert [(r["teacher_name"], r["resolution_method"]) for r in t] == [("Greta Holm", "scraped")]


def test_stream_updates_schools(spark, tmp_path):
    """A later payload changes what a crawl sets, and neither the school's name nor staff that is there."""
    src = tmp_path / "in"
    src.mkdir()
    doc = {"school": {"nces_id": "7", "school_name": "North"}, "status": "TIMEOUT", "records": [{"name": "GRETA HOLM", "title": "Art"}]}
    later = {"school": {"nces_id": "7", "school_name": "Other"}, "status": "OK", "directory_url": "https://n.example/staff", "resolution": {"entity_type": "SCHOOL", "resolution_confidence": 0.72}, "paths_attempted": [{"url": "u", "status": "403", "rejected_because": None}], "records": [{"name": "Greta Holm", "title": "Band"}, {"name": "hugo marsh", "title": "Art"}]}
    for k, d in enumerate((doc, later, later)):
        (src / f"{k}.json").write_text(json.dumps(d) + "\n")
        ingest.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    s = spark.read.parquet(str(tmp_path / "out" / "schools")).collect()
    assert [(r["nces_id"], r["school_name"], r["status"], r["scrape_status"], r["scraped"], r["directory_url"], r["entity_type"], r["resolution_confidence"]) for r in s] == [("7", "North", "OK", "OK", 1, "https://n.example/staff", "SCHOOL", 0.72)]
    assert json.loads(s[0]["paths_attempted"]) == [{"url": "u", "status": "403", "rejected_because": None}]
    t = spark.read.parquet(str(tmp_path / "out" / "staff")).orderBy("teacher_name").collect()
    assert [(r["teacher_name"], r["title"], r["email_verified"]) for r in t] == [("Greta Holm", "Art", 0), ("Hugo Marsh", "Art", 0)] and all(r["added_at"] for r in t)


def test_html_rows_of_nested_and_open_tables():
    page = b"<html><table><tr><th>A<th>B &lt;x&gt;<tr><td>1<td>two <table><tr><td>in</td></tr></table> more</td></tr><!-- <tr><td>no</td></tr> --><tr><td> </td></tr></table>"
    assert list(readers.html_rows(page)) == [["A", "B <x>"], ["in"], ["1", "two  more"]]


def test_files_with_different_headers(spark, tmp_path):
    for k, head in enumerate((["School ID", "School Name"], ["School ID", "City", "STABR", "ST"])):
        cells = "".join(f"<td>{h}</td>" for h in head)
        (tmp_path / f"{k}.xls").write_text(f"<html><table><tr>{cells}</tr><tr>" + "".join(f"<td>{k}{i}</td>" for i in range(len(head))) + "</tr></table>")
    got = readers._table(spark, str(tmp_path / "*.xls"), readers.html_rows)
    assert sorted(tuple(r[c] for c in ("School ID", "SCH_NAME", "LCITY", "ST")) for r in got.collect()) == [("00", "01", None, None), ("10", None, "11", "12")]


def test_two_state_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NCESSCH,ST,STABR\n1,TX,KS\n2,,KS\n")
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()) == [("1", "TX"), ("2", "KS")]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a,b\n")
        z.writestr("y.csv", '\ufeffNCESSCH,SCH_NAME\n001,"North, ""N"""\n002\n')
    assert sorted(tuple(r) for r in readers.read_directory(spark, str(tmp_path / "a.zip")).collect()) == [("001", 'North, "N"'), ("002", "")]


def test_pdf_without_a_library(spark):
    df = spark.createDataFrame([("a.pdf", b"no pdf"), ("b.pdf", None)], "path string, content binary")
    assert {(r["path"], r["text"], r["method"]) for r in readers.pdf_texts(df).collect()} == {("a.pdf", "", "unavailable"), ("b.pdf", "", "unavailable")}


def test_reference_index(spark):
    rows = spark.createDataFrame([("1", "North H.S.", "North ISD", "9", "tx", "Open"), ("2", "South", "S", "8", "TX", "Open "), ("3", "East", "E", "7", "TX", None)], "NCESSCH string, SCH_NAME string, LEA_NAME string, LEAID string, ST string, SY_STATUS_TEXT string")
    assert sorted((r["nces_id"], r["norm"], r["district_norm"], r["state"]) for r in readers.reference_index(rows).collect()) == [("1", "north h s", "north independent school district", "TX"), ("3", "east", "e", "TX")]
