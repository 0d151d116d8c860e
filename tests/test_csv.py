from __future__ import annotations

from pathlib import Path

from twinkeep.sources import csv_tree, sinks

ODD = [
    (1, "plain", "x"), (2, 'a "quoted" word', ""), (3, "two\nlines", None), (4, " pad ", "tail "),
    (5, "crlf\r\nend", ','), (6, None, "\\"), (7, "", '"'), (8, "back\\slash", "\\\""), (9, "\t", "a,b"),
]
SCHEMA = "k int, v string, w string"


def test_text_survives_export_and_import(spark, folder):
    rows = spark.createDataFrame(ODD, SCHEMA)
    sinks.export_report(rows, folder)
    back = csv_tree.read_export(spark, folder, SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(ODD)


def test_files_of_another_writer(spark, folder):
    """Doubled quotes and quoted line breaks, as spreadsheets write them."""
    path = Path(folder) / "srv_db"
    path.mkdir(parents=True)
    (path / "dbo_t.csv").write_text('k,v\n1,"say ""hi"""\n2,"two\nlines, one value"\n3, pad \n')
    done = csv_tree.load_csv_tree(spark, folder, f"{folder}-tables").first()
    assert done.status == "success", done.error
    rows = spark.table(f"{done.namespace}.{done.table_name}").collect()
    assert {r.k: r.v for r in rows} == {1: 'say "hi"', 2: "two\nlines, one value", 3: " pad "}


def test_a_damaged_file_fails_and_the_others_load(spark, folder):
    path = Path(folder) / "srv_broken"
    path.mkdir(parents=True)
    (path / "dbo_good.csv").write_text("k,v\n1,a\n")
    (path / "dbo_bad.csv").write_text("k,v\n1,a\n2\nx,y,z,w\n")
    schemas = {"dbo_good": "k int, v string", "dbo_bad": "k int, v string"}
    done = csv_tree.load_csv_tree(spark, folder, f"{folder}-tables", schemas).collect()
    assert {r.table_name: r.status for r in done} == {"dbo_good": "success", "dbo_bad": "failed"}


def test_two_exports_of_one_target_fail(spark, folder):
    for name in ("srv-x", "srv x"):
        path = Path(folder) / name
        path.mkdir(parents=True)
        (path / "dbo_t.csv").write_text("k\n1\n")
    done = csv_tree.load_csv_tree(spark, folder, f"{folder}-tables").collect()
    assert [r.status for r in done] == ["failed", "failed"]
