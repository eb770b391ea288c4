from __future__ import annotations

import random

import pytest

from feedback_engine.sources import csv_records as C
from feedback_engine.sources import files


def cell(dice) -> str:
    kinds = ["plain", "", 'say ""hi""', "a;b", "two\nlines", "three\n\n\nlines", "end\r\nmark", "é€", "x" * 60, '""', ' pad ']
    text = dice.choice(kinds)
    return f'"{text}"' if any(c in text for c in ';"\n\r') or dice.random() < 0.2 else text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two files; most records hold quoted line breaks, and some are longer than several splits."""
    dice, out = random.Random(3), tmp_path_factory.mktemp("csv")
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        lines = ["id;text;other"]
        for i in range(400):
            text = '"' + "long\n" * 300 + '"' if i % 97 == 0 else cell(dice)
            lines.append(f"{i};{text};{cell(dice)}")
            if i % 50 == 7:
                lines.append("")
        (out / name).write_text("﻿" * (name == "a.csv") + end.join(lines) + end, encoding="utf-8", newline="")
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("split", ["200b", "1k", "7k", "100m"])
def test_equals_the_slow_reader(spark, folder, split):
    """Splits down to a fraction of a record give the rows of the one-task reader."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        slow = as_rows(spark.read.csv(f"{folder}/b.csv", header=True, sep=";", multiLine=True, quote='"', escape='"', lineSep="\r\n"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = C.read_csv_records(spark, f"{folder}/b.csv", ";")
        assert found.columns == ["id", "text", "other"] and as_rows(found) == slow
        both = C.read_csv_records(spark, f"{folder}/*.csv", ";", file_column="file")
        assert both.groupBy("file").count().count() == 2 and both.count() == 800
        assert both.where("id is null").count() == 0
        if split == "1k":
            n_tasks = C._lines(spark, f"{folder}/b.csv").rdd.getNumPartitions()
            assert n_tasks >= 20
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_default_reader_keeps_quoted_breaks(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text('id,text\n1,"a\nb"\n2,c\n')
    found = files.read_by_suffix(spark, str(path))
    assert as_rows(found) == [("1", "a\nb"), ("2", "c")]
    typed = files.read_by_suffix(spark, str(path), files.T.StructType.fromDDL("n long, t string"))
    assert as_rows(typed) == [(1, "a\nb"), (2, "c")]
    assert as_rows(files.read_by_suffix(spark, str(path), multiline=False)) != as_rows(found)


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id;`odd` name\n")
    assert C.read_csv_records(spark, str(tmp_path / "h.csv"), ";").columns == ["id", "`odd` name"]
    assert C.read_csv_records(spark, str(tmp_path / "h.csv"), ";").count() == 0
    (tmp_path / "e.csv").write_text("")
    assert C.read_csv_records(spark, str(tmp_path / "e.csv"), ";").count() == 0


def test_header_over_many_splits(spark, tmp_path):
    (tmp_path / "w.csv").write_text('"one\n' + "more\n" * 20 + 'name","two",two,\n1,2,3,4\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = C.read_csv_records(spark, str(tmp_path / "w.csv"))
        assert found.columns == ["one\n" + "more\n" * 20 + "name", "two1", "two2", "_c3"]
        assert as_rows(found) == [("1", "2", "3", "4")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_complaint_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text('Nome;Texto\nA;"x\ny"\n', encoding="utf-8")
    (tmp_path / "complaints_processed.csv").write_text("Nome;Texto\nB;z\n")
    found = files.read_complaint_csv(spark, f"{tmp_path}/*.csv")
    assert as_rows(found.select("Nome", "Texto", "source_file")) == [("A", "x\ny", "one.csv")]
