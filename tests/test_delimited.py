"""Delimited files with line breaks in quotes, cut into blocks anywhere."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sparkveil.sources import readers as S
from sparkveil.sources.delimited import delimiter_of, read_records


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "97b")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def made(rng, rows, sep, end):
    cell = lambda: rng.choice(["", "a", "x y", 'say "hi"', f"b{sep}c", "línea\nde\r\nmás", "\n" * 40, "z" * 150, " s ", '"'])
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(["Nombre", "", "Nombre", "n"])
    table = [[cell(), cell(), cell(), str(k)] for k in range(rows)]
    for k, r in enumerate(table):
        w.writerow(r)
        if k % 7 == 0:
            out.write(rng.choice([end, f"{sep}{sep}{end}", f'"" {sep}{end}']))
    return out.getvalue(), table


@pytest.mark.parametrize(("sep", "end"), [(",", "\n"), (";", "\r\n"), ("\t", "\n"), ("|", "\r\n")])
def test_records_come_back_whatever_the_blocks(spark, tmp_path, small_blocks, sep, end):
    rng = random.Random(sep)
    text, table = made(rng, 60, sep, end)
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    records = read_records(spark, str(path), sep)
    assert records.select("block").distinct().count() > 10 and spark.read.text(str(path)).rdd.getNumPartitions() > 20
    df = S.read_csv(spark, str(path))
    assert df.columns == ["_row", "Nombre", "Columna 2", "Nombre (2)", "n"]
    got = [list(r) for r in df.orderBy("_row").collect()]
    assert [r[0] for r in got] == list(range(60))
    assert [[c or "" for c in r[1:]] for r in got] == table


def test_several_files_and_encodings(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes("﻿año,b\nuno,\"1\n2\"\n".encode())
    (tmp_path / "b.csv").write_bytes("año,b\nseñor,\"sin fin\nde comillas".encode("cp1252"))
    got = [tuple(r) for r in S.read_csv(spark, str(tmp_path), ",").orderBy("_row").collect()]
    assert S.read_csv(spark, str(tmp_path), ",").columns == ["_row", "año", "b"]
    assert got[:1] == [(0, "uno", "1\n2")] and got[1][:2] == (1, "señor") and len(got) == 2


def test_delimiters_within_quotes_do_not_count():
    assert delimiter_of(['"a,b,c,d";1', '"e,f,g,h";2', '"i', 'j,,,";3']) == ";"
    assert delimiter_of(["a|b,c", "d|e,f", "g|h"]) == "|" and delimiter_of([]) == "," and delimiter_of(["x"]) == ","


def test_written_and_read_again(spark, tmp_path):
    from sparkveil.sources.writers import write_csv

    df = spark.range(2000).select(F.col("id").alias("_row"), F.concat(F.lit("v\n"), "id", F.lit(' "q"; ')).alias("texto"), F.when(F.col("id") % 3 > 0, "x").alias("y"))
    write_csv(df, str(tmp_path / "o"), ";")
    back = S.read_csv(spark, str(tmp_path / "o"), ";")
    assert back.count() == 2000 and back.drop("_row").exceptAll(df.drop("_row")).count() == 0


def test_no_records(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="no rows"):
        S.read_csv(spark, str(tmp_path / "e.csv"))
