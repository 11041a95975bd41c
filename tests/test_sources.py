"""File sinks, row keys and the small scans that no query needs whole."""

import json
import os

import pytest

from strata.functions.columns import equal_width_bin
from strata.sources import files as FS
from strata.sources.grid import to_zero_based


def test_json_array_is_one_document(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(2, 0.12345), (1, 0.5)], "k int, v double")
    FS.write_json_array(df, f"{tmp_path}/a", round_cols=["v"])
    part = next(f for f in os.listdir(f"{tmp_path}/a") if f.startswith("part"))
    assert json.load(open(f"{tmp_path}/a/{part}")) == [{"k": 1, "v": 0.5}, {"k": 2, "v": 0.123}]
    monkeypatch.setattr(FS, "ARRAY_ROWS", 1)
    with pytest.raises(ValueError):
        FS.write_json_array(df, f"{tmp_path}/b")


def test_predictions_without_their_key(spark, tmp_path):
    df = spark.createDataFrame([(i, float(9 - i)) for i in range(9)], "k long, target double")
    FS.write_predictions(df, f"{tmp_path}/p", "k", keep_key=False)
    assert sorted(r[0] for r in FS.read_table(spark, f"{tmp_path}/p", "target double").collect()) == [float(i) for i in range(1, 10)]


def test_row_keys_tell_null_from_text(spark):
    rows = [(None, "a"), ("\\N", "a"), ("", "a"), ("-", "a"), ("a", None), ("1:a", ""), ("a", "a"), ("a", "a")]
    keys = [r["row_key"] for r in FS.with_row_key(spark.createDataFrame(rows, "a string, b string")).collect()]
    assert len(set(keys)) == 7 and keys[-1] == keys[-2]


def test_split_and_zero_based(spark):
    df = spark.createDataFrame([(1, 5, 2.0)], "u int, v int, y double")
    x, y = FS.split_xy(df, "y")
    assert x.columns == ["u", "v"] and y.columns == ["y"]
    assert to_zero_based(df, ["u", "v"]).first()[:] == (0, 4, 2.0)


def test_constant_column_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(equal_width_bin("x", 1.0, 1.0, 5)).collect()] == [0, None]
