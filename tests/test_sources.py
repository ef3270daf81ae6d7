"""Readers on files laid out as the workflows leave them."""

import json

import pytest

from cellgauge.sources import tables as S


def test_tree_strict_and_loose(spark, tmp_path):
    f = tmp_path / "tree.txt"
    f.write_text("Root\n  Left\n    Leaf\n      Deep\n\n  Right\n    Kid\n        Far1\n        Far2\nTop\n  Twice\n    Twice\n")
    strict = {r.label: r.ancestors for r in S.read_hierarchy(spark, str(f)).collect()}
    assert strict["Leaf"] == ["Root", "Left"] and strict["Deep"] == ["Root", "Left", "Leaf"]
    assert strict["Kid"] == ["Root", "Right"]
    assert strict["Far1"] == strict["Far2"] == ["Root", "Right", "Kid"]
    assert strict["Twice"] == ["Top", "Twice"]
    assert "Root" not in strict and "Left" not in strict
    loose = {r.label: r.ancestors for r in S.read_hierarchy(spark, str(f), strict=False).collect()}
    assert loose["Leaf"] == ["Root", "Left"]
    assert loose["Kid"] == ["", "Right"]
    assert loose["Far1"] == ["", "Right", "Kid"] and loose["Far2"] == ["", "Right", "Kid", "Far1"]


def test_files_named_by_sample(spark, tmp_path):
    for name, text in (("s1.csv", "cell_id,m1\n1,2.5\n"), ("s2.ome.csv", "cell_id,m1\n4,NaN\n")):
        (tmp_path / name).write_text(text)
    got = sorted((r.sample_id, r.cell_id) for r in S.concat_files(spark, str(tmp_path), "cell_id bigint, m1 double").collect())
    assert got == [("s1", 1), ("s2", 4)]
    assert S.read_quant(spark, str(tmp_path), "cell_id bigint, m1 double").where("m1 is null").count() == 1


def test_prediction_layout(spark, tmp_path):
    for m in ("alpha", "beta"):
        d = tmp_path / "tissue" / m / "level3"
        d.mkdir(parents=True)
        (d / "predictions_2.csv").write_text("true_phenotype,predicted_phenotype\na,b\n")
        (d / "other.csv").write_text("x\n1\n")
    rows = S.read_predictions(spark, str(tmp_path), "true_phenotype string, predicted_phenotype string").collect()
    assert sorted((r.dataset, r.method, r.level, r.fold) for r in rows) == [("tissue", "alpha", "level3", "2"), ("tissue", "beta", "level3", "2")]


def test_prediction_paths_are_taken_apart_once_per_file(spark, tmp_path):
    d = tmp_path / "key=tissue a" / "alpha" / "level3"
    d.mkdir(parents=True)
    (d / "other.csv").write_text("x\n1\n")
    schema = "true_phenotype string, predicted_phenotype string"
    none = S.read_predictions(spark, str(tmp_path), schema)
    assert none.columns == ["true_phenotype", "predicted_phenotype", "dataset", "method", "level", "fold"] and none.count() == 0
    (d / "predictions_2.csv").write_text("true_phenotype,predicted_phenotype\na,b\n")
    found = S.read_predictions(spark, str(tmp_path), schema)
    assert [tuple(r) for r in found.collect()] == [("a", "b", "tissue%20a", "alpha", "level3", "2")]
    # a pattern matched against the path of every row took most of the time
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan


def test_prediction_columns_are_found_by_name(spark, tmp_path):
    texts = {"one": "true_phenotype,predicted_phenotype\na,b\n", "two": "confidence,predicted_phenotype,true_phenotype\n0.5,b,a\n"}
    for name, text in texts.items():
        d = tmp_path / name / "tissue" / name / "level3"
        d.mkdir(parents=True)
        (d / "predictions_0.csv").write_text(text)
    roots = [str(tmp_path / n) for n in texts]
    rows = S.read_predictions(spark, roots, "true_phenotype string, predicted_phenotype string, confidence double").collect()
    assert sorted((r.method, r.true_phenotype, r.predicted_phenotype, r.confidence or 0) for r in rows) == [
        ("one", "a", "b", 0), ("two", "a", "b", 0.5)]


def test_header_must_fit_the_schema(spark, tmp_path):
    (tmp_path / "s.csv").write_text("m1,cell_id\n2.5,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_quant(spark, str(tmp_path / "s.csv"), "cell_id bigint, m1 double").collect()


def test_fold_times(spark, tmp_path):
    (tmp_path / "fold_times.txt").write_text(
        "Fold 1 training_time: 12.34\nFold 1 inference_time, 1.5 seconds\nnote\nFold 1 training_time: 10\n"
        "Fold 2 training_time: 3: 4\nFold 3 prediction_time: 2.5s\nFold 4 training_time: soon\n\n")
    got = {(r.fold, r.event): r.seconds for r in S.read_fold_times(spark, str(tmp_path)).collect()}
    assert got == {("1", "training_time"): 10.0, ("1", "inference_time"): 1.5, ("3", "prediction_time"): 2.5, ("4", "training_time"): None}


def test_folds(spark, tmp_path):
    (tmp_path / "cells.json").write_text(json.dumps({"random_state": 42, "folds": [{"fold": 1, "train": [3, 4], "test": [5], "validation": [6]}]}, indent=2))
    got = sorted((r.fold, r.split, r.row) for r in S.read_cell_folds(spark, str(tmp_path / "cells.json"), multiline=True).collect())
    assert got == [(1, "test", 5), (1, "train", 3), (1, "train", 4), (1, "validation", 6)]
    (tmp_path / "images.json").write_text(json.dumps({"fold_0_train_set": ["a", "b"], "fold_0_test_set": ["c"], "seed": ["x"]}, indent=1))
    got = sorted((r.fold, r.split, r.image) for r in S.read_image_folds(spark, str(tmp_path / "images.json")).collect())
    assert got == [(0, "test", "c"), (0, "train", "a"), (0, "train", "b")]


def test_line_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("-1\n4\n5\n")
    (tmp_path / "b.txt").write_text("7\n")
    sizes = spark.createDataFrame([("a", 2), ("b", 3)], "sample_id string, n_cells int")
    got = sorted((r.sample_id, r.cell_id, r.code) for r in S.read_line_labels(spark, str(tmp_path), sizes).collect())
    assert got == [("a", 1, 4), ("a", 2, 5), ("b", 1, 7), ("b", 2, -1), ("b", 3, -1)]


def test_decision_matrix(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("Populations,CD3,CD20\nT,1,-1\nB,,1\n")
    got = sorted((r.cell_type, r.marker, r.weight) for r in S.read_decision_matrix(spark, str(f)).collect())
    assert got == [("B", "CD20", 1.0), ("T", "CD20", -1.0), ("T", "CD3", 1.0)]


def test_partition_pruning(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "'d' AS dataset", "'m' AS method", "'l' AS level", "id % 5 AS fold")
    S.write_predictions(df, str(tmp_path / "p"))
    part = spark.read.parquet(str(tmp_path / "p")).where("fold = 3")
    assert part.count() == 20
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_conflicting_hierarchy(spark):
    df = spark.createDataFrame([("t", "x", "r"), ("t", "x", "r"), ("t", "y", "r")], "cell_type string, level_2_cell_type string, level_1_cell_type string")
    row = S.hierarchy_map(df).first()
    assert row.level_2_cell_type == "x" and row.n_variants == 2


def test_unequal_columns(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    (a / "s1.csv").write_text("cell_id,m1\n1,2.5\n")
    (b / "s2.csv").write_text("cell_id,m2\n1,3.5\n")
    out = S.concat_files(spark, [str(a), str(b)])
    assert set(out.columns) == {"cell_id", "m1", "m2", "sample_id"} and out.where("m1 is null").count() == 1


if __name__ == "__main__":
    pytest.main([__file__])
