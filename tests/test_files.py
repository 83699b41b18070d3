import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import comparison, evaluation, significance
from quern.sources import evaluation_files as files
from quern.sources import metric_source


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two method folders in the layout of the evaluation tool."""
    top = tmp_path_factory.mktemp("runs")
    for method, shift in (("base", 0), ("knn", 1)):
        (top / method).mkdir()
        for name, mark, _ in files.METRIC_FILES:
            lines = [f"{name:<22}\t{q}\t{(q + shift) % 7 / 10:.4f}" for q in (603, 601, 604)]
            text = "\n".join([*lines, f"{name:<22}\tall\t0.1234"]) + "\n"
            (top / method / f"Eval_{mark}_first_ret50_top_n10_lambda0_9.txt").write_text(text)
    return str(top)


def test_summary_row_goes_and_ids_become_integers(spark, root, rows):
    path = files.find_file(spark, f"{root}/base", "map_map")
    df = files.load_metric_file(spark, path, "map")
    assert df.dtypes == [("id_Q", "bigint"), ("map", "double")]
    assert rows(df) == [(601, 0.6), (603, 0.1), (604, 0.2)]


def test_bad_id_fails(spark, tmp_path):
    (tmp_path / "x.txt").write_text("map\tseven\t0.1\n")
    with pytest.raises(PySparkException):
        files.load_metric_file(spark, str(tmp_path), "map").collect()


def test_pattern_must_match_one_file(spark, root):
    with pytest.raises(FileNotFoundError):
        files.find_file(spark, f"{root}/base", "recall")
    with pytest.raises(ValueError):
        files.find_file(spark, f"{root}/base", "Eval")


def test_all_folders_load_in_one_scan(spark, root, rows):
    table = comparison.combine_metrics(files.load_metrics(spark, root))
    assert table.count() == 6
    assert rows(table.where("id_Q = 603")) == [(603, 0.1, 0.1, 0.1, "base"), (603, 0.2, 0.2, 0.2, "knn")]


def test_configuration_comes_from_the_file_name(spark):
    names = [
        ("a_first_ret50_n_neighbours5_min_doc_c5_top_n10_lambda0_9.txt",),
        ("w_vector_size75_window5_min_count5_negative15_epochs10_sample0_ret25_top_n100_lambda0_9.txt",),
        ("plain_map_map.txt",),
    ]
    df = spark.createDataFrame(names, "file string").select(files.run_configuration(F.col("file")).alias("c"))
    knn, w2v, plain = (r.c.asDict() for r in df.collect())
    assert {k: v for k, v in knn.items() if v is not None} == {
        "first_ret": 50, "n_neighbours": 5, "min_doc_c": 5, "top_n": 10, "lambda": 0.9,
    }
    assert (w2v["first_ret"], w2v["sample"], w2v["vector_size"], w2v["top_n"]) == (25, 0.0, 75, 100)
    assert set(plain.values()) == {None}


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_method_tables_are_written_and_read(spark, root, tmp_path, rows, form):
    table = comparison.combine_metrics(files.load_metrics(spark, root))
    folder = str(tmp_path / "tables")
    files.write_method_tables(table, folder, form)
    again = files.read_method_tables(spark, folder) if form == "csv" else spark.read.parquet(folder)
    assert rows(again.select(*table.columns)) == rows(table)


def test_metric_files_round_trip_with_their_all_row(spark, tmp_path, rows):
    metrics = spark.createDataFrame(
        [("map", 1, 0.25), ("map", 2, 0.75)], "metric string, query_id int, value double"
    )
    folder = str(tmp_path / "base")
    files.write_metric_files(evaluation.with_all_row(metrics), folder)
    raw = files.metric_rows(spark, folder)
    assert rows(raw.select("metric", "id_q", "value")) == [("map", "1", 0.25), ("map", "2", 0.75), ("map", "all", 0.5)]
    assert spark.read.text(folder).first().value.startswith("map" + " " * 19 + "\t")
    assert rows(files.load_metric_file(spark, folder, "map")) == [(1, 0.25), (2, 0.75)]


def test_run_is_blank_separated(spark, tmp_path):
    run = spark.createDataFrame(
        [(1, "Q0", 9, 1, 2.5, "t")], "query_id long, iteration string, doc_id long, rank int, score double, tag string"
    )
    folder = str(tmp_path / "run")
    files.write_run(run, folder)
    assert spark.read.text(folder).first().value == "1 Q0 9 1 2.5 t"


# Method, metric: t, p(t), Wilcoxon p on raw and on rounded differences, ids of gain and loss.
PUBLISHED = {
    ("knn", "map"): (2.266821, 0.025599, 0.000546, 0.000539, 652, 634),
    ("knn", "p_5"): (2.836488, 0.005543, 0.010445, 0.007403, 622, 634),
    ("knn", "ndcg_10"): (2.764910, 0.006804, 0.007722, 0.007784, 652, 634),
    ("w2v", "map"): (-2.796439, 0.006219, 0.003990, 0.003964, 601, 698),
    ("w2v", "p_5"): (-1.931245, 0.056342, 0.102295, 0.060123, 654, 613),
    ("w2v", "ndcg_10"): (-0.843488, 0.401010, 0.101144, 0.100740, 654, 667),
    ("exp", "map"): (-0.090580, 0.928011, 0.491060, 0.492370, 607, 664),
    ("exp", "p_5"): (-0.583416, 0.560954, 0.768067, 0.823916, 654, 700),
    ("exp", "ndcg_10"): (-1.214150, 0.227608, 0.261410, 0.261409, 654, 667),
}
FOLDER = os.environ.get("PUBLISHED_EVALUATIONS")


@pytest.mark.skipif(not FOLDER, reason="PUBLISHED_EVALUATIONS does not name a folder")
def test_published_evaluations(spark, rows):
    long = files.load_metrics(spark, FOLDER).cache()
    table = comparison.combine_metrics(long)
    assert rows(table) == rows(files.read_method_tables(spark, FOLDER))
    pairs = comparison.paired(long).cache()
    key = ["method", "metric"]
    extremes = comparison.difference_extremes(comparison.method_difference(pairs))
    found = (
        significance.paired_t_test(pairs).select(*key, "t", F.col("p").alias("p_t"))
        .join(significance.wilcoxon(pairs, None).select(*key, F.col("p").alias("raw")), key)
        .join(significance.wilcoxon(pairs).select(*key, F.col("p").alias("rounded")), key)
        .join(extremes, key)
    )
    got = {
        (r.method, r.metric): (r.t, r.p_t, r.raw, r.rounded, r.max_id, r.min_id) for r in found.collect()
    }
    assert got.keys() == PUBLISHED.keys()
    for name, expected in PUBLISHED.items():
        assert got[name] == pytest.approx(expected, abs=1e-6)


LONG = "method string, metric string, id_q string, value double, file string"


def test_named_files_come_back_with_their_configuration(spark, tmp_path, rows):
    made = [(m, metric, q, 0.25, f"Eval_{mark}_first_ret50_lambda0_9.txt") for m in ("base", "knn")
            for _, mark, metric in files.METRIC_FILES for q in ("602", "601", "all", "1000")]
    metric_source.write_named_files(spark.createDataFrame(made, LONG).repartition(4), str(tmp_path))
    lines = (tmp_path / "knn" / "Eval_P5_P5_first_ret50_lambda0_9.txt").read_text().splitlines()
    assert lines[0] == f"{'P_5':<22}\t601\t0.2500" and [x.split("\t")[1] for x in lines] == ["601", "602", "1000", "all"]
    assert sorted(p.name for p in (tmp_path / "base").iterdir()) == sorted({f for *_, f in made})
    back = metric_source.read_metric_files(spark, str(tmp_path))
    assert rows(back.select("method", "metric", "id_q", "value", "file")) == sorted(made)
    assert rows(back.select("configuration.first_ret", "configuration.lambda").distinct()) == [(50, 0.9)]
    plain = files.load_metrics(spark, str(tmp_path))
    assert rows(plain) == rows(metric_source.metrics_of_files(spark, str(tmp_path)))
    one = metric_source.read_metric_files(spark, f"{tmp_path}/base", "map_map", single=True)
    assert one.rdd.getNumPartitions() == 1 and one.count() == 4


def test_files_that_do_not_match_once_are_refused(spark, root):
    with pytest.raises(PySparkException, match="no file matching"):
        metric_source.read_metric_files(spark, f"{root}/base", "recall", single=True).count()
    with pytest.raises(PySparkException, match="3 files match"):
        metric_source.read_metric_files(spark, f"{root}/base", "Eval", single=True).count()


def test_two_configurations_of_one_metric_are_refused(spark, tmp_path):
    made = [("base", "map", "1", 0.1, f"Eval_map_map_top_n{n}.txt") for n in (10, 20)]
    metric_source.write_named_files(spark.createDataFrame(made, LONG), str(tmp_path))
    with pytest.raises(PySparkException, match="several files of map for base"):
        metric_source.metrics_of_files(spark, str(tmp_path)).collect()


def test_a_file_from_two_tasks_is_refused_and_leaves_nothing(spark, tmp_path):
    metric_source.register(spark)
    rows = spark.createDataFrame([("base", "map", str(k), 0.1, "Eval_map_map.txt") for k in range(8)], LONG).repartition(4)
    with pytest.raises(PySparkException):
        rows.write.format(metric_source.FORMAT).mode("append").save(str(tmp_path))
    assert not list(tmp_path.rglob("*.txt"))


def test_file_names(spark):
    df = spark.createDataFrame([("knn", "p_5", 50, 0.9)], "method string, metric string, first_ret int, lam double")
    name = metric_source.file_name(F.col("method"), F.col("metric"), first_ret=F.col("first_ret"), **{"lambda": F.col("lam")})
    assert df.select(name).first()[0] == "Eval_Q_QE_knn_P5_P5_first_ret50_lambda0_9.txt"
