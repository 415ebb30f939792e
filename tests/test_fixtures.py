"""Golden values derived by hand (FIXTURES.md F1-F6)."""

import math

import pytest
from pyspark.sql import functions as F

from tabsynth.functions.names import clean_name, ingest_name, make_unique
from tabsynth.operators import clean as C
from tabsynth.operators import evaluate as E
from tabsynth.operators.features import reduce_features, reinject_columns


def test_f1_evaluation_report(spark):
    real = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "A bigint, B bigint")
    synth = spark.createDataFrame([(1, 4), (2, 4), (2, 5)], "A bigint, B bigint")
    rep = {(r["section"], r["metric"], r["column"]): r for r in E.build_evaluation_report(real, synth).collect()}
    assert rep[("summary", "real_rows", None)]["value"] == 3
    assert rep[("summary", "generated_rows", None)]["value"] == 3
    assert rep[("summary", "correlation_similarity_score", None)]["value"] == pytest.approx(0.75)
    assert rep[("summary", "avg_ks_similarity", None)]["value"] == pytest.approx(2 / 3)
    a = rep[("column_statistics", None, "A")]
    assert (a["real_mean"], a["synth_mean"]) == pytest.approx((2.0, 5 / 3))
    assert (a["real_std"], a["synth_std"]) == pytest.approx((1.0, 0.577350), abs=1e-6)
    assert (a["mean_abs_diff"], a["std_abs_diff"]) == pytest.approx((1 / 3, 0.422650), abs=1e-6)
    b = rep[("column_statistics", None, "B")]
    assert (b["real_mean"], b["synth_mean"], b["mean_abs_diff"]) == pytest.approx((5.0, 13 / 3, 2 / 3))
    for col in ("A", "B"):
        k = rep[("ks_test", None, col)]
        assert k["ks_statistic"] == pytest.approx(1 / 3)
        assert k["similarity_score"] == pytest.approx(2 / 3)
        assert 0.0 <= k["p_value"] <= 1.0


def test_f3_names():
    assert ingest_name("  Unit   Price ") == "Unit Price"
    assert clean_name("  Unit   Price ") == "Unit_Price"
    assert ingest_name("a-b (%)") == "a-b (%)"
    assert clean_name("a-b (%)") == "a_b"
    assert ingest_name("") == "column" and clean_name("") == "column"
    assert make_unique(["x", "x", "x"]) == ["x", "x_1", "x_2"]
    # a suffixed name that is taken gets suffixed again; comparison ignores case
    assert make_unique(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert make_unique(["A", "a"]) == ["A", "a_1"]


def f4(spark):
    rows = [
        (1, "1,000", "2024-01-05", " a ", 1.0, None, True),
        (2, "2,500.5", "2024-01-06", "null", float("inf"), None, False),
        (3, "3", "2024-01-06", "b", None, None, True),
        (4, "4", None, "b", 4.0, None, True),
    ]
    return spark.createDataFrame(
        rows, "id bigint, amount string, `when` string, note string, gap double, empty string, flag boolean")


def test_f4_cleaning_ladder(spark):
    out, rep = C.clean_dataset(f4(spark))
    assert out.columns == ["id", "amount", "when", "note", "gap", "flag"]
    got = sorted(out.collect(), key=lambda r: r["id"])
    assert [r["amount"] for r in got] == [1000.0, 2500.5, 3.0, 4.0]
    assert [str(r["when"])[:10] for r in got] == ["2024-01-05", "2024-01-06", "2024-01-06", "2024-01-06"]
    assert [r["note"] for r in got] == ["a", "b", "b", "b"]
    assert [r["gap"] for r in got] == [1.0, 2.5, 2.5, 4.0]
    assert [r["flag"] for r in got] == [True, False, True, True]
    assert (rep.rows_before, rep.rows_after, rep.cols_before, rep.cols_after, rep.dropped_rows) == (4, 4, 7, 6, 0)
    assert rep.dropped_columns == ["empty"]
    assert rep.converted_columns == ["amount:numeric", "when:datetime"]
    assert rep.imputed_columns == ["when:mode_datetime", "note:mode", "gap:median"]


def test_cleaning_is_idempotent(spark):
    once, _ = C.clean_dataset(f4(spark))
    twice, rep2 = C.clean_dataset(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert rep2.imputed_columns == [] and rep2.converted_columns == []


def test_f6_feature_reduction(spark):
    rows = [(f"u{i % 5}", f"code{i}", 7, f"s{i % 4}", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "user_id string, code string, const int, segment string, value double")
    red, dropped = reduce_features(df)
    assert red.columns == ["segment", "value"]
    assert dropped == ["user_id", "code", "const"]
    back = reinject_columns(red, df, dropped)
    assert back.columns == df.columns
    r = back.first()
    assert r["user_id"] == "NA" and r["code"] == "NA" and r["const"] is None
    # protected columns stay
    assert "user_id" in reduce_features(df, ["user_id"])[0].columns


def test_f2_csv_with_junk_rows(spark, tmp_path):
    from tabsynth.sources.load import load_dataset

    p = tmp_path / "export.csv"
    p.write_text("Quarterly export;;;\n;;;\nID;Date;Value;\n1;2024-01-05;1,200;\n2;2024-01-06;n/a;\n")
    df, diag = load_dataset(spark, str(p))
    assert diag.detected_delimiter == ";"
    assert diag.detected_header_row == 2
    assert df.columns == ["ID", "Date", "Value"]
    assert sorted(r["ID"] for r in df.collect()) == [1, 2]
    # overrides
    df2, diag2 = load_dataset(spark, str(p), sep_override=";", header_override=2)
    assert df2.columns == ["ID", "Date", "Value"] and diag2.detected_header_row == 2


def test_f2_error_cases(spark, tmp_path):
    from tabsynth.sources.load import load_dataset

    one = tmp_path / "one.csv"
    one.write_text("a\n1\n2\n")
    with pytest.raises(ValueError):
        load_dataset(spark, str(one))
    empty = tmp_path / "empty.csv"
    empty.write_text("\n")
    with pytest.raises(Exception):
        load_dataset(spark, str(empty))


def f5(spark):
    rows = [(float(i), float(i % 7), ["red", "blue", "green"][i % 3], "n") for i in range(20)]
    rows += [(100.0 + i, 50.0 + i, ["red", "blue"][i % 2], "p") for i in range(5)]
    return spark.createDataFrame(rows, "x double, y double, colour string, cls string")


def test_f5_model_choice_and_smote(spark):
    from tabsynth.operators.generate.smote import smote_balance
    from tabsynth.operators.recommend import recommend_model

    df = f5(spark)
    rec = recommend_model(df, target="cls")
    assert rec.model == "SMOTE" and rec.imbalance_ratio == pytest.approx(0.25)
    bal, _, _ = smote_balance(df, "cls")
    counts = {r["_y"]: r["count"] for r in bal.groupBy("_y").count().collect()}
    assert counts == {"n": 20, "p": 20}
    # generated minority rows stay inside the minority's bounding box (interpolation)
    syn = bal.where("_generated").agg(F.min("_n0"), F.max("_n0")).first()
    assert 100.0 <= syn[0] and syn[1] <= 104.0


def test_f5_smote_errors(spark):
    from tabsynth.operators.generate.smote import generate_smote

    df = f5(spark)
    with pytest.raises(ValueError):
        generate_smote(df.where("cls = 'n'"), "cls", 10)
    with pytest.raises(ValueError):
        generate_smote(df.where("cls = 'n' OR x = 100.0"), "cls", 10)
    with pytest.raises(ValueError):
        generate_smote(df.select("cls"), "cls", 10)
    with pytest.raises(ValueError):
        generate_smote(df, "nope", 10)


def test_sample_size_defaults():
    from tabsynth.operators.sample import pipeline_sample_size, ui_sample_size

    assert ui_sample_size(5) == 15 and ui_sample_size(2000) == 2000 and ui_sample_size(200) == 600
    assert pipeline_sample_size(5) == 100 and pipeline_sample_size(5000) == 1000 and pipeline_sample_size(300) == 300


def test_model_alias_and_chain():
    from tabsynth.operators.generate.fallback import fallback_chain
    from tabsynth.operators.recommend import canonical_model

    assert canonical_model("TimeGAN / Sequential") == "Sequential"
    assert fallback_chain("SMOTE") == ["SMOTE", "CTGAN", "GaussianCopula", "BOOTSTRAP"]
    assert fallback_chain("SMOTE", "main") == ["SMOTE", "CTGAN", "GaussianCopula"]
    assert fallback_chain("whatever") == ["GaussianCopula", "BOOTSTRAP"]
    assert math.isfinite(1.0)


def test_common_columns_and_variant_header(spark):
    from tabsynth.functions.names import common_columns
    from tabsynth.sources.csv import detect_header_row_from_lines

    assert common_columns(["a", "b", "c"], ["c", "a"]) == ["a", "c"]
    lines = ["report;;", "S-No;Item;Qty", "1;x;2"]
    assert detect_header_row_from_lines(spark, lines, ";", variant=True) == 1
    assert detect_header_row_from_lines(spark, lines, ";", variant=False) == 1
    assert detect_header_row_from_lines(spark, [], ";", variant=True) == 0
    assert detect_header_row_from_lines(spark, [], ";", variant=False) is None


def test_names_with_dots_and_commas(spark):
    from tabsynth.operators.features import reduce_features
    from tabsynth.operators.profile import build_profile
    df = spark.createDataFrame([(1, 2.0, float("nan"), "x"), (2, None, 5.0, "y")], "`S.No` int, `a,b` double, one double, t string")
    p = build_profile(df)
    assert p.numerical_columns == ["S.No", "a,b", "one"] and p.missing_cells == 2
    assert reduce_features(df)[1] == ["a,b", "one"]


def test_csv_keeps_cells_beyond_the_header(spark, tmp_path):
    from tabsynth.sources.csv import read_csv
    path = tmp_path / "wide.csv"
    path.write_text('id,"name, full",v\n' + "".join(f"{i},n{i},{i}\n" for i in range(30)) + "99,x,5,EXTRA\n" + '7,"a,b",1\n')
    df, diag = read_csv(spark, f"file:{path}")
    assert df.columns == ["id", "name, full", "v", "extra_3"]
    assert [r["extra_3"] for r in df.where("id = '99'").collect()] == ["EXTRA"] and df.where("id = '7' and v = '1'").count() == 1
    assert any("1 lines" in n for n in diag.notes)


def test_draws_reach_rows_beyond_32_bits(spark):
    from pyspark.sql import functions as F
    from tabsynth.functions.columns import uniform
    n = 10**11
    got = spark.range(2000).select(F.floor(uniform(42, "boot", F.col("id")) * n).alias("i")).agg(F.max("i"), F.countDistinct(F.col("i") % 16)).first()
    assert got[0] > 2**32 and got[1] == 16


def test_fallback_reports_attempts(spark):
    import pytest
    from tabsynth.operators.generate.fallback import generate_with_fallback
    df = spark.range(60).selectExpr("id % 7 as a", "id * 1.5 as b")
    made = generate_with_fallback(df, "BOOTSTRAP", 25)
    assert made.rows.count() == 25 and [(a.model, a.ok) for a in made.attempts] == [("BOOTSTRAP", True)]
    made = generate_with_fallback(df, "SMOTE", 10)
    assert [(a.model, a.ok) for a in made.attempts][:2] == [("SMOTE", False), ("CTGAN", False)] and made.rows.count() == 10
    with pytest.raises(ValueError):
        generate_with_fallback(df.limit(0), "BOOTSTRAP", 5)
