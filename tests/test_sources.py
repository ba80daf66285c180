import pytest
from pyspark.sql import functions as F

from retentia.sources import TableSpec, coerce_double, coerce_timestamp, load_tables, retention_tables, stage, write_features
from tests.conftest import SMALL, at


def test_bad_text_becomes_missing(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02"), ("x", "soon"), ("NaN", None), (" 2 ", "2024-01-02 03:04:05")], "n string, t string")
    got = coerce_timestamp(coerce_double(df, ["n", "absent"]), ["t", "absent"]).collect()
    assert [r["n"] for r in got] == [1.5, None, None, 2.0]
    assert [r["t"] for r in got] == [at("2024-01-02"), None, None, at("2024-01-02 03:04:05")]
    assert dict(coerce_timestamp(df, ["t"]).dtypes)["t"] == "timestamp_ntz"


def test_csv_is_typed_without_inference(spark, tmp_path):
    spark.createDataFrame([(7, "2024-01-01", "3.5", "x"), (8, "bad", "bad", "y")], "CustomerID int, at string, amount string, extra string") \
        .write.option("header", True).csv(str(tmp_path / "t"))
    spec = {"t": TableSpec("t", timestamps=("at",), doubles=("amount",), format="csv")}
    t = load_tables(spark, str(tmp_path), spec)["t"]
    assert t.dtypes == [("CustomerID", "string"), ("at", "timestamp_ntz"), ("amount", "double"), ("extra", "string")]
    assert {r["CustomerID"]: r["amount"] for r in t.collect()} == {"7": 3.5, "8": None}


def test_default_tables_and_pass_through_columns(spark, tmp_path):
    frames = {
        "Customer_Demographics": spark.createDataFrame([(1, "F", 30.0), (2, None, float("nan"))], "CustomerID int, Gender string, Age double"),
        "Transaction_History": spark.createDataFrame([(1, 5, "2024-01-01", "9.5", "A")], "CustomerID int, TransactionID int, TransactionDate string, AmountSpent string, ProductCategory string"),
        "Customer_Service": spark.createDataFrame([(1, 5, "2024-01-01", "Inquiry", "Open")], "CustomerID int, InteractionID int, InteractionDate string, InteractionType string, ResolutionStatus string"),
        "Online_Activity": spark.createDataFrame([(1, "2024-01-01", "4", 17)], "CustomerID int, LastLoginDate string, LoginFrequency string, ServiceUsage int"),
        "Churn_Status": spark.createDataFrame([(1, 1), (2, 0)], "CustomerID int, ChurnStatus int"),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / name))
    got = load_tables(spark, str(tmp_path))
    assert set(got) == {"demo", "tx", "svc", "online", "churn"}
    assert all(dict(df.dtypes)["CustomerID"] == "string" for df in got.values())
    assert dict(got["online"].dtypes)["ServiceUsage"] == "string"
    assert got["demo"].filter("Age IS NULL").count() == 1


def test_catalog_tables_load(spark):
    spark.createDataFrame([(1,)], "CustomerID int").createOrReplaceTempView("some_customers")
    got = load_tables(spark, "", {"t": TableSpec("table:some_customers")})["t"]
    assert got.first()["CustomerID"] == "1"


def test_features_are_written_and_overwritten(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "CustomerID string, n int")
    write_features(df, path, partition_by=("n",))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_features(df, path)
    write_features(df.limit(1), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 1


def test_stage_keeps_schema_even_when_empty(spark):
    df = spark.createDataFrame([], "a string, b timestamp_ntz, c array<double>")
    staged = stage(df)
    assert staged.schema == df.schema and staged.count() == 0
    assert "stage-" in staged.inputFiles()[0] if staged.inputFiles() else True


def test_star_tables_have_no_event_after_the_cutoff(spark):
    t = retention_tables(spark, SMALL)
    assert t["tx"].filter("TransactionDate >= TIMESTAMP_NTZ '2001-02-02'").isEmpty()
    assert t["svc"].filter("InteractionDate >= TIMESTAMP_NTZ '2001-02-02'").isEmpty()
    assert t["online"].filter("LastLoginDate >= TIMESTAMP_NTZ '2001-02-02'").isEmpty()
    assert t["demo"].count() == t["churn"].count() == 150
    assert t["demo"].select(F.count_if(F.col("IncomeLevel").isNull())).first()[0] > 0


def test_pushdown_reaches_the_scan(spark):
    plan = retention_tables(spark, SMALL)["tx"].select("CustomerID", "TransactionDate")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


def test_lines_meet_their_orders_in_parts_of_bounded_size(spark, monkeypatch):
    from retentia.sources import star

    lines = spark.createDataFrame([(i % 40, i, 1.0, "R", "F", star.CUTOFF.replace(year=2000)) for i in range(100)],
                                  "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    orders = spark.createDataFrame([(i, i % 7) for i in range(30)], "o_orderkey bigint, o_custkey bigint")
    whole = sorted(map(tuple, star.interactions(lines, orders).collect()))
    assert len(whole) == 80
    monkeypatch.setattr(star, "JOIN_ROWS", 10, raising=False)
    cut = star.interactions(lines, orders)
    assert "hashpartitioning(l_orderkey" in (plan := cut._jdf.queryExecution().executedPlan().toString()) and ", 10), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, cut.collect())) == whole
