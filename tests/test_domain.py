from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from callbook.checks import domain, stored, studies
from callbook.checks.domain import plain_code, series_symbol, ticker_code
from callbook.functions.text import LISTED_SYMBOL
from callbook.operators.ordering import with_ordinal, with_previous


def test_every_supplier_key_gives_its_own_listed_symbol(spark):
    """Large keys too, so that a larger folder tests as much as a small one."""
    n = F.col("id")
    keys = spark.range(1, 2_000).union(spark.range(10_000, 12_000)).union(spark.range(400_000, 402_000))
    codes = keys.select(ticker_code(n).alias("t"), plain_code(n).alias("p"), series_symbol(n).alias("s"))
    assert codes.filter(~F.col("t").rlike(f"^(?:{LISTED_SYMBOL})$")).count() == 0
    assert rows(codes.agg(F.count_distinct("t"), F.count_distinct("p"), F.count_distinct("s"))) == [(5999,) * 3]


def test_rows_without_a_day_come_first(spark):
    df = spark.createDataFrame(
        [("a", None, "x"), ("a", None, "y"), ("a", "2024-01-02", "z"), ("b", "2024-01-01", "w")],
        "k string, d string, p string").withColumn("d", F.col("d").cast("date"))
    got = {r["p"]: r["ordinal"] for r in with_ordinal(df, "k", "d", ["p"]).collect()}
    assert got == {"x": 1, "y": 2, "z": 3, "w": 1}
    before = {r["p"]: r["prev"] and r["prev"]["p"] for r in with_previous(df, "k", "d", "p", ["p"]).collect()}
    assert before == {"x": None, "y": "x", "z": "y", "w": None}


def test_coverage_is_grouped_without_its_paths(spark, tmp_path, monkeypatch):
    """Paths are long, so they are made of the grouped rows; orders may repeat and lack a day."""
    orders = [(1, 5, "1995-02-03", "5-LOW"), (1, 5, "1995-02-03", "5-LOW"), (1, 5, "1995-02-03", "1-URGENT"),
              (2, 6, None, "5-LOW"), (2, 6, None, "1-URGENT"), (None, 7, "1996-01-01", "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string, o_orderpriority string").select(
        "*", F.col("d").cast("timestamp").alias("o_orderdate"), F.lit(1.0).alias("o_totalprice"),
        F.lit("F").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 1, 1), (1, 1, 2), (1, 2, 3), (2, 1, 2), (3, 1, 1), (None, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(domain, "settle", lambda df: df)
    coverage = domain.Domain(spark, str(tmp_path)).coverage
    plan = coverage._jdf.queryExecution().optimizedPlan().toString()
    assert not any("concat" in line for line in plan.split("Aggregate", 1)[1].splitlines())
    found = sorted((r["path"] or "", r["ticker"][-1], r["is_primary"]) for r in coverage.collect())
    assert found == [("", "B", False), ("/investing/1995/02/03/o1/", "B", True), ("/investing/1995/02/03/o1/", "C", False),
                     ("/retirement/1995/02/03/o1/", "B", True), ("/retirement/1995/02/03/o1/", "C", False)]


def test_pages_that_land_are_made_by_all_tasks(spark, tmp_path):
    """Two files, however many tasks made their rows."""
    pages = spark.range(0, 800, 1, 8).select("id", F.spark_partition_id().alias("task"))
    stored.land(pages, f"{tmp_path}/landing")
    landed = spark.read.json(f"{tmp_path}/landing")
    assert landed.count() == 800 and landed.select("task").distinct().count() == 8
    assert len(list((tmp_path / "landing").glob("part-*"))) == 2


def test_symbols_make_each_letter_once(spark):
    """A longer expression makes a method that the JVM does not compile."""
    n = F.col("id")
    for code in (plain_code, ticker_code, series_symbol):
        plan = spark.range(1).select(code(n).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("chr(") + plan.lower().count("char(") == 4
    got = spark.createDataFrame([(0,), (7,), (13,), (91,), (456_976,), (None,)], "id long").select(
        plain_code(n), ticker_code(n), series_symbol(n))
    assert [tuple(r) for r in got.collect()] == [
        ("SAAAA", "SAAA.A", "SAAA-A.TO"), ("SAAAH", "SAAA.H", "SAAA-H"), ("SAAAN", "SAAAN", "SAAAN.TO"),
        ("SAADN", "SAAD.N", "SAAD-N.TO"), ("SAAAA", "SAAAA", "SAAAA.TO"), (None, None, None)]


def test_tasks_get_a_bounded_number_of_articles(spark, monkeypatch):
    monkeypatch.setattr(domain, "TASK_ROWS", 100)
    dealt = domain.Domain(spark, "")._spread(spark.range(0, 2_050, 1, 1).toDF("id"))
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 2_050 and max(sizes) <= 150


def test_incremental_scoring_runs_each_part_once(spark):
    """Both parts are read several times, so they are settled."""
    found = studies.outcomes_incremental(domain.Domain(spark, "/root/testdata/sf0.001"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_chart_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Their number decides, not their size."""
    monkeypatch.setattr(stored, "TASK_FILES", 2)
    days = spark.range(0, 80, 1, 1).select(
        F.concat(F.lit("S"), (F.col("id") % 40).cast("string")).alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.lit(1.5).alias("close"), F.lit(3).cast("bigint").alias("volume"))
    stored.write_charts(domain.Domain(spark, ""), days, f"{tmp_path}/charts")
    files = list((tmp_path / "charts").glob("symbol=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 8
    found = spark.read.text(f"{tmp_path}/charts")
    assert found.count() == 40 and found.filter("value NOT LIKE '%\"timestamp\":[%,%]%'").count() == 0
