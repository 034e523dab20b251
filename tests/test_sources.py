import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.sources import sinks, tables


def test_csv_declared_and_inferred(spark, tmp_dir):
    rides = spark.createDataFrame([("tram", dt.date(2020, 5, 1), 12.5), ("ferry", dt.date(2020, 5, 9), 3.0)], "line string, day date, km double")
    rides.coalesce(1).write.option("header", "true").option("sep", "|").csv(f"{tmp_dir}/rides")
    declared = tables.read_csv(spark, f"{tmp_dir}/rides", schema="a string, b date, c double", sep="|", names=["mode", "on", "length"])
    assert [f"{n}:{t}" for n, t in declared.dtypes] == ["mode:string", "on:date", "length:double"]
    assert sorted(map(tuple, declared.collect())) == sorted(map(tuple, rides.collect()))
    assert dict(tables.read_csv(spark, f"{tmp_dir}/rides", sep="|").dtypes) == {"line": "string", "day": "date", "km": "double"}


def test_table_and_path_writers(spark, tmp_dir):
    plain = spark.range(30).select("id", (F.col("id") % 3).alias("bucket"))
    sinks.write_path(plain, f"{tmp_dir}/plain")
    assert tables.read_format(spark, f"{tmp_dir}/plain").agg(F.sum("id")).first()[0] == 435
    sinks.write_table(plain, "writer_test_managed")
    assert tables.read_table(spark, "writer_test_managed").where("bucket = 2").count() == 10
    dated = plain.select("id", F.date_add(F.lit(dt.date(2021, 2, 27)), F.col("bucket").cast("int")).alias("day"))
    sinks.write_table(sinks.with_date_partitions(dated, "day"), "writer_test_external", path=f"{tmp_dir}/ext", partition_by=list(sinks.PARTITION_COLUMNS))
    assert sinks.newest_partition(spark, f"{tmp_dir}/ext") == ("2021", "03", "01")
    sinks.drop_days(spark, f"{tmp_dir}/ext", [dt.date(2021, 3, 1), dt.date(2030, 1, 1)])
    assert sinks.newest_partition(spark, f"{tmp_dir}/ext") == ("2021", "02", "28")
    assert sinks.newest_partition(spark, f"{tmp_dir}/none") is None


def test_reader_sees_a_rewritten_file(spark, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}/t.parquet")
    reader = tables.ParquetTables(spark, tmp_dir)
    assert reader("t").columns == ["id"]
    spark.range(5).withColumn("more", F.lit("x")).write.mode("overwrite").parquet(f"{tmp_dir}/t.parquet")
    assert reader("t").columns == ["id", "more"] and reader("t").count() == 5
    reader.register_views(("t", "missing"))
    assert spark.sql("select count(more) from t").first()[0] == 5


def test_scratch_folders_differ_and_need_a_shared_folder(spark):
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two and one.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Cluster)


def test_two_results_of_the_overwrite_query_live_side_by_side(spark):
    import __spark_entry__ as entry
    query = entry.queries()["partition_overwrite"]
    first = query(spark, "/root/testdata/sf0.001")
    second = query(spark, "/root/testdata/sf0.001")
    assert first.count() == second.count() > 0


def test_csv_rejects_keep_every_line(spark, tmp_dir):
    lines = ["key;day;v", "1;2024-01-01;2.5", "x;2024-01-02;1.0", "2;2024-02-30;1.0", "3;;", "4;2024-01-03", "5;2024-01-03;1.0;9", ";;", "6;2024-01-04;bad", "7;\"a;b\";1"]
    spark.createDataFrame([(line,) for line in lines], "l string").coalesce(1).write.text(f"{tmp_dir}/c")
    good, rejected = tables.read_csv_with_rejects(spark, f"{tmp_dir}/c", "key long, day date, v double", sep=";")
    assert sorted((r.key or 0) for r in good.collect()) == [0, 1, 3] and good.columns == ["key", "day", "v"]
    bad = {"x;2024-01-02;1.0", "2;2024-02-30;1.0", "4;2024-01-03", "5;2024-01-03;1.0;9", "6;2024-01-04;bad", "7;\"a;b\";1"}
    assert {r[0] for r in rejected.collect()} == bad
    # a query of one column judges lines as a query of all does
    assert good.select("v").count() == 3 and good.select("key").where("key is not null").count() == 2 and rejected.count() == 6 and good.count() == 3
    with pytest.raises(ValueError):
        tables.read_csv_with_rejects(spark, f"{tmp_dir}/c", "rejected_line string")
