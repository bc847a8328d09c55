"""What a task sorts does not grow with the rows."""

from datetime import date

from tapewright.operators import book, patterns, validate


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(patterns, "ROWS_A_TASK", 10)
    assert patterns.tasks_for(spark, 1) == spark.sparkContext.defaultParallelism
    assert patterns.tasks_for(spark, 201) == 21
    rows = [(date(2024, 1, 2), "A", "8", k % 40, k, k, 1) for k in range(400)]
    changes = spark.createDataFrame(rows, "trading_date date, symbol string, side string, price_raw long, ts_nanos long, seq long, delta long")
    tasks = patterns.tasks_for(spark, 400)
    sizes = book.level_sizes(changes, tasks)
    assert sizes.rdd.getNumPartitions() == tasks
    checked = validate.level_check(changes, sizes.withColumnRenamed("level_size", "declared").drop("delta").selectExpr("*", "0L seq"), tasks)
    assert checked.rdd.getNumPartitions() == tasks
    assert checked.count() == 400 and checked.filter("not matches").count() == 0
