import time


def test_the_driver_keeps_few_records_of_past_executions(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    for n in range(60):
        spark.range(3).where(f"id > {n}").collect()
    until = time.time() + 20
    while store.executionsCount() > 30 and time.time() < until:    # records are dropped behind the run
        time.sleep(0.2)
    assert store.executionsCount() <= 30
