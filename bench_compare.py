"""

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line per comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window, functions as F  # noqa: E402

from ledgerlens.operators import activity, cashback, cohort  # noqa: E402
from ledgerlens.plans import fixtures as fx, queries_cashback as qc, queries_subscription as qs  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402
from ledgerlens.sources.tables import ParquetTables  # noqa: E402


def timed(build, repeats=3):
    build().write.format("noop").mode("overwrite").save()
    out = []
    for _ in range(repeats):
        t0 = time.perf_counter()
        df = build()
        df.write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - t0)
    return round(statistics.median(out), 3), df.count()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    t = ParquetTables(spark, sf_dir)

    def orders_activity():
        return t("orders").select(F.col("o_custkey").alias("consumer_id"),
                                  F.to_date("o_orderdate").alias("created_date"), "o_orderpriority")

    def rolling(method, k):
        return lambda: activity.rolling_active_users(orders_activity(), group_cols=["o_orderpriority"], window_days=k,
                                                     start=fx.ORDERS_START, as_of=fx.ORDERS_AS_OF, method=method)

    for k in (7, 35):
        res = {m: timed(rolling(m, k)) for m in ("coverage", "expand")}
        print(json.dumps({"compare": f"rolling_active_users k={k}", **{m: {"sec": s, "rows": n}
                                                                      for m, (s, n) in res.items()}}), flush=True)

    def cashback_per_product():
        src = qc._sources(spark, sf_dir)
        camp = cashback.flagged_campaigns(src["taxonomy"], qc.PARAMS.flag_pattern)
        promo = cashback.promo_cashback(src["promo"], camp, qc.PARAMS)
        ev = cashback.status_events(src["events"], camp, src["core"], qc.PARAMS, list(fx.PROMO_ORDER))
        parts = []
        for spec in cashback.PRODUCTS:
            pay = cashback.normalised_payments(src["payment_tables"][spec.name], spec, qc.PARAMS)
            parts += [cashback.cashback_before(pay, promo, qc.PARAMS), cashback.cashback_after(pay, ev, qc.PARAMS)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def cashback_one_join_per_era():
        src = qc._sources(spark, sf_dir)
        camp = cashback.flagged_campaigns(src["taxonomy"], qc.PARAMS.flag_pattern)
        pays = cashback.all_payments(src["payment_tables"], qc.PARAMS)
        ev = cashback.status_events(src["events"], camp, src["core"], qc.PARAMS, list(fx.PROMO_ORDER))
        return cashback.cashback_before(pays, cashback.promo_cashback(src["promo"], camp, qc.PARAMS),
                                        qc.PARAMS).unionByName(cashback.cashback_after(pays, ev, qc.PARAMS))

    res = {"one_join_per_era": timed(cashback_one_join_per_era), "join_per_product": timed(cashback_per_product)}
    print(json.dumps({"compare": "cashback product branches", **{m: {"sec": s, "rows": n}
                                                                 for m, (s, n) in res.items()}}), flush=True)

    def attribution(kind):
        def build():
            base = qs._cohort_base(t)
            act, churn = cohort.activation_cohort(base), cohort.month_end_churn(base, as_of=qs.AS_OF)
            if kind == "one_pass":
                return cohort.cohort_attribution(base, as_of=qs.AS_OF)
            if kind == "min":
                return cohort.churn_attribution(act, churn)
            c = churn.select(F.col("consumer_id").alias("_c"), "canceled_month")
            j = act.join(c, (F.col("consumer_id") == F.col("_c")) &
                         (F.col("effective_month") <= F.col("canceled_month")), "left")
            w = Window.partitionBy("consumer_id", "effective_month").orderBy(F.col("canceled_month").asc_nulls_first())
            return (j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
                     .select("consumer_id", "effective_month", "canceled_month",
                             F.months_between("canceled_month", "effective_month").alias("delta_meses_churn")))
        return build

    res = {"one_pass_range_window": timed(attribution("one_pass")), "aggregated_min": timed(attribution("min")),
           "row_number": timed(attribution("rn"))}
    print(json.dumps({"compare": "churn attribution", **{m: {"sec": s, "rows": n} for m, (s, n) in res.items()}}),
          flush=True)

    def retention(month_end_only):
        return lambda: cohort.retention_matrix(qs._story(t, month_end_only=month_end_only), fx.BASIC_TITLE, as_of=qs.AS_OF,
                                               pool_before=fx.POOL_BEFORE)

    res = {"month_end_spine": timed(retention(True)), "daily_spine": timed(retention(False))}
    print(json.dumps({"compare": "retention matrix", **{m: {"sec": s, "rows": n} for m, (s, n) in res.items()}}),
          flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
