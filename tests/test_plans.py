"""Plan properties the scale design relies on (checked on the executed plans)."""

import re

import __spark_entry__ as entry
from conftest import SF_SMALL

from ledgerlens.session import ensure_checkpoint_dir, scratch_path


def executed(df):
    df.collect()  # runs this frame's own query execution, so the adaptive plan is the final one
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    # the initial plan is printed below the final one; subqueries, indented, have both of their own
    return plan.split("\n+- == Initial Plan ==")[0]


def test_rolling_metric_pushes_date_range_to_scan(spark):
    df = entry.queries()["rolling_active_35"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "o_custkey" in line]
    assert any("GreaterThanOrEqual(o_orderdate" in s and "LessThan(o_orderdate" in s for s in scan), scan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_storyline_exchanges_contracts_and_makes_days_last(spark):
    plan = executed(entry.queries()["storyline"](spark, SF_SMALL))
    lines = plan.splitlines()
    days = next(i for i, line in enumerate(lines) if "sequence(metric_date" in line or "sequence(" in line and "last_date" in line)
    sweeps = [i for i, line in enumerate(lines) if "MapInArrow" in line]
    between = lines[sweeps[0]:sweeps[1]]
    assert days < sweeps[0] and len(sweeps) == 2                                 # days are made above both sweeps
    assert sum("Exchange hashpartitioning(consumer_id" in line for line in between) == 1
    assert not any("Exchange" in line for line in lines[:sweeps[0]])             # and never exchanged
    assert "Window" not in "".join(lines[:sweeps[1]])


def test_cohort_report_reads_the_base_once(spark):
    plan = executed(entry.queries()["cohort_churn"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)) <= 20


def test_legacy_cashback_one_join_for_all_products(spark):
    # Without auto-broadcast (as with large tables): one exchange for the
    # unioned payments of all products, one for the promo side.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(entry.queries()["cashback_before"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"hashpartitioning\(key_kind", plan)) == 1
    assert len(re.findall(r"hashpartitioning\(_kind", plan)) == 1


def test_checkpoint_dir_is_read_not_replaced(spark):
    current = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == current
    assert scratch_path(spark, "x").startswith(current)


def test_top1_and_caps_limit_rows_before_the_shuffle(spark):
    for key in ("contract_latest_status",):
        plan = executed(entry.queries()[key](spark, SF_SMALL))
        assert "WindowGroupLimit" in plan, key


def test_rolling_metric_has_one_exchange_below_the_daily_sums(spark):
    plan = executed(entry.queries()["rolling_active_7"](spark, SF_SMALL))
    assert len(re.findall(r"hashpartitioning\(event_type#\d+, _consumer", plan)) == 1
    assert plan.count("hashpartitioning(event_type") == 3       # besides it, the sums by (group, day) and the running sum by group


def test_active_base_makes_one_day_only(spark):
    plan = executed(entry.queries()["active_base_check"](spark, SF_SMALL))
    assert "sequence(" not in plan.replace("sequence(0", "")


def test_payment_ids_are_counted_by_16_byte_marks(spark):
    plan = executed(entry.queries()["cashback_payment_ids"](spark, SF_SMALL))
    expand = [line for line in plan.splitlines() if "Expand" in line]
    assert expand and not any("product_type_name" in line for line in expand)
