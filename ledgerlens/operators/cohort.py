"""Activation cohorts, churn attribution, cumulative churn, retention matrix.

Input is the storyline (one row per consumer and day, see ``subscription``, or
one per consumer and interval, see ``intervals``) and a contract table ``(contract_number, created_at, effective_at,
canceled_at)``.

Scale notes. Cohort and churn sets are distinct (consumer, month) pairs, so a
consumer contributes at most one row per month to each: the churn
attribution join on consumer is bounded per key by the number of months, and
the first churn month is an aggregated ``min`` (no window sort);
``cohort_attribution`` gets the same rows in one pass over the base. The
final cumulative window is partitioned by cohort month and holds at most 14
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import DateLike, date_lit, later_of, month_start, to_py_date
from .subscription import ACTIVE, INACTIVE

# --- fixed values (must equal the reference's for equal results) -------------
STAYED_ACTIVE = "Permaneceu Ativo"
CHURN_LABELS = ("a. m0", "b. m1", "c. m2", "d. m3", "e. m4", "f. m5",
                "g. m6", "h. m7", "i. m8", "j. m9", "k. m10", "l. m11")
POOLED_LABEL_PREFIX = "< "
MONTH_LABEL_FORMAT = "y-MM-01"
# -----------------------------------------------------------------------------


def _seen_in(month) -> F.Column:
    """Some day of the row lies in the month that starts on ``month``."""
    return (F.col("metric_date") <= F.last_day(month)) & (F.col("last_date") >= month)


def _on_month_end(as_of: DateLike) -> F.Column:
    """Some day of the row is the last of its month, or ``as_of``."""
    return (F.last_day("metric_date") <= F.col("last_date")) | date_lit(as_of).between(F.col("metric_date"), F.col("last_date"))


def cohort_base(story: DataFrame, contracts: DataFrame, excluded_title: str,
                created_from: DateLike = "2023-01-01") -> DataFrame:
    """Storyline rows with the contract's effective and cancel months.

    A row covers the days ``metric_date`` to ``last_date``: one day, unless the
    storyline comes in intervals.
    """
    if "last_date" not in story.columns:
        story = story.withColumn("last_date", F.col("metric_date"))
    s = story.where((F.col("package_title") != excluded_title) & F.col("effective_at").isNotNull())
    c = contracts.where(F.to_date("created_at") >= date_lit(created_from)).select(
        F.col("contract_number").alias("_contract"),
        later_of(F.col("created_at"), F.col("effective_at")).alias("_eff"),
        F.col("canceled_at").alias("_canceled"))
    j = s.join(c, F.col("contract_number") == F.col("_contract"), "inner")
    return j.select("metric_date", "last_date", "contract_number", "consumer_id",
                    F.to_date("_eff").alias("effective_date"),
                    month_start(F.col("_eff")).alias("effective_month"),
                    F.to_date("_canceled").alias("canceled_date"),
                    month_start(F.col("_canceled")).alias("canceled_month"),
                    "status_contract")


def activation_cohort(base: DataFrame) -> DataFrame:
    """Distinct (consumer, effective month) seen in the storyline in that month."""
    return (base.where(_seen_in(F.col("effective_month")))
                .select("consumer_id", "effective_month").distinct())


def month_end_churn(base: DataFrame, as_of: DateLike = None) -> DataFrame:
    """Distinct (consumer, cancel month) inactive on a month end or on ``as_of``."""
    return (base.where((F.col("status_contract") == INACTIVE) & _on_month_end(as_of))
                .select("consumer_id", "canceled_month").distinct())


def churn_attribution(cohort: DataFrame, churn: DataFrame) -> DataFrame:
    """First churn month at or after each cohort month, and months between.

    Equal to ``row_number() over (partition by consumer, cohort order by churn
    month) = 1`` after the left equi+range join, computed as a grouped ``min``.
    A cohort row without churn keeps a null churn month and delta.
    """
    c = churn.select(F.col("consumer_id").alias("_consumer"), "canceled_month")
    j = cohort.join(c, (F.col("consumer_id") == F.col("_consumer")) &
                    (F.col("effective_month") <= F.col("canceled_month")), "left")
    first = j.groupBy("consumer_id", "effective_month").agg(F.min("canceled_month").alias("canceled_month"))
    return first.select("consumer_id", "effective_month", "canceled_month",
                        F.months_between("canceled_month", "effective_month").alias("delta_meses_churn"))


def cohort_attribution(base: DataFrame, as_of: DateLike = None) -> DataFrame:
    """Activation cohort, month-end churn and churn attribution in one pass.

    Same rows as ``churn_attribution(activation_cohort(base),
    month_end_churn(base, as_of))``, but the base is read once: cohort and
    churn months are tagged in one projection and deduplicated together, and
    the first churn month at or after each cohort month is a ``min`` over a
    RANGE window per consumer (current month to the last one). A consumer has
    at most two rows per month there, so the window is bounded by the number
    of months, however active the consumer.
    """
    in_cohort = _seen_in(F.col("effective_month"))
    churned = (F.col("status_contract") == INACTIVE) & _on_month_end(as_of)
    tagged = (base.where(in_cohort | churned)
                  .select("consumer_id", F.explode(F.array(
                      F.when(in_cohort, F.struct(F.lit(True).alias("c"), F.col("effective_month").alias("m"))),
                      F.when(churned, F.struct(F.lit(False).alias("c"), F.col("canceled_month").alias("m"))))).alias("_e"))
                  .where(F.col("_e").isNotNull())
                  .select("consumer_id", F.col("_e.c").alias("_is_cohort"), F.col("_e.m").alias("_month"))
                  .distinct())
    later = (Window.partitionBy("consumer_id").orderBy(F.col("_month").asc_nulls_first())
                   .rangeBetween(Window.currentRow, Window.unboundedFollowing))
    first_churn = F.min(F.when(~F.col("_is_cohort"), F.col("_month"))).over(later)
    out = tagged.select("consumer_id", "_is_cohort", F.col("_month").alias("effective_month"),
                        first_churn.alias("canceled_month")).where(F.col("_is_cohort"))
    return out.select("consumer_id", "effective_month", "canceled_month",
                      F.months_between("canceled_month", "effective_month").alias("delta_meses_churn"))


#: Months of one word of a bitmap; the sign bit stays free.
MONTHS = 62


def month_bitmaps(base: DataFrame, first: DateLike, as_of: DateLike) -> DataFrame:
    """One row per consumer: its cohort and churn months as bits, ``c0, c1, ...`` and ``x0, x1, ...``.

    Bit i of word w is month ``MONTHS * w + i`` after the month of ``first``; the
    words reach the month of ``as_of``. Every task ors its rows together before
    the exchange, which carries one row per consumer and task. ``beyond`` is
    the first churn month after ``as_of`` (a cancel date in the future).
    """
    origin, end = to_py_date(first).replace(day=1), to_py_date(as_of).replace(day=1)
    months = (end.year - origin.year) * 12 + end.month - origin.month + 1
    at = lambda c: (F.months_between(F.trunc(c, "month"), F.lit(origin)).cast("int"))
    in_cohort = _seen_in(F.col("effective_month"))
    churned = (F.col("status_contract") == INACTIVE) & _on_month_end(as_of)
    rows = base.where(in_cohort | churned).select(
        "consumer_id", F.when(in_cohort, at("effective_month")).alias("_c"), F.when(churned, at("canceled_month")).alias("_x"),
        F.when(churned, F.col("canceled_month")).alias("_month"))

    def word(name: str, w: int) -> F.Column:
        inside = (F.col(name) >= w * MONTHS) & (F.col(name) < (w + 1) * MONTHS)
        bit = F.expr(f"shiftleft(cast(1 as bigint), {name} - {w * MONTHS})")
        return F.coalesce(F.bit_or(F.when(inside, bit)), F.lit(0).cast("long")).alias(f"{name[1:]}{w}")

    words = range(-(-months // MONTHS))
    return rows.groupBy("consumer_id").agg(*(word("_c", w) for w in words), *(word("_x", w) for w in words),
                                           F.min(F.when(F.col("_x") >= MONTHS * len(words), F.col("_month"))).alias("beyond"))


def bitmap_attribution(bitmaps: DataFrame, first: DateLike) -> DataFrame:
    """Activation cohort and churn attribution (A33, A35) from ``month_bitmaps``: the rows of ``cohort_attribution``.

    A cohort month's first churn month is the lowest set bit of the churn words
    from that month on. Null consumers are one consumer, as in a grouping.
    """
    origin = to_py_date(first).replace(day=1)
    words = [int(c[1:]) for c in bitmaps.columns if c.startswith("c") and c[1:].isdigit()]

    def set_months(w: int) -> F.Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(MONTHS - 1)), lambda i: F.getbit(F.col(f"c{w}"), i) == 1)
        return F.transform(bits, lambda i: i + w * MONTHS)

    months = F.flatten(F.array(*map(set_months, words)))
    rows = bitmaps.where(" or ".join(f"c{w} <> 0" for w in words)).withColumn("_m", F.explode(months))
    found = []
    for w in words:
        later = F.expr(f"""case when _m < {w * MONTHS} then x{w} when _m < {(w + 1) * MONTHS}
                           then shiftleft(shiftright(x{w}, _m - {w * MONTHS}), _m - {w * MONTHS}) else cast(0 as bigint) end""")
        found.append(F.when(later != 0, F.bit_count(later.bitwiseAND(-later) - 1) + w * MONTHS))
    churn = F.coalesce(F.add_months(F.lit(origin), F.coalesce(*found)), F.col("beyond"))
    out = rows.select("consumer_id", F.add_months(F.lit(origin), F.col("_m")).alias("effective_month"), churn.alias("canceled_month"))
    return out.select("*", F.months_between("canceled_month", "effective_month").alias("delta_meses_churn"))


def churn_label(delta: F.Column) -> F.Column:
    """'Permaneceu Ativo' for no churn, 'a. m0' .. 'l. m11', null beyond 11."""
    n = delta.cast("int")
    expr = F.when(delta.isNull(), F.lit(STAYED_ACTIVE))
    for i, label in enumerate(CHURN_LABELS):
        expr = expr.when(n == i, F.lit(label))
    return expr


def cohort_churn(attribution: DataFrame, as_of: DateLike = None, horizon_months: int = 12) -> DataFrame:
    """Churn per cohort month and churn month, with % and cumulative.

    Output: safra, mes_churn, clientes, clientes_pct, clientes_acum,
    clientes_acum_pct. Cohorts of the last ``horizon_months`` months up to
    ``as_of``. The running sum is ordered by label (nulls first) and skips the
    'Permaneceu Ativo' row, whose cumulative values fall back to its own.

    The cohort size is the sum of the counts of its month: the attribution has
    exactly one row per cohort row, so this equals counting the cohort, without
    reading it again.
    """
    lower = F.add_months(F.trunc(date_lit(as_of), "month"), -(horizon_months - 1))
    # Grouped by the whole-month delta first (deltas above 11 stay separate
    # rows that share a null label), then labelled.
    counts = (attribution.where(F.col("effective_month") >= lower)
                         .groupBy("effective_month", F.col("delta_meses_churn").cast("int").alias("_delta"))
                         .agg(F.count_distinct("consumer_id").alias("clientes"))
                         .select("effective_month", churn_label(F.col("_delta")).alias("mes_churn"), "clientes"))
    size = F.sum("clientes").over(Window.partitionBy("effective_month"))
    w = (Window.partitionBy("effective_month").orderBy(F.col("mes_churn").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    acum = F.sum(F.when(F.col("mes_churn") != STAYED_ACTIVE, F.col("clientes"))).over(w)
    j = counts.select("*", size.alias("_size"), acum.alias("_acum"))
    pct = 100 * F.col("clientes") / F.col("_size")
    pct_acum = 100 * F.col("_acum") / F.col("_size")
    return j.select(F.col("effective_month").alias("safra"), "mes_churn", "clientes",
                    pct.alias("clientes_pct"),
                    F.coalesce(F.col("_acum"), F.col("clientes")).alias("clientes_acum"),
                    F.coalesce(pct_acum, pct).alias("clientes_acum_pct"))


def retention_matrix(story: DataFrame, excluded_title: str, as_of: DateLike = None,
                     pool_before: str = "2023-07-01") -> DataFrame:
    """Active rows on month ends (or ``as_of``) by production month x cohort month.

    Months before ``pool_before`` are pooled under '< pool_before'. Month
    labels are 'yyyy-MM-01' strings. Counts rows (one per consumer and day).
    """
    d = F.col("metric_date")

    def label(c):
        m = F.date_format(c, MONTH_LABEL_FORMAT)
        return F.when(m >= pool_before, m).otherwise(F.lit(POOLED_LABEL_PREFIX + pool_before))

    s = story.where(((d == F.last_day(d)) | (d == date_lit(as_of))) &
                    (F.col("status_contract") == ACTIVE) & (F.col("package_title") != excluded_title))
    return (s.groupBy(label(d).alias("data_producao"), label(F.col("effective_at")).alias("data_safra"))
             .agg(F.count(F.lit(1)).alias("consumers")))
