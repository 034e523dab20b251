"""Audience split into labelled groups and stratified capped samples.

Membership is decided by 52 bits of the md5 of the key and a seed, not by
``rand``: the same consumer lands in the same group on every run and every
task retry, which ``randomSplit``/``sample`` only guarantee for an identical
input partitioning, and any engine with md5 reproduces the draw exactly
(the SQL twins of the registered queries do). Group bounds and the sampling
fraction are integer thresholds on those bits. Caps (none by default) keep the
rows with the least bits of a group, a uniform random order: a histogram of
the leading bits finds where a group reaches its cap, and only that narrow
range is ranked, however large the group or the cap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .rank import cap_by_bits, free_name

# --- fixed values (must equal the reference's for equal results) -------------
GROUP_LABEL = "Grupo {}"
# -----------------------------------------------------------------------------

HASH_BITS = 52
HASH_SCALE = 1 << HASH_BITS


def hash_bits(*keys, seed: int) -> Column:
    """52 pseudo-random bits: the first 13 hex digits of md5('k1|k2|...|seed')."""
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def split_thresholds(weights: Sequence[float]) -> list[int]:
    """Upper bounds (exclusive) on the hash bits of every group but the last."""
    total = float(sum(weights))
    out, acc = [], 0.0
    for w in list(weights)[:-1]:
        acc += w
        out.append(int(round(acc / total * HASH_SCALE)))
    return out


def fraction_threshold(fraction: float) -> int:
    return int(round(fraction * HASH_SCALE))


def audience_split(df: DataFrame, consumer_col: str = "consumer_id", weights: Sequence[float] = (1, 1, 1),
                   cap: int | None = None, seed: int = 0, label_col: str = "grupos",
                   where: Column | None = None) -> DataFrame:
    """Disjoint labelled groups of distinct consumers, each capped at ``cap`` if given.

    ``weights`` are normalised (``randomSplit`` semantics); group ``i`` is
    labelled 'Grupo i'. Output: ``consumer_col, label_col``.
    """
    base = df.where(where) if where is not None else df
    base = base.select(consumer_col).where(F.col(consumer_col).isNotNull()).distinct()
    h = base.select(consumer_col, hash_bits(consumer_col, seed=seed).alias("_h"))
    label = None
    for i, bound in enumerate(split_thresholds(weights), start=1):
        cond = F.col("_h") < F.lit(bound)
        name = F.lit(GROUP_LABEL.format(i))
        label = F.when(cond, name) if label is None else label.when(cond, name)
    last = F.lit(GROUP_LABEL.format(len(weights)))
    out = h.select(consumer_col, (label.otherwise(last) if label is not None else last).alias(label_col), "_h")
    if cap is not None:
        out = cap_by_bits(out, label_col, "_h", consumer_col, cap, HASH_BITS)
    return out.drop("_h")


def stratified_sample(df: DataFrame, strata_col: str, consumer_col: str = "consumer_id",
                      strata: Sequence[str] | None = None, fraction: float = 0.5, seed: int = 123,
                      cap: int | None = None) -> DataFrame:
    """Per stratum: Bernoulli(``fraction``) sample of distinct rows, capped at ``cap`` if given.

    The draw is ``hash_bits(consumer, stratum, seed) < fraction * 2^52``.
    Output: ``consumer_col, strata_col``.
    """
    base = df.select(consumer_col, strata_col)
    if strata is not None:
        base = base.where(F.col(strata_col).isin(*strata))
    # The draw depends only on (consumer, stratum), so it can run before the
    # distinct: same rows, and the distinct shuffles only the sampled ones.
    h = hash_bits(consumer_col, strata_col, seed=seed)
    sampled = (base.select("*", h.alias("_h")).where(F.col("_h") < F.lit(fraction_threshold(fraction)))
                   .distinct())
    if cap is not None:
        sampled = cap_by_bits(sampled, strata_col, "_h", consumer_col, cap, HASH_BITS)
    return sampled.drop("_h")


def _capped(df: DataFrame, group: str, seed: int | None, cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, in the order of a hash of the whole row (not ``limit``'s arbitrary rows)."""
    bits = free_name(df, "__bits")
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    return cap_by_bits(df.withColumn(bits, hash_bits(*values, seed=seed or 0)), group, bits, bits, cap, HASH_BITS).drop(bits)


def random_split_groups(df: DataFrame, weights: Sequence[float] = (0.1, 0.1, 0.1), seed: int | None = None,
                        cap: int | None = None, label_col: str = "grupos") -> DataFrame:
    """The reference's form: ``randomSplit`` then label, cap and union.

    Not reproducible across runs unless ``seed`` is set and the input
    partitioning is identical; kept for users who need that behaviour.
    """
    parts = df.randomSplit(list(weights), seed)
    out = None
    for i, part in enumerate(parts, start=1):
        p = part.select("*", F.lit(GROUP_LABEL.format(i)).alias(label_col))
        out = p if out is None else out.unionByName(p)
    return out if cap is None else _capped(out, label_col, seed, cap)


def bernoulli_sample(df: DataFrame, fraction: float = 0.5, seed: int = 123, cap: int | None = None,
                     where: Column | None = None) -> DataFrame:
    """The source form of one stratum: ``sample(False, fraction, seed)`` then a cap.

    Spark's sampler is seeded per partition, so the rows depend on the input
    partitioning; ``stratified_sample`` is the reproducible form.
    """
    base = df.where(where) if where is not None else df
    out = base.sample(withReplacement=False, fraction=fraction, seed=seed)
    if cap is None:
        return out
    one = free_name(out, "__one")
    return _capped(out.withColumn(one, F.lit(1)), one, seed, cap).drop(one)
