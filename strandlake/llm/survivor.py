"""One surviving record per group of duplicate records.

survivors() keeps, in one shuffle, the records that win a stated order of preference: one for the record and one per
field. truth_discovery() builds field values by iterative truth discovery: source reliability and weighted votes for
field values are estimated alternately until they settle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import materialize


def survivors(df: DataFrame, keys: list[str], winners: dict[str, tuple[Column | None, list[Column], Column]], least: int = 2) -> DataFrame:
    """keys, n and a column per winner: name -> (eligible or None, preferences best-is-largest, what to report).

    Of the rows where `eligible` holds (all, if None), the one whose preferences are largest in order is reported; null
    preferences count as smallest; a group without an eligible row reports null. Put a unique column last among the
    preferences: ties then have one winner. Groups of fewer than `least` rows are left out, and so are rows with a null
    key. Each winner is a maximum of a struct, so that partial maxima are taken before the shuffle and a hot group is no
    larger than another; an empty table gives no rows; other columns are dropped.
    """
    rows = df.select(
        *keys,
        *[
            F.when(F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)], report.alias("report"))).alias(f"__{name}")
            for name, (eligible, prefer, report) in winners.items()
        ],
    ).dropna(subset=keys)
    best = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.max(f"__{name}").alias(name) for name in winners])
    return best.where(F.col("n") >= least).select(*keys, "n", *[F.col(f"{name}.report").alias(name) for name in winners])


def truth_discovery(df: DataFrame, keys: list[str], source: str, fields: list[str], rounds: int = 50, tolerance: float = 1e-3) -> DataFrame:
    """keys and, per field, the value with the highest support, in the field's own type, and its share of the support (name
    and name_support), settled: whether the reliabilities came to rest, and rounds: after how many.

    A source's reliability is the smoothed share of its contested claims (of a group's field with different values; the
    others tell nothing) that agree with the current choice; a claim votes with the log odds of its source's reliability (at least a little, so that no source is silenced). Votes and reliabilities
    are estimated in turn until no reliability moves by more than `tolerance`; `rounds` is a bound for safety, and if it is
    reached first, settled is false in every row.

    Claims are first counted per (group, field, value, source), with partial counts before the shuffle. Ties go to the
    value more sources claim and then to the smaller value as text. Null values claim nothing: a field nobody claims is
    null with support null. Null keys or sources are left out; an empty table gives no rows; other columns are dropped.
    The reliability table has one row per source and is joined by its measured size. Fields are of plain types; an array
    is claimed by a hash of it.
    """
    kinds = {f: df.schema[f].dataType for f in fields}
    if bad := [f for f, k in kinds.items() if isinstance(k, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]:
        raise ValueError(f"no plain type: {', '.join(bad)}")
    claims = None
    for f in fields:
        one = df.select(*keys, F.col(source).alias("__source"), F.lit(f).alias("__field"), F.col(f).cast("string").alias("__value"))
        claims = one if claims is None else claims.unionByName(one)
    claims = claims.dropna(subset=[*keys, "__source", "__value"])
    claims = materialize(claims.groupBy(*keys, "__field", "__value", "__source").agg(F.count(F.lit(1)).alias("__n")), "claims")
    trust = claims.select("__source").distinct().withColumn("__r", F.lit(0.8))
    chosen, settled = None, False
    used = 0
    for used in range(1, rounds + 1):
        weight = F.greatest(F.log(F.col("__r") / (1 - F.col("__r"))), F.lit(0.05))
        votes = claims.join(trust, "__source").groupBy(*keys, "__field", "__value").agg(F.sum(weight).alias("__w"), F.count(F.lit(1)).alias("__k"))
        # a minimum of structs, taken in part before the shuffle: a group with many different values is no window of one task
        best = F.min(F.struct((-F.round("__w", 9)).alias("w"), (-F.col("__k")).alias("k"), F.col("__value").alias("v"), F.col("__w").alias("full")))
        ranked = votes.groupBy(*keys, "__field").agg(best.alias("__b"), F.sum("__w").alias("__all"), F.count(F.lit(1)).alias("__values"))
        chosen = ranked.select(*keys, "__field", F.col("__b.v").alias("__best"), "__values", (F.col("__b.full") / F.col("__all")).alias("__support"))
        chosen = materialize(chosen, "chosen")
        agree = F.sum(F.when(F.col("__value") == F.col("__best"), F.col("__n")).otherwise(0))
        fresh = claims.join(chosen.where("__values > 1"), [*keys, "__field"]).groupBy("__source").agg(((agree + 4) / (F.sum("__n") + 5)).alias("__new"))
        both = materialize(trust.join(fresh, "__source", "left").withColumn("__new", F.least(F.coalesce("__new", "__r"), F.lit(0.999))), "trust")
        moved = both.agg(F.max(F.abs(F.col("__new") - F.col("__r")))).first()[0]
        trust = both.select("__source", F.col("__new").alias("__r"))
        if settled := moved is None or moved <= tolerance:
            break
    out = df.select(*keys).dropna().distinct()
    wide = chosen.groupBy(*keys).agg(
        *[x for f in fields for x in (F.max(F.when(F.col("__field") == f, F.col("__best"))).cast(kinds[f]).alias(f), F.max(F.when(F.col("__field") == f, F.col("__support"))).alias(f"{f}_support"))]
    )
    return out.join(wide, keys, "left").withColumn("settled", F.lit(settled)).withColumn("rounds", F.lit(used).cast("bigint"))
