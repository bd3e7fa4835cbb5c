"""Raw transactions to the daily aggregate, and the counters of a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshock.functions.parsing import clean_key, clean_text, does_not_fit, tolerant_date, tolerant_decimal
from panelshock.functions.scalars import average_price, sum_unless_missing

KEY = ("TA_YMD", "MCT_SGG_CD", "MCT_RY_CD")
MEASURES = ("TS_AT", "USE_CNT")


def parse_transactions(raw: DataFrame, precision: int = 38, scale: int = 10) -> DataFrame:
    """Trimmed keys (NULL when blank) and exact measures (NULL when missing or not a number).

    ``<measure>_invalid`` marks text that is there but is not a number, ``<measure>_unfit`` a
    number that decimal(precision, scale) cannot hold exactly; it is NULL, never rounded."""
    columns = [clean_key(k).alias(k) for k in KEY]
    for m in MEASURES:
        value, unfit = tolerant_decimal(m, precision, scale), does_not_fit(m, precision, scale)
        there = clean_text(F.coalesce(F.col(m), F.lit(""))) != ""
        columns += [value.alias(m), (value.isNull() & there & ~unfit).alias(f"{m}_invalid"), unfit.alias(f"{m}_unfit")]
    return raw.select(*columns)


def has_keys(df: DataFrame, keys=KEY) -> DataFrame:
    """Rows whose keys are all there."""
    return df.dropna(subset=list(keys))


def daily_aggregate(parsed: DataFrame, keys=KEY) -> DataFrame:
    """One row per key. A sum is NULL when any of its inputs is missing; rows with a blank key
    are left out; rows with a bad date stay."""
    sums = has_keys(parsed, keys).groupBy(*keys).agg(*[sum_unless_missing(m).alias(m) for m in MEASURES])
    return sums.withColumn("avg_price", average_price(*MEASURES))


def load_report(raw: DataFrame, precision: int = 38, scale: int = 10) -> DataFrame:
    """One row of load counters.

    Rows are first folded to one row per key (partial aggregation on the map side), so the
    distinct counts run over keys and not over rows."""
    sales, count = MEASURES
    parsed = parse_transactions(raw, precision, scale)
    whole = F.lit(True)
    for k in KEY:
        whole = whole & F.col(k).isNotNull()
    per_key = (
        parsed.withColumn("keyed", whole)
        .groupBy("keyed", *KEY)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col(m).isNull()).alias(f"{m}_missing") for m in MEASURES],
            *[F.count_if(F.col(f"{m}_{k}")).alias(f"{m}_{k}") for m in MEASURES for k in ("invalid", "unfit")],
            F.count_if(F.col(count) == 0).alias("zero_counts"),
            F.sum(count).alias("count_sum"),
        )
        .withColumn("day", F.when(F.col("keyed"), tolerant_date(KEY[0])))
    )

    def keyed(c: Column) -> Column:
        return F.when(F.col("keyed"), c)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(keyed(c)), F.lit(0)).cast("long")

    complete_count = F.col(f"{count}_missing") == 0
    complete_sales = F.col(f"{sales}_missing") == 0
    zero_sum = complete_count & (F.col("count_sum") == 0)
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("raw_rows"),
        F.coalesce(F.sum(F.when(~F.col("keyed"), F.col("rows"))), F.lit(0)).cast("long").alias("blank_key_rows"),
        total(F.when(F.col("day").isNull(), F.col("rows"))).alias("bad_date_rows"),
        total(F.col("rows") - 1).alias("repeated_key_rows"),
        total(F.col(f"{sales}_missing")).alias("missing_sales"),
        total(F.col(f"{sales}_invalid")).alias("invalid_sales"),
        total(F.col(f"{count}_missing")).alias("missing_counts"),
        total(F.col(f"{count}_invalid")).alias("invalid_counts"),
        total(F.col(f"{sales}_unfit")).alias("unfit_sales"),
        total(F.col(f"{count}_unfit")).alias("unfit_counts"),
        total(F.col("zero_counts")).alias("zero_counts"),
        F.count_if(F.col("keyed")).alias("groups"),
        F.count_if(F.col("keyed") & ~complete_sales).alias("groups_missing_sales"),
        F.count_if(F.col("keyed") & ~complete_count).alias("groups_missing_counts"),
        F.count_if(F.col("keyed") & zero_sum).alias("groups_zero_count"),
        F.count_if(F.col("keyed") & (~complete_sales | ~complete_count | zero_sum)).alias("groups_without_price"),
        F.min("day").alias("min_date"),
        F.max("day").alias("max_date"),
        F.count_distinct(keyed(F.col(KEY[1]))).alias("regions"),
        F.count_distinct(keyed(F.col(KEY[2]))).alias("industries"),
    )
