"""Dimensions of the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.functions import cents, dollars, ladder, pct

# fixed values: the member that stands for customers missing from the dimension
UNKNOWN_CUSTOMER_ID = "00000000-0000-0000-0000-000000000000"
UNKNOWN_CUSTOMER = {
    "customer_id": UNKNOWN_CUSTOMER_ID,
    "customer_external_id": "UNKNOWN-CUSTOMER",
    "email": "unknown@customer.invalid",
    "first_name": "Unknown",
    "last_name": "Customer",
    "region": "UNKNOWN",
    "country_code": "UNK",
    "segment": "unknown",
    "signup_date": dt.date(1900, 1, 1),
    "signup_channel": "unknown",
    "account_status": "closed",
    "signup_year": 1900,
    "signup_cohort": "unknown",
    "created_at": dt.datetime(1900, 1, 1),
    "updated_at": dt.datetime(1900, 1, 1),
    "is_unknown_customer": True,
}

PRICE_TIERS = ((20, 50, 150), ("budget", "mid_range", "premium", "luxury"))


def year_quarter(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))


def dim_customers(customers: DataFrame) -> DataFrame:
    real = customers.select(
        "customer_id",
        "customer_external_id",
        "email",
        "first_name",
        "last_name",
        "region",
        "country_code",
        "segment",
        "signup_date",
        "signup_channel",
        "account_status",
        F.year("signup_date").cast("bigint").alias("signup_year"),
        F.date_format("signup_date", "yyyy-MM").alias("signup_cohort"),
        "created_at",
        "updated_at",
        F.lit(False).alias("is_unknown_customer"),
    )
    unknown = customers.sparkSession.range(1).select(
        *[F.lit(UNKNOWN_CUSTOMER[f.name]).cast(f.dataType).alias(f.name) for f in real.schema]
    )
    return real.unionByName(unknown)


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select(
        "seller_id",
        "seller_external_id",
        "business_name",
        "seller_type",
        "tier",
        "onboarding_date",
        "region",
        "country_code",
        "primary_category",
        "avg_rating",
        "total_reviews",
        "is_verified",
        "is_suspended",
        "commission_rate",
        F.year("onboarding_date").cast("bigint").alias("onboarding_year"),
        F.date_format("onboarding_date", "yyyy-MM").alias("onboarding_cohort"),
        "created_at",
        "updated_at",
    )


def dim_products(products: DataFrame) -> DataFrame:
    margin = cents("price") - cents("cost")
    bounds, labels = PRICE_TIERS
    return products.select(
        "product_id",
        "product_sku",
        "seller_id",
        "product_name",
        "category",
        "subcategory",
        "brand",
        "price",
        "cost",
        "weight_kg",
        "avg_rating",
        "review_count",
        "return_rate",
        "is_active",
        "launch_date",
        dollars(margin).alias("gross_margin"),
        F.when(F.col("price") > 0, pct(margin, cents("price"), 2)).otherwise(F.lit(0.0)).alias("gross_margin_pct"),
        F.when(F.col("price").isNull(), labels[-1])
        .otherwise(ladder(F.col("price"), bounds, labels, inclusive=False))
        .alias("price_tier"),
        "created_at",
        "updated_at",
    )


def dim_dates(
    spark: SparkSession,
    start: dt.date = dt.date(2022, 1, 1),
    end: dt.date = dt.date(2026, 12, 31),
    fiscal_start_month: int = 2,
) -> DataFrame:
    day = F.col("date_day")
    month = F.month(day)
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date_day"))
    season = (
        F.when(month.isin(10, 11, 12), "Q4_peak")
        .when(month == 1, "post_holiday")
        .when(month.isin(7, 8), "summer_dip")
        .otherwise("normal")
    )
    return calendar.select(
        day,
        F.year(day).cast("bigint").alias("year"),
        F.quarter(day).cast("bigint").alias("quarter"),
        month.cast("bigint").alias("month"),
        F.weekofyear(day).cast("bigint").alias("week_of_year"),
        (F.dayofweek(day) - 1).cast("bigint").alias("day_of_week"),
        F.dayofyear(day).cast("bigint").alias("day_of_year"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        year_quarter(day).alias("year_quarter"),
        F.dayofweek(day).isin(1, 7).alias("is_weekend"),
        (F.year(day) - F.when(month < fiscal_start_month, 1).otherwise(0)).cast("bigint").alias("fiscal_year"),
        season.alias("season_label"),
    )
