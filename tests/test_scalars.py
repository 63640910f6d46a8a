import datetime as dt

import pytest
from pyspark.sql import functions as F

from furlong.functions import scalars as x


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("raw,want", [("62.5", 62.5), ("1:02.5", 62.5), ("1:00:02", 3602.0), ("x", None), ("", None), ("1:x", None)])
def test_clock(spark, raw, want):
    assert one(spark, x.time_seconds(lit(raw))) == want


@pytest.mark.parametrize("name,want", [("کلاس1(140-96)", "class1"), ("کلاس4(85-71)", "class4"), ("گروه 1", "group1"), ("مبتدی/نبرده", "maiden"), ("", "unknown"), ("Derby", "other"), ("Cup G3", "g3")])
def test_race_class(spark, name, want):
    assert one(spark, x.race_class(lit(name))) == want


def test_jalali_both_ways(spark):
    for day, text in ((dt.date(2024, 3, 20), "1403/01/01"), (dt.date(2026, 2, 14), "1404/11/25"), (dt.date(2025, 3, 20), "1403/12/30"), (dt.date(1994, 5, 20), "1373/02/30")):
        assert one(spark, x.jalali_text(lit(day, "date"))) == text
        y, m, d = map(int, text.split("/"))
        assert one(spark, x.from_jalali(F.lit(y), F.lit(m), F.lit(d))) == day


def test_weighted_present_renormalises(spark):
    null = F.lit(None).cast("double")
    assert one(spark, x.weighted_present([(0.5, F.lit(10.0)), (0.5, null)])) == 10.0
    assert one(spark, x.weighted_present([(0.5, null)])) is None
    assert one(spark, x.weighted_present([(0.5, null)], 40.0)) == 40.0


def test_missing_is_never_imputed(spark):
    null = F.lit(None).cast("double")
    assert one(spark, x.rate(F.lit(0), F.lit(0))) is None
    assert one(spark, x.finish_points(null)) is None
    assert one(spark, x.eb_rate(F.lit(0), F.lit(0), F.lit(0.2))) is None
    assert one(spark, x.heat_index_c(F.lit(30.0), null)) is None


def test_names_and_sex(spark):
    assert one(spark, x.normalize_name(lit("  Ali‌ (كاوه) ۱۲ "))) == "ali کاوه 12"
    assert one(spark, x.bio_sex(lit("female"), F.lit(3.0))) == "Filly"
    assert one(spark, x.bio_sex(lit("نر"), F.lit(7.0))) == "Stallion"
    assert one(spark, x.normalize_sex(lit("Gelding"))) == "gelding"


def test_weather(spark):
    assert one(spark, x.track_condition(F.lit(6.0), F.lit(None).cast("double"), F.lit(0.0))) == "muddy"
    assert one(spark, x.wind_compass(F.lit(359.0))) == "N"
    assert one(spark, x.wmo_condition(F.lit(95))) == "thunderstorm"
    assert one(spark, x.weather_category(lit(None), F.lit(1.0))) == "precip"
