import datetime as dt

import __spark_entry__ as entry
from tidegrid.operators import seasonality

US = {
    "2021-01-01": "new_years_day", "2021-01-18": "martin_luther_king_jr_day", "2021-02-15": "washingtons_birthday", "2021-05-31": "memorial_day", "2021-06-19": "juneteenth_national_independence_day", "2021-07-04": "independence_day",
    "2021-09-06": "labor_day", "2021-10-11": "columbus_day", "2021-11-11": "veterans_day", "2021-11-25": "thanksgiving_day", "2021-12-25": "christmas_day",
}


def test_all_holidays_of_a_year(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(365)]
    df = spark.createDataFrame([("a", d) for d in days] + [("a", dt.date(2020, 6, 19))], "id string, day date")
    got = {str(r["day"]): r["holiday__US"] for r in seasonality.add_holiday_effects(df, ["US"]).collect()}
    assert len(got) == 366 and {d: h for d, h in got.items() if h} == US


def test_holidays_of_every_order(spark, data):
    got = entry.queries()["cal_holiday_effects"](spark, data).toPandas()
    assert len(got) == spark.read.parquet(f"{data}/orders.parquet").count() and got["holiday__US"].isna().any()
    assert {"memorial_day", "labor_day", "thanksgiving_day"} <= set(got["holiday__US"].dropna())


def test_wide_holds_every_entity(spark, data):
    rows = spark.read.parquet(f"{data}/orders.parquet").join(spark.read.parquet(f"{data}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    nations = {str(r[0]) for r in rows.select("c_nationkey").distinct().collect()}
    wide = entry.queries()["long_to_wide"](spark, data)
    assert set(wide.columns) - {"month"} == {str(k) for k in range(25)}
    long = entry.queries()["wide_to_long"](spark, data).toPandas()
    assert len(nations) > 4 and set(long["entity"]) == nations and len(long) == len(nations) * wide.count()


def test_observed_days_and_other_countries(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(i) for i in range(365)]
    df = spark.createDataFrame([("a", d) for d in days], "id string, day date")
    got = {str(r["day"]): r["holiday__US"] for r in seasonality.add_holiday_effects(df, ["US"], observed=True).collect() if r["holiday__US"]}
    assert got == US | {"2021-06-18": "juneteenth_national_independence_day_(observed)", "2021-07-05": "independence_day_(observed)", "2021-12-24": "christmas_day_(observed)", "2021-12-31": "new_years_day_(observed)"}
    some = seasonality.add_holiday_effects(df, ["CA", "IT", "ES", "AT", "BE", "PL", "GB"]).collect()
    at = {str(r["day"]): r for r in some}
    assert at["2021-05-24"]["holiday__CA"] == "victoria_day" and at["2021-04-04"]["holiday__IT"] == "easter_sunday" and at["2021-06-03"]["holiday__PL"] == at["2021-06-03"]["holiday__AT"] == "corpus_christi"
    assert at["2021-12-06"]["holiday__ES"] == "constitution_day" and at["2021-07-21"]["holiday__BE"] == "national_day" and at["2021-08-30"]["holiday__GB"] == "late_summer_bank_holiday"
