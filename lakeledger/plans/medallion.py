"""The sample pipelines: raw to bronze, silver and gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sample data.
BOROUGHS = ["Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]
CONDITIONS = ["Clear", "Cloudy", "Rain", "Snow", "Fog"]
TRIP = ["trip_id", "pickup_datetime", "dropoff_datetime", "distance_miles", "fare_amount", "passenger_count", "borough"]


def _clock(hour: Column, minute: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.lit("2024-01-15 "), two(hour), F.lit(":"), two(minute), F.lit(":00"))


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))


def _trips(ids: DataFrame, prefix: str, start: int, end: int, spread: int, base: float, rate: float, fee: float, seats: int) -> DataFrame:
    i = F.col("idx")
    hour = (i % 24).cast("int")
    miles = (i % spread + 1).cast("double") + base
    return ids.select(
        F.concat(F.lit(prefix), i.cast("string")).alias("trip_id"),
        _clock(hour, (i + start) % 60).alias("pickup_datetime"),
        _clock((hour + 1) % 24, (i + end) % 60).alias("dropoff_datetime"),
        miles.alias("distance_miles"),
        (miles * rate + fee).alias("fare_amount"),
        (i % seats + 1).cast("int").alias("passenger_count"),
        _pick(BOROUGHS, i).alias("borough"),
    )


def taxi_rows(ids: DataFrame) -> DataFrame:
    """A taxi trip per ``idx`` (Z8); ``spark.range(n).toDF("idx")`` gives the ids."""
    return _trips(ids, "taxi_", 0, 15, 15, 0.5, 2.5, 2.5, 4)


def ride_rows(ids: DataFrame) -> DataFrame:
    return _trips(ids, "ride_", 30, 40, 12, 0.3, 2.0, 3.0, 3)


def weather_rows(ids: DataFrame) -> DataFrame:
    i = F.col("idx")
    return ids.select(
        i.cast("int").alias("hour_of_day"),
        (i % 30 + 25).cast("double").alias("temperature_f"),
        (i % 50 + 30).cast("double").alias("humidity_pct"),
        (i % 20 + 2).cast("double").alias("wind_speed_mph"),
        F.when(i % 5 == 0, 0.3).otherwise(0.0).alias("precipitation_in"),
        _pick(CONDITIONS, i).alias("condition"),
    )


def bronze(raw: DataFrame, source: str) -> DataFrame:
    """Trips with a fare and a distance, marked with where they came from."""
    return raw.filter((F.col("fare_amount") > 0) & (F.col("distance_miles") > 0)).withColumn("source", F.lit(source))


def bronze_weather(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("temperature_f").isNotNull())


def all_trips(taxi: DataFrame, ride: DataFrame) -> DataFrame:
    """Both feeds with duration, fare per mile and hour."""
    cols = [*TRIP, "source"]
    minutes = (F.unix_timestamp("dropoff_datetime") - F.unix_timestamp("pickup_datetime")) / 60
    t = taxi.select(*cols).unionByName(ride.select(*cols))
    return t.withColumns({"trip_duration_min": minutes, "fare_per_mile": F.col("fare_amount") / F.col("distance_miles"), "hour_of_day": F.hour("pickup_datetime")})


def trip_weather(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """Trips with the weather of their hour, where there is any."""
    w = weather.withColumnRenamed("hour_of_day", "weather_hour")
    return trips.join(w, F.col("hour_of_day") == F.col("weather_hour"), "left").drop("weather_hour")


def gold_borough(trips: DataFrame) -> DataFrame:
    """Trips, money and people per borough."""
    return trips.groupBy("borough").agg(
        F.count("*").alias("trip_count"), F.sum("fare_amount").alias("total_revenue"), F.avg("fare_amount").alias("avg_fare"),
        F.avg("distance_miles").alias("avg_distance"), F.avg("trip_duration_min").alias("avg_duration_min"), F.sum("passenger_count").alias("total_passengers"),
    )


def gold_hourly(trips: DataFrame) -> DataFrame:
    """Demand per hour and feed."""
    return trips.groupBy("hour_of_day", "source").agg(
        F.count("*").alias("trip_count"), F.avg("fare_amount").alias("avg_fare"), F.avg("trip_duration_min").alias("avg_duration")
    )


def quick_pipeline(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bronze, silver) of the smoke test: clean and derive, then aggregate per category."""
    b = raw.filter("value > 0").select("id", F.upper("name").alias("name_upper"), (F.col("value") * 2).alias("value_doubled"), "category")
    s = b.groupBy("category").agg(F.count("*").alias("row_count"), F.sum("value_doubled").alias("total_value"), F.avg("value_doubled").alias("avg_value"))
    return b, s


def user_purchases(users: DataFrame, purchases: DataFrame) -> DataFrame:
    """Purchases with their user."""
    return users.join(purchases, "user_id")


def column_lineage_cases(users: DataFrame, purchases: DataFrame) -> dict[str, DataFrame]:
    """The column lineage scenarios: copy, join, mix, aggregate."""
    up = user_purchases(users, purchases)
    return {
        "users_copy": users,
        "user_purchases": up,
        "user_purchases_enhanced": up.withColumn("email_upper", F.upper("email")),
        "country_stats": up.groupBy("country").agg(F.count("*").alias("purchase_count"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount")),
    }


def evolution_snapshots(ids: DataFrame) -> DataFrame:
    """Five schema versions of one dataset per ``idx`` (Z5): two columns added, a type changed, one removed, one made required."""
    f = lambda n, t, null=True: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(null).alias("nullable"))
    v1 = [f("id", "int"), f("name", "string"), f("age", "int")]
    v2 = [*v1, f("email", "string"), f("city", "string")]
    v3 = [f("id", "int"), f("name", "string"), f("age", "string"), f("email", "string"), f("city", "string")]
    v4 = [v3[0], v3[1], v3[2], v3[4]]
    v5 = [f("id", "int", False), f("name", "string", False), v3[2], v3[4]]
    steps = F.array(*[F.array(*v) for v in (v1, v2, v3, v4, v5)])
    return ids.select(F.lit("o1").alias("org_id"), F.concat(F.lit("demo_customers_"), F.col("idx").cast("string")).alias("dataset"), F.posexplode(steps).alias("step", "fields")).select(
        "org_id", "dataset", F.timestamp_seconds(F.lit(1705276800) + F.col("step") * 3600).alias("captured_at"), "fields"
    )


def spike_metrics(ids: DataFrame) -> DataFrame:
    """Fifteen normal loads and one of 1000 rows per ``idx``."""
    n = F.when(F.col("step") == 15, F.lit(1000)).otherwise(F.lit(100) + (F.col("step") % 3) - 1)
    return ids.select("idx", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("step")).select(
        F.lit("o1").alias("org_id"), F.concat(F.lit("trips_"), F.col("idx").cast("string")).alias("dataset"), F.concat_ws("-", F.lit("run"), "idx", "step").alias("job_id"),
        F.lit("demo").alias("job_name"), F.lit(None).cast("string").alias("partition_key"),
        F.timestamp_seconds(F.lit(1705276800) + F.col("step") * 3600).alias("ts"), n.cast("bigint").alias("row_count"), (n * 10).cast("bigint").alias("byte_size"),
    )
