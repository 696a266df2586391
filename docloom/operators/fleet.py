"""Vehicles, reservations and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V


def available(vehicles: DataFrame, reservations: DataFrame, start: Column, end: Column, search: str | None = None, exclude: str | None = None, n: int | None = 100, limit_first: bool = False) -> DataFrame:
    """Vehicles in service that fit the search and that no open reservation overlaps (intervals are half-open), by plate, n at most. limit_first takes the n before the reserved ones go, so that fewer may be left.

    vehicles: name, plate, make, model, status; reservations: name, vehicle, start, end, status.
    """
    fits = ~F.col("status").isin(V.OUT_OF_SERVICE)
    if search:
        fits &= F.col("plate").contains(search) | F.col("make").contains(search) | F.col("model").contains(search)
    open_ones = reservations.where(~F.col("status").isin(V.CLOSED_RESERVATIONS) & (F.col("start") < end) & (F.col("end") > start) & ((F.col("name") != exclude) if exclude else F.lit(True)))
    taken = open_ones.select(F.col("vehicle").alias("name")).distinct()
    found = vehicles.where(fits)
    if limit_first and n:
        return found.orderBy("plate").limit(n).join(taken, "name", "left_anti").orderBy("plate")
    free = found.join(taken, "name", "left_anti").orderBy("plate")
    return free.limit(n) if n else free


def overlaps(requests: DataFrame, reservations: DataFrame, keys: list[str], bucket_s: int = 86_400) -> DataFrame:
    """R2 for a table of requests: (request, reservation, and the keys) of the pairs that agree in the keys and whose half-open intervals overlap.

    Intervals are cut into buckets of time; those that share one meet by an equi-join, and a pair counts only in the first
    bucket that both have, so that it comes once without a distinct. A bucket should be about as long as most
    intervals are. Empty intervals, and those without a start or end, overlap with nothing. requests: request, start, end, keys; reservations:
    reservation, start, end, keys.
    """
    number = lambda c: F.floor(F.unix_micros(c) / (bucket_s * 1_000_000))

    def cut(df: DataFrame, name: str, side: str) -> DataFrame:
        start, end = F.col("start").cast("timestamp"), F.col("end").cast("timestamp")
        some = df.where(start < end).select(name, *keys, start.alias(f"_s{side}"), end.alias(f"_e{side}"), number(start).alias(f"_b{side}"), F.floor((F.unix_micros(end) - 1) / (bucket_s * 1_000_000)).alias("_last"))
        return some.withColumn("_bucket", F.explode(F.sequence(F.col(f"_b{side}"), F.col("_last")))).drop("_last")

    both = cut(requests, "request", "q").join(cut(reservations, "reservation", "r"), [*keys, "_bucket"])
    return both.where((F.col("_sq") < F.col("_er")) & (F.col("_sr") < F.col("_eq")) & (F.col("_bucket") == F.greatest("_bq", "_br"))).select("request", "reservation", *keys)


def available_for(requests: DataFrame, vehicles: DataFrame, reservations: DataFrame, keys: list[str], bucket_s: int = 86_400) -> DataFrame:
    """R1-R3 for a table of requests: (request, n_free, plate): how many vehicles in service that agree in the keys are free for it, and the first of them by plate.

    Vehicles of equal keys are numbered by plate. A request's taken vehicles are numbers too; the first number that lacks
    among them is that of the first free one, so that no request is paired with the vehicles that are free. Requests of equal
    keys and times are answered once.
    requests: request, start, end, keys; vehicles: name, plate, status, keys; reservations: name, vehicle, start, end, status.
    """
    fit = vehicles.where(~F.col("status").isin(V.OUT_OF_SERVICE))
    numbered = fit.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("plate", "name")) - 1).select(F.col("name").alias("vehicle"), "plate", *keys, "_n")
    still_open = reservations.where(~F.col("status").isin(V.CLOSED_RESERVATIONS)).join(numbered.select("vehicle", *keys, "_n"), "vehicle").select(F.col("_n").alias("reservation"), "start", "end", *keys)
    # requests of equal keys and times have one answer
    asked = requests.withColumn("_ask", F.struct(*keys, "start", "end"))
    asks = asked.select("_ask").distinct().select(F.col("_ask").alias("request"), "_ask.*")
    taken = overlaps(asks, still_open, keys, bucket_s).select("request", F.col("reservation").alias("_n")).distinct()
    # taken numbers that are as small as their place have none free before them
    placed = taken.withColumn("_place", F.row_number().over(Window.partitionBy("request").orderBy("_n")) - 1)
    per = placed.groupBy("request").agg(F.count("*").alias("_taken"), F.count_if(F.col("_n") == F.col("_place")).alias("_first"))
    size = numbered.groupBy(*keys).agg(F.count("*").alias("_size"))
    counted = asks.join(size, keys, "left").join(per, "request", "left").select("request", *keys, (F.coalesce("_size", F.lit(0)) - F.coalesce("_taken", F.lit(0))).alias("n_free"), F.coalesce("_first", F.lit(0)).cast("int").alias("_n"))
    free = counted.join(numbered.select(*keys, "_n", "plate"), [*keys, "_n"], "left").select(F.col("request").alias("_ask"), "n_free", "plate")
    return asked.select("request", "_ask").join(free, "_ask", "left").select("request", "n_free", "plate")


def status_after(events: DataFrame) -> DataFrame:
    """(vehicle, status): on duty after the last submitted reservation, free after a cancelled one. events: vehicle, at, kind."""
    last = events.where(F.col("kind").isin("submit", "cancel")).groupBy("vehicle").agg(F.max_by("kind", "at").alias("kind"))
    return last.select("vehicle", F.when(F.col("kind") == "submit", "En mission").otherwise("Disponible").alias("status"))
