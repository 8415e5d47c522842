"""Attempts from the ``events`` test table.

An event's ``k`` names one of 96 exercises in a hierarchy of 24 activities, 8 objectives
and 4 modules; its type is the work mode and its value the duration.  As in real
tables, a fifth of the attempts reach an exercise in another activity than its own, some
outcomes are missing, and some attempts have no student, no place below the module, or
no place at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EXERCISES = 96


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event as an exercise attempt, with both attempt ordinals.

    Both windows cluster by user, so they share one shuffle.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k")  # a column of its own, so that each row is parsed once
    e = F.col("event_id")
    x = k % EXERCISES
    place = F.when(e % 5 == 3, (x + 4) % EXERCISES).otherwise(x)
    module = F.when(e % 118 != 7, (F.floor(place / 24) + 1).cast("string"))
    below = e % 59 != 7
    objective, activity = F.when(below, F.floor(place / 12).cast("string")), F.when(below, F.floor(place / 4).cast("string"))
    mode = F.when(F.col("event_type").isin("view", "click"), "zpdes").when(F.col("event_type") == "purchase", "playlist").when(F.col("event_type") == "signup", "adaptive-test").otherwise("initial-test")
    rows = events.select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.to_date("ts").alias("date_utc"),
        F.when(e % 97 != 11, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user_id"),
        F.when(F.col("user_id") % 10 != 9, F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string"))).alias("classroom_id"),
        F.when(mode == "playlist", F.concat(F.lit("p"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("m"), module)).alias("playlist_or_module_id"),
        F.concat(F.lit("m"), module).alias("module_id"),
        F.concat(F.lit("M"), module).alias("module_code"),
        F.concat(F.lit("Module "), module).alias("module_label"),
        F.concat(F.lit("o"), objective).alias("objective_id"),
        F.concat(F.lit("Objective "), objective).alias("objective_label"),
        F.concat(F.lit("a"), activity).alias("activity_id"),
        F.concat(F.lit("Activity "), activity).alias("activity_label"),
        F.concat(F.lit("e"), x.cast("string")).alias("exercise_id"),
        F.when(e % 13 != 4, F.col("value") < 50).alias("data_correct"),
        F.col("value").alias("data_duration"),
        F.when(e % 7 != 0, F.col("value") * 3).alias("session_duration"),
        mode.alias("work_mode"),
    )
    order = ["created_at", "event_id"]
    rows = rows.withColumn("student_attempt_index", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    return rows.withColumn("attempt_number", F.row_number().over(Window.partitionBy("user_id", "exercise_id").orderBy(*order)))


#: The same view in DuckDB; queries continue it after the comma.
ATTEMPTS_SQL = """
WITH raw_events AS (
  SELECT event_id, ts, CASE WHEN event_id % 97 <> 11 THEN 'u' || user_id END AS user_id, user_id % 10 AS class, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), numbered_events AS (
  SELECT *, k % 96 AS x, CASE WHEN event_id % 5 = 3 THEN (k % 96 + 4) % 96 ELSE k % 96 END AS place FROM raw_events
), coded AS (
  SELECT *, CASE WHEN event_id % 118 <> 7 THEN place // 24 + 1 END AS m, CASE WHEN event_id % 59 <> 7 THEN place // 12 END AS o, CASE WHEN event_id % 59 <> 7 THEN place // 4 END AS a,
    CASE WHEN event_type IN ('view', 'click') THEN 'zpdes' WHEN event_type = 'purchase' THEN 'playlist'
         WHEN event_type = 'signup' THEN 'adaptive-test' ELSE 'initial-test' END AS work_mode
  FROM numbered_events
), attempts AS (
  SELECT event_id, ts AS created_at, CAST(ts AS DATE) AS date_utc, user_id,
    CASE WHEN class <> 9 THEN 'c' || class END AS classroom_id,
    CASE WHEN work_mode = 'playlist' THEN 'p' || (k % 5) ELSE 'm' || m END AS playlist_or_module_id,
    'm' || m AS module_id, 'M' || m AS module_code, 'Module ' || m AS module_label,
    'o' || o AS objective_id, 'Objective ' || o AS objective_label,
    'a' || a AS activity_id, 'Activity ' || a AS activity_label, 'e' || x AS exercise_id,
    CASE WHEN event_id % 13 <> 4 THEN value < 50 END AS data_correct, value AS data_duration,
    CASE WHEN event_id % 7 <> 0 THEN value * 3 END AS session_duration, work_mode,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS student_attempt_index,
    row_number() OVER (PARTITION BY user_id, x ORDER BY ts, event_id) AS attempt_number
  FROM coded
)"""
