"""Readers and adapters that bring raw sources into the common attempt layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import code_of, outcome, real_csv, real_id, real_text
from ..operators.catalog import derive_catalog, load_catalog

# fixed columns of the researcher file, in file order
REQUIRED = (
    "classroom_id teacher_id user_id playlist_or_module_id objective_id activity_id exercise_id module_long_title created_at login_time "
    "is_initial_test data_correct work_mode student_attempt_index attempt_number data_duration session_duration data_answer data_score data_test_context variation"
).split()
OPTIONAL = ("module_id", "progression_score", "initial_test_score", "finished_module_score", "is_gar", "first_attempt_success_rate")
HEAD, TAIL = 17, 3
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """SRC-1: Parquet with projection and an optional row limit."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return df if rows is None else df.limit(rows)


def check_header(header: list[str]) -> None:
    """Raises for missing or unexpected columns."""
    missing, unexpected = set(REQUIRED) - set(header), set(header) - set(REQUIRED) - set(OPTIONAL)
    if missing or unexpected:
        raise ValueError(f"missing columns {sorted(missing)}, unexpected columns {sorted(unexpected)}")


def _quoted_split(line: Column) -> Column:
    """Fields of a line, cut at commas that an even number of quotes follows.

    Pieces between quotes are told by their place from the end, so a line is passed a fixed
    number of times; only lines that hold the mark itself look ahead from every comma.
    """
    mark = "\u0001"
    pieces = F.split(line, '"', -1)
    marked = F.array_join(F.transform(pieces, lambda x, i: F.when((F.size(pieces) - i) % 2 == 1, F.translate(x, ",", mark)).otherwise(x)), '"')
    looked = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.when(~F.contains(line, F.lit('"')), F.split(line, ",", -1)).when(~F.contains(line, F.lit(mark)), F.split(marked, mark, -1)).otherwise(looked)


def researcher_rows(lines: DataFrame, header: list[str]) -> DataFrame:
    """SRC-4: text lines (``value``) to string columns, with ``row_state`` ok, repaired or skipped.

    A trailing semicolon goes.  Commas inside quotes belong to a field.  A line with more
    fields than columns is repaired if the file has exactly the required columns: the
    first 17 and last 3 fields are taken by commas and the middle is the answer.
    """
    check_header(header)
    n = len(header)
    unquoted = lambda x: F.when(F.contains(x, F.lit('"')), F.regexp_replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), '""', '"')).otherwise(x)
    plain = F.col("plain")
    middle = F.array_join(F.slice(plain, HEAD + 1, F.size(plain) - HEAD - TAIL), ",")
    fixed = F.concat(F.slice(plain, 1, HEAD), F.array(middle), F.slice(plain, F.size(plain) - TAIL + 1, F.lit(TAIL)))
    whole, repairable = F.size("quoted") == n, (F.size(plain) > n) & F.lit(n == HEAD + TAIL + 1)
    # each step is a column of its own, so that a line is cut once
    rows = lines.filter(F.trim("value") != "").select(F.regexp_replace("value", r";+\s*$", "").alias("line")).select("line", _quoted_split(F.col("line")).alias("quoted"))
    rows = rows.select("quoted", F.when(~whole, F.split(F.regexp_replace("line", r'^"|"$', ""), ",", -1)).alias("plain"))
    rows = rows.select(
        F.when(whole, F.transform("quoted", unquoted)).when(repairable, fixed).alias("f"),
        F.when(whole, "ok").when(repairable, "repaired").otherwise("skipped").alias("row_state"),
    )
    return rows.select("row_state", *[real_csv(F.col("f")[i]).alias(c) for i, c in enumerate(header)])


def typed_researcher_rows(rows: DataFrame) -> DataFrame:
    """SRC-4: typed columns of usable rows; ``work_mode`` falls back to the test context."""
    text = lambda c: F.col(c)
    out = rows.filter("row_state <> 'skipped'")
    casts: dict[str, Column] = {
        "created_at": F.try_to_timestamp("created_at").cast("timestamp_ntz"),
        "login_time": F.try_to_timestamp("login_time").cast("timestamp_ntz"),
        "data_correct": outcome(text("data_correct")) > 0,
        "student_attempt_index": text("student_attempt_index").try_cast("int"),
        "attempt_number": text("attempt_number").try_cast("int"),
        "data_duration": text("data_duration").try_cast("double"),
        "session_duration": text("session_duration").try_cast("double"),
        "work_mode": F.coalesce("work_mode", "data_test_context"),
    }
    return out.withColumns({k: v for k, v in casts.items() if k in rows.columns})


def ingest_counts(rows: DataFrame) -> DataFrame:
    """SRC-4: how many lines were read as they are, repaired and skipped."""
    return rows.groupBy("row_state").agg(F.count("*").alias("rows"))


def with_ordinals(attempts: DataFrame) -> DataFrame:
    """SRC-10: running attempt numbers per exercise and per student.

    Attempts at one time go by exercise, then by a hash of the whole row, so that the
    numbers do not depend on the order of reading; only equal rows are interchangeable.
    """
    last = F.xxhash64(*sorted(c for c in attempts.columns if c not in ("student_attempt_index", "attempt_number")))
    per_user = Window.partitionBy("user_id").orderBy("created_at", "exercise_id", last)
    per_exercise = Window.partitionBy("user_id", "exercise_id").orderBy("created_at", last)
    return attempts.withColumn("student_attempt_index", F.row_number().over(per_user)).withColumn("attempt_number", F.row_number().over(per_exercise))


def config_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: semicolon rows of modules, objectives and activities with lists of UUIDs."""
    rows = spark.read.option("header", True).option("sep", ";").csv(path)
    lists = [c for c in rows.columns if c.endswith("_ids") or c == "learning_items"]
    return rows.filter(F.lower(F.trim("type")).isin("module", "objective", "activity")).withColumns({c: F.regexp_extract_all(F.col(c), F.lit(f"({_UUID})"), F.lit(1)) for c in lists} | {"type": F.lower(F.trim("type"))})


def config_parents(rows: DataFrame) -> DataFrame:
    """SRC-6: (id, type, code) with the parent found by code prefix: M1O2A3 -> M1O2 -> M1."""
    parent = F.when(F.col("type") == "activity", code_of(F.col("code"), "objective")).when(F.col("type") == "objective", code_of(F.col("code"), "module"))
    up = rows.select(F.col("code").alias("_code"), F.col("id").alias("parent_id"))
    return rows.withColumn("parent_code", parent).join(up, F.col("parent_code") == F.col("_code"), "left").drop("_code")


def extend_activities(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC-8: exercises seen in an activity that the catalog has, but without them."""
    seen = attempts.filter("activity_id is not null and exercise_id is not null").select("activity_id", "exercise_id").distinct()
    places = catalog.select("module_id", "module_code", "objective_id", "activity_id").distinct()
    return seen.join(catalog.select("activity_id", "exercise_id").distinct(), ["activity_id", "exercise_id"], "left_anti").join(places, "activity_id")


def orphans(attempts: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC-9: activities of attempts that a module's configuration lacks, with attempts."""
    return attempts.filter("activity_id is not null").join(catalog.select("activity_id").distinct(), "activity_id", "left_anti").groupBy("activity_id").agg(F.count("*").alias("attempts"))


_OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "between": lambda c, v: c.between(*v), "in": lambda c, v: c.isin(*v) if v else F.lit(False)}


def filtered(df: DataFrame, columns: list[str], filters: list[tuple[str, str, object]] = (), order: list[tuple[str, bool]] = ()) -> DataFrame:
    """SRC-12: projection, conjunction of filters and order (column, descending).

    Only columns of ``df`` and the listed operators are accepted; an empty ``in`` gives no
    rows but all columns.  On a stored table filters and columns reach the Parquet scan.
    """
    for c in [*columns, *(f[0] for f in filters), *(o[0] for o in order)]:
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    for c, op, value in filters:
        if op not in _OPS:
            raise ValueError(f"unknown operator {op!r}")
        df = df.filter(_OPS[op](F.col(c), value))
    if order:
        df = df.orderBy(*[F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_first() for c, d in order])
    return df.select(*columns)


def standardise(rows: DataFrame, mapping: dict[str, str], source: str) -> DataFrame:
    """MOD-1: attempts under common names; students qualified by source; outcomes from words.

    ``mapping`` is common name -> column of ``rows``; common names without a column are NULL.
    """
    word = F.lower(F.trim(F.col(mapping["success"]).cast("string")))
    correct = F.when(word.isin("vrai", "true"), 1).when(word.isin("faux", "false"), 0).otherwise(outcome(F.col(mapping["success"])).cast("int"))
    names = ("student_id", "classroom_id", "module", "work_mode", "exercise_id", "activity_id", "created_at")
    pick = {n: F.col(mapping[n]) if n in mapping else F.lit(None).cast("string") for n in names}
    pick["student_id"] = F.concat(F.lit(f"{source}:"), real_text(pick["student_id"].cast("string")))
    return rows.select(*[c.alias(n) for n, c in pick.items()], correct.alias("success"), F.lit(source).alias("source"))


def ingest(spark: SparkSession, profile: str, **paths: str) -> tuple[DataFrame, DataFrame]:
    """SRC-11: (attempts, catalog hierarchy) of a source profile.

    ``main``: Parquet attempts and a catalog file.  ``derived``: Parquet attempts whose
    catalog is derived.  ``researcher``: text lines with a header, catalog derived.
    ``multi_module``: such lines and a JSON configuration, completed by the attempts.
    ``module_config``: such lines and one module's CSV configuration.
    """
    from ..operators.catalog import hierarchy
    from . import adapters

    if profile == "main":
        return scan(spark, paths["attempts"]), hierarchy(load_catalog(spark, paths["catalog"]))
    if profile == "derived":
        rows = scan(spark, paths["attempts"])
    elif profile in ("researcher", "multi_module", "module_config"):
        lines = spark.read.text(paths["attempts"])
        names = F.transform(F.split(F.regexp_replace("value", r"[;\s]+$", ""), ","), F.trim)
        found = lines.filter(F.size(F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), names)) == 0).first()
        check_header([] if found is None else [h.strip() for h in found[0].rstrip("; \r").split(",")])
        head = found[0]  # every file of a folder repeats it
        rows = typed_researcher_rows(researcher_rows(lines.filter(F.col("value") != head), [h.strip() for h in head.rstrip("; \r").split(",")]))
        rows = with_ordinals(rows.withColumns({c: real_id(F.col(c)) for c in ("module_id", "objective_id", "activity_id", "exercise_id") if c in rows.columns}))
        if profile == "multi_module":
            base = adapters.config_hierarchy(adapters.config_json(spark, paths["config"]))
            rows = rows.withColumn("module_code", code_of(F.col("playlist_or_module_id"), "module"))
            codes = base.select(F.col("module_id").alias("playlist_or_module_id"), F.col("module_code").alias("_code")).distinct()
            rows = rows.join(codes, "playlist_or_module_id", "left").withColumn("module_code", F.coalesce("_code", "module_code")).drop("_code")
            full = adapters.extended_catalog(rows, base)
            return adapters.completed(rows, full), full
        if profile == "module_config":
            config = config_csv(spark, paths["config"])
            label = F.coalesce(real_text(F.col("short_title")), real_text(F.col("long_title")), F.col("code"))
            return adapters.one_module(rows, config.select("id", "type", "code", label.alias("label"), F.col("learning_items").alias("exercise_ids")))
    else:
        raise ValueError(f"unknown profile {profile!r}")
    for level in ("module_code", "module_label", "module_id", "objective_label", "activity_label"):
        if level not in rows.columns:
            base = {"module_code": "playlist_or_module_id", "module_id": "playlist_or_module_id", "module_label": "module_long_title"}.get(level, level.replace("_label", "_id"))
            rows = rows.withColumn(level, F.col(base))
    return rows, derive_catalog(rows)
