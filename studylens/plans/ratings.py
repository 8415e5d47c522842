"""Queries of the rating models."""

from __future__ import annotations

from ..functions.lineage import kept
from ..operators import ratings as R, slices as S
from ..sources.attempts_view import attempts
from .concentration import START_SQL, p_sql, same_item
from .daily import rounded
from .registry import register


def _start(spark, sf_dir, by_module=True):
    return R.smoothed_start(R.calibration_rows(attempts(spark, sf_dir)), by_module)


def _current(spark, sf_dir):
    """Calibrated ratings; only queries whose SQL says so read the smoothed start."""
    return R.joint_ratings(R.calibration_rows(attempts(spark, sf_dir)))


@register("elo_smoothed_start", START_SQL + " SELECT module_code, objective_id, activity_id, exercise_id, calibration_attempts, round(calibration_success_rate, 6) AS calibration_success_rate, round(smoothed_rate, 6) AS smoothed_rate, round(rating, 6) AS rating FROM items")
def elo_smoothed_start(spark, sf_dir):
    return rounded(_start(spark, sf_dir))


#: Start ratings over all modules, continuing START_SQL.
GLOBAL_SQL = """, global_counts AS (SELECT exercise_id, sum(n) AS n, sum(s) AS s FROM item_counts GROUP BY 1),
global_rates AS (SELECT exercise_id, greatest(0.01::DOUBLE, least(0.99::DOUBLE, (s + 20 * (sum(s) OVER () / CAST(sum(n) OVER () AS DOUBLE))) / CAST(n + 20 AS DOUBLE))) AS q FROM global_counts),
global_raw AS (SELECT exercise_id, 1500 - 400 * log10(q / (1 - q)) AS raw FROM global_rates),
global_items AS (SELECT exercise_id, raw - avg(raw) OVER () + 1500 AS rating FROM global_raw)"""


def replay_sql(by_module: bool) -> str:
    start = START_SQL.replace("WITH raw_events", "WITH RECURSIVE raw_events", 1)
    group, items = ("user_id, module_code", "") if by_module else ("user_id", GLOBAL_SQL)
    source, on = ("items", same_item("c", "i")) if by_module else ("global_items", "c.exercise_id = i.exercise_id")
    return (
        start
        + items
        + f""", seq AS (
  SELECT c.event_id, c.user_id, c.module_code, c.objective_id, c.exercise_id, c.activity_id, c.created_at, CAST(c.success AS DOUBLE) AS y, rating AS item_rating,
    row_number() OVER (PARTITION BY {", ".join("c." + g for g in group.split(", "))} ORDER BY created_at, c.exercise_id, attempt_number, event_id) AS ord
  FROM ctx c JOIN {source} i ON {on} WHERE c.success IS NOT NULL AND c.user_id IS NOT NULL AND c.module_code IS NOT NULL
), replay AS (
  SELECT *, 1500.0::DOUBLE AS pre, 1500.0::DOUBLE + 24 * (y - 1 / (1 + pow(10.0::DOUBLE, (item_rating - 1500.0::DOUBLE) / 400))) AS post FROM seq WHERE ord = 1
  UNION ALL
  SELECT s.*, r.post AS pre, r.post + 24 * (s.y - 1 / (1 + pow(10.0::DOUBLE, (s.item_rating - r.post) / 400))) AS post
  FROM replay r JOIN seq s ON s.ord = r.ord + 1 AND {" AND ".join(f"s.{g} = r.{g}" for g in group.split(", "))}
)"""
    )


_EVENT_SQL = " SELECT event_id, user_id, module_code, exercise_id, CAST(ord AS INTEGER) AS attempt_ordinal, round(item_rating, 6) AS item_rating, round(pre, 6) AS pre, round(post, 6) AS post FROM replay"
_EVENT_COLUMNS = ["event_id", "user_id", "module_code", "exercise_id", "attempt_ordinal", "item_rating", "pre", "post"]


def _events(spark, sf_dir, by_module=True):
    return R.sequential_replay(R.replay_rows(attempts(spark, sf_dir)), _start(spark, sf_dir, by_module), by_module)


@register("elo_sequential_replay", replay_sql(True) + _EVENT_SQL)
def elo_sequential_replay(spark, sf_dir):
    return rounded(_events(spark, sf_dir).select(*_EVENT_COLUMNS))


@register("elo_global_replay", replay_sql(False) + _EVENT_SQL)
def elo_global_replay(spark, sf_dir):
    return rounded(_events(spark, sf_dir, False).select(*_EVENT_COLUMNS))


@register(
    "elo_profiles",
    replay_sql(True)
    + """ SELECT user_id, module_code, count(*) AS attempts, min(created_at) AS first_attempt_at, max(created_at) AS last_attempt_at, count(DISTINCT exercise_id) AS unique_exercises,
  count(DISTINCT activity_id) AS unique_activities, round(arg_max(post, ord), 6) AS final_rating FROM replay GROUP BY user_id, module_code""",
)
def elo_profiles(spark, sf_dir):
    return rounded(R.profiles(_events(spark, sf_dir)))


@register("elo_final_ratings", replay_sql(True) + " SELECT user_id, module_code, CAST(count(*) AS INTEGER) AS attempts, round(arg_max(post, ord), 6) AS final_rating FROM replay GROUP BY user_id, module_code")
def elo_final_ratings(spark, sf_dir):
    return rounded(R.final_ratings(R.replay_rows(attempts(spark, sf_dir)), _start(spark, sf_dir)))


@register("elo_convergence", replay_sql(True) + " SELECT user_id, module_code, count(*) AS attempts, round(max(CASE WHEN ord = 30 THEN post END), 6) AS rating FROM replay GROUP BY user_id, module_code")
def elo_convergence(spark, sf_dir):
    return rounded(R.rating_at(_events(spark, sf_dir), 30))


@register("elo_replay_series", replay_sql(True) + ", marked AS (SELECT *, max(ord) OVER (PARTITION BY user_id, module_code) AS last_ord FROM replay) SELECT user_id, module_code, CAST(ord AS INTEGER) AS cutoff, round(post, 6) AS rating FROM marked WHERE ord % 10 = 0 OR ord = last_ord")
def elo_replay_series(spark, sf_dir):
    return rounded(R.replay_series(_events(spark, sf_dir)))


@register("elo_student_sample", replay_sql(True) + " SELECT user_id, count(*) AS attempts, round(sum(post - pre), 6) AS net_change, round(stddev_samp(post - pre), 6) AS volatility, round(min(post - pre), 6) AS worst_drop FROM replay GROUP BY user_id")
def elo_student_sample(spark, sf_dir):
    return rounded(R.student_sample(_events(spark, sf_dir)))


BASE_SQL = """, item_base AS (SELECT DISTINCT module_code, objective_id, activity_id, exercise_id FROM ctx WHERE exercise_id IS NOT NULL)"""


@register("activity_elo", START_SQL + BASE_SQL + f" SELECT x.module_code, x.objective_id, x.activity_id, round(avg(rating), 6) AS mean_rating, count(rating) AS calibrated_exercises, count(*) AS exercises, round(CAST(count(rating) AS DOUBLE) / count(*), 6) AS coverage FROM item_base x LEFT JOIN items i ON {same_item('x', 'i')} GROUP BY x.module_code, x.objective_id, x.activity_id")
def activity_elo(spark, sf_dir):
    return rounded(R.activity_ratings(R.item_base(attempts(spark, sf_dir)), _start(spark, sf_dir)))


@register(
    "elo_movement",
    replay_sql(True)
    + """, moved AS (
  SELECT activity_id, count(*) AS event_count, count(DISTINCT user_id) AS unique_students, avg(post - pre) AS mean_delta, stddev_samp(post - pre) AS std_delta, avg(abs(post - pre)) AS mean_abs_delta,
    sum(CASE WHEN post < pre THEN post - pre ELSE 0 END) AS total_loss, min(post - pre) AS worst_delta FROM replay GROUP BY activity_id
) SELECT activity_id, event_count, unique_students, round(mean_delta, 6) AS mean_delta, round(std_delta, 6) AS std_delta, round(mean_abs_delta, 6) AS mean_abs_delta, round(total_loss, 6) AS total_loss, round(worst_delta, 6) AS worst_delta,
  round(mean_delta / (std_delta / sqrt(event_count)), 6) AS z, row_number() OVER (ORDER BY round(total_loss, 6), activity_id) AS impact_rank, row_number() OVER (ORDER BY round(mean_delta, 6), activity_id) AS severity_rank,
  row_number() OVER (ORDER BY round(mean_abs_delta, 6) DESC, activity_id) AS volatility_rank FROM moved""",
)
def elo_movement(spark, sf_dir):
    return rounded(R.movement(_events(spark, sf_dir)))


_MOVED = "count(*) AS event_count, avg(post - pre) AS mean_delta, stddev_samp(post - pre) AS std_delta, avg(abs(post - pre)) AS mean_abs_delta, coalesce(sum(CASE WHEN post < pre THEN pre - post END), 0) AS loss"


@register("elo_movement_regions", replay_sql(True) + f", moved AS (SELECT module_code, objective_id, count(DISTINCT user_id) AS unique_students, {_MOVED} FROM replay GROUP BY ALL) SELECT module_code, objective_id, event_count, unique_students, round(mean_delta, 6) AS mean_delta, round(mean_abs_delta, 6) AS mean_abs_delta, round(loss, 6) AS total_negative_loss FROM moved")
def elo_movement_regions(spark, sf_dir):
    return rounded(R.movement_regions(_events(spark, sf_dir)))


def _leading(kind: str, source: str, value: str, order: str, condition: str = "true") -> str:
    return f"""SELECT '{kind}' AS finding, row_number() OVER (ORDER BY {order}, event_count DESC, module_code NULLS FIRST, objective_id NULLS FIRST, activity_id NULLS FIRST) AS rank, module_code, objective_id, activity_id, event_count, round({value}, 6) AS value, p_value
FROM {source} WHERE {condition} OR NOT EXISTS (SELECT 1 FROM {source} WHERE {condition}) QUALIFY rank <= 5"""


@register(
    "elo_movement_findings",
    replay_sql(True)
    + f""", places AS (SELECT module_code, objective_id, activity_id, {_MOVED} FROM replay GROUP BY ALL HAVING count(*) >= 20),
tested AS (SELECT *, CASE WHEN std_delta > 0 THEN mean_delta / (std_delta / sqrt(event_count)) END AS z FROM places),
probable AS (SELECT *, round({p_sql("z")}, 6) AS p_value FROM tested),
regions AS (SELECT module_code, objective_id, CAST(NULL AS VARCHAR) AS activity_id, {_MOVED}, CAST(NULL AS DOUBLE) AS p_value FROM replay GROUP BY ALL HAVING count(*) >= 20) """
    + " UNION ALL ".join(
        f"({q})"
        for q in (
            _leading("impact", "probable", "loss", "round(loss, 6) DESC", "loss > 0"),
            _leading("severity", "probable", "mean_delta", "round(mean_delta, 6)", "mean_delta < 0"),
            _leading("volatility", "probable", "mean_abs_delta", "round(mean_abs_delta, 6) DESC"),
            _leading("region", "regions", "loss", "round(loss, 6) DESC"),
        )
    ),
)
def elo_movement_findings(spark, sf_dir):
    return rounded(R.movement_findings(_events(spark, sf_dir)))


@register("exercise_elo_module")
def exercise_elo_module(spark, sf_dir):
    return R.joint_ratings(R.calibration_rows(attempts(spark, sf_dir)))


@register("exercise_elo_iterative")
def exercise_elo_iterative(spark, sf_dir):
    return R.iterative_ratings(R.replay_rows(attempts(spark, sf_dir)))


@register("elo_batch_replay")
def elo_batch_replay(spark, sf_dir):
    return R.batch_replay(R.replay_rows(attempts(spark, sf_dir)), _current(spark, sf_dir))


@register("adaptive_block_elo")
def adaptive_block_elo(spark, sf_dir):
    return R.block_ratings(attempts(spark, sf_dir), _current(spark, sf_dir))


@register(
    "elo_system_comparison",
    START_SQL
    + GLOBAL_SQL
    + """ SELECT count(*) AS exercises, round(corr(i.rating, g.rating), 6) AS correlation, round(median(abs(i.rating - g.rating)), 6) AS median_abs_shift, round(avg(g.rating - i.rating), 6) AS mean_shift
FROM items i JOIN global_items g USING (exercise_id)""",
)
def elo_system_comparison(spark, sf_dir):
    local = _start(spark, sf_dir).select(*R.CONTEXT, "rating")
    return rounded(R.compare_systems(local, _start(spark, sf_dir, False).select("exercise_id", "rating")))


@register("elo_aligned_systems")
def elo_aligned_systems(spark, sf_dir):
    rows, items = R.replay_rows(attempts(spark, sf_dir)), _current(spark, sf_dir)
    return R.aligned(R.sequential_replay(rows, items), R.batch_replay(rows, items))


def _shifts(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return R.exercise_shifts(_current(spark, sf_dir), R.iterative_ratings(R.replay_rows(rows)), R.calibration_rows(rows))


@register("elo_exercise_shifts")
def elo_exercise_shifts(spark, sf_dir):
    return _shifts(spark, sf_dir)


@register("elo_calibrated_comparison")
def elo_calibrated_comparison(spark, sf_dir):
    return R.shift_summary(_shifts(spark, sf_dir))


@register("elo_student_gaps")
def elo_student_gaps(spark, sf_dir):
    rows, shifts = R.replay_rows(attempts(spark, sf_dir)), kept(_shifts(spark, sf_dir))
    rated = [R.sequential_replay(rows, shifts.select(*R.CONTEXT, shifts[c].alias("rating"))) for c in ("current_elo", "iterative_elo")]
    return R.student_gaps(R.aligned(*rated))


@register("exercise_elo_calibrated")
def exercise_elo_calibrated(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return S.rating_table(R.item_base(rows).select(*R.CONTEXT), _current(spark, sf_dir), R.calibration_rows(rows))
