"""Ranked evidence: facts with value, support and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import two_sided_p
from ..functions.lineage import kept
from ..functions.rank import rank_by_range



def _order(*columns):
    return Window.partitionBy(F.lit(0)).orderBy(*columns)


def bottleneck_evidence(scored: DataFrame, id_: str = "activity_id") -> DataFrame:
    """RNK-2: impact = score x attempts, main driver, rank and the share of the top three."""
    impact = F.col("bottleneck_score") * F.col("attempts")
    gap = F.col("failure_rate") - F.col("retry_before_success_rate")
    rows = scored.select(id_, "attempts", "bottleneck_score", impact.alias("impact"), F.when(gap > 0.1, "failure").when(gap < -0.1, "retry").otherwise("mixed").alias("driver"))
    rows = rows.withColumn("rank", F.row_number().over(_order(F.desc(F.round("impact", 6)), id_)))
    total = rows.agg(F.sum("impact").alias("_all"), F.sum(F.when(F.col("rank") <= 3, F.col("impact")).otherwise(0.0)).alias("_top"))
    return rows.join(F.broadcast(total)).withColumn("top_3_share", F.col("_top") / F.col("_all")).drop("_all", "_top")


def transition_evidence(edges: DataFrame) -> DataFrame:
    """RNK-3: destination success, fragility = n (1 - success), and the weakest against the rest."""
    rows = edges.groupBy("from_activity_id", "to_activity_id").agg(F.sum("transition_count").alias("n"), F.sum("destination_successes").alias("s"))
    rows = rows.withColumns({"destination_success": F.col("s") / F.col("n"), "fragility": F.col("n") - F.col("s")})
    rows = rows.withColumn("rank", F.row_number().over(_order(F.desc("fragility"), "from_activity_id", "to_activity_id")))
    total = rows.agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    rest = (F.col("_s") - F.col("s")) / (F.col("_n") - F.col("n"))
    return rows.join(F.broadcast(total)).withColumn("gap_to_rest", F.col("destination_success") - rest).drop("_n", "_s")


def work_mode_evidence(summary: DataFrame) -> DataFrame:
    """RNK-4: share of every mode, and weighted against exercise-balanced success."""
    total = summary.agg(F.sum("attempts").alias("_all"))
    return summary.join(F.broadcast(total)).select("work_mode", (F.col("attempts") / F.col("_all")).alias("attempt_share"), (F.col("success_rate") - F.col("balanced_success_rate")).alias("balance_gap"), F.row_number().over(_order(F.desc("attempts"), "work_mode")).alias("rank"))


def mean_test(rows: DataFrame, group: str, value: str) -> DataFrame:
    """RNK-1: z of each group's mean against 0 with a two-sided p-value."""
    out = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    z = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return out.withColumn("z", z).withColumn("p_value", two_sided_p(F.col("z")))


def module_usage_by_mode(attempts: DataFrame, n: int = 10) -> DataFrame:
    """MOD-5: mean attempts per student by module and mode with standard error and 95 % interval."""
    per = attempts.groupBy("module_code", "work_mode", "user_id").agg(F.count("*").alias("k"))
    out = per.groupBy("module_code", "work_mode").agg(F.count("*").alias("students"), F.avg("k").alias("mean"), F.stddev_samp("k").alias("sd"))
    se = F.col("sd") / F.sqrt("students")
    out = out.withColumns({"se": se, "low": F.col("mean") - 1.96 * se, "high": F.col("mean") + 1.96 * se})
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("work_mode").orderBy(F.desc("students"), "module_code"))).filter(F.col("rank") <= n)


def population_split(attempts: DataFrame, modes: tuple[str, str] = ("zpdes", "playlist"), least: int = 1) -> DataFrame:
    """MOD-3: students of both modes or of one, with at least ``least`` exercises per mode."""
    per = attempts.filter(F.col("work_mode").isin(*modes)).groupBy("user_id", "work_mode").agg(F.count_distinct("exercise_id").alias("exercises")).filter(F.col("exercises") >= least)
    return per.groupBy("user_id").agg(F.when(F.count("*") == 2, "both_modes").otherwise("exclusive_modes").alias("population"), F.sum("exercises").alias("exercises"))


def single_module_playlists(attempts: DataFrame) -> DataFrame:
    """MOD-2: attempts of playlists that stay within one module; other modes stay."""
    single = attempts.filter("work_mode = 'playlist'").groupBy("playlist_or_module_id").agg(F.count_distinct("module_code").alias("m")).filter("m = 1").select("playlist_or_module_id")
    return attempts.filter("work_mode <> 'playlist'").unionByName(attempts.filter("work_mode = 'playlist'").join(single, "playlist_or_module_id", "left_semi").select(*attempts.columns))


def design(rows: DataFrame, modes: tuple[str, str] = ("zpdes", "playlist")) -> DataFrame:
    """MOD-8: intercept, mode, position, interaction, and nested group codes."""
    zpdes = (F.col("work_mode") == modes[0]).cast("double")
    out = kept(rows.filter(F.col("work_mode").isin(*modes)).select("user_id", "classroom_id", "module_code", F.lit(1.0).alias("intercept"), zpdes.alias("zpdes"), F.col("position").cast("double").alias("position"), (zpdes * F.col("position")).alias("interaction"), (F.col("data_correct").cast("double")).alias("y")))
    for name, keys in (("student_code", ["user_id"]), ("classroom_code", ["classroom_id", "user_id"])):
        ids = rank_by_range(out.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct(), *[F.asc(f"_{k}") for k in keys], name=name)
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(ids, same).drop(*[f"_{k}" for k in keys])
    return out


def probability_curve(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """MOD-9: probability of success by mode and position from fitted coefficients.

    ``rows`` has work_mode and position; ``estimates`` (term, estimate) must have the terms
    intercept, zpdes, position and interaction, else the job fails.
    """
    terms = ("intercept", "zpdes", "position", "interaction")
    one = estimates.agg(*[F.max(F.when(F.col("term") == t, F.col("estimate"))).alias(f"_{t}") for t in terms])
    one = one.select(*[F.coalesce(f"_{t}", F.raise_error(F.lit(f"no coefficient {t}")).cast("double")).alias(f"_{t}") for t in terms])
    zpdes, at = (F.col("work_mode") == "zpdes").cast("double"), F.col("position").cast("double")
    x = F.col("_intercept") + F.col("_zpdes") * zpdes + F.col("_position") * at + F.col("_interaction") * zpdes * at
    out = rows.select("work_mode", "position").distinct().join(F.broadcast(one)).withColumn("linear_predictor", x)
    return out.select("work_mode", "position", (F.col("position") + 1).alias("attempt_number"), "linear_predictor", (1 / (1 + F.exp(-F.col("linear_predictor")))).alias("predicted_probability"))


class _Absorbed:
    """OLS with absorbed fixed effects from one table of cells (cluster x effect).

    A cell holds counts, means and co-moments of its rows: the only pass over the rows.
    Group means, cross products within groups and cluster scores are sums over cells.
    The driver sees one row of k x k sums and solves for k coefficients.
    """

    def __init__(self, rows: DataFrame, y: str, numeric: list[str], effect: str, cluster: str):
        import numpy as np

        self.x = numeric
        names = [*numeric, y]
        rows = rows.select(F.col(effect).alias("g"), F.col(cluster).alias("c"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(names)]).dropna(subset=[f"v{i}" for i in range(len(names))])
        k = len(numeric)
        self.pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]  # the last is y
        means = [F.avg(f"v{i}").alias(f"m{i}") for i in range(k + 1)]
        moments = [F.covar_pop(f"v{i}", f"v{j}").alias(f"s{i}_{j}") for i, j in self.pairs]
        cells = kept(rows.groupBy("g", "c").agg(F.count("*").alias("n"), *means, *moments))
        total = lambda i: (F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n"))
        groups = cells.groupBy(F.col("g").alias("_g")).agg(*[total(i).alias(f"g{i}") for i in range(k + 1)])
        joined = cells.join(groups, F.col("g").eqNullSafe(F.col("_g")))
        apart = {i: F.col(f"m{i}") - F.col(f"g{i}") for i in range(k + 1)}
        within = [(F.col("n") * (F.col(f"s{i}_{j}") + apart[i] * apart[j])).alias(f"w{i}_{j}") for i, j in self.pairs]
        self.cells = kept(joined.select("g", "c", "n", *[(F.col("n") * apart[i]).alias(f"d{i}") for i in range(k + 1)], *within))
        one = self.cells.agg(F.sum("n").alias("n"), F.count_distinct("c").alias("clusters"), F.max(F.col("c").isNull().cast("int")).alias("c0"), F.count_distinct("g").alias("groups"), F.max(F.col("g").isNull().cast("int")).alias("g0"), *[F.sum(f"w{i}_{j}").alias(f"w{i}_{j}") for i, j in self.pairs]).first()
        overall = cells.agg(*[total(i).alias(f"m{i}") for i in range(k + 1)]).first()
        self.n, self.clusters, self.groups = int(one.n or 0), int(one.clusters + (one.c0 or 0)), int(one.groups + (one.g0 or 0))
        self.means = np.array([overall[f"m{i}"] or 0.0 for i in range(k + 1)])
        xx, xy = np.zeros((k, k)), np.zeros(k)
        for i, j in self.pairs:
            v = one[f"w{i}_{j}"] or 0.0
            if j == k:
                xy[i] = v
            else:
                xx[i, j] = xx[j, i] = v
        self.inverse = np.linalg.pinv(xx)
        self.beta = self.inverse @ xy

    def _scores(self) -> DataFrame:
        """Per cluster: the sum of residuals (u) and of centred regressor times residual (s0, s1, ...)."""
        k = len(self.x)
        slope = [F.lit(float(b)) for b in self.beta]
        w = lambda i, j: F.col(f"w{min(i, j)}_{max(i, j)}")
        u = F.col(f"d{k}") - sum((slope[i] * F.col(f"d{i}") for i in range(k)), F.lit(0.0))
        score = [w(i, k) - sum((slope[j] * w(i, j) for j in range(k)), F.lit(0.0)) for i in range(k)]
        return self.cells.select("c", u.alias("u"), *[e.alias(f"s{i}") for i, e in enumerate(score)]).groupBy("c").agg(F.sum("u").alias("u"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])

    def variances(self, directions) -> list[float]:
        """Cluster-robust variance of estimates that move by a0 * mean residual + a1 . score for each (a0, a1)."""
        parts = []
        for share, by in directions:
            moved = F.lit(share) * F.col("u") + sum((F.lit(float(b)) * F.col(f"s{i}") for i, b in enumerate(by)), F.lit(0.0))
            parts.append(F.sum(moved * moved))
        found = self._scores().agg(F.lit(1), *parts).first()[1:]
        scale = self.clusters / max(1, self.clusters - 1) * (self.n - 1) / max(1, self.n - len(self.x) - self.groups)
        return [max(0.0, v or 0.0) * scale for v in found]


def clustered_ols(rows: DataFrame, y: str, numeric: list[str], effect: str, cluster: str) -> DataFrame:
    """MOD-7: OLS with fixed effects of one column and cluster-robust errors: term, estimate, std_error, n, clusters.

    Errors have the usual small-sample factor, clusters / (clusters - 1) times
    (n - 1) / (n - parameters), effects counting as parameters.  Rows with an unknown
    number take no part; an unknown effect or cluster is one of its own.
    """
    fit = _Absorbed(rows, y, numeric, effect, cluster)
    errors = fit.variances([(0.0, fit.inverse[i]) for i in range(len(numeric))])
    out = [(name, float(b), float(v**0.5), fit.n, fit.clusters) for name, b, v in zip(numeric, fit.beta, errors)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, n long, clusters long")


def adjusted_means(rows: DataFrame, y: str, mode: str, modes: tuple[str, str], effect: str, cluster: str) -> DataFrame:
    """MOD-7: mean outcome of both modes as if each met the groups in their overall shares, and their difference.

    One row: estimate of the first mode against the second with error, z, two-sided p and
    95 % bounds, and both adjusted means with their errors.  Without both modes or with
    fewer than two clusters there is no row.
    """
    first = (F.col(mode) == modes[0]).cast("double")
    used = rows.filter(F.col(mode).isin(*modes)).withColumn("_first", first)
    fit = _Absorbed(used, y, ["_first"], effect, cluster)
    share, mean = (float(v) for v in fit.means)
    schema = "estimate double, std_error double, first_mean double, first_error double, second_mean double, second_error double, n long, clusters long, groups long"
    if fit.clusters < 2 or not 0 < share < 1:
        out = []
    else:
        b, inverse = float(fit.beta[0]), float(fit.inverse[0, 0])
        at = [(1.0 / fit.n, [(x - share) * inverse]) for x in (1.0, 0.0)]
        v = fit.variances([(0.0, [inverse]), *at])
        out = [(b, v[0] ** 0.5, mean + b * (1 - share), v[1] ** 0.5, mean - b * share, v[2] ** 0.5, fit.n, fit.clusters, fit.groups)]
    df = rows.sparkSession.createDataFrame(out, schema)
    z = F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error"))
    low, high = (F.col("estimate") + s * F.lit(1.959963984540054) * F.col("std_error") for s in (-1, 1))
    return df.withColumns({"z": z, "p_value": two_sided_p(z), "ci_low": low, "ci_high": high})
