"""Reconciled and configured dependency tables, drill-down findings, absorbed OLS and p-values, on literal fixtures."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studylens.functions import columns as X
from studylens.operators import catalog, evidence, matrix, topology as T

from .test_operators import one

NODE = "module_code string, node_code string, node_id string, node_type string, label string, objective_code string, activity_index int, init_open boolean, source_primary string, source_enrichment string, is_ghost boolean"


def test_stored_nodes_meet_the_catalog(spark):
    ours = [("M1", "M1O1", "o1", "objective", "One", "M1O1", None, False, "catalog", "rules", False), ("M1", "M1O1A1", "a1", "activity", "First", "M1O1", 1, False, "catalog", "rules", False), ("M1", "M1O2", "o2", "objective", "Two", "M1O2", None, False, "catalog", "rules", False), ("M2", "M2O1", "p1", "objective", "Far", "M2O1", None, False, "catalog", "rules", False)]
    stored = [("M1", " M1O1 ", "o1 ", "objective", "One", "M1O1", 9, True, "rules", " ", None), ("M1", "M1O1A1", "a1", "activity", "Former", "M1O1", 1, None, "", "hand", True), ("M1", "M1O9", None, "objective", "Lost", "M1O9", None, True, "rules", None, True), ("M1", " ", "x", "objective", "No code", None, None, True, "rules", None, False)]
    rows = T.reconcile_nodes(spark.createDataFrame(ours, NODE), spark.createDataFrame(stored, NODE))
    got = {r.node_code: r for r in rows.collect()}
    assert {c: r.status for c, r in got.items()} == {"M1O1": "confirmed", "M1O1A1": "corrected", "M1O2": "added", "M1O9": "kept", "M2O1": "added"}
    assert (got["M1O1"].init_open, got["M1O1"].is_ghost, got["M1O1"].source_primary, got["M1O1"].source_enrichment, got["M1O1"].activity_index) == (True, False, "rules", "rules", None)
    assert (got["M1O1A1"].label, got["M1O1A1"].init_open, got["M1O1A1"].is_ghost, got["M1O1A1"].source_primary, got["M1O1A1"].source_enrichment) == ("First", False, True, "catalog", "hand")
    assert (got["M1O9"].label, got["M1O9"].init_open, got["M1O9"].is_ghost) == ("Lost", True, True)
    report = {r.module_code: r for r in T.reconcile_report(rows).collect()}
    assert (report["M1"].nodes, report["M1"].added, report["M1"].corrected, report["M1"].confirmed, report["M1"]["kept"], report["M1"].ghosts) == (4, 1, 1, 1, 1, 2)
    assert T.reconcile_nodes(spark.createDataFrame([], NODE), spark.createDataFrame([], NODE)).count() == 0


FLAT = "module_id string, module_code string, objective_id string, objective_code string, objective_label string, activity_id string, activity_code string, activity_label string, objective_order int, activity_order int"


def flat_catalog(spark):
    rows = [("m1", "M1", f"o{o}", f"M1O{o}", f"O{o}", f"o{o}a{a}", f"M1O{o}A{a}", None, o, a) for o in (1, 2, 3) for a in (1, 2, 3)]
    return spark.createDataFrame(rows + [("m2", "M2", "q", "M2O1", "Q", "qa", "M2O1A1", None, 1, 1)], FLAT)


def test_catalog_nodes(spark):
    got = {r.node_code: r for r in T.catalog_nodes(flat_catalog(spark)).collect()}
    assert len(got) == 14 and got["M1O2A3"].activity_index == 3 and got["M1O2A3"].label == "M1O2A3" and got["M1O2"].label == "O2" and got["M1O2"].node_id == "o2"


CONFIG = {
    "config": {
        "ai": {
            "moduleConfig": {
                "m1": {
                    "m1": {
                        "subgroups": [["o3", "gone", "o1", "o2"]],
                        "init_ssb": [[0, 2]],
                        "requirements": [{"o1": {"o3": {"sr": [0.5], "lvl": [1]}, "o2": {"lvl": [7]}}, "o2": {"gone": {"sr": [0.1], "lvl": [0]}, "o3": {"sr": [0.25], "lvl": []}}}],
                    },
                    "o1": {"subgroups": [["gone"]], "init_ssb": [1], "requirements": [{"o1a2": {"o1": {"sr": [0.75], "lvl": [0]}, "o3": {"sr": [0.9], "lvl": [1]}}, "lost": {"o1": {"lvl": [0]}}}]},
                    "o3": {"subgroups": [["o3a3", "o3a1"]], "init_ssb": [[0]], "requirements": []},
                    "o2": {"requirements": [{"o2a1": {"nowhere": {"lvl": [0], "sr": [0.2]}}}]},
                }
            }
        }
    }
}


def test_configured_requirements_by_position(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(CONFIG))
    entries = T.config_entries(spark, str(path))
    read = {r.entry_id: r for r in entries.collect()}
    assert list(read["m1"].subgroup) == ["o3", "gone", "o1", "o2"] and list(read["m1"].initial) == [0, 2] and list(read["o1"].initial) == [1]
    nodes = {r.node_code: (r.position, r.init_open) for r in T.configured_nodes(entries, flat_catalog(spark)).collect()}
    assert nodes == {
        "M1O3": (0, True), "M1O1": (1, False), "M1O2": (2, True),
        "M1O3A3": (0, True), "M1O3A1": (1, False),  # as listed; the second activity is not listed
        "M1O1A1": (0, False), "M1O1A2": (1, False), "M1O1A3": (2, False),  # nothing known is listed: own order; the objective is closed
        "M1O2A1": (0, False), "M1O2A2": (1, False), "M1O2A3": (2, False),
    }
    edges = {(r.from_node_code, r.to_node_code): (r.threshold_type, r.threshold_value, r.enrich_lvl, r.rule_text.split(".")[1]) for r in T.configured_edges(entries, flat_catalog(spark)).collect()}
    assert edges == {
        ("M1O3A1", "M1O1"): ("success_rate", 0.5, 1, "requirements"),  # second in configured order
        ("M1O2", "M1O1"): ("unknown", None, 7, "requirements"),  # no such level
        ("M1O3", "M1O2"): ("success_rate", 0.25, None, "requirements"),  # no level
        ("M1O1A1", "M1O1A2"): ("success_rate", 0.75, 0, "objective_requirements"),
        ("M1O3A1", "M1O1A2"): ("success_rate", 0.9, 1, "objective_requirements"),
    }


def test_of_equal_edges_the_first_stays(spark):
    schema = "module_id string, entry_id string, subgroup array<string>, initial array<int>, requirements array<struct<target:string,source:string,level:int,sr:double>>"
    rows = [("m1", "m1", None, None, [("o2", "o1", 9, 0.1), ("o2", "o1", 8, 0.2)]), ("m1", "o1", None, None, [("o2a1", "o1", 9, 0.3), ("o2a1", "o1", 8, 0.4)]), ("m1", "o2", None, None, [("o2a1", "o1", 7, 0.5)])]
    edges = {(r.from_node_code, r.to_node_code): r.threshold_value for r in T.configured_edges(spark.createDataFrame(rows, schema), flat_catalog(spark)).collect()}
    assert edges[("M1O1", "M1O2A1")] == 0.3 and edges[("M1O1", "M1O2")] in (0.1, 0.2) and len(edges) == 2


DRILL = "module_code string, objective_id string, activity_id string, exercise_id string, attempts long, metric_value double"


def test_drilldown_findings(spark):
    rows = [("M1", "o", "a", "e1", 40, 0.9), ("M1", "o", "a", "e2", 20, 0.5), ("M1", "o", "a", "e3", 30, 0.5), ("M1", "o", "a", "e4", 9, 0.0), ("M1", "o", "a", "e5", 50, None), ("M1", "o", "b", "e6", 30, 0.4), ("M1", "o", "b", "e7", 3, 0.4)]
    df = spark.createDataFrame(rows, DRILL)
    r = one(matrix.drilldown_findings(df, "success_rate"))
    # order: value falling, then attempts falling, so the last of the equal ones is e2
    assert (r.activity_id, r.exercises, r.highest_exercise, r.lowest_exercise, r.finding, r.ranking) == ("a", 3, "e1", "e2", "uneven", "e3>e2>e1")
    pooled = 46 / 60
    z = (36 / 40 - 10 / 20) / math.sqrt(pooled * (1 - pooled) * (1 / 40 + 1 / 20))
    assert r.z == pytest.approx(z) and r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)
    r = one(matrix.drilldown_findings(df, "repeat_attempt_rate"))
    assert r.ranking == "e1>e3>e2" and r.z is None and r.p_value is None
    r = one(matrix.drilldown_findings(df.filter("exercise_id <> 'e5'"), "attempts"))
    assert (r.highest_exercise, r.lowest_exercise, r.spread, r.finding) == ("e1", "e2", 20.0, "uneven")
    r = one(matrix.drilldown_findings(spark.createDataFrame([("M1", "o", "a", "e1", 40, 1600.0), ("M1", "o", "a", "e2", 20, 1490.0)], DRILL), "activity_mean_exercise_elo"))
    assert (r.spread, r.finding) == (110.0, "even")


def test_p_values_equal_erfc(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.959964, 2.8, 2.83, 3.5, 5.0, 8.0, 12.0, 30.0, -2.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p in df.select("z", X.two_sided_p(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-11)


def plain_ols(rows, columns):
    """Dummy-variable OLS with cluster-robust covariance and the usual correction."""
    groups, clusters = sorted({r[-2] for r in rows}, key=str), sorted({r[-1] for r in rows}, key=str)
    x = np.array([[*r[1 : 1 + columns], *[float(r[-2] == g) for g in groups]] for r in rows])
    y = np.array([r[0] for r in rows])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    scores = np.array([(x * e[:, None])[[i for i, r in enumerate(rows) if r[-1] == c]].sum(axis=0) for c in clusters])
    n, k, g = len(y), x.shape[1], len(clusters)
    return beta, inverse @ scores.T @ scores @ inverse * (g / (g - 1) * (n - 1) / (n - k)), groups


def test_absorbed_ols_equals_dummies(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        g, c = rng.choice(["a", "b", "c", None]), rng.choice([f"k{j}" for j in range(9)] + [None])
        x1, x2 = rng.gauss(1000, 1), float(rng.random() < 0.4)
        rows.append((0.5 * x1 - 2 * x2 + len(str(g)) + rng.gauss(0, 1) * (1 + x2), x1, x2, g, c))
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, "a", "k1"), (1.0, None, 1.0, "a", "k1")], "y double, x1 double, x2 double, g string, c string")
    beta, cov, _ = plain_ols([(y, x1 - 1000, x2, g, c) for y, x1, x2, g, c in rows], 2)
    got = {r.term: r for r in evidence.clustered_ols(df, "y", ["x1", "x2"], "g", "c").collect()}
    for i, name in enumerate(("x1", "x2")):
        assert got[name].estimate == pytest.approx(beta[i], rel=1e-8) and got[name].std_error == pytest.approx(math.sqrt(cov[i, i]), rel=1e-8)
    assert (got["x1"].n, got["x1"].clusters) == (400, 10)


def test_adjusted_means_equal_dummies(spark):
    rng = random.Random(5)
    rows = [(float(rng.random() < 0.3 + 0.2 * (m == "zpdes")) + "abc".index(g), m, g, c) for m, g, c in ((rng.choice(["zpdes", "playlist"]), rng.choice("abc"), f"k{rng.randrange(8)}") for _ in range(300))]
    df = spark.createDataFrame(rows + [(9.0, "other", "a", "k1")], "y double, mode string, g string, c string")
    beta, cov, groups = plain_ols([(y, float(m == "zpdes"), g, c) for y, m, g, c in rows], 1)
    r = one(evidence.adjusted_means(df, "y", "mode", ("zpdes", "playlist"), "g", "c"))
    share = [sum(g == x for *_, g, _ in rows) / len(rows) for x in groups]
    for name, mode in (("first", 1.0), ("second", 0.0)):
        c = np.array([mode, *share])
        assert r[f"{name}_mean"] == pytest.approx(c @ beta, rel=1e-9) and r[f"{name}_error"] == pytest.approx(math.sqrt(c @ cov @ c), rel=1e-8)
    assert r.estimate == pytest.approx(beta[0]) and r.std_error == pytest.approx(math.sqrt(cov[0, 0])) and r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))
    assert evidence.adjusted_means(df.filter("mode = 'zpdes'"), "y", "mode", ("zpdes", "playlist"), "g", "c").count() == 0


def test_resolution_of_raw_contexts(spark):
    flat = flat_catalog(spark).selectExpr("*", "concat('e', activity_id) as exercise_id", "'Module' as module_label")
    codes = spark.createDataFrame([("g1", "M1O2A1"), ("g2", "M1O3"), ("g3", "M9"), ("g4", None)], "id string, code string")
    raw = [("m1", None, None, None), ("g3", "g2", None, "eo1a1"), (None, "o1", "None", None), (None, "zz", "g1", None), (" null ", None, None, "eo2a2"), (None, None, None, None), ("g4", None, "g1", "eo1a1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "event_id int, playlist_or_module_id string, objective_id string, activity_id string, exercise_id string")
    out = catalog.resolve(df, flat, codes)
    got = {r.event_id: r for r in out.collect()}
    place = lambda i: (got[i].module_code, got[i].objective_id, got[i].activity_id, *[got[i][c][:2] for c in catalog.SOURCES])
    assert place(0) == ("M1", None, None, "di", "mi", "mi")
    assert place(1) == (None, "g2", "o1a1", "mi", "ra", "ex")  # the playlist's code comes first and is unknown
    assert place(2) == (None, "o1", None, "mi", "di", "mi")
    assert place(3) == ("M1", "zz", "g1", "co", "ra", "ra")
    assert place(4) == ("M1", "o2", "o2a2", "ex", "ex", "ex")
    assert place(5) == (None, None, None, "mi", "mi", "mi")
    assert place(6) == ("M1", "o2", "g1", "co", "co", "ra")
