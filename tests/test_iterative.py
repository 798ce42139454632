"""Conjugate gradients (CGLS): the smallest-norm least-squares solution without a Gram matrix, past MAX_TERMS."""

import os

import numpy as np
import pandas as pd
import pytest

from fleetledger.models import iterative
from fleetledger.models.design import build_design
from fleetledger.models.iterative import ols_cg
from fleetledger.models.regress import MAX_TERMS, ols
from fleetledger.session import scratch_path, written_once


def _coefs(fit):
    return {r["term"]: r["coef"] for r in fit.coefs.collect()}


def test_agrees_with_the_minimum_norm_solution(spark):
    rng = np.random.default_rng(3)
    n = 500
    data = pd.DataFrame({"gas": rng.choice(["a", "b", "c", None], n), "kind": rng.choice(["x", "y"], n), "rate": rng.normal(3, 1, n)})
    data["cost"] = 5 + 2 * data["rate"] + (data["gas"] == "a") * 3 + rng.normal(0, 1, n)
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), "gas string, kind string, rate double, cost double")
    design = build_design(frame.repartition(4), ["gas", "kind"], ["rate"], "cost")
    x = pd.get_dummies(data[["gas", "kind"]]).astype(float)
    x["rate"], x["const"] = data["rate"], 1.0
    beta = np.linalg.pinv(x.to_numpy()) @ data["cost"].to_numpy()
    fit = ols_cg(design)
    got = _coefs(fit)
    assert list(got) == list(x.columns)
    assert [got[c] for c in x.columns] == pytest.approx(beta, rel=1e-6, abs=1e-8)
    assert got == pytest.approx(_coefs(ols(design)), rel=1e-6, abs=1e-8)
    residual = data["cost"].to_numpy() - x.to_numpy() @ beta
    assert fit.r2 == pytest.approx(1 - residual @ residual / ((data["cost"] - data["cost"].mean()) ** 2).sum(), rel=1e-9)
    assert fit.n == n and fit.rank is None
    assert all(r["std_err"] is None and r["t"] is None for r in fit.coefs.collect())


def test_fits_ten_times_max_terms_levels(spark):
    levels = 10 * MAX_TERMS
    rng = np.random.default_rng(4)
    shop = np.concatenate([np.arange(levels), rng.integers(0, levels, 2 * levels)])
    y = rng.normal(0, 1, len(shop)) + shop % 7
    frame = spark.createDataFrame(pd.DataFrame({"shop": [f"s{i:05d}" for i in shop], "y": y})).repartition(8)
    design = build_design(frame, ["shop"], [], "y")
    got = _coefs(ols_cg(design, tol=1e-12))
    # One factor and a constant: fitted values are the level means m; the smallest norm gives const = sum(m) / (levels + 1).
    means = pd.Series(y).groupby(shop).mean()
    const = means.sum() / (levels + 1)
    assert len(got) == levels + 1 and got["const"] == pytest.approx(const, rel=1e-8)
    want = {f"shop_s{i:05d}": m - const for i, m in means.items()}
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-8)


def test_odd_designs(spark):
    empty = build_design(spark.createDataFrame([], "g string, y double"), ["g"], [], "y")
    with pytest.raises(ValueError, match="no rows"):
        ols_cg(empty)
    only_null = build_design(spark.createDataFrame([(None, 1.0), (None, 3.0)], "g string, y double"), ["g"], [], "y")
    assert _coefs(ols_cg(only_null)) == pytest.approx({"const": 2.0})
    with pytest.raises(ValueError, match="2 terms, more than 1"):
        ols_cg(build_design(spark.createDataFrame([("a", 1.0)], "g string, y double"), ["g"], [], "y"), max_vector=1)


def test_passes_read_merged_rows_of_term_numbers(spark, monkeypatch):
    written = {}

    def keep(df, name):
        written[name] = written_once(df, name)
        return written[name]

    monkeypatch.setattr(iterative, "written_once", keep)
    data = [(f"s{i % 40}" if i % 7 else None, float(i % 2), float(i % 11)) for i in range(4000)]
    design = build_design(spark.createDataFrame(data, "shop string, open double, y double"), ["shop"], ["open"], "y")
    fit = ols_cg(design)
    # 4,000 rows hold 280 rows of X at most; every pass reads these, without the level texts.
    rows = written["cgls-rows"]
    assert rows.count() == len({row[:2] for row in data}) and "string" not in dict(rows.dtypes).values()
    assert _coefs(fit) == pytest.approx(_coefs(ols(design)), rel=1e-6, abs=1e-8) and fit.n == 4000
    assert fit.r2 == pytest.approx(ols(design).r2, rel=1e-9)


def test_numbers_without_categories(spark):
    frame = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (2.0, 5.0), (4.0, 9.0)], "x double, y double")
    assert _coefs(ols_cg(build_design(frame, [], ["x"], "y"))) == pytest.approx({"x": 2.0, "const": 1.0})


def _by_tables(monkeypatch, spark, data, schema, cats, numbers, **options):
    """The fit with no vector over the terms on the driver, and the folders it left."""
    made = []

    def noted(session, name):
        made.append(scratch_path(session, name))
        return made[-1]

    monkeypatch.setattr(iterative, "DRIVER_TERMS", 0)
    monkeypatch.setattr(iterative, "scratch_path", noted)
    fit = ols_cg(build_design(spark.createDataFrame(data, schema).repartition(3), cats, numbers, "y"), **options)
    assert made and not any(os.path.exists(path) for path in made)
    return fit


def test_vectors_as_tables_agree_with_the_gram_matrix(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [
        (str(a) if a else None, str(b), str(b % 2), float(v), float(w), float(3 * a - b + 2 * v + e))
        for a, b, v, w, e in zip(rng.integers(0, 4, 400), rng.integers(0, 6, 400), rng.normal(3, 1, 400), rng.integers(0, 4, 400), rng.normal(0, 1, 400))
    ]
    schema = "g string, h string, half string, v double, w double, y double"
    # ``half`` follows from ``h``: the design lacks rank in more than the constant.
    for cats, numbers in ((["g", "h", "half"], ["v", "w"]), (["g"], ["v"])):
        want = ols(build_design(spark.createDataFrame(data, schema), cats, numbers, "y"))
        fit = _by_tables(monkeypatch, spark, data, schema, cats, numbers, tol=1e-12)
        assert _coefs(fit) == pytest.approx(_coefs(want), rel=1e-6, abs=1e-7)
        assert fit.coefs.count() == want.coefs.count() and fit.coefs.dtypes == want.coefs.dtypes
        assert fit.intercept == pytest.approx(want.intercept, rel=1e-6) and fit.r2 == pytest.approx(want.r2, rel=1e-9) and fit.n == 400
        assert all(r["std_err"] is None and r["t"] is None for r in fit.coefs.collect())


def test_vectors_as_tables_fit_many_levels(spark, monkeypatch):
    levels = 5 * MAX_TERMS
    rng = np.random.default_rng(6)
    shop = np.concatenate([np.arange(levels), rng.integers(0, levels, levels)])
    y = rng.normal(0, 1, len(shop)) + shop % 7
    fit = _by_tables(monkeypatch, spark, pd.DataFrame({"shop": [f"s{i}" for i in shop], "y": y}), "shop string, y double", ["shop"], [], tol=1e-12)
    means = pd.Series(y).groupby(shop).mean()
    const = means.sum() / (levels + 1)
    got = _coefs(fit)
    assert len(got) == levels + 1 and got["const"] == pytest.approx(const, rel=1e-8)
    assert [got[f"shop_s{i}"] for i in means.index] == pytest.approx(list(means - const), abs=1e-8)


def test_odd_designs_by_tables(spark, monkeypatch):
    monkeypatch.setattr(iterative, "DRIVER_TERMS", 0)
    with pytest.raises(ValueError, match="no rows"):
        ols_cg(build_design(spark.createDataFrame([], "g string, y double"), ["g"], [], "y"))
    with pytest.raises(ArithmeticError, match="in 1 iterations"):
        data = [("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 7.0), ("c", 1.0), ("c", 4.0)]
        ols_cg(build_design(spark.createDataFrame(data, "g string, y double"), ["g"], [], "y"), max_iter=1)
    only_null = [(None, 1.0), (None, 3.0)]
    assert _coefs(_by_tables(monkeypatch, spark, only_null, "g string, y double", ["g"], [])) == pytest.approx({"const": 2.0})
    numbers = [(1.0, 3.0), (2.0, 5.0), (4.0, 9.0)]
    assert _coefs(ols_cg(build_design(spark.createDataFrame(numbers, "x double, y double"), [], ["x"], "y"))) == pytest.approx({"x": 2.0, "const": 1.0})
