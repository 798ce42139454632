import statistics

import numpy as np
import pandas as pd
import pytest
from helpers import as_set
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fleetledger.models.design import build_design, gram_stats, gram_stats_wide
from fleetledger.models.effects import lattice_effects, segment_effects, tag_terms
from fleetledger.models.regress import (
    collect_moments,
    ols,
    ols_wide,
    probit,
    ridge,
    ridge_wide,
    score_segments,
)
from fleetledger.operators.reshape import interaction_terms, one_hot


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 600
    frame = pd.DataFrame({
        "gas": rng.choice(["a", "b", "c", None], n, p=[0.5, 0.3, 0.1, 0.1]), "kind": rng.choice(["x", "y"], n),
        "hours": rng.normal(20000, 3000, n), "rate": rng.normal(3, 1, n),
    })
    frame["cost"] = 5 + frame["hours"] * 0.01 + (frame["gas"] == "a") * 30 + rng.normal(0, 4, n)
    return frame


def wide(data):
    x = pd.get_dummies(data[["gas", "kind"]]).astype(float)
    x["hours"], x["rate"], x["const"] = data["hours"], data["rate"], 1.0
    return x


def coefs(fit, column="coef"):
    return {r["term"]: r[column] for r in fit.coefs.collect()}


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), "gas string, kind string, hours double, rate double, cost double").repartition(5)


@pytest.fixture(scope="module")
def design(table):
    return build_design(table, ["gas", "kind"], ["hours", "rate"], "cost")


def test_gram_cells_equal_the_matrix_product(design, data):
    x = wide(data).assign(cost=data["cost"])
    want = x.T @ x
    cells = {(r["row_term"], r["col_term"]): r["value"] for r in gram_stats(design).collect()}
    for i, a in enumerate(sorted(x.columns)):
        for b in sorted(x.columns)[i:]:
            assert cells.get((a, b), 0.0) == pytest.approx(want.loc[a, b], rel=1e-12)


def test_wide_gram_equals_the_factor_gram(spark, design, data):
    x = wide(data).assign(cost=data["cost"])
    terms = [c for c in x.columns if c not in ("const", "cost")]
    frame = spark.createDataFrame(x[[*terms, "cost"]]).repartition(3)
    got = {(r[0], r[1]): r[2] for r in gram_stats_wide(frame, terms, "cost").collect()}
    want = {(r[0], r[1]): r[2] for r in gram_stats(design).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want)
    assert coefs(ols_wide(frame, terms, "cost")) == pytest.approx(coefs(ols(design)), rel=1e-6, abs=1e-8)
    assert coefs(ridge_wide(frame, terms, "cost")) == pytest.approx(coefs(ridge(design)), rel=1e-8)


def test_ols_is_the_minimum_norm_solution(design, data):
    x, y = wide(data), data["cost"].to_numpy()
    inverse = np.linalg.pinv(x.to_numpy())
    beta = inverse @ y
    rank = np.linalg.matrix_rank(x.to_numpy())
    residual = y - x.to_numpy() @ beta
    std_err = np.sqrt(residual @ residual / (len(y) - rank) * np.diag(inverse @ inverse.T))
    fit = ols(design)
    assert fit.rank == rank < x.shape[1] and fit.n == len(y)
    assert coefs(fit) == pytest.approx(dict(zip(x.columns, beta)), rel=1e-6)
    assert coefs(fit, "std_err") == pytest.approx(dict(zip(x.columns, std_err)), rel=1e-6)
    assert coefs(fit, "t") == pytest.approx(dict(zip(x.columns, beta / std_err)), rel=1e-6)
    assert fit.r2 == pytest.approx(1 - residual @ residual / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert fit.intercept == pytest.approx(beta[-1], rel=1e-6)


def test_ridge_penalises_all_but_the_intercept(design, data):
    x, y = wide(data).drop(columns="const"), data["cost"].to_numpy()
    centred = x - x.mean()
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    fit = ridge(design)
    assert coefs(fit) == pytest.approx({**dict(zip(x.columns, w)), "const": y.mean() - w @ x.mean()}, rel=1e-7)
    left = y - y.mean() - centred.to_numpy() @ w
    assert fit.r2 == pytest.approx(1 - left @ left / ((y - y.mean()) ** 2).sum(), rel=1e-9)


def test_probit_of_one_factor_gives_the_quantiles_of_the_shares(spark):
    shares = {"a": 0.2, "b": 0.5, "c": 0.9}
    data = [(k, int(i < 10 * p)) for k, p in shares.items() for i in range(10)]
    fit = probit(build_design(spark.createDataFrame(data, "k string, y int"), ["k"], [], "y"))
    z = {k: statistics.NormalDist().inv_cdf(p) for k, p in shares.items()}
    want = {"const": z["a"], "k_b": z["b"] - z["a"], "k_c": z["c"] - z["a"]}
    assert coefs(fit) == pytest.approx(want, abs=1e-5)
    assert fit.n == 30


def test_probit_keeps_rows_with_a_null_category(spark):
    """Null is the base then, and every level has a term."""
    shares = {None: 0.4, "": 0.2, "b": 0.5}
    data = [(k, int(i < 10 * p)) for k, p in shares.items() for i in range(10)]
    fit = probit(build_design(spark.createDataFrame(data, "k string, y int"), ["k"], [], "y"))
    z = {k: statistics.NormalDist().inv_cdf(p) for k, p in shares.items()}
    assert fit.n == 30
    assert coefs(fit) == pytest.approx({"const": z[None], "k_": z[""] - z[None], "k_b": z["b"] - z[None]}, abs=1e-5)


@pytest.mark.parametrize("mean", [1e5, 1e7])
def test_fits_of_numbers_far_from_zero(spark, mean):
    rng = np.random.default_rng(3)
    x = mean + rng.normal(size=400)
    level = rng.integers(0, 2, 400)
    y = 3.0 * (x - mean) + level + 1e6 + rng.normal(0, 0.1, 400)
    frame = spark.createDataFrame([(f"l{k}", float(a), float(b)) for k, a, b in zip(level, x, y)], "k string, x double, y double")
    fit = ols(build_design(frame, ["k"], ["x"], "y"))
    near = np.column_stack([level == 0, level == 1, x - mean, np.ones(400)])
    solution, rest, rank, _ = np.linalg.lstsq(near, y, rcond=None)
    got = coefs(fit)
    assert got["x"] == pytest.approx(solution[2], rel=1e-6)
    assert got["k_l1"] - got["k_l0"] == pytest.approx(solution[1] - solution[0], rel=1e-6)
    residual = ((y - near @ solution) ** 2).sum()
    assert fit.r2 == pytest.approx(1 - residual / ((y - y.mean()) ** 2).sum(), abs=1e-9)
    # the smallest norm: the levels' coefficients add up to the constant
    assert got["k_l0"] + got["k_l1"] == pytest.approx(got["const"], rel=1e-6)
    soft = coefs(ridge(build_design(frame, [], ["x"], "y"), alpha=1.0))
    centred = x - x.mean()
    assert soft["x"] == pytest.approx(centred @ (y - y.mean()) / (centred @ centred + 1), rel=1e-6)


def test_scores_use_the_labels_of_the_design(spark):
    fit = ols(build_design(spark.createDataFrame([(2020.0, 1.0), (2021.0, 3.0)], "yr double, y double"), ["yr"], [], "y"))
    segments = spark.createDataFrame([(2020.0,), (2021.0,), (1999.0,)], "yr double")
    found = {r.yr: r.prediction for r in score_segments(fit.coefs, segments, ["yr"]).collect()}
    assert found == {2020.0: pytest.approx(1.0), 2021.0: pytest.approx(3.0), 1999.0: None}
    with pytest.raises(Exception, match="no term const"):
        score_segments(fit.coefs.where("term <> 'const'"), segments, ["yr"]).collect()


def test_missing_values_are_dropped_or_refused(rows):
    frame = rows([("a", 1.0, 2.0), ("b", None, 2.0), (None, 3.0, 1.0)], "k string, x double, y double")
    assert build_design(frame, ["k"], ["x"], "y").frame.count() == 2
    with pytest.raises(PySparkException):
        build_design(frame, ["k"], ["x"], "y", missing="raise").frame.collect()
    with pytest.raises(PySparkException):
        gram_stats_wide(frame, ["x"], "y").collect()


def test_refused_designs(rows):
    frame = rows([(str(i), i, 1.0) for i in range(9)], "k string, x int, y double")
    with pytest.raises(ValueError, match="more than 4 terms"):
        ols(build_design(frame, ["k"], ["x"], "y"), max_terms=4)
    clash = rows([("b_c", "c", 1.0), ("x", "y", 2.0)], "a string, a_b string, y double")
    with pytest.raises(ValueError, match="same term"):
        ols(build_design(clash, ["a", "a_b"], [], "y"))
    with pytest.raises(ValueError, match="no rows"):
        ols(build_design(frame.where("x < 0"), [], ["x"], "y"))


def test_constant_terms_of_zeros_get_no_weight(rows):
    frame = rows([(0.0, 1.0, 2.0), (0.0, 2.0, 4.0), (0.0, 3.0, 6.5)], "z double, x double, y double")
    assert coefs(ols_wide(frame, ["z", "x"], "y"))["z"] == 0.0
    moments = collect_moments(gram_stats_wide(frame, ["z", "x"], "y"), "y", ["z", "x"])
    assert moments.terms == ["z", "x", "const"] and moments.n == 3


def test_score_segments(rows):
    terms = rows([("const", 1.0), ("i_a", 2.0), ("r_b", 4.0), ("g_c", 8.0), ("g_d", 16.0)], "term string, coef double")
    segments = rows([("a", "b", "c"), ("a", "b", "d"), ("a", "b", "zz"), (None, "b", "c")], "i string, r string, g string")
    assert as_set(score_segments(terms, segments, ["i", "r", "g"])) == {
        ("a", "b", "c", 15.0), ("a", "b", "d", 23.0), ("a", "b", "zz", None), (None, "b", "c", None)}


def melted_effects(pdf, weights, dims):
    """The definition, on pandas: replace cells, melt, distinct, sum."""
    out = pdf.copy()
    for term, weight in weights.items():
        out[term] = np.where(out[term] != 0, weight, out[term])
    long = out.melt(id_vars=dims).drop_duplicates()
    return {(*k, v) for k, v in long.groupby(dims)["value"].sum().items()}


def test_segment_effects(spark, rows):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": rng.choice(["p", "q"], 40), "g": rng.choice(["m", "n"], 40), "i": rng.choice(["u", "v"], 40),
                        "size": rng.integers(0, 4, 40).astype(float)})
    t1, t2 = ("dummies_const" * 3 + x for x in "ab")
    pdf[t1], pdf[t2] = (pdf["s"] == "p") * 1.0, rng.choice([0.0, 1.0], 40)
    terms = [(t1, 2.5), (t2, -1.0), ("dummies_constother", 99.0)]
    got = as_set(segment_effects(spark.createDataFrame(pdf), rows(terms, "term string, coef double"), ["s", "g", "i"]))
    assert got == melted_effects(pdf, {t1: 2.5, t2: -1.0}, ["s", "g", "i"])
    only = pdf.drop(columns="size")
    got = as_set(segment_effects(spark.createDataFrame(only), rows(terms, "term string, coef double"), ["s", "g", "i"]))
    assert got == melted_effects(only, {t1: 2.5, t2: -1.0}, ["s", "g", "i"])
    with pytest.raises(ValueError):
        segment_effects(spark.createDataFrame(only.drop(columns=t1)), rows(terms, "term string, coef double"), ["s", "g", "i"])


def test_tags_are_the_first_value_in_sorted_order(rows):
    terms = rows([("x_north_gas", 1.0), ("northwest", 2.0), ("nothing", 3.0)], "term string, coef double")
    segments = rows([("northwest", "gas"), ("north", "x"), (None, None)], "r string, g string")
    got = tag_terms(terms, segments, ["r", "g"], {"g": "_"})
    assert as_set(got) == {("x_north_gas", 1.0, "north", "gas"), ("northwest", 2.0, "north", None), ("nothing", 3.0, None, None)}


def lattice_by_hand(terms, segments, dims, prefixes, flag, marker):
    """The definition, row by row."""
    from itertools import combinations, product

    tagged = []
    for term, coef in terms:
        if flag not in term or term == flag:
            continue
        tags = {}
        for k, d in enumerate(dims):
            known = sorted({s[k] for s in segments if s[k] is not None})
            tags[d] = next((v for v in known if prefixes.get(d, "") + v in term), None)
        if any(v is not None for v in tags.values()):
            tagged.append((term.count(marker), tags, coef))
    base = dict(terms)[flag]
    out = []
    for s in set(segments):
        own = dict(zip(dims, s))
        choices = []
        for size in range(1, len(dims) + 1):
            for subset in combinations(dims, size):
                hits = {c for order, tags, c in tagged if order == size and all(tags[d] == own[d] for d in subset)}
                choices.append(sorted(hits) or [None])
        for values in set(product(*choices)):
            out.append((*s, round(sum(v or 0.0 for v in values) + base, 6)))
    return sorted(out, key=repr)


def test_lattice_effects(rows):
    flag, m = "minimumoperatinghours", "dummies_const"
    terms = [
        (flag, 1.0), (f"{m}north_{flag}", 2.0), (f"{m}{flag}_bio", 4.0), (f"{m}bio{m}_north_{flag}", 8.0),
        (f"{m}_bio{m}_north_{flag}", 16.0), (f"{m}{m}{m}_bio_north_farm{flag}", 32.0), (f"{m}farm", 64.0),
        (f"{m}{flag}", 128.0), (f"{m}south_{flag}_x", 256.0), (f"{m}south_{flag}_y", 512.0),
    ]
    segments = [("north", "bio", "farm"), ("south", "bio", "farm"), ("north", "gas", "mill"), (None, "gas", "mill")]
    dims = ["r", "g", "i"]
    frame = rows([*segments, *segments], "r string, g string, i string")
    got = lattice_effects(rows(terms, "term string, coef double"), frame, dims, prefixes={"g": "_"})
    found = sorted(((*tuple(r)[:3], round(r["effect"], 6)) for r in got.collect()), key=repr)
    assert found == lattice_by_hand(terms, segments, dims, {"g": "_"}, flag, m)


def test_interactions_fit_as_a_wide_design(table, data):
    wide_rows = interaction_terms(one_hot(table.dropna(), ["gas", "kind"]), ["gas_", "kind_"])
    terms = [c for c in wide_rows.columns if c.startswith("dummies_const")]
    fit = ols_wide(wide_rows, terms, "cost")
    means = data.dropna().groupby(["gas", "kind"])["cost"].mean()
    got = coefs(fit)
    for (gas, kind), mean in means.items():
        assert got["const"] + got[f"dummies_constkind_{kind}_gas_{gas}"] == pytest.approx(mean, rel=1e-8)
    assert wide_rows.agg(F.sum(terms[0])).first()[0] > 0


def test_segment_effects_of_thousands_of_terms(spark):
    """The number of terms only makes a table longer."""
    n = 1500
    cells = [F.when(F.col("id") % n == i, 1).otherwise(0).alias(f"dummies_const{i}") for i in range(n)]
    base = spark.range(20).select(F.concat(F.lit("s"), F.col("id") % 4).alias("k"), *cells)
    coefs = spark.createDataFrame([(f"dummies_const{i}", float(i)) for i in range(n)], "term string, coef double")
    found = {r.k: r.value for r in segment_effects(base, coefs, ["k"], order=1).collect()}
    assert found == {f"s{k}": float(sum(range(k, 20, 4))) for k in range(4)}


def test_lattice_needs_its_base_term(spark):
    coefs = spark.createDataFrame([("dummies_constminimumoperatinghours_a", 1.0)], "term string, coef double")
    with pytest.raises(Exception, match="no coefficient of"):
        lattice_effects(coefs, spark.createDataFrame([("a",)], "k string"), ["k"]).collect()


def test_long_interactions_equal_the_wide_columns(spark, rows):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["p", "q", None], 60), "a_x": rng.choice([0, 1, 2], 60), "a_y": rng.choice([0, 1], 60),
                        "b_u": rng.choice([0.0, 1.0, 2.5], 60), "b_v": rng.choice([0, 3], 60), "c_w": rng.choice([0, 1], 60)})
    frame = spark.createDataFrame(pdf).withColumn("row", F.monotonically_increasing_id())
    wide = interaction_terms(frame, ["a_", "b_", "c_"])
    products = [c for c in wide.columns if c.startswith("dummies_const")]
    want = {(r.row, t, r[t]) for r in wide.collect() for t in products if r[t] is None or r[t] != 0}
    long = interaction_terms(frame, ["a_", "b_", "c_"], long=True, keep=["row"])
    got = {(r.row, r.term, r.value) for r in long.collect() if r.term is not None}
    assert got == {(i, t, None if v is None else float(v)) for i, t, v in want}
    # A row without any product keeps one row with a null term.
    bare = {r.row for r in long.where(F.col("term").isNull()).collect()}
    assert bare == {r.row for r in wide.collect() if all(r[t] == 0 for t in products)}


def test_long_segment_effects_equal_the_wide_form_at_5000_terms(spark):
    n = 5000
    base = spark.range(400).select(
        F.concat(F.lit("s"), F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).alias("g"),
        (F.col("id") % 100).alias("a"), (F.col("id") % 50).alias("b"),
    )
    wide_cells = [F.when((F.col("a") * 50 + F.col("b")) % n == i, 1).otherwise(0).alias(f"dummies_const{i}") for i in range(n)]
    wide = base.select("k", "g", *wide_cells)
    long = base.select("k", "g", F.concat(F.lit("dummies_const"), ((F.col("a") * 50 + F.col("b")) % n).cast("string")).alias("term"), F.lit(1.0).alias("value"))
    coefs = spark.createDataFrame([(f"dummies_const{i}", float(i % 97)) for i in range(0, n, 3)], "term string, coef double")
    got = {(r.k, r.g): r.value for r in segment_effects(long, coefs, ["k", "g"], order=1, long=True).collect()}
    want = {(r.k, r.g): r.value for r in segment_effects(wide, coefs, ["k", "g"], order=1).collect()}
    assert got == pytest.approx(want) and len(got) == 21


def test_centred_cells_from_one_scan_equal_numpy(spark):
    from fleetledger.models.design import centred_gram_stats, level_moments

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"c": rng.choice(["a", "b", None], 300), "x": 1e9 + rng.normal(0, 3, 300), "y": rng.normal(5e8, 1, 300)})
    design = build_design(spark.createDataFrame(pdf), ["c"], ["x"], "y")
    moments = level_moments(design)
    cells, means = centred_gram_stats(design, moments)
    got = {(r.row_term, r.col_term): r.value for r in cells.collect()}
    x, y = pdf["x"] - pdf["x"].mean(), pdf["y"] - pdf["y"].mean()
    assert means == pytest.approx({"x": pdf["x"].mean(), "y": pdf["y"].mean()}, rel=1e-15)
    assert got[("x", "x")] == pytest.approx(float((x * x).sum()), rel=1e-6)
    assert got[("x", "y")] == pytest.approx(float((x * y).sum()), rel=1e-7, abs=1e-6)
    for level in ("a", "b"):
        on = pdf["c"] == level
        assert got[("c_" + level, "x")] == pytest.approx(float(x[on].sum()), rel=1e-6, abs=1e-3)  # means near 1e9 hold 1e-7 absolute
        assert got[("c_" + level, "c_" + level)] == on.sum()
    # The rows are aggregated once: the moments table has one row per level, null included.
    assert moments.count() == 3


def test_predict_whole_rows(spark, design, data):
    from fleetledger.models.regress import predict

    fit = ols(design)
    beta = coefs(fit)
    rows = spark.createDataFrame(
        [("a", "x", 20000.0, 3.0), ("zz", "y", 1.0, 2.0), (None, "x", 0.0, 0.0), ("b", None, None, 1.0)], "gas string, kind string, hours double, rate double"
    )
    got = [r["prediction"] for r in predict(fit, rows, ["gas", "kind"], ["hours", "rate"]).collect()]
    base = beta["const"]
    want = [
        base + beta["gas_a"] + beta["kind_x"] + 20000 * beta["hours"] + 3 * beta["rate"],
        base + beta["kind_y"] + beta["hours"] + 2 * beta["rate"],  # an unseen level adds nothing
        base + beta["kind_x"],  # a null level adds nothing
    ]
    assert got[:3] == pytest.approx(want, rel=1e-9) and got[3] is None
    with pytest.raises(PySparkException, match="no term"):
        predict(fit, rows.withColumn("extra", F.lit(1.0)), ["gas"], ["hours", "extra"]).collect()


def test_fitted_totals_read_the_features_once(spark):
    from fleetledger.checks.registry import _fitted_totals
    from fleetledger.models.design import profiled

    data = [(f"k{i % 3}" if i % 5 else None, float(i % 4), float(i % 7)) for i in range(500)]
    seen = spark.sparkContext.accumulator(0)

    def tally(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "kind string, size double, cost double"
    plain = spark.createDataFrame(data, schema)
    found = _fitted_totals(plain.mapInArrow(tally, schema), ["kind"], ["size"], "cost").collect()
    assert seen.value == len(data)
    totals = {f"kind_k{k}": sum(c for kind, _, c in data if kind == f"k{k}") for k in range(3)} | {"const": sum(c for *_, c in data)}
    assert {r["term"]: r["target_total"] for r in found} == totals and {r["explained"] for r in found} == {1.0}
    design = build_design(plain, ["kind"], ["size"], "cost")
    shared = profiled(design)
    assert sorted(gram_stats(shared).collect()) == sorted(gram_stats(design).collect())
    assert ols(shared).coefs.collect() == ols(design).coefs.collect()
