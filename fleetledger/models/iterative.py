"""Least squares past the Gram matrix: conjugate gradients on the normal equations (CGLS), every product computed in Spark.

``ols`` brings the square Gram matrix to the driver and stops at ``MAX_TERMS``. Here the driver holds only vectors over the terms:
the coefficients, the gradient and the search direction. Rows that agree in all levels and numbers have the same row of X, so they
are first merged to one row with their count and sums of the target, levels become term numbers by a join, and the result is written
once. Each iteration is one pass over it that computes X'X p and |X p|^2 for the broadcast direction p: a task looks up the terms of
its rows (one indicator per non-null level, the numbers, the constant), adds its share of X'X p into one dense vector and sends the
non-zero entries on; a grouping by term sums them.

Past ``DRIVER_TERMS`` terms the vectors are tables too, and the driver holds only the entries of the numbers and the constant. X'X is
then kept by its cells that are not zero: with each level its count and sums of the numbers, and the counts of the pairs of levels that
meet in a row. Each iteration is one pass over the table of levels, written to the shared folder in place of the one before, with a join
to the pairs where there is more than one category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.models.design import CONST, Design
from fleetledger.models.regress import _COEFS, FitResult
from fleetledger.session import removed, scratch_path, written_once

#: Terms up to which every vector over them is broadcast to the tasks and held whole by the driver; past it they are tables.
DRIVER_TERMS = 250_000


def _levels(design: Design) -> DataFrame | None:
    """The levels as a table: category number ``c``, level ``v`` and a number ``term`` of their own (with gaps)."""
    cats = list(design.categories)
    if not cats:
        return None
    levels = design.frame.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(cats)])).alias("l"))
    levels = levels.select("l.*").where(F.col("v").isNotNull()).distinct()
    return written_once(levels.withColumn("term", F.monotonically_increasing_id()), "cgls-levels")


def _vocabulary(design: Design, levels: DataFrame | None) -> tuple[DataFrame | None, list[str]]:
    """The levels as a table (category number ``c``, level ``v``, ``term`` number), and all term names: indicators (sorted by name),
    numbers, const."""
    cats = list(design.categories)
    tail = [*design.numbers, CONST]
    if levels is None:
        return None, tail
    known = levels.select("c", "v").toArrow()
    of_level = [f"{cats[c]}_{v}" for c, v in zip(known["c"].to_pylist(), known["v"].to_pylist())]
    names = [*sorted(of_level), *tail]
    index = {name: i for i, name in enumerate(names)}
    numbered = known.append_column("term", pa.array([index[name] for name in of_level], pa.int32()))
    return design.frame.sparkSession.createDataFrame(numbered, "c int, v string, term int"), names


def _merged(design: Design, levels: DataFrame | None, none: int) -> DataFrame:
    """The distinct rows of X: terms ``c{i}`` (``none`` for a null level), numbers ``x{i}``, the count ``n`` of the rows merged, and
    the sums ``y`` of their target and ``y2`` of its square."""
    cats, numbers, target = list(design.categories), list(design.numbers), F.col(design.target)
    keys = [*[F.col(c).alias(f"v{i}") for i, c in enumerate(cats)], *[F.col(c).alias(f"x{i}") for i, c in enumerate(numbers)]]
    rows = design.frame.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(target).alias("y"), F.sum(target * target).alias("y2")
    )
    for i in range(len(cats)):
        terms = levels.where(F.col("c") == i).select(F.col("v").alias(f"v{i}"), F.col("term").alias(f"t{i}"))
        rows = rows.join(terms, f"v{i}", "left")
    coded = [F.coalesce(F.col(f"t{i}"), F.lit(none)).alias(f"c{i}") for i in range(len(cats))]
    return rows.where("n > 0").select(*coded, *[f"x{i}" for i in range(len(numbers))], "n", "y", "y2")


def _products(n_cats: int, number_at: list[int], const_at: int, size: int, vector):
    """Per task: the entries of X'X p over its rows and |X p|^2 (term -1), for the broadcast p (None: X'y and sums of y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One place more than the terms: a null level points there.
        p = None if vector is None else np.append(vector.value, 0.0)
        total, extra = np.zeros(size + 1), np.zeros(3)
        terms: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0

        def add() -> None:
            if terms:
                total[:] += np.bincount(np.concatenate(terms), weights=np.concatenate(values), minlength=size + 1)
            terms.clear()
            values.clear()

        for batch in batches:
            n = batch.column("n").to_numpy()
            hits = [batch.column(f"c{i}").to_numpy() for i in range(n_cats)]
            xs = [batch.column(f"x{i}").to_numpy() for i in range(len(number_at))]
            # The value of X p (or, in the first pass, of y) summed over the merged rows.
            if p is None:
                q = batch.column("y").to_numpy()
                extra += (n.sum(), q.sum(), batch.column("y2").to_numpy().sum())
            else:
                one = np.full(len(n), p[const_at])
                for term in hits:
                    one += p[term]
                for at, x in zip(number_at, xs):
                    one += x * p[at]
                q = n * one
                extra[0] += q @ one
            for at, x in zip(number_at, xs):
                total[at] += x @ q
            total[const_at] += q.sum()
            terms += hits
            values += [q] * n_cats
            held += len(n) * n_cats
            # A sum over all terms costs their number: it waits for as many rows.
            if held >= max(size, 1 << 16):
                add()
                held = 0
        add()
        found = np.flatnonzero(total[:size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([found, [-1, -2, -3]])), pa.array(np.concatenate([total[found], extra]))], ["term", "value"]
        )

    return run


def _gram_tables(rows: DataFrame, n_cats: int, n_numbers: int) -> tuple[DataFrame, DataFrame | None]:
    """X'X and X'y by level from the merged rows: (``term``, sums ``w{j}`` of the numbers and, last, the count, ``y``), and the counts
    ``n`` of the pairs of levels (``a``, ``b``) that meet in a row, in both orders (None for one category)."""
    places = [F.col(f"c{i}") for i in range(n_cats)]
    shares = [*[(F.col("n") * F.col(f"x{j}")).alias(f"w{j}") for j in range(n_numbers)], F.col("n").alias(f"w{n_numbers}"), F.col("y")]
    sums = [F.sum(name).alias(name) for name in [*[f"w{j}" for j in range(n_numbers + 1)], "y"]]
    terms = rows.select(F.explode(F.array(*places)).alias("term"), *shares).where("term >= 0").groupBy("term").agg(*sums)
    if n_cats < 2:
        return terms, None
    both = [F.struct(a.alias("a"), b.alias("b")) for i, a in enumerate(places) for j, b in enumerate(places) if i != j]
    pairs = rows.select(F.explode(F.array(*both)).alias("l"), "n").select("l.*", "n").where("a >= 0 AND b >= 0")
    return terms, pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _with_product(table: DataFrame, pairs: DataFrame | None, tail: np.ndarray) -> DataFrame:
    """``table`` (``term``, ``w{j}``, vector ``p``) with the entries ``t`` of X'X p, where ``tail`` is p at the numbers and the constant."""
    t = F.col(f"w{len(tail) - 1}") * F.col("p")
    for j, value in enumerate(tail):
        t = t + F.col(f"w{j}") * F.lit(float(value))
    if pairs is None:
        return table.withColumn("t", t)
    met = pairs.join(table.select(F.col("term").alias("b"), "p"), "b").groupBy(F.col("a").alias("term"))
    met = met.agg(F.sum(F.col("n") * F.col("p")).alias("met"))
    return table.join(met, "term", "left").withColumn("t", t + F.coalesce(F.col("met"), F.lit(0.0))).drop("met")


def _fit_by_tables(design: Design, levels: DataFrame, size: int, tol: float, max_iter: int | None) -> FitResult:
    """The fit of ``ols_cg`` with the vectors' entries of the levels in a table (``term``, ``w{j}``, ``x``, ``s``, ``p``, ``t``)."""
    spark, numbers = design.frame.sparkSession, list(design.numbers)
    last = len(numbers)
    widths = [f"w{j}" for j in range(last + 1)]
    rows = written_once(_merged(design, levels, -1), "cgls-rows")
    terms, pairs = _gram_tables(rows, len(design.categories), last)
    terms = written_once(terms, "cgls-terms")
    pairs = None if pairs is None else written_once(pairs, "cgls-pairs")

    def sums(table: DataFrame, *columns) -> np.ndarray:
        found = table.agg(*[F.sum(c).alias(f"f{i}") for i, c in enumerate(columns)]).first()
        return np.array([0.0 if value is None else value for value in found])

    # The part of X'X and X'y over the numbers and the constant.
    at = [*[F.col(f"x{j}") for j in range(last)], F.lit(1.0)]
    found = sums(rows, F.col("y2"), *[a * F.col("y") for a in at], *[F.col("n") * a * b for a in at for b in at])
    y2, b_tail, gram = found[0], found[1 : last + 2], found[last + 2 :].reshape(last + 1, last + 1)
    n, y_sum = gram[last, last], b_tail[last]
    if n == 0:
        raise ValueError("the design has no rows")

    path = None

    def kept(table: DataFrame) -> DataFrame:
        """The next table of vectors, written; the one before goes."""
        nonlocal path
        before, path = path, scratch_path(spark, "cgls-vectors")
        table.write.parquet(path)
        if before:
            removed(spark, before)
        return spark.read.schema(table.schema).parquet(path)

    def times(table: DataFrame, p_tail: np.ndarray, *columns) -> tuple[float, np.ndarray, np.ndarray]:
        """p'X'X p, X'X p at the numbers and the constant, and the sums of the columns, for a table with ``p`` and ``t``."""
        found = sums(table, F.col("p") * F.col("t"), *[F.col(w) * F.col("p") for w in widths], *columns)
        t_tail = found[1 : last + 2] + gram @ p_tail
        return found[0] + p_tail @ t_tail, t_tail, found[last + 2 :]

    x_tail, s_tail, p_tail = np.zeros(last + 1), b_tail.copy(), b_tail.copy()
    state = terms.select("term", *widths, F.lit(0.0).alias("x"), F.col("y").alias("s"), F.col("y").alias("p"))
    state = kept(_with_product(state, pairs, p_tail))
    gamma = start = sums(state, F.col("s") * F.col("s"))[0] + s_tail @ s_tail
    limit = 2 * size + 20 if max_iter is None else max_iter
    steps = 0
    while gamma > (tol**2) * start:
        if steps >= limit:
            raise ArithmeticError(f"conjugate gradients did not converge in {limit} iterations")
        q2, t_tail, _ = times(state, p_tail)
        if q2 <= 0:
            break
        alpha = gamma / q2
        x_tail, s_tail = x_tail + alpha * p_tail, s_tail - alpha * t_tail
        x, s = F.col("x") + F.lit(float(alpha)) * F.col("p"), F.col("s") - F.lit(float(alpha)) * F.col("t")
        new = sums(state, s * s)[0] + s_tail @ s_tail
        p = s + F.lit(float(new / gamma)) * F.col("p")
        p_tail = s_tail + (new / gamma) * p_tail
        state = kept(_with_product(state.select("term", *widths, x.alias("x"), s.alias("s"), p.alias("p")), pairs, p_tail))
        gamma = new
        steps += 1
    # |y - Xx|^2 = |y|^2 - 2 x'X'y + x'X'X x, with X'X x from one more pass.
    solved = _with_product(state.select("term", *widths, F.col("x").alias("p")), pairs, x_tail)
    xtx, _, (xty,) = times(solved.join(terms.select("term", "y"), "term"), x_tail, F.col("p") * F.col("y"))
    residual = max(y2 - 2 * (xty + x_tail @ b_tail) + xtx, 0.0)
    total = y2 - y_sum * y_sum / n
    r2 = 1 - residual / total if total > 0 else None
    prefix = F.get(F.array(*[F.lit(f"{c}_") for c in design.categories]), F.col("c"))
    named = levels.join(state.select("term", "x"), "term").select(F.concat(prefix, "v").alias("term"), F.col("x").alias("coef"))
    tail = spark.createDataFrame([(name, float(value)) for name, value in zip([*numbers, CONST], x_tail)], "term string, coef double")
    coefs = written_once(named.union(tail), "cgls-coefs")
    removed(spark, path)
    none = F.lit(None).cast("double")
    return FitResult(coefs.select("term", "coef", none.alias("std_err"), none.alias("t")), float(x_tail[-1]), r2, int(n), None)


def ols_cg(design: Design, tol: float = 1e-10, max_iter: int | None = None, max_vector: int | None = None) -> FitResult:
    """Least squares on all levels, the numbers and a constant, by CGLS from a zero start: the solution of smallest norm.

    Iterates stay in the row space of X, so the limit is the smallest-norm solution that ``ols`` gives, without a square matrix. A
    design may have any number of terms, unless ``max_vector`` is given: then more are refused. Up to ``DRIVER_TERMS`` the driver holds
    the vectors and the coefficients are sorted as in ``ols``; past it they are tables in no order. The fit stops when |X'r| <= ``tol`` |X'y| and fails with ArithmeticError if
    ``max_iter`` (default: twice the number of terms, plus 20) iterations do not get there. Standard errors and t values need the
    inverse of X'X and are refused: they are null, and so is the rank. A design without rows is an error. Columns and rows are
    those of ``build_design`` (rows with a missing number or target were dropped there; a null level has no indicator).
    """
    spark = design.frame.sparkSession
    levels = _levels(design)
    terms = (0 if levels is None else levels.count()) + len(design.numbers) + 1
    if max_vector is not None and terms > max_vector:
        raise ValueError(f"the design has {terms} terms, more than {max_vector}")
    if levels is not None and terms > DRIVER_TERMS:
        return _fit_by_tables(design, levels, terms, tol, max_iter)
    levels, names = _vocabulary(design, levels)
    index = {name: i for i, name in enumerate(names)}
    size = len(names)
    number_at, const_at = [index[c] for c in design.numbers], index[CONST]
    rows = written_once(_merged(design, levels, size), "cgls-rows")

    def pass_over(p: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        vector = None if p is None else spark.sparkContext.broadcast(p)
        try:
            run = _products(len(design.categories), number_at, const_at, size, vector)
            parts = rows.mapInArrow(run, "term bigint, value double")
            found = parts.groupBy("term").agg(F.sum("value").alias("value")).toArrow()
        finally:
            if vector is not None:
                vector.destroy()
        terms, values = found["term"].to_numpy(), found["value"].to_numpy()
        out, extra = np.zeros(size), np.zeros(3)
        out[terms[terms >= 0]] = values[terms >= 0]
        extra[-1 - terms[terms < 0]] = values[terms < 0]
        return out, extra

    s, (n, y_sum, y2) = pass_over(None)
    xty = s.copy()
    if n == 0:
        raise ValueError("the design has no rows")
    x, p = np.zeros(size), s.copy()
    gamma = start = s @ s
    limit = 2 * size + 20 if max_iter is None else max_iter
    steps = 0
    while gamma > (tol**2) * start:
        if steps >= limit:
            raise ArithmeticError(f"conjugate gradients did not converge in {limit} iterations")
        t, (q2, _, _) = pass_over(p)
        if q2 <= 0:
            break
        alpha = gamma / q2
        x += alpha * p
        s -= alpha * t
        new = s @ s
        p = s + (new / gamma) * p
        gamma = new
        steps += 1
    # |y - Xx|^2 = |y|^2 - 2 x'X'y + x'X'X x, with X'X x from one more pass.
    xtx, _ = pass_over(x)
    residual = max(y2 - 2 * x @ xty + x @ xtx, 0.0)
    total = y2 - y_sum * y_sum / n
    r2 = 1 - residual / total if total > 0 else None
    none = pa.nulls(size, pa.float64())
    coefs = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "coef": x, "std_err": none, "t": none}), _COEFS)
    return FitResult(coefs, float(x[-1]), r2, int(n), None)
