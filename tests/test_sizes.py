"""What larger tables and odd values brought up: formulas that iterate, as batches and as folds."""

import math

import pytest
from pyspark.sql import functions as F

from lemnia.plans.lower import Lowering
from lemnia.session import Session


@pytest.fixture(scope="module")
def odd(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.5, 2.0, -3.5, 7.25, 50.0, 13200.0, math.inf, -math.inf, math.nan, None]
    return spark.createDataFrame([(k, x, float(k % 3)) for k, x in enumerate(values)], "k int, x double, y double").coalesce(1).cache()


def _both(df, formula, s=None):
    """(batch, fold) of each row, and whether the first is a batch or a number."""
    s = s or Session()
    node = s.plan(formula, df.columns)
    env = {c: F.col(c).cast("double") for c in ("x", "y")}
    batch, fold = Lowering(s, env, outer=True).column(node), Lowering(s, env).column(node)
    got = df.select("k", batch.alias("b"), fold.alias("f"))
    plan = got.select("b")._jdf.queryExecution().executedPlan().toString()
    return sorted(map(tuple, got.collect())), "aggregate" not in plan


def _same(rows):
    for k, b, f in rows:
        assert (b is None) == (f is None) and (b is None or b == f or (math.isnan(b) and math.isnan(f)) or b == pytest.approx(f, rel=1e-9, abs=1e-9)), (k, b, f)


@pytest.mark.parametrize("formula", ["intg(@(t)3*t^2,0,x)", "intg(@(t)exp(-t)+y*t,x,y)", "intg(@(t)1/t,-1,x)", "intg(@(t)if(t>1 && t<3,t,y),0,x)", "intg(@(t)t,0,x,5)", "intg(@(t)t,5,2)", "2*intg(@(t)sec(t),0,y)+1/intg(@(t)t,0,y)"])
@pytest.mark.parametrize("unit", ["RAD", "DEG"])
def test_integrals_in_batches(odd, formula, unit):
    rows, batch = _both(odd, formula, Session(unit))
    assert batch
    _same(rows)


def test_folds_stay(odd):
    """Where a lambda holds the integral, or numpy has no equal form, folds remain."""
    s = Session()
    got = odd.where("k = 2").select(*(s.compile(f, odd.columns).alias(f"c{i}") for i, f in enumerate(["variance(intg(@(t)t,0,y),x)", "roundN(2,intg(@(t)t^2,0,y))", "intg(@(t)max(t,1),0,y)", "intg(@(t)intg(@(u)u,0,t),0,y)"]))).first()
    assert tuple(got) == pytest.approx((0.5, 2.67, 2.5, 4 / 3))


@pytest.mark.parametrize("formula", ["root(@(t)t^3-2*t+2,0)", "root(@(t)atan(t-x),x+4)", "root(@(t)t^3-x,0,x)", "root(@(t)exp(t)-x,1)", "root(@(t)1/(t-y),y-0.3)", "root(@(t)t^2+1+0*x,x)", "root(@(t)sin(t)-x/10,x)", "root(@(t)t^2-4,x,3,7)"])
def test_roots_in_batches(odd, formula):
    rows, batch = _both(odd, formula)
    assert batch
    _same(rows)


def test_distinct_rows():
    """Equal rows once, told apart by their bits; code over arrays gives what the tree does."""
    import numpy as np

    from lemnia.plans.batches import compiled, distinct
    from lemnia.plans.numeric import FUNCTIONS, evaluate

    a, b = np.array([1.0, 0.0, 1.0, -0.0, math.nan, 0.0, math.nan]), np.array([2.0, 1, 2, 1, 5, 1, 5])
    at, back = distinct([a, b])
    assert len(at) == 4 and np.array_equal(a[at][back], a, equal_nan=True) and np.array_equal(b[at][back], b) and np.signbit(a[at][back][3])
    assert [len(x) for x in distinct([a[:0]])] == [0, 0]
    s = Session()
    for text in ("sin(x)^2+x*cos(y)/(y+1)", "if(x>1,x,y)+floor(y)", "3"):
        node, env = s.plan(text, ["x", "y"]), {"x": a, "y": b}
        with np.errstate(all="ignore"):
            assert np.array_equal(np.asarray(compiled(node, forms=FUNCTIONS)(env)), np.asarray(evaluate(node, env)), equal_nan=True)


def test_cubic_roots_stay_small(spark):
    """What is used several times is bound once: 894 cases before."""
    from lemnia.operators.roots import cubic_roots

    df = spark.createDataFrame([(1.0, -6.0, 11.0, -6.0), (0.0, 1.0, -3.0, 2.0), (0.0, 1.0, 0.0, 1.0), (2.0, 0.0, 0.0, -16.0), (1.0, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").coalesce(1)
    got = df.select(cubic_roots(*(F.col(k) for k in "abcd")).alias("r"))
    assert got._jdf.queryExecution().analyzed().toString().count("CASE WHEN") < 60
    r = [x["r"] for x in got.collect()]
    assert sorted(r[0][:6:2]) == pytest.approx([1, 2, 3]) and r[0][6] == 0 and sorted(r[1][:4:2]) == [1, 2] and r[2][:4] == [0, 1, 0, -1]
    assert r[3][0] == pytest.approx(2) and r[3][6] == 2 and r[4][:6] == [0] * 6


@pytest.mark.parametrize("formula", ["autodiff(@(t)exp(2*t),x,12)", "autodiff(@(t)sin(t)*t^y,x,5)", "autodiff(@(t)sqrt(t)+t^2.5+t^7,x,4)", "autodiff(@(t)ln(t)/cosh(t)+tan(t),x,3)", "autodiff(@(t)square(t)*cube(t)+inverse(t),x,3)", "autodiff(@(t)t^t+sec(t),y+0.5,4)"])
@pytest.mark.parametrize("unit", ["RAD", "DEG"])
def test_derivatives_in_batches(odd, formula, unit):
    rows, batch = _both(odd, formula, Session(unit))
    assert batch
    _same(rows)


def test_whole_stacks():
    """Each function of a stack gives what it gives for each matrix, zero and NaN pivots and singular matrices among them."""
    import numpy as np

    from lemnia.operators import matrix

    r = np.random.default_rng(3)
    for shape in ((1, 1), (2, 2), (3, 3), (4, 4), (2, 3), (3, 5)):
        m = r.integers(-2, 3, (40, *shape)).astype(float)
        m[0, 0, 0], m[1, :, 0] = math.nan, 0.0
        for name in ("tri_mat", "echelon", "cofactor", "adjoint"):
            if shape[0] == shape[1] or name in ("tri_mat", "echelon"):
                with np.errstate(all="ignore"):
                    assert np.array_equal(matrix.STACKED[name](m), np.stack([matrix.UNARY[name](x) for x in m]), equal_nan=True), (name, shape)
        if shape[0] == shape[1] > 1:
            s = r.normal(size=(40, *shape))
            assert matrix.STACKED["eigvec"](s) == pytest.approx(np.stack([matrix.UNARY["eigvec"](x) for x in s]))


def test_matrices_without_cells(spark):
    from lemnia.operators import matrix

    rows = [(0, (2, 2, [4.0, 1.0, 2.0, 3.0])), (1, None), (2, (2, 2, [1.0])), (3, (3, 3, [float(x) for x in range(9)])), (4, (2, 2, [1.0, None, 0.0, 1.0]))]
    df = spark.createDataFrame(rows, f"k int, m {matrix.TYPE}").coalesce(1)
    got = {r["k"]: r for r in df.select("k", matrix.apply("adjoint", F.col("m")).alias("a"), matrix.determinant(F.col("m")).alias("d")).collect()}
    assert got[0]["a"]["data"] == pytest.approx([3, -1, -2, 4]) and got[0]["d"] == pytest.approx(10)
    assert got[1]["a"]["rows"] == 0 and got[2]["a"]["data"] == [] and got[1]["d"] is None and got[3]["a"]["rows"] == 3 and math.isnan(got[4]["a"]["data"][1])


def test_digits_are_parsed_once(spark):
    """One decimal text for each rounding to digits, where there were 72 in the plan."""
    s = Session()
    df = spark.createDataFrame([(x,) for x in (0.0, 9.995, 99.95, -123456.5, 1.5e20, 1e-9, 5e-324, math.inf, math.nan, None)], "x double").coalesce(1)
    got = df.select(*(s.compile(f, df.columns).alias(f"c{k}") for k, f in enumerate(["roundDigitsN(3,x)", "ceilDigitsN(2,x)", "floorDigitsN(2,x)", "lengthFractional(x)"])))
    one = df.select(s.compile("roundDigitsN(3,x)", df.columns).alias("v"))
    assert one._jdf.queryExecution().analyzed().toString().count("abs(") == 1
    rows = [tuple(r) for r in got.collect()]
    assert rows[:7] == [(0, 0, 0, 0), (10.0, 10.0, 9.9, 3), (100.0, 100.0, 99.0, 2), (-123000.0, -120000.0, -130000.0, 1), (1.5e20, 1.5e20, 1.5e20, 0), (1e-9, 1e-9, 1e-9, 9), (5e-324, 5e-324, 5e-324, 325)]
    assert rows[7] == (math.inf, math.inf, math.inf, 0) and all(map(math.isnan, rows[8][:3])) and rows[9][:3] == (None,) * 3
