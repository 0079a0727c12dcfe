"""Golden formulas, checked in one job each."""

import math

import pytest
from pyspark.sql import functions as F

from lemnia.operators.evaluate import evaluate, summarise, where
from lemnia.operators.series import expand, series
from lemnia.plans.lexer import SyntaxProblem
from lemnia.plans.logical import compile_logical, split_logical
from lemnia.session import Session

#: Formulas and their known values.
GOLDEN = {
    "2^3": 8, "8^(1/3)": 2, "8^(1/2)": 2.8284271247461903, "r1=4;r1*5": 20, "44+22*(3)": 110, "f(x,y) = x-x/y; f(2,3);f(2,5);": 0, "-2^2": 4, "-x^2": -4, "2sin(3)": 2 * math.sin(3), "3(x)": 6, "x(y)": 10, "2^-x": 0.25, "y/-x": -2.5,
    "avgN(0,1,2,3)": 2, "((avgN((0,  (1)+((1+1)),((2)),((3+2))))))": 10 / 3, "avg(1,3,1)": 5 / 3, "geom(1,3,1)": 3 ** (1 / 3), "gsum(1,1,2,3)": 6, "count(1,1,2,3,3)": 5, "med(0,5,4)": 4, "med(3,1,2)": 2, "prod(1+1,2+2)": 8,
    "listsum(4,1,3,5,9,sort(2,1,3,12,8,4),5,9,2,2,10,10)": 90, "length(-1.35)": 3, "lengthFractional(-1.35)": 2, "lengthDecimal(-1.35)": 1, "length(1E5)": 6, "lengthFractional(1E-5)": 5, "lengthDecimal(-1E-5)": 0,
    "roundDigitsN(3,125.35)": 125, "roundDigitsN(4,125.35)": 125.4, "roundDigitsN(5,125.35)": 125.35, "round(1.5)": 2, "round(1.445)": 1, "round(-12.99999)": -13, "roundX(0,1.445)": 2, "ceilN(1,1.11)": 1.2, "floorN(1,-1.11)": -1.2,
    "det(@(5,5)(-21,12,13,64,5,6,2.7,18,9,0,4,2,3,4,23,6,7,8,9,0,1,2,32,4,5))": -1739274.3, "f(x)=x^3;diff(f,5,2)": 30, "autodiff(@(x)3*x^2,3)": 18, "autodiff(@(x)x*cos(x),3,10)": 1.558777409202664, "f(x)=3*x^2;intg(f,2,5)": 117, "f(x)=3*x^2;intg(f,5,2)": -117,
    "root(@(x)x^2-2,1)": 2**0.5, "5!": 120, "4 Č 2": 6, "4 Р 2": 12, "√16": 4, "2²": 4, "4-¹": 0.25, "0.5!": 0.886226925452758, "erf(1)": math.erf(1), "erf(4)": math.erf(4), "erf(-2.5)": math.erf(-2.5), "max(3,-x)": 3, "log(100)": 2, "log(8,2)": 3,
    "sin-¹(1)": math.pi / 2, "1/0": math.inf, "-1/0": -math.inf, "5%0": math.nan, "0/0": math.nan, "ln(0)": -math.inf, "ln(-1)": math.nan, "if(3*x+7>5,sin(x),-3)": math.sin(2), "s_d(1,2,3,4)": 1.2909944487358056, "variance(5)": 0, "171!": math.inf, "(-2)!": -math.inf,
}


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1).select(F.lit(2.0).alias("x"), F.lit(5.0).alias("y"))


def test_golden(one):
    got = one.select(*(Session().compile(k, ["x", "y"]).cast("double").alias(f"c{i}") for i, k in enumerate(GOLDEN))).first()
    for (text, want), value in zip(GOLDEN.items(), got, strict=True):
        same = math.isnan(value) if math.isnan(want) else value == want or abs(value - want) <= 2e-7 * max(1, abs(want))
        assert same, (text, want, value)


def test_angles(one):
    got = one.select(*(Session(u).compile("sin(1)").alias(u) for u in ("DEG", "RAD", "GRAD"))).first()
    assert got == pytest.approx((0.01745240643728351, 0.8414709848078965, 0.015707317311820675))


#: Logical formulas and their known values.
LOGIC = {"1<2  && 1<=0": False, "1+1 < (2+0)*1 impl   false": True, "[1+1 < (2+0)*1 impl  false ]  eq  false": False, "![![ true && false ]]": False, "r=3;r<r+1": True, "1 lt 2 and x ge 2": True, "x": True, "x-2": False}


def test_logic(one):
    got = one.select(*(compile_logical(k, Session(), ["x", "y"]).alias(f"c{i}") for i, k in enumerate(LOGIC))).first()
    assert list(got) == list(LOGIC.values())
    assert split_logical("a<1 && [b | c] xor d") == (["a<1", "[b | c]", "d"], ["&", "xor"])
    with pytest.raises(SyntaxProblem):
        compile_logical("1<2<3", Session())


def test_series(spark):
    text = "avg(..L1)*1.1-MN <  L0 | L1*1.3 + MN<  L0"
    assert expand(text, ["60", "20", "80", "70"]) == "avg(60,20,80)*1.1-4 <  70 | 80*1.3 + 4<  70"
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([60, 20, 80, 70])], "t long, v double")
    rows = series(df.withColumn("u", F.lit(1)), {"a": text, "c": "L9", "d": "L{MN-1}", "e": "sum(L1..L3)"}, "v", ["u"], ["t"]).orderBy("t").collect()
    assert rows[-1]["a"] is True and rows[-1]["c"] == 60 and rows[-1]["d"] == 60 and [r["e"] for r in rows] == [60, 60, 80, 160]


def test_sessions(one):
    s = Session()
    s.define("f(x)=x^2+sin(x);M=@(2,2)(1,2,3,4);k=3;a,b=3")
    assert Session.load(s.dump()).dump() == s.dump()
    assert s.variables("z+f(w)+z") == ["z", "w"]
    s.register("twice", lambda c: c * 2)
    assert one.select(s.compile("twice(k)+undeclared", ["x"])).first()[0] == 6
    with pytest.raises(SyntaxProblem):
        s.compile("f(1,2)")
    with pytest.raises(SyntaxProblem):
        s.compile("3+*")


def test_pushdown(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("q"), F.lit(1.0).alias("unused")).write.parquet(str(tmp_path / "t"))
    df = where(spark.read.parquet(str(tmp_path / "t")), "q > 5").select("q")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(q,5.0)" in plan and "unused" not in plan and df.count() == 4


def test_group_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None)], "k string, v double")
    rows = {r["k"]: r for r in summarise(df, ["k"], {"m": ("avg", "v*2"), "s": ("s_d", "v"), "n": ("count", "v")}).collect()}
    assert rows["a"]["m"] == 4 and rows["b"]["s"] == 0 and rows["b"]["n"] == 1


def test_streams(spark, tmp_path):
    from lemnia.streaming import read

    src = str(tmp_path / "s")
    spark.range(5).select(F.col("id").cast("double").alias("x")).write.parquet(src)
    stream = where(evaluate(read(spark, src, "x double"), {"y": "x^2+1"}), "y > 4")
    q = stream.writeStream.format("memory").queryName("lemnia_stream").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["y"] for r in spark.table("lemnia_stream").collect()) == [5, 10, 17]


#: Formulas of matrices and their known values, by rows.
MATRICES = {
    "invert(M)": [-0.07936507936507937], "tri_mat(M)": [1, 4 / 3, 1 / 3, 0, 1, 4.75, 0, 0, 1], "echelon(M)": [3, 4, 1, 0, 4, 19, 0, 0, 567], "matrix_sub(M,N)": [-1, 3, -7, 0, 3, 4, 4, 0, -11], "sub_mat(A,1,1)": [8], "matrix_minor(A,1,1)": [3], "M*N": [25, 8, 45],
    "M^2-M*M": [0] * 9, "M*invert(M)": [1, 0, 0, 0, 1, 0, 0, 0, 1], "linear_sys(2,3,5,1,-1,1)": [1.6, 0.6], "M/M": [1, 0, 0, 0, 1], "2*M/4": [1.5, 2], "transpose(M)": [3, 2, 9], "matrix_edit(M,0,1,x)": [3, 2, 1], "M^-1*M": [1, 0, 0], "@(2,2)(x,1,1,1)^2": [5, 3, 3, 2], "matrix_pow(M,0)": [1, 0, 0, 0, 1],
}


def test_matrices_in_formulas(one):
    def session():
        s = Session()
        s.define("M=@(3,3)(3,4,1,2,4,7,9,1,-2);N=@(3,3)(4,1,8,2,1,3,5,1,9);A=@(4,4)(3,1,2,5,9,8,3,6,12,1,0,5,3,7,5,9)")
        return s

    got = one.select(*(session().compile(k, ["x", "y"]).alias(f"c{i}") for i, k in enumerate(MATRICES)), session().compile("det(M)", []), session().compile("sum(M)", [])).first()
    for (text, want), value in zip(MATRICES.items(), got, strict=False):
        assert value[: len(want)] == pytest.approx(want, abs=1e-9), text
    assert got[-2:] == pytest.approx((189, 29))
    for bad in ("M+@(1,2)(1,2)", "M*@(1,2)(1,2)", "det(@(1,3)(1,2,3))", "M+1"):
        with pytest.raises(SyntaxProblem):
            session().compile(bad, [])


def test_roots(one):
    known = {"root(@(t)t^3-2*t+2,0)": -1.7692923542386314, "root(@(x)atan(x),3)": 0, "root(@(x)x^3-2,0,2)": 2 ** (1 / 3), "root(@(x)x^2+1,1)": math.nan, "root(@(z)cbrt(z-x),9)": 2}
    got = one.select(*(Session().compile(k, ["x"]).alias(f"c{i}") for i, k in enumerate(known))).first()
    for (text, want), value in zip(known.items(), got, strict=True):
        assert (math.isnan(value) and math.isnan(want)) or value == pytest.approx(want, abs=1e-6), text


def test_rounding_of_all_doubles(one):
    known = {"roundN(2,1e20)": 1e20, "roundDigitsN(3,1e20)": 1e20, "length(1e20)": 21, "roundDigitsN(8,1.23456789012345e-7)": 1.2345679e-07, "roundN(2,-1.005)": -1.01, "ceilN(-30,1.5)": 1e30, "roundN(3,5e-324)": 0, "roundN(1,1/0)": math.inf, "roundN(-400,1.5)": 0, "roundN(400,1.5)": 1.5, "roundDigitsN(2,0)": 0, "floorN(-2,-1)": -100, "length(0)": 0, "roundX(1,0.4449999)": 0.5}
    got = one.select(*(Session().compile(k, []).alias(f"c{i}") for i, k in enumerate(known))).first()
    assert dict(zip(known, got, strict=True)) == known


def test_equations_in_formulas(one):
    known = {"diffeqnHO(y[2] + y[0], 0, @(1,2)(1,0), 3)": math.cos(3), "diffeqn(y[1]+2*y[0], 3, 1.5, 3, 0.01, rk4)": 1.5, "diffeqn(y[1]-(-2*y[0]), 0, 1, 5, 0.01, rk4)": math.exp(-10), "diffeqn(y[1]+2*y[0],0,1,1,0.001,bdf2)": math.exp(-2)}
    paths = {"diffeqnPath(y[1]+2*y[0], 0, 1, 1, 0.1, rk4)": (11, 2), "diffeqnPathHO(y[2]+y[0], 0, @(1,2)(1,0), 3, 0.1, rk4, state)": (31, 3), "diffeqnPathHO(y[2]+y[0], 0, @(1,2)(1,0), 3, 0.1, implicit_euler, 7)": (7, 2), 'diffeqnPath(@(2)("y[2]-y[1]","y[2]+y[0]"),0,@(1,2)(1,0),1,0.1,rk45)': (11, 3)}
    got = one.select(*(Session().compile(k, ["x"]).alias(f"c{i}") for i, k in enumerate([*known, *paths]))).first()
    assert list(got[: len(known)]) == pytest.approx(list(known.values()), rel=1e-5)
    assert [(len(p), len(p[0])) for p in got[len(known) :]] == list(paths.values())
    for bad in ("diffeqn(y[1],0,1)", "diffeqn(y[1],0,1,1,0.1,rk9)"):
        with pytest.raises(SyntaxProblem):
            Session().compile(bad, [])


def test_numbers_in_other_bases(spark):
    from lemnia.functions import numbers as N

    df = spark.createDataFrame([(255.5, "FF.8"), (-10.0, "-1010"), (0.0, "12G"), (7.25, "")], "x double, t string")
    rows = df.select(N.to_base(F.col("x"), 16, 1).alias("a"), N.from_base(F.col("t"), 16).alias("b"), N.is_prime(F.abs("x").cast("bigint")).alias("p"), N.fraction(F.col("x")).alias("f")).collect()
    assert [r["a"] for r in rows] == ["FF.8", "-A.0", "0.0", "7.4"] and [r["b"] for r in rows] == [255.5, -4112, None, None]
    assert [r["p"] for r in rows] == [False, False, False, True] and [tuple(r["f"]) for r in rows] == [(511, 2), (-10, 1), (0, 1), (29, 4)]


def test_stored_sessions_and_windows(spark, tmp_path):
    from lemnia.sources import load_session, save_session

    s = Session()
    s.define("f(x)=x^2;M=@(2,2)(1,2,3,4)")
    save_session(spark, s, str(tmp_path / "s"))
    assert load_session(spark, str(tmp_path / "s")).dump() == s.dump()


def test_windowed_streams(spark, tmp_path):
    from lemnia.streaming import read, windowed

    src = str(tmp_path / "s")
    spark.sql("SELECT timestamp_seconds(id * 30) AS ts, id % 2 AS k, double(id) AS x FROM range(8)").write.parquet(src)
    stats = windowed(read(spark, src, "ts timestamp, k long, x double"), "ts", "1 minute", "10 minutes", ["k"], {"m": ("avg", "x*2"), "n": ("count", "x")})
    q = stats.writeStream.format("memory").outputMode("complete").queryName("lemnia_windows").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = sorted((r["start"].minute, r["k"], r["m"], r["n"]) for r in spark.table("lemnia_windows").collect())
    assert rows == [(m, k, 2.0 * (2 * m + k), 1.0) for m in range(4) for k in range(2)]


def test_members_and_traces(one):
    """Operands may be given by the host, and every part that is read is noted."""
    between = lambda text, session: F.col("x").between(1, 3) if text == "x in range" else None
    trace: list = []
    c = compile_logical("[x in range and y > 4] xor false", Session(), ["x", "y"], members=[between], trace=trace)
    assert one.select(c).first()[0] is True
    assert trace == [(0, "[x in range and y > 4] xor false"), (1, "x in range and y > 4"), (2, "x in range"), (2, "y > 4"), (1, "false")]


def test_methods_of_texts(one):
    s = Session()
    seen: list = []
    s.register_text("named", lambda session, *texts: seen.extend(texts) or session.compile(texts[1], ["x", "y"]) * 2)
    assert one.select(s.compile("named(foo, x+y) + 1", ["x", "y"])).first()[0] == 15 and seen[0] == "foo"
    s.unregister("named")
    assert not s.is_function("named")


def test_command_line(spark, tmp_path, capsys):
    from lemnia.__main__ import main

    (tmp_path / "f").write_text("r=4;r*5\nf(x)=x^2;f(3)\n3+*\n")
    assert main(["2^3", "-e", str(tmp_path / "f")], spark) == 0
    assert capsys.readouterr().out.splitlines()[:3] == ["8.0", "20.0", "9.0"]
    main(["-l", "1<2 and 3>4"], spark)
    main(["-u", "DEG", "sin(30)"], spark)
    out = capsys.readouterr().out.split()
    assert out[0] == "False" and float(out[1]) == pytest.approx(0.5)
