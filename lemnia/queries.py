"""The library's own queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .operators import geometry, matrix, ode
from .operators.evaluate import eval_range, evaluate, modes, summarise, trimmed_mean, where
from .operators.integrals import integrate, simpson, trapezoid
from .operators.series import series
from .session import Session
from .sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6
LINE = ["l_orderkey", "l_linenumber"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if c in names else c for c in df.columns))


def _formulas(name: str, pairs: dict[str, tuple[str, str]], source: str = "lineitem", keys=None, define: str = "", angle: str = "RAD") -> None:
    """A projection query: alias -> (formula, SQL)."""
    keys = keys or LINE

    def run(spark, sf_dir):
        s = Session(angle)
        if define:
            s.define(define)
        return _rounded(evaluate(table(spark, sf_dir, source), {k: f for k, (f, _) in pairs.items()}, s, keys), set(pairs))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {', '.join(keys)}, {', '.join(f'round(({q})::DOUBLE, {DIGITS}) AS {k}' for k, (_, q) in pairs.items())} FROM {source}"


# -- arithmetic and comparison ---------------------------------------------------
_formulas("arith_basic", {"revenue": ("l_extendedprice*(1-l_discount)*(1+l_tax)", "l_extendedprice*(1-l_discount)*(1+l_tax)"), "sums": ("12*l_quantity+3*l_tax-4*l_discount+5*l_quantity-l_tax", "12*l_quantity+3*l_tax-4*l_discount+5*l_quantity-l_tax"), "chain": ("l_quantity--+-2", "l_quantity-2")})
_formulas("arith_power", {"a": ("l_quantity^2 + l_quantity^3/1000 + l_quantity^0.5", "l_quantity*l_quantity + pow(l_quantity,3)/1000 + sqrt(l_quantity)"), "b": ("2^3^0.5 + -2^2", "pow(2,pow(3,0.5)) + 4"), "c": ("-l_quantity^2", "-(l_quantity*l_quantity)"), "d": ("l_quantity^(1/3) + l_quantity^-2 + l_quantity^1.7", "cbrt(l_quantity) + 1/(l_quantity*l_quantity) + pow(l_quantity,1.7)"), "e": ("l_quantity² + l_quantity³ + √l_quantity + ³√l_quantity + l_quantity-¹", "l_quantity*l_quantity + l_quantity*l_quantity*l_quantity + sqrt(l_quantity) + cbrt(l_quantity) + 1/l_quantity")})
_formulas("implicit_mul", {"a": ("3(l_quantity)+2sin(l_tax)(l_quantity)", "3*l_quantity+2*sin(l_tax)*l_quantity"), "b": ("(l_quantity)2 + 2pi l_tax", "l_quantity*2 + 2*pi()*l_tax")})
_formulas("constants", {"a": ("pi*l_quantity + e + φ", f"pi()*l_quantity + exp(1) + {(1 + math.sqrt(5)) / 2!r}")})
_formulas("user_function", {"a": ("f(l_quantity, 4)", "l_quantity - l_quantity/4")}, define="f(x,y)=x-x/y")
_formulas("nested_user_function", {"a": ("g(l_quantity) + h(l_tax)", "(2*l_quantity+1)*(2*l_quantity+1) + l_tax + 7")}, define="f(x)=2*x+1;g(x)=f(x)^2;k=7;h=@(z)z+k")
_formulas("if_expr", {"a": ("if(3*l_quantity+7>50, sin(l_quantity), -3)", "CASE WHEN 3*l_quantity+7>50 THEN sin(l_quantity) ELSE -3 END")})
_formulas("cmp_all", {k: (f"if(l_quantity {op} 25,1,0)", f"CASE WHEN l_quantity {sql} 25 THEN 1.0 ELSE 0.0 END") for k, op, sql in (("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">="), ("eq", "==", "="), ("ne", "!=", "<>"))})
_formulas("word_operators", {"a": ("if(gt(l_quantity,25),1,0) + if(le(l_quantity,3),2,0)", "CASE WHEN l_quantity>25 THEN 1 ELSE 0 END + CASE WHEN l_quantity<=3 THEN 2 ELSE 0 END"), "b": ("rem(l_quantity,7)+mod(l_quantity,4)", "l_quantity%7 + l_quantity%4")})
_formulas("logic_and_or", {"a": ("if(l_quantity > 25 && l_discount < 0.05 || l_tax == 0, 1, 0)", "CASE WHEN (l_quantity > 25 AND l_discount < 0.05) OR l_tax = 0 THEN 1.0 ELSE 0.0 END")})
_CASE = lambda e: f"CASE WHEN isnan({e}) THEN 'nan' WHEN {e} = 'inf'::DOUBLE THEN 'inf' WHEN {e} = '-inf'::DOUBLE THEN '-inf' ELSE 'finite' END"


def _kinds(df: DataFrame, formulas: dict[str, str], keys) -> DataFrame:
    got = evaluate(df, formulas, None, keys)
    kind = lambda c: F.when(F.isnan(c), "nan").when(c == math.inf, "inf").when(c == -math.inf, "-inf").otherwise("finite")
    return got.select(*keys, *(kind(F.col(k)).alias(k) for k in formulas))


def _guards(name: str, pairs: dict[str, tuple[str, str]]) -> None:
    QUERIES[name] = lambda spark, d: _kinds(table(spark, d, "part"), {k: f for k, (f, _) in pairs.items()}, ["p_partkey"])
    ORACLE_SQL[name] = f"SELECT p_partkey, {', '.join(f'{_CASE(q)} AS {k}' for k, (_, q) in pairs.items())} FROM (SELECT p_partkey, (p_size % 3 - 1)::DOUBLE AS z, p_size::DOUBLE AS s FROM part)"


_guards("div_zero_guard", {"a": ("p_size/(p_size%3-1)", "(s/z)"), "b": ("(p_size%3-1)/(p_size%3-1)", "(z/z)"), "c": ("-p_size/(p_size%3-1)", "(-s/z)")})
_guards("arith_mod_guard", {"a": ("p_size%(p_size%3-1)", "(s%z)")})
_guards("log_guard", {"a": ("ln(p_size%3-1)", "(CASE WHEN z>0 THEN 0.0 WHEN z=0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)"), "b": ("sqrt(p_size%3-1)", "(CASE WHEN z>=0 THEN 0.0 ELSE 'nan'::DOUBLE END)"), "c": ("atanh(p_size%3-1) + acosh(p_size%3-1)", "('nan'::DOUBLE)")})

# -- scalar functions -----------------------------------------------------------------
_TRIG = {"RAD": "l_quantity", "DEG": "(l_quantity*pi()/180)", "GRAD": "(l_quantity*pi()/200)"}
for _unit, _x in _TRIG.items():
    _formulas(f"trig_{_unit.lower()}", {f: (f"{f}(l_quantity)", f"{f}({_x})") for f in ("sin", "cos", "tan")}, angle=_unit)
for _unit, _f in (("RAD", "1"), ("DEG", "(180/pi())"), ("GRAD", "(200/pi())")):
    _formulas(f"inv_trig_{_unit.lower()}", {"a": ("asin(l_discount)", f"asin(l_discount)*{_f}"), "b": ("acos(l_discount)", f"acos(l_discount)*{_f}"), "c": ("tan-¹(l_quantity)", f"atan(l_quantity)*{_f}")}, angle=_unit)
_formulas("recip_trig", {"a": ("sec(l_quantity/60)", "1/cos(l_quantity/60)"), "b": ("csc(l_quantity/60)", "1/sin(l_quantity/60)"), "c": ("cot(l_quantity/60)", "1/tan(l_quantity/60)")})
_formulas("inv_recip_trig", {"a": ("asec(l_quantity+1)", "acos(1/(l_quantity+1))"), "b": ("acsc(l_quantity+1)", "asin(1/(l_quantity+1))"), "c": ("cot-¹(l_quantity)", "atan(1/l_quantity)")})
_formulas("hyperbolic", {"a": ("sinh(l_discount)+cosh(l_tax)+tanh(l_quantity/20)", "sinh(l_discount)+cosh(l_tax)+tanh(l_quantity/20)"), "b": ("sech(l_tax)+csch(l_quantity/20)+coth(l_quantity/20)", "1/cosh(l_tax)+1/sinh(l_quantity/20)+1/tanh(l_quantity/20)")})
_formulas("inv_hyperbolic", {"a": ("asinh(l_quantity)+acosh(l_quantity)+atanh(l_discount)", "asinh(l_quantity)+acosh(l_quantity)+atanh(l_discount)"), "b": ("asech(1/(l_quantity+1))+acsch(l_quantity)+acoth(l_quantity+1)", "acosh(l_quantity+1)+asinh(1/l_quantity)+atanh(1/(l_quantity+1))")})
_formulas("exp_log", {"a": ("exp(l_discount)+ln(l_quantity)+ln-¹(l_tax)", "exp(l_discount)+ln(l_quantity)+exp(l_tax)"), "b": ("lg(l_quantity)+log(l_quantity)", "2*log10(l_quantity)")})
_formulas("log_any_base", {"a": ("log(l_quantity+1,3)", "ln(l_quantity+1)/ln(3)")})
_formulas("antilog", {"a": ("alg(l_discount)+lg-¹(l_tax)+alog(l_discount,3)+log-¹(l_tax,2)", "pow(10,l_discount)+pow(10,l_tax)+pow(3,l_discount)+pow(2,l_tax)")})
_formulas("roots", {"a": ("sqrt(l_quantity)+cbrt(l_quantity)+square(l_tax)+cube(l_tax)+inverse(l_quantity)", "sqrt(l_quantity)+cbrt(l_quantity)+l_tax*l_tax+l_tax*l_tax*l_tax+1/l_quantity"), "b": ("atan2(l_quantity,3)+hypot(l_quantity,4)+abs(-l_tax)+floor(l_extendedprice)+ceil(l_extendedprice)", "atan2(l_quantity,3)+sqrt(l_quantity*l_quantity+16)+l_tax+floor(l_extendedprice)+ceil(l_extendedprice)")})
_formulas("factorial_comb_perm", {"a": ("l_linenumber! + fact(l_linenumber)", "2*factorial(l_linenumber)"), "b": ("comb(9,l_linenumber) + (9 Č l_linenumber)", "2*factorial(9)/(factorial(l_linenumber)*factorial(9-l_linenumber))"), "c": ("perm(9,l_linenumber) + (9 Р l_linenumber)", "2*factorial(9)/factorial(9-l_linenumber)"), "d": ("fact(l_linenumber/2)", "gamma(l_linenumber/2+1)")})
_A = "(0.254829592*{t}-0.284496736*{t}*{t}+1.421413741*{t}*{t}*{t}-1.453152027*{t}*{t}*{t}*{t}+1.061405429*{t}*{t}*{t}*{t}*{t})"
_T = "(1/(1+0.3275911*(l_discount*10/sqrt(2))))"
_formulas("fast_gelu", {"a": ("fast_gelu(l_discount*10)", f"0.5*l_discount*10*(1+(1-{_A.format(t=_T)}*exp(-(l_discount*10/sqrt(2))*(l_discount*10/sqrt(2)))) * sign(l_discount))")})
_formulas("swiglu", {"a": ("swiglu(l_quantity/10)", "(l_quantity/10)*(l_quantity/10)/(1+exp(-l_quantity/10))"), "b": ("swiglu(l_tax,l_quantity/10)", "l_tax*(l_quantity/10)/(1+exp(-l_quantity/10))")})
_formulas("fma", {"a": ("fma(l_quantity,l_tax,l_discount)", "l_quantity*l_tax+l_discount")})
_ERF = "(2/sqrt(pi())*{x}*(" + "+".join(f"pow(-1,{k})*pow({{x}},{2 * k})/({math.factorial(k) * (2 * k + 1)})" for k in range(24)) + "))"
_formulas("erf_gelu", {"a": ("erf(l_discount*10)", _ERF.format(x="(l_discount*10)")), "b": ("gelu(l_discount*10)", f"0.5*l_discount*10*(1+{_ERF.format(x='(l_discount*10/sqrt(2))')})"), "c": ("geglu(l_tax,l_discount*10)", f"l_tax*0.5*l_discount*10*(1+{_ERF.format(x='(l_discount*10/sqrt(2))')})")})
_formulas("activations", {"a": ("sigmoid(l_quantity/9)+relu(l_discount-0.05)", "1/(1+exp(-l_quantity/9))+greatest(l_discount-0.05,0)"), "b": ("leaky_relu(l_discount-0.05)+elu(l_discount-0.05)", "CASE WHEN l_discount-0.05>0 THEN 2*(l_discount-0.05) ELSE 0.01*(l_discount-0.05)+exp(l_discount-0.05)-1 END"), "c": ("clip(l_quantity,10,20)+mish(l_tax)", "least(greatest(l_quantity,10),20)+l_tax*tanh(ln(1+exp(l_tax)))")})
_D = "l_extendedprice::DECIMAL(28,6)"
_formulas("round_family", {"a": ("round(l_extendedprice)", "round(l_extendedprice)"), "b": ("roundN(1,l_extendedprice)", f"round({_D},1)"), "c": ("roundN(-2,l_extendedprice)", f"round({_D}/100,0)*100")})
_formulas("ceil_floor_n", {"a": ("ceilN(1,l_extendedprice)", f"ceil({_D}*10)/10"), "b": ("floorN(1,l_extendedprice)", f"floor({_D}*10)/10")})
_formulas("sig_digits", {"a": ("roundDigitsN(3,l_extendedprice)", f"round({_D}/pow(10,floor(log10(l_extendedprice))-2)::DECIMAL(10,0),0)::DOUBLE*pow(10,floor(log10(l_extendedprice))-2)"), "b": ("floorDigitsN(2,l_extendedprice)", f"floor({_D}/pow(10,floor(log10(l_extendedprice))-1)::DECIMAL(10,0))::DOUBLE*pow(10,floor(log10(l_extendedprice))-1)"), "c": ("ceilDigitsN(2,l_extendedprice)", f"ceil({_D}/pow(10,floor(log10(l_extendedprice))-1)::DECIMAL(10,0))::DOUBLE*pow(10,floor(log10(l_extendedprice))-1)")})
_formulas("round_x", {"a": ("roundX(0,l_extendedprice)", f"round(round(({_D})::DECIMAL(28,2),1),0)")})
_formulas("length_family", {"a": ("lengthDecimal(p_size)", "length(p_size::VARCHAR)"), "b": ("lengthFractional(p_size+0.25)", "2"), "c": ("length(p_size+0.25)", "length(p_size::VARCHAR)+2")}, "part", ["p_partkey"])


@_query("SELECT p_partkey, p_size || ' ' || (p_size+1) AS a FROM part")
def echo_family(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "part"), {"a": "echo(p_size,p_size+1)"}, None, ["p_partkey"])


# -- statistics ----------------------------------------------------------------------------
_ARGS = "l_quantity,100*l_tax,100*l_discount,7"
_LIST = "[l_quantity,100*l_tax,100*l_discount,7.0]"
_MEAN = f"list_avg({_LIST})"
_formulas("row_sum_prod", {"a": (f"sum({_ARGS})+listsum({_ARGS},sort(3,1,2))", f"2*list_sum({_LIST})+6"), "b": (f"prod({_ARGS})", f"list_product({_LIST})"), "c": (f"gsum({_ARGS})", f"list_product({_LIST})")})
_formulas("row_min_max_range", {"a": (f"min({_ARGS})+max({_ARGS})", f"list_min({_LIST})+list_max({_LIST})"), "b": (f"rng({_ARGS})", f"list_max({_LIST})-list_min({_LIST})"), "c": (f"mrng({_ARGS})", f"(list_max({_LIST})+list_min({_LIST}))/2")})
_formulas("row_mean_geom_rms", {"a": (f"avg({_ARGS})+mean({_ARGS})", f"2*{_MEAN}"), "b": ("geom(l_quantity,7,3)", "pow(l_quantity*21,1.0/3)"), "c": (f"rms({_ARGS})", f"sqrt(list_avg(list_transform({_LIST}, lambda x: x*x)))"), "d": (f"count({_ARGS})", "4")})
_formulas("row_var_sd_sterr_cov", {"a": (f"variance({_ARGS})", f"list_var_samp({_LIST})"), "b": (f"s_d({_ARGS})", f"list_stddev_samp({_LIST})"), "c": (f"st_err({_ARGS})", f"list_stddev_samp({_LIST})/2"), "d": (f"cov({_ARGS})", f"list_stddev_samp({_LIST})/{_MEAN}")})
_formulas("row_median", {"a": (f"med({_ARGS})", f"list_median({_LIST})")})
_formulas("row_trimmed_mean", {"a": (f"avgN(1,{_ARGS})", f"list_avg(list_sort({_LIST})[2:3])"), "b": ("geomN(1,l_quantity,7,3,9)", "sqrt(list_sort([l_quantity,7.0,3.0,9.0])[2]*list_sort([l_quantity,7.0,3.0,9.0])[3])")})


def _exploded(df: DataFrame, keys, vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "value")).withColumn("value", F.round("value", DIGITS))


@_query(f"SELECT l_orderkey, l_linenumber, (i-1)::INTEGER AS pos, round(list_sort({_LIST})[i],6) AS value FROM lineitem, range(1,5) t(i)")
def row_sort(spark, sf_dir):
    return _exploded(evaluate(table(spark, sf_dir, "lineitem"), {"v": f"sort({_ARGS})"}, None, LINE), LINE, "v")


@_query("WITH c AS (SELECT l_orderkey, l_linenumber, v, count(*) n FROM lineitem, unnest([l_linenumber::DOUBLE, 3.0, 3.0, 5.0, 5.0, 2.0]) u(v) GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey, l_linenumber) t FROM c) SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY v) - 1)::INTEGER AS pos, v AS value FROM m WHERE n = t")
def row_mode(spark, sf_dir):
    return _exploded(evaluate(table(spark, sf_dir, "lineitem").dropDuplicates(LINE), {"v": "mode(l_linenumber,3,3,5,5,2)"}, None, LINE), LINE, "v")


ORACLE_SQL["row_mode"] = ORACLE_SQL["row_mode"].replace("FROM lineitem, unnest", "FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) d, unnest")

_V = "l_extendedprice*(1-l_discount)"
_AGG = {"sum": "sum({v})", "avg": "avg({v})", "count": "count({v})::DOUBLE", "min": "min({v})", "max": "max({v})", "rng": "max({v})-min({v})", "mrng": "(max({v})+min({v}))/2", "med": "median({v})", "geom": "exp(avg(ln({v})))", "rms": "sqrt(avg({v}*{v}))", "s_d": "stddev_samp({v})", "variance": "var_samp({v})", "st_err": "stddev_samp({v})/sqrt(count({v}))", "cov": "stddev_samp({v})/avg({v})"}
for _stat, _sql in _AGG.items():
    ORACLE_SQL[f"agg_{_stat}"] = f"SELECT l_returnflag, round({_sql.format(v='(' + _V + ')')}, 3) AS x FROM lineitem GROUP BY 1"
    QUERIES[f"agg_{_stat}"] = lambda spark, d, s=_stat: summarise(table(spark, d, "lineitem"), ["l_returnflag"], {"x": (s, _V)}).withColumn("x", F.round("x", 3))
ORACLE_SQL["agg_prod"] = "SELECT l_returnflag, round(ln(product(1+l_tax/1000)), 6) AS x FROM lineitem GROUP BY 1"
QUERIES["agg_prod"] = lambda spark, d: summarise(table(spark, d, "lineitem"), ["l_returnflag"], {"x": ("prod", "1+l_tax/1000")}).withColumn("x", F.round(F.ln("x"), DIGITS))


@_query("WITH c AS (SELECT l_returnflag, l_quantity AS value, count(*) n FROM lineitem GROUP BY ALL) SELECT l_returnflag, value, n FROM c QUALIFY n = max(n) OVER (PARTITION BY l_returnflag)")
def agg_mode(spark, sf_dir):
    return modes(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@_query("WITH r AS (SELECT l_returnflag, l_quantity v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) i, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem) SELECT l_returnflag, round(avg(v), 6) AS trimmed_mean FROM r WHERE i > 5 AND i <= n - 5 GROUP BY 1")
def agg_trimmed_mean(spark, sf_dir):
    return _rounded(trimmed_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 5), {"trimmed_mean"})


# -- logic and series -----------------------------------------------------------------------------
@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def logical_filter(spark, sf_dir):
    return where(table(spark, sf_dir, "lineitem"), "l_quantity > 25 && l_discount < 0.05").select(*LINE)


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((NOT ((l_quantity > 25) <> (l_tax < 0.04))) OR l_discount > 0.05) = (NOT (l_quantity <= 10))")
def logical_xor_impl_eq(spark, sf_dir):
    return where(table(spark, sf_dir, "lineitem"), "[l_quantity > 25 xor l_tax < 0.04 impl l_discount > 0.05] eq ![l_quantity <= 10]").select(*LINE)


_EVENTS = "WITH e AS (SELECT event_id, user_id, ts, value, row_number() OVER w i, count(*) OVER (w ROWS UNBOUNDED PRECEDING) mn, first_value(value) OVER w f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _series(name: str, formulas: dict[str, str], sql: str) -> None:
    def run(spark, sf_dir):
        got = series(table(spark, sf_dir, "events"), formulas, "value", ["user_id"], ["ts", "event_id"])
        kinds = dict(got.dtypes)
        return got.select("event_id", *(F.round(k, DIGITS).alias(k) if kinds[k] == "double" else k for k in formulas))

    QUERIES[name], ORACLE_SQL[name] = run, sql


_W = "PARTITION BY user_id ORDER BY ts, event_id"
_series("series_lag", {"a": "L0-L1", "b": "L3*1.1"}, f"SELECT event_id, round(value-coalesce(lag(value,1) OVER w, first_value(value) OVER w),6) AS a, round(coalesce(lag(value,3) OVER w, first_value(value) OVER w)*1.1,6) AS b FROM events WINDOW w AS ({_W})")
_series("series_prefix", {"a": "pi*avg(..L1)+MN", "b": "max(..L0)"}, f"SELECT event_id, round(pi()*coalesce(avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value)+count(*) OVER (w ROWS UNBOUNDED PRECEDING),6) AS a, round(max(value) OVER (w ROWS UNBOUNDED PRECEDING),6) AS b FROM events WINDOW w AS ({_W})")
_series("series_suffix", {"a": "sum(L3..)", "b": "s_d(L4..)"}, f"SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),6) AS a, round(coalesce(stddev_samp(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),0),6) AS b FROM events WINDOW w AS ({_W})")
_series("series_range", {"a": "min(L4..L2)", "b": "med(L2..L0)"}, f"SELECT event_id, round(coalesce(min(value) OVER (w ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING), first_value(value) OVER w),6) AS a, round(median(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),6) AS b FROM events WINDOW w AS ({_W})")
_series("series_product", {"a": "prod(L2..L0)", "b": "gsum(L1..)/100"}, f"SELECT event_id, round(product(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),6) AS a, round(product(value) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)/100,6) AS b FROM events WINDOW w AS ({_W})")
_series("series_alert", {"a": "avg(..L1)*1.1-MN < L0 | L1*1.3 + MN < L0"}, f"SELECT event_id, (coalesce(avg(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value)*1.1-count(*) OVER (w ROWS UNBOUNDED PRECEDING) < value) OR (coalesce(lag(value,1) OVER w, value)*1.3 + count(*) OVER (w ROWS UNBOUNDED PRECEDING) < value) AS a FROM events WINDOW w AS ({_W})")
_series("series_computed", {"a": "L{MN-2}+L0"}, f"SELECT event_id, round(coalesce(CASE WHEN count(*) OVER (w ROWS UNBOUNDED PRECEDING) < 2 THEN value END, nth_value(value, 2) OVER (w ROWS UNBOUNDED PRECEDING)) + value, 6) AS a FROM events WINDOW w AS ({_W})")

# -- calculus -------------------------------------------------------------------------------------------
_formulas("diff_symbolic", {"a": ("diff(f,l_discount,1)", "2*l_discount*sin(l_discount)+l_discount*l_discount*cos(l_discount)"), "b": ("diff(g,l_tax,1)", "exp(2*l_tax)*2/(1+l_tax) - exp(2*l_tax)/((1+l_tax)*(1+l_tax))")}, define="f(x)=x^2*sin(x);g(x)=exp(2*x)/(1+x)")
_formulas("diff_nth", {"a": ("diff(f,l_quantity,2)", "6*l_quantity"), "b": ("diff(g,l_tax,4)", "16*sin(2*l_tax)")}, define="f(x)=x^3;g(x)=sin(2*x)")
_formulas("autodiff", {"a": ("autodiff(@(x)3*x^2,l_quantity)", "6*l_quantity"), "b": ("autodiff(@(x)x*cos(x),l_tax,3)", "-3*cos(l_tax)+l_tax*sin(l_tax)"), "c": ("autodiff(@(x)ln(x)/x,l_quantity)", "(1-ln(l_quantity))/(l_quantity*l_quantity)")})


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([pow(p_size,3), 3*pow(p_size,2), 6.0*p_size, 6.0][i],6) AS value FROM part, range(1,5) t(i)")
def autodiff_vector(spark, sf_dir):
    return _exploded(evaluate(table(spark, sf_dir, "part"), {"v": "autodiffN(@(x)x^3,p_size,3)"}, None, ["p_partkey"]), ["p_partkey"], "v")


@_query("SELECT l_orderkey, l_linenumber, round(2*l_quantity*l_tax,6) AS dx, round(l_quantity*l_quantity+cos(l_tax),6) AS dy FROM lineitem")
def gradient_2var(spark, sf_dir):
    s = Session()
    s.define("f(x,y)=x^2*y+sin(y)")
    parts = {"dx": s.derivative(s.functions["f"], 1, "x"), "dy": s.derivative(s.functions["f"], 1, "y")}
    for k, fn in parts.items():
        s.functions[k] = fn
    return _rounded(evaluate(table(spark, sf_dir, "lineitem"), {k: f"{k}(l_quantity,l_tax)" for k in parts}, s, LINE), set(parts))


_formulas("integral_fixed", {"a": ("intg(@(x)3*x^2,2,5)", "117"), "b": ("intg(@(x)3*x^2,5,2)", "-117"), "c": ("intg(@(x)sin(x),0,pi)", "2")}, "part", ["p_partkey"])
_formulas("integral_per_row", {"a": ("intg(@(x)3*x^2,0,p_size/10)", "pow(p_size/10.0,3)"), "b": ("intg(@(x)exp(-x),0,p_size/10)", "1-exp(-p_size/10.0)")}, "part", ["p_partkey"])


@_query("SELECT p_partkey, round((SELECT sum((sin(p_size/10.0*k/40)+sin(p_size/10.0*(k+1)/40))/2*p_size/400.0) FROM range(40) t(k)),6) AS a FROM part")
def trapezoid_rule(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(trapezoid("sin(x)", F.lit(0.0), F.col("p_size") / 10.0, 40), DIGITS).alias("a"))


@_query("SELECT p_partkey, round(1-cos(p_size/10.0),4) AS a FROM part")
def simpson_rule(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(simpson("sin(x)", F.lit(0.0), F.col("p_size") / 10.0, 100), 4).alias("a"))


@_query("SELECT p_partkey, round(sqrt(pi())/2*1.0,6) AS a, round(2*sqrt(p_size),4) AS b FROM part")
def robust_integral(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", F.round(integrate("exp(-x^2)", F.lit(0.0), F.lit(math.inf)), DIGITS).alias("a"), F.round(integrate("1/sqrt(x)", F.lit(0.0), F.col("p_size")), 4).alias("b"))


_formulas("newton_root", {"a": ("root(@(x)x^2-p_size,p_size)", "sqrt(p_size)"), "b": ("root(@(x)exp(x)-p_size,1)", "ln(p_size)")}, "part", ["p_partkey"])


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([p_size+1.0, 1.0][i],6) AS value FROM part, range(1,3) t(i)")
def quadratic_roots(spark, sf_dir):
    return _exploded(evaluate(table(spark, sf_dir, "part"), {"v": "quadratic(@(x)x^2-(p_size+2)*x+p_size+1)"}, None, ["p_partkey"]), ["p_partkey"], "v")


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([p_size::DOUBLE, 0, -p_size/2.0, sqrt(3)/2*p_size, -p_size/2.0, -sqrt(3)/2*p_size, 2.0][i],4) AS value FROM part, range(1,8) t(i)")
def cubic_roots(spark, sf_dir):
    return _exploded(evaluate(table(spark, sf_dir, "part"), {"v": "t_root(@(x)x^3-p_size^3)"}, None, ["p_partkey"]), ["p_partkey"], "v").withColumn("value", F.round("value", 4) + 0.0)


# -- differential equations --------------------------------------------------------------------------------------
def _ode(df, equation, y0, end, h, method, **k):
    return ode.solve(equation, F.lit(0.0), y0, F.lit(float(end)), h, method, **k)


@_query("SELECT p_partkey, round(p_size*pow(1-2*0.01,100),6) AS y FROM part")
def ode_euler(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", F.round(F.get(_ode(t, "y[1]+2*y[0]", [F.col("p_size")], 1, 0.01, "euler"), F.lit(0)), DIGITS).alias("y"))


@_query("SELECT p_partkey, round(p_size*exp(-2),5) AS y FROM part")
def ode_rk4(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", F.round(F.get(_ode(t, "y[1]+2*y[0]", [F.col("p_size")], 1, 0.01, "rk4"), F.lit(0)), 5).alias("y"))


@_query("SELECT p_partkey, k::INTEGER AS pos, round(k*0.1,6) AS t, round(p_size*pow(1-0.2,k),6) AS y FROM part, range(11) r(k)")
def ode_path(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    rows = ode.path("y[1]+2*y[0]", F.lit(0.0), [F.col("p_size")], F.lit(1.0), 0.1, "euler")
    return t.select("p_partkey", F.posexplode(rows).alias("pos", "r")).select("p_partkey", "pos", F.round(F.get("r", F.lit(0)), DIGITS).alias("t"), F.round(F.get("r", F.lit(1)), DIGITS).alias("y"))


@_query("SELECT p_partkey, round(p_size*cos(3),4) AS y, round(-p_size*sin(3),4) AS v FROM part")
def ode_second_order(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    y = _ode(t, "y[2]+y[0]", [F.col("p_size"), F.lit(0.0)], 3, 0.01, "rk4")
    return t.select("p_partkey", y.alias("s")).select("p_partkey", F.round(F.get("s", F.lit(0)), 4).alias("y"), F.round(F.get("s", F.lit(1)), 4).alias("v"))


@_query("SELECT p_partkey, round(p_size*exp(1)*cos(2),4) AS a, round(p_size*exp(1)*sin(2),4) AS b FROM part")
def ode_system(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    y = _ode(t, ["y[0]-2*y[1]", "2*y[0]+y[1]"], [F.col("p_size"), F.lit(0.0)], 1, 0.005, "rk4")
    return t.select("p_partkey", y.alias("s")).select("p_partkey", F.round(F.get("s", F.lit(0)), 4).alias("a"), F.round(F.get("s", F.lit(1)), 4).alias("b"))


def _stiff(method, digits, h):
    def run(spark, sf_dir):
        t = table(spark, sf_dir, "part")
        return t.select("p_partkey", F.round(F.get(_ode(t, "y[1]+2*y[0]-sin(t)", [F.col("p_size")], 1, h, method), F.lit(0)), digits).alias("y"))

    return run


_EXACT = "(p_size+0.2)*exp(-2)+0.4*sin(1)-0.2*cos(1)"
QUERIES["ode_rk45"] = _stiff("rk45", 5, 0.01)
ORACLE_SQL["ode_rk45"] = f"SELECT p_partkey, round({_EXACT},5) AS y FROM part"
QUERIES["ode_implicit"], QUERIES["ode_bdf2"] = _stiff("implicit_euler", 6, 0.01), _stiff("bdf2", 6, 0.01)
ORACLE_SQL["ode_implicit"] = "WITH RECURSIVE r AS (SELECT p_partkey, 0 AS k, p_size::DOUBLE AS y FROM part UNION ALL SELECT p_partkey, k+1, (y+0.01*sin((k+1)*0.01))/1.02 FROM r WHERE k < 100) SELECT p_partkey, round(y,6) AS y FROM r WHERE k = 100"
ORACLE_SQL["ode_bdf2"] = "WITH RECURSIVE r AS (SELECT p_partkey, 1 AS k, p_size::DOUBLE AS x, (p_size+0.01*sin(0.01))/1.02 AS y FROM part UNION ALL SELECT p_partkey, k+1, y, ((4*y-x)/3+0.02/3*sin((k+1)*0.01))/(1+0.04/3) FROM r WHERE k < 100) SELECT p_partkey, round(y,6) AS y FROM r WHERE k = 100"


@_query("WITH RECURSIVE r AS (SELECT p_partkey, 0 AS k, p_size::DOUBLE AS y FROM part UNION ALL SELECT p_partkey, k+1, y/1.2 FROM r WHERE k < 10) SELECT p_partkey, k::INTEGER AS pos, round(k*0.1,6) AS t, round(y,6) AS y FROM r")
def ode_path_implicit(spark, sf_dir):
    rows = ode.path("y[1]+2*y[0]", F.lit(0.0), [F.col("p_size")], F.lit(1.0), 0.1, "implicit_euler")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(rows).alias("pos", "r")).select("p_partkey", "pos", F.round(F.get("r", F.lit(0)), DIGITS).alias("t"), F.round(F.get("r", F.lit(1)), DIGITS).alias("y"))


@_query("SELECT p_partkey, k::INTEGER AS pos, round(k*0.1,6) AS t, round(p_size*exp(-0.2*k),4) AS y FROM part, range(11) r(k)")
def ode_path_adaptive(spark, sf_dir):
    rows = ode.path("y[1]+2*y[0]", F.lit(0.0), [F.col("p_size")], F.lit(1.0), 0.1, "rk45")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(rows).alias("pos", "r")).select("p_partkey", "pos", F.round(F.get("r", F.lit(0)), DIGITS).alias("t"), F.round(F.get("r", F.lit(1)), 4).alias("y"))


# -- solvers, derivatives and matrices inside formulas
_formulas("round_extremes", {"a": ("roundN(2,p_size*1e20)/1e20", "p_size"), "b": ("roundDigitsN(1,p_size*1e15)/1e15", "round(p_size/pow(10,floor(log10(p_size))))*pow(10,floor(log10(p_size)))"), "c": ("length(p_size*1e20)", "length(p_size::VARCHAR)+20"), "d": ("roundDigitsN(3,p_size*1.23456e-9)*1e9", "round(p_size*1.23456::DECIMAL(12,6)/pow(10,floor(log10(p_size*1.23456))-2)::DECIMAL(12,6))*pow(10,floor(log10(p_size*1.23456))-2)"), "e": ("ceilN(-30,p_size)/1e30", "1")}, "part", ["p_partkey"])
_formulas("root_cycle", {"a": ("root(@(t)t^3-2*t+2,0)", "-1.7692923542386314"), "b": ("root(@(x)atan(x-p_size),p_size+4)", "p_size"), "c": ("root(@(x)x^3-p_size,0,p_size)", "cbrt(p_size)")}, "part", ["p_partkey"])
_formulas("derivative_high", {"a": ("autodiff(@(x)exp(2*x),l_tax,12)", "4096*exp(2*l_tax)"), "b": ("autodiff(@(x)sin(x),l_quantity,9)", "cos(l_quantity)"), "c": ("autodiff(@(x)1/(1+x),l_tax,6)", "720/pow(1+l_tax,7)"), "d": ("diff(f,l_tax,5)", "(5+l_tax)*exp(l_tax)")}, define="f(x)=x*exp(x)")
_formulas("antiderivative", {"a": ("g(l_quantity)", "sin(l_quantity)-l_quantity*cos(l_quantity)"), "b": ("h(l_quantity)", "ln(l_quantity*l_quantity+1)"), "c": ("k(l_tax)", "exp(3*l_tax)/3 + pow(l_tax,4)/4")}, define="g=intg(@(x)x*sin(x));h=intg(@(x)2*x/(x^2+1));k=intg(@(x)exp(3*x)+x^3)")


def _vector_formula(name: str, formula: str, sql: str, n: int, digits: int = DIGITS) -> None:
    QUERIES[name] = lambda spark, d: _exploded(evaluate(table(spark, d, "part"), {"v": formula}, None, ["p_partkey"]), ["p_partkey"], "v").withColumn("value", F.round("value", digits) + 0.0)
    ORACLE_SQL[name] = f"SELECT p_partkey, (i-1)::INTEGER AS pos, round(({sql})[i],{digits})+0.0 AS value FROM part, range(1,{n + 1}) t(i)"


_vector_formula("formula_matrix", "invert(@(2,2)(p_size+3,1,2,4)) + 2*@(2,2)(p_size,1,2,3)*@(2,2)(1,2,3,4) - transpose(@(2,2)(1,2,3,4))^2", "[4/(4*(p_size+3.0)-2)+2*(p_size+3)-7, -1/(4*(p_size+3.0)-2)+2*(2*p_size+4)-15, -2/(4*(p_size+3.0)-2)+22-10, (p_size+3)/(4*(p_size+3.0)-2)+32-22]", 4)
_vector_formula("formula_linear_sys", "linear_sys(2,3,p_size,1,-1,1)", "[(p_size+3)/5.0, (p_size-2)/5.0]", 2)
_vector_formula("formula_ode", 'diffeqn(@(2)("y[2]-y[0]+2*y[1]","y[2]-2*y[0]-y[1]"),0,@(1,2)(p_size,0),1,0.005,rk4)', "[p_size*exp(1)*cos(2), p_size*exp(1)*sin(2)]", 2, 4)
_formulas("formula_ode_scalar", {"a": ("diffeqn(y[1]+2*y[0],0,p_size,1,0.01,rk45)*1", "p_size*exp(-2)"), "b": ("diffeqnHO(y[2]+y[0],0,@(1,2)(1,0),3)", "cos(3)")}, "part", ["p_partkey"])
_vector_formula("formula_rot", "rot(@(2,3)(p_size,0,0,0,1,0),0.5,@(1,3)(0,0,0),@(1,3)(0,0,2))", "[p_size*cos(0.5), p_size*sin(0.5), 0, -sin(0.5), cos(0.5), 0]", 6)


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([1.0,0,2,0,p_size+3,0,0][i],4)+0.0 AS value FROM part, range(1,8) t(i)")
def cubic_general(spark, sf_dir):
    from .operators.roots import cubic_roots

    r = F.col("p_size") + 3.0
    roots = cubic_roots(F.lit(1.0), -(r + 3), 3 * r + 2, -2 * r)
    sorted_ = F.flatten(F.transform(F.array_sort(F.array(*(F.struct(F.get("r", F.lit(k)).alias("re"), F.get("r", F.lit(k + 1)).alias("im")) for k in (0, 2, 4)))), lambda x: F.array(x["re"], x["im"])))
    t = table(spark, sf_dir, "part").select("p_partkey", roots.alias("r"))
    return _exploded(t.select("p_partkey", F.concat(sorted_, F.array(F.get("r", F.lit(6)))).alias("v")), ["p_partkey"], "v").withColumn("value", F.round("value", 4) + 0.0)


@_query("SELECT p_partkey, to_base(p_size, 7) AS b7, to_base(p_size, 16) || '.8' AS h16, p_size::DOUBLE AS back, p_size + 0.5 AS half FROM part")
def base_n(spark, sf_dir):
    from .functions import numbers as N

    p = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.to_base(p, 7).alias("b7"), N.to_base(p + 0.5, 16, 1).alias("h16"), N.from_base(N.to_base(p, 3), 3).alias("back"), N.from_base(N.to_base(p + 0.5, 2, 3), 2).alias("half"))


@_query("SELECT p_partkey, p_size > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 51) r(k) WHERE k < p_size AND p_size % k = 0) AS prime, (p_size // gcd(p_size, 24))::BIGINT AS num, (24 // gcd(p_size, 24))::BIGINT AS den FROM part")
def primes_fractions(spark, sf_dir):
    from .functions import numbers as N

    return table(spark, sf_dir, "part").select("p_partkey", N.is_prime(F.col("p_size").cast("bigint")).alias("prime"), N.fraction(F.col("p_size") / 24.0).alias("f")).select("p_partkey", "prime", "f.num", "f.den")


@_query("SELECT p_partkey, round(p_size*3-4*2.0,6) AS mre, round(p_size*2+4*3.0,6) AS mim, round((p_size*3+8)/13.0,6) AS dre, round((12-p_size*2)/13.0,6) AS dim, round(sqrt(p_size*p_size+16),6) AS size, round(exp(p_size/50.0)*cos(4),6) AS ere, round(p_size*p_size-16.0,4) AS sq FROM part")
def complex_arithmetic(spark, sf_dir):
    from .operators import complexes as C

    a, b = C.make(F.col("p_size").cast("double"), F.lit(4.0)), C.make(F.lit(3.0), F.lit(2.0))
    m, d, e = C.multiply(a, b), C.divide_by(a, b), C.exp(C.make(F.col("p_size") / 50.0, F.lit(4.0)))
    parts = {"mre": m["re"], "mim": m["im"], "dre": d["re"], "dim": d["im"], "size": C.size(a), "ere": e["re"]}
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(c, DIGITS).alias(k) for k, c in parts.items()), F.round(C.power(a, F.lit(2.0))["re"], 4).alias("sq"))


# -- matrices --------------------------------------------------------------------------------------------------------
_CELLS = "SELECT l_suppkey % 40 AS i, l_partkey % 40 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def _cells(spark, sf_dir, swap=False) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    i, j = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    return t.groupBy((j if swap else i).alias("i"), (i if swap else j).alias("j")).agg(F.sum("l_quantity").alias("v"))


@_query(f"WITH a AS ({_CELLS}), b AS (SELECT j AS i, i AS j, v FROM a), u AS (SELECT * FROM a UNION ALL SELECT i, j, -v FROM b) SELECT i, j, sum(v) AS v FROM u GROUP BY 1, 2")
def mat_add_sub(spark, sf_dir):
    return matrix.subtract(_cells(spark, sf_dir), _cells(spark, sf_dir, True))


@_query(f"WITH a AS ({_CELLS}) SELECT x.i, y.j, sum(x.v*y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY 1, 2")
def mat_mul(spark, sf_dir):
    a = _cells(spark, sf_dir)
    return matrix.multiply(a, a)


@_query(f"WITH a AS ({_CELLS}) SELECT j AS i, i AS j, v FROM a")
def mat_transpose(spark, sf_dir):
    return matrix.transpose(_cells(spark, sf_dir))


@_query(f"WITH a AS ({_CELLS}) SELECT i - (i>1)::INT AS i, j - (j>2)::INT AS j, v FROM a WHERE i<>1 AND j<>2")
def mat_minor(spark, sf_dir):
    return matrix.minor(_cells(spark, sf_dir), 1, 2)


@_query(f"WITH a AS ({_CELLS}) SELECT i-1 AS i, j-1 AS j, v FROM a WHERE i>=1 AND j>=1")
def mat_sub(spark, sf_dir):
    return matrix.sub_matrix(_cells(spark, sf_dir), 1, 1)


@_query(f"WITH a AS ({_CELLS}), b AS (SELECT x.i, y.j, sum(x.v*y.v) v FROM a x JOIN a y ON x.j=y.i GROUP BY 1,2), c AS (SELECT x.i, y.j, sum(x.v*y.v) v FROM b x JOIN a y ON x.j=y.i GROUP BY 1,2) SELECT sum(v) AS trace FROM c WHERE i=j")
def mat_trace_power(spark, sf_dir):
    return matrix.trace(matrix.power(_cells(spark, sf_dir), 3, 40))


_M = [["p_size+9", "1", "2"], ["3", "p_size+7", "1"], ["2", "4", "p_size+11"]]
_DET = "((p_size+9)*((p_size+7)*(p_size+11)-4)-1*(3*(p_size+11)-2)+2*(12-2*(p_size+7)))"
_formulas("mat_det3", {"d": (f"det(@(3,3)({','.join(c for r in _M for c in r)}))", _DET)}, "part", ["p_partkey"])


def _structs(spark, sf_dir):
    t, s = table(spark, sf_dir, "part"), Session()
    return t.select("p_partkey", matrix.matrix(3, 3, *(s.compile(c, t.columns) for r in _M for c in r)).alias("m"))


@_query(f"SELECT p_partkey, round({_DET},4) AS d FROM part")
def mat_det_struct(spark, sf_dir):
    return _structs(spark, sf_dir).select("p_partkey", F.round(matrix.determinant(F.col("m")), 4).alias("d"))


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([1.0,2.0,3.0][i],6) AS value FROM part, range(1,4) t(i)")
def mat_solve3(spark, sf_dir):
    t, s = table(spark, sf_dir, "part"), Session()
    cells = [c for r in _M for c in (*r, f"({r[0]})*1+({r[1]})*2+({r[2]})*3")]
    m = matrix.matrix(3, 4, *(s.compile(c, t.columns) for c in cells))
    return _exploded(t.select("p_partkey", matrix.apply("linear_sys", m).alias("x")).select("p_partkey", "x.data"), ["p_partkey"], "data")


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([4.0,-1.0,-2.0,p_size+3.0][i]/(4*(p_size+3.0)-2),6) AS value FROM part, range(1,5) t(i)")
def mat_inverse2(spark, sf_dir):
    t, s = table(spark, sf_dir, "part"), Session()
    m = matrix.matrix(2, 2, *(s.compile(c, t.columns) for c in ("p_size+3", "1", "2", "4")))
    return _exploded(t.select("p_partkey", matrix.apply("invert", m).alias("x")).select("p_partkey", "x.data"), ["p_partkey"], "data")


def _struct_query(name, op, **k):
    QUERIES[name] = lambda spark, d: _exploded(_structs(spark, d).select("p_partkey", matrix.apply(op, F.col("m"), **k).alias("x")).select("p_partkey", "x.data"), ["p_partkey"], "data")


for _op in ("tri_mat", "echelon", "cofactor", "adjoint"):
    _struct_query(f"mat_{_op}", _op)
_struct_query("mat_pow", "matrix_pow", exponent=3)


def _cells_sql(items: str, source: str = "SELECT p_partkey, p_size+9.0 a, p_size+7.0 e, p_size+11.0 k FROM part", digits: int = DIGITS, n: int = 9) -> str:
    return f"WITH m AS ({source}) SELECT p_partkey, (i-1)::INTEGER AS pos, round({items}[i],{digits}) AS value FROM m, range(1,{n + 1}) t(i)"


ORACLE_SQL["mat_cofactor"] = _cells_sql("[e*k-4, 2-3*k, 12-2*e, 8-k, a*k-4, 2-4*a, 1-2*e, 6-a, a*e-3]")
ORACLE_SQL["mat_adjoint"] = _cells_sql("[e*k-4, 8-k, 1-2*e, 2-3*k, a*k-4, 6-a, 12-2*e, 2-4*a, a*e-3]")
ORACLE_SQL["mat_echelon"] = _cells_sql("[a, 1, 2, 0, a*e-3, a-6, 0, 0, (a*e-3)*(a*k-4)-(4*a-2)*(a-6)]")
_TIMES = "[{x}[3*(q//3)+1]*{y}[q%3+1]+{x}[3*(q//3)+2]*{y}[q%3+4]+{x}[3*(q//3)+3]*{y}[q%3+7] for q in range(9)]"
ORACLE_SQL["mat_pow"] = f"WITH m AS (SELECT p_partkey, [p_size+9.0,1,2,3,p_size+7.0,1,2,4,p_size+11.0] AS m FROM part), s AS (SELECT *, {_TIMES.format(x='m', y='m')} AS m2 FROM m), c AS (SELECT *, {_TIMES.format(x='m2', y='m')} AS m3 FROM s) SELECT p_partkey, (i-1)::INTEGER AS pos, round(m3[i],6) AS value FROM c, range(1,10) t(i)"


def _upper(spark, sf_dir):
    """Upper triangular matrices, whose eigenvalues are their diagonals."""
    t, s = table(spark, sf_dir, "part"), Session()
    return t.select("p_partkey", matrix.matrix(3, 3, *(s.compile(c, t.columns) for c in ("p_size+9", "1", "2", "0", "p_size+7.5", "1", "0", "0", "p_size+11"))).alias("m"))


@_query("SELECT p_partkey, (i-1)::INTEGER AS pos, round([p_size+7.5,0,p_size+9,0,p_size+11,0][i],6) AS value FROM part, range(1,7) t(i)")
def mat_eigvalues(spark, sf_dir):
    return _exploded(_upper(spark, sf_dir).select("p_partkey", matrix.apply("eigvalues", F.col("m")).alias("x")).select("p_partkey", "x.data"), ["p_partkey"], "data")


@_query("WITH v AS (SELECT p_partkey, (2+1/3.5)/2 AS x, 1/3.5 AS y FROM part), n AS (SELECT *, sqrt(x*x+y*y+1) AS s FROM v) SELECT p_partkey, (i-1)::INTEGER AS pos, round([-1/sqrt(3.25),1,x/s,1.5/sqrt(3.25),0,y/s,0,0,1/s][i],6)+0.0 AS value FROM n, range(1,10) t(i)")
def mat_eigvec(spark, sf_dir):
    return _exploded(_upper(spark, sf_dir).select("p_partkey", matrix.apply("eigvec", F.col("m")).alias("x")).select("p_partkey", "x.data"), ["p_partkey"], "data").withColumn("value", F.col("value") + 0.0)


ORACLE_SQL["mat_tri_mat"] = "WITH m AS (SELECT p_partkey, p_size+9.0 a, p_size+7.0 e, p_size+11.0 k FROM part), s AS (SELECT *, e-3/a AS e2, 1-6/a AS f2 FROM m) SELECT p_partkey, (i-1)::INTEGER AS pos, round([1.0,1/a,2/a,0,1.0,f2/e2,0,0,1.0][i],6) AS value FROM s, range(1,10) t(i)"


@_query("SELECT p_partkey, '1*n^3-' || (p_size+3) || '*n^2+' || (3*p_size+2) || '*n^1-' || (2*p_size) || '*n^0' AS polynomial FROM part")
def mat_eigpoly(spark, sf_dir):
    t, s = table(spark, sf_dir, "part"), Session()
    return t.select("p_partkey", s.compile("eigpoly(@(3,3)(1,5,6,0,2,7,0,0,p_size))", t.columns).alias("polynomial"))


# -- tensor kernels -----------------------------------------------------------------------------------------------------
_E = "embedding::DOUBLE[]"


def _kernel(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.posexplode(f(F.transform("embedding", lambda x: x.cast("double")))).alias("pos", "v")).withColumn("v", F.round("v", 5) + 0.0)
    ORACLE_SQL[name] = f"WITH e AS (SELECT vec_id, {_E} AS a FROM embeddings), r AS (SELECT vec_id, {sql} AS b FROM e) SELECT vec_id, (i-1)::INTEGER AS pos, round(b[i],5)+0.0 AS v FROM r, range(1, 4097) t(i) WHERE i <= len(b)"


_kernel("vec_relu", lambda a: K.each("relu", a), "list_transform(a, lambda x: greatest(x,0))")
_kernel("vec_silu", lambda a: K.each("silu", a), "list_transform(a, lambda x: x/(1+exp(-x)))")
_kernel("vec_softmax", K.softmax, "list_transform(a, lambda x: exp(x-list_max(a))/list_sum(list_transform(a, lambda y: exp(y-list_max(a)))))")
_kernel("vec_log_softmax", K.log_softmax, "list_transform(a, lambda x: x-ln(list_sum(list_transform(a, lambda y: exp(y)))))")
_kernel("vec_layer_norm", K.layer_norm, "list_transform(a, lambda x: (x-list_avg(a))/sqrt(list_var_pop(a)+1e-5))")
_kernel("vec_rms_norm", K.rms_norm, "list_transform(a, lambda x: x/sqrt(list_avg(list_transform(a, lambda y: y*y))+1e-5))")
_kernel("vec_quantize", lambda a: F.transform(K.quantize(a)["q"], lambda x: x.cast("double")), "list_transform(a, lambda x: greatest(-127,least(127,round(x/(list_max(list_transform(a, lambda y: abs(y)))/127)))))")
_kernel("vec_dequantize", lambda a: K.dequantize(K.quantize(a)), "list_transform(a, lambda x: greatest(-127,least(127,round(x/(list_max(list_transform(a, lambda y: abs(y)))/127))))*(list_max(list_transform(a, lambda y: abs(y)))/127))")
_kernel("vec_axpy", lambda a: K.axpy(F.lit(2.0), a, a), "list_transform(a, lambda x: 3*x)")


@_query(f"SELECT vec_id, round(list_dot_product({_E},{_E}),5) AS d, round(list_max(list_transform({_E}, lambda x: abs(x))),5) AS m, round(list_avg(list_transform({_E}, lambda x: (x-2*x)*(x-2*x))),5) AS mse FROM embeddings")
def vec_dot(spark, sf_dir):
    a = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(K.dot(a, a), 5).alias("d"), F.round(K.absmax(a), 5).alias("m"), F.round(K.loss("mse", a, K.axpy(F.lit(1.0), a, a)), 5).alias("mse"))


_kernel("vec_rope", lambda a: K.rope(a, F.col("vec_id") % 16), "list_transform(range(1, len(a)//2+1), lambda i: a[i]*cos((vec_id%16)/pow(10000,2.0*(i-1)/len(a)))-a[i+len(a)//2]*sin((vec_id%16)/pow(10000,2.0*(i-1)/len(a)))) || list_transform(range(1, len(a)//2+1), lambda i: a[i]*sin((vec_id%16)/pow(10000,2.0*(i-1)/len(a)))+a[i+len(a)//2]*cos((vec_id%16)/pow(10000,2.0*(i-1)/len(a))))")
_DOTS = "[exp((list_dot_product(a,a)-list_dot_product(a,a))/sqrt(len(a))), exp((list_dot_product(a,k2)-list_dot_product(a,a))/sqrt(len(a))), exp((list_dot_product(a,k3)-list_dot_product(a,a))/sqrt(len(a)))]"
ATTENTION = f"WITH e AS (SELECT vec_id, {_E} AS a FROM embeddings), k AS (SELECT *, list_transform(a, lambda x: greatest(x,0)) AS k2, list_transform(a, lambda x: 2*x/3) AS k3 FROM e), w AS (SELECT *, {_DOTS} AS w FROM k), r AS (SELECT vec_id, [(w[1]*a[i]+w[2]*k2[i]+w[3]*k3[i])/list_sum(w) for i in range(1, len(a)+1)] AS b FROM w) SELECT vec_id, (i-1)::INTEGER AS pos, round(b[i],5)+0.0 AS v FROM r, range(1, 4097) t(i) WHERE i <= len(b)"


def _keys(a):
    return F.array(a, K.each("relu", a), F.transform(a, lambda x: 2 * x / 3))


_kernel("vec_attention", lambda a: K.attention(a, _keys(a), _keys(a)), "a")
ORACLE_SQL["vec_attention"] = ATTENTION
_kernel("vec_mha_decode", lambda a: K.mha_decode_step(a, _keys(a), _keys(a), 1), "a")
ORACLE_SQL["vec_mha_decode"] = ATTENTION
_kernel("vec_accum_v", lambda a: K.accum_v(F.array(F.lit(0.25), F.lit(0.5), F.lit(2.0)), _keys(a)), "list_transform(a, lambda x: 0.25*x+0.5*greatest(x,0)+4*x/3)")
_kernel("vec_gemv", lambda a: K.gemv(_keys(a), a), "[list_dot_product(a,a), list_dot_product(a,list_transform(a, lambda x: greatest(x,0))), 2*list_dot_product(a,a)/3]")
_kernel("vec_matmul_swiglu", lambda a: K.matmul_swiglu(_keys(a), _keys(a), a), "list_transform([list_dot_product(a,a), list_dot_product(a,list_transform(a, lambda x: greatest(x,0))), 2*list_dot_product(a,a)/3], lambda y: y*y/(1+exp(-y)))")
_kernel("vec_matmul_add_sin", lambda a: K.matmul_add_sin(_keys(a), a, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))), "[sin(list_dot_product(a,a)+0.1), sin(list_dot_product(a,list_transform(a, lambda x: greatest(x,0)))+0.2), sin(2*list_dot_product(a,a)/3+0.3)]")
_kernel("vec_matmul_bias", lambda a: K.matmul_bias(_keys(a), a, F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0)), "relu"), "[greatest(0,list_dot_product(a,a)-1), greatest(0,list_dot_product(a,list_transform(a, lambda x: greatest(x,0)))-2), greatest(0,2*list_dot_product(a,a)/3-3)]")
_kernel("vec_q8_blocks", lambda a: K.q8_values(K.q8_blocks(a, 16)), "flatten(list_transform(range(1, len(a)+1, 16), lambda s: list_transform(a[s:s+15], lambda x: greatest(-127,least(127,round(x/(list_max(list_transform(a[s:s+15], lambda y: abs(y)))/127))))*(list_max(list_transform(a[s:s+15], lambda y: abs(y)))/127))))")
_kernel("vec_activations", lambda a: F.transform(F.zip_with(K.each("sigmoid", a), F.zip_with(K.each("elu", a), K.each("leaky_relu", a), lambda x, y: x + y), lambda x, y: x + y), lambda x: x), "list_transform(a, lambda x: 1/(1+exp(-x)) + CASE WHEN x>0 THEN 2*x ELSE exp(x)-1+0.01*x END)")


# -- geometry, ranges, registration, streams ---------------------------------------------------------------------------------
@_query("SELECT l_orderkey, l_linenumber, round(l_quantity*cos(0.5)-l_tax*sin(0.5),6) AS x, round(l_quantity*sin(0.5)+l_tax*cos(0.5),6) AS y, round(l_discount,6) AS z FROM lineitem")
def rotate_points(spark, sf_dir):
    x, y, z = geometry.rotate((F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")), F.lit(0.5), (0, 0, 0), (0, 0, 2))
    return table(spark, sf_dir, "lineitem").select(*LINE, F.round(x, DIGITS).alias("x"), F.round(y, DIGITS).alias("y"), F.round(z, DIGITS).alias("z"))


@_query("SELECT round(-1+i*0.01,6) AS x, round(sin(-1+i*0.01)+1,6) AS y FROM range(201) t(i)")
def range_evaluation(spark, sf_dir):
    return _rounded(eval_range(spark, "sin(x)+1", 1, -1, 0.01), {"x", "y"})


@_query("SELECT l_orderkey, l_linenumber, round(l_quantity*0.5+1,6) AS a FROM lineitem")
def registered_function(spark, sf_dir):
    s = Session()
    s.register("halfplus", lambda x: x * 0.5 + 1)
    return _rounded(evaluate(table(spark, sf_dir, "lineitem"), {"a": "halfplus(l_quantity)"}, s, LINE), {"a"})


@_query("SELECT l_returnflag, round(avg(r),3) AS mean, round(stddev_samp(r),3) AS deviation, count(*)::DOUBLE AS n FROM (SELECT l_returnflag, l_extendedprice*(1-l_discount)*(1+l_tax) r FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05) GROUP BY 1")
def flagship(spark, sf_dir):
    """Projection, predicate and statistics in one plan."""
    rows = where(table(spark, sf_dir, "lineitem"), "l_quantity > 25 && l_discount < 0.05")
    got = summarise(rows, ["l_returnflag"], {k: (s, "l_extendedprice*(1-l_discount)*(1+l_tax)") for k, s in (("mean", "avg"), ("deviation", "s_d"), ("n", "count"))})
    return got.select("l_returnflag", F.round("mean", 3).alias("mean"), F.round("deviation", 3).alias("deviation"), "n")


@_query("SELECT p_partkey, true AS a, true AS b, true AS c FROM part")
def random_values(spark, sf_dir):
    """Whether each value is in its range."""
    got = evaluate(table(spark, sf_dir, "part"), {"a": "rnd()", "b": "rnd(10)", "c": "now()"}, None, ["p_partkey"])
    return got.select("p_partkey", F.col("a").between(0, 1).alias("a"), F.col("b").between(0, 10).alias("b"), (F.col("c") > 1.7e18).alias("c"))


@_query("SELECT i, j, true AS whole, true AS inside FROM range(20) a(i), range(30) b(j)")
def random_matrix(spark, sf_dir):
    m = matrix.random_matrix(spark, 9, 20, 30, 7)
    return m.select("i", "j", (F.col("v") == F.floor("v")).alias("whole"), F.col("v").between(1, 9).alias("inside"))

