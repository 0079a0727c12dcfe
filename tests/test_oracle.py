"""A sample of the registered queries against their SQL on the smallest tables; the driver compares all."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
PICKED = ["flagship", "arith_power", "cmp_all", "trig_deg", "factorial_comb_perm", "sig_digits", "length_family", "row_var_sd_sterr_cov", "row_mode", "agg_med", "agg_trimmed_mean", "logical_xor_impl_eq", "series_alert", "series_computed", "diff_symbolic", "integral_per_row", "quadratic_roots", "ode_path", "mat_mul", "mat_minor", "vec_layer_norm", "rotate_points", "range_evaluation", "div_zero_guard", "formula_matrix", "formula_linear_sys", "formula_ode", "formula_rot", "root_cycle", "round_extremes", "derivative_high", "antiderivative", "mat_echelon", "mat_adjoint", "mat_pow", "mat_eigvec", "mat_eigpoly", "vec_rope", "vec_attention", "vec_q8_blocks", "ode_bdf2", "ode_path_adaptive", "cubic_general", "complex_arithmetic", "base_n", "primes_fractions", "random_values", "robust_integral", "series_product"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", PICKED)
def test_query(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "part lineitem events embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()), key=repr)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
