"""Matrix algebra: cell tables (i, j, v) for large matrices, structs (rows, cols, data) for small ones.

Cell tables have long indices from 0 and a double value; absent cells are 0.
A large product is one join and one partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "struct<rows:int,cols:int,data:array<double>>"


# -- cell tables ---------------------------------------------------------------
def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + b, or a - b for sign -1."""
    return a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * sign).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * by).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def power(a: DataFrame, n: int, size: int) -> DataFrame:
    """a^n for n >= 0 by squaring."""
    out, base = None, a
    while n:
        if n & 1:
            out = base if out is None else multiply(out, base)
        n >>= 1
        base = multiply(base, base) if n else base
    return out if out is not None else identity(a.sparkSession, size)


def minor(a: DataFrame, r: int, c: int) -> DataFrame:
    """a without row r and column c, counted from 0."""
    return a.where((F.col("i") != r) & (F.col("j") != c)).select((F.col("i") - (F.col("i") > r).cast("long")).alias("i"), (F.col("j") - (F.col("j") > c).cast("long")).alias("j"), "v")


def sub_matrix(a: DataFrame, r: int, c: int) -> DataFrame:
    """The block from (r, c) on."""
    return a.where((F.col("i") >= r) & (F.col("j") >= c)).select((F.col("i") - r).alias("i"), (F.col("j") - c).alias("j"), "v")


def edit(a: DataFrame, r: int, c: int, value: float) -> DataFrame:
    hit = (F.col("i") == r) & (F.col("j") == c)
    return a.select("i", "j", F.when(hit, F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def swap_rows(a: DataFrame, r: int, s: int) -> DataFrame:
    return a.select(F.when(F.col("i") == r, F.lit(s)).when(F.col("i") == s, F.lit(r)).otherwise(F.col("i")).cast("long").alias("i"), "j", "v")


def swap_cols(a: DataFrame, r: int, s: int) -> DataFrame:
    return transpose(swap_rows(transpose(a), r, s))


def join_rows(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """b below a, which has the given rows."""
    return a.select("i", "j", "v").unionByName(b.select((F.col("i") + rows).alias("i"), "j", "v"))


def join_cols(a: DataFrame, b: DataFrame, cols: int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", (F.col("j") + cols).alias("j"), "v"))


def row(a: DataFrame, r: int) -> DataFrame:
    return a.where(F.col("i") == r)


def column(a: DataFrame, c: int) -> DataFrame:
    return a.where(F.col("j") == c)


def delete_rows(a: DataFrame, r: int, count: int = 1) -> DataFrame:
    return a.where((F.col("i") < r) | (F.col("i") >= r + count)).select((F.col("i") - F.when(F.col("i") >= r, count).otherwise(0)).cast("long").alias("i"), "j", "v")


def delete_cols(a: DataFrame, c: int, count: int = 1) -> DataFrame:
    return transpose(delete_rows(transpose(a), c, count))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def random_matrix(spark, n: int, rows: int, cols: int, seed: int = 0) -> DataFrame:
    """Whole numbers from 1 to n."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), (F.floor(F.rand(seed) * n) + 1).cast("double").alias("v"))


# -- structs ---------------------------------------------------------------------
def matrix(rows: int, cols: int, *cells: Column) -> Column:
    return F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.array(*cells).alias("data"))


def triangular(m: np.ndarray) -> np.ndarray:
    """Unit upper-triangular form, rows swapped where a pivot is 0."""
    m = m.astype(float).copy()
    for k in range(min(m.shape)):
        if m[k, k] == 0:
            below = np.flatnonzero(m[k:, k])
            if not len(below):
                continue
            m[[k, k + below[0]]] = m[[k + below[0], k]]
        m[k] = m[k] / m[k, k]
        m[k + 1 :] -= np.outer(m[k + 1 :, k], m[k])
    return m


def echelon(m: np.ndarray) -> np.ndarray:
    """Row echelon form without divisions: each row below is cross-multiplied with the pivot's."""
    m = m.astype(float).copy()
    for k in range(min(m.shape)):
        if m[k, k] == 0:
            below = np.flatnonzero(m[k:, k])
            if not len(below):
                continue
            m[[k, k + below[0]]] = m[[k + below[0], k]]
        for i in range(k + 1, m.shape[0]):
            if m[i, k]:
                m[i] = m[k, k] * m[i] - m[i, k] * m[k]
    return m


def cofactors(m: np.ndarray) -> np.ndarray:
    n = len(m)
    keep = lambda k: [x for x in range(n) if x != k]
    return np.array([[(-1) ** (i + j) * (np.linalg.det(m[np.ix_(keep(i), keep(j))]) if n > 1 else 1.0) for j in range(n)] for i in range(n)])


def eigenvalues(m: np.ndarray) -> np.ndarray:
    """n x 2 of real and imaginary parts, ascending by both."""
    e = np.linalg.eigvals(m)
    e = e[np.lexsort((e.imag, e.real))]
    return np.stack([e.real, e.imag], 1)


def eigenvectors(m: np.ndarray) -> np.ndarray:
    """Columns of unit length in the order of the eigenvalues, greatest component positive."""
    e, v = np.linalg.eig(m)
    v = np.real(v[:, np.lexsort((e.imag, e.real))])
    top = np.argmax(np.abs(v), axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1, 1)


def _solve(m: np.ndarray) -> np.ndarray:
    return np.linalg.solve(m[:, :-1], m[:, -1])[:, None]


UNARY = {"invert": np.linalg.inv, "transpose": np.transpose, "tri_mat": triangular, "echelon": echelon, "cofactor": cofactors, "adjoint": lambda m: cofactors(m).T, "eigvalues": eigenvalues, "eigvec": eigenvectors, "linear_sys": _solve}
BINARY = {"matrix_add": np.add, "matrix_sub": np.subtract, "matrix_mul": np.matmul, "matrix_div": lambda a, b: a @ np.linalg.inv(b)}


def _stacked_eigenvalues(m: np.ndarray) -> np.ndarray:
    e = np.linalg.eigvals(m)
    order = np.lexsort((e.imag, e.real), axis=-1)
    e = np.take_along_axis(e, order, -1)
    return np.stack([e.real, e.imag], -1)


def _stacked_cofactors(m: np.ndarray) -> np.ndarray:
    n = m.shape[1]
    out = np.ones((len(m), n, n))
    for i in range(n if n > 1 else 0):
        for j in range(n):
            out[:, i, j] = (-1) ** (i + j) * np.linalg.det(m[:, [x for x in range(n) if x != i]][:, :, [x for x in range(n) if x != j]])
    return out


def _pivoted(m: np.ndarray, k: int) -> np.ndarray:
    """Rows swapped where pivot k is 0; the matrices that have one then."""
    zero = np.flatnonzero(m[:, k, k] == 0)
    below = k + np.argmax(m[zero, k:, k] != 0, axis=1)
    m[zero, k], m[zero, below] = m[zero, below].copy(), m[zero, k].copy()
    return np.flatnonzero(m[:, k, k] != 0)


def _stacked_triangular(m: np.ndarray) -> np.ndarray:
    m = m.copy()
    for k in range(min(m.shape[1:])):
        at = _pivoted(m, k)
        m[at, k] = m[at, k] / m[at, k, k][:, None]
        m[at, k + 1 :] -= m[at, k + 1 :, k][:, :, None] * m[at, k][:, None, :]
    return m


def _stacked_echelon(m: np.ndarray) -> np.ndarray:
    m = m.copy()
    for k in range(min(m.shape[1:])):
        at = _pivoted(m, k)
        for i in range(k + 1, m.shape[1]):
            on = at[m[at, i, k] != 0]
            m[on, i] = m[on, k, k][:, None] * m[on, i] - m[on, i, k][:, None] * m[on, k]
    return m


def _stacked_eigenvectors(m: np.ndarray) -> np.ndarray:
    e, v = np.linalg.eig(m)
    v = np.real(np.take_along_axis(v, np.lexsort((e.imag, e.real), axis=-1)[:, None, :], -1))
    top = np.take_along_axis(v, np.argmax(np.abs(v), axis=1)[:, None, :], 1)
    return v * np.where(top < 0, -1, 1)


#: Functions of whole stacks (rows of a batch, rows, columns).
STACKED = {
    "invert": np.linalg.inv, "transpose": lambda m: np.swapaxes(m, 1, 2), "eigvalues": _stacked_eigenvalues, "eigvec": _stacked_eigenvectors, "linear_sys": lambda m: np.linalg.solve(m[:, :, :-1], m[:, :, -1:]),
    "tri_mat": _stacked_triangular, "echelon": _stacked_echelon, "cofactor": _stacked_cofactors, "adjoint": lambda m: np.swapaxes(_stacked_cofactors(m), 1, 2),
    "matrix_add": np.add, "matrix_sub": np.subtract, "matrix_mul": np.matmul, "matrix_div": lambda a, b: a @ np.linalg.inv(b),
}


def _stacks(given: tuple[pa.StructArray, ...]):
    """(positions, stacks) of the rows whose matrices have the same shapes; rows without a matrix, or with too many or too few cells, are in none."""
    fits, shapes, cells = np.ones(len(given[0]), bool), [], []
    for c in given:
        rows, cols = (pc.fill_null(pc.struct_field(c, k), -1).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("rows", "cols"))
        data = pc.struct_field(c, "data")
        size = pc.fill_null(pc.list_value_length(data), -1).to_numpy(zero_copy_only=False)
        flat = data.flatten().to_numpy(zero_copy_only=False).astype(float)
        fits &= (rows >= 0) & (cols >= 0) & (size == rows * cols)
        shapes += [rows, cols]
        cells.append((np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), flat))
    table, places = np.stack(shapes, 1), np.flatnonzero(fits)
    while len(places):
        shape = table[places[0]]
        same = (table[places] == shape).all(axis=1)
        at, places = places[same], places[~same]
        yield at, [flat[start[at][:, None] + np.arange(shape[2 * k] * shape[2 * k + 1])].reshape(len(at), *shape[2 * k : 2 * k + 2]) for k, (start, flat) in enumerate(cells)]


def _computed(whole, op, given: tuple[pa.StructArray, ...]):
    """(positions, stack of results) for all rows that have one; none where a matrix is singular or ill-shaped."""
    for at, stacks in _stacks(given):
        if whole:
            try:
                yield at, whole(*stacks)
                continue
            except (np.linalg.LinAlgError, ValueError):
                pass  # at least one has no result: each by itself
        for i in range(len(at)):
            try:
                yield at[i : i + 1], op(*(s[i] for s in stacks))[None]
            except (np.linalg.LinAlgError, ValueError):
                pass


def apply(name: str, *matrices: Column, exponent: int | None = None) -> Column:
    """A struct function by name; singular or ill-shaped inputs give an empty matrix."""
    power_ = lambda m: np.linalg.matrix_power(m, int(exponent))
    op = power_ if name == "matrix_pow" else UNARY.get(name) or BINARY[name]
    whole = power_ if name == "matrix_pow" else STACKED.get(name)

    @F.arrow_udf(TYPE)
    def run(*given: pa.Array) -> pa.Array:
        got, shape = list(_computed(whole, op, given)), np.zeros((len(given[0]), 2), np.int32)
        for at, m in got:
            shape[at] = m.shape[1:]
        size = shape[:, 0].astype(np.int64) * shape[:, 1]
        ends = np.cumsum(size)
        cells = np.zeros(int(size.sum()))
        for at, m in got:
            cells[(ends - size)[at][:, None] + np.arange(m.shape[1] * m.shape[2])] = m.reshape(len(at), -1)
        data = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(cells))
        return pa.StructArray.from_arrays([pa.array(shape[:, 0].copy()), pa.array(shape[:, 1].copy()), data], ["rows", "cols", "data"])

    return run(*matrices)


def determinant(m: Column) -> Column:
    """Null for what is not square."""

    @F.arrow_udf("double")
    def det(a: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        for at, (stack,) in _stacks((a,)):
            if stack.shape[1] == stack.shape[2]:
                out[at] = np.linalg.det(stack)
        return pa.array(out, from_pandas=True)

    return det(m)


def characteristic(m: Column) -> Column:
    """The characteristic polynomial as text."""

    @F.pandas_udf("string")
    def poly(a: pd.DataFrame) -> pd.Series:
        show = lambda c: "".join(f"{'+' if v >= 0 else ''}{v:.12g}*n^{len(c) - 1 - k}" for k, v in enumerate(c) if abs(v) > 1e-12).lstrip("+")
        return pd.Series([show(np.poly(np.asarray(d, float).reshape(r, c))) for r, c, d in zip(a["rows"], a["cols"], a["data"], strict=True)])

    return poly(m)


def parse_system(text: str) -> list[list[float]]:
    """'2x+3*(y-1)=5; x-y=1' as an augmented matrix, unknowns in the order of their names; each side is linear in them."""
    from ..plans.antiderive import polynomial
    from ..plans.numeric import evaluate
    from ..plans.simplify import simplify
    from ..plans.tree import Num, call, substitute, variables
    from ..session import Session

    s, rows = Session(), []
    for eq in filter(None, (e.strip() for e in text.split(";"))):
        left, right = eq.split("=")
        node = simplify(call("-", s.bind(s.parse(left)), s.bind(s.parse(right))))
        terms = {}
        for name in variables(node):
            p = polynomial(node, name)
            if p is None or len(p) > 2 or any(variables(c) for c in p[1:]):
                raise ValueError(f"{eq!r} is not linear in {name}")
            terms[name] = float(evaluate(p[1], {})) if len(p) > 1 else 0.0
        rows.append((terms, float(evaluate(simplify(substitute(node, {n: Num(0.0) for n in terms})), {}))))
    names = sorted({n for terms, _ in rows for n in terms})
    return [[terms.get(n, 0.0) for n in names] + [0.0 - rest] for terms, rest in rows]
