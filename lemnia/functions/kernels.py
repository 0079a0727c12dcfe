"""Tensor kernels over array columns (one row of a tensor per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import let
from .scalar import SIMPLE


def each(name: str, a: Column) -> Column:
    """An elementwise function: relu, gelu, silu, sigmoid, mish, elu, leaky_relu, swiglu, geglu, .."""
    return F.transform(a, lambda x: SIMPLE[name](x.cast("double")))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def axpy(k: Column, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: k * a + b)


def softmax(a: Column) -> Column:
    shifted = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(a: Column) -> Column:
    return let(F.array_max(a).cast("double"), lambda m: let(F.ln(total(F.transform(a, lambda x: F.exp(x - m)))) + m, lambda z: F.transform(a, lambda x: x - z)))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    n = F.size(a)
    return let(total(a) / n, lambda m: let(F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / n + eps), lambda s: F.transform(a, lambda x: (x - m) / s)))


def rms_norm(a: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(dot(a, a) / F.size(a) + eps), lambda s: F.transform(a, lambda x: x / s))


def absmax(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def quantize(a: Column) -> Column:
    """(scale, whole numbers -127 to 127)."""
    return let(absmax(a) / 127, lambda s: F.struct(s.alias("scale"), F.transform(a, lambda x: F.when(s == 0, F.lit(0)).otherwise(F.least(F.lit(127), F.greatest(F.lit(-127), F.round(x.cast("double") / F.when(s == 0, F.lit(1.0)).otherwise(s)).cast("int"))))).alias("q")))


def dequantize(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x * q["scale"])


def rope(a: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary embedding: halves of the vector are the two coordinates of each pair."""
    half = (F.size(a) / 2).cast("int")
    angle = lambda i: position / F.pow(F.lit(base), 2.0 * i / F.size(a))
    first = F.transform(F.slice(a, F.lit(1), half), lambda x, i: x * F.cos(angle(i)) - F.get(a, i + half) * F.sin(angle(i)))
    second = F.transform(F.slice(a, half + 1, half), lambda y, i: F.get(a, i) * F.sin(angle(i)) + y * F.cos(angle(i)))
    return F.concat(first, second)


def attention(q: Column, keys: Column, values: Column) -> Column:
    """One query against arrays of keys and values."""
    weights = softmax(F.transform(keys, lambda k: dot(q, k) / F.sqrt(F.size(q).cast("double"))))
    return accum_v(weights, values)


def gemv(rows: Column, x: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, x))


def matmul_bias(rows: Column, x: Column, bias: Column, activation: str | None = None) -> Column:
    y = F.zip_with(gemv(rows, x), bias, lambda a, b: a + b)
    return each(activation, y) if activation else y


def reduce(name: str, a: Column) -> Column:
    return {"sum": total, "mean": lambda v: total(v) / F.size(v), "prod": lambda v: F.aggregate(v, F.lit(1.0), lambda s, x: s * x), "max": F.array_max, "min": F.array_min}[name](a)


def loss(name: str, a: Column, b: Column) -> Column:
    f = {"mse": lambda x, y: (x - y) * (x - y), "mae": lambda x, y: F.abs(x - y), "cross_entropy": lambda p, t: -t * F.ln(F.greatest(p, F.lit(1e-15)))}[name]
    s = total(F.zip_with(a, b, f))
    return s if name == "cross_entropy" else s / F.size(a)


def accum_v(weights: Column, values: Column) -> Column:
    """The sum of the value vectors, each by its weight."""
    zero = F.transform(F.get(values, F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate(F.zip_with(weights, values, lambda w, v: F.transform(v, lambda x: w * x)), zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def mha_decode_step(q: Column, keys: Column, values: Column, heads: int) -> Column:
    """One token's query against cached keys and values, head by head; the heads' results in a row."""

    def head(h: Column) -> Column:
        width = (F.size(q) / heads).cast("int")
        part = lambda v: F.slice(v, h * width + 1, width)
        return attention(part(q), F.transform(keys, part), F.transform(values, part))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), head))


def matmul_swiglu(gate: Column, up: Column, x: Column) -> Column:
    """silu(gate x) times (up x), elementwise."""
    return F.zip_with(each("silu", gemv(gate, x)), gemv(up, x), lambda a, b: a * b)


def matmul_add_sin(rows: Column, x: Column, bias: Column) -> Column:
    return F.transform(F.zip_with(gemv(rows, x), bias, lambda a, b: a + b), F.sin)


def q8_blocks(a: Column, size: int = 32) -> Column:
    """Blocks of (scale, whole numbers -127 to 127), the last one as short as it is."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a)), F.lit(size))
    return F.transform(F.filter(starts, lambda i: i <= F.size(a)), lambda i: quantize(F.slice(a, i, size)))


def q8_values(blocks: Column) -> Column:
    return F.flatten(F.transform(blocks, dequantize))
