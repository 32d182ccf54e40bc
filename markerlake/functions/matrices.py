"""Dense matrices as columns: struct(nrows, ncols, data), row by row; a 1x1 matrix acts as a scalar in products.

Element-wise work, products and transposes are array expressions. Decompositions are pandas UDFs that take a batch of
matrices at a time; a singular or misshapen matrix gives null. Spark cannot run them over an expression with
higher-order functions, such as a product: make that a column of the frame first.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import bound

TYPE = T.StructType([T.StructField("nrows", T.IntegerType()), T.StructField("ncols", T.IntegerType()), T.StructField("data", T.ArrayType(T.DoubleType()))])
SVD_TYPE = T.StructType([T.StructField("u", TYPE), T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("v", TYPE)])
EPS = 1e-8


def matrix(nrows, ncols, data: Column) -> Column:
    as_col = lambda n: n if isinstance(n, Column) else F.lit(n)
    return F.struct(as_col(nrows).cast("int").alias("nrows"), as_col(ncols).cast("int").alias("ncols"), data.cast("array<double>").alias("data"))


def identity(n: int) -> Column:
    return matrix(n, n, F.array(*(F.lit(float(i == j)) for i in range(n) for j in range(n))))


def zeros(nrows: int, ncols: int) -> Column:
    return matrix(nrows, ncols, F.array_repeat(F.lit(0.0), nrows * ncols))


def get(m: Column, row, col) -> Column:
    return F.get(m["data"], F.lit(row) * m["ncols"] + F.lit(col))


@bound
def put(m: Column, row: int, col: int, value: Column) -> Column:
    at = F.lit(row) * m["ncols"] + F.lit(col)
    return matrix(m["nrows"], m["ncols"], F.transform(m["data"], lambda v, i: F.when(i == at, value).otherwise(v)))


@bound
def select(m: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    """Rows r0..r1 and columns c0..c1, ends included."""
    rows = F.flatten(F.transform(F.sequence(F.lit(r0), F.lit(r1)), lambda r: F.slice(m["data"], r * m["ncols"] + c0 + 1, F.lit(c1 - c0 + 1))))
    return matrix(r1 - r0 + 1, c1 - c0 + 1, rows)


@bound
def _each(a: Column, b: Column, f) -> Column:
    same = (a["nrows"] == b["nrows"]) & (a["ncols"] == b["ncols"])
    return F.when(same, matrix(a["nrows"], a["ncols"], F.zip_with(a["data"], b["data"], f)))


def add(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _each(a, b, lambda x, y: x - y)


@bound
def scale(a: Column, s) -> Column:
    return matrix(a["nrows"], a["ncols"], F.transform(a["data"], lambda x: x * s))


@bound
def transpose(a: Column) -> Column:
    n = a["nrows"] * a["ncols"]
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a["data"], (i % a["nrows"]) * a["ncols"] + F.floor(i / a["nrows"]).cast("int")))
    return matrix(a["ncols"], a["nrows"], moved)


@bound
def multiply(a: Column, b: Column) -> Column:
    """a b; a 1x1 side scales the other; null where the shapes do not meet."""
    def cell(i: Column) -> Column:
        r, c = F.floor(i / b["ncols"]).cast("int"), i % b["ncols"]
        return F.aggregate(F.sequence(F.lit(0), a["ncols"] - 1), F.lit(0.0), lambda s, k: s + F.get(a["data"], r * a["ncols"] + k) * F.get(b["data"], k * b["ncols"] + c))

    product = matrix(a["nrows"], b["ncols"], F.transform(F.sequence(F.lit(0), a["nrows"] * b["ncols"] - 1), cell))
    one = lambda m: (m["nrows"] == 1) & (m["ncols"] == 1)
    return F.when(one(a), scale(b, get(a, 0, 0))).when(one(b), scale(a, get(b, 0, 0))).when(a["ncols"] == b["nrows"], product)


def largest(a: Column) -> Column:
    return F.array_max(a["data"])


@bound
def err_inf(a: Column, b: Column) -> Column:
    """Largest absolute difference."""
    return F.array_max(F.zip_with(a["data"], b["data"], lambda x, y: F.abs(x - y)))


@bound
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@bound
def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@bound
def distance(a: Column, b: Column) -> Column:
    return magnitude(subtract(a, b))


@bound
def normalize(a: Column) -> Column:
    return scale(a, 1 / magnitude(a))


@bound
def cross(a: Column, b: Column) -> Column:
    x, y = ([F.get(m["data"], F.lit(k)) for k in range(3)] for m in (a, b))
    return matrix(3, 1, F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]))


def _arrays(frame: pd.DataFrame):
    for r, c, d in zip(frame["nrows"], frame["ncols"], frame["data"]):
        yield None if d is None or r is None or len(d) != r * c else np.asarray(d, float).reshape(int(r), int(c))


def _row(m: np.ndarray | None) -> tuple:
    return (None, None, None) if m is None else (m.shape[0], m.shape[1], m.ravel().tolist())


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame([_row(m) for m in rows], columns=["nrows", "ncols", "data"]).astype({"nrows": "Int32", "ncols": "Int32"})


def _try(f, *args):
    try:
        return f(*args)
    except (np.linalg.LinAlgError, ValueError, TypeError):
        return None


def _inverse(m):
    if m is None or m.shape[0] != m.shape[1] or abs(np.linalg.det(m)) == 0:
        return None
    return np.linalg.inv(m)


@F.pandas_udf(T.DoubleType())
def det(m: pd.DataFrame) -> pd.Series:
    return pd.Series([_try(lambda a: float(np.linalg.det(a)), a) for a in _arrays(m)], dtype="float64")


@F.pandas_udf(TYPE)
def inverse(m: pd.DataFrame) -> pd.DataFrame:
    return _frame(_try(_inverse, a) for a in _arrays(m))


@F.pandas_udf(TYPE)
def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """x of a x = b."""
    return _frame(_try(np.linalg.solve, x, y) for x, y in zip(_arrays(a), _arrays(b)))


@F.pandas_udf(TYPE)
def chol(m: pd.DataFrame) -> pd.DataFrame:
    """Upper u with u' u = m, for a symmetric positive definite m."""
    return _frame(_try(lambda x: np.linalg.cholesky(x).T, a) for a in _arrays(m))


@F.pandas_udf(SVD_TYPE)
def svd(m: pd.DataFrame) -> pd.DataFrame:
    """u, falling singular values, and v, with u diag(s) v' = m."""
    out = []
    for a in _arrays(m):
        got = None if a is None else _try(np.linalg.svd, a, False)
        keys = ("nrows", "ncols", "data")
        out.append((dict(zip(keys, _row(None))), None, dict(zip(keys, _row(None)))) if got is None else (dict(zip(keys, _row(got[0]))), got[1].tolist(), dict(zip(keys, _row(got[2].T)))))
    return pd.DataFrame(out, columns=["u", "s", "v"])


def scalar(v) -> Column:
    """A 1x1 matrix."""
    return matrix(1, 1, F.array(v if isinstance(v, Column) else F.lit(float(v))))


def get_scalar(m: Column) -> Column:
    return get(m, 0, 0)


@bound
def set_data(m: Column, data: Column) -> Column:
    """m with other numbers; null where their count does not fit."""
    return F.when(F.size(data) == m["nrows"] * m["ncols"], matrix(m["nrows"], m["ncols"], data))


def is_scalar(m: Column) -> Column:
    return (m["nrows"] == 1) & (m["ncols"] == 1)


def is_vector(m: Column) -> Column:
    return (m["nrows"] == 1) | (m["ncols"] == 1)


def is_vector_len(m: Column, n: int) -> Column:
    return is_vector(m) & (m["nrows"] * m["ncols"] == n)


@bound
def distance_n(a: Column, b: Column, n: int) -> Column:
    """Distance over the first n numbers."""
    d = F.zip_with(F.slice(a["data"], 1, n), F.slice(b["data"], 1, n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


@bound
def largest_at(m: Column, row: int, columns: int) -> Column:
    """Column of the largest magnitude off the diagonal among the first columns of a row; -1 if there is none."""
    line = F.transform(F.slice(m["data"], F.lit(row) * m["ncols"] + 1, F.lit(columns)), lambda v, j: F.when(j == row, F.lit(-1.0)).otherwise(F.abs(v)))
    return F.when(F.array_max(line) >= 0, F.array_position(line, F.array_max(line)) - 1).otherwise(F.lit(-1)).cast("int")


PLU_TYPE = T.StructType([T.StructField(n, TYPE) for n in ("p", "l", "u")])


def _plu(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, l and u with m = p l u: elimination by rows, the largest of a column first."""
    rows, cols = m.shape
    u, order, n = m.astype(float).copy(), np.arange(rows), min(rows, cols)
    low = np.zeros((rows, n))
    for k in range(n):
        best = k + int(np.abs(u[k:, k]).argmax())
        for a in (u, low, order):
            a[[k, best]] = a[[best, k]]
        low[k, k] = 1
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    p = np.zeros((rows, rows))
    p[order, np.arange(rows)] = 1
    return p, low, np.triu(u[:n])


@F.pandas_udf(PLU_TYPE)
def plu(m: pd.DataFrame) -> pd.DataFrame:
    """p, l and u with p l u = m."""
    keys, out = ("nrows", "ncols", "data"), []
    for a in _arrays(m):
        out.append([dict(zip(keys, _row(x))) for x in (_plu(a) if a is not None else (None,) * 3)])
    return pd.DataFrame(out, columns=["p", "l", "u"])


@bound
def _diagonal_product(m: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), m["ncols"] - 1), F.lit(1.0), lambda s, k: s * F.get(m["data"], k * m["ncols"] + k))


@bound
def plu_det(f: Column) -> Column:
    """The determinant from a factored matrix; the sign is that of its permutation."""
    order = F.transform(F.sequence(F.lit(0), f["p"]["ncols"] - 1), lambda c: F.array_position(F.transform(F.sequence(F.lit(0), f["p"]["nrows"] - 1), lambda r: F.get(f["p"]["data"], r * f["p"]["ncols"] + c)), F.lit(1.0)))

    def sign(o: Column) -> Column:
        swaps = F.aggregate(F.transform(o, lambda x, i: F.size(F.filter(F.slice(o, 1, i), lambda y: y > x))), F.lit(0), lambda s, x: s + x)
        return F.when(swaps % 2 == 0, 1.0).otherwise(-1.0)

    return F.get(F.transform(F.array(order), sign), F.lit(0)) * _diagonal_product(f["u"])


def _triangular(m, b, lower: bool, turned: bool = False):
    if m is None or b is None or m.shape[0] != m.shape[1] or m.shape[0] != b.shape[0] or (np.diag(m) == 0).any():
        return None
    return np.linalg.solve((np.tril(m).T if turned else np.tril(m)) if lower else np.triu(m), b)


@F.pandas_udf(TYPE)
def solve_lower(l: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
    """x of l x = b; what stands above the diagonal of l is ignored."""
    return _frame(_triangular(x, y, True) for x, y in zip(_arrays(l), _arrays(b)))


@F.pandas_udf(TYPE)
def solve_lower_transposed(l: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
    """x of l' x = b."""
    return _frame(_triangular(x, y, True, True) for x, y in zip(_arrays(l), _arrays(b)))


@F.pandas_udf(TYPE)
def solve_upper(u: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """x of u x = b; what stands below the diagonal of u is ignored."""
    return _frame(_triangular(x, y, False) for x, y in zip(_arrays(u), _arrays(b)))


def _frames(f: pd.DataFrame, name: str) -> pd.DataFrame:
    return pd.DataFrame([r if r is not None else dict.fromkeys(("nrows", "ncols", "data")) for r in f[name]])


@F.pandas_udf(TYPE)
def plu_solve(f: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """x of m x = b from the factors of m."""
    parts = zip(*(_arrays(_frames(f, n)) for n in ("p", "l", "u")), _arrays(b))
    return _frame(None if p is None or y is None else _triangular(u, _try(_triangular, low, p.T @ y, True), False) for p, low, u, y in parts)


@F.pandas_udf(TYPE)
def chol_solve(u: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """x of m x = b from the upper Cholesky factor of m."""
    return _frame(None if x is None else _triangular(x, _triangular(x.T, y, True), False) for x, y in zip(_arrays(u), _arrays(b)))


@F.pandas_udf(TYPE)
def chol_inverse(u: pd.DataFrame) -> pd.DataFrame:
    """The inverse of a matrix from its upper Cholesky factor."""
    return _frame(None if x is None else _triangular(x, _triangular(x.T, np.eye(len(x)), True), False) for x in _arrays(u))


def evaluate(expression: str, *args: Column) -> Column:
    """A matrix expression over the arguments in order of their letters M (or F): products by * or side by side, sums,
    differences, parentheses, ' for the transpose, ^-1 for the inverse, and numbers as scalars. Built as a column."""
    tokens = re.findall(r"\^-1|[MF'()+*-]|\d+(?:\.\d+)?", expression)
    if "".join(tokens) != re.sub(r"\s", "", expression):
        raise ValueError(f"unknown characters in {expression!r}")
    given, at = list(args), 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom() -> Column:
        t = take() if peek() else None
        if t == "(":
            m = total()
            if peek() != ")":
                raise ValueError("missing )")
            take()
        elif t in ("M", "F"):
            if not given:
                raise ValueError("too few matrices")
            m = given.pop(0)
        elif t == "-":
            return scale(product(), -1.0)
        elif t and t[0].isdigit():
            m = matrix(1, 1, F.array(F.lit(float(t))))
        else:
            raise ValueError(f"unexpected {t or 'end'}")
        while peek() in ("'", "^-1"):
            m = transpose(m) if take() == "'" else inverse(m)
        return m

    def product() -> Column:
        m = atom()
        while (t := peek()) and (t in "*MF(" or t[0].isdigit()):
            if t == "*":
                take()
            m = multiply(m, atom())
        return m

    def total() -> Column:
        m = product()
        while peek() in ("+", "-"):
            m = add(m, product()) if take() == "+" else subtract(m, product())
        return m

    found = total()
    if peek() or given:
        raise ValueError("matrices or characters are left over")
    return found
