"""Vectors as arrays, and their codec."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, from the left; null where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


@F.arrow_udf(T.BinaryType())
def _packed(vectors: pa.Array) -> pa.Array:
    """Little-endian 32-bit floats of each vector."""
    ends = np.append(0, 4 * np.cumsum(pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)))
    values = vectors.flatten().cast(pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
    out = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
    return pc.if_else(vectors.is_valid(), out, None)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unpacked(raw: pa.Array) -> pa.Array:
    fine = pc.fill_null(pc.and_(pc.greater(pc.binary_length(raw), 0), pc.equal(pc.bit_wise_and(pc.binary_length(raw), 3), 0)), False)
    whole = pc.if_else(fine, raw, None)
    ends = np.append(0, np.cumsum(pc.binary_length(whole).fill_null(0).to_numpy(zero_copy_only=False) // 4)).astype(np.int32)
    values = np.frombuffer(b"".join(x for x in whole.to_pylist() if x), "<f4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float32()), mask=pc.invert(fine))


def encoded(vector: Column | str) -> Column:
    """Base64 of little-endian 32-bit floats."""
    return F.base64(_packed(vector))


def decoded(text: Column | str) -> Column:
    """The vector of such a text; null for texts that are none."""
    return _unpacked(F.try_to_binary(F.col(text) if isinstance(text, str) else text, F.lit("base64")))
