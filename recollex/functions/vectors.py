"""Expressions over vectors and scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products as doubles, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str) -> Column:
    """Unit length; the zero vector stays zero."""
    n = norm(a) + F.lit(1e-8)
    return F.transform(a, lambda x: x.cast("double") / n)


def half(a: Column | str) -> Column:
    """Rounded to 11 significant bits in the range of half floats (ties to even), without leaving the JVM: values keep
    their exponent; below the least normal one the step is fixed."""

    def rounded(x: Column) -> Column:
        x = x.cast("double")
        e = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
        step = F.pow(F.lit(2.0), e - 10)
        return F.when(x == 0, x).when(F.abs(x) >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(F.rint(x / step) * step).cast("float")

    return F.transform(a, rounded)


def pack_half(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with the vector as bytes: two a component, little-endian half floats (ties to even); null for a null vector or
    one with a null component. A quarter of the memory of doubles, half of floats, in files and shuffles alike."""

    def run(batches):
        for b in batches:
            v = b.column(vector)
            flat, lengths = v.flatten(), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                raw = flat.to_numpy(zero_copy_only=False).astype(np.float64).astype("<f2").tobytes()
            gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            ends = np.cumsum(lengths)
            packed = [None if null or gaps[e] != gaps[e - n] else raw[2 * (e - n) : 2 * e] for null, n, e in zip(v.is_null().to_pylist(), lengths, ends, strict=True)]
            yield b.set_column(b.schema.get_field_index(vector), vector, pa.array(packed, pa.binary()))

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {'binary' if f.name == vector else f.dataType.simpleString()}" for f in df.schema))


def unpack_half(vectors: pa.Array, n: int) -> np.ndarray:
    """A matrix of a column that pack_half() made."""
    return np.frombuffer(b"".join(vectors.to_pylist()), dtype="<f2").reshape(n, -1).astype(np.float64)


def decayed(score: Column, age: Column, rate: float) -> Column:
    """Exponential decay by age in seconds; what is in the future doesn't decay. Negative scores move towards 0, too."""
    return score * F.exp(F.lit(-rate) * F.greatest(F.lit(0.0), age))


def rounded(x: Column, digits: int = 6) -> Column:
    """F.round(x, digits), bit by bit, for columns of very many rows: decimals, which are slow, are only made near ties and for
    large numbers. Elsewhere the error of the product is below the distance to the next tie."""
    up = x * F.lit(float(10**digits))
    plain = (F.abs(up) <= 1e9) & (F.abs(up - F.floor(up) - 0.5) > 1e-5)
    return F.when(plain, F.rint(up) / F.lit(float(10**digits)) + F.lit(0.0)).otherwise(F.round(x, digits))  # + 0 as -0 becomes 0


def blended(parent: Column, own: Column, hop_decay: float, own_weight: float) -> Column:
    """Score of a node that a hop reaches; own may be null."""
    return F.greatest(parent * F.lit(hop_decay), F.lit(own_weight) * own)


def modality_name(m: Column | str) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.when(m == 0, "text").when(m == 1, "audio").when(m == 2, "image").otherwise("unknown")


def draw(tag: str, a: Column, b: Column, seed: int) -> Column:
    """A portable pseudo-random integer below 2 ** 32 for (tag, a, b, seed), from md5."""
    text = F.concat_ws(":", F.lit(tag), a.cast("string"), b.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def float_bits(x: Column) -> Column:
    """The 32 bits of a single-precision number, as a long from 0."""
    x = x.cast("float")
    a = F.abs(x).cast("double")
    guess = F.floor(F.log2(a)).cast("int")  # the logarithm may round to the next whole number
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(power(guess) > a, guess - 1).when(power(guess + 1) <= a, guess + 1).otherwise(guess)
    normal = (e + 127).cast("long") * (1 << 23) + ((a / power(e) - 1) * (1 << 23)).cast("long")
    size = F.when(F.isnan(x), 0x7FC00000).when(a == float("inf"), 0x7F800000).when(a < 2.0**-126, (a * 2.0**149).cast("long")).otherwise(normal)
    return size + F.when(x.cast("string").startswith("-"), 1 << 31).otherwise(0)


def query_hash(q: Column) -> Column:
    """Exclusive or of the bits of a vector's first two components; what is missing counts as 0."""
    at = lambda i: F.coalesce(float_bits(F.get(q, F.lit(i))), F.lit(0).cast("long"))
    return at(0).bitwiseXOR(at(1))
