"""Hash embeddings and cosine similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for the embedding. Fixed values.
STOP_WORDS = """
the a an and or of to in on for is are was with as at by it this that be def return import from self none true false class
""".split()

#: Dimensions of the local embedding and of the constant stand-in.
LOCAL_DIM, CONSTANT_DIM = 384, 16


def tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def bucket(token: Column, dim: int = LOCAL_DIM) -> Column:
    """The first eight bytes of the token's md5, big-endian, modulo dim."""
    high = F.conv(F.substring(F.md5(token.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % F.lit(dim)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a null vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def constant_embedding() -> Column:
    """The stand-in vector: 0.1, 0.2, ..."""
    return F.array(*[F.lit(0.1 * (i + 1)) for i in range(CONSTANT_DIM)])


def vector_size(provider: str, model: str | None = None, dimensions: int | None = None) -> int:
    """The dimension of a provider's vectors: 16 for the stand-in, 3072 for large hosted models, 1536 for other hosted ones."""
    if provider == "mock":
        return CONSTANT_DIM
    if provider == "local":
        return dimensions or LOCAL_DIM
    return dimensions or (3072 if model and "large" in model else 1536)
