"""Hashed bag-of-words vectors and vector arithmetic as column expressions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowloom.functions.text import let, tokens

DIMENSIONS = 128
MODEL = "hashed-bow-128"


class Embedder(Protocol):
    """Turns a text column into a vector column; a model may do so in a pandas function."""

    dimensions: int
    model_name: str

    def embed(self, text: Column) -> Column: ...


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """SHA-1 of the token modulo a power of two up to 2^16, from the last hex digits."""
    return (F.conv(F.substring(F.sha1(token), 37, 4), 16, 10).cast("int") % dimensions).cast("int")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null for vectors of unlike length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    return let(v, lambda w: let(F.when(norm(w) > 0, norm(w)).otherwise(1.0), lambda n: F.transform(w, lambda x: (x / n).cast("float"))))


class HashedEmbedder:
    """Counts of hashed words, scaled to unit length; runs inside the JVM."""

    def __init__(self, dimensions: int = DIMENSIONS, model_name: str | None = None):
        if dimensions & (dimensions - 1) or not 0 < dimensions <= 1 << 16:
            raise ValueError("dimensions must be a power of two up to 65536")
        self.dimensions, self.model_name = dimensions, model_name or f"hashed-bow-{dimensions}"

    def embed(self, text: Column) -> Column:
        d = self.dimensions
        where = F.transform(tokens(text), lambda t: bucket(t, d))
        return unit(let(where, lambda at: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (F.size(at) - F.size(F.array_remove(at, i))).cast("double"))))

    def embed_query(self, query: str) -> list[float]:
        """The vector of one query string, on the driver."""
        import hashlib
        import math

        v = [0.0] * self.dimensions
        for t in query.lower().split():
            v[int(hashlib.sha1(t.encode()).hexdigest(), 16) % self.dimensions] += 1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v
