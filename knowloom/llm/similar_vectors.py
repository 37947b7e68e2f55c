"""The k most similar vectors for every vector, by multiprobe p-stable hashing.

Vectors are brought to unit length, so Euclidean distance orders like cosine
similarity.  Each of ``tables`` hash tables cuts ``functions`` Gaussian
projections into cells of ``width``; a vector is stored in its own cell and
looks into the ``probes`` perturbed cells most likely to hold a near vector
(sets of cell borders in order of expected squared distance).  Candidates of
all tables are merged, thinned by a 128-bit sign sketch and by bytewise
vectors, and re-ranked by the exact cosine.

Without a least similarity, or with one below ``LEAST_HASHED``, all directions of
a group are compared by blocked matrix products: exact, but quadratic.

Scale
-----
* Copies are collapsed first: all hashing runs over one representative of each
  direction, and copies are attached again at the end, at most ``k`` per row.
* A direction and its group (model and length) are one 64-bit key, a cell with
  its group another; a row of a table is 32 bytes.
* Probes are tested against a bit set of the occupied cells before they are
  shuffled, so only cells that exist travel.  The set has ``bit_sets.MAX_BITS`` at most;
  where all tables would need more, the tables are searched in several passes.
* Vectors are shuffled for pairs only that pass the sketch and the bytewise
  comparison.
* A cell with more than ``HOT`` vectors takes no part in the join.  Its members
  are compared whole, by blocked matrix products, with every vector that lies in
  such a cell or probes one: exact, but quadratic in those vectors.
* ``functions`` grows with the logarithm of the collection, which keeps the
  candidates of a vector about constant; ``probes`` and ``tables`` grow with it,
  so that the modelled recall at the least similarity is ``RECALL`` at every size.

Defined results
---------------
* null, empty, all-zero vectors and vectors with a null, NaN or infinite
  component take no part; vectors of unlike length are never compared;
* neighbours are rows of the same model (null models form one group) and
  another content_id (null content ids count as one content);
* equal similarities rank by smaller ``embedding_id``; a repeated
  ``embedding_id`` with the same vector counts once;
* extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.llm import bit_sets
from knowloom.session import bounded_broadcast, materialise

HOT = 256
#: Vectors compared at once by an exact search: those of one broadcast, and the numbers of one product.
SLAB = 65_536
PRODUCT = 1 << 23
#: Single precision may move a cosine by so much, bytewise vectors by so much.
SLACK = 1e-5
BYTE_SLACK = 0.02
#: Below this cosine, or without a limit, all vectors are compared: hashing tells near from far no longer.
LEAST_HASHED = 0.8
#: Part of the pairs at the least similarity that the tables are to find, by the model of ``hit_rate``.
RECALL = 0.92

_NAMED_SCHEMA = "c long, g long, embedding_id string, content_id string"
_SIGN_SCHEMA = f"{_NAMED_SCHEMA}, cells array<long>, s1 long, s2 long"
_CELL_SCHEMA = "cell long, c long, s1 long, s2 long"
_TOUCHING_SCHEMA = "c long, g long, dense boolean, vector array<float>"
_PAIR_SCHEMA = "a long, b long"
_EXACT_SCHEMA = "a long, b long, similarity double"


def default_functions(n: int) -> int:
    """Projections per table for ``n`` vectors."""
    return max(12, round((math.log(max(n, 2)) + 7.4) / 0.68))


def default_probes(n: int) -> int:
    """Cells a vector looks into besides its own, for ``n`` vectors."""
    return max(128, round(1024 * (n / 140_000) ** 0.3))


@functools.lru_cache(maxsize=64)
def hit_rate(m: int, width: float, probes: int, cosine: float, pairs: int = 2000) -> float:
    """Part of the pairs at a cosine that meet in one table, one vector probing the cell of the other; by simulation."""
    rng = np.random.default_rng([m, probes])
    x, z = rng.standard_normal((2, pairs, 128))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1)[:, None]
    met = []
    for t in range(4):
        part = slice(t * pairs // 4, (t + 1) * pairs // 4)
        a, b = (_with_probes(*_cells(v[part].astype(np.float32), m, t, width, 7), probes) for v in (x, y))
        met.append(((a == b[0]).any(0) | (b == a[0]).any(0)).mean())
    return float(np.mean(met))


def default_tables(m: int, width: float, probes: int, cosine: float) -> int:
    """Tables that together find ``RECALL`` of the pairs at a cosine."""
    miss = 1 - min(max(hit_rate(m, width, probes, cosine), 1e-3), 0.999)
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(miss)))


def sketch_limit(cosine: float) -> int:
    """Sign bits of 128 that may differ at a cosine: the mean and 3.5 deviations."""
    p = math.acos(min(max(cosine, -1.0), 1.0)) / math.pi
    return math.ceil(128 * p + 3.5 * math.sqrt(128 * p * (1 - p)))


@functools.lru_cache(maxsize=64)
def probe_sets(m: int, count: int) -> list[tuple[int, ...]]:
    """The ``count`` best sets of ranked cell borders, by expected squared distance.

    Border ``j`` of 2m, counted from the nearest, has a known expected squared
    distance; sets are enumerated from a heap by shifting or extending the last
    member, and a set with both borders of one projection is skipped.
    """
    j = np.arange(1, 2 * m + 1, dtype=float)
    near = j * (j + 1) / (4.0 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4.0 * (m + 1) * (m + 2))
    e = np.where(j <= m, near, far)
    heap, out = [(e[0], (0,))], []
    while heap and len(out) < count:
        score, s = heapq.heappop(heap)
        if not any(2 * m - 1 - x in s for x in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - e[last] + e[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (score + e[last + 1], (*s, last + 1)))
    return out


@functools.lru_cache(maxsize=64)
def _probe_steps(m: int, count: int) -> list[tuple[int, int]]:
    """Each probe as (an earlier probe, or 0 for the own cell; the border that comes in)."""
    sets = probe_sets(m, count)
    at = {(): 0} | {s: i for i, s in enumerate(sets, 1)}
    return [(at[s[:-1]], s[-1]) for s in sets]


@functools.lru_cache(maxsize=256)
def _projection(dim: int, m: int, table: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim, table, 0])
    a = rng.standard_normal((dim, m)).astype(np.float32) / np.float32(width)
    return a, rng.uniform(0, 1, m).astype(np.float32), rng.integers(1, 2**63, m, dtype=np.uint64) | np.uint64(1), rng.integers(1, 2**63, dtype=np.uint64)


@functools.lru_cache(maxsize=16)
def _sketch_projection(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 99]).standard_normal((dim, 128)).astype(np.float32)


def _cells(v: np.ndarray, m: int, table: int, width: float, seed: int):
    """Own cell of every vector, its fractions inside the cell, and the multipliers."""
    a, b, r, salt = _projection(v.shape[1], m, table, width, seed)
    x = v @ a + b
    low = np.floor(x)
    own = (low.astype(np.int64).astype(np.uint64) * r).sum(1, dtype=np.uint64) + salt
    return own, x - low, r


def _with_probes(own: np.ndarray, frac: np.ndarray, r: np.ndarray, count: int) -> np.ndarray:
    """Own cells (first row) and probed cells, one column for each vector."""
    m = len(r)
    order = np.argsort(np.concatenate([frac, 1 - frac], axis=1), axis=1)
    step = np.ascontiguousarray(np.concatenate([(~r) + np.uint64(1), r])[order].T)
    steps = _probe_steps(m, count)
    out = np.empty((len(steps) + 1, len(own)), np.uint64)
    out[0] = own
    for i, (before, border) in enumerate(steps, 1):
        np.add(out[before], step[border], out=out[i])
    return out


def _occupied_of(words: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe number, column) of the probes whose cell is occupied."""
    return np.divmod(bit_sets.members(words, p.ravel()), p.shape[1])


def _unit_groups(pdf: pd.DataFrame):
    """Unit vectors of a batch by dimension: (row positions, group of each, matrix)."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(pdf["vector"].array):
        if v is not None and len(v):
            by.setdefault(len(v), []).append(i)
    models = pdf["model"].to_numpy()
    for dim, rows in by.items():
        m = np.array([np.asarray(pdf["vector"].iat[i], dtype=np.float32) for i in rows], dtype=np.float64)
        norm = np.sqrt((m * m).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            at = np.array(rows)[ok]
            names: dict = {x: xxhash.xxh3_64_intdigest(f"{dim}" if x is None else f"{dim}:{x}") for x in set(models[at])}
            yield at, np.array([names[x] for x in models[at]], np.uint64), (m[ok] / norm[ok, None]).astype(np.float32)


def _keys(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """64-bit key of each direction in its group, equal for copies of any length."""
    q = np.round(v * 1e4).astype(np.int16)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=int(s)) for row, s in zip(q, g)], np.uint64).view(np.int64)


def _sketch(v: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.packbits((v @ _sketch_projection(v.shape[1], seed)) > 0, axis=1)
    s = np.ascontiguousarray(bits).view(np.int64)
    return s[:, 0], s[:, 1]


def _as_bytes(v: np.ndarray) -> list[bytes]:
    """Unit vectors with one byte for each component, their scale in front."""
    scale = np.abs(v).max(1, keepdims=True)
    q = np.round(v / scale * 127).astype(np.int8)
    return [s.tobytes() + row.tobytes() for s, row in zip(scale.astype(np.float32), q)]


def _sign(width: float, m: int, tables: int, seed: int):
    def run(batches):
        for pdf in batches:
            for rows, g, v in _unit_groups(pdf):
                s1, s2 = _sketch(v, seed)
                cells = np.stack([_cells(v, m, t, width, seed)[0] + g for t in range(tables)], axis=1).view(np.int64)
                yield pd.DataFrame({"c": _keys(g, v), "g": g.view(np.int64), "embedding_id": pdf["embedding_id"].to_numpy()[rows], "content_id": pdf["content_id"].to_numpy()[rows], "cells": list(cells), "s1": s1, "s2": s2})

    return run


def _name_rows(batches):
    for pdf in batches:
        for rows, g, v in _unit_groups(pdf):
            yield pd.DataFrame({"c": _keys(g, v), "g": g.view(np.int64), "embedding_id": pdf["embedding_id"].to_numpy()[rows], "content_id": pdf["content_id"].to_numpy()[rows]})


def _probe(width: float, m: int, tables: list[int], probes: int, seed: int, bits):
    def run(batches):
        words = bits.value
        for pdf in batches:
            for _, g, v in _unit_groups(pdf):
                c = _keys(g, v)
                s1, s2 = _sketch(v, seed)
                for t in tables:
                    at, cells = [], []
                    for a in range(0, len(v), 1000):
                        own, frac, r = _cells(v[a : a + 1000], m, t, width, seed)
                        p = _with_probes(own + g[a : a + 1000], frac, r, probes)[1:]
                        j, i = _occupied_of(words, p)
                        at.append(i + a)
                        cells.append(p[j, i])
                    i, cell = np.concatenate(at), np.concatenate(cells)
                    if len(i):
                        yield pd.DataFrame({"cell": cell.view(np.int64), "c": c[i], "s1": s1[i], "s2": s2[i]})

    return run


def _touching(width: float, m: int, tables: int, probes: int, seed: int, crowded):
    """Rows of which a cell or a probe is crowded; ``dense`` marks those stored in a crowded cell."""

    def run(batches):
        cells = crowded.value
        hit = lambda p: cells[np.minimum(np.searchsorted(cells, p), len(cells) - 1)] == p
        for pdf in batches:
            for rows, g, v in _unit_groups(pdf):
                own, any_ = np.zeros(len(v), bool), np.zeros(len(v), bool)
                for a in range(0, len(v), 1000):
                    e = slice(a, a + 1000)
                    for t in range(tables):
                        at, frac, r = _cells(v[e], m, t, width, seed)
                        there = hit(_with_probes(at + g[e], frac, r, probes))
                        own[e] |= there[0]
                        any_[e] |= there.any(0)
                i = np.nonzero(any_)[0]
                if len(i):
                    yield pd.DataFrame({"c": _keys(g, v)[i], "g": g.view(np.int64)[i], "dense": own[i], "vector": list(pdf["vector"].to_numpy()[rows[i]])})

    return run


def _best(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (query, stored) of unit vectors that hold the ``k`` best of each query outside ``lo:hi``, itself not counted.

    The (k+1)-th largest of the maxima of short runs is a lower bound of the
    (k+1)-th largest value, so a sort of all values is not needed.
    """
    sims = q @ s.T
    for i in np.nonzero(hi > lo)[0]:
        sims[i, lo[i] : hi[i]] = -2
    run = 32
    whole = len(s) // run * run
    tops = sims[:, :whole].reshape(len(q), -1, run).max(2)
    tops = np.concatenate([tops, sims[:, whole:]], axis=1)
    bound = np.full(len(q), -1.5, np.float32)
    if tops.shape[1] > k:
        bound = np.maximum(bound, np.partition(tops, tops.shape[1] - k - 1, axis=1)[:, -k - 1])
    return np.nonzero(sims >= np.maximum(bound - SLACK, least - SLACK)[:, None])


def _search_slab(slab, k: int, least: float):
    def run(batches):
        stored = slab.value
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=False):
                if g not in stored:
                    continue
                b, soles, raw, unit, norm = stored[g]
                a = part["c"].to_numpy()
                x = np.stack(part["vector"].to_numpy()).astype(np.float32)
                xn = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                content = "=" + part["content"].to_numpy().astype(object)
                lo, hi = np.searchsorted(soles, content, "left"), np.searchsorted(soles, content, "right")
                step = max(1, PRODUCT // len(unit))
                for at in range(0, len(x), step):
                    e = slice(at, at + step)
                    q = (x[e] / xn[e, None]).astype(np.float32)
                    i, j = _best(q, lo[e], hi[e], unit, k, least)
                    i = i + at
                    other = a[i] != b[j]
                    i, j = i[other], j[other]
                    sims = np.einsum("nd,nd->n", x[i].astype(np.float64), raw[j].astype(np.float64)) / (xn[i] * norm[j])
                    ok = sims >= least
                    i, j = i[ok], j[ok]
                    if len(i):
                        yield pd.DataFrame({"a": a[i], "b": b[j], "similarity": sims[ok]})

    return run


def _pack(pdf: pd.DataFrame) -> dict[int, tuple]:
    """Vectors of a slab by group, in order of the only content of their direction; several come first."""
    out = {}
    for g, part in pdf.groupby("g", sort=False):
        soles = ("=" + part["sole"]).fillna("").to_numpy().astype(object)
        at = np.argsort(soles, kind="stable")
        raw = np.stack(part["vector"].to_numpy()[at]).astype(np.float32)
        norm = np.sqrt((raw.astype(np.float64) ** 2).sum(1))
        out[g] = (part["c"].to_numpy()[at], soles[at], raw, (raw / norm[:, None]).astype(np.float32), norm)
    return out


def _search(looking: DataFrame, stored: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, similarity): all pairs of directions that can be among the best ``k`` of a, by comparing all.

    ``looking`` has (c, g, content, vector), ``stored`` (c, g, sole, vector).
    The stored vectors go to the executors in slabs, one at a time.
    """
    sc = looking.sparkSession.sparkContext
    slabs = max(1, -(-stored.count() // SLAB))
    numbered = stored.withColumn("slab", F.pmod(F.xxhash64("c"), F.lit(slabs)))
    out = looking.sparkSession.createDataFrame([], _EXACT_SCHEMA)
    for s in range(slabs):
        slab = sc.broadcast(_pack(numbered.filter(F.col("slab") == s).drop("slab").toArrow().to_pandas()))
        out = out.unionByName(materialise(looking.mapInPandas(_search_slab(slab, k, least), _EXACT_SCHEMA)))
        slab.destroy()
    return out


def _contents(src: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Directions with each of their contents, to look from; one with more than ``k`` has its neighbours among its copies."""
    several = classes.filter((F.col("contents") > 1) & (F.col("contents") <= k)).select("c")
    rows = src.mapInPandas(_name_rows, _NAMED_SCHEMA).join(bounded_broadcast(several), "c")
    return classes.filter(F.col("contents") == 1).select("c", "content").unionByName(rows.select("c", F.coalesce("content_id", F.lit("")).alias("content")).distinct())


def _crowded_pairs(src: DataFrame, classes: DataFrame, crowded: DataFrame, touching, k: int, least: float) -> DataFrame:
    """Pairs of which one vector lies in a crowded cell and the other lies in or probes one."""
    cells = src.sparkSession.sparkContext.broadcast(np.sort(crowded.toPandas()["cell"].to_numpy(dtype=np.int64).view(np.uint64)))
    rows = src.select("model", "vector").mapInPandas(touching(cells), _TOUCHING_SCHEMA)
    rows = materialise(rows.groupBy("c", "g").agg(F.first("dense").alias("dense"), F.first("vector").alias("vector")))
    looking = rows.drop("dense").join(_contents(src, classes, k), "c")
    # The only content of a direction, null if it has several.
    sole = classes.select("c", F.when(F.col("contents") == 1, F.col("content")).alias("sole"))
    return _search(looking, rows.filter("dense").drop("dense").join(sole, "c"), k, least)


def _stored_cells(classes: DataFrame, tables: int) -> tuple[DataFrame, DataFrame | None]:
    """Each representative in its cell of every table (t), without the crowded cells; and these, None if there are none."""
    table_no = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t")
    at = classes.select("c", "s1", "s2", "cells", table_no).withColumn("cell", F.element_at("cells", F.col("t") + 1)).drop("cells")
    crowded = materialise(at.groupBy("cell").count().filter(F.col("count") > HOT).select("cell"))
    if crowded.isEmpty():
        return at, None
    return at.join(bounded_broadcast(crowded), "cell", "left_anti"), crowded


def _byte_pairs(least: float):
    """Map function: pairs with their bytewise vectors to the pairs that may reach the cosine ``least``."""

    def run(batches):
        for pdf in batches:
            size = pdf["va"].map(len)
            for n, part in pdf.groupby(size, sort=False):
                raw = [np.frombuffer(b"".join(part[x]), np.uint8).reshape(-1, n) for x in ("va", "vb")]
                scale = [np.ascontiguousarray(x[:, :4]).view(np.float32)[:, 0] for x in raw]
                a, b = (x[:, 4:].view(np.int8).astype(np.float32) for x in raw)
                near = (a * b).sum(1) * scale[0] * scale[1] / 127**2 >= least - BYTE_SLACK
                yield part.loc[near, ["a", "b"]]

    return run


def _in_bytes(batches):
    for pdf in batches:
        for _, g, v in _unit_groups(pdf):
            yield pd.DataFrame({"c": _keys(g, v), "bytes": _as_bytes(v)})


def _with_key(batches):
    """Fetched representatives whose vector has the key that was asked for."""
    for pdf in batches:
        for rows, g, v in _unit_groups(pdf):
            same = _keys(g, v) == pdf["c"].to_numpy()[rows]
            yield pdf.iloc[rows[same]][["c", "vector"]]


def _exact(batches):
    for pdf in batches:
        sims = []
        for x, y in zip(pdf["va"], pdf["vb"]):
            x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
            sims.append(float(x @ y / math.sqrt((x @ x) * (y @ y))))
        yield pdf[["a", "b"]].assign(similarity=sims)


def _classes(rows: DataFrame, *more) -> DataFrame:
    """One row for each direction, with the number of its contents and the least of them."""
    by = rows.withColumn("content", F.coalesce("content_id", F.lit(""))).groupBy("c", "g", "content").agg(F.min("embedding_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *more)
    names = [c for c in by.columns if c not in ("c", "g", "content", "rep", "copies")]
    once = by.groupBy("c", "g").agg(*(F.first(c).alias(c) for c in names), F.min("rep").alias("rep"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("contents"), F.min("content").alias("content"))
    return materialise(once)


def similar_vectors(
    vectors: DataFrame,
    k: int = 5,
    min_similarity: float | None = 0.85,
    tables: int | None = None,
    probes: int | None = None,
    width: float = 2.2,
    functions_per_table: int | None = None,
    seed: int = 20240,
) -> DataFrame:
    """(embedding_id, neighbour_id, similarity, rank) of up to ``k`` neighbours at or above ``min_similarity``, of all if it is None.

    ``tables``, ``probes`` and the sketch limit follow from ``min_similarity`` and
    the number of vectors, see ``default_tables``.
    """
    src = vectors.select("embedding_id", "content_id", "model", "vector").filter(F.size("vector") > 0)
    if min_similarity is None or min_similarity < LEAST_HASHED:
        return _all_compared(src, k, -2.0 if min_similarity is None else min_similarity)
    n = vectors.count()
    m = functions_per_table or default_functions(n)
    probes = probes or default_probes(n)
    tables = tables or default_tables(m, width, probes, min_similarity)

    signed = src.mapInPandas(_sign(width, m, tables, seed), _SIGN_SCHEMA)
    classes = _classes(signed, *(F.first(x).alias(x) for x in ("cells", "s1", "s2")))
    stored, crowded = _stored_cells(classes, tables)
    passes = min(tables, -(-n * tables * bit_sets.BITS_PER_HASH // bit_sets.MAX_BITS)) or 1
    pairs = None
    for some in np.array_split(np.arange(tables), passes):
        found_here = _candidates(src, stored, [int(t) for t in some], n, (width, m, probes, seed), sketch_limit(min_similarity))
        pairs = found_here if pairs is None else pairs.unionByName(found_here)
    pairs = pairs if passes == 1 else materialise(pairs.distinct())
    exact = _verified(src, classes, pairs, min_similarity)
    if crowded is not None:
        dense = _crowded_pairs(src, classes, crowded, functools.partial(_touching, width, m, tables, probes, seed), k, min_similarity)
        dense = dense.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
        exact = exact.unionByName(dense).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return _ranked(src.mapInPandas(_name_rows, _NAMED_SCHEMA), classes, materialise(exact), k)


def _candidates(src: DataFrame, stored: DataFrame, tables: list[int], n: int, hashing: tuple, most: int) -> DataFrame:
    """Pairs (a, b) of directions that meet in one of the tables and whose sketches differ in at most ``most`` bits."""
    width, m, probes, seed = hashing
    here = stored.filter(F.col("t").isin(tables)).drop("t").select("cell", "c", "s1", "s2")
    bits = src.sparkSession.sparkContext.broadcast(bit_sets.bit_set(here.select("cell"), n * len(tables)))
    probing = src.select("model", "vector").mapInPandas(_probe(width, m, tables, probes, seed, bits), _CELL_SCHEMA)
    b = here.select("cell", F.col("c").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    near = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= most
    met = probing.join(b, "cell").filter((F.col("c") != F.col("b")) & near).unionByName(here.join(b, "cell").filter((F.col("c") < F.col("b")) & near))
    return materialise(met.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct())


def _verified(src: DataFrame, classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the cosine ``least``, tested bytewise first and exactly then."""
    met = bounded_broadcast(materialise(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()))
    small = src.select("model", "vector").mapInPandas(_in_bytes, "c long, bytes binary").join(met, "c", "left_semi")
    small = materialise(small.groupBy("c").agg(F.first("bytes").alias("bytes")))
    side = lambda x: small.select(F.col("c").alias(x), F.col("bytes").alias(f"v{x}"))
    likely = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_byte_pairs(least), _PAIR_SCHEMA))
    ends = likely.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = bounded_broadcast(materialise(ends.join(classes.select("c", F.col("rep").alias("embedding_id")), "c")))
    fetched = src.join(wanted, "embedding_id").select("c", "model", "vector").mapInPandas(_with_key, "c long, vector array<float>")
    fetched = materialise(fetched.dropDuplicates(["c"]))
    va, vb = fetched.select(F.col("c").alias("a"), F.col("vector").alias("va")), fetched.select(F.col("c").alias("b"), F.col("vector").alias("vb"))
    return likely.join(va, "a").join(vb, "b").mapInPandas(_exact, _EXACT_SCHEMA).filter(F.col("similarity") >= least)


def _units(batches):
    for pdf in batches:
        for rows, g, v in _unit_groups(pdf):
            yield pd.DataFrame({"c": _keys(g, v), "g": g.view(np.int64), "embedding_id": pdf["embedding_id"].to_numpy()[rows], "content_id": pdf["content_id"].to_numpy()[rows], "vector": list(pdf["vector"].to_numpy()[rows])})


def _all_compared(src: DataFrame, k: int, least: float) -> DataFrame:
    classes = _classes(src.mapInPandas(_units, f"{_NAMED_SCHEMA}, vector array<float>"), F.first("vector").alias("vector"))
    one = classes.filter(F.col("contents") == 1).select("c", "g", "content", "vector")
    several = _contents(src, classes.filter(F.col("contents") > 1), k).join(classes.select("c", "g", "vector"), "c")
    stored = classes.select("c", "g", F.when(F.col("contents") == 1, F.col("content")).alias("sole"), "vector")
    exact = _search(one.unionByName(several.select(*one.columns)), stored, k, least)
    return _ranked(src.mapInPandas(_name_rows, _NAMED_SCHEMA), classes, exact.dropDuplicates(["a", "b"]), k, directed=True)


def _ranked(named: DataFrame, classes: DataFrame, exact: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """Neighbour lists of the rows from the pairs of directions, or from those seen from a only.

    Works on (direction, content) groups: of a direction only the first ``k``
    rows of its first ``k + 1`` contents can be among anybody's first ``k``.
    """
    from pyspark.sql import Window as W

    both = exact if directed else exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    own = classes.filter(F.col("copies") > 1).select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("similarity"))
    links = both.unionByName(own)
    rows = named.select("c", F.coalesce("content_id", F.lit("")).alias("content"), "embedding_id")
    linked = bounded_broadcast(materialise(links.select(F.col("a").alias("c")).distinct()))
    rows = materialise(rows.join(linked, "c", "left_semi").distinct())
    heads = rows.withColumn("r", F.row_number().over(W.partitionBy("c", "content").orderBy("embedding_id"))).filter(F.col("r") <= k)
    first = heads.filter(F.col("r") == 1).withColumn("q", F.row_number().over(W.partitionBy("c").orderBy("embedding_id"))).filter(F.col("q") <= k + 1)
    kept = heads.join(first.select("c", "content"), ["c", "content"], "left_semi")
    targets = kept.select(F.col("c").alias("b"), F.col("content").alias("to"), F.col("embedding_id").alias("neighbour_id"))
    groups = rows.select(F.col("c").alias("a"), "content").distinct()
    options = links.join(groups, "a").join(targets, "b").filter(F.col("content") != F.col("to"))
    best = options.withColumn("rank", F.row_number().over(W.partitionBy("a", "content").orderBy(F.desc("similarity"), "neighbour_id"))).filter(F.col("rank") <= k)
    best = best.select(F.col("a").alias("c"), "content", "neighbour_id", "similarity", "rank")
    return rows.join(best, ["c", "content"]).select("embedding_id", "neighbour_id", "similarity", "rank")


def found(vectors: DataFrame, k: int = 5, min_similarity: float = 0.85) -> DataFrame:
    """Unordered neighbour pairs, smaller id first."""
    s = similar_vectors(vectors, k, min_similarity)
    return s.select(F.least("embedding_id", "neighbour_id").alias("embedding_id_a"), F.greatest("embedding_id", "neighbour_id").alias("embedding_id_b")).distinct()
