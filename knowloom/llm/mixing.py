"""Sources mixed to target weights by Poisson replication.

Every document is repeated a number of times drawn from a Poisson distribution
whose uniform variate is a keyed hash of the document's id, so the draw needs
no order, no state and no second pass, and is the same on every run.  The count
is cut at the source's ``max_repeats``; the rate is solved so that the *cut*
distribution has the target mean, and a target mean at the cap repeats every
document exactly that often.  Copies are exploded and spread by a hash of
document and copy number, which is a global shuffle.

Documents differ in size, so the tokens of one draw miss their mean, in small
sources by much.  The variates of a source may be turned round the unit circle
without changing their distribution: of ``TURNS`` turns each source takes the
one whose tokens come nearest to its target.

The size of the mix is the largest for which every present source can reach its
share under its cap, or ``total_tokens`` if given; then sources at their cap
fall short, and the report shows it.

Sizes are tokens of a public tokenizer, whose vocabulary file is a parameter; the
driver reads it and hands it to the workers.
The first pass counts tokens and leaves one narrow row per document; rates are
solved from one row per source.

Defined results
---------------
* a source is read in lower case, without outer space, with ``_`` for ``-`` and
  blanks; null sources and sources without target contribute nothing and are
  reported with target 0;
* null and empty texts have no tokens and are never repeated;
* a target source without documents gets the actual share 0, the others keep
  their proportions;
* repeated texts under other ids count as documents of their own; a repeated
  doc_id gets equal counts.
"""

from __future__ import annotations

import base64
import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowloom.session import bounded_broadcast, materialise

#: Vocabulary of the default tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Turns of the variates that a source chooses from.
TURNS = 16
# Fixed value: split pattern of byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(spark: SparkSession, path: str = TOKENIZER):
    """Column function: number of tokens of a text."""
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(vocabulary.value)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def source_key(source: Column) -> Column:
    """The source as written, brought to one form."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def cut_mean(rate: float, most: int) -> float:
    """Mean of min(Poisson(rate), most)."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(most):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + most * max(0.0, 1.0 - below)


def solve_rate(mean: float, most: int) -> float:
    """Rate whose cut distribution has the given mean, infinite at the cap."""
    if mean <= 0:
        return 0.0
    if mean >= most:
        return math.inf
    low, high = 0.0, 1.0
    while cut_mean(high, most) < mean and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cut_mean(mid, most) < mean else (low, mid)
    return high


def thresholds(rate: float, most: int) -> list[float]:
    """P(count <= k) for k below the cap: the count is the number of thresholds at or under the variate."""
    if rate == math.inf:
        return [0.0] * most
    p, total, out = math.exp(-rate), 0.0, []
    for k in range(most):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def uniform(*parts: Column) -> Column:
    """A keyed hash of the parts as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, tuple[float, list[float]]]:
    """Mean and thresholds per source, from token totals and (share, cap) per source."""
    present = {s: t for s, t in targets.items() if sizes.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not present:
        return {}
    whole = sum(share for share, _ in present.values())
    most = min(cap * sizes[s] * whole / share for s, (share, cap) in present.items())
    total = most if total_tokens is None else total_tokens
    out = {}
    for s, (share, cap) in present.items():
        mean = min(float(cap), total * share / whole / sizes[s])
        out[s] = (mean, thresholds(solve_rate(mean, cap), cap))
    return out


class Mix:
    """A planned mix of a corpus: its documents and its report."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 9, total_tokens: int | None = None):
        self.documents, self.seed = documents, seed
        spark = documents.sparkSession
        count = token_counter(spark, tokenizer)
        self.counted = materialise(documents.select("doc_id", source_key(F.col("source")).alias("source"), count("text").alias("tokens")))
        self.target_table = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        # One row per target source.
        named = self.counted.join(bounded_broadcast(self.target_table.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"))
        sizes = {r["source"]: r["tokens"] for r in named.collect()}
        self.targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in self.target_table.collect()}
        self.plan = plan(sizes, self.targets, total_tokens)
        rows = [(s, float(mean), [float(t) for t in steps], mean * sizes[s]) for s, (mean, steps) in self.plan.items()]
        table = spark.createDataFrame(rows, "source string, mean double, steps array<double>, wanted double")
        self.draws = bounded_broadcast(materialise(self._turned(table)))

    def _turned(self, table: DataFrame) -> DataFrame:
        """The plan with the best turn of every source."""
        turns = F.explode(F.array(*(F.lit(i / TURNS) for i in range(TURNS)))).alias("turn")
        drawn = self.counted.filter(F.col("tokens") > 0).join(bounded_broadcast(table), "source").select("*", turns)
        reached = drawn.groupBy("source", "turn").agg(F.sum(F.col("tokens") * self._copies()).alias("reached"))
        best = reached.join(bounded_broadcast(table), "source").groupBy("source").agg(F.min_by("turn", F.struct(F.abs(F.col("reached") - F.col("wanted")), "turn")).alias("turn"))
        return table.join(best, "source").select("source", "mean", "steps", "turn")

    def _copies(self) -> Column:
        """Number of copies of a row with doc_id, steps and turn."""
        u = uniform(F.lit(self.seed), F.col("doc_id")) + F.col("turn")
        u = F.when(u >= 1, u - 1).otherwise(u)
        return F.aggregate("steps", F.lit(0), lambda n, t: n + (u >= t).cast("int"))

    def mixed(self) -> DataFrame:
        """doc_id, copy, source, text and shuffle_key, in the order of the shuffle inside each partition."""
        d = self.documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter(F.length("text") > 0)
        d = d.join(self.draws, "source").withColumn("n", self._copies()).filter(F.col("n") > 0)
        d = d.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
        d = d.withColumn("shuffle_key", F.xxhash64(F.lit(self.seed), F.lit("shuffle"), "doc_id", "copy"))
        return d.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("doc_id", "copy", "source", "text", "shuffle_key")

    def report(self) -> DataFrame:
        """Target and actual share of every source of the corpus and the targets."""
        n = F.when(F.col("tokens") > 0, F.coalesce(self._copies(), F.lit(0))).otherwise(0)
        got = self.counted.join(self.draws, "source", "left").withColumn("n", n).groupBy("source").agg(
            F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("corpus_tokens"), F.sum(F.col("tokens") * F.col("n")).alias("mixed_tokens"), F.max("n").alias("largest_repeat"), F.max("mean").alias("mean")
        )
        got = materialise(got)
        total = F.lit(got.agg(F.sum("mixed_tokens")).first()[0]).cast("double")
        both = self.target_table.join(got, "source", "full")
        return both.select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce(F.try_divide(F.col("mixed_tokens"), total), F.lit(0.0)).alias("actual_share"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("corpus_tokens", F.lit(0)).alias("corpus_tokens"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            F.coalesce("mean", F.lit(0.0)).alias("mean_repeats"),
            F.coalesce("largest_repeat", F.lit(0)).alias("largest_repeat"),
        )
