"""Training mixes in which every source has its target share of all tokens.

Sizes are tokens of a public tokenizer. Weights are exponentiated token shares: with exponent a, a source weighs
``target ** a * usable ** (1 - a)``, normalised, where usable is its share of all tokens that the repetition limits let be used. At 1
these are the target shares, at 0 every source is used up evenly. a is bisected

* without a wanted total, to the least value at which no weight is further than ``tolerance`` from its target; the mix is then as
  large as the limits allow at these weights, so that the shares hold and scarce sources bind it as little as they may;
* with a wanted total, to the largest value at which no source needs more repetitions than it may have;
* with ``match_entropy``, plain token shares are raised to the power at which their entropy is that of the targets.

Weights become token budgets: whole passes over a source, then blocks of a random permutation up to the remaining budget.

Source names are compared without case and outer blanks. Documents without source, text, or target are left out and counted
in the report; targets without documents get nothing and their share is spread over the others. A null max_repeats means 1.
The plan has one row per source and stays a table; only sums over it reach the driver, so there is no bound on sources. No source
is sorted as a whole: documents fall into blocks by a random key, prefix sums run over the blocks' totals, and only the block in
which the budget ends is ordered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbom.session import cut, spread

BLOCKS = 4096
#: Exponents that are tried in one pass of a bisection, and passes: together they settle an exponent to eight digits.
TRIES, PASSES = 64, 4


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, source, tokens)``: tokens of a byte-level BPE whose ranks stand in the file ``vocabulary``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as public
        import tiktoken

        path = vocabulary or public.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "tokens": [len(coding.encode_ordinary(t)) for t in part["text"]]})

    one = docs.where("text is not null and doc_id is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return spread(one, "doc_id").dropDuplicates(["doc_id"]).mapInPandas(run, "doc_id long, source string, tokens long")


def tempered(a: Column | float, share: str = "target", base: str = "usable") -> Column:
    """``share ** a * base ** (1 - a)``, not yet normalised; null where either is 0."""
    known = (F.col(share) > 0) & (F.col(base) > 0)
    return F.when(known, F.exp(F.log(share) * a + F.log(base) * (1 - a)))


def _bisected(low: float, high: float, table: DataFrame, raw: Column, measure: Column, most: float) -> float:
    """The least exponent ``a`` of [low, high], or close above it, from which on ``measure`` is at most ``most``; high if it never is.
    raw is a source's weight before it is divided by the sum ``z`` over the sources. Each pass cuts the range into TRIES parts."""
    for _ in range(PASSES):
        points = [low + (high - low) * k / TRIES for k in range(TRIES + 1)]
        tried = table.withColumn("a", F.explode(F.array(*(F.lit(float(x)) for x in points)))).withColumn("raw", raw)
        z = tried.groupBy("a").agg(F.sum("raw").alias("z"))
        found = {r[0]: r[1] for r in tried.join(F.broadcast(z), "a").groupBy("a").agg(measure.alias("m")).collect()}  # TRIES + 1 rows
        first = next((k for k, x in enumerate(points) if (found.get(x) or 0.0) <= most), TRIES)
        if first == 0:
            return points[0]
        low, high = points[first - 1], points[first]
    return high


def _sums(table: DataFrame, columns: list[Column]) -> list[float]:
    """Sums over the sources, 0 where there are none."""
    return [x or 0.0 for x in table.agg(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()]


def exponent_within(table: DataFrame, tolerance: float) -> float:
    """The least exponent at which no weight is further than ``tolerance`` from its target."""
    return _bisected(0.0, 1.0, table, tempered(F.col("a")), F.max(F.abs(F.col("raw") / F.col("z") - F.col("target"))), tolerance)


def exponent_for_total(table: DataFrame, total: float) -> float:
    """The largest exponent in [0, 1] at which no source needs more than its usable tokens for ``total`` tokens."""
    # looked for from 1 downwards
    return 1 - _bisected(0.0, 1.0, table, tempered(1 - F.col("a")), F.max(F.col("raw") / F.col("z") * total / F.col("capacity")), 1 + 1e-9)


def exponent_for_entropy(table: DataFrame, wanted: float) -> float:
    """The exponent in [0, 8] at which token shares raised to it have the wanted entropy, which falls as the exponent grows."""
    p = F.col("raw") / F.col("z")
    return _bisected(0.0, 8.0, table.where("natural > 0"), F.exp(F.log("natural") * F.col("a")), -F.sum(F.when(p > 0, p * F.log(p))), wanted)


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None, tolerance: float = 0.001, match_entropy: bool = False) -> DataFrame:
    """One row per target source: tokens, weight, budget, passes (whole ones) and rest (tokens of one more, partial pass)."""
    name = F.lower(F.trim("source"))
    t = targets.where("source is not null").groupBy(name.alias("source")).agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"))
    t = t.join(sizes, "source", "left").fillna(0, ["tokens", "documents"])
    t = cut(t.withColumn("capacity", (F.col("tokens") * F.greatest("max_repeats", F.lit(0))).cast("double")).withColumn("wanted", F.when(F.col("capacity") > 0, F.col("target_share")).otherwise(0.0)), "sources")
    want, room, known = _sums(t, [F.sum("wanted"), F.sum(F.when(F.col("wanted") > 0, F.col("capacity"))), F.sum(F.when(F.col("wanted") > 0, F.col("tokens"))).cast("double")])
    part = lambda c, whole: F.when(F.col("wanted") > 0, F.col(c) / (whole or 1.0)).otherwise(0.0)
    t = cut(t.select("source", "target_share", "max_repeats", "tokens", "documents", "capacity", part("wanted", want).alias("target"), part("capacity", room).alias("usable"), part("tokens", known).alias("natural")), "sources")
    if match_entropy:
        exponent = exponent_for_entropy(t, -_sums(t, [F.sum(F.when(F.col("target") > 0, F.col("target") * F.log("target")))])[0])
        raw = F.when(F.col("natural") > 0, F.exp(exponent * F.log("natural")))
    else:
        exponent = exponent_within(t, tolerance) if total is None else exponent_for_total(t, min(total, room))
        raw = tempered(exponent)
    weight = F.coalesce(raw / (_sums(t, [F.sum(raw)])[0] or 1.0), F.lit(0.0))
    most = t.agg(F.min(F.when(weight > 0, F.col("capacity") / weight))).first()[0] or 0.0
    size = most if total is None else min(total, room)
    t = t.withColumn("weight", weight).withColumn("exponent", F.lit(exponent)).withColumn("budget", F.least(F.col("weight") * size, F.col("capacity")))
    # a budget that is a whole number of passes but for rounding is that number
    t = t.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens") + 1e-9)).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.greatest(F.col("budget") - F.col("passes") * F.col("tokens"), F.lit(0.0)))
    return cut(t.select("source", "target_share", "max_repeats", "tokens", "documents", "weight", "exponent", "budget", "passes", "rest"), "plan")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, vocabulary: str | None = None, tolerance: float = 0.001, match_entropy: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, plan, sizes): ``(doc_id, source, tokens, uses, block, key)`` of every document that is used, in the order (block,
    key) of each pass; the plan per target source; and documents and tokens of every source there is."""
    counts = cut(token_counts(docs, vocabulary), "tokens")
    # a source may hold most documents: partial sums come first
    sizes = cut(counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "sizes")
    table = plan(sizes.where("source is not null"), targets, total, tolerance, match_entropy)
    key = F.xxhash64("doc_id", F.lit(seed))
    keyed = counts.join(table.select("source", "passes", "rest").where("passes > 0 or rest > 0"), "source").withColumn("key", key).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)))
    block = keyed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    upto = block.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keyed = keyed.join(upto.select("source", "block", "size", "before"), ["source", "block"])
    inside = (F.col("before") + F.col("size")) <= F.col("rest")
    whole = keyed.where(inside | (F.col("before") >= F.col("rest"))).withColumn("more", inside.cast("int"))
    order = Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = keyed.where(~inside & (F.col("before") < F.col("rest"))).withColumn("sum", F.col("before") + F.sum("tokens").over(order))
    edge = edge.withColumn("more", (F.col("sum") <= F.col("rest")).cast("int")).drop("sum")
    uses = F.col("passes") + F.col("more")
    out = whole.unionByName(edge).select("doc_id", "source", "tokens", uses.alias("uses"), "block", "key")
    return out.where("uses > 0"), table, sizes


def report(used: DataFrame, table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per source, with and without a target: wanted and reached share, the largest number of uses of a document, and the documents
    that are left out. The row with a null source holds the documents that name none."""
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("used_documents"))
    all_ = got.agg(F.sum("used_tokens").alias("all_tokens"))
    rest = sizes.join(table.select("source"), "source", "left_anti").select("source", "tokens", "documents")
    out = table.unionByName(rest, allowMissingColumns=True).join(got, "source", "left").join(F.broadcast(all_))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "source", "target_share", "weight", "exponent", "max_repeats", "documents", "tokens", *(zero(c) for c in ("used_documents", "used_tokens", "most_uses")),
        (F.col("documents") - F.coalesce("used_documents", F.lit(0))).alias("left_out"), (F.coalesce("used_tokens", F.lit(0)) / F.col("all_tokens")).alias("reached_share"),
    )
