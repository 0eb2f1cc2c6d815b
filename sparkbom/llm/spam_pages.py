"""Pages that repeat key phrases or list links, menu entries, tags or products instead of saying something.

Each page's words are ranked by frequency; a line is fitted to log frequency over log rank, and the page's word distribution
is set against that of its language: its divergence, and its share of the words at the head of the language's own curve, those
that stand in most texts. Slope, residual, divergence and head share are compared with pages of the same language and a similar
length (median and absolute deviation, over distinct texts). Pages that are far off in their sum or in the residual are spam by
their curves; a last check reads them segment by segment and lets those go whose words stand mainly in sentences. It knows no
words but the heads of the curves. Where too few distinct texts share a language and length to say what is usual, the check
alone decides.

Null texts and texts without words are no pages. The language is the one whose prose fits best, whatever the lang column
says; languages of fewer than PEERS distinct texts have no model. All sums run within one page's words, which are hashed by page,
or over (language, word) after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbom.llm.page_text import list_share
from sparkbom.session import cut

#: Words kept per language; all rarer words share one probability. Bounds a model at KEPT rows.
KEPT = 2000
#: Words at the head of a language's curve, and the part of its vocabulary that they are at most.
HEAD, PART = 40, 4
#: Languages that one pass over the pages compares; more of them take more passes.
BATCH = 20
#: Distinct texts that a language, or a class of language and length, needs, lest a page be its own measure.
PEERS = 20


def word_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, word, n)``; the pages are hashed by id once and all later steps per page need no further shuffle."""
    one = docs.where("text is not null and doc_id is not null").select("doc_id", F.lower("lang").alias("lang"), "text").repartition("doc_id")
    words = F.explode(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+', 0)"))
    return one.select("doc_id", "lang", words.alias("word")).groupBy("doc_id", "lang", "word").agg(F.count("*").alias("n"))


def language_models(counts: DataFrame, pages: DataFrame) -> DataFrame:
    """``(model, word, logp, head)`` of the most frequent words of each language, and under the null word that of any other word.
    head: whether the word is among the HEAD that stand in most texts."""
    by = counts.where("lang is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    by = cut(by, "words")
    texts = pages.groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("pages")).where(F.col("pages") >= PEERS)
    size = cut(by.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).join(texts, "lang"), "languages")

    def top(order: str, keep: int) -> DataFrame:
        # two steps, so that no task ranks all words of a language
        slot = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc(order), "word")
        first = by.withColumn("r", F.row_number().over(slot)).where(F.col("r") <= keep)
        return first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(order), "word"))).where(F.col("r") <= keep).drop("r")

    kept = cut(top("n", KEPT), "kept")
    often = top("texts", HEAD).join(size.select("lang", "kinds"), "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("texts"), "word")))
    often = cut(often.where(F.col("r") * PART <= F.col("kinds")).drop("r", "kinds"), "heads")
    head = often.select("lang", "word", F.lit(True).alias("head"))
    # a word may stand at the head without being among the most frequent
    known = kept.unionByName(often).distinct().join(head, ["lang", "word"], "left").join(size, "lang")
    known = known.select(F.col("lang").alias("model"), "word", F.log(F.col("n") / F.col("all")).alias("logp"), F.coalesce("head", F.lit(False)).alias("head"))
    rest = kept.groupBy("lang").agg(F.sum("n").alias("kept")).join(size, "lang")
    other = F.log((F.col("all") - F.col("kept") + 1) / F.col("all") / F.greatest(F.col("kinds") - KEPT, F.lit(1)))
    return known.unionByName(rest.select(F.col("lang").alias("model"), F.lit(None).cast("string").alias("word"), other.alias("logp"), F.lit(False).alias("head")))


def models_of(docs: DataFrame) -> DataFrame:
    """The language models of ``docs``, in which copies count once."""
    once = docs.where("text is not null and doc_id is not null").withColumn("copy", F.xxhash64("text")).dropDuplicates(["lang", "copy"])
    return cut(language_models(word_counts(once), once), "models")


def curves(docs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """``(doc_id, bag, model, words, slope, residual, divergence, surprise, head, size)`` of each page; size is a class of length,
    and pages of the same words have the same bag."""
    counts = word_counts(docs)
    model = models_of(docs) if model is None else model
    base = {r[0]: r[1] for r in model.where("word is null").select("model", "logp").collect()}  # one row per language
    names = sorted(base)
    # one map per word: word -> {model: (logp, head)}
    per_word = model.where("word is not null").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("logp", "head")))).alias("known"))
    if len(names) <= BATCH:
        per_word = F.broadcast(per_word)  # at most BATCH x (KEPT + HEAD) words
    w = Window.partitionBy("doc_id")
    ranked = counts.join(per_word, "word", "left").withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "word")))
    if len(names) > BATCH:
        ranked = cut(ranked, "ranked")
    n, x, y = F.col("n"), F.log("rank"), F.log("n")
    line = [F.sum(n).alias("words"), F.bit_xor(F.xxhash64("word", "n")).alias("bag"), F.count("*").alias("kinds"), F.sum(n * F.log("n")).alias("nlogn"), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("syy"), F.regr_r2(y, x).alias("r2")]
    page = None
    for k in range(0, max(1, len(names)), BATCH):
        batch = names[k : k + BATCH]
        said = [F.sum(n * F.coalesce(F.col("known")[m]["logp"], F.lit(base[m]))).alias(f"said_{i}") for i, m in enumerate(batch)]
        heads = [F.sum(F.when(F.col("known")[m]["head"], n).otherwise(0)).alias(f"head_{i}") for i, m in enumerate(batch)]
        fits = [F.struct(F.col(f"said_{i}").alias("s"), F.lit(m).alias("m"), F.col(f"head_{i}").alias("h")) for i, m in enumerate(batch)]
        fits = fits or [F.struct(F.lit(0.0).alias("s"), F.lit("").alias("m"), F.lit(0).cast("long").alias("h"))]
        best = F.greatest(*fits) if len(fits) > 1 else fits[0]
        part = ranked.groupBy("doc_id").agg(*(line if page is None else [F.sum(n).alias("_")]), *said, *heads).withColumn("best", best).drop("_", *(f"{c}_{i}" for i in range(len(batch)) for c in ("said", "head")))
        page = part if page is None else page.join(part.withColumnRenamed("best", "more"), "doc_id").withColumn("best", F.greatest("best", "more")).drop("more")
    page = page.withColumn("surprise", -F.col("best.s") / F.col("words"))
    entropy = F.log("words") - F.col("nlogn") / F.col("words")
    return page.select(
        "doc_id", "bag", F.col("best.m").alias("model"), "words", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce(F.sqrt(F.col("syy") * (1 - F.col("r2")) / F.col("kinds")), F.lit(0.0)).alias("residual"),
        (F.col("surprise") - entropy).alias("divergence"), "surprise", (F.col("best.h") / F.col("words")).alias("head"), F.floor(F.log2("words")).cast("int").alias("size"),
    )


def unusual(pages: DataFrame, limit: float = 5.0, rough: float = 6.0) -> DataFrame:
    """Pages that lie far from others of their language and length: by divergence, by the share of usual words and by a steep slope
    together, in deviations, or by the residual alone; and all pages where there are fewer than PEERS others to compare them with."""
    pages = cut(pages, "curves")
    cols = ("slope", "residual", "divergence", "head")
    peers = cut(pages.dropDuplicates(["bag"]), "peers")
    mid = peers.groupBy("model", "size").agg(F.count("*").alias("peers"), *(F.percentile_approx(c, 0.5, 1000).alias(f"m_{c}") for c in cols))
    off = pages.join(mid, ["model", "size"])
    spread = peers.join(mid, ["model", "size"]).groupBy("model", "size").agg(*(F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 1000).alias(f"d_{c}") for c in cols))
    off = off.join(spread, ["model", "size"])
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.greatest(1.4826 * F.col(f"d_{c}"), F.lit(0.02)) for c in cols}
    score = z["divergence"] - z["head"] + F.greatest(-z["slope"], F.lit(0.0))
    off = off.withColumns({"score": score} | {f"z_{c}": z[c] for c in cols})
    return off.where((F.col("peers") < PEERS) | (F.col("score") > limit) | (F.col("z_residual") > rough)).select("doc_id", "score", *(f"z_{c}" for c in cols))


def spam_pages(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """``(doc_id, list_share, score, z_...)`` of the pages that stand out and consist mainly of lists or repetitions."""
    model = models_of(docs)
    out = cut(unusual(curves(docs, model)), "unusual")
    words = model.where("head").groupBy("model").agg(F.collect_list("word").alias("words")).orderBy("model").collect()  # HEAD words a language
    heads = [frozenset(r["words"]) for r in words]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "list_share": [list_share(t, heads) for t in part["text"]]})

    texts = docs.where("text is not null").select("doc_id", "text").join(out.select("doc_id"), "doc_id", "left_semi")
    shares = texts.mapInPandas(run, "doc_id long, list_share double").where(F.col("list_share") > share)
    return shares.join(out, "doc_id")
