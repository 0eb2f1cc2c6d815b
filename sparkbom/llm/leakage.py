"""Documents that contain passages of held-out evaluation items.

Latent semantic retrieval: passages of all documents become TF-IDF vectors over the words of the items; a randomised SVD,
whose two passes over the passages are sums within tasks, gives latent axes; every document passage is compared by cosine
with all item passages. Item passages lie in clusters, and a passage meets only the clusters that the angle leaves possible, which
loses none. The words then decide for each candidate pair: a local alignment, or a window with at most EDITS edits. Items too short
for passages are searched for by their halves, of which an edit leaves one as it is. A candidate that no alignment confirms is a
paraphrase if its longest common subsequence with the item is long and the item's answer stands in the document; these are kept
apart, as a passage is a case by its words alone.

The items are the stated query set. They are read in blocks of at most ITEM_CHARS characters, which bounds the model and everything
that is broadcast; sums that leave a task have one row per item word. Instruction lines that several items share are not part of an
item. Null texts hold nothing. Repeated rows count once. A document or item shorter than a passage is one passage. Of a passage
within an alignment a third of the words may differ, so passages with fewer item words than KNOWN are not compared.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbom.llm.alignment import best_overlap, common, differences, may_overlap, window, words
from sparkbom.session import cut, spread

WINDOW, STEP, ITEM_STEP = 15, 5, 2
AXES, EXTRA = 48, 12
#: Changed, dropped or inserted words that a window of the least length may hold anywhere; shorter items in proportion.
EDITS = 2
#: Share of item words that a passage within an alignment has at least.
KNOWN = 2 / 3
#: Characters of the items that are searched for at once.
ITEM_CHARS = 20_000_000
#: Share of the shorter text's words that a paraphrase has in common with the item, in order.
PARAPHRASE = 0.6
#: Cells of the dense block of the TF-IDF matrix that a task holds.
BLOCK = 1_000_000


def items_by_block(items: DataFrame, shared: int = 3) -> tuple[DataFrame, int]:
    """``(item_id, body, answer, block)`` and the number of blocks: the items without instruction lines, which are sentences that
    open at least ``shared`` different texts."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    one = items.where("item_id is not null and text is not null").select("item_id", F.trim("text").alias("text"), answer.alias("answer")).dropDuplicates(["item_id"])
    one = cut(one.withColumn("opening", F.regexp_extract("text", r"^(?s)(.*?[.:?!])(?:\s|$)", 1)), "items")
    lines = one.where("opening <> ''").groupBy("opening").agg(F.count_distinct("text").alias("n")).where(F.col("n") >= shared).select("opening", F.length("opening").alias("skip"))
    count = -(-(one.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS)
    body = F.expr("substring(text, coalesce(skip, 0) + 1)")
    return cut(one.join(lines, "opening", "left").select("item_id", body.alias("body"), "answer", F.pmod(F.xxhash64("item_id"), F.lit(max(1, count))).alias("block")), "items"), count


def _starts(n: int, step: int) -> list[int]:
    return list(range(0, max(1, n - WINDOW + 1), step)) + ([n - WINDOW] if n > WINDOW and (n - WINDOW) % step else [])


def _passages(ids: np.ndarray, step: int, idf: np.ndarray, axes: np.ndarray | None, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages of one text and their vectors: on the axes, or per passage and word (rows of the TF-IDF matrix)."""
    starts = np.array(_starts(len(ids), step))
    grid = starts[:, None] + np.arange(min(WINDOW, len(ids)))[None, :]
    own = ids[grid]
    keep = (own >= 0).sum(axis=1) >= max(1, least * WINDOW)
    starts, own = starts[keep], own[keep]
    known = own >= 0
    weight = np.where(known, idf[own], 0.0)
    norm = np.sqrt((weight**2).sum(axis=1, keepdims=True)) + 1e-9
    if axes is None:
        return own, weight / norm
    vectors = np.einsum("pw,pwk->pk", weight / norm, axes[own])
    return starts, vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)


def _halves(items: dict[int, list[int]], least: int) -> dict[int, dict[tuple, list[tuple[int, int]]]]:
    """length -> words -> (item, start in the item): pieces of the items under ``least`` words, one more than they may hold edits."""
    out: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
    for item, own in items.items():
        if len(own) < least:
            count = EDITS * len(own) // least + 1
            cuts = [len(own) * k // count for k in range(count + 1)]
            for lo, hi in zip(cuts, cuts[1:]):
                out.setdefault(hi - lo, {}).setdefault(tuple(own[lo:hi]), []).append((item, lo))
    return out


def _short(ids: list[int], items: dict[int, list[int]], halves: dict[int, dict[tuple, list[tuple[int, int]]]], least: int) -> dict[int, int]:
    """item -> words that agree, of the short items that stand whole in a text."""
    out: dict[int, int] = {}
    for n, known in halves.items():
        for i in range(len(ids) - n + 1):
            for item, lo in known.get(tuple(ids[i : i + n]), ()):
                own = list(items[item])
                edits = EDITS * len(own) // least
                if item not in out and (off := differences(ids[max(0, i - lo - edits) : i - lo + len(own) + edits], own)) <= edits:
                    out[item] = len(own) - off
    return out


def coded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``(doc_id, ids)``: the words of each document as numbers of item words, -1 for all others; texts without any are left out."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for part in parts:
            rows = [(d, ids) for d, t in zip(part["doc_id"], part["text"]) if max(ids := [number.get(w, -1) for w in words(t)], default=-1) >= 0]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    one = spread(docs.where("text is not null and doc_id is not null").select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"])
    return one.mapInPandas(run, "doc_id long, ids array<int>")


def _word_sums(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over the TF-IDF matrix A of all passages: summed in each task, then per word."""
    width = basis.shape[1]
    shared = texts.sparkSession.sparkContext.broadcast((idf, basis))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, basis = shared.value
        total = np.zeros_like(basis)
        rows = max(16, BLOCK // len(idf))  # passages that are multiplied at once
        own, weight, held = [], [], 0

        def add() -> None:
            block = np.zeros((held, len(idf)))
            at = 0
            for o, w in zip(own, weight):
                np.add.at(block, (np.arange(at, at + len(o))[:, None], o), w)
                at += len(o)
            np.add(total, block.T @ (block @ basis), out=total)
            own.clear()
            weight.clear()

        for part in parts:
            for ids in part["ids"]:
                o, w = _passages(np.asarray(ids), STEP, idf, None)
                for k in range(0, len(o), rows):
                    own.append(o[k : k + rows])
                    weight.append(w[k : k + rows])
                    held += len(own[-1])
                    if held >= rows:
                        add()
                        held = 0
        if held:
            add()
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        if len(used):
            yield pd.DataFrame({"word": used} | {f"s{i}": total[used, i] for i in range(basis.shape[1])})

    schema = "word long, " + ", ".join(f"s{i} double" for i in range(width))
    rows = spread(texts.select("doc_id", "ids"), "doc_id").select("ids").mapInPandas(run, schema).groupBy("word").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()
    out = np.zeros_like(basis)
    for r in rows:
        out[r[0]] = r[1:]
    return out


def latent_axes(texts: DataFrame, idf: np.ndarray, rounds: int = 1) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, by randomised subspace iteration."""
    rng = np.random.default_rng(7)
    width = min(AXES + EXTRA, len(idf))
    basis = np.linalg.qr(rng.standard_normal((len(idf), width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_word_sums(texts, idf, basis))[0]
    product = _word_sums(texts, idf, basis)
    values, turn = np.linalg.eigh(basis.T @ product)
    return basis @ turn[:, ::-1][:, : min(AXES, width)]


def clusters(vectors: np.ndarray, cosine: float, rounds: int = 4) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """(centre, least cosine, rows): a unit vector within ``cosine`` of any of the rows has at least that cosine with the centre,
    because its angle with the centre is at most the sum of two angles."""
    count = max(1, int(math.sqrt(len(vectors))))
    centres = vectors[np.random.default_rng(7).choice(len(vectors), count, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), centres)
    near = vectors @ centres.T
    nearest = np.argmax(near, axis=1)
    out = []
    for k in range(count):
        rows = np.flatnonzero(nearest == k)
        if len(rows):
            wide = math.acos(min(1.0, max(-1.0, float(near[rows, k].min())))) + math.acos(cosine) + 1e-3
            out.append((centres[k], math.cos(wide) if wide < math.pi else -2.0, rows))
    return out


def leaks(docs: DataFrame, items: DataFrame, cosine: float = 0.87, least: int = 20) -> DataFrame:
    """``(doc_id, item_id, kind, span, agreeing, answer)``. Kind passage: documents whose words align with at least ``least``
    successive words of an item (or with the whole item), occasional differences aside. Kind paraphrase: see the module; span and
    agreeing are then the length of the common subsequence. answer: whether the item's answer stands in the document. One row per
    pair."""
    queries, count = items_by_block(items)
    out = None
    for block in range(count):
        found = cut(_leaks(docs, queries.where(F.col("block") == block).drop("block"), cosine, least), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string, span int, agreeing int, answer boolean")
    return _answered(out, docs, queries)


def _answered(found: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds whether the item's answer stands in the document; paraphrases without an answer of several words in place go."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            holds = []
            for text, answer in zip(part["text"], part["answer"]):
                own = words(answer)
                holds.append((bool(own) and f" {' '.join(own)} " in f" {' '.join(words(text))} ", len(own)))
            part = part.assign(answer=[h for h, _ in holds])
            keep = [k == "passage" or h and n > 1 for k, (h, n) in zip(part["kind"], holds)]
            yield part[keep][["doc_id", "item_id", "kind", "span", "agreeing", "answer"]]

    texts = docs.where("text is not null").select("doc_id", "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = found.join(texts, "doc_id").join(queries.select("item_id", "answer"), "item_id")
    return both.mapInPandas(run, "doc_id long, item_id long, kind string, span int, agreeing int, answer boolean")


def _leaks(docs: DataFrame, block: DataFrame, cosine: float, least: int) -> DataFrame:
    """:func:`leaks` for one block of items, before answers are looked at."""
    spark = docs.sparkSession
    texts_of = {int(r.item_id): words(r.body) for r in block.select("item_id", "body").collect()}  # bounded by ITEM_CHARS
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts_of.values() for w in t}))}
    schema = "doc_id long, item_id long, kind string, span int, agreeing int"
    if not vocabulary:
        return spark.createDataFrame([], schema)
    texts = cut(coded(docs, vocabulary), "coded")
    seen = texts.select(F.explode(F.array_distinct("ids")).alias("word")).where("word >= 0").groupBy("word").count().collect()  # one row per item word
    n = texts.count()
    idf = np.full(len(vocabulary), math.log(n + 1.0) + 1)
    for word, k in seen:
        idf[word] = math.log((n + 1) / (k + 1)) + 1
    axes = latent_axes(texts, idf)
    numbers = {i: np.array([vocabulary[w] for w in t]) for i, t in texts_of.items() if t}
    owner, table = [], []
    for i, ids in numbers.items():
        _, vectors = _passages(ids, ITEM_STEP, idf, axes)
        owner += [i] * len(vectors)
        table.append(vectors)
    table = np.concatenate(table)
    shared = spark.sparkContext.broadcast((idf, axes.astype(np.float32), np.array(owner), table.astype(np.float32), clusters(table, cosine), numbers))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, axes, owner, table, groups, item_ids = shared.value
        halves = _halves({i: x.tolist() for i, x in item_ids.items() if len(x) < least}, least)
        centres = np.stack([c for c, _, _ in groups]).astype(np.float32)
        limits = np.array([x for _, x, _ in groups])
        tables = [table[rows] for _, _, rows in groups]
        owners = [owner[rows] for _, _, rows in groups]
        for part in parts:
            found = []
            block: list[tuple] = []
            whole: set[tuple[int, int]] = set()
            size = 0

            def search() -> None:
                vectors = np.concatenate([v for _, _, _, v in block])
                of = np.concatenate([np.full(len(s), k) for k, (_, _, s, _) in enumerate(block)])
                at = np.concatenate([s for _, _, s, _ in block])
                open_ = vectors @ centres.T >= limits
                near: dict[tuple[int, int], list[int]] = {}
                for g in np.flatnonzero(open_.any(axis=0)):
                    rows = np.flatnonzero(open_[:, g])
                    hit, passage = np.nonzero(vectors[rows] @ tables[g].T >= cosine)
                    hit = rows[hit]
                    for k, item, start in zip(of[hit].tolist(), owners[g][passage].tolist(), at[hit].tolist()):
                        span = near.setdefault((k, item), [start, start])
                        span[0], span[1] = min(span[0], start), max(span[1], start)
                for (k, item), (lo, hi) in near.items():
                    doc, ids, _, _ = block[k]
                    own = item_ids[item]
                    if (doc, item) in whole:
                        continue
                    a = ids[max(0, lo - least - 5) : hi + WINDOW + least + 5]
                    goal = min(least, len(own))
                    span = agreeing = 0
                    if may_overlap(a, own, goal):
                        x, y = a.tolist(), own.tolist()
                        span, agreeing = best_overlap(x, y)
                        # of a window's words at least this many agree in one run, so the alignment spans them
                        if span < least <= len(own) and span >= (least - EDITS) // (EDITS + 1):
                            span, agreeing = max((span, agreeing), window(x, y, least, EDITS))
                    if span >= goal:
                        found.append((doc, item, "passage", span, agreeing))
                    elif (n := common(a[a >= 0].tolist(), own.tolist())) >= PARAPHRASE * min(len(own), len(a)):
                        found.append((doc, item, "paraphrase", n, n))
                block.clear()
                whole.clear()

            for doc, ids in zip(part["doc_id"], part["ids"]):
                ids = np.asarray(ids)
                if halves:
                    for item, agreeing in _short(ids.tolist(), item_ids, halves, least).items():
                        whole.add((doc, item))
                        found.append((doc, item, "passage", len(item_ids[item]), agreeing))
                starts, vectors = _passages(ids, STEP, idf, axes, least=KNOWN if len(ids) >= WINDOW else 0.0)
                if len(starts):
                    block.append((doc, ids, starts, vectors.astype(np.float32)))
                    size += len(starts)
                if size >= 2000:
                    search()
                    size = 0
            if block:
                search()
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "kind", "span", "agreeing"])

    return spread(texts, "doc_id").mapInPandas(run, schema)
