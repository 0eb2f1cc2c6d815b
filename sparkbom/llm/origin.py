"""Files that are not hand-written source of their repository: generated, minified, third-party copies and data.

Known originals are trees beside those of the repositories. Merkle hashes grow from file contents to directories, level by
level: the hash of a file is that of its content, the hash of a directory a sum over the names and hashes of what it holds. A
subtree, down to a single file, that stands in several unrelated repositories or in an original is a copy (reason subtree), and so
is all that lies below a directory that is named like the tree of an original outside that original's own repository (tree).
Edited or shortened copies of originals are found by shingles of five tokens (upstream): 0.8 of the smaller text's shingles agree.
Headers, lock-file pins and line shapes tell the rest (layout). Folders with a conventional name for foreign code count where
nothing else has told (folder).

Two repositories are related, as forks are, if they agree in two independent minima over the hashes of all their files, which
they do with the square of their files' Jaccard similarity.

Null contents give no verdict by content, only by tree or folder. Repeated rows count once. Files shorter than SMALL characters are
not taken for copies of each other, as the shortest files agree by chance; copies of originals are found at any length. Roots are
compared without trailing slashes. A tree as deep as d takes d rounds.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbom.llm import layout as L
from sparkbom.session import cut, spread

SMALL = 200
#: Shingles that the smaller of two texts needs at least, lest a few common lines make it a part of the other.
PART = 20
#: Originals of at most so many characters are broadcast; more of them are joined shingle by shingle.
UPSTREAM_CHARS = 50_000_000
ORIGINAL = "original:"
_index: dict[int, tuple[dict[int, list[int]], list[int]]] = {}


def _body(c: str):
    """Content without differences of white space and leading comments."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?:\s*(?:#|//|\*|/\*)[^\n]*\n)+", ""), r"\s+", " ")


def _root(c: str = "root"):
    return F.regexp_replace(c, "/+$", "")


def merkle(files: DataFrame) -> DataFrame:
    """``(root, path, level, hash, files, chars)`` of every file and every directory of ``(root, file, content)``."""
    body = _body("content")
    leaf = files.select(_root().alias("root"), F.col("file").alias("path"), F.size(F.split("file", "/")).alias("level"), F.xxhash64(body).alias("hash"), F.lit(1).cast("long").alias("files"), F.length(body).cast("long").alias("chars"))
    leaf = cut(leaf.where("root is not null and path is not null and chars is not null"), "leaves", "level")
    deepest = leaf.agg(F.max("level")).first()[0] or 0
    columns = ["root", "path", "level", "hash", "files", "chars"]
    out, below = leaf.select(columns), None
    for n in range(deepest, 1, -1):  # as many rounds as the deepest path has parts; each reads its own level only
        here = leaf.where(F.col("level") == n).select(columns)
        here = here if below is None else here.unionByName(below)
        part = F.xxhash64(F.substring_index("path", "/", -1), "hash")
        up = here.groupBy("root", F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(
            F.sum(part.bitwiseAND(0xFFFFFFFF)).alias("a"), F.sum(F.shiftrightunsigned(part, 32)).alias("b"), F.count("*").alias("n"), F.sum("files").alias("files"), F.sum("chars").alias("chars")
        )
        below = cut(up.select("root", "path", F.lit(n - 1).alias("level"), F.xxhash64("a", "b", "n").alias("hash"), "files", "chars"), "merkle")
        out = out.unionByName(below)
    return out


def families(tree: DataFrame) -> DataFrame:
    """``(root, family)``: related repositories have one family."""
    least = lambda seed: F.min(F.xxhash64("hash", F.lit(seed)))
    return tree.where(~F.col("root").startswith(ORIGINAL) & (F.col("files") == 1)).groupBy("root").agg(F.xxhash64(least(1), least(2)).alias("family"))


def shared_subtrees(tree: DataFrame) -> DataFrame:
    """``(hash, families)`` of subtrees that several unrelated repositories hold, or that an original holds."""
    known = F.col("root").startswith(ORIGINAL)
    owned = tree.join(families(tree), "root", "left").where(known | (F.col("chars") >= SMALL))
    # pre-aggregated by repository: a file that stands everywhere is one row for each
    by = owned.groupBy("hash", "family").agg(F.max(known).alias("known")).groupBy("hash").agg(F.count_distinct("family").alias("families"), F.max("known").alias("known"))
    return by.where("families > 1 or known").select("hash", "families")


def originals(upstream: DataFrame) -> DataFrame:
    """The known originals as trees of ``(root, file, content)``; one tree per library and version."""
    version = F.coalesce("version", F.lit("")) if "version" in upstream.columns else F.lit("")
    path = F.coalesce("path", F.lit("original")) if "path" in upstream.columns else F.lit("original")
    return upstream.where("content is not null").select(F.concat(F.lit(ORIGINAL), F.coalesce("library", F.lit("")), F.lit("@"), version).alias("root"), path.alias("file"), "content")


def named_trees(tree: DataFrame) -> DataFrame:
    """``(root, path)`` of directories that are named, a version aside, like the topmost directory of an original's tree, but for
    those in a repository of that name."""
    name = lambda c: F.lower(F.regexp_replace(F.substring_index(c, "/", -1), r"[-@_]?v?\d+(?:\.\d+)*$", ""))
    held = tree.where(F.col("root").startswith(ORIGINAL) & (F.col("level") > 1)).select(name(F.substring_index("path", "/", 1)).alias("name")).where("name <> ''").distinct()
    mine = tree.where(~F.col("root").startswith(ORIGINAL)).select("root", F.explode(F.expr("transform(sequence(1, level - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))")).alias("path")).where("path <> ''").distinct()
    return mine.withColumn("name", name("path")).where(F.col("name") != name("root")).join(held, "name", "left_semi").select("root", "path")


def near_copies(files: DataFrame, upstream: DataFrame, similar: float = 0.8) -> DataFrame:
    """``file_id`` of files that share at least ``similar`` of the smaller text's shingles with an original."""
    known = upstream.where("content is not null").select("content").distinct()
    if (known.agg(F.sum(F.length("content"))).first()[0] or 0) > UPSTREAM_CHARS:
        return _joined_copies(files, known, similar)
    shared, key = files.sparkSession.sparkContext.broadcast([r[0] for r in known.collect()]), uuid.uuid4().int

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, sizes = _originals_index(key, shared.value)
        for part in parts:
            hit = []
            for text in part["content"]:
                own = L.shingles(text)
                counts = Counter(i for s in own for i in index.get(s, ()))
                hit.append(any(n >= similar * (least := min(sizes[i], len(own))) and (n >= similar * sizes[i] or least >= PART) for i, n in counts.items()))
            yield part[hit][["file_id"]]

    return files.where("content is not null").select("file_id", "content").mapInPandas(run, "file_id long")


def _originals_index(key: int, texts: list[str]) -> tuple[dict[int, list[int]], list[int]]:
    """shingle -> originals, and the number of shingles of each; built once in each Python worker."""
    if key not in _index:
        index: dict[int, list[int]] = defaultdict(list)
        own = [L.shingles(t) for t in texts]
        for i, found in enumerate(own):
            for s in found:
                index[s].append(i)
        _index.clear()
        _index[key] = dict(index), [len(x) for x in own]
    return _index[key]


def _joined_copies(files: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """:func:`near_copies` for originals of any size: shingles are joined and counted per pair of file and original."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, text in zip(part["key"], part["content"]):
                own = list(L.shingles(text))
                yield pd.DataFrame({"key": key, "size": len(own), "shingle": own})

    of = lambda df: df.mapInPandas(run, "key long, size int, shingle long")
    theirs = of(known.select(F.xxhash64("content").alias("key"), "content")).toDF("original", "total", "shingle")
    mine = of(files.where("content is not null").select(F.col("file_id").alias("key"), "content"))
    pairs = mine.join(theirs, "shingle").groupBy("key", "original").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("total").alias("total"))
    least = F.least("size", "total")
    return pairs.where((F.col("n") >= similar * least) & ((F.col("n") >= similar * F.col("total")) | (least >= PART))).select(F.col("key").alias("file_id")).distinct()


def origins(files: DataFrame, upstream: DataFrame, similar: float = 0.8) -> DataFrame:
    """``(file_id, root, file, origin, reason)`` of the files that are not hand-written: origin is generated, minified, data or
    vendored."""
    one = cut(spread(files.select("file_id", "root", "file", "content"), "file_id").dropDuplicates(["file_id"]), "files")
    tree = cut(merkle(one.select("root", "file", "content").unionByName(originals(upstream))), "tree")
    copies = tree.join(shared_subtrees(tree), "hash", "left_semi").where(~F.col("root").startswith(ORIGINAL)).select("root", "path")
    # files without content belong to directories too
    places = tree.select("root", "path", "level").unionByName(one.where("content is null and file is not null").select(_root().alias("root"), F.col("file").alias("path"), F.size(F.split("file", "/")).alias("level")))
    marks = copies.withColumn("mark", F.lit(0)).unionByName(named_trees(places).withColumn("mark", F.lit(1))).groupBy("root", "path").agg(F.min("mark").alias("mark"))
    # a file is a copy if it, or a directory above it, is one: look up all its prefixes
    path = F.explode(F.expr("transform(sequence(1, size(split(file, '/'))), n -> array_join(slice(split(file, '/'), 1, n), '/'))"))
    prefixes = one.where("file is not null").select("file_id", _root().alias("root"), path.alias("path"))
    marked = prefixes.join(marks, ["root", "path"]).groupBy("file_id").agg(F.min("mark").alias("mark"))
    near = near_copies(one, upstream, similar).withColumn("near", F.lit(True))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names = part["file"].fillna("")
            kind = [L.layout(f.rpartition(".")[2].lower(), t) if t else None for f, t in zip(names, part["content"])]
            folder = [any(x.lower() in L.FOREIGN for x in f.split("/")[:-1]) for f in names]
            yield part.assign(kind=kind, folder=folder)[["file_id", "root", "file", "kind", "folder"]]

    shape = one.mapInPandas(run, "file_id long, root string, file string, kind string, folder boolean")
    out = shape.join(marked, "file_id", "left").join(near, "file_id", "left")
    reason = F.when(F.col("mark") == 0, "subtree").when(F.col("mark") == 1, "tree").when(F.col("near"), "upstream").when(F.col("kind").isNotNull(), "layout").when(F.col("folder"), "folder")
    out = out.withColumn("reason", reason).where("reason is not null")
    return out.select("file_id", "root", "file", F.when(F.col("reason") == "layout", F.col("kind")).otherwise("vendored").alias("origin"), "reason")


def handwritten(rows: DataFrame, foreign: DataFrame) -> DataFrame:
    """The rows, such as graph nodes or findings, whose ``root`` and ``file`` are hand-written source."""
    key = foreign.select(_root().alias("_root"), F.col("file").alias("_file")).distinct()
    return rows.join(key, (F.regexp_replace(rows["root"], "/+$", "") == F.col("_root")) & (rows["file"] == F.col("_file")), "left_anti")
