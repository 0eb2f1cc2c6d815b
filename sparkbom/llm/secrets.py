"""Credentials that stand as literals in files, graph nodes and findings, and redacted texts.

All literals are indexed over the whole corpus, by a hash of 64 bits, with the number of repositories that own them and the strongest
context in which they stand. Values that many repositories share are placeholders; rare values of a usable form that somewhere stand
in a credential's context, or have the form of an issuer's token, are confirmed. An automaton of the confirmed values then re-scans
every text, so that a value is found wherever it stands, with or without its context.

The automaton is broadcast in blocks of BLOCK values, so its size is bounded however many there are. Null texts hold nothing;
repeated rows count once; texts are scanned whole. Roots count as one owner with or without a trailing slash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbom.llm.secret_text import credentials, literals, spellings, structured, usable
from sparkbom.session import cut, spread

#: A hand-made value in more repositories than this is a placeholder; a random one may be shared more widely. The numbers hold
#: for up to ROOTS repositories and grow with them. A private key is never a placeholder.
OWNERS, OWNERS_RANDOM, ROOTS = 4, 20, 40
#: Values in one automaton.
BLOCK = 100_000
TEXTS = "place string, item_id string, root string, text string"


def places(files: DataFrame | None, nodes: DataFrame | None, findings: DataFrame | None) -> DataFrame:
    """``(place, item_id, root, text)``: every field that may hold a credential. The strings of a node's properties or a
    finding's arguments stand on lines of their own, after the call that they make up."""
    root = F.regexp_replace("root", "/+$", "").alias("root")
    parts = []
    if files is not None:
        parts.append(files.where("content is not null").select(F.lit("source_files").alias("place"), F.col("file_id").cast("string").alias("item_id"), root, F.col("content").alias("text")))
    if nodes is not None:
        p = "properties."
        keywords = F.expr("transform(map_entries(properties.keywords), e -> concat(e.key, '=', coalesce(e.value, '')))")
        call = F.concat(F.coalesce(F.col(p + "resolved_name"), F.lit("")), F.lit("("), F.array_join(F.concat(F.coalesce(F.col(p + "arguments"), F.array().cast("array<string>")), F.coalesce(keywords, F.array().cast("array<string>"))), ", "), F.lit(")"))
        text = F.concat_ws("\n", F.col(p + "code"), F.array_join(p + "parameters", "\n"), F.when(F.col(p + "arguments").isNotNull() | F.col(p + "keywords").isNotNull(), call), F.col(p + "callee"), F.expr("array_join(transform(properties.literal_arguments, x -> x.repr), '\n')"))
        parts.append(nodes.where("id is not null and properties is not null").select(F.lit("nodes").alias("place"), F.col("id").alias("item_id"), root, text.alias("text")))
    if findings is not None:
        text = F.concat(F.coalesce("api_name", F.lit("")), F.lit("("), F.array_join("arguments", ", "), F.lit(")"))
        parts.append(findings.where("arguments is not null").select(F.lit("findings").alias("place"), F.col("finding_id").cast("string").alias("item_id"), root, text.alias("text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # repeated rows count once; a file's text is the same in all its rows
    return spread(out.where("item_id is not null"), "item_id").dropDuplicates(["place", "item_id"])


def fields(found: DataFrame, files: DataFrame | None, nodes: DataFrame | None, findings: DataFrame | None) -> DataFrame:
    """``(place, item_id, field, text)``: each string by itself, by its path, of the items that ``found`` names."""
    p = "properties."
    one = lambda path, text: F.array(F.struct(F.lit(path).alias("field"), F.col(text).alias("text")))
    many = lambda path, value="x": F.expr(f"coalesce(transform({path}, (x, i) -> struct(concat('{path}[', i, ']{value[1:]}') as field, {value} as text)), array())")
    keywords = F.expr("coalesce(transform(map_entries(properties.keywords), e -> struct(concat('properties.keywords.', e.key) as field, e.value as text)), array())")
    strings = F.concat(*(one(p + c, p + c) for c in ("code", "resolved_name", "callee")), many(p + "parameters"), many(p + "arguments"), many(p + "literal_arguments", "x.repr"), keywords)
    out = None
    for place, rows, key, texts in (("source_files", files, "file_id", one("content", "content")), ("nodes", nodes, "id", strings), ("findings", findings, "finding_id", F.concat(one("api_name", "api_name"), many("arguments")))):
        if rows is not None:
            mine = rows.withColumn("item_id", F.col(key).cast("string")).join(found.where(F.col("place") == place).select("item_id"), "item_id", "left_semi")
            part = mine.select(F.lit(place).alias("place"), "item_id", F.explode(texts).alias("x")).select("place", "item_id", "x.field", "x.text").where("text is not null")
            out = part if out is None else out.unionByName(part)
    return out


def literal_index(texts: DataFrame) -> DataFrame:
    """``(key, secret, owners, places, strength)`` of every literal: key is a hash of it, strength that of its strongest context (0: no
    credential's), and secret the value itself where there is a context, null elsewhere."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seen: dict[tuple[int, int], list] = {}
            for root, text in zip(part["root"], part["text"]):
                found = credentials(text)
                for value, n in Counter(literals(text)).items():
                    row = seen.setdefault((xxhash.xxh3_64_intdigest(value) - (1 << 63), root), [0, 0, None])
                    row[0] += n
                for value, strength in found.items():
                    row = seen.setdefault((xxhash.xxh3_64_intdigest(value) - (1 << 63), root), [0, 0, None])
                    row[0], row[1], row[2] = max(1, row[0]), max(strength, row[1]), value
            yield pd.DataFrame([(k, r, *row) for (k, r), row in seen.items()], columns=["key", "root", "n", "strength", "secret"])

    found = texts.select(F.xxhash64("root").alias("root"), "text").mapInPandas(run, "key long, root long, n long, strength int, secret string")
    by_root = found.groupBy("key", "root").agg(F.sum("n").alias("n"), F.max("strength").alias("strength"), F.max("secret").alias("secret"))
    return by_root.groupBy("key").agg(F.max("secret").alias("secret"), F.count("root").alias("owners"), F.sum("n").alias("places"), F.max("strength").alias("strength"))


def confirmed(index: DataFrame, roots: int = 0) -> DataFrame:
    """``(secret, owners)`` of the values that are no placeholders among ``roots`` repositories."""
    scale = max(1.0, roots / ROOTS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            key = part["secret"].str.startswith("-----BEGIN").astype(bool)
            random = part["secret"].map(structured).astype(bool) | key
            limit = random.map(lambda r: scale * (OWNERS_RANDOM if r else OWNERS))
            yield part[((part["owners"] <= limit) | key) & (part["strength"] >= random.map(lambda r: 1 if r else 2))][["secret", "owners"]]

    return index.where("strength > 0 and secret is not null").mapInPandas(run, "secret string, owners long")


def _automaton(secrets: list[str]) -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for secret in secrets:
        for spelling in spellings(secret):
            words.add_word(spelling, spelling)
    words.make_automaton()
    return words


def _weak(secret: str) -> bool:
    """Whether only its name makes a value a credential, so that it is none in a text that does not name it."""
    return not secret.startswith("-----BEGIN") and not usable(secret)


def _spans(words: ahocorasick.Automaton, text: str, named: bool = False) -> list[tuple[int, str]]:
    """(start, secret) of whole values, also where they overlap. named: all of them are known to be named in the item of which
    the text is a field, in which a value may stand without quotes."""
    spans, own = [], None
    for end, secret in words.iter(text):
        start = end + 1 - len(secret)
        before, after = text[start - 1 : start], text[end + 1 : end + 2]
        escaped = re.search(r"(?<!\\)\\[nrt]$", text[max(0, start - 3) : start])
        if (secret[0].isalnum() and before.isalnum() and not escaped) or (secret[-1].isalnum() and after.isalnum()):
            continue
        if _weak(secret) and named:
            if after not in "\"'`" or before not in "\"'`: ":
                continue
        elif _weak(secret):
            own = credentials(text) if own is None else own
            if secret not in own or not after or after not in "\"'`" or not before or before not in "\"'`: ":
                continue
        spans.append((start, secret))
    return spans


def _apart(spans: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of values that overlap the longest."""
    out: list[tuple[int, str]] = []
    for start, secret in sorted(spans, key=lambda x: (-len(x[1]), x[0])):
        if all(start + len(secret) <= a or a + len(s) <= start for a, s in out):
            out.append((start, secret))
    return out


def occurrences(texts: DataFrame, secrets: DataFrame) -> DataFrame:
    """``(place, item_id, secret)``: every confirmed value in every text. Values are collected one block at a time; overlaps are
    resolved over the hits of all blocks."""
    spark = texts.sparkSession
    count = -(-secrets.count() // BLOCK)
    out = None
    for i in range(count):
        block = [r[0] for r in secrets.where(F.pmod(F.xxhash64("secret"), F.lit(count)) == i).select("secret").collect()]
        if not block:
            continue
        shared = spark.sparkContext.broadcast(block)
        del block

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words = _automaton(shared.value)
            for part in parts:
                hits = ((p, i, _spans(words, t)) for p, i, t in zip(part["place"], part["item_id"], part["text"]))
                rows = [(p, i, at, s) for p, i, spans in hits for at, s in (_apart(spans) if count == 1 else spans)]
                yield pd.DataFrame(rows, columns=["place", "item_id", "at", "secret"])

        found = texts.select("place", "item_id", "text").mapInPandas(run, "place string, item_id string, at long, secret string")
        if count > 1:
            found = cut(found, "hits")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return texts.select("place", "item_id", F.lit("").alias("secret")).where("false")
    if count > 1:

        def apart(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [(p, i, s) for p, i, hits in zip(part["place"], part["item_id"], part["hits"]) for _, s in _apart([(h["at"], h["secret"]) for h in hits])]
                yield pd.DataFrame(rows, columns=["place", "item_id", "secret"])

        out = out.groupBy("place", "item_id").agg(F.collect_list(F.struct("at", "secret")).alias("hits")).mapInPandas(apart, "place string, item_id string, secret string")
    return out.select("place", "item_id", "secret").distinct()


def secrets_of(texts: DataFrame) -> DataFrame:
    """``(secret, owners)`` of the confirmed values of all texts."""
    return confirmed(literal_index(texts), texts.select("root").distinct().count())


def steps(files: DataFrame | None, nodes: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """``(step, n)``: literals indexed, those in a credential's context, those confirmed, and places found by the automaton."""
    texts = cut(places(files, nodes, findings), "texts")
    index = cut(literal_index(texts), "literals")
    secrets = cut(confirmed(index, texts.select("root").distinct().count()), "secrets")
    count = lambda df, step: df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n")
    out = count(index, "indexed").unionByName(count(index.where("strength > 0"), "in context")).unionByName(count(secrets, "confirmed"))
    return out.unionByName(count(occurrences(texts, secrets), "found"))


def find(files: DataFrame | None, nodes: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """``(place, item_id, secret)`` over all given tables."""
    texts = cut(places(files, nodes, findings), "texts")
    return occurrences(texts, cut(secrets_of(texts), "secrets"))


def masked(secret: str) -> str:
    """A text of the same length, line structure and escapes in which no character of the value is left."""
    return re.sub(r"(\\.)|[^\s\\-]", lambda m: m[1] or "X", secret)


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``(place, item_id, text)``, with a column field if ``texts`` has one, of the texts that hold credentials, with every one
    masked in place."""
    keys = [c for c in ("place", "item_id", "field") if c in texts.columns]
    mine = found.groupBy("place", "item_id").agg(F.collect_set("secret").alias("secrets"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for text, secrets in zip(part["text"], part["secrets"]):
                for start, secret in _apart(_spans(_automaton(list(secrets)), text, True)):
                    text = text[:start] + masked(secret) + text[start + len(secret) :]
                done.append(text)
            part = part.assign(masked=done)
            part = part[part["masked"] != part["text"]]
            yield part.drop(columns=["text"]).rename(columns={"masked": "text"})[[*keys, "text"]]

    one = texts.dropDuplicates(keys).join(mine, ["place", "item_id"])
    return one.select(*keys, "text", "secrets").mapInPandas(run, ", ".join(f"{c} string" for c in (*keys, "text")))
