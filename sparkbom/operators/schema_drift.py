"""Schemas that drift between successive documents of one source: the list of all changes, and one consistent table.

Each document becomes path-value rows with raw JSON types, statistics are kept per file and path, neighbours in time are
compared, and typed columns are projected with a report of casts that failed.

Nulls and the text ``unknown`` say nothing about a field. A payload that is null or no JSON object is no document: it takes
no part in any comparison and :func:`unreadable` lists it. Redeliveries (same key) count once. Empty input gives empty
results. An id, source or time that is null leaves the row out of the sequence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbom.session import cut

#: Arrays of objects whose elements count together, with the field that names an element.
ELEMENTS = {"cryptographic_assets": "asset_id"}
#: Further elements of the same fields, rows of the table that take no part in comparisons.
MORE = {"supporting_artifacts": "asset_id"}
#: Top-level fields that are not compared; the table holds them.
SKIPPED = ("supporting_artifacts", "summary")
LEAVES = "cbom_id long, source string, generated_at timestamp_ntz, field string, types array<string>, keys array<string>, `values` array<string>, positions array<int>"

#: Documents that have a place among those of their source.
IN_SEQUENCE = "source is not null and generated_at is not null"


def json_type(value: object) -> str | None:
    """The raw JSON type of a leaf; None where the value says nothing."""
    if value is None or value == "unknown":
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "whole"
    if isinstance(value, float):
        return "fractional"
    return "list" if isinstance(value, list) else "string"


def _walk(value: object, path: str) -> Iterator[tuple[str, object]]:
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from _walk(inner, f"{path}.{name}" if path else name)
    else:
        yield path, value


def document_leaves(payload: str | None, whole: bool = False) -> dict[str, list[tuple[str, str | None, str, int | None]]] | None:
    """path -> (element key, type, value as text, element position) of one document; None if it is no JSON object. The path ''
    has an entry for each element, with the name of its array as value. Fields that are not compared are left out unless ``whole``."""
    try:
        doc = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(doc, dict):
        return None
    arrays = ELEMENTS | MORE if whole else ELEMENTS
    out: dict[str, list[tuple[str, str | None, str, int | None]]] = {"": []}
    for name, value in doc.items():
        if name in SKIPPED and not whole:
            continue
        elements = [(str(i), x) for i, x in enumerate(value)] if name in arrays and isinstance(value, list) else [("", value)]
        for i, element in elements:
            key = str(element.get(arrays[name]) or f"#{i}") if name in arrays and isinstance(element, dict) else ""
            at = int(i or 0) if name in arrays else None
            if at is not None and (i or element is not None):
                out[""].append((key, "element", name, at))
            for path, leaf in _walk(element, name):
                text = leaf if isinstance(leaf, str) else json.dumps(leaf, ensure_ascii=False)
                out.setdefault(path, []).append((key, json_type(leaf), text, at))
    return out


def path_values(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row per document and path: its raw types, and element keys with values. The path '' marks a readable document. ``whole``
    adds the fields that are not compared, and documents outside any sequence."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for cbom_id, source, at, payload in part.itertuples(index=False, name=None):
                for path, found in (document_leaves(payload, whole) or {}).items():
                    said = [x for x in found if x[1]]
                    rows.append((cbom_id, source, at, path, sorted({x[1] for x in said}), [x[0] for x in said], [x[2] for x in said], [x[3] for x in said]))
            yield pd.DataFrame(rows, columns=["cbom_id", "source", "generated_at", "field", "types", "keys", "values", "positions"])

    docs = docs.select("cbom_id", "source", "generated_at", "payload").where("cbom_id is not null")
    docs = docs if whole else docs.where(IN_SEQUENCE)
    return docs.dropDuplicates(["cbom_id"]).mapInPandas(run, LEAVES)


def unreadable(docs: DataFrame) -> DataFrame:
    """``(cbom_id, source)`` of documents whose payload is null or no JSON object."""
    good = path_values(docs).where("field = ''").select("cbom_id")
    return docs.select("cbom_id", "source").distinct().join(good, "cbom_id", "left_anti")


def successors(leaves: DataFrame) -> DataFrame:
    """``(cbom_id, next_id)``: each document and the one after it in its source.

    Documents are range-partitioned by source and time and compared within partitions; only the last document of each source
    in each partition is carried over. A source of any size is thus spread over tasks."""
    docs = leaves.where("field = ''").select("source", "generated_at", "cbom_id")
    docs = cut(docs.repartitionByRange("source", "generated_at", "cbom_id").withColumn("part", F.spark_partition_id()), "sequence")
    order = Window.partitionBy("source", "part").orderBy("generated_at", "cbom_id")
    inner = docs.select("cbom_id", "source", "part", F.lead("cbom_id").over(order).alias("next_id"))
    first = docs.groupBy("source", "part").agg(F.min_by("cbom_id", F.struct("generated_at", "cbom_id")).alias("first_id"))
    after = first.select("source", "part", F.lead("first_id").over(Window.partitionBy("source").orderBy("part")).alias("after_id"))
    return inner.join(after, ["source", "part"]).select("cbom_id", F.coalesce("next_id", "after_id").alias("next_id")).where("next_id is not null")


def changes(docs: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """``(cbom_id, field, change, new_field)`` of every document against the one before it in its source.

    A removed and an added field of one parent and one type are one renamed field if at least half of the values that both
    name carry over; of several candidates the pair with most agreeing values wins. A field outside the elements that holds
    another value in every document, such as a run id, carries over if its form does (digits aside)."""
    leaves = cut(path_values(docs), "leaves") if leaves is None else leaves
    follows = successors(leaves)
    seen = leaves.where("field <> ''").select("cbom_id", "field", "types", "keys", "values")
    fact = F.struct("types", "keys", "values")
    # every row serves as the new side of its own document and as the old side of the next one
    new = seen.select("cbom_id", "field", F.lit(None).cast(seen.select(fact.alias("x")).schema["x"].dataType).alias("old"), fact.alias("new"))
    old = seen.join(follows, "cbom_id").select(F.col("next_id").alias("cbom_id"), "field", fact.alias("old"), F.lit(None).cast(new.schema["new"].dataType).alias("new"))
    later = follows.select(F.col("next_id").alias("cbom_id"))
    both = new.join(later, "cbom_id", "left_semi").unionByName(old).groupBy("cbom_id", "field").agg(F.first("old", True).alias("old"), F.first("new", True).alias("new"))
    told = lambda side: F.size(F.col(f"{side}.types")) > 0
    change = (
        F.when(F.col("new").isNull() & told("old"), "removed")
        .when(F.col("old").isNull() & told("new"), "added")
        .when(told("old") & told("new") & (F.col("old.types") != F.col("new.types")), "retyped")
    )
    both = cut(both.withColumn("change", change).where("change is not null"), "changed")
    side = F.coalesce("old", "new")
    gone = both.where("change = 'removed'").select("cbom_id", F.col("field").alias("was"), _parent("field"), side["types"].alias("types"), side["keys"].alias("k0"), side["values"].alias("v0"))
    come = both.where("change = 'added'").select("cbom_id", F.col("field").alias("now"), _parent("field"), side["types"].alias("types"), side["keys"].alias("k1"), side["values"].alias("v1"))
    pair = gone.join(come, ["cbom_id", "parent", "types"])
    at = F.expr("filter(transform(k0, (k, i) -> struct(v0[i] as a, get(v1, cast(array_position(k1, k) - 1 as int)) as b, array_position(k1, k) > 0 as both)), x -> x.both)")
    pair = pair.withColumn("at", at).withColumn("same", F.expr("size(filter(at, x -> x.a = x.b))"))
    form = lambda v: F.regexp_replace(v, r"\d", "9")
    alike = (F.col("k0")[0] == "") & (form(F.col("v0")[0]) == form(F.col("v1")[0])) & F.col("v0")[0].rlike(r"\d")
    pair = pair.where(((F.col("same") > 0) & (F.col("same") * 2 >= F.size("at"))) | alike)
    best = lambda c: F.row_number().over(Window.partitionBy("cbom_id", c).orderBy(F.desc("same"), "was", "now"))
    pair = pair.withColumn("r0", best("was")).withColumn("r1", best("now")).where("r0 = 1 and r1 = 1").select("cbom_id", "was", "now")
    used = pair.select("cbom_id", F.explode(F.array(F.struct(F.col("was").alias("field"), F.lit("removed").alias("change")), F.struct(F.col("now").alias("field"), F.lit("added").alias("change")))).alias("u"))
    rest = both.select("cbom_id", "field", "change").join(used.select("cbom_id", "u.field", "u.change"), ["cbom_id", "field", "change"], "left_anti")
    renamed = pair.select("cbom_id", F.col("was").alias("field"), F.lit("renamed").alias("change"), F.col("now").alias("new_field"))
    return rest.withColumn("new_field", F.lit("")).unionByName(renamed)


def _parent(c: str):
    return F.regexp_replace(c, r"(^|\.)[^.]*$", "").alias("parent")


def path_statistics(leaves: DataFrame) -> DataFrame:
    """``(field, type, documents, occurrences)`` over all documents."""
    one = leaves.where("field <> ''").select("field", F.explode("types").alias("type"), F.size("values").alias("n"))
    return one.groupBy("field", "type").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


def canonical_names(stats: list[tuple[str, int]], renames: list[tuple[str, str]]) -> dict[str, str]:
    """Every field name to the most frequent name among those that renames tie together. Sizes are those of the schema."""
    group = {f: {f} for f, _ in stats}
    for a, b in renames:
        if group.setdefault(a, {a}) is not group.setdefault(b, {b}):
            group[a] |= group[b]
            for f in group[b]:
                group[f] = group[a]
    n = dict(stats)
    return {f: max(g, key=lambda x: (n.get(x, 0), x)) for f, g in group.items()}


CASTS = {"whole": "bigint", "fractional": "double", "boolean": "boolean", "list": "array<string>", "string": "string"}


def consistent_table(docs: DataFrame, of: str = "cryptographic_assets") -> DataFrame:
    """One row per document and element of ``of`` and of the arrays MORE, by the array's name (``list``) and position, and one with null
    position for a document without elements. A typed column per canonical field (its most frequent type): those of elements under
    their path below their array, all others under document_ and their path. failed_casts has the columns whose value did not fit.
    Documents without a source or time are rows, too. Only names and counts of fields, the size of the schema, reach the driver."""
    leaves = cut(path_values(docs, True), "leaves")
    stats = path_statistics(leaves).collect()
    compared = leaves.where(IN_SEQUENCE).where(~F.col("field").rlike(rf"^({'|'.join(SKIPPED)})(\.|$)"))
    moves = changes(docs, compared).where("change = 'renamed'").select("field", "new_field").distinct().collect()
    below = lambda field, array: field == array or field.startswith(f"{array}.")
    inner = lambda field: below(field, of)
    # the field of ``of`` that a field of another array stands for
    like = {r.field: next((of + r.field[len(m) :] for m in MORE if below(r.field, m)), r.field) for r in stats}
    count: dict[str, int] = {}
    for r in stats:
        count[like[r.field]] = count.get(like[r.field], 0) + (r.documents if like[r.field] == r.field else 0)
    names = canonical_names(list(count.items()), [tuple(m) for m in moves if m.field in count and inner(m.field) == inner(m.new_field)])
    votes: dict[str, dict[str, int]] = {}
    for r in stats:
        mine = votes.setdefault(names[like[r.field]], {})
        mine[r.type] = mine.get(r.type, 0) + r.documents
    kinds = {f: max(v, key=lambda t: (v[t], t)) for f, v in votes.items()}
    read = leaves.where("field = ''")
    elements = read.select("cbom_id", F.explode_outer(F.arrays_zip("values", "positions", "keys")).alias("x"))
    elements = elements.select("cbom_id", F.col("x.values").alias("list"), F.col("x.positions").alias("position"), F.col("x.keys").alias("element"))
    mapping = leaves.sparkSession.createDataFrame([(f, names[g], g != names[g]) for f, g in sorted(like.items())], "field string, canonical string, other boolean")
    rows = leaves.join(F.broadcast(mapping), "field").select("cbom_id", F.substring_index("field", ".", 1).alias("list"), "field", "canonical", "other", F.explode(F.arrays_zip("positions", "values")).alias("x"))
    # of two names of one field in one place the canonical one counts
    value = F.min_by("x.values", F.struct("other", "field"))
    out, typed, failed, taken = elements, [], [], {"cbom_id", "list", "position", "element", "failed_casts"}
    for part, key in ((True, ["cbom_id", "list", "position"]), (False, ["cbom_id"])):
        fields = sorted(f for f in kinds if inner(f) == part)
        if not fields:
            continue
        ids = [f"{part}_{i}" for i in range(len(fields))]
        places = rows.where(F.col("x.positions").isNotNull() if part else F.col("x.positions").isNull())
        wide = places.groupBy("cbom_id", *([F.col("list"), F.col("x.positions").alias("position")] if part else [])).pivot("canonical", fields).agg(value)
        out = out.join(wide.toDF(*key, *ids), key, "left")
        for f, i in zip(fields, ids):
            raw, kind = F.col(i), kinds[f]
            cast = F.from_json(raw, "array<string>") if kind == "list" else raw.try_cast(CASTS[kind])
            name = re.sub(r"\W", "_", (f[len(of) + 1 :] or "value") if part else f"document_{f}")
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            typed.append(cast.alias(name))
            failed.append(F.when(raw.isNotNull() & cast.isNull(), F.lit(name)))
    none = F.array().cast("array<string>")
    return out.select("cbom_id", "list", "position", "element", *typed, (F.array_compact(F.array(*failed)) if failed else none).alias("failed_casts"))
