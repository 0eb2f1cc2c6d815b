"""Python files to graph rows: functions, calls, containment edges, imports and assignments.

Parsing one file is a small helper in a task; everything after it is joins. A file that cannot be parsed gives no rows here and
one row in :func:`parse_errors`. Null contents give neither. Text is only parsed, never run.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkbom.session import spread

ROWS = "root string, file string, what string, id string, seq int, name string, line int, function string, parent string, target string, parameters array<string>, arguments array<string>, keywords map<string,string>, code string, literals array<struct<py_type:string,repr:string>>"
_COLUMNS = [x.strip().split(" ")[0] for x in ROWS.split(", ")]


def source_tree(spark: SparkSession, path: str, suffix: str = ".py") -> DataFrame:
    """``(root, file, content)`` of all files below a folder whose path has no hidden part."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    base = path.rstrip("/")
    file = F.regexp_replace("path", r"^file:/*", "/")
    return raw.select(F.lit(base).alias("root"), F.replace(file, F.lit(base + "/"), F.lit("")).alias("file"), F.col("value").alias("content")).where(~F.col("file").rlike(r"(^|/)\."))


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    return ast.unparse(node)


def file_rows(root: str, file: str, content: str) -> list[tuple]:
    """All rows of one file; raises SyntaxError."""
    module = file.rpartition("/")[2].removesuffix(".py")
    out: list[tuple] = []
    alias: dict[str, str] = {}

    def row(what: str, **kw: object) -> None:
        out.append((root, file, what, kw.get("id"), len(out), kw.get("name"), kw.get("line"), kw.get("function"), kw.get("parent"), kw.get("target"), kw.get("parameters"), kw.get("arguments"), kw.get("keywords"), kw.get("code"), kw.get("literals")))

    stack: list[tuple[ast.AST, str | None, str | None]] = [(ast.parse(content), None, None)]
    while stack:
        node, function, holder = stack.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                target = a.name if isinstance(node, ast.Import) else f"{node.module or ''}.{a.name}"
                alias[a.asname or a.name] = target
                row("import", name=a.asname or a.name, target=target, line=node.lineno)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function, holder = f"{module}.{node.name}", f"{root}/{file}:{node.lineno}:function:{node.name}"
            row("function", id=holder, name=function, line=node.lineno, function=function, parameters=[a.arg for a in node.args.args], code=ast.unparse(node))
        elif isinstance(node, ast.Call):
            name = dotted(node.func)
            first, dot, rest = name.partition(".")
            here = f"{root}/{file}:{node.lineno}:{node.col_offset}:{node.end_lineno}:{node.end_col_offset}"  # chained calls share their start
            literals = [(type(a.value).__name__, repr(a.value)) for a in node.args if isinstance(a, ast.Constant)]
            row("call", id=here, name=name, target=alias.get(first, first) + dot + rest, line=node.lineno, function=function, parent=holder, arguments=[ast.unparse(a) for a in node.args], keywords={k.arg: ast.unparse(k.value) for k in node.keywords if k.arg}, literals=literals)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                for n in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                    if isinstance(n, ast.Name):
                        row("assignment", name=n.id, target=ast.unparse(node.value), line=node.lineno, function=function)
        stack += [(child, function, holder) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def parse(files: DataFrame) -> DataFrame:
    """One row per function, call, import and assignment of every Python file that parses."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for root, file, content in part.itertuples(index=False, name=None):
                try:
                    rows += file_rows(root or "", file, content)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(rows, columns=_COLUMNS)

    one = files.where("content is not null and file is not null and lower(file) like '%.py'").select("root", "file", "content")
    return spread(one, "root", "file").distinct().mapInPandas(run, ROWS)


def calls(rows: DataFrame) -> DataFrame:
    """Parsed calls in the form of call nodes."""
    types = F.transform("literals", lambda x: x["py_type"]).alias("literal_types")
    return rows.where("what = 'call'").select("root", "id", "name", "file", "line", "function", F.col("target").alias("resolved_name"), F.col("name").alias("callee"), "arguments", "keywords", types).dropDuplicates(["id"])


def nodes(rows: DataFrame) -> DataFrame:
    """Parsed functions and calls as graph nodes."""
    p = "struct<parameters:array<string>,code:string,arguments:array<string>,keywords:map<string,string>,resolved_name:string,callee:string,literal_arguments:array<struct<py_type:string,repr:string>>>"
    call = F.col("what") == "call"
    properties = F.struct("parameters", "code", "arguments", "keywords", F.when(call, F.col("target")).alias("resolved_name"), F.when(call, F.col("name")).alias("callee"), F.col("literals").alias("literal_arguments")).cast(p)
    return rows.where("what in ('function', 'call')").select("root", "id", F.col("what").alias("kind"), "name", "file", "line", "function", properties.alias("properties"))


def parse_errors(files: DataFrame) -> DataFrame:
    """``(root, file)`` of the Python files that give no rows although they hold text."""
    py = files.where("content is not null and lower(file) like '%.py' and trim(content) <> ''").select("root", "file").distinct()
    return py.join(parse(files).select("root", "file").distinct(), ["root", "file"], "left_anti")


def containment(rows: DataFrame) -> DataFrame:
    """``(source, target, kind)``: a bag with one edge per call within a function."""
    return rows.where("what = 'call' and parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("AST_FUNCTION").alias("kind"))


def resolve(rows: DataFrame) -> DataFrame:
    """Calls with the assignment, if any, that a bare first argument was last given in the same function."""
    calls = rows.where("what = 'call'").select("root", "file", "function", "id", "name", "target", "arguments", F.get("arguments", F.lit(0)).alias("first_argument"))
    given = rows.where("what = 'assignment'").groupBy("root", "file", "function", F.col("name").alias("first_argument")).agg(F.max_by("target", "seq").alias("assigned"))
    same = (calls["root"] == given["root"]) & (calls["file"] == given["file"]) & calls["function"].eqNullSafe(given["function"]) & (calls["first_argument"] == given["first_argument"])
    return calls.join(given, same, "left").select(calls["id"], calls["name"], calls["target"], calls["first_argument"], given["assigned"])


def boundary_scan(files: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``(root, file, line, function, api)``: a line scan that needs no parser. The first known call that a line holds counts;
    function is the last ``def`` before it."""
    lines = files.where("content is not null and lower(file) like '%.py'").select("root", "file", "content").distinct().select("root", "file", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("pos", "text"))
    api = F.get(F.filter(F.array(*(F.lit(k) for k in known)), lambda k: F.contains(F.col("text"), F.concat(k, F.lit("(")))), F.lit(0))
    name = F.nullif(F.regexp_extract("text", r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1), F.lit(""))
    w = Window.partitionBy("root", "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("function", F.last(name, True).over(w)).withColumn("api", api).where("api is not null").select("root", "file", (F.col("pos") + 1).alias("line"), "function", "api")
