"""Source files that do not parse in the language of their extension.

Every file is parsed whole by tables built from the bundled grammars; the first token that no reading of the grammar accepts
is the error that is reported.

Null content or a file name without a known extension: no verdict, status ``unread`` or ``unknown``. Empty py, js, java and
toml files parse, empty json files do not. Repeated rows of one file count once. Line ends of all kinds are taken as they are.
A file on which the parser itself fails has status ``failed``, so that it ends no job and is seen in the rates.

Beyond the grammars: names that a TOML document defines twice and days that do not exist, escapes and bytes literals of Python,
and in JavaScript what a word or brace is by the function around it. Early errors that need names to be resolved, such as a
variable declared twice or a jump without its loop, are not looked for.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbom.llm import grammars, lexers
from sparkbom.llm.tables import Stack, Tables
from sparkbom.session import spread

LANGUAGES = {
    "py": ("python", grammars.PYTHON, lexers.python_tokens),
    "js": ("javascript", grammars.JAVASCRIPT, lexers.javascript_tokens),
    "java": ("java", grammars.JAVA, lexers.java_tokens),
    "json": ("json", grammars.JSON, lexers.json_tokens),
    "toml": ("toml", grammars.TOML, lexers.toml_tokens),
}


@functools.cache
def tables(extension: str) -> Tables:
    """Built once in each Python worker."""
    return Tables(LANGUAGES[extension][1])


def first_error(extension: str, text: str) -> tuple[int, str] | None:
    """(line, reason) of the first error that cannot be recovered from, or None if the text parses as a whole."""
    stack, line = Stack(tables(extension)), 1
    try:
        for terminals, line, fresh in LANGUAGES[extension][2](text, stack):
            if stack.push(terminals):
                continue
            # a missing semicolon may be put in before a token on a new line or a closing brace
            if extension == "js" and (fresh or terminals[0] == "}") and stack.push(("ASI",)) and stack.push(terminals):
                continue
            return line, "unexpected " + terminals[0]
    except lexers.BadToken as e:
        return e.args[0], "no token"
    if not stack.finish():
        if not (extension == "js" and stack.push(("ASI",)) and stack.finish()):
            return line, "unexpected end"
    if extension == "toml" and (twice := lexers.toml_conflict(text)):
        return twice, "defined twice"
    return None


def verdict(extension: str, text: str | None) -> tuple[str, int | None, str | None]:
    """(status, line, reason) of one file."""
    if extension not in LANGUAGES:
        return "unknown", None, None
    if text is None:
        return "unread", None, None
    try:
        error = first_error(extension, text)
    except Exception as e:  # a fault of the parser is no verdict on the file
        return "failed", None, type(e).__name__
    return ("broken", *error) if error else ("parsed", None, None)


def extension_of(file: str):
    return F.lower(F.regexp_extract(F.col(file), r"\.([A-Za-z0-9]+)$", 1))


def parse_status(files: DataFrame) -> DataFrame:
    """``(file_id, root, file, language, status, line, reason)``, one row per file: status is parsed, broken, unread, unknown or
    failed; language is that of the extension."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [verdict(e, c) for e, c in zip(part["extension"], part["content"])]
            part = part.assign(status=[f[0] for f in found], line=pd.array([f[1] for f in found], dtype="Int32"), reason=[f[2] for f in found])
            yield part[["file_id", "root", "file", "extension", "status", "line", "reason"]]

    one = spread(files.select("file_id", "root", "file", "content"), "file_id").dropDuplicates(["file_id"]).withColumn("extension", F.coalesce(extension_of("file"), F.lit("")))
    out = one.mapInPandas(run, "file_id long, root string, file string, extension string, status string, line int, reason string")
    language = F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[0])))[F.col("extension")]
    return out.select("file_id", "root", "file", language.alias("language"), "status", "line", "reason")


def rates(status: DataFrame) -> DataFrame:
    """``(root, language, files, broken, failed, rate)`` of the files that were read; rate is broken over those with a verdict."""
    kept = status.where("status in ('parsed', 'broken', 'failed')")
    count = lambda s: F.count_if(F.col("status") == s)
    return kept.groupBy("root", "language").agg(F.count("*").alias("files"), count("broken").alias("broken"), count("failed").alias("failed"), (count("broken") / F.nullif(F.count("*") - count("failed"), F.lit(0))).alias("rate"))
