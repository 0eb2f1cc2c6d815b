"""Header and layout rules for one source file (small per-file helpers)."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

#: Folders that hold the code of others by convention.
FOREIGN = frozenset("vendor _vendor vendored node_modules bower_components jspm_packages third_party thirdparty third-party site-packages dist-packages pods carthage deps external extern externals".split())
_MARK = re.compile(
    r"code generated by|generated by .{0,60}do not|do not (?:edit|modify)|@generated\b|<auto-?generated|auto-?generated (?:file|code|by|from)|automatically (?:produced|generated)|will be (?:lost|overwritten) (?:on|when|by)|this file (?:is|was) generated", re.I
)
_ANNOTATION = re.compile(r"^\s*@(?:[\w.]+\.)?Generated\b", re.M)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|;|<!--|--|\"\"\"|''')")
_LINE = re.compile(r"[^\n]+")
_TEXT = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"")
_NUMBERED = re.compile(r"\b[A-Za-z_]*[A-Za-z_]\d+\w*")
_PIN = re.compile(r"[\"']?(?:integrity|checksum|hash|resolved)[\"']?\s*[:=]\s*\"(?:sha\d+[-:]|[0-9a-f]{40,}|https?:)", re.I)
CODE = frozenset(("py", "js", "java"))


def header_says_generated(text: str) -> bool:
    """A marker in the comments before the first line of code, or a Generated annotation."""
    for m in _LINE.finditer(text.lstrip("\ufeff")):
        line = m[0]
        if not line.strip():
            continue
        if not _COMMENT.match(line):
            break
        if _MARK.search(line):
            return True
    return bool(_ANNOTATION.search(text))


def layout(extension: str, text: str) -> str | None:
    """generated, minified or data, by the shape of the lines; None for what people write."""
    if header_says_generated(text):
        return "generated"
    lines = [x for x in text.split("\n") if x.strip()]
    if len(_PIN.findall(text)) >= 3 and extension not in CODE:
        return "generated"
    if extension not in CODE or not lines:
        return None
    shapes: Counter[str] = Counter()
    numbered = 0
    for line in lines:
        bare = _TEXT.sub("\x01", line)
        shapes["".join(sorted(set(re.findall(r"[^\w\s]", bare)) - {"-", "+"}))] += 1
        numbered += len({re.sub(r"\d", "9", w) for w in _NUMBERED.findall(bare)} - {"sha999", "sha9", "md9"}) > 0
    alike = max(shapes.values()) / len(lines)
    if len(lines) >= 10 and alike >= 0.6 and not sum(x.lstrip().startswith(("import ", "from ", "//", "#")) for x in lines) * 2 > len(lines):
        return "data" if sum(map(len, _TEXT.findall(text))) + len(re.findall(r"[\d,.\s]", text)) > 0.6 * len(text) or text.lstrip()[:1].islower() and "=" not in text[:200] else "generated"
    if len(lines) >= 12 and numbered >= 0.7 * len(lines):
        return "generated"
    # statements run together in long lines; a long string or a long chain of calls is one statement
    packed = sum(len(x) for x in lines if len(x) > 200 and (bare := _TEXT.sub("\x01", x)).count(";") >= max(3, len(bare) / 250))
    if packed >= 0.5 * len(text):
        return "minified"
    solid = sum(len(x) for x in _TEXT.findall(text) if len(x) > 200 and not re.search(r"\s", x))
    return "data" if solid >= 0.7 * len(text) else None


_TOKEN = re.compile(r"\w+|[^\w\s]")


def shingles(text: str) -> set[int]:
    """Hashes of five successive tokens, the same in every process."""
    t = _TOKEN.findall(text)
    return {xxhash.xxh3_64_intdigest("\0".join(t[i : i + 5])) - (1 << 63) for i in range(max(1, len(t) - 4))}
