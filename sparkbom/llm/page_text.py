"""How much of a page is lists or repeated key phrases rather than sentences (a small per-page helper)."""

from __future__ import annotations

import re
from collections import Counter

_LINK = re.compile(r"\w+://|<a\s|\bwww\.|\]\(", re.I)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_SEGMENT = re.compile(r"\n+|(?<=[.!?])\s+|\s+[|/»•·›>]\s+|\s*•\s*|(?=<a\s)")
_WORD = re.compile(r"\w+")


def list_share(text: str, heads: list[frozenset[str]]) -> float:
    """Share of the words outside code blocks that stand in list entries (links, menus, tags, products, bare key phrases)
    or in sentences that repeat the page's key phrase. heads: the most usual words of each language; a segment's words are set
    against the language they fit best."""
    text = _CODE.sub("\n", text)
    words = _WORD.findall(text.lower())
    pairs = Counter(zip(words, words[1:]))
    plain = lambda p: any(p[0] in h and p[1] in h for h in heads)
    most, phrase = max(((n, p) for p, n in pairs.items() if n > 3 and not plain(p)), default=(0, ("", "")))
    # a key phrase of usual words is not usual where it fills the page
    stuffed = set(phrase) if most * 5 > len(words) else set()
    spam = total = 0
    for segment in _SEGMENT.split(text):
        own = _WORD.findall(segment.lower())
        if not own:
            continue
        total += len(own)
        usual = max((sum(w in h and w not in stuffed for w in own) for h in heads), default=0) / len(own)
        named = sum(p == phrase for p in zip(own, own[1:]))
        if _LINK.search(segment):
            spam += len(own)
        elif most and (named >= 2 and named * 12 >= len(own) or named and most * 8 > len(words)):
            spam += len(own)
        elif segment.rstrip(" \"')*_")[-1:] in ".!?:" and len(own) >= 4:
            spam += len(own) * (usual < 0.04 and len(own) > 30)
        elif usual < 0.1:
            spam += len(own)
    return spam / total if total else 0.0
