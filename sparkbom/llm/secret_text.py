"""Credential literals within one text (small per-text helpers)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick

_WORD = r"passw(?:or)?d|passwd|passwort|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|priv[_-]?key|secret[_-]?key|signing[_-]?key|sign[_-]?key|encryption[_-]?key|enc[_-]?key|master[_-]?key|mac[_-]?key|hmac[_-]?key|auth(?:orization)?|credentials?|bearer"
#: Names that speak about a credential, or of something else, without holding one.
_NOT = re.compile(r"(?:hint|field|name|url|uri|prefix|env|len(?:gth)?|size|type|sha\d*|md5|commit|checksum|param|pattern|regex|count|limit|algorithm|host|endpoint|public\w*)$|public|pub_?key", re.I)
#: Endings that may as well be a word of their own: then only digests are left out.
_MAYBE_NOT = re.compile(r"(?:header|path|file|id|ttl|digest|hash|label)$", re.I)
_NAME = re.compile(rf"(?:^|[^a-z])pass(?:$|[^a-z])|(?:^|[^a-z])(?:{_WORD})|(?:{_WORD})(?:[^a-z]|$)|(?:password|secret|token|apikey|accesskey|privatekey|passphrase)", re.I)
_KEY = re.compile(r"(?:^|_)key$|^key(?:_|$)|Key$")
_QUOTED = r"""(?P<q>\"\"\"|'''|["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"""
#: name = "value", name: "value", "name": "value", x["name"] = "value", name="value" as argument or default
_ASSIGN = re.compile(rf"""(?<![\w.-])(?P<n>[\w.-]++)["'`]?\]?\s*+(?P<type>:\s*[A-Za-z][\w\[\], .]*)?\s*(?:=>|:=|=(?!=)|:)\s*(?P<call>[A-Za-z_][\w.]*\(\s*)?(?:[bBrRuU]{{0,2}}){_QUOTED}""")
_LITERAL = re.compile(rf"[bBrRuUfF]{{0,2}}{_QUOTED}")
#: Any literal, in one of three groups.
_ANY = re.compile(r""""([^\"\\\n]*(?:\\.[^\"\\\n]*)*)\"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|`([^`\\\n]*(?:\\.[^`\\\n]*)*)`""")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----)[\s\S]){20,}?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SCHEME = re.compile(r"(?:bearer|basic|token|apikey|digest)\s+(?P<s>[^\s\"'`,;]+)\s*$", re.I)
_SENT = re.compile(r"(?:^|[\"'`:,\s])(?:bearer|basic)\s+(?P<s>[A-Za-z0-9._~+/=:@!-]{8,})", re.I)
_URL_USER = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/\"'`:@]*:(?P<s>[^\s/\"'`@]+)@[\w.-]")
_URL_PARAM = re.compile(rf"[?&;](?:[\w.-]*(?:{_WORD})|key|sig)=(?P<s>[^&\s\"'`#]+)", re.I)
_CRYPTO = re.compile(
    r"(?:\b(?:AES|DES3?|Blowfish|ARC[24]|ChaCha20\w*|Salsa20)\.new\(|\bFernet\(|\bMultiFernet\(|\b(?:AESGCM|AESCCM|AESOCB3|ChaCha20Poly1305)\(|\balgorithms\.\w+\(|\b(?:hmac\.new|HMAC|hmac\.HMAC|hmac\.digest)\(|\bcreate(?:Hmac|Cipheriv|Decipheriv)\(\s*['\"][^'\"]*['\"]\s*,|\bnew SecretKeySpec\(|\bjwt\.(?:encode|decode|sign|verify)\([^,()]*(?:\([^()]*\)|\{[^{}]*\})?[^,()]*,|\b(?:login|authenticate)\([^,()\"']*(?:[\"'][^\"']*[\"'])?[^,()\"']*,)\s*(?:key\s*=\s*)?(?:[A-Za-z_][\w.]*\(\s*)?[bBrRuU]{0,2}"
    + _QUOTED
)
#: user and password side by side: in a remark, or as the last two arguments of a connection
_LOGIN = re.compile(r"(?:#|//|/?\*|--)[^\n]*\b(?:login|credentials?|account|password)\b[^\n]*:\s*[\w.@-]+\s*/\s*(?P<s>\S+)", re.I)
_CONNECT = re.compile(r"\b(?:getConnection|connect|login|createConnection)\(\s*\"[^\"\n]*\"\s*,\s*\"[^\"\n]*\"\s*,\s*\"(?P<s>[^\"\n]*)\"", re.I)
#: name, then value, as two arguments; between tags; and after a colon or an equals sign in a remark
_PAIR = re.compile(rf"\(\s*[\"'](?P<n>[\w.-]+)[\"']\s*,\s*[bBrRuU]{{0,2}}{_QUOTED}")
_BETWEEN = re.compile(r"<(?P<n>[A-Za-z][\w.-]*)>(?P<s>[^<>\s]+)</(?P=n)>")
_NOTED = re.compile(r"^[ \t]*(?:#|//|\*)[^\S\n]*(?P<n>[\w.-]+)[^\S\n]*[:=][^\S\n]*(?P<s>[^\s\"'`,;(){}\[\]<>]+)[^\S\n]*$", re.M)
#: Tokens that their issuers give a form of its own.
_ISSUED = re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,}|(?:AKIA|ASIA)[A-Z0-9]{16}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9_-])")
_MARKER = re.compile(r"//|#|/\*")
_SPEAKS = re.compile(rf"\b(?:{_WORD}|key)\b", re.I)
_CLEARED = re.compile(r"placeholder|example|dummy|fake|sample value|digest|checksum|public|not a (?:secret|password)|iv\b|nonce|salt", re.I)
_IDENT = re.compile(r"[A-Za-z_]+(?:[._-][A-Za-z_]+)*$")
_HOLDER = re.compile(r"\$\{|\{\{|\{[\w.]*\}|%\(|%s(?![a-z])|<[^<>]*>|\$\(|^\$[A-Z_]|^(.)\1+$|changeme|change[-_ ]me|your[-_ ]|example|placeholder|redacted|dummy|xxxx|\*\*\*|\.\.\.|set-?me|todo|fixme|insert|replace|n/a|^env:|^vault:|process\.env|os\.environ", re.I)
_HEX = re.compile(r"[0-9a-fA-F]+$")


#: Names that end in a word for a pass word or phrase, and what such a field holds where it describes a form or a schema.
_PHRASE = re.compile(r"(?:pass(?:word|wd|phrase)?|passwort|pwd)\d*$", re.I)
_FORM = re.compile(r"(?:string|text|str|varchar|bytes|hidden|input|object|required|optional|none|null|nil|true|false|undefined|default|unknown|empty|prompt|plain|basic)$|\b(?:your|please|enter|must|invalid|required|missing|expected|cannot|wrong)\b|^[A-Z].*\s.*[.:?!]$", re.I)
_FILE = re.compile(r"\.[A-Za-z]\w{0,4}$")


#: Words of which a text holds at least one where any of the patterns above matches: those of names, and those of calls.
_NAMING = frozenset("pass pwd secret token key auth cred bearer login".split())
_CIPHERS = frozenset("login auth aes des.new des3 fernet chacha blowfish arc2 arc4 salsa hmac jwt cipher algorithms. secret".split())
_CONTEXT = ahocorasick.Automaton()
_ISSUERS = frozenset("ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ akia asia sk_live_ sk_test_ xox aiza glpat- npm_ eyj".split())
for _w in {*_NAMING, *_CIPHERS, *_ISSUERS, *"basic account connect :// sig=".split()}:
    _CONTEXT.add_word(_w, _w)
_CONTEXT.make_automaton()


def entropy(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def usable(value: str) -> bool:
    """Whether a literal can be a credential: no placeholder, reference, field name, sentence or path."""
    if len(value) < 8 or _HOLDER.search(value) or re.search(r"\s", value) or value.startswith(("/", "./", "../", "http://", "https://")):
        return False
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    if len(set(value)) < 5:
        return False
    if value.isascii() and value.isalpha():  # letters alone: only without the look of words
        return len(value) >= 10 and len(re.findall("[a-z][A-Z]", value)) >= 2 and bool(re.search("[A-Z]{2}[a-z]|[A-Z]{3}", value))
    return not _IDENT.match(value) and (bool(re.search(r"\d", value)) or classes >= 3)


def named_usable(name: str, value: str) -> bool:
    """Whether a literal that a credential's name is given can be one: also short values, pass phrases of words with blanks or
    joiners between them, and random values that begin with a slash. Under four characters nothing tells a value from a mark."""
    if usable(value):
        return True
    if len(value) < 4 or _HOLDER.search(value) or _FORM.search(value) or len(set(value)) < 3 or re.search(r"[\n\t]|\w+://", value):
        return False
    if value.startswith(("/", "./", "../")):
        return len(value) >= 8 and not re.search(r"\s", value) and not _FILE.search(value) and all(re.search(c, value) for c in ("[a-z]", "[A-Z]", r"\d"))
    phrase = bool(_PHRASE.search(name)) and not _NAME.search(value)
    if re.search(r"\s", value):  # pass phrases of words
        return len(value.split()) >= 3 and (phrase or bool(re.search(r"(?:secret|credentials?)$", name, re.I)) and not _NAME.search(value))
    if value.isalpha() or _IDENT.match(value):  # other names also name things: a token's kind, a secret's label
        return phrase
    return len(value) < 8 and value.isascii() and bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"\d|[^\w.:,/-]", value)) or phrase and len(value) < 8


def structured(value: str) -> bool:
    """A value that no one chose by hand: long, of many different characters, with digits."""
    return usable(value) and (len(value) >= 16 and entropy(value) >= (2.9 if _HEX.match(value) else 3.3)) and bool(re.search(r"\d", value))


def literals(text: str) -> Iterator[str]:
    """All literals of a text that are long enough to be anything but marks."""
    for m in _ANY.finditer(text):
        if len(value := m[m.lastindex]) >= 4:
            yield value


def _remark(line: str) -> int:
    """Where a remark begins that speaks of a credential before any quote, or -1. Each stretch between quotes is read once."""
    for part in re.finditer(r"[^\"']+", line):
        mark = _MARKER.search(line, part.start(), part.end())
        if mark and _SPEAKS.search(line, mark.end(), part.end()):
            return mark.start()
    return -1


def _inner(value: str) -> str:
    """A value without scheme and user name."""
    m = _SCHEME.match(value)
    if m:
        value = m["s"]
    return value


def _names(name: str) -> bool:
    """Whether a name, its last part, is that of a credential."""
    last = name.rpartition(".")[2]
    return bool(_NAME.search(last)) and not _NOT.search(last) and not _MAYBE_NOT.search(last)


def credentials(text: str) -> dict[str, int]:
    """value -> strength (2 named as a credential or of a fixed form, 1 only by a weaker context), as it stands in the text.

    The text is read whole. Each pattern runs only where a word is present without which it cannot match."""
    found: dict[str, int] = {}
    spoken = {w for _, w in _CONTEXT.iter(text.lower())}
    if not spoken:
        return found

    def add(value: str, strength: int) -> None:
        if value:
            found[value] = max(found.get(value, 0), strength)

    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            add(m[0], 2)
    plain = [_URL_PARAM]
    if "://" in spoken:
        plain.append(_URL_USER)
    if spoken & {"login", "cred", "account", "pass"}:
        plain.append(_LOGIN)
    if spoken & {"login", "connect"}:
        plain.append(_CONNECT)
    if spoken & {"bearer", "basic"}:
        plain.append(_SENT)
    for pattern in plain:
        for m in pattern.finditer(text):
            if usable(m["s"]):
                add(m["s"], 2)
    if spoken & _ISSUERS:
        for m in _ISSUED.finditer(text):
            if usable(m[0]):
                add(m[0], 2)
    if spoken & _NAMING:
        for m in _PAIR.finditer(text):
            if _names(m["n"]) and usable(m["v"]) and "-----" not in m["v"]:
                add(_inner(m["v"]), 2)
        for m in _BETWEEN.finditer(text) if "</" in text else ():
            if _names(m["n"]) and usable(m["s"]):
                add(m["s"], 2)
        for m in _NOTED.finditer(text):
            if _names(m["n"]) and structured(m["s"]) and all(re.search(c, m["s"]) for c in ("[a-z]", "[A-Z]")):
                add(m["s"], 2)
    for m in _ASSIGN.finditer(text) if spoken & _NAMING else ():
        name, value = m["n"].rpartition(".")[2], m["v"]
        if "-----" in value or _NOT.search(name) or (_MAYBE_NOT.search(name) and (_HEX.match(value) or not _NAME.search(name))) or re.match(r"\w+://", value):
            continue
        call = m["call"] or ""
        if re.search(r"getenv|environ|get\(|getpass|load|read|fetch|open|lookup|header", call, re.I):
            continue
        if _NAME.search(name) or re.search(r"(?:^|_)login(?:_|$)", name, re.I) and re.match(r"[\w.@-]+:", value):
            value = _inner(value)
            if ":" in value and re.search(r"auth|login|credential|basic", name, re.I):
                value = value.partition(":")[2]
            # a block's opening colon with a text below it: what stands there describes the block
            opens = m["q"] in ('"""', "'''") and not m["type"] and re.search(r":\s*\n\s*\w{0,2}$", text[m.start() : m.start("q")])
            if usable(value) if opens else named_usable(name, value):
                add(value, 2)
        elif _KEY.search(name) and structured(value):
            add(value, 2 if "hex" in call or len(value) >= 16 else 1)
    for m in _CRYPTO.finditer(text) if spoken & _CIPHERS else ():
        if usable(m["v"]):
            add(m["v"], 2)
    if spoken & _NAMING:
        for line in text.split("\n"):
            if ("#" in line or "//" in line or "/*" in line) and (r := _remark(line)) >= 0 and not _CLEARED.search(line, r):
                for m in _LITERAL.finditer(line[:r]):
                    if structured(m["v"]) and "-----" not in m["v"]:
                        add(m["v"], 2)
    return found


def spellings(secret: str) -> set[str]:
    """A secret as other fields may print it: line breaks as escapes or the other way round."""
    out = {secret}
    if "\n" in secret or "\\n" in secret:
        plain = secret.replace("\\r\\n", "\n").replace("\\n", "\n").replace("\r\n", "\n")
        out |= {plain, plain.replace("\n", "\\n"), plain.replace("\n", "\\\\n"), plain.replace("\n", "\r\n"), plain.replace("\n", "\\r\\n")}
    return out
