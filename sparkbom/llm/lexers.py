"""Tokens of the five languages: ``((terminal, ...), line, line break before)``; a :class:`BadToken` ends a text that has none."""

from __future__ import annotations

import calendar
import io
import re
import tokenize
import unicodedata
from collections.abc import Iterator

import regex

from sparkbom.llm.grammars import _JS_IDENTS, _JS_WORDS, JAVA_IDENTS
from sparkbom.llm.tables import Stack


class BadToken(Exception):
    """No token starts here; the argument is the line."""


Token = tuple[tuple[str, ...], int, bool]


def _scan(pattern: re.Pattern, text: str) -> Iterator[tuple[str, str, int, bool]]:
    """(kind, text, line, line break before); blanks and comments are left out."""
    at, line, fresh = 0, 1, False
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            raise BadToken(line)
        word, kind = m.group(), m.lastgroup
        breaks = word.count("\n")
        if kind == "skip":
            fresh = fresh or breaks > 0
        else:
            yield kind, word, line, fresh
            fresh = False
        line += breaks
        at = m.end()


_JSON = re.compile(r'(?P<skip>[ \t\r\n]+)|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<op>[{}\[\]:,]|true\b|false\b|null\b)', re.A)


def json_tokens(text: str, stack: object = None) -> Iterator[Token]:
    for kind, word, line, fresh in _scan(_JSON, text):
        yield (word if kind == "op" else kind,), line, fresh


_HALF = r"(?:[0-9abcefABCEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2})"  # no surrogates
_ESC = rf'\\(?:[btnfr"\\]|u{_HALF}|U0000{_HALF}|U000[1-9a-fA-F][0-9a-fA-F]{{4}}|U0010[0-9a-fA-F]{{4}})'
_TOML_TEXT = (
    r'(?P<skip>[ \t]+|\#[^\n\x00-\x08\x0b-\x1f\x7f]*(?=\n|\r\n|\Z))|(?P<NL>\r?\n)'
    rf'|(?P<MLSTRING>"""(?:[^\\"\x00-\x08\x0b-\x1f\x7f]|\r(?=\n)|"{{1,2}}(?!")|{_ESC}|\\[ \t]*\r?\n\s*)*"""(?:"{{1,2}}(?!"))?|\'\'\'(?:[^\'\x00-\x08\x0b-\x1f\x7f]|\r(?=\n)|\'{{1,2}}(?!\'))*\'\'\'(?:\'{{1,2}}(?!\'))?)'
    rf'|(?P<STRING>"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|{_ESC})*"|\'[^\'\x00-\x08\x0a-\x1f\x7f]*\')'
)
_TOML_KEY = re.compile(_TOML_TEXT + r"|(?P<BARE>[A-Za-z0-9_-]+)|(?P<op>[=.,{}\[\]])", re.A)
_TOML_VALUE = re.compile(
    _TOML_TEXT
    + r"|(?P<SCALAR>(?:\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?|(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
    + r"|true|false|[+-]?(?:inf|nan)|0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    + r"|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)(?![\w.+:-]))|(?P<op>[,{}\[\]])", re.A,
)


def _toml_scan(text: str) -> Iterator[tuple[str, str, int]]:
    at, line, depth, value = 0, 1, [], False
    start = True
    while at < len(text):
        m = (_TOML_VALUE if value else _TOML_KEY).match(text, at)
        if not m:
            raise BadToken(line)
        kind, word = m.lastgroup, m.group()
        at = m.end()
        if kind == "SCALAR" and word[4:5] == "-" and int(word[8:10]) > calendar.monthrange(int(word[:4]) or 4, int(word[5:7]))[1]:
            raise BadToken(line)  # no such day
        if kind == "op":
            if not value and word == "[" and start and text[at : at + 1] == "[":
                word, at = "[[", at + 1
            elif not value and word == "]" and not depth and text[at : at + 1] == "]":
                word, at = "]]", at + 1
            kind = word
            if word == "=":
                value = True
            elif value and word in "[{":
                depth.append(word)
                value = word == "["
            elif depth and word in "]}":
                depth.pop()
                value = bool(depth) and depth[-1] == "["
                if not depth:
                    value = False
            elif depth and word == ",":
                value = depth[-1] == "["
        elif kind not in ("skip", "NL") and not (depth and depth[-1] == "["):
            value = False
        if kind == "NL" and not depth:
            start, value = True, False
        elif kind != "skip":
            start = False
        if kind != "skip":
            yield kind, word, line
        line += word.count("\n")


def toml_tokens(text: str, stack: object = None) -> Iterator[Token]:
    for kind, _, line in _toml_scan(text):
        yield (kind,), line, False


class _Table(dict):
    """A table of a document and how it came about: by a ``header``, by ``dotted`` keys, ``inline``, or only on the way ("")."""

    def __init__(self, made: str = ""):
        self.made = made


def _toml_name(word: str) -> str:
    if word[0] == '"':
        return re.sub(r"\\(?:[uU]([0-9a-fA-F]+)|(.))", lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t", "b": "\b", "f": "\f", "r": "\r"}.get(m[2], m[2]), word[1:-1])
    return word[1:-1] if word[0] == "'" else word


def _toml_path(tokens: list, i: int) -> tuple[list[str], int]:
    """The names of a dotted key, and where the token after it stands."""
    path = [_toml_name(tokens[i][1])]
    while tokens[i + 1][0] == ".":
        i += 2
        path.append(_toml_name(tokens[i][1]))
    return path, i + 1


def _toml_header(root: _Table, path: list[str], many: bool) -> _Table | None:
    """The table that a header opens; None if it may not."""
    at = root
    for step in path[:-1]:
        at = at.setdefault(step, _Table())
        if isinstance(at, list):
            at = at[-1]
        if not isinstance(at, _Table) or at.made == "inline":
            return None
    if many:
        rows = at.setdefault(path[-1], [])
        if not isinstance(rows, list):
            return None
        rows.append(_Table("header"))
        return rows[-1]
    here = at.setdefault(path[-1], _Table())
    if not isinstance(here, _Table) or here.made:
        return None
    here.made = "header"
    return here


def toml_conflict(text: str) -> int | None:
    """The line of the first key or table that a well-formed document defines twice; TOML calls such documents invalid. Values
    are not kept: None stands for all but tables and lists of tables."""
    tokens = [*_toml_scan(text), ("NL", "", 0), ("NL", "", 0)]
    root = table = _Table()
    boxes: list[_Table | None] = []  # open inline tables, and None for open arrays
    given = None  # the inline table that the key before it names
    i = 0
    while i < len(tokens) - 2:
        kind, _, line = tokens[i]
        if kind in ("[", "[[") and not boxes and (i == 0 or tokens[i - 1][0] == "NL"):
            path, i = _toml_path(tokens, i + 1)
            table = _toml_header(root, path, kind == "[[")
            if table is None:
                return line
        elif kind in ("BARE", "STRING") and (not boxes or boxes[-1] is not None):
            path, i = _toml_path(tokens, i)
            at = boxes[-1] if boxes else table
            for step in path[:-1]:
                at = at.setdefault(step, _Table())
                if not isinstance(at, _Table) or at.made in ("inline", "header"):
                    return line
                at.made = "dotted"
            if path[-1] in at:
                return line
            given = at[path[-1]] = _Table("inline") if tokens[i + 1][0] == "{" else None
            if tokens[i + 1][0] not in ("{", "["):
                i += 1  # a value of one token
        elif kind == "{":
            boxes.append(given if given is not None else _Table("inline"))
            given = None
        elif kind == "[":
            boxes.append(None)
        elif kind in ("}", "]") and boxes:
            boxes.pop()
        i += 1
    return None


_PY_WORDS = frozenset("False None True _ and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
_PY_CMP = frozenset(["==", "!=", "<=", ">="])
_PY_BIN = frozenset(["//", "%", "<<", ">>", "&", "^"])
_PY_DIGITS = r"\d(?:_?\d)*"
_PY_FLOAT = rf"(?:(?:{_PY_DIGITS})?\.{_PY_DIGITS}|{_PY_DIGITS}\.)(?:[eE][+-]?{_PY_DIGITS})?|{_PY_DIGITS}[eE][+-]?{_PY_DIGITS}"
_PY_NUMBER = re.compile(rf"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*|(?:{_PY_FLOAT})[jJ]?|{_PY_DIGITS}[jJ])$")
_PY_PREFIX = re.compile(r"[A-Za-z]*")

_PY_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N\{([^{}]*)\}|[\s\S])")


def _bad_escape(text: str, octets: bool = False) -> bool:
    """Whether a literal that is not raw holds an escape without its digits or its name."""
    for m in _PY_ESCAPE.finditer(text):
        kind = m[0][1]
        if len(m[0]) == 2 and (kind == "x" or kind in "uUN" and not octets):
            return True
        if m[1] is not None and not octets:
            try:
                unicodedata.lookup(m[1])
            except KeyError:
                return True
    return False


def python_tokens(text: str, stack: object = None) -> Iterator[Token]:
    """By the tokenizer of the running Python (the grammar is that of 3.13); its own errors count as bad tokens."""
    line, raw, last = 1, [], ""
    if "\0" in text:
        raise BadToken(text[: text.index("\0")].count("\n") + 1)
    names = {tokenize.NUMBER: "NUMBER", tokenize.STRING: "STRING", tokenize.NEWLINE: "NEWLINE", tokenize.INDENT: "INDENT", tokenize.DEDENT: "DEDENT", tokenize.FSTRING_START: "FSTRING_START", tokenize.FSTRING_MIDDLE: "FSTRING_MIDDLE", tokenize.FSTRING_END: "FSTRING_END"}
    try:
        for kind, word, (line, _), _, _ in tokenize.generate_tokens(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("\ufeff")).readline):
            if kind in (tokenize.NL, tokenize.COMMENT, tokenize.ENCODING, tokenize.ENDMARKER):
                continue
            terminal = names.get(kind)
            if kind == tokenize.NAME:
                if not word.isidentifier() or last == "!" and word not in ("s", "r", "a"):
                    raise BadToken(line)
                terminal = word if word in _PY_WORDS else "NAME"
            elif kind == tokenize.OP:
                if word in ("$", "?", "`") or word == "!" and not raw:
                    raise BadToken(line)
                terminal = "CMP" if word in _PY_CMP else "BIN" if word in _PY_BIN else "AUG" if word[-1] == "=" and len(word) > 1 and word != ":=" else word
            elif kind == tokenize.NUMBER:
                if not _PY_NUMBER.match(word):
                    raise BadToken(line)
                if word[-1] in "jJ":
                    terminal = "IMAGINARY"
            elif kind == tokenize.STRING:
                prefix = _PY_PREFIX.match(word)[0].lower()
                octets = "b" in prefix
                if octets and not word.isascii() or "\\" in word and "r" not in prefix and _bad_escape(word, octets):
                    raise BadToken(line)
                if octets:
                    terminal = "BYTES"
            elif kind == tokenize.FSTRING_START:
                raw.append("r" in word.lower())
            elif kind == tokenize.FSTRING_END:
                raw.pop()
            elif kind == tokenize.FSTRING_MIDDLE:
                if "\\" in word and not raw[-1] and _bad_escape(word):
                    raise BadToken(line)
            elif terminal is None:
                raise BadToken(line)
            yield (terminal,), line, False
            last = word
    except (tokenize.TokenError, SyntaxError) as e:
        raise BadToken(line) from e


_ID = r"[\p{L}\p{Nl}_$][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}_$]*"
_DEC = r"(?:0|[1-9]\d*(?:_\d+)*)"
_NUM_JS = (
    r"0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|0[0-7]+|0\d*[89]\d*(?:\.\d*)?(?:[eE][+-]?\d+)?"
    rf"|(?:{_DEC}\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|{_DEC}n"
)
_JS_ESC = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu])"
_JS = regex.compile(
    r"(?P<skip>[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)"
    rf"|(?P<NAME>(?:[\p{{L}}\p{{Nl}}_$]|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})(?:[\p{{L}}\p{{Nl}}\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}_$\u200c\u200d]|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})*)|(?P<PRIVATE>\#{_ID})|(?P<NUMBER>(?:{_NUM_JS})(?![\p{{L}}\d_$]))"
    rf"|(?P<STRING>\"(?:[^\"\\\n\r]|{_JS_ESC})*\"|'(?:[^'\\\n\r]|{_JS_ESC})*')"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.])"
)
_JS_REGEX = regex.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[dgimsuvy]*(?![\p{L}\d_$])")
_JS_TPL = regex.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{)")
_JS_BIN = frozenset("** % << >> >>> & ^ | && || ?? == != === !== <= >=".split())
_JS_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=".split())
_JS_KNOWN = frozenset([*_JS_WORDS, *_JS_IDENTS[1:], "await", "yield"])
_JS_BODIES = ("FB", "FBA", "FBG", "FBAG")


class _Bracket:
    """An open bracket: what it is, the kind of function whose body it opens, whether an async arrow's expression stands in it,
    and the line of a sign that only a pattern may hold."""

    def __init__(self, char: str, body: str = ""):
        self.char, self.body, self.arrow, self.cover = char, body, False, 0


def _awaits(brackets: list[_Bracket]) -> bool:
    for b in reversed(brackets):
        if b.arrow or b.body:
            return b.arrow or "A" in b.body
    return False


def _body(brackets: list[_Bracket]) -> str:
    return next((b.body for b in reversed(brackets) if b.body), "")


def javascript_tokens(text: str, stack: Stack) -> Iterator[Token]:
    """What a slash, a brace or a word such as await is depends on the rules in progress, so the parser's stack is asked."""
    at, line, fresh, last, before = 0, 1, False, "", ""
    brackets, owed = [_Bracket("")], 0
    if text.startswith("#!"):
        at = (text + "\n").index("\n")
    while at < len(text):
        c = text[at]
        if c == "`" or (c == "}" and brackets[-1].char == "`"):
            m = _JS_TPL.match(text, at + 1)
            if not m or owed:
                raise BadToken(owed or line)
            if c == "}":
                brackets.pop()
            opens = m["end"] == "${"
            kind = ("TMID" if opens else "TTAIL") if c == "}" else ("THEAD" if opens else "TEMPLATE")
            if opens:
                brackets.append(_Bracket("`"))
            yield (kind,), line, fresh
            line += text.count("\n", at, m.end())
            at, fresh, before, last = m.end(), False, last, "{" if opens else "`"
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*") and stack.accepts("REGEX") and (m := _JS_REGEX.match(text, at)):
            yield ("REGEX",), line, fresh
            at, fresh, before, last = m.end(), False, last, "REGEX"
            continue
        m = _JS.match(text, at)
        if not m:
            raise BadToken(line)
        kind, word = m.lastgroup, m.group()
        at = m.end()
        breaks = word.count("\n")
        if kind == "skip":
            if (breaks or "\r" in word or "\u2028" in word) and not fresh:
                fresh = True
                if last in ("return", "break", "continue"):
                    yield ("ASI",), line, False
                    last = ";"
            line += breaks
            continue
        if owed and word not in ("=", "=>", "of", "in"):  # a pattern within a pattern, or none
            if word not in (",", "}", "]", ")") or len(brackets) == 1:
                raise BadToken(owed)
            brackets[-1].cover = owed
        owed, also = 0, ()
        terminal = kind
        if kind == "NAME":
            if word in _JS_KNOWN and last not in (".", "?."):
                if not (word == "await" and not _awaits(brackets) or word == "yield" and "G" not in _body(brackets)):
                    terminal = word
                if word == "return" and not _body(brackets) and stack.accepts("TEMPLATE"):  # a statement, no name of a field
                    raise BadToken(line)
        elif kind == "op":
            terminal = "BIN" if word in _JS_BIN else "ASSIGN" if word in _JS_ASSIGN else word
            here = brackets[-1]
            if word in ("++", "--") and fresh:
                terminal = "NLINC"
            elif word == "{":
                if last in (")", "=>"):
                    terminal = next((b for b in _JS_BODIES if stack.accepts(b)), word)
                if last == "=>":
                    here.arrow = False
                brackets.append(_Bracket(word, terminal if terminal != word else ""))
            elif word in ("(", "["):
                brackets.append(_Bracket(word))
            elif word in ("}", ")", "]"):
                owed = here.cover
                if len(brackets) > 1:
                    brackets.pop()
            elif word in (",", ";"):
                here.arrow = False
            elif word == "=>" and stack.accepts("=>A"):
                terminal, here.arrow = "=>A", True
            elif word == "=" and here.char == "{" and before in ("{", ",") and stack.accepts("COVER"):
                also, here.cover = ("COVER",), line
        yield (terminal, *also), line, fresh
        line += breaks
        fresh, before, last = False, last, (word if kind in ("op", "NAME") and (kind == "op" or terminal != "NAME") else kind)
    if owed:
        raise BadToken(owed)


_JAVA_KEYS = frozenset("class interface enum extends implements package import static final default synchronized void this super new if else while do for return throw throws break continue try catch finally switch case assert instanceof".split()) | frozenset(JAVA_IDENTS[1:])
_JAVA_BAD = frozenset("const goto _".split())
_JAVA_MODS = frozenset("public protected private abstract native transient volatile strictfp".split())
_JAVA_PRIM = frozenset("byte short int long char float double boolean".split())
_JAVA = regex.compile(
    r"(?P<skip>[ \t\f\r\n\x1a]+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<op1>non-sealed\b)"
    rf"|(?P<NAME>{_ID})"
    r"|(?P<TEXT>\"\"\"[ \t\f]*\r?\n(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\")|(?P<STRING>\"(?:[^\"\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*\")"
    r"|(?P<LITERAL>'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'"
    r"|(?!0[\d_]*[89][\d_]*[lL]?(?![\w.]))(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+[fFdD]?|0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d(?:[\d_]*\d)?)?\.\d(?:[\d_]*\d)?(?:[eE][+-]?\d+)?[fFdD]?|\d(?:[\d_]*\d)?\.?(?:[eE][+-]?\d+)?[fFdDlL]?)(?![\p{L}\d_$]))"
    r"|(?P<op>>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[{}()\[\];,.<>=!~?:+\-*/&|^%@])"
)
_JAVA_BIN = frozenset("&& || == != <= >= << ^ %".split())
_JAVA_ASSIGN = frozenset("+= -= *= /= &= |= ^= %= <<= >>= >>>=".split())


def java_tokens(text: str, stack: object = None) -> Iterator[Token]:
    for kind, word, line, fresh in _scan(_JAVA, text):
        if kind == "NAME":
            if word in _JAVA_BAD:
                raise BadToken(line)
            kind = word if word in _JAVA_KEYS else "MODIFIER" if word in _JAVA_MODS else "PRIMITIVE" if word in _JAVA_PRIM else "LITERAL" if word in ("true", "false", "null") else "NAME"
        elif kind in ("op", "op1"):
            kind = "BIN" if word in _JAVA_BIN else "ASSIGN" if word in _JAVA_ASSIGN else word
        elif kind == "TEXT":
            kind = "STRING"
        yield (kind,), line, fresh
