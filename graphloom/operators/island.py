"""Island grammars: declarations of many languages by one parser that tables drive.

A language's table says how its comments and strings look, which words declare
types and functions, and how bodies end: by a closing brace, by ``end`` or by
indentation. Text is cut into tokens first, so that braces and words inside of
strings and comments mean nothing; brackets are paired; then declarations are
read scope by scope, each with the body that its bracket closes. All else is
water that is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

SLASHES, HASH = ("//",), ("#",)
STARS = (("/*", "*/"),)
DOUBLE, SINGLE, CHAR = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
TRIPLE, TICKS = r'"""(?:\\.|[^\\])*?"""', r"`(?:\\.|[^`\\])*`"


@dataclass(frozen=True)
class Language:
    line: tuple[str, ...] = SLASHES
    block: tuple[tuple[str, str], ...] = STARS
    nested: bool = False  # block comments inside of each other
    strings: tuple[str, ...] = (DOUBLE, SINGLE)  # patterns, the longer openings first
    types: dict[str, str] = field(default_factory=dict)  # word that declares → kind of node
    functions: frozenset[str] = frozenset()  # words before a function's name
    headed: bool = False  # functions without such a word: a name, brackets and a body
    body: str = "brace"
    opens: frozenset[str] = frozenset()  # words that ``end`` closes, where bodies end so
    imports: str = ""  # how imports read, see ``_imports``
    kind: str = "module"  # of an imported node
    word: str = r"[^\W\d][\w$]*"
    regex: bool = False  # has literals between slashes


def _types(**kinds: str) -> dict[str, str]:
    return {w: kind for kind, words in kinds.items() for w in words.split()}


_C = Language(strings=(r'R"\((?:.|\n)*?\)"', DOUBLE, CHAR), types=_types(struct="struct union", enum="enum"), headed=True, imports="include")
_JS = Language(strings=(TICKS, DOUBLE, SINGLE), types=_types(**{"class": "class"}), functions=frozenset(["function"]), headed=True, imports="script", word=r"[^\W\d]?[\w$]+", regex=True)
_JVM = Language(strings=(TRIPLE, DOUBLE, CHAR), types=_types(**{"class": "class record", "interface": "interface", "enum": "enum"}), headed=True, imports="dotted")

LANGUAGES: dict[str, Language] = {
    "c": _C,
    "cpp": replace(_C, types=_C.types | _types(**{"class": "class", "namespace": "namespace"})),
    "objc": replace(_C, strings=(r'@?"(?:\\.|[^"\\\n])*"', CHAR), imports="include"),
    "java": _JVM,
    "csharp": replace(_JVM, strings=(r'\$?@\$?"(?:""|[^"])*"', r'"""(?:.|\n)*?"""', r'\$?"(?:\\.|[^"\\\n])*"', CHAR), types=_JVM.types | _types(struct="struct", namespace="namespace"), imports="using"),
    "dart": replace(_JVM, strings=(TRIPLE, r"'''(?:\\.|[^\\])*?'''", DOUBLE, SINGLE), types=_types(**{"class": "class mixin extension", "enum": "enum"}), nested=True, imports="quoted"),
    "javascript": _JS,
    "typescript": replace(_JS, types=_JS.types | _types(interface="interface", enum="enum", namespace="namespace")),
    "rust": Language(nested=True, strings=(r'b?r(?P<fence>#*)"(?:.|\n)*?"(?P=fence)', r'b?"(?:\\(?:.|\n)|[^"\\])*"', CHAR), types=_types(struct="struct union", enum="enum", trait="trait", module="mod"), functions=frozenset(["fn"]), imports="use"),
    "go": Language(strings=(r"`[^`]*`", DOUBLE, CHAR), types={}, functions=frozenset(["func"]), imports="strings", kind="package"),
    "kotlin": Language(nested=True, strings=(r'"""(?:.|\n)*?"""', DOUBLE, CHAR), types=_types(**{"class": "class object", "interface": "interface"}), functions=frozenset(["fun"]), imports="dotted"),
    "scala": Language(nested=True, strings=(r'"""(?:.|\n)*?"""', DOUBLE, CHAR), types=_types(**{"class": "class object", "trait": "trait", "enum": "enum"}), functions=frozenset(["def"]), imports="dotted"),
    "swift": Language(nested=True, strings=(TRIPLE, DOUBLE), types=_types(**{"class": "class actor extension", "struct": "struct", "enum": "enum", "interface": "protocol"}), functions=frozenset(["func"]), imports="dotted"),
    "php": Language(line=("//", "#"), types=_types(**{"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}), functions=frozenset(["function"]), imports="php", word=r"\$?[^\W\d]\w*"),
    "zig": Language(block=(), strings=(r"\\\\[^\n]*", DOUBLE, CHAR), functions=frozenset(["fn"]), imports="call"),
    "powershell": Language(line=HASH, block=(("<#", "#>"),), strings=(r'@"(?:.|\n)*?\n"@', r'"(?:`.|""|[^"`])*"', r"'(?:''|[^'])*'"), types=_types(**{"class": "class", "enum": "enum"}), functions=frozenset(["function", "filter"]), headed=True, imports="shell", word=r"[^\W\d][\w-]*"),
    "ruby": Language(line=HASH, block=(("\n=begin", "\n=end"),), strings=(r"<<[~-]?(?P<q>['\"]?)(?P<doc>[A-Z]\w*)(?P=q)[^\n]*\n(?:.|\n)*?\n[ \t]*(?P=doc)\b", DOUBLE, SINGLE), types=_types(**{"class": "class", "module": "module"}), functions=frozenset(["def"]), body="end",
                     opens=frozenset("class module def do begin case if unless while until for".split()), imports="require", word=r"[^\W\d]\w*[?!]?"),
    "lua": Language(line=("--",), block=(("--[[", "]]"),), strings=(r"\[(?P<eq>=*)\[(?:.|\n)*?\](?P=eq)\]", DOUBLE, SINGLE), functions=frozenset(["function"]), body="end", opens=frozenset("function do if".split()), imports="require"),
    "julia": Language(line=HASH, block=(("#=", "=#"),), nested=True, strings=(TRIPLE, DOUBLE, CHAR), types=_types(struct="struct", module="module"), functions=frozenset(["function", "macro"]), body="end",
                      opens=frozenset("function macro module struct if for while let begin quote try do".split()), imports="names", word=r"[^\W\d]\w*!?"),
    "elixir": Language(line=HASH, block=(), strings=(TRIPLE, r'~\w"[^"]*"', DOUBLE, SINGLE), types=_types(module="defmodule", interface="defprotocol"), functions=frozenset(["def", "defp", "defmacro"]), body="end", opens=frozenset(["do", "fn"]), imports="names", word=r"[^\W\d][\w.]*[?!]?"),
    "python": Language(line=HASH, block=(), strings=(r'"""(?:\\.|[^\\])*?"""', r"'''(?:\\.|[^\\])*?'''", DOUBLE, SINGLE), types=_types(**{"class": "class"}), functions=frozenset(["def"]), body="indent", imports="from"),
}

#: Words before brackets that are no function's name.
CONTROL = frozenset("if for while switch catch return new else do throw sizeof typeof await yield foreach lock using fixed synchronized match when elif until unless and or not in is assert super this defined alignof decltype function".split())
#: What may stand between the brackets and the body of a function, or between a type's name and its body.
AFTER = frozenset("const noexcept override final throws async where extends implements permits with mut volatile unsafe".split())
IMPORTS = frozenset("# @ import require using use export part library require_once include include_once require_relative load alias from import-module Import-Module".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}

Token = tuple[str, str, int]  # word, string, sign or line; text; place


def _lexer(lang: Language) -> re.Pattern:
    comments = [re.escape(a) if lang.nested else re.escape(a) + r"(?:.|\n)*?(?:" + re.escape(b) + r"|\Z)" for a, b in lang.block]
    parts = [*([rf"(?P<block>{'|'.join(comments)})"] if comments else []), *([rf"(?P<line>(?:{'|'.join(map(re.escape, lang.line))})[^\n]*)"] if lang.line else []), rf"(?P<string>{'|'.join(lang.strings)})", rf"(?P<word>{lang.word})", r"(?P<number>\d[\w.]*)", r"(?P<end>\n)", r"(?P<sign>=>|->|::|[^\s\w])"]
    return re.compile("|".join(parts), re.S)


_lexers: dict[str, re.Pattern] = {}
_SLASHED = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")


def tokens(text: str, name: str) -> Iterator[Token]:
    lang = LANGUAGES[name]
    lexer = _lexers.setdefault(name, _lexer(lang)) if name not in _lexers else _lexers[name]
    at, last = 0, ""
    while m := lexer.search(text, at):
        at, kind = m.end(), m.lastgroup if m.lastgroup in ("block", "line", "string", "word", "number", "end", "sign") else "string"
        if kind == "block":
            if lang.nested:
                at = _after_nested(text, m.start(), dict(lang.block)[m[0]], m[0])
            continue
        if kind == "line":
            continue
        if lang.regex and m[0] == "/" and (last in ("", "return", "typeof", "=>") or last in tuple("(,=:[!&|?{};+-*%<>~^")) and (r := _SLASHED.match(text, m.start())):
            at, kind = r.end(), "string"
        yield kind, text[m.start() : at], m.start()
        last = m[0] if kind != "end" else last


def _after_nested(text: str, at: int, close: str, start: str) -> int:
    depth = 0
    for m in re.finditer(f"{re.escape(start)}|{re.escape(close)}", text[at:]):
        depth += 1 if m[0] == start else -1
        if not depth:
            return at + m.end()
    return len(text)


@dataclass
class Found:
    """A type, function, import or implementation."""

    what: str
    kind: str
    name: str
    at: int
    body: str = ""
    inside: str | None = None  # the type that a method or a type belongs to


class Parser:
    def __init__(self, text: str, name: str) -> None:
        self.text, self.lang, self.language = text, LANGUAGES[name], name
        every = list(tokens(text, name))
        self.plain = _masked(text, every)
        self.t = [x for x in every if x[0] != "end"]
        self.first = self._first_of_lines(every)
        self.match = self._pairs()
        self.found: list[Found] = []

    @staticmethod
    def _first_of_lines(every: list[Token]) -> set[int]:
        """Places in ``t`` of tokens that begin a line."""
        out, n, fresh = set(), 0, True
        for kind, _, _ in every:
            if kind == "end":
                fresh = True
                continue
            if fresh:
                out.add(n)
            fresh, n = False, n + 1
        return out

    def _pairs(self) -> dict[int, int]:
        """Closing places of brackets and, where bodies end so, of words that ``end`` closes."""
        match: dict[int, int] = {}
        open_: list[tuple[str, int]] = []
        for i, (kind, x, _) in enumerate(self.t):
            if kind == "sign" and x in PAIRS:
                open_.append((PAIRS[x], i))
            elif kind == "word" and self.lang.body == "end" and self._opens(i):
                open_.append(("end", i))
            elif (kind == "sign" and x in PAIRS.values()) or (x == "end" and kind == "word" and self.lang.body == "end" and not self._dotted(i)):
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == x), None)
                if k is not None:
                    match[open_[k][1]] = i
                    del open_[k:]
        return {i: len(self.t) for _, i in open_} | match

    def _dotted(self, i: int) -> bool:
        return i > 0 and self.t[i - 1][1] in (".", ":") and self.language in ("ruby", "lua")

    def _opens(self, i: int) -> bool:
        x = self.t[i][1]
        if x not in self.lang.opens or self._dotted(i):
            return False
        if self.language == "elixir" and x == "do":
            return self._is(i + 1) != ":"
        if self.language == "ruby":
            if x in ("if", "unless", "while", "until"):  # after something they are modifiers
                return i in self.first or self._is(i - 1) in ("=", "(", ";", "then", "else", "do", "|")
            if x == "do":  # the loop's own word has opened
                return not any(self._is(k) in ("while", "until", "for") for k in range(self._line_start(i), i))
            if x == "def":  # a method of one expression has no end
                k = i + 2
                while self._is(k) == ".":
                    k += 2
                k = self._closing(k) + 1 if self._is(k) == "(" else k
                return self._is(k) != "=" or self._is(k + 1) == "="
            return x != "class" or self._is(i + 1) != "<"
        if self.language == "julia" and x in ("if", "for"):  # comprehensions have them inside of brackets
            return i in self.first or self._is(i - 1) in ("else", "begin", ";")
        return True

    def _closing(self, i: int) -> int:
        depth = 0
        for k in range(i, len(self.t)):
            x = self.t[k][1] if self.t[k][0] == "sign" else ""
            depth += (x in PAIRS) - (x in PAIRS.values())
            if not depth:
                return k
        return len(self.t)

    def _line_start(self, i: int) -> int:
        while i > 0 and i not in self.first:
            i -= 1
        return i

    def _is(self, i: int) -> str:
        """A token's text unless it is a string."""
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] != "string" else ""

    def _word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "word"

    def _end_of(self, i: int) -> int:
        return self.match.get(i, len(self.t))

    def _skip_generic(self, i: int) -> int:
        """Behind angle brackets that open at ``i``, if they do."""
        if self._is(i) != "<":
            return i
        depth = 0
        for k in range(i, len(self.t)):
            depth += (self._is(k) == "<") - (self._is(k) == ">")
            if not depth:
                return k + 1
            if self._is(k) in (";", "{", "}"):
                break
        return i

    def _slice(self, a: int, b: int) -> str:
        """Text between two tokens, without strings and comments."""
        start = self.t[a][2] if a < len(self.t) else len(self.text)
        return self.plain[start : self.t[b][2] if b < len(self.t) else len(self.text)]

    # -- declarations -------------------------------------------------------------------------------------------------

    def parse(self) -> list[Found]:
        self._scope(0, len(self.t), None)
        return self.found

    def _scope(self, i: int, stop: int, inside: str | None) -> None:
        """Declarations between two places, all in the type ``inside``; bodies of functions aren't entered."""
        while i < stop:
            i = max(i + 1, min(stop, self._one(i, stop, inside)))

    def _one(self, i: int, stop: int, inside: str | None) -> int:
        """Reads what begins at ``i`` and says where to go on."""
        kind, x, _ = self.t[i]
        if inside is None and (go := self._imports(i, stop)):
            return go
        if kind == "word":
            if self.language == "go" and x == "type":
                return self._go_types(i, stop)
            if self.language == "rust" and x == "impl":
                return self._impl(i, stop)
            if x in self.lang.types and self._is(i - 1) not in (".", "::") and self._word(self._named(i)):
                return self._type(i, stop, inside)
            if x in self.lang.functions:
                return self._function(i, stop, inside)
            if self.lang.headed and self._is(i + 1) == "(" and x not in CONTROL:
                return self._headed(i, stop, inside)
            if self.lang.regex and self._arrow(i):
                return self._add_function(i, x, self._arrow_body(i), stop, inside)
        if kind == "sign" and x in PAIRS:
            if x == "{" and inside is None and self.lang.body == "brace" and self._is(i - 1) in ("", '"C"'):
                return i + 1  # a block like extern "C": its declarations count
            return self._end_of(i) + 1
        return self._end_of(i) + 1 if i in self.match and x not in self.lang.types and x not in self.lang.functions and self.lang.body == "end" and x != "do" else i + 1

    def _named(self, i: int) -> int:
        """Where the name of the type that is declared at ``i`` stands."""
        i += 1
        while self._is(i) in ("class", "struct", "data") or (self.language == "cpp" and self._is(i) == "["):
            i = self._end_of(i) + 1 if self._is(i) == "[" else i + 1
        return i

    def _type(self, i: int, stop: int, inside: str | None) -> int:
        kind, at = self.lang.types[self._is(i)], self._named(i)
        name, k = self._is(at), at + 1
        while self._is(k) == "::" or (self._is(k) == "." and self.language in ("csharp", "ruby")):
            name, k = f"{name}{self._is(k)}{self._is(k + 1)}", k + 2
        if self.lang.body == "end":
            opener = i if i in self.match else next((j for j in range(at, min(stop, at + 8)) if self._is(j) == "do"), i)
            body = (k, self._end_of(opener)) if opener in self.match else None
        elif self.lang.body == "indent":
            body = self._indented(i, stop)
        else:
            if self.language in ("c", "cpp", "objc") and self._is(k) not in ("{", ":", ";", "final", "<"):
                return k  # a type that is used: struct a b;
            body = self._brace(k, stop)
        self.found.append(Found("type", kind, name, self.t[at][2], inside=inside))
        if body is None:
            return k
        self._scope(body[0], body[1], name if kind not in ("namespace", "module") or self.language in ("ruby", "elixir") else None)
        return body[1] + (0 if self.lang.body == "indent" else 1)

    def _brace(self, k: int, stop: int) -> tuple[int, int] | None:
        """The body in braces that belongs to a head which goes on at ``k``."""
        while k < stop:
            x = self._is(k)
            if x == "{":
                return k + 1, min(stop, self._end_of(k))
            if x in (";", "}", "=") or (x in self.lang.types and x not in ("class", "object")) or x in self.lang.functions:
                return None
            if k in self.first and x not in AFTER and x not in (":", "<", "(", ",", "|", "&") and self._is(k - 1) not in (",", ":", "<", "(", "&", "|", "->", "=>") and self._is(k - 1) not in AFTER and not self._word_goes_on(k):
                return None
            k = self._end_of(k) + 1 if x in ("(", "[") else k + 1
        return None

    def _word_goes_on(self, k: int) -> bool:
        return self.language in ("java", "csharp", "cpp", "rust") and (self._word(k) or self._is(k) in (">", "*", "::"))

    def _impl(self, i: int, stop: int) -> int:
        k = self._skip_generic(i + 1)
        names, what = [""], 0
        while k < stop and self._is(k) not in ("{", ";", "where"):
            if self._is(k) == "for":
                names, what = [*names, ""], what + 1
            elif self._word(k):
                names[what] = self._is(k)
            k = max(k + 1, self._skip_generic(k))
        body = self._brace(k, stop)
        if what:
            self.found.append(Found("implements", "trait", names[0], self.t[i][2], inside=names[1]))
        if body is None:
            return k
        self._scope(body[0], body[1], names[-1])
        return body[1] + 1

    def _go_types(self, i: int, stop: int) -> int:
        group = self._is(i + 1) == "("
        k, end = (i + 2, self._end_of(i + 1)) if group else (i + 1, stop)
        while k < end and self._word(k):
            name, at = self._is(k), self.t[k][2]
            k += 1
            if self._is(k) == "[" and self._is(self._end_of(k) + 1) in ("struct", "interface"):
                k = self._end_of(k) + 1
            kind = self._is(k)
            self.found.append(Found("type", kind if kind in ("struct", "interface") else "struct", name, at))
            while k < end and (k not in self.first or self._is(k) in PAIRS.values()):
                k = self._end_of(k) + 1 if self._is(k) in PAIRS else k + 1
            if not group:
                break
        return max(k, self._end_of(i + 1) + 1) if group else k

    def _function(self, i: int, stop: int, inside: str | None) -> int:
        k, owner = i + 1, inside
        if self.language == "go" and self._is(k) == "(":
            words = [self._is(j) for j in range(k, self._end_of(k)) if self._word(j)]
            k = self._end_of(k) + 1
            if not self._word(k):
                return k  # without a name
            owner = words[-1] if words else None
        k = self._skip_generic(k)
        while self._is(k) in ("*", "&"):
            k += 1
        name, at = "", k
        while self._word(k):
            name, at = self._is(k), k
            if self._is(k + 1) not in (".", ":" if self.language == "lua" else "::") or not self._word(k + 2):
                break
            k += 2
        if not name or (self.language in ("javascript", "typescript", "php") and self._is(at + 1) not in ("(", "<")):
            return i + 1
        if self.language == "ruby" and self._is(at + 1) == "=" and self._is(at + 2) == "(":
            name += "="
        k = self._skip_generic(at + 1)
        if self.lang.body == "indent":
            body = self._indented(i, stop)
        elif self.lang.body == "end":
            body = self._body_to_end(i, k, stop)
        else:
            k = self._end_of(k) + 1 if self._is(k) == "(" else k
            body = self._brace_or_value(k, stop)
        return self._add_function(at, name, body, stop, owner)

    def _body_to_end(self, i: int, k: int, stop: int) -> tuple[int, int] | None:
        if i in self.match:
            return k, min(stop, self._end_of(i))
        opener = next((j for j in range(k, stop) if self._is(j) == "do" or (j in self.first and j > k)), None)
        if opener is not None and self._is(opener) == "do":
            return opener + 1, min(stop, self._end_of(opener)) if opener in self.match else self._line_end(opener, stop)
        return k, self._line_end(k, stop)

    def _line_end(self, k: int, stop: int) -> int:
        k += 1
        while k < stop and k not in self.first:
            k += 1
        return k

    def _brace_or_value(self, k: int, stop: int) -> tuple[int, int] | None:
        """A body in braces, or the value behind ``=`` or ``=>``, which ends with its statement."""
        while k < stop and self._is(k) not in ("{", ";", "}", "=", "=>"):
            if k in self.first and self._is(k) not in AFTER and self._is(k) not in ("(", ":", "->") and self._is(k - 1) not in (",", ":", "->", "=>") and not self._word_goes_on(k):
                return None
            k = self._end_of(k) + 1 if self._is(k) in ("(", "[") else k + 1
        if k < stop and self._is(k) == "{":
            return k + 1, min(stop, self._end_of(k))
        if k < stop and self._is(k) in ("=", "=>"):
            return k + 1, self._value_end(k + 1, stop)
        return None

    def _value_end(self, k: int, stop: int) -> int:
        start = k
        while k < stop and self._is(k) not in (";", "}", ")", ","):
            if k > start and k in self.first and self._is(k) not in (".", "?", "+", "-", "*", "|", "&", "else") and self._is(k - 1) not in ("=", "=>", "+", "-", "*", "|", "&", ".", "else"):
                break
            k = self._end_of(k) + 1 if self._is(k) in PAIRS else k + 1
        return min(k, stop)

    def _headed(self, i: int, stop: int, inside: str | None) -> int:
        """A name, brackets and a body, without a word that says function."""
        name, before, close = self._is(i), self._is(i - 1), self._end_of(i + 1)
        k, owner = close + 1, inside
        script = self.language in ("javascript", "typescript", "powershell")
        if script and inside is None:
            return close + 1
        if not script and not (self._word(i - 1) or before in (">", "]", "*", "&", "~", "::") or name == inside) or before in ("new", "return", "else", "throw", "=", "."):
            return close + 1
        if before == "::" and self._word(i - 2):
            owner = self._is(i - 2)
        if self._is(k) == ":" and self.language in ("cpp", "csharp", "dart", "typescript"):  # initialisers, or a type
            k += 1
            while k < stop and self._is(k) not in (";", "}", "=>") and not (self._is(k) == "{" and not (self.language == "cpp" and self._word(k - 1) and self._is(self._end_of(k) + 1) in (",", "{"))):
                k = self._end_of(k) + 1 if self._is(k) in PAIRS else k + 1
        while k < stop and (self._word(k) or self._is(k) in (",", ".", "->", "::", "<", ">", "&", "*", "?", ":")):
            k += 1
        if self._is(k) == "{":
            return self._add_function(i, name, (k + 1, min(stop, self._end_of(k))), stop, owner)
        if self._is(k) == "=>" and not script:
            return self._add_function(i, name, (k + 1, self._value_end(k + 1, stop)), stop, owner)
        if self.language == "java" and inside is not None and self._is(k) == ";" and self._word(i - 1):
            return self._add_function(i, name, None, stop, owner)  # declared in an interface
        return close + 1

    def _arrow(self, i: int) -> bool:
        """``name = (...) => ``, ``name = x => `` or ``name = function``, with or without async."""
        if self._is(i + 1) != "=":
            return False
        k = i + 3 if self._is(i + 2) == "async" else i + 2
        if self._is(k) == "function":
            return True
        k = self._end_of(k) + 1 if self._is(k) == "(" else k + 1
        return self._is(k) == "=>" or (self._is(k) == ":" and any(self._is(j) == "=>" for j in range(k, min(k + 12, len(self.t)))))

    def _arrow_body(self, i: int) -> tuple[int, int]:
        stop = len(self.t)
        k = next((j for j in range(i + 2, stop) if self._is(j) in ("=>", "{")), stop)
        if self._is(k) == "=>" and self._is(k + 1) == "{":
            k += 1
        return (k + 1, self._end_of(k)) if self._is(k) == "{" else (k + 1, self._value_end(k + 1, stop))

    def _indented(self, i: int, stop: int) -> tuple[int, int]:
        column = lambda k: self.t[k][2] - self.text.rfind("\n", 0, self.t[k][2])
        start = self._line_start(i)
        k = next((j for j in range(i, stop) if self._is(j) == ":" and not self._in_brackets(i, j)), i)
        end = next((j for j in range(k + 1, stop) if j in self.first and column(j) <= column(start)), stop)
        return k + 1, end

    def _in_brackets(self, a: int, b: int) -> bool:
        return any(self._is(j) in PAIRS and self._end_of(j) > b for j in range(a, b))

    def _add_function(self, at: int, name: str, body: tuple[int, int] | None, stop: int, owner: str | None) -> int:
        self.found.append(Found("function", "method" if owner is not None else "function", name, self.t[at][2], self._slice(*body) if body else "", owner))
        return at + 1 if body is None else body[1] if self.lang.body == "indent" else body[1] + (self._is(body[1]) in ("}", "end"))

    # -- imports ------------------------------------------------------------------------------------------------------

    def _import(self, name: str, at: int) -> None:
        if name := name.strip():
            self.found.append(Found("import", self.lang.kind, name, self.t[at][2]))

    def _string(self, i: int) -> str | None:
        return self.t[i][1].strip("\"'`") if 0 <= i < len(self.t) and self.t[i][0] == "string" else None

    def _statement(self, i: int, stop: int) -> int:
        """Where the statement that begins at ``i`` ends: at a semicolon or with its line, but not inside of braces."""
        k = i
        while k < stop and self._is(k) != ";" and (k == i or k not in self.first):
            k = self._end_of(k) + 1 if self._is(k) in ("{", "(") else k + 1
        return k

    def _raw(self, a: int, b: int) -> str:
        end = self.t[b][2] if b < len(self.t) else len(self.text)
        return re.sub(r"\s+", " ", self.text[self.t[a][2] : end]).strip() if a < min(b, len(self.t)) else ""

    def _imports(self, i: int, stop: int) -> int | None:
        """Reads an import that begins at ``i``; None if none does."""
        x, way = self._is(i), self.lang.imports
        if x not in IMPORTS:
            return None
        if way == "include" and x in ("#", "@") and self._is(i + 1) in ("include", "import") and i in self.first:
            line = self.text[self.t[i + 1][2] : (self.text + "\n").index("\n", self.t[i + 1][2])]
            if m := re.match(r"\w+\s*[<\"]?([^>\";]+)", line):
                self._import(m[1], i)
            k = i + 1
            while k < stop and k not in self.first:
                k += 1
            return k
        if way == "script" and x == "import" and self._is(i + 1) not in ("(", "."):
            return self._script_import(i, stop)
        if way == "script" and x == "require" and self._is(i + 1) == "(" and (s := self._string(i + 2)):
            self._import(s, i)
            return i + 4
        end = self._statement(i, stop)
        if way == "dotted" and x == "import" and i in self.first:
            k = i + 2 if self._is(i + 1) == "static" else i + 1
            self._import(self._raw(k, end).split(" as ")[0], i)
            return end
        if way == "using" and x == "using" and self._word(i + 1) and self._is(i + 1) != "var" and self._is(end) == ";":
            self._import(re.sub(r"^static ", "", self._raw(i + 1, end)), i)
            return end
        if way == "use" and x == "use":
            public = any(self._is(k) == "pub" for k in range(self._line_start(i), i))
            self._import(("pub use " if public else "") + self._raw(i + 1, end), i)
            return end
        if way == "strings" and x == "import":
            last = self._end_of(i + 1) if self._is(i + 1) == "(" else end
            for k in range(i + 1, last):
                if s := self._string(k):
                    self._import(s, k)
            return last
        if way == "quoted" and x in ("import", "export", "part", "library") and (s := self._string(i + 1)):
            self._import(s, i)
            return end
        if way == "php" and x in ("use", "require", "require_once", "include", "include_once"):
            s = next((s for k in range(i + 1, end) if (s := self._string(k))), None)
            self._import(s or self._raw(i + 1, end).split(" as ")[0], i)
            return end
        if way == "require" and x in ("require", "require_relative", "load"):
            k = i + 2 if self._is(i + 1) == "(" else i + 1
            if s := self._string(k):
                self._import(s, i)
                return k + 1
        if way == "call" and x == "@" and self._is(i + 1) == "import" and (s := self._string(i + 3)):
            self._import(s, i)
            return i + 4
        if way == "names" and x in ("using", "import", "alias", "use", "require", "include"):
            s = self._string(i + 2)
            for name in [s] if s and x == "include" else re.split(r"[:,]", self._raw(i + 1, end))[: None if self.language == "julia" and ":" not in self._raw(i + 1, end) else 1]:
                self._import(name, i)
            return end
        if way == "shell" and x.lower() in ("import-module", "using"):
            self._import(self._raw(i + (2 if self._is(i + 1) in ("module", "namespace") else 1), end).split(" ")[0].strip("\"'"), i)
            return end
        if way == "from" and x in ("import", "from") and i in self.first:
            said = self._raw(i, end).replace("(", " ").replace(")", " ")
            module, _, names = said.partition(" import ") if x == "from" else ("", "", said[6:])
            for name in names.split(","):
                name = name.split(" as ")[0].strip()
                self._import(f"{module[4:].strip().strip('.')}.{name}".lstrip(".") if x == "from" else name, i)
            return end
        return None

    def _script_import(self, i: int, stop: int) -> int:
        k, names = i + 1, []
        while k < stop and self.t[k][0] != "string" and self._is(k) != ";":
            if self._is(k) == "{":
                inner = self._raw(k + 1, self._end_of(k))
                names += [n.split(" as ")[0].replace("type ", "").strip() for n in inner.split(",")]
                k = self._end_of(k)
            elif self._is(k) == "*":
                k += 2
            elif self._word(k) and self._is(k) not in ("from", "type"):
                names.append(self._is(k))
            k += 1
        if (module := self._string(k)) is not None:
            for name in [f"{module}/{n}" for n in names if n] or [module]:
                self._import(name, i)
        return k + 1


def _masked(text: str, every: list[Token]) -> str:
    """The text with blanks for strings and comments."""
    out, at = [], 0
    for kind, x, start in every:
        out.append(re.sub(r"[^\n]", " ", text[at:start]))
        out.append(x if kind != "string" else re.sub(r"[^\n]", " ", x))
        at = start + len(x)
    out.append(re.sub(r"[^\n]", " ", text[at:]))
    return "".join(out)


def declarations(text: str, language: str) -> list[Found]:
    """Types, functions with their bodies, imports and implementations, in order."""
    return Parser(text, language).parse()
