"""What parsers share: the facts they yield, the registry, and a scanner that blanks comments and strings."""
from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import cache
from typing import Protocol

from ...errors import UnsupportedLanguage
from ...schema import CALLS, EXTENSIONS, HERITAGE, IMPORTS, NODES
from ..scan import content_hash


@dataclass
class Facts:
    """Rows (as dicts) of one file; `assignments` is there for parsers that know them."""

    nodes: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    heritage: list[dict] = field(default_factory=list)
    assignments: list[dict] = field(default_factory=list)


class Provider(Protocol):
    """A language. Parsers of other languages are added by registering one."""

    language: str
    extensions: tuple[str, ...]

    def parse(self, path: str, data: bytes) -> Facts: ...


class Registry:
    def __init__(self):
        self.by_extension: dict[str, Provider] = {}

    def register(self, provider: Provider) -> None:
        for e in provider.extensions:
            self.by_extension[e] = provider

    def get(self, path: str) -> Provider:
        ext = path.rsplit("/", 1)[-1].rpartition(".")[2]
        if ext not in self.by_extension:
            raise UnsupportedLanguage(f"no parser for {path}")
        return self.by_extension[ext]

    def detect(self, path: str) -> str | None:
        ext = path.rsplit("/", 1)[-1].rpartition(".")[2]
        return next((name for name, exts in EXTENSIONS.items() if ext in exts), None)

    def languages(self) -> list[str]:
        return sorted({p.language for p in self.by_extension.values()})

    def parse(self, path: str, data: bytes) -> Facts:
        return self.get(path).parse(path, data)


def default_registry() -> Registry:
    from .go import Go
    from .python import Python
    from .rust import Rust
    from .script import JavaScript, TypeScript

    out = Registry()
    for p in (TypeScript(), JavaScript(), Python(), Go(), Rust()):
        out.register(p)
    return out


class File:
    """A file's text, the lines of its positions, and the rows gathered from it."""

    def __init__(self, path: str, data: bytes, language: str):
        self.path, self.language = path, language
        self.text = data.decode("utf-8", "replace")
        self.starts = [0] + [m.end() for m in re.finditer("\n", self.text)]
        self.facts = Facts()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def define(self, label: str, name: str, start: int, end: int, **more) -> dict:
        """A definition over text[start:end]. more: fields of NODES."""
        first, last = self.line(start), self.line(max(start, end - 1))
        container, arity = more.get("container_name"), more.get("parameter_count")
        qualified = f"{container}.{name}" if container else name
        row = dict.fromkeys(NODES.names) | {
            "id": f"{self.path}::{name}::{first}", "label": label, "name": name, "file_path": self.path, "start_line": first, "end_line": last, "language": self.language,
            "qualified_name": qualified, "symbol_key": f"{self.language}::{label}::{qualified}::{arity or 0}", "is_exported": False, "is_static": False, "is_async": False, "body_hash": content_hash(self.text[start:end].encode()),
        } | more
        self.facts.nodes.append(row)
        return row

    def call(self, name: str, receiver: str | None, at: int, arguments: int | None) -> None:
        self.facts.calls.append(dict.fromkeys(CALLS.names) | {"callee_name": name, "receiver": receiver, "file_path": self.path, "line": self.line(at), "arguments_count": arguments})

    def import_(self, name: str, module: str, at: int, alias: str | None = None, default: bool = False, namespace: bool = False) -> None:
        self.facts.imports.append(dict(zip(IMPORTS.names, (self.path, name, module, alias, default, namespace, self.line(at)), strict=True)))

    def inherit(self, child: str, parent: str, kind: str) -> None:
        """child: a name; its first definition in the file is the child."""
        own = next((n["id"] for n in self.facts.nodes if n["name"] == child), f"{self.path}::{child}")
        self.facts.heritage.append(dict(zip(HERITAGE.names, (own, parent, kind, self.path), strict=True)))

    def done(self) -> Facts:
        """Definitions once each, and for each call the narrowest definition around it."""
        nodes = list({n["id"]: n for n in self.facts.nodes}.values())
        self.facts.nodes = nodes
        spans = sorted((n["end_line"] - n["start_line"], k, n["start_line"], n["end_line"], n["id"]) for k, n in enumerate(nodes))
        for c in self.facts.calls:
            c["caller_id"] = next((i for _, _, a, b, i in spans if a <= c["line"] <= b), f"{self.path}::__module__")
        return self.facts


_NO_BREAK = re.compile(r"[^\n]")


@cache
def _any_of(characters: str) -> re.Pattern:
    return re.compile("[" + re.escape(characters) + "]")


def blank(text: str, quotes: str, line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), raw: str = "", char_literals: bool = False, templates: str = "") -> str:
    """The text with comments and the insides of strings as spaces; lines and lengths stay.

    quotes: characters that begin and end a string, with backslash escapes; raw: those without; templates: those whose
    strings have code between ${ and }, which stays, in braces.
    """
    out, k, n = list(text), 0, len(text)
    depth, open_ = 0, []  # braces, and (quote, depth) of the templates that the place is in

    # between these nothing begins or ends
    special = _any_of(line[0] + (block[0][0] if block else "") + templates + raw + quotes + "{}")

    def wipe(a: int, b: int) -> None:
        b = min(b, n)
        if a < b:
            out[a:b] = _NO_BREAK.sub(" ", text[a:b])

    def template(k: int, quote: str) -> int:
        """From within a template to the place after its end, or after the brace of its next piece of code."""
        nonlocal depth
        start = k
        while k < n and text[k] != quote and not text.startswith("${", k):
            k += 2 if text[k] == "\\" else 1
        if k < n and text[k] == "$":
            wipe(start, k + 1)
            open_.append((quote, depth))
            depth += 1
            return k + 2
        wipe(start, k)
        return k + 1

    while m := special.search(text, k):
        k = m.start()
        c = text[k]
        if text.startswith(line, k):
            end = text.find("\n", k)
            end = n if end < 0 else end
            wipe(k, end)
            k = end
        elif block and text.startswith(block[0], k):
            end = text.find(block[1], k + 2)
            end = n if end < 0 else end + len(block[1])
            wipe(k, end)
            k = end
        elif c in templates:
            k = template(k + 1, c)
        elif c in raw:
            end = text.find(c, k + 1)
            end = n if end < 0 else end
            wipe(k + 1, end)
            k = end + 1
        elif c in quotes:
            if char_literals and c == "'" and not re.match(r"'(\\.[^']*|[^\\'])'", text[k : k + 12], re.S):
                k += 1  # a lifetime
                continue
            end = k + 1
            while end < n and text[end] != c and not (text[end] == "\n" and not char_literals):
                end += 2 if text[end] == "\\" else 1
            wipe(k + 1, end)
            k = end + 1
        else:
            depth += (c == "{") - (c == "}")
            k += 1
            if c == "}" and open_ and open_[-1][1] == depth:
                k = template(k, open_.pop()[0])
    return "".join(out)


_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; the text's end if there is none."""
    depth = 0
    for m in _BRACKET.finditer(text, at):
        depth += 1 if m[0] in _PAIRS else -1
        if depth == 0:
            return m.end()
    return len(text)


def split_top(text: str, sep: str = ",", angles: bool = True) -> list[str]:
    """Parts at separators outside all brackets (angle brackets too, unless they are comparisons); no empty ones."""
    opening, ending = ("([{<", ")]}>") if angles else ("([{", ")]}")
    parts, depth, last = [], 0, 0
    for k, c in enumerate(text):
        if c in opening:
            depth += 1
        elif c in ending and not (c == ">" and text[k - 1 : k] in ("=", "-")):
            depth -= 1
        elif c == sep and depth <= 0:
            parts.append(text[last:k])
            last = k + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def _is_word(c: str) -> bool:
    return c.isalnum() or c in "_$"


class Calls:
    """Call sites of a text without comments and strings: a name before a parenthesis, with the expression that it is asked of.

    words: what is no name of a function; paths: whether `::` joins names, and `!` and `?` end them (Rust); angles: whether type
    arguments may stand between a name and its parenthesis.
    """

    def __init__(self, text: str, words: frozenset[str], paths: bool = False, angles: bool = False):
        self.text, self.words, self.paths, self.angles = text, words, paths, angles
        self.opened: dict[int, int] = {}  # closing brackets to their opening ones
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", text):
            if m[0] in _PAIRS:
                stack.append(m.start())
            elif stack:
                self.opened[m.start()] = stack.pop()

    def back(self, k: int, within: str = " \t\r\n") -> int:
        """The place after the last character before k that is no space."""
        while k and self.text[k - 1] in within:
            k -= 1
        return k

    def word_start(self, k: int) -> int:
        while k and _is_word(self.text[k - 1]):
            k -= 1
        return k

    def angle_start(self, k: int) -> int:
        """The place of the < that the > before k closes, -1 if it is a comparison."""
        depth = 0
        while k:
            k -= 1
            c = self.text[k]
            if c == ">" and self.text[k - 1 : k] not in ("=", "-"):
                depth += 1
            elif c == "<":
                depth -= 1
                if not depth:
                    return k
            elif c in "();{}" or c == "&" and self.text[k - 1 : k] == "&":
                return -1
        return -1

    def start(self, k: int) -> int:
        """Where the expression begins that ends at k: names, calls, indices and literals joined by dots."""
        text = self.text
        while True:
            k = self.back(k)
            c = text[k - 1 : k]
            if c and c in ")]}":
                if k - 1 not in self.opened:
                    return k
                k = self.opened[k - 1]
                j = k if c == "}" else self.back(k, " \t")
                before = text[j - 1 : j]
                if before == "." and c == ")":  # a type assertion
                    k = j - 1
                elif before and (before in ")]" or self.paths and before == "!" or self.angles and before == ">" and self.angle_start(j) >= 0):
                    k = j
                elif before and _is_word(before) and text[self.word_start(j) : j] not in self.words:
                    k = j
                else:
                    return k
            elif c and c in "\"'`":
                return max(0, text.rfind(c, 0, k - 1))
            elif c and (_is_word(c) or c == "#"):
                k = self.word_start(k - (c == "#"))
                k -= text[k - 1 : k] == "#"
                p = self.back(k)
                if text[p - 1 : p] == "." and text[max(0, p - 3) : p] != "...":
                    k = p - 1
                    k -= text[k - 1 : k] == "?" and not self.paths
                elif self.paths and text[max(0, p - 2) : p] == "::":
                    k = p - 2
                else:
                    return p - 3 if not self.paths and p < k and text[max(0, p - 3) : p] == "new" and not _is_word(text[p - 4 : p - 3] or " ") else k
            elif c == "!" or c == "?" and self.paths:
                k -= 1
            elif c == ">" and (self.angles or self.paths) and (at := self.angle_start(k)) >= 0:
                k = at - 2 if self.paths and text[max(0, at - 2) : at] == "::" else at
            else:
                return k

    def __iter__(self):
        """(name, receiver's start and end or None, where the call begins, its parenthesis)"""
        text = self.text
        for m in re.finditer(r"\(", text):
            k = self.back(m.start(), " \t")
            if self.angles and text[k - 1 : k] == ">":
                k = self.angle_start(k)
            elif self.paths and text[k - 1 : k] == ">" and (at := self.angle_start(k)) >= 2 and text[at - 2 : at] == "::":
                k = at - 2
            if k <= 0 or not _is_word(text[k - 1]):
                continue
            s = self.word_start(k)
            name, p = text[s:k], self.back(s)
            if name[0].isdigit() or text[s - 1 : s] == "#":
                continue
            dotted = text[p - 1 : p] == "." and text[max(0, p - 3) : p] != "..."
            if dotted or self.paths and text[max(0, p - 2) : p] == "::":
                end = p - 1 if dotted else p - 2
                end -= text[end - 1 : end] == "?" and not self.paths
                first = self.start(end)
                if first < end:
                    yield name, (first, end), first, m.start()
            elif name not in self.words:
                yield name, None, s, m.start()


def statement_end(text: str, at: int) -> int:
    """The place after a statement that begins at `at`: a semicolon, or a line's end outside brackets."""
    k = at
    while k < len(text):
        c = text[k]
        if c in _PAIRS:
            k = closing(text, k)
            continue
        if c == ";":
            return k + 1
        if c == "\n" or c in ")]}":
            return k
        k += 1
    return k
