"""Go, by a scanner over text without comments and strings."""
from __future__ import annotations

import re

from ...schema import EXTENSIONS
from .base import Calls, Facts, File, blank, closing, split_top, statement_end

_FUNC = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", re.M)
_SPEC = re.compile(r"(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?P<alias>=\s*)?(?P<kind>struct\s*\{|interface\s*\{|[^\s{])")
_TYPE = re.compile(r"^[ \t]*type\s+(?P<group>\()?", re.M)
_WORDS = frozenset("func if for switch select return go defer range case var const type map chan interface struct import package".split())
_IMPORT = re.compile(r'(?:(?P<alias>[\w.]+)\s+)?"(?P<path>[^"\n]+)"')


def _arity(params: str) -> int:
    return len(split_top(params))


class Go:
    language, extensions = "go", EXTENSIONS["go"]

    def __init__(self, named_fields: bool = False):
        """named_fields: a struct's named fields of a bare type are parents, too."""
        self.named_fields = named_fields

    def parse(self, path: str, data: bytes) -> Facts:
        f = File(path, data, self.language)
        text = blank(f.text, "\"'", raw="`")
        heads: set[int] = set()
        inherited: list[tuple[str, str]] = []
        for m in _TYPE.finditer(text):
            if m["group"]:
                at, end = m.end(), closing(text, m.end() - 1) - 1
                while at < end:
                    spec = _SPEC.search(text, at, end)
                    if not spec:
                        break
                    at = self._type(f, text, spec, inherited, heads)
            elif spec := _SPEC.match(text, m.end()):
                self._type(f, text, spec, inherited, heads)
        for m in _FUNC.finditer(text):
            heads.add(m.end() - 1)
            after = closing(text, m.end() - 1)
            open_ = self._body(text, after)
            end = closing(text, open_) if open_ >= 0 else statement_end(text, after)
            result = text[after : open_ if open_ >= 0 else end].strip()
            f.define("Method" if m["owner"] else "Function", m["name"], m.start(), end, container_name=m["owner"], is_exported=m["name"][:1].isupper(), parameter_count=_arity(text[m.end() : after - 1]), return_type=result or None)
        for child, parent in inherited:
            f.inherit(child, parent, "Extends")
        for m in re.finditer(r"^import\s*(?P<group>\()?", text, re.M):
            end = closing(text, m.end() - 1) if m["group"] else statement_end(text, m.end())
            for one in _IMPORT.finditer(f.text, m.end(), end):
                alias = one["alias"] if one["alias"] not in (None, ".", "_") else None
                f.import_(alias or one["path"].rsplit("/", 1)[-1], one["path"], one.start(), alias=alias, namespace=True)
        for name, receiver, at, paren in Calls(text, _WORDS):
            if paren not in heads:
                f.call(name, f.text[slice(*receiver)].strip() if receiver else None, at, len(split_top(text[paren + 1 : closing(text, paren) - 1], angles=False)))
        return f.done()

    @staticmethod
    def _body(text: str, at: int) -> int:
        """The brace that opens a function's body, -1 without one; braces of result types are passed over."""
        k = at
        while k < len(text):
            if text[k] == "\n":
                return -1
            if text[k] in "([":
                k = closing(text, k)
            elif text[k] == "{":
                if re.search(r"(struct|interface)\s*$", text[at:k]):
                    k = closing(text, k)
                else:
                    return k
            else:
                k += 1
        return -1

    def _type(self, f: File, text: str, spec: re.Match, inherited: list, heads: set[int]) -> int:
        name, kind = spec["name"], spec["kind"]
        label = "Type"
        end = statement_end(text, spec.end() - 1)
        if kind.startswith(("struct", "interface")):
            end = closing(text, spec.end() - 1)
            label = "Struct" if kind.startswith("struct") else "Interface"
        f.define(label, name, spec.start(), end, is_exported=name[:1].isupper())
        if label != "Type":
            at = spec.end()
            for line in text[at : end - 1].split("\n"):
                own = line.strip()
                if label == "Interface" and (m := re.match(r"([A-Za-z_]\w*)\s*\(", own)):
                    start = at + line.index(own)
                    heads.add(start + m.end() - 1)
                    close = closing(text, start + m.end() - 1)
                    f.define("Method", m[1], start, start + len(own), container_name=name, is_exported=m[1][:1].isupper(), parameter_count=_arity(text[start + m.end() : close - 1]), return_type=text[close : start + len(own)].strip() or None)
                elif m := re.fullmatch(r"\*?(?:\w+\.)?([A-Za-z_]\w*)(?:\s+`\s*`)?", own):
                    inherited.append((name, m[1]))
                elif self.named_fields and (m := re.fullmatch(r"\w+\s+([A-Za-z_]\w*)", own)):
                    inherited.append((name, m[1]))
                at += len(line) + 1
        return end
