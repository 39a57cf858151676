"""Rust, by a scanner over text without comments and strings."""
from __future__ import annotations

import re
from bisect import bisect_right

from ...schema import EXTENSIONS
from .base import Calls, Facts, File, blank, closing, split_top

_VIS = r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?"
_ITEM = re.compile(_VIS + r"\b(?P<kind>struct|enum|trait|mod|type|union)\s+(?P<name>[A-Za-z_]\w*)")
_IMPL = re.compile(r"\b(?:unsafe\s+)?impl\b(?P<head>[^{;]*)\{")
_MACRO = re.compile(r"\bmacro_rules!\s*(?P<name>\w+)\s*(?P<open>[{(\[])")
_FN = re.compile(_VIS + r"(?P<words>(?:\b(?:const|async|unsafe|default|extern(?:\s*\"[^\"]*\")?)\s+)*)\bfn\s+(?P<name>\w+)\s*(?:<[^({]*>)?\s*\(")
_INVOKED = re.compile(r"(?P<path>(?:\w+\s*::\s*)*)\b(?P<name>[A-Za-z_]\w*)!\s*(?=[(\[{])")
_USE = re.compile(r"\buse\s+(?P<tree>[^;]+);")
_WORDS = frozenset("if while for match return fn loop in as let mut ref move pub impl where struct enum trait mod use else unsafe".split())
_LABELS = {"struct": "Struct", "union": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Namespace", "type": "TypeAlias"}


def clean(name: str) -> str:
    """A type's own name: no references, mut, generics or path."""
    name = re.sub(r"^&+\s*(?:'\w+\s+)?(?:mut\s+)?", "", name.strip())
    return re.sub(r"<.*$", "", name, flags=re.S).strip().rsplit("::", 1)[-1]


def _without_generics(text: str) -> str:
    """Text after `impl`, without its own parameter list."""
    text = text.strip()
    if not text.startswith("<"):
        return text
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "<") - (c == ">" and text[k - 1] != "-")
        if depth == 0:
            return text[k + 1 :].strip()
    return text


class Rust:
    language, extensions = "rust", EXTENSIONS["rust"]

    def parse(self, path: str, data: bytes) -> Facts:
        f = File(path, data, self.language)
        text = blank(f.text, "\"'", char_literals=True)
        heads: set[int] = set()
        owners: list[tuple[int, int, str]] = []  # bodies of impls and traits
        inherited: list[tuple[str, str, str]] = []
        for m in _ITEM.finditer(text):
            stop = re.compile(r"[{;]").search(text, m.end())
            at = stop.start() if stop else len(text)
            end = closing(text, at) if text[at : at + 1] == "{" else at + 1
            f.define(_LABELS[m["kind"]], m["name"], m.start(), end, is_exported=bool(m["vis"]), visibility="pub" if m["vis"] else None)
            if m["kind"] == "trait":
                owners.append((at, end, m["name"]))
                bounds = re.match(r"\s*(?:<[^{]*?>)?\s*:\s*([^{]*?)(?:\bwhere\b|$)", text[m.end() : at], re.S)
                inherited += [(m["name"], clean(p), "Extends") for p in split_top(bounds[1], "+") if not p.startswith("'")] if bounds else []
        for m in _IMPL.finditer(text):
            end = closing(text, m.end() - 1)
            head = re.split(r"\bwhere\b", _without_generics(m["head"]))[0]
            parts = re.split(r"\bfor\b", head)
            name = clean(parts[-1])
            if not name:
                continue
            owners.append((m.end() - 1, end, name))
            f.define("Impl", name, m.start(), end)
            if len(parts) > 1:
                inherited.append((name, clean(parts[0].lstrip("!")), "Implements"))
        for m in _MACRO.finditer(text):
            f.define("Macro", m["name"], m.start(), closing(text, m.end() - 1))
        for m in _FN.finditer(text):
            heads.add(m.end() - 1)
            after = closing(text, m.end() - 1)
            stop = re.compile(r"[{;]").search(text, after)
            at = stop.start() if stop else len(text)
            body = text[at : at + 1] == "{"
            result = re.match(r"\s*->\s*(.*?)\s*(?:\bwhere\b.*)?$", text[after:at], re.S)
            owner = next((o for a, b, o in sorted(owners, key=lambda x: x[1] - x[0]) if a < m.start() < b), None)
            params = [p for p in split_top(text[m.end() : after - 1]) if not re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self(?:\s*:.*)?", p, re.S)]
            f.define(
                "Method" if owner or not body else "Function", m["name"], m.start(), closing(text, at) if body else at + 1, container_name=owner, is_exported=bool(m["vis"]), visibility="pub" if m["vis"] else None,
                is_async="async" in m["words"].split(), parameter_count=len(params), return_type=result[1] if result else None,
            )
        for row in inherited:
            f.inherit(*row)
        for m in _USE.finditer(text):
            for name, module, alias in _uses(m["tree"]):
                f.import_(name, module, m.start(), alias=alias, namespace=name == "*")
        # what stands in a macro's brackets is tokens, not calls
        tokens, last = [], 0
        for m in _INVOKED.finditer(text):
            if m.start() >= last and m["name"] != "macro_rules":
                last = closing(text, m.end())
                tokens.append((m.end(), last))
                if not m["path"]:
                    f.call(m["name"], None, m.start(), 0)
        starts = [a for a, _ in tokens]
        for name, receiver, at, paren in Calls(text, _WORDS, paths=True):
            k = bisect_right(starts, paren) - 1
            if paren in heads or k >= 0 and paren < tokens[k][1]:
                continue
            f.call(name, f.text[slice(*receiver)].strip() if receiver else None, at, len(split_top(text[paren + 1 : closing(text, paren) - 1], angles=False)))
        return f.done()


def _uses(tree: str) -> list[tuple[str, str, str | None]]:
    """(name, module path, alias) of a use declaration; one level of braces."""
    tree = " ".join(tree.split())
    prefix, rest = "", [tree]
    if m := re.fullmatch(r"(.*?)(?:::)?\s*\{(.*)\}", tree):
        prefix, rest = m[1], split_top(m[2])
    out = []
    for one in rest:
        name, _, alias = one.partition(" as ")
        path = [p.strip() for p in "::".join(x for x in (prefix, name) if x).split("::")]
        while len(path) > 1 and path[0] in ("crate", "self", "super"):
            path = path[1:]
        last = path[-1]
        if last == "self" and len(path) > 1:
            path, last = path[:-1], path[-2]
        out.append((last, "/".join(path[:-1]) or last, alias.strip() or None))
    return out
