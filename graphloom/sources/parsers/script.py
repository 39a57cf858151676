"""TypeScript and JavaScript, by a scanner over text without comments and strings."""
from __future__ import annotations

import re

from ...schema import EXTENSIONS
from .base import Calls, Facts, File, blank, closing, split_top, statement_end

_NAME = r"[A-Za-z_$][\w$]*"
_LEAD = r"(?P<lead>(?:\b(?:export|default|declare|abstract|async|public|private|protected|static|readonly)\s+)*)"
_TYPE = re.compile(_LEAD + rf"\b(?P<kind>class|interface|enum|const\s+enum)\s+(?!(?:extends|implements)\b)(?P<name>{_NAME})\s*(?P<generic><[^{{}}()]*>)?\s*(?P<head>[^{{;]*)\{{")
_ALIAS = re.compile(_LEAD + rf"\btype\s+(?P<name>{_NAME})\s*(?:<[^=;]*>)?\s*=")
_FUNCTION = re.compile(_LEAD + rf"\bfunction\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^()]*>)?\s*\(")
_CONST = re.compile(rf"(?P<lead>(?:\bexport\s+)?)\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=\s*(?P<async>async\s+)?(?P<what>function\b|(?:<[^()]*>\s*)?\(|{_NAME}\s*=>)")
_MEMBER = re.compile(rf"(?P<lead>(?:\b(?:public|private|protected|static|readonly|abstract|async|override|declare|get|set)\s+|\*\s*)*)(?P<name>#?{_NAME})\s*[?!]?\s*(?P<next><[^()=;]*>\s*\(|\(|:|=(?!=)|;|\n|$)")
_SIGNATURE = re.compile(rf"(?:{_NAME}|\bnew)\s*\??\s*(?:<[^()]*>)?\(|[;{{,\n]\s*\(")
_BARE_NEW = re.compile(rf"\bnew\s+(?P<name>{_NAME})\s*(?![\w$.(<\[])")
_ANONYMOUS = re.compile(r"\bclass\s*(?:(?:extends|implements)\b[^{;]*)?\{")
_WORDS = frozenset("if for while switch catch function return typeof await yield super import constructor of in do else throw case delete void instanceof new".split())
_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:(?P<clause>[^'\";()]*?)\s*\bfrom\s*)?(['\"])(?P<module>[^'\"\n]*)\2")
_REEXPORT = re.compile(r"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(['\"])(?P<module>[^'\"\n]*)\1")


class TypeScript:
    language, extensions, types = "typescript", EXTENSIONS["typescript"], True

    def parse(self, path: str, data: bytes) -> Facts:
        f = File(path, data, self.language)
        text = blank(f.text, "'\"", templates="`")
        heads: set[int] = set()  # brackets that open parameters of definitions, not calls
        self._types(f, text, heads)
        self._functions(f, text, heads)
        self._imports(f, text)
        calls = Calls(text, _WORDS, angles=self.types)
        for name, receiver, at, paren in calls:
            if paren in heads or self._signature(f, text, name, receiver, at, paren):
                continue
            told = f.text[slice(*receiver)].strip() if receiver else None
            if told and re.fullmatch(rf"new\s+{_NAME}(\s*\.\s*{_NAME})*", told):
                continue  # a constructor in a module
            inside = text[paren + 1 : closing(text, paren) - 1]
            f.call(name, told, at, len(split_top(inside, angles=False)))
        for m in _BARE_NEW.finditer(text):
            f.call(m["name"], None, m.start(), 0)
        return f.done()

    def _signature(self, f: File, text: str, name: str, receiver, at: int, paren: int) -> bool:
        """Whether it is a member of an object or of a type, not a call: `{ name() {} }` (a method, which is defined) or `{ name(): T }`."""
        after = closing(text, paren)
        nxt = re.compile(r"[ \t]*(?P<type>:[^{};=,()]*)?[ \t]*(?P<open>\{)?").match(text, after)
        lead = re.search(r"[{,;(](?:\s*(?:async|get|set|static|readonly|\*))*\s*$", text[max(0, at - 60) : at])
        if receiver or not lead or not (nxt["open"] or nxt["type"]) or nxt["open"] and lead[0][0] in ";(" or not nxt["open"] and lead[0][0] == "(":
            return False
        if nxt["open"]:
            words = lead[0][1:].split()
            more = {"is_async": "async" in words, "parameter_count": len(split_top(text[paren + 1 : after - 1])), "return_type": (nxt["type"] or "").lstrip(":").strip() or None}
            f.define("Method", name, at, closing(text, nxt.end() - 1), container_name=self._owner(at), **more)
        return bool(nxt["open"] or self.types)

    def _owner(self, at: int) -> str | None:
        """The nearest class around a place."""
        return next((n for a, b, n in sorted(self.classes, key=lambda c: c[1] - c[0]) if a <= at < b), None)

    def _types(self, f: File, text: str, heads: set[int]) -> None:
        inherited = []
        self.classes: list[tuple[int, int, str]] = []
        for m in _ANONYMOUS.finditer(text):
            self._members(f, text, m.end(), closing(text, m.end() - 1) - 1, None, heads)
        for m in _TYPE.finditer(text):
            kind = m["kind"].split()[-1]
            if kind != "class" and not self.types:
                continue
            end = closing(text, m.end() - 1)
            label = {"class": "Class", "interface": "Interface", "enum": "Enum"}[kind]
            f.define(label, m["name"], m.start(), end, is_exported=_exported(text, m.start(), m["lead"]))
            head = " " + re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m["head"]))
            for word, found in re.findall(r"\b(extends|implements)\s+([^{]*?)(?=\bextends\b|\bimplements\b|$)", head):
                inherited += [(m["name"], p, "Implements" if word == "implements" else "Extends") for p in split_top(found) if re.fullmatch(rf"{_NAME}(\.{_NAME})*", p)]
            if kind == "interface":  # signatures aren't calls
                heads.update(x.end() - 1 for x in _SIGNATURE.finditer(text, m.end(), end))
            if kind == "class":
                self.classes.append((m.end(), end, m["name"]))
                self._members(f, text, m.end(), end - 1, m["name"], heads)
        if self.types:
            for m in _ALIAS.finditer(text):
                f.define("TypeAlias", m["name"], m.start(), statement_end(text, m.end()), is_exported=_exported(text, m.start(), m["lead"]))
        for row in inherited:
            f.inherit(*row)

    def _members(self, f: File, text: str, k: int, end: int, owner: str | None, heads: set[int]) -> None:
        while k < end:
            if text[k].isspace() or text[k] in ";,}":
                k += 1
                continue
            if text[k] == "@":  # a decorator
                m = re.compile(rf"@{_NAME}(?:\.{_NAME})*").match(text, k)
                k = m.end() if m else k + 1
                k = closing(text, k) if text[k : k + 1] == "(" else k
                continue
            m = _MEMBER.match(text, k, end)
            if not m:
                k = statement_end(text, k) if text[k] not in "{[(" else closing(text, k)
                k += text[k : k + 1] in ")]}"
                continue
            lead = m["lead"].split()
            more = {"container_name": owner, "is_static": "static" in lead, "is_exported": _exported(text, k, ""), "visibility": next((v for v in ("public", "private", "protected") if v in lead), None)}
            if m["next"].endswith("("):
                heads.add(m.end() - 1)
                params_end = closing(text, m.end() - 1)
                body = re.compile(r"\s*(?::(?P<type>[^{};=]*))?\s*(?P<open>\{)?").match(text, params_end)
                stop = closing(text, body.end() - 1) if body["open"] else statement_end(text, params_end)
                f.define("Method", m["name"], k, stop, is_async="async" in lead, parameter_count=len(split_top(text[m.end() : params_end - 1])), return_type=(body["type"] or "").strip() or None, **more)
            else:
                at = m.end() - 1
                if m["next"] == "=" or m["next"] == ":":
                    at = m.end()
                stop = statement_end(text, at) if m["next"] not in (";", "\n", "") else m.end() - 1
                f.define("Property", m["name"], k, stop, **more)
            k = max(stop, k + 1)

    def _functions(self, f: File, text: str, heads: set[int]) -> None:
        for m in _FUNCTION.finditer(text):
            heads.add(m.end() - 1)
            self._function(f, text, m["name"], m.start(), m.end() - 1, _exported(text, m.start(), m["lead"]), "async" in m["lead"].split())
        for m in _CONST.finditer(text):
            if m["what"].startswith("function"):
                at = text.find("(", m.end())
            elif m["what"].endswith("("):
                at = m.end() - 1
                if not re.compile(r"\s*(:[^=;{]*(\{[^}]*\})?[^=;{]*)?=>").match(text, closing(text, at)):
                    continue
            else:
                f.define("Function", m["name"], m.start(), statement_end(text, m.end()), is_exported=bool(m["lead"]), is_async=bool(m["async"]), parameter_count=1)
                continue
            heads.add(at)
            self._function(f, text, m["name"], m.start(), at, bool(m["lead"]), bool(m["async"]))

    def _function(self, f: File, text: str, name: str, start: int, at: int, exported: bool, is_async: bool) -> None:
        after = closing(text, at)
        m = re.compile(r"\s*(?::(?P<type>\s*(?:\{[^}]*\}|[^{};=])[^{};=]*))?\s*(?P<arrow>=>)?\s*(?P<open>\{)?").match(text, after)
        end = closing(text, m.end() - 1) if m["open"] else statement_end(text, m.end())
        f.define("Function", name, start, end, is_exported=exported, is_async=is_async, parameter_count=len(split_top(text[at + 1 : after - 1])), return_type=(m["type"] or "").strip() or None)

    def _imports(self, f: File, text: str) -> None:
        for m in _IMPORT.finditer(f.text):
            if not text.startswith("import", m.start()):
                continue  # in a comment or a string
            clause, module = (m["clause"] or "").strip(), m["module"]
            if not clause:
                f.import_("*", module, m.start(), namespace=True)
                continue
            braces = re.search(r"\{([^}]*)\}", clause)
            for part in split_top(braces[1]) if braces else []:
                names = re.sub(r"^type\s+", "", part).split(" as ")
                f.import_(names[0].strip(), module, m.start(), alias=names[1].strip() if len(names) > 1 else None, default=names[0].strip() == "default")
            rest = re.sub(r"\{[^}]*\}", "", clause)
            for part in split_top(rest):
                if star := re.fullmatch(rf"\*\s+as\s+({_NAME})", part):
                    f.import_(star[1], module, m.start(), namespace=True)
                elif re.fullmatch(_NAME, part):
                    f.import_(part, module, m.start(), default=True)
        for m in _REEXPORT.finditer(f.text):
            if text.startswith("export", m.start()):
                f.import_("*", m["module"], m.start(), namespace=True)


class JavaScript(TypeScript):
    language, extensions, types = "javascript", EXTENSIONS["javascript"], False


def _exported(text: str, at: int, lead: str) -> bool:
    return lead.lstrip().startswith("export") or text[:at].rstrip(" \t").endswith(("export", "export default"))
