"""Python, by the standard library's syntax trees."""
from __future__ import annotations

import ast
import re

from ...errors import ParseFailed
from ...schema import EXTENSIONS
from .base import Facts, File


#: Lines that are given up in a file before the file is.
MOST_ERRORS = 200


def tolerant(path: str, text: str) -> ast.Module:
    """The syntax tree; a line that can't be parsed counts as a block's head, as `pass`, or as nothing."""
    lines, last = text.split("\n"), None
    for _ in range(MOST_ERRORS):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            last = e
            k = min(max(1, e.lineno or 1), len(lines)) - 1
            while k >= 0 and not lines[k].strip():
                k -= 1
            if k < 0:
                break
            own = lines[k].strip()
            indent = lines[k][: len(lines[k]) - len(lines[k].lstrip())]
            # the head of a block still holds its lines together
            lines[k] = indent + "if 1:" if own.endswith(":") and own != "if 1:" else "" if own == "pass" else indent + "pass"
        except (ValueError, RecursionError) as e:
            raise ParseFailed(f"{path}: {e}") from e
    raise ParseFailed(f"{path}: {last}")


class Python:
    language, extensions = "python", EXTENSIONS["python"]

    def parse(self, path: str, data: bytes) -> Facts:
        f = File(path, data, self.language)
        tree = tolerant(path, f.text)
        bytes_of = [f.text[a:b].encode() for a, b in zip(f.starts, [*f.starts[1:], len(f.text)], strict=True)]

        def at(line: int, col: int) -> int:
            return f.starts[line - 1] + len(bytes_of[line - 1][:col].decode("utf-8", "replace"))

        def span(n: ast.AST) -> tuple[int, int]:
            return at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)

        def hidden(name: str) -> bool:
            return name.startswith("_") and name != "__init__"

        def visit(node: ast.AST, owner: str | None) -> None:
            """owner: the nearest class around."""
            for n in ast.iter_child_nodes(node):
                inner = owner
                if isinstance(n, ast.ClassDef):
                    inner = n.name
                    if not hidden(n.name):
                        f.define("Class", n.name, *span(n), container_name=owner, is_exported=not n.name.startswith("_"), annotations=decorators(n) or None)
                elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not hidden(n.name):
                    a, own = n.args, decorators(n)
                    count = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                    f.define(
                        "Method" if owner else "Function", n.name, *span(n), container_name=owner, is_exported=not n.name.startswith("_"), is_async=isinstance(n, ast.AsyncFunctionDef), parameter_count=max(0, count - 1) if owner else count,
                        is_static="staticmethod" in own, annotations=own or None,
                    )
                elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and not hidden(n.target.id):
                    f.define("Property", n.target.id, *span(n), container_name=owner, is_exported=not n.target.id.startswith("_"))
                elif isinstance(n, ast.Call):
                    start, args = at(n.lineno, n.col_offset), len(n.args) + len(n.keywords)
                    if isinstance(n.func, ast.Name):
                        f.call(n.func.id, None, start, args)
                    elif isinstance(n.func, ast.Attribute):
                        f.call(n.func.attr, f.text[slice(*span(n.func.value))], start, args)
                elif isinstance(n, ast.Import):
                    for x in n.names:
                        f.import_(x.name, x.name.replace(".", "/"), span(n)[0], namespace=True)
                elif isinstance(n, ast.ImportFrom):
                    # dots in front are the importing file's own folder and those above
                    up = "" if not n.level else "./" if n.level == 1 else "../" * (n.level - 1)
                    for x in n.names:
                        f.import_(x.name, up + (n.module or "").replace(".", "/"), span(n)[0], alias=x.asname, namespace=x.name == "*")
                visit(n, inner)

        def decorators(n) -> list[str]:
            return [re.split(r"\(", f.text[slice(*span(d))])[0].strip() for d in n.decorator_list]

        visit(tree, None)
        for n in ast.walk(tree):
            if isinstance(n, ast.ClassDef):
                for b in n.bases:
                    if isinstance(b, ast.Name):
                        f.inherit(n.name, b.id, "Extends")
        return f.done()
