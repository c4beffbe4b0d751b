"""What a Java file states: names, types, members and metrics of its functions."""

from __future__ import annotations

from typing import Any

from .parser import Node, Parser

FUNCTIONS = frozenset(("method", "constructor", "compact", "lambda"))
LOOPS = frozenset(("for", "foreach", "while", "do"))
BRANCHES = LOOPS | {"if", "catch", "ternary"}
MOST_COMPLEXITY, MOST_PARAMETERS = 65535, 255


def cyclomatic(function: Node) -> int:
    """One, and one more for each branch, loop, handler, conditional, logical operator and case that names a value."""
    total, stack = 1, list(function.children)
    while stack:
        node = stack.pop()
        if node.kind in FUNCTIONS:
            continue
        total += node.kind in BRANCHES or node.kind == "logic" or node.kind == "case" and node.count > 0
        stack += node.children
    return min(total, MOST_COMPLEXITY)


def cognitive(function: Node) -> int:
    """Reading difficulty: structures cost more the deeper they stand.

    A body or condition is entered by its children, so a structure that is
    itself the body (no braces), the branch of a conditional or the bare
    condition of a ``for`` isn't counted.  Nodes wait on a stack with their
    depth, so nesting has no limit.
    """
    total, stack = 0, [(child, 0, function) for child in function.children]
    while stack:
        node, depth, parent = stack.pop()
        kind = node.kind
        if kind in FUNCTIONS:
            continue
        entered = [(node, depth)]  # whose children come next, and how deep they stand
        if kind == "if":
            cost, entered = _if(node, depth)
            total += cost
        elif kind in LOOPS or kind in ("switch", "catch"):
            total += 1 + depth
            body = node.parts.get("body")
            entered = [(c, depth + (c is body)) for c in node.children]
        elif kind == "ternary":
            total += 1 + depth
            entered = [(part, depth + (name != "condition")) for name, part in node.parts.items()]
        elif kind == "jump":
            total += bool(node.name)
            continue
        elif kind == "logic":
            total += not (parent.kind == "logic" and parent.name == node.name)
        stack += [(child, deep, own) for own, deep in entered for child in own.children]
    return min(total, MOST_COMPLEXITY)


def _if(node: Node, depth: int) -> tuple[int, list[tuple[Node, int]]]:
    """The cost of a ladder of conditions, and the parts whose children come next."""
    total, entered = 1 + depth, []
    while True:
        entered += [(node.parts["condition"], depth), (node.parts["consequence"], depth + 1)]
        other = node.parts.get("alternative")
        if other is None:
            return total, entered
        total += 1
        if other.kind != "if":
            return total, [*entered, (other, depth + 1)]
        node = other


def _functions(root: Node) -> list[dict[str, Any]]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kind in FUNCTIONS:
            out.append({"name": node.name or "<anonymous>", "line": node.line, "col": node.col, "cyclomatic": cyclomatic(node), "cognitive": cognitive(node), "line_count": node.end_line - node.line + 1, "param_count": min(node.count, MOST_PARAMETERS)})
        stack += reversed(node.children)
    return out


def _types(root: Node, enclosing: list[str]) -> list[dict[str, Any]]:
    out, stack = [], [(child, enclosing) for child in reversed(root.children)]
    while stack:
        node, around = stack.pop()
        if node.kind == "type" and node.name:
            around = [*around, node.name]
            out.append({"fqn": ".".join(around), "simple": node.name, "line": node.line, "is_public": "public" in node.modifiers})
        stack += [(child, around) for child in reversed(node.children)]
    return out


def _exports(root: Node) -> list[dict[str, Any]]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.kind == "method" and node.name != "main" and {"public", "protected"} & set(node.modifiers) and "Override" not in node.annotations:
            out.append({"name": node.name, "line": node.line})
        stack += reversed(node.children)
    return out


def split_imports(texts: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Plain, wildcard and static imports; the wildcard is looked for first, so a static wildcard is a wildcard."""
    plain, wild, static = [], [], []
    for text in texts:
        if text.endswith(".*"):
            wild.append(text[:-2].removeprefix("static").strip())
        elif text.startswith("static"):
            static.append(text.removeprefix("static").strip())
        else:
            plain.append(text)
    return plain, wild, static


def parse_file(path: str, source: str) -> dict[str, Any]:
    """One row of the files table; of a file nested beyond all measure only the names and lines."""
    parser = Parser(source)
    root = parser.unit_or_none() or Node("unit", 1)
    package = next((n.name for n in root.children if n.kind == "package"), "")
    plain, wild, static = split_imports([n.name for n in root.children if n.kind == "import"])
    return {
        "path": path,
        "package": package,
        "imports": plain,
        "wildcard_imports": wild,
        "static_imports": static,
        "types": _types(root, [package] if package else []),
        "referenced": sorted(set(parser.type_names) | set(parser.annotation_names)),
        "used_names": sorted({t.text for t in parser.t if t.kind == "id"}),
        "annotations": sorted(set(parser.annotation_names)),
        "exports": _exports(root),
        "functions": _functions(root),
        "line_count": source.count("\n") + 1,
    }
