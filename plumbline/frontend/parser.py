"""A tolerant structural parser for Java: enough shape for metrics and names, never an exception on odd input.

It descends recursively over declarations, statements and expressions and
builds one kind of node.  Expressions keep what metrics need (conditionals,
logical operators, parentheses, lambdas, switches, class bodies); anything
else is a plain node around its parts.  A token that fits nowhere is skipped.

The descent is as deep as the text is nested.  Calls between Python functions
take no room on the C stack, so :meth:`Parser.unit_or_none` lets it go down
:data:`DEEPEST` frames; a file beyond that has no tree.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from .lexer import PRIMITIVES, Token, tokenize

MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non-sealed".split())
TYPE_WORDS = frozenset("class interface enum record @interface".split())
ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())
BINARY = frozenset("== != <= >= < > + - * / & | ^ % << >> >>>".split())
CLOSERS = frozenset(") ] } ; , :".split())
#: Frames of one descent, of which a level of parentheses takes eight; some 100 MB at most.
DEEPEST = 200_000


@dataclass
class Node:
    kind: str
    line: int
    children: list[Node] = field(default_factory=list)
    name: str = ""
    end_line: int = 0
    col: int = 0
    parts: dict[str, Node] = field(default_factory=dict)  # condition, consequence, alternative, body
    modifiers: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    count: int = 0  # parameters of a function; 1 for a case that names a value

    def part(self, name: str, node: Node | None) -> None:
        if node is not None:
            self.parts[name] = node
            self.children.append(node)


class Parser:
    def __init__(self, source: str):
        self.t = tokenize(source)
        last = self.t[-1].end_line if self.t else 1
        self.t += [Token("end", "", last, 0, last)] * 4
        self.i = 0
        self.type_names: list[str] = []
        self.annotation_names: list[str] = []
        self._arrow_after = self._parentheses_before_arrows()

    def _parentheses_before_arrows(self) -> set[int]:
        """Where parentheses open that close before an arrow, with no statement between."""
        found, opened = set(), []
        for i, t in enumerate(self.t):
            if t.kind != "op":
                continue
            if t.text == "(":
                opened.append(i)
            elif t.text == ")" and opened:
                begin = opened.pop()
                if i + 1 < len(self.t) and self.t[i + 1].text == "->":
                    found.add(begin)
            elif t.text in (";", "{", "}"):
                opened.clear()
        return found

    def unit_or_none(self) -> Node | None:
        """The whole file, or None if it is nested too deeply."""
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, DEEPEST))
        try:
            return self.unit()
        except RecursionError:
            return None
        finally:
            sys.setrecursionlimit(limit)

    # --- the token stream ---

    def at(self, *texts: str) -> bool:
        t = self.t[self.i]
        return t.text in texts and t.kind not in ("string", "char")

    def ahead(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def take(self) -> Token:
        t = self.t[self.i]
        if t.kind != "end":
            self.i += 1
        return t

    def skip(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def done(self) -> bool:
        return self.t[self.i].kind == "end"

    def close(self, node: Node) -> Node:
        node.end_line = self.t[self.i - 1].end_line if self.i else node.line
        return node

    def node(self, kind: str) -> Node:
        t = self.t[self.i]
        return Node(kind, t.line, col=t.col)

    # --- types and annotations ---

    def dotted(self) -> str:
        parts = []
        while self.t[self.i].kind == "id":
            parts.append(self.take().text)
            if not (self.at(".") and self.ahead().kind == "id"):
                break
            self.take()
        return ".".join(parts)

    def annotation(self) -> tuple[str, list[Node]]:
        self.take()
        name = self.dotted()
        self.annotation_names.append(name.rpartition(".")[2])
        return name, self.arguments() if self.at("(") else []

    def prefix(self, node: Node) -> None:
        """Modifiers and annotations before a declaration."""
        while True:
            if self.at("@") and self.ahead().text != "interface":
                name, values = self.annotation()
                node.annotations.append(name.rpartition(".")[2])
                node.children += values
            elif self.at(*MODIFIERS) and not (self.at("default") and self.ahead().text in (":", "->")) and not (self.at("sealed") and self.ahead().kind not in ("id", "word")):
                node.modifiers.append(self.take().text)
            elif self.at("non") and self.ahead().text == "-" and self.ahead(2).text == "sealed":
                self.i += 3
            else:
                return

    def type(self) -> bool:
        """A type, with its names noted; False, and nothing moved, if there is none."""
        start, known, noted = self.i, len(self.type_names), len(self.annotation_names)
        if self._type():
            return True
        self.i = start
        del self.type_names[known:], self.annotation_names[noted:]
        return False

    def _type(self) -> bool:
        while self.at("@") and self.ahead().text != "interface":
            self.annotation()
        if self.t[self.i].text in PRIMITIVES:
            self.take()
        elif self.t[self.i].kind == "id":
            while True:
                self.type_names.append(self.take().text)
                if self.at("<") and not self.type_arguments():
                    return False
                if self.at(".") and self.ahead().kind == "id":
                    self.take()
                elif self.at(".") and self.ahead().text == "@":
                    self.take()
                    self.annotation()
                    if self.t[self.i].kind != "id":
                        return False
                else:
                    break
        else:
            return False
        while self.at("[") and self.ahead().text == "]":
            self.i += 2
        return True

    def type_arguments(self) -> bool:
        """``<...>`` with wildcards, bounds and nesting; closing angles may share a token."""
        self.take()
        while not self.done():
            while self.at("@"):
                self.annotation()
            if self.at("?"):
                self.take()
            elif not self.at(">", ">>", ">>>") and not self._type():
                return False
            while self.at("extends", "super", "&"):
                self.take()
                if not self._type():
                    return False
            if self.skip(","):
                continue
            t = self.t[self.i]
            if t.text == ">":
                self.take()
                return True
            if t.text in (">>", ">>>"):
                self.t[self.i] = t._replace(text=t.text[1:], col=t.col + 1)
                return True
            return False
        return False

    # --- declarations ---

    def unit(self) -> Node:
        """The whole file."""
        root = self.node("unit")
        while not self.done():
            start = self.i
            if self.at("package"):
                root.children.append(self.package())
            elif self.at("import"):
                root.children.append(self.import_())
            elif self.skip(";") or self.skip("}"):
                continue
            else:
                self.member(root)
            if self.i == start:
                self.take()
        return self.close(root)

    def package(self) -> Node:
        node = self.node("package")
        self.take()
        node.name = self.dotted()
        self.skip(";")
        return self.close(node)

    def import_(self) -> Node:
        node = self.node("import")
        self.take()
        text = []
        while not self.done() and not self.at(";", "import", "class", "@"):
            t = self.take()
            text.append(t.text + (" " if t.text == "static" else ""))
        self.skip(";")
        node.name = "".join(text)
        return self.close(node)

    def at_type_declaration(self) -> bool:
        if self.at("class", "interface", "enum") or self.at("@") and self.ahead().text == "interface":
            return True
        return self.at("record") and self.ahead().kind == "id" and self.ahead(2).text in ("(", "<")

    def member(self, owner: Node, owner_name: str = "") -> None:
        """A type, method, constructor, initialiser or field, added to the owner."""
        node = self.node("member")
        self.prefix(node)
        if self.at("package"):
            found = self.package()
            node.kind, node.name = "package", found.name
            owner.children.append(self.close(node))
            return
        if self.at_type_declaration():
            owner.children.append(self.type_declaration(node))
            return
        if self.at("{"):
            node.kind = "initializer"
            node.part("body", self.block())
            owner.children.append(self.close(node))
            return
        if self.at("<"):
            if not self.type_arguments():
                self.skip_to(";", "{", "}")
        t = self.t[self.i]
        if t.kind == "id" and self.ahead().text == "(" and t.text == (owner_name or t.text):
            node.kind, node.name = "constructor", self.take().text
            self.function_rest(node)
        elif t.kind == "id" and self.ahead().text == "{" and t.text == owner_name:
            node.kind, node.name = "compact", self.take().text
            node.part("body", self.block())
        elif self.type():
            if self.t[self.i].kind == "id" and self.ahead().text == "(":
                node.kind, node.name = "method", self.take().text
                self.function_rest(node)
            else:
                node.kind = "field"
                self.declarators(node)
                self.skip(";")
        else:
            return
        owner.children.append(self.close(node))

    def skip_to(self, *texts: str) -> None:
        while not self.done() and not self.at(*texts):
            self.take()

    def type_declaration(self, node: Node) -> Node:
        node.kind = "type"
        annotation = self.skip("@")
        word = self.take().text
        node.name = self.take().text if self.t[self.i].kind == "id" else ""
        if self.at("<"):
            self.type_arguments()
        if word == "record" and self.at("("):
            self.parameters(node)
            node.count = 0
        while self.at("extends", "implements", "permits"):
            self.take()
            while self.type() and self.skip(","):
                pass
        if self.at("{"):
            node.part("body", self.body(node.name, word == "enum"))
            if word == "interface" and annotation:  # its elements look like methods but aren't functions
                for child in node.parts["body"].children:
                    child.kind = "element" if child.kind == "method" else child.kind
        return self.close(node)

    def body(self, owner_name: str, enum: bool = False) -> Node:
        node = self.node("class body")
        self.take()
        if enum:
            self.constants(node)
        while not self.done() and not self.at("}"):
            start = self.i
            if not self.skip(";"):
                self.member(node, owner_name)
            if self.i == start:
                self.take()
        self.skip("}")
        return self.close(node)

    def constants(self, node: Node) -> None:
        while not self.done() and not self.at(";", "}"):
            start, constant = self.i, self.node("constant")
            self.prefix(constant)
            if self.t[self.i].kind == "id":
                constant.name = self.take().text
                if self.at("("):
                    constant.children += self.arguments()
                if self.at("{"):
                    constant.part("body", self.body(""))
                node.children.append(self.close(constant))
            self.skip(",")
            if self.i == start:
                self.take()
        self.skip(";")

    def parameters(self, node: Node) -> None:
        """Formal parameters; a receiver isn't counted."""
        self.take()
        while not self.done() and not self.at(")"):
            start, own = self.i, self.node("parameter")
            self.prefix(own)
            self.type()
            if self.at("..."):
                self.take()
            while self.at("@"):
                self.annotation()
            if self.at("this") or self.ahead().text == "." and self.ahead(2).text == "this":
                self.skip_to(",", ")")
            elif self.t[self.i].kind == "id":
                own.name = self.take().text
                node.count += 1
                while self.at("[", "]"):
                    self.take()
            node.children.append(own)
            self.skip(",")
            if self.i == start:
                self.take()
        self.skip(")")

    def function_rest(self, node: Node) -> None:
        self.parameters(node)
        while self.at("[", "]"):
            self.take()
        if self.skip("throws"):
            while self.type() and self.skip(","):
                pass
        if self.skip("default"):
            node.children.append(self.expression())
        if self.at("{"):
            node.part("body", self.block())
        else:
            self.skip(";")

    def declarators(self, node: Node) -> None:
        while self.t[self.i].kind == "id":
            own = self.node("declarator")
            own.name = self.take().text
            while self.at("[", "]"):
                self.take()
            if self.skip("="):
                own.children.append(self.expression())
            node.children.append(self.close(own))
            if not self.skip(","):
                break

    # --- statements ---

    def block(self) -> Node:
        node = self.node("block")
        self.take()
        while not self.done() and not self.at("}"):
            start = self.i
            node.children.append(self.statement())
            if self.i == start:
                self.take()
        self.skip("}")
        return self.close(node)

    def parenthesised(self) -> Node:
        node = self.node("paren")
        if self.skip("("):
            while not self.done() and not self.at(")", "{", "}", ";"):
                start = self.i
                node.children.append(self.expression())
                if not self.skip(",") and self.i == start:
                    self.take()
            self.skip(")")
        return self.close(node)

    def statement(self) -> Node:
        t, node = self.t[self.i], self.node("statement")
        word = t.text if t.kind in ("word", "op", "id") else ""
        if word == "{":
            return self.block()
        if word == ";":
            self.take()
            return self.close(node)
        if word == "if":
            node.kind = "if"
            self.take()
            node.part("condition", self.parenthesised())
            node.part("consequence", self.statement())
            if self.skip("else"):
                node.part("alternative", self.statement())
            return self.close(node)
        if word == "while":
            node.kind = "while"
            self.take()
            node.part("condition", self.parenthesised())
            node.part("body", self.statement())
            return self.close(node)
        if word == "do":
            node.kind = "do"
            self.take()
            node.part("body", self.statement())
            if self.skip("while"):
                node.part("condition", self.parenthesised())
            self.skip(";")
            return self.close(node)
        if word == "for":
            return self.for_(node)
        if word == "switch":
            found = self.expression()
            self.skip(";")
            return found
        if word == "try":
            return self.try_(node)
        if word == "synchronized" and self.ahead().text == "(":
            self.take()
            node.children.append(self.parenthesised())
            node.part("body", self.block() if self.at("{") else self.statement())
            return self.close(node)
        if word in ("break", "continue"):
            node.kind = "jump"
            self.take()
            if self.t[self.i].kind == "id":
                node.name = self.take().text
            self.skip(";")
            return self.close(node)
        if word in ("return", "throw", "assert") or word == "yield" and self.ahead().text not in ("=", ".", "(", "++", "--", "["):
            self.take()
            if not self.at(";"):
                node.children.append(self.expression())
                if word == "assert" and self.skip(":"):
                    node.children.append(self.expression())
            self.skip(";")
            return self.close(node)
        if t.kind == "id" and self.ahead().text == ":" and self.ahead(2).text != ":":
            self.i += 2
            node.kind = "labelled"
            node.children.append(self.statement())
            return self.close(node)
        if word in ("case", "default") and not (word == "default" and self.ahead().text not in (":", "->")):
            return self.label(node)
        if word in ("else", "catch", "finally"):  # stray
            self.take()
            return self.close(node)
        self.prefix(node)
        if self.at_type_declaration():
            return self.type_declaration(node)
        if self.local_declaration(node):
            self.skip(";")
            return self.close(node)
        start = self.i
        node.children.append(self.expression())
        while self.skip(","):
            node.children.append(self.expression())
        if not self.skip(";") and self.i == start:
            self.take()
        return self.close(node)

    def local_declaration(self, node: Node) -> bool:
        start, known, noted = self.i, len(self.type_names), len(self.annotation_names)
        if self.type() and self.t[self.i].kind == "id" and self.ahead().text in ("=", ";", ",", ":", "[", ")"):
            node.kind = "declaration"
            self.declarators(node)
            return True
        self.i = start
        del self.type_names[known:], self.annotation_names[noted:]
        return False

    def for_(self, node: Node) -> Node:
        self.take()
        node.kind = "for"
        if self.skip("("):
            while not self.done() and not self.at(")"):
                start = self.i
                own = self.node("statement")
                self.prefix(own)
                if self.skip(";") or self.skip(","):
                    continue
                if self.local_declaration(own):
                    if self.skip(":"):
                        node.kind = "foreach"
                        node.children.append(own)
                        node.children.append(self.expression())
                    else:
                        node.children.append(own)
                else:
                    node.children.append(self.expression())
                if self.i == start:
                    self.take()
            self.skip(")")
        node.part("body", self.statement())
        return self.close(node)

    def try_(self, node: Node) -> Node:
        self.take()
        node.kind = "try"
        if self.skip("("):
            while not self.done() and not self.at(")"):
                start, own = self.i, self.node("statement")
                self.prefix(own)
                if not self.local_declaration(own):
                    own.children.append(self.expression())
                node.children.append(own)
                self.skip(";")
                if self.i == start:
                    self.take()
            self.skip(")")
        if self.at("{"):
            node.part("body", self.block())
        while self.at("catch"):
            own = self.node("catch")
            self.take()
            if self.skip("("):
                self.prefix(own)
                while self.type() and self.skip("|"):
                    pass
                self.skip_to(")", "{")
                self.skip(")")
            if self.at("{"):
                own.part("body", self.block())
            node.children.append(self.close(own))
        if self.skip("finally") and self.at("{"):
            own = self.node("finally")
            own.children.append(self.block())
            node.children.append(self.close(own))
        return self.close(node)

    def label(self, node: Node) -> Node:
        """``case`` or ``default`` with its colon or arrow; several values are one label."""
        node.kind = "case"
        if self.take().text == "case":
            node.count = 1
            while not self.done() and not self.at(":", "->", "}", ";"):
                start = self.i
                if self.skip(",") or self.skip("default"):
                    continue
                if self.at("when"):
                    self.take()
                    node.children.append(self.expression())
                elif not self.pattern():
                    node.children.append(self.ternary(False))
                if self.i == start:
                    self.take()
        self.skip(":") or self.skip("->")
        return self.close(node)

    def pattern(self) -> bool:
        """A type with a name or a parenthesised list of patterns."""
        start, known, noted = self.i, len(self.type_names), len(self.annotation_names)
        self.skip("final")
        if self.type():
            if self.t[self.i].kind == "id" and not self.at("when"):
                self.take()
                return True
            if self.skip("("):
                while not self.done() and not self.at(")"):
                    if not (self.pattern() or self.skip(",")):
                        break
                if self.skip(")"):
                    if self.t[self.i].kind == "id" and not self.at("when"):
                        self.take()
                    return True
        self.i = start
        del self.type_names[known:], self.annotation_names[noted:]
        return False

    # --- expressions ---

    def expression(self) -> Node:
        left = self.ternary()
        if self.at(*ASSIGN):
            node = Node("assign", left.line, [left])
            self.take()
            node.children.append(self.expression())
            return self.close(node)
        return left

    def ternary(self, lambdas: bool = True) -> Node:
        condition = self.logical("||", lambdas)
        if not self.at("?"):
            return condition
        node = Node("ternary", condition.line)
        node.part("condition", condition)
        self.take()
        node.part("consequence", self.expression())
        self.skip(":")
        node.part("alternative", self.ternary(lambdas))
        return self.close(node)

    def logical(self, op: str, lambdas: bool) -> Node:
        below = (lambda: self.logical("&&", lambdas)) if op == "||" else (lambda: self.operand(lambdas))
        left = below()
        while self.at(op):
            node = Node("logic", left.line, [left], name=op)
            self.take()
            node.children.append(below())
            left = self.close(node)
        return left

    def lambda_ahead(self) -> bool:
        if self.t[self.i].kind == "id" and self.ahead().text == "->":
            return True
        return self.i in self._arrow_after and self.at("(")

    def lambda_(self) -> Node:
        node = self.node("lambda")
        node.name = "<lambda>"
        if self.at("("):
            if self.ahead().kind == "id" and self.ahead(2).text in (",", ")"):
                self.take()
                while not self.done() and not self.at(")"):
                    node.count += self.take().kind == "id"
                self.skip(")")
            else:
                self.parameters(node)
        else:
            self.take()
            node.count = 1
        self.skip("->")
        node.part("body", self.block() if self.at("{") else self.expression())
        return self.close(node)

    def cast(self) -> bool:
        """A parenthesised type before what begins an operand."""
        start, known, noted = self.i, len(self.type_names), len(self.annotation_names)
        if self.skip("("):
            primitive = self.t[self.i].text in PRIMITIVES
            if self.type():
                while self.skip("&") and self.type():
                    pass
                if self.skip(")"):
                    t = self.t[self.i]
                    if t.kind in ("id", "number", "string", "char") or t.text in ("(", "!", "~", "new", "this", "super", "switch", "true", "false", "null") or t.text in PRIMITIVES or primitive and t.text in ("+", "-", "++", "--"):
                        return True
        self.i = start
        del self.type_names[known:], self.annotation_names[noted:]
        return False

    def operand(self, lambdas: bool = True) -> Node:
        """Operands joined by any operators tighter than the logical ones."""
        node = self.node("operand")
        while not self.done():
            while self.at("+", "-", "!", "~", "++", "--") or self.at("(") and not (lambdas and self.lambda_ahead()) and self.cast():
                if not (self.t[self.i - 1].text == ")" and not self.at("+", "-", "!", "~", "++", "--")):
                    self.take()
            start = self.i
            found = self.primary(lambdas)
            if found is not None:
                node.children.append(found)
            if self.at("instanceof"):
                self.take()
                if not self.pattern():
                    self.skip("final")
                    self.type()
            if self.at(*BINARY):
                self.take()
                continue
            if found is None or self.i == start or self.t[self.i].kind == "op" or self.t[self.i].kind == "word":
                break
            break
        self.close(node)
        return node.children[0] if len(node.children) == 1 else node

    def arguments(self) -> list[Node]:
        return self.parenthesised().children

    def primary(self, lambdas: bool) -> Node | None:
        t = self.t[self.i]
        if t.kind == "end" or t.kind == "op" and t.text in CLOSERS:
            return None
        if lambdas and self.lambda_ahead():
            return self.lambda_()
        if self.at("("):
            node = self.parenthesised()
        elif self.at("new"):
            node = self.creation()
        elif self.at("switch"):
            node = self.node("switch")
            self.take()
            node.part("condition", self.parenthesised())
            if self.at("{"):
                node.part("body", self.block())
            self.close(node)
        elif self.at("{"):
            node = self.node("array")
            self.take()
            while not self.done() and not self.at("}"):
                start = self.i
                node.children.append(self.expression())
                if not self.skip(",") and self.i == start:
                    self.take()
            self.skip("}")
            self.close(node)
        elif self.at("@"):
            node = self.node("annotation")
            node.children += self.annotation()[1]
        else:
            node = self.node("leaf")
            if t.kind == "id" and self.class_literal() or t.text in PRIMITIVES and self.type():
                pass
            else:
                self.take()
        return self.suffixes(node)

    def class_literal(self) -> bool:
        """``Type.class`` or ``Type[]::new``, whose names are types."""
        start, known, noted = self.i, len(self.type_names), len(self.annotation_names)
        if self.type() and (self.at(".") and self.ahead().text == "class" or self.at("::") and self.t[self.i - 1].text in ("]", ">")):
            return True
        self.i = start
        del self.type_names[known:], self.annotation_names[noted:]
        return False

    def suffixes(self, node: Node) -> Node:
        wrap = Node("access", node.line, [node])
        while True:
            if self.at(".") or self.at("::"):
                self.take()
                if self.at("<"):
                    self.type_arguments()
                if self.at("new") and self.t[self.i - 1].text == ".":
                    wrap.children.append(self.creation())
                elif self.t[self.i].kind in ("id", "word"):
                    self.take()
            elif self.at("("):
                wrap.children += self.arguments()
            elif self.at("["):
                self.take()
                if not self.at("]"):
                    wrap.children.append(self.expression())
                self.skip("]")
            elif self.at("++", "--"):
                self.take()
            else:
                break
        return self.close(wrap) if len(wrap.children) > 1 else node

    def creation(self) -> Node:
        node = self.node("creation")
        self.take()
        if self.at("<"):
            self.type_arguments()
        self.type()
        while self.at("["):
            self.take()
            if not self.at("]"):
                node.children.append(self.expression())
            self.skip("]")
        if self.at("("):
            node.children += self.arguments()
            if self.at("{"):
                node.part("body", self.body(""))
        elif self.at("{"):
            found = self.primary(False)
            node.children += [found] if found else []
        return self.close(node)
