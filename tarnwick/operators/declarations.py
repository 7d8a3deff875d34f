"""Declarations of Python and Java sources, found by scanning; broken sources give what can be found.

A declaration has its first and last line (from 0, decorators and the comments
directly above included), dotted name, kind and inner declarations. Functions
within functions stay part of them.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field


@dataclass
class Declaration:
    first: int
    last: int
    name: str
    kind: str
    inner: list[Declaration] = field(default_factory=list)


def _with_comments(first: int, comment_of: dict[int, tuple[int, int]]) -> int:
    """The line where the comments directly above ``first`` begin; ``comment_of``: (first, last) line of comments, by last line, that stand alone."""
    while first - 1 in comment_of:
        first = comment_of[first - 1][0]
    return first


# ---------------------------------------------------------------- Python


def python_declarations(source: str) -> list[Declaration]:
    """Functions, classes and methods of a Python source."""
    lines = source.split("\n")
    comments = {k: (k, k) for k, line in enumerate(lines) if line.lstrip().startswith("#")}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _indented(lines, comments)

    def walk(node: ast.AST, scope: str, in_class: bool) -> list[Declaration]:
        out = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{child.name}" if scope else child.name
                is_class = isinstance(child, ast.ClassDef)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)]) - 1
                kind = "class" if is_class else "method" if in_class else "function"
                out.append(Declaration(_with_comments(first, comments), child.end_lineno - 1, name, kind, walk(child, name, True) if is_class else []))
            else:
                out += walk(child, scope, in_class)
        return sorted(out, key=lambda d: d.first)

    return walk(tree, "", False)


_DEF = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")


def _indented(lines: list[str], comments: dict) -> list[Declaration]:
    """Declarations by indentation alone, for sources that don't parse."""
    heads = [(k, len(m[1].expandtabs(8)), m[2], m[3]) for k, line in enumerate(lines) if (m := _DEF.match(line))]

    def end(k: int, indent: int) -> int:
        last = k
        for i in range(k + 1, len(lines)):
            text = lines[i].expandtabs(8)
            start = text.lstrip()
            if not start:
                continue
            if len(text) - len(start) > indent or start[0] in ")]}":
                last = i
            elif start[0] != "#":  # a comment that stands as far left may belong to what follows
                break
        return last

    def take(lo: int, hi: int, scope: str, in_class: bool) -> list[Declaration]:
        out, at = [], lo
        for k, indent, word, ident in heads:
            if k < at or k > hi:
                continue
            first, last = k, end(k, indent)
            while first > lo and lines[first - 1].lstrip().startswith("@"):
                first -= 1
            name = f"{scope}.{ident}" if scope else ident
            kind = "class" if word == "class" else "method" if in_class else "function"
            out.append(Declaration(_with_comments(first, comments), last, name, kind, take(k + 1, last, name, True) if word == "class" else []))
            at = last + 1
        return out

    return take(0, len(lines) - 1, "", False)


# ---------------------------------------------------------------- Java

_JAVA = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|[^\W\d][\w$]*|\d[\w.]*|->|::|\S', re.S)
_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
_NOT_METHODS = frozenset("if for while switch catch synchronized try do else return new throw assert case super this".split())


@dataclass
class _Token:
    text: str
    line: int
    last: int
    comment: bool = False


def _java_tokens(source: str) -> tuple[list[_Token], dict[int, tuple[int, int]]]:
    """(tokens without comments, comments that stand alone on their lines by their last line)."""
    out, alone, line, at = [], {}, 0, 0
    for m in _JAVA.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        last = line + source.count("\n", m.start(), m.end())
        if m[0].startswith(("//", "/*")):
            if not source[source.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
                alone[last] = (line, last)
        else:
            out.append(_Token(m[0], line, last))
    return out, alone


def java_declarations(source: str) -> list[Declaration]:
    """Types, methods and constructors of a Java source, by balanced brackets."""
    tokens, comments = _java_tokens(source)
    close = _closing(tokens)

    def body(lo: int, hi: int, scope: str, kind: str | None) -> list[Declaration]:
        """Declarations among the tokens lo to hi, the members of a type of ``kind`` (None: a file or a piece of code)."""
        out: list[Declaration] = []
        start = i = lo
        if kind == "enum":  # constants come first; their bodies hold members
            while i < hi and tokens[i].text != ";":
                if tokens[i].text == "{":
                    out += body(i + 1, close[i], scope, "enum body")
                i = close.get(i, i) + 1
            i += 1
            start = i
        while i < hi:
            text = tokens[i].text
            if text in _TYPES and _names_type(i, start):
                i = declare_type(i, start, hi, scope, out)
                start = i
            elif text in (";", "}"):
                i += 1
                start = i
            elif text == "@" and i + 1 < hi and tokens[i + 1].text != "interface":
                i += 2
                while i + 1 < hi and tokens[i].text == ".":
                    i += 2
                if i < hi and tokens[i].text == "(":
                    i = close[i] + 1
            elif text == "@":  # an annotation type is no declaration of ours
                while i < hi and tokens[i].text != "{":
                    i += 1
                i = close.get(i, i) + 1
                start = i
            elif text == "(" and kind is not None and i > start and _is_name(tokens[i - 1].text) and tokens[i - 1].text not in _NOT_METHODS and "=" not in (t.text for t in tokens[start:i]):
                end = method_end(close[i] + 1, hi)
                if end is None:
                    i = close[i] + 1
                    continue
                ident = tokens[i - 1].text
                typed = any(_is_name(t.text) and t.text not in _MODIFIERS or t.text in ("]", ">") for t in _plain(start, i - 1))
                name = f"{scope}.{ident}" if scope else ident
                out.append(Declaration(_with_comments(tokens[start].line, comments), tokens[end].last, name, "method" if typed else "constructor"))
                i = end + 1
                start = i
            elif text in ("(", "["):
                i = close[i] + 1
            elif text == "{":
                field_value = any(t.text in ("=", "new") for t in tokens[start:i])
                compact = kind == "record" and i > start and _is_name(tokens[i - 1].text) and tokens[i - 1].text == scope.rpartition(".")[2]
                if not compact:  # an initialiser, or a value: declarations inside it are found, members of anonymous types among them
                    out += body(i + 1, close[i], scope, "anonymous" if field_value and _anonymous(i) else None)
                i = close[i] + 1
                if not field_value:
                    start = i
            else:
                i += 1
        return out

    def _anonymous(i: int) -> bool:
        return tokens[i - 1].text == ")"

    def _plain(lo: int, hi: int) -> list[_Token]:
        """Tokens before a method's name, without annotations and type parameters."""
        out, i = [], lo
        while i < hi:
            if tokens[i].text == "@":
                i += 2
                while i + 1 < hi and tokens[i].text == ".":
                    i += 2
                if i < hi and tokens[i].text == "(":
                    i = close[i] + 1
                continue
            if tokens[i].text == "<" and (not out or out[-1].text in _MODIFIERS):
                depth = 0
                while i < hi:
                    depth += {"<": 1, ">": -1}.get(tokens[i].text, 0)
                    i += 1
                    if not depth:
                        break
                continue
            out.append(tokens[i])
            i += 1
        return out

    def _names_type(i: int, start: int) -> bool:
        if i + 1 >= len(tokens) or not _is_name(tokens[i + 1].text) or i > start and tokens[i - 1].text in (".", "@"):
            return False
        if tokens[i].text != "record":
            return True
        return i + 2 < len(tokens) and tokens[i + 2].text in ("(", "<")

    def declare_type(i: int, start: int, hi: int, scope: str, out: list[Declaration]) -> int:
        kind, ident = _TYPES[tokens[i].text], tokens[i + 1].text
        name = f"{scope}.{ident}" if scope else ident
        j = i + 2
        while j < hi and tokens[j].text not in ("{", ";"):
            j = close[j] + 1 if tokens[j].text == "(" else j + 1
        if j >= hi or tokens[j].text == ";":
            return j + 1
        end = min(close[j], len(tokens) - 1)
        out.append(Declaration(_with_comments(tokens[start].line, comments), tokens[end].last, name, kind, body(j + 1, close[j], name, kind)))
        return close[j] + 1

    def method_end(j: int, hi: int) -> int | None:
        """The last token of a method whose parameters end before ``j``; None if this is no declaration."""
        while j < hi:
            text = tokens[j].text
            if text == "{":
                return min(close[j], len(tokens) - 1)
            if text == ";":
                return j
            if text == "default":  # a value of an annotation's member
                while j < hi and tokens[j].text != ";":
                    j = close.get(j, j) + 1
                return min(j, hi - 1)
            if not (_is_name(text) or text in (",", ".", "[", "]", "@", "<", ">", "?", "&")):
                return None
            j += 1
        return None

    return body(0, len(tokens), "", None)


_MODIFIERS = frozenset("public protected private static final abstract synchronized native strictfp default sealed transient volatile".split())


def _is_name(text: str) -> bool:
    return text[0].isidentifier() or text[0] == "$"


def _closing(tokens: list[_Token]) -> dict[int, int]:
    """The bracket that closes each opening one; what is never closed ends with the file."""
    out, stack = {}, []
    pairs = {"}": "{", ")": "(", "]": "["}
    for k, t in enumerate(tokens):
        if t.text in ("{", "(", "["):
            stack.append(k)
        elif t.text in pairs:
            for depth in range(len(stack) - 1, -1, -1):
                if tokens[stack[depth]].text == pairs[t.text]:
                    for open_ in stack[depth:]:
                        out[open_] = k
                    del stack[depth:]
                    break
    for open_ in stack:
        out[open_] = len(tokens)
    return out


LANGUAGES = {".py": python_declarations, ".java": java_declarations}
