"""A small sandboxed template language, compiled to Python closures.

    text            as it stands
    {{ expr }}      the value of an expression
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% for name in e %} .. {% endfor %}       loop.index, loop.first, loop.last
    {% set name = e %}
    {% generation %} .. {% endgeneration %}   output inside is marked (the loss mask)

Expressions have strings, integers, true/false/none, names, ``a.key`` and ``a[e]`` on mappings and lists,
``+`` (numbers or strings), ``~`` (strings), comparisons, ``and or not``, and the filters ``trim``,
``upper``, ``lower``, ``length`` and ``escape``.  There are no calls and no attribute access on Python
objects, so a template reaches nothing but its variables; nesting and output size are bounded.

Stages: tokens -> syntax tree (tuples) -> constant folding -> closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.\[\]()=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}
MAX_NESTING = 64


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- parsing


class _Expressions:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in tag: {source[at:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("str", "int", "name", "op"), m.groups()) if v is not None))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (want and self.tokens[self.at][1] != want):
            raise TemplateError(f"expected {want or 'more'} in tag")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in tag")

    def whole(self) -> tuple:
        tree = self.either()
        self.end()
        return tree

    def _binary(self, ops: tuple[str, ...], below: Callable) -> tuple:
        left = below()
        while self.peek() in ops:
            left = ("op", self.take()[1], left, below())
        return left

    def either(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_NESTING:
            raise TemplateError("expression is nested too deeply")
        tree = self._binary(("or",), lambda: self._binary(("and",), self.negated))
        self.depth -= 1
        return tree

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        return self._binary(("==", "!=", "<", "<=", ">", ">="), lambda: self._binary(("+", "~"), self.filtered))

    def filtered(self) -> tuple:
        tree = self.path()
        while self.peek() == "|":
            self.take()
            tree = ("filter", self.name(), tree)
        return tree

    def path(self) -> tuple:
        kind, value = self.take()
        if kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif kind == "int":
            tree = ("const", int(value))
        elif value == "(":
            tree = self.either()
            self.take(")")
        elif kind == "name":
            words = {"true": True, "false": False, "none": None}
            tree = ("const", words[value]) if value in words else ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r} in tag")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                tree = ("item", tree, ("const", self.name()))
            else:
                tree = ("item", tree, self.either())
                self.take("]")
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template: ('block', [nodes])."""
    pieces = _TAGS.split(source)
    at = 0

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str, _Expressions | None]:
        nonlocal at
        if depth > MAX_NESTING:
            raise TemplateError("blocks are nested too deeply")
        nodes = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{") and piece.endswith("}}"):
                nodes.append(("print", _Expressions(piece[2:-2]).whole()))
            elif piece.startswith("{%") and piece.endswith("%}"):
                tag = _Expressions(piece[2:-2])
                word = tag.name()
                if word in ends:
                    return ("block", nodes), word, tag
                if word == "if":
                    arms, test, otherwise = [], tag.whole(), ("block", [])
                    while True:
                        body, word, tag = block(("elif", "else", "endif"), depth + 1)
                        arms.append((test, body))
                        if word == "elif":
                            test = tag.whole()
                            continue
                        if word == "else":
                            tag.end()
                            otherwise, _, tag = block(("endif",), depth + 1)
                        tag.end()
                        break
                    nodes.append(("if", arms, otherwise))
                elif word == "for":
                    name = tag.name()
                    tag.take("in")
                    over = tag.whole()
                    body, _, _ = block(("endfor",), depth + 1)
                    nodes.append(("for", name, over, body))
                elif word == "set":
                    name = tag.name()
                    tag.take("=")
                    nodes.append(("set", name, tag.whole()))
                elif word == "generation":
                    tag.end()
                    body, _, _ = block(("endgeneration",), depth + 1)
                    nodes.append(("generation", body))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            elif piece:
                nodes.append(("text", piece))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return ("block", nodes), "", None

    return block((), 0)[0]


# ---------------------------------------------------------------- meaning of operators


def _text(value) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _plus(a, b):
    if isinstance(a, str) or isinstance(b, str):
        return _text(a) + _text(b)
    return (a or 0) + (b or 0)


def _item(value, key):
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _ordered(compare: Callable) -> Callable:
    def run(a, b):
        try:
            return compare(a, b)
        except TypeError:
            return False

    return run


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _plus, "~": lambda a, b: _text(a) + _text(b),
    "<": _ordered(lambda a, b: a < b), "<=": _ordered(lambda a, b: a <= b), ">": _ordered(lambda a, b: a > b), ">=": _ordered(lambda a, b: a >= b),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, Mapping)) else 0,
}


# ---------------------------------------------------------------- folding


def fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Constant expressions become constants, constant output becomes text, dead branches go, texts join."""
    kind = tree[0]
    if kind == "op":
        _, op, a, b = tree
        a, b = fold(a, filters), fold(b, filters)
        if op in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (op == "and") else a
        if a[0] == b[0] == "const" and op in OPERATORS:
            return ("const", OPERATORS[op](a[1], b[1]))
        return ("op", op, a, b)
    if kind == "not":
        a = fold(tree[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(tree[2], filters)
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        return ("const", filters[tree[1]](a[1])) if a[0] == "const" else ("filter", tree[1], a)
    if kind == "item":
        a, k = fold(tree[1], filters), fold(tree[2], filters)
        return ("const", _item(a[1], k[1])) if a[0] == k[0] == "const" else ("item", a, k)
    if kind == "print":
        a = fold(tree[1], filters)
        return ("text", _text(a[1])) if a[0] == "const" else ("print", a)
    if kind == "if":
        arms, otherwise = [], fold(tree[2], filters)
        for test, body in tree[1]:
            test, body = fold(test, filters), fold(body, filters)
            if test[0] == "const":
                if test[1]:
                    otherwise = body
                    break
                continue
            arms.append((test, body))
        return ("if", arms, otherwise) if arms else otherwise
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "set":
        return ("set", tree[1], fold(tree[2], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "block":
        nodes: list[tuple] = []
        for node in (fold(n, filters) for n in tree[1]):
            for n in node[1] if node[0] == "block" else [node]:
                if n[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + n[1])
                elif n != ("text", ""):
                    nodes.append(n)
        return ("block", nodes)
    return tree


# ---------------------------------------------------------------- closures


class Output:
    """Rendered pieces, their length in code points, and the marked spans."""

    __slots__ = ("marks", "most", "pieces", "size")

    def __init__(self, most: int):
        self.pieces, self.size, self.marks, self.most = [], 0, [], most

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)
        if self.size > self.most:
            raise TemplateError("the output is larger than allowed")


def _value(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda scope: constant
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        of, key = _value(tree[1], filters), _value(tree[2], filters)
        return lambda scope: _item(of(scope), key(scope))
    if kind == "not":
        of = _value(tree[1], filters)
        return lambda scope: not of(scope)
    if kind == "filter":
        run, of = filters[tree[1]], _value(tree[2], filters)
        return lambda scope: run(of(scope))
    _, op, a, b = tree
    a, b = _value(a, filters), _value(b, filters)
    if op == "and":
        return lambda scope: a(scope) and b(scope)
    if op == "or":
        return lambda scope: a(scope) or b(scope)
    run = OPERATORS[op]
    return lambda scope: run(a(scope), b(scope))


def _action(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    kind = tree[0]
    if kind == "text":
        text = tree[1]
        return lambda scope, out: out.add(text)
    if kind == "print":
        of = _value(tree[1], filters)
        return lambda scope, out: out.add(_text(of(scope)))
    if kind == "set":
        name, of = tree[1], _value(tree[2], filters)

        def assign(scope, out):
            scope[name] = of(scope)

        return assign
    if kind == "if":
        arms = [(_value(t, filters), _action(b, filters)) for t, b in tree[1]]
        otherwise = _action(tree[2], filters)

        def choose(scope, out):
            for test, body in arms:
                if test(scope):
                    return body(scope, out)
            return otherwise(scope, out)

        return choose
    if kind == "for":
        name, of, body = tree[1], _value(tree[2], filters), _action(tree[3], filters)

        def loop(scope, out):
            items = of(scope)
            items = items if isinstance(items, (list, tuple)) else []
            inner = dict(scope)
            for i, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                body(inner, out)

        return loop
    if kind == "generation":
        body = _action(tree[1], filters)

        def mark(scope, out):
            start = out.size
            body(scope, out)
            out.marks.append((start, out.size))

        return mark
    actions = [_action(n, filters) for n in tree[1]]

    def run_all(scope, out):
        for action in actions:
            action(scope, out)

    return run_all


def compile_template(source: str, escape: Callable[[str], str] | None = None, most: int = 1 << 30) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """``render(**variables) -> (text, marked spans)``; ``escape`` is the filter of that name."""
    filters = FILTERS | {"escape": lambda v: (escape or (lambda s: s))(_text(v))}
    action = _action(fold(parse(source), filters), filters)

    def render(**variables):
        out = Output(most)
        action(dict(variables), out)
        return "".join(out.pieces), out.marks

    return render
