"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                 output
    {% for x in list %} {% endfor %} loop; loop.index, loop.index0, loop.first, loop.last
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% set name = e %}               variable of the rendering
    {% generation %} {% endgeneration %}  marks what a model is trained on
    {# comment #}

A ``-`` inside a brace drops white space on that side.  Expressions have strings, whole numbers,
true, false, none, names, ``a.b`` and ``a['b']`` on mappings, ``== != < > <= >=``, ``in``, ``+``,
``~`` (join as text), ``not and or``, parentheses, and the filters given to ``compile_template``.
There are no calls and no access to attributes of Python objects, so a template can reach only
the values it is given.

A template is parsed to a tree, constants are folded and constant branches dropped, and every node
becomes a closure that yields ``(text, trained)`` pieces.  Loops take their list lazily with one
element of look-ahead, so a list of any length is rendered in the memory of a few elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

Piece = tuple[str, bool]
Renderer = Callable[[dict[str, Any], bool], Iterator[Piece]]


class TemplateError(ValueError):
    """The template is not well formed, or it asks for something that is not there."""


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    base: Any
    key: Any


class Apply(NamedTuple):
    """A pure function of the operands; ``lazy`` ones get closures and decide what to evaluate."""

    function: Callable
    operands: tuple
    lazy: bool = False


class Output(NamedTuple):
    value: Any


class Assign(NamedTuple):
    name: str
    value: Any


class Loop(NamedTuple):
    name: str
    items: Any
    body: list


class Branch(NamedTuple):
    test: Any
    then: list
    other: list


class Generation(NamedTuple):
    body: list


_TAG = re.compile(r"\{#.*?#\}|\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))", re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _equal(a, b):
    return a == b


def _add(a, b):
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


_COMPARE = {
    "==": _equal,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


class _Expression:
    """Recursive-descent parser of one expression; folds constants as it builds."""

    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(next((i, g) for i, g in enumerate(found.groups()) if g is not None))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 else None

    def accept(self, *words: str) -> str | None:
        word = self.peek()
        if word in words:
            self.at += 1
            return word
        return None

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise TemplateError(f"expected {word!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 2:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.accept("or"):
            node = fold(Apply(lambda a, b: a() or b(), (node, self.both()), True))
        return node

    def both(self):
        node = self.negated()
        while self.accept("and"):
            node = fold(Apply(lambda a, b: a() and b(), (node, self.negated()), True))
        return node

    def negated(self):
        if self.accept("not"):
            return fold(Apply(lambda a: not a, (self.negated(),)))
        node = self.joined()
        while word := self.accept(*_COMPARE):
            node = fold(Apply(_COMPARE[word], (node, self.joined())))
        return node

    def joined(self):
        node = self.filtered()
        while word := self.accept("+", "~"):
            function = _add if word == "+" else lambda a, b: _text(a) + _text(b)
            node = fold(Apply(function, (node, self.filtered())))
        return node

    def filtered(self):
        node = self.reached()
        while self.accept("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = fold(Apply(self.filters[name], (node,)))
        return node

    def reached(self):
        node = self.atom()
        while True:
            if self.accept("."):
                node = Item(node, Const(self.name()))
            elif self.accept("["):
                node = Item(node, self.either())
                self.expect("]")
            else:
                return node

    def atom(self):
        if self.accept("("):
            node = self.either()
            self.expect(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 0:
            return Const(int(word))
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == 2:
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[word]) if word in fixed else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def fold(node):
    """A node whose operands are all constants becomes a constant."""
    if isinstance(node, Apply) and all(isinstance(x, Const) for x in node.operands):
        values = [x.value for x in node.operands]
        return Const(node.function(*[lambda v=v: v for v in values] if node.lazy else values))
    return node


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]]):
        self.filters, self.parts, at, strip = filters, [], 0, False
        for tag in _TAG.finditer(source):
            text = source[at : tag.start()]
            text = text.lstrip() if strip else text
            self.parts.append(("text", text.rstrip() if tag[1] or tag[4] else text))
            if tag[2] is not None:
                self.parts.append(("output", tag[2]))
            elif tag[5] is not None:
                self.parts.append(("tag", tag[5].strip()))
            at, strip = tag.end(), bool(tag[3] or tag[6])
        self.parts.append(("text", source[at:].lstrip() if strip else source[at:]))
        self.at = 0

    def expression(self, source: str):
        return _Expression(source, self.filters).whole()

    def block(self, *ends: str) -> tuple[list, str]:
        nodes: list = []
        while self.at < len(self.parts):
            kind, body = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes += [Output(Const(body))] if body else []
            elif kind == "output":
                nodes.append(Output(self.expression(body)))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return merge(nodes), body
                nodes += self.tag(word, rest)
        if ends:
            raise TemplateError(f"missing {ends[-1]!r}")
        return merge(nodes), ""

    def tag(self, word: str, rest: str) -> list:
        if word == "generation":
            return [Generation(self.block("endgeneration")[0])]
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not found:
                raise TemplateError(f"can't read for {rest!r}")
            return [Loop(found[1], self.expression(found[2]), self.block("endfor")[0])]
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not name.strip().isidentifier():
                raise TemplateError(f"can't read set {rest!r}")
            return [Assign(name.strip(), self.expression(value))]
        if word == "if":
            return self.branch(rest)
        raise TemplateError(f"unknown tag {word!r}")

    def branch(self, test: str) -> list:
        then, end = self.block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        other = self.branch(rest) if word == "elif" else self.block("endif")[0] if word == "else" else []
        tested = self.expression(test)
        if isinstance(tested, Const):
            return then if tested.value else other
        return [Branch(tested, then, other)]


def merge(nodes: list) -> list:
    """Neighbouring constant outputs become one."""
    out: list = []
    for node in nodes:
        last = out[-1] if out else None
        if all(isinstance(x, Output) and isinstance(x.value, Const) for x in (node, last)):
            out[-1] = Output(Const(_text(last.value.value) + _text(node.value.value)))
        else:
            out.append(node)
    return out


def _value(node) -> Callable[[dict[str, Any]], Any]:
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        return lambda scope: scope.get(node.name)
    operands = [_value(x) for x in (node if isinstance(node, Item) else node.operands)]
    if isinstance(node, Item):

        def item(scope):
            base, key = operands[0](scope), operands[1](scope)
            if not isinstance(base, dict):
                raise TemplateError(f"{key!r} is asked of something that is no mapping")
            return base.get(key)

        return item
    if node.lazy:
        return lambda scope: node.function(*[lambda f=f: f(scope) for f in operands])
    return lambda scope: node.function(*[f(scope) for f in operands])


def _looked_ahead(items: Iterable) -> Iterator[tuple[Any, bool]]:
    items = iter(items)
    held = next(items, items)
    while held is not items:
        following = next(items, items)
        yield held, following is items
        held = following


def _render(nodes: list) -> Renderer:
    steps = [_node(n) for n in nodes]

    def run(scope, trained):
        for step in steps:
            yield from step(scope, trained)

    return run


def _node(node) -> Renderer:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            constant = _text(node.value.value)
            return lambda scope, trained: iter(((constant, trained),))
        value = _value(node.value)
        return lambda scope, trained: iter(((_text(value(scope)), trained),))
    if isinstance(node, Generation):
        inside = _render(node.body)
        return lambda scope, trained: inside(scope, True)
    if isinstance(node, Assign):
        assigned = _value(node.value)

        def assign(scope, trained):
            scope[node.name] = assigned(scope)
            return iter(())

        return assign
    if isinstance(node, Branch):
        test, then, other = _value(node.test), _render(node.then), _render(node.other)
        return lambda scope, trained: (then if test(scope) else other)(scope, trained)
    items, body = _value(node.items), _render(node.body)

    def loop(scope, trained):
        for i, (item, last) in enumerate(_looked_ahead(items(scope) or ())):
            scope[node.name] = item
            scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": last}
            yield from body(scope, trained)

    return loop


def parse(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> list:
    parser = _Parser(source, filters or {})
    return parser.block()[0]


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[..., Iterator[Piece]]:
    """Function of the template's variables that yields (text, trained) pieces."""
    run = _render(parse(source, filters))
    return lambda **scope: run(scope, False)
