"""A sandboxed template language compiled to Python closures.

    {{ expression }}                       output
    {% for name in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   marks what a model is to produce
    {# comment #}

Expressions have strings, integers, true, false, none, names, ``a.b`` and
``a['b']`` on mappings, ``loop.first``, ``loop.last``, ``loop.index0``, ``==``,
``!=``, ``in``, ``not``, ``and``, ``or``, ``~`` and ``+`` (join), and filters
``a | name``.  There are no calls and no Python attributes: a template reaches
nothing but its variables and the filters that it is given.

``parse`` builds the syntax tree, ``fold`` computes what is constant (constant
output merges into text, constant conditions choose their branch), and
``compile_template`` makes closures that yield (text, generated) pieces, so a
long conversation is rendered piece by piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, NamedTuple

Piece = tuple[str, bool]
Filters = Mapping[str, Callable[[Any], Any]]


class TemplateError(ValueError):
    """The template, or what it asks of its variables, is not allowed."""


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Apply(NamedTuple):
    filter: str
    of: Any


class Unary(NamedTuple):
    of: Any


class Binary(NamedTuple):
    op: str
    left: Any
    right: Any


class Text(NamedTuple):
    text: str


class Output(NamedTuple):
    of: Any


class Assign(NamedTuple):
    name: str
    of: Any


class For(NamedTuple):
    name: str
    over: Any
    body: tuple


class If(NamedTuple):
    branches: tuple  # (condition, body) pairs; the last condition may be Const(True)


class Generation(NamedTuple):
    body: tuple


# --- parsing ---------------------------------------------------------------

_PARTS = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|~+()\[\]=]))")
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in {source!r}")
        text, number, word, sign = m.groups()
        if text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), text[1:-1])))
        elif number is not None:
            out.append(("const", int(number)))
        elif word in _WORDS:
            out.append(("const", _WORDS[word]))
        else:
            out.append(("word", word) if word is not None else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.at = tokens, 0

    def peek(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "const" and value in wanted:
                return value
        return None

    def take(self, *wanted: str) -> str | None:
        found = self.peek(*wanted)
        self.at += found is not None
        return found

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def whole(self) -> Any:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError("text after the expression")
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.joined()
        while op := self.take("==", "!=", "in"):
            node = Binary(op, node, self.joined())
        return node

    def joined(self) -> Any:
        node = self.filtered()
        while self.take("~", "+"):
            node = Binary("~", node, self.filtered())
        return node

    def filtered(self) -> Any:
        node = self.single()
        while True:
            if self.take("."):
                node = Item(node, Const(self.word()))
            elif self.take("["):
                node = Item(node, self.either())
                self.need("]")
            elif self.take("|"):
                node = Apply(self.word(), node)
            else:
                return node

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is expected")

    def single(self) -> Any:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.word())


def _expression(source: str) -> Any:
    return _Expression(_tokens(source)).whole()


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in _PARTS.finditer(source):
        parts += [source[at : m.start()], m[0]]
        at = m.end()
    parts.append(source[at:])
    body, rest = _body(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {parts[rest]}")
    return body


def _body(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    """Nodes up to a block that begins with one of ``ends``, and its place."""
    nodes: list[Any] = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{") and at % 2:
            nodes.append(Output(_expression(part[2:-2])))
        elif part.startswith("{%") and at % 2:
            inside = part[2:-2].strip()
            word, _, rest = inside.partition(" ")
            if word in ends:
                return tuple(nodes), at
            node, at = _block(parts, at, word, rest)
            nodes.append(node)
        elif not (part.startswith("{#") and at % 2) and part:
            nodes.append(Text(part))
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), at


def _block(parts: list[str], at: int, word: str, rest: str) -> tuple[Any, int]:
    if word == "for":
        name, sign, over = rest.partition(" in ")
        if not sign or not name.strip().isidentifier():
            raise TemplateError(f"cannot read for {rest}")
        body, at = _body(parts, at + 1, ("endfor",))
        return For(name.strip(), _expression(over), body), at
    if word == "generation":
        body, at = _body(parts, at + 1, ("endgeneration",))
        return Generation(body), at
    if word == "set":
        name, sign, value = rest.partition("=")
        if not sign or not name.strip().isidentifier():
            raise TemplateError(f"cannot read set {rest}")
        return Assign(name.strip(), _expression(value)), at
    if word == "if":
        branches, condition = [], _expression(rest)
        while True:
            body, at = _body(parts, at + 1, ("elif", "else", "endif"))
            branches.append((condition, body))
            word, _, rest = parts[at][2:-2].strip().partition(" ")
            if word == "endif":
                return If(tuple(branches)), at
            condition = _expression(rest) if word == "elif" else Const(True)
    raise TemplateError(f"unknown block {word}")


# --- constants -------------------------------------------------------------


def fold(body: tuple, filters: Filters) -> tuple:
    """The tree with constant expressions computed and neighbouring text merged."""
    out: list[Any] = []
    for node in body:
        for new in _folded(node, filters):
            if isinstance(new, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + new.text)
            elif new != Text(""):
                out.append(new)
    return tuple(out)


def _folded(node: Any, filters: Filters) -> tuple:
    match node:
        case Output(of):
            value = _constant(of, filters)
            return (Text(_string(value.value)),) if isinstance(value, Const) else (Output(value),)
        case Assign(name, of):
            return (Assign(name, _constant(of, filters)),)
        case For(name, over, inner):
            return (For(name, _constant(over, filters), fold(inner, filters)),)
        case Generation(inner):
            inner = fold(inner, filters)
            return (Generation(inner),) if inner else ()
        case If(branches):
            kept = []
            for condition, inner in branches:
                condition = _constant(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                kept.append((condition, fold(inner, filters)))
                if isinstance(condition, Const):
                    break
            if kept and isinstance(kept[0][0], Const):
                return kept[0][1]
            return (If(tuple(kept)),) if kept else ()
    return (node,)


def _constant(node: Any, filters: Filters) -> Any:
    match node:
        case Item(of, key):
            node = Item(_constant(of, filters), _constant(key, filters))
            parts = node
        case Apply(name, of):
            node = Apply(name, _constant(of, filters))
            parts = (node.of,)
        case Unary(of):
            node = Unary(_constant(of, filters))
            parts = node
        case Binary(op, left, right):
            node = Binary(op, _constant(left, filters), _constant(right, filters))
            parts = node[1:]
        case _:
            return node
    return Const(_evaluator(node, filters)({})) if all(isinstance(p, Const) for p in parts) else node


# --- closures --------------------------------------------------------------


def _string(value: Any) -> str:
    return "" if value is None else str(value)


def _evaluator(node: Any, filters: Filters) -> Callable[[dict], Any]:
    match node:
        case Const(value):
            return lambda scope: value
        case Name(name):
            return lambda scope: scope.get(name)
        case Item(of, key):
            of, key = _evaluator(of, filters), _evaluator(key, filters)

            def item(scope: dict) -> Any:
                held = of(scope)
                if held is None:
                    return None
                if not isinstance(held, dict):
                    raise TemplateError("only mappings have items")
                return held.get(key(scope))

            return item
        case Apply(name, of):
            if name not in filters:
                raise TemplateError(f"unknown filter {name}")
            of, function = _evaluator(of, filters), filters[name]
            return lambda scope: function(of(scope))
        case Unary(of):
            of = _evaluator(of, filters)
            return lambda scope: not of(scope)
        case Binary(op, left, right):
            left, right = _evaluator(left, filters), _evaluator(right, filters)
            if op == "and":
                return lambda scope: left(scope) and right(scope)
            if op == "or":
                return lambda scope: left(scope) or right(scope)
            if op == "==":
                return lambda scope: left(scope) == right(scope)
            if op == "!=":
                return lambda scope: left(scope) != right(scope)
            if op == "in":
                return lambda scope: _string(left(scope)) in _string(right(scope))
            return lambda scope: _string(left(scope)) + _string(right(scope))
    raise TemplateError(f"unknown expression {node!r}")


Renderer = Callable[[dict, bool], Iterator[Piece]]


def _renderer(node: Any, filters: Filters) -> Renderer:
    match node:
        case Text(text):

            def render(scope: dict, marked: bool) -> Iterator[Piece]:
                yield text, marked

        case Output(of):
            value = _evaluator(of, filters)

            def render(scope: dict, marked: bool) -> Iterator[Piece]:
                yield _string(value(scope)), marked

        case Assign(name, of):
            value = _evaluator(of, filters)

            def render(scope: dict, marked: bool) -> Iterator[Piece]:
                scope[name] = value(scope)
                yield from ()

        case Generation(body):
            inner = _sequence(body, filters)

            def render(scope: dict, marked: bool) -> Iterator[Piece]:
                yield from inner(scope, True)

        case If(branches):
            pairs = [(_evaluator(c, filters), _sequence(b, filters)) for c, b in branches]

            def render(scope: dict, marked: bool) -> Iterator[Piece]:
                for condition, inner in pairs:
                    if condition(scope):
                        yield from inner(scope, marked)
                        return

        case For(name, over, body):
            value, inner = _evaluator(over, filters), _sequence(body, filters)

            def render(scope: dict, marked: bool) -> Iterator[Piece]:
                for index, (item, last) in enumerate(_with_last(value(scope) or ())):
                    loop = {"first": index == 0, "last": last, "index0": index}
                    yield from inner({**scope, name: item, "loop": loop}, marked)

        case _:
            raise TemplateError(f"unknown node {node!r}")
    return render


def _with_last(items: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    held, some = None, False
    for item in items:
        if some:
            yield held, False
        held, some = item, True
    if some:
        yield held, True


def _sequence(body: tuple, filters: Filters) -> Renderer:
    parts = [_renderer(node, filters) for node in body]

    def render(scope: dict, marked: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope, marked)

    return render


def compile_template(source: str, filters: Filters | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the variables that yields (text, generated) pieces.

    A variable may be any iterable: it is read once and piece by piece."""
    filters = dict(filters or {})
    run = _sequence(fold(parse(source), filters), filters)
    return lambda **variables: run(dict(variables), False)
