"""A small sandboxed template language for chat formats, compiled to Python closures.

Source text is parsed into a syntax tree, constant parts are folded, and each node becomes a closure that yields
pieces (text, is_generation). Templates see only the values they are given, mappings by key, and the filters passed
to ``compile_template``: there are no calls, no attributes of Python objects and no imports.

    {{ expr }}   {% set x = expr %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% for x in e %} .. {% endfor %} with loop.index0, loop.index, loop.first
    {% generation %} .. {% endgeneration %} marks what a model is to learn
    {# comment #};  a minus sign inside a tag ({%- -%}) strips white space on that side

Expressions: strings, integers, true/false/none, names, x.key, x['key'], filters (x | name), not/and/or, == != in,
+ and ~ for joining, a if c else b, parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~|.()\[\]=,]))")
TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template is malformed, or asks for what the sandbox lacks."""


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Get:
    of: object
    key: object


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Print:
    expr: object


@dataclass
class Set:
    name: str
    expr: object


@dataclass
class If:
    cond: object
    then: list
    other: list


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Generation:
    body: list


@dataclass
class Template:
    tree: list
    run: Callable = field(repr=False)

    def pieces(self, **values) -> Iterator[tuple[str, bool]]:
        """Rendered pieces in order, each with whether it lies in a generation block."""
        yield from self.run(dict(values), False)

    def render(self, **values) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of it (in code points) that lie in generation blocks."""
        out, spans, at = [], [], 0
        for text, learn in self.pieces(**values):
            if learn and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


# -- parsing


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.toks, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self) -> tuple:
        return self.toks[self.i] if self.i < len(self.toks) else (None, None)

    def take(self, value: str | None = None) -> tuple:
        tok = self.peek()
        if tok[0] is None or value is not None and tok[1] != value:
            raise TemplateError(f"expected {value or 'more'}, got {tok[1]!r}")
        self.i += 1
        return tok

    def on(self, *values: str) -> bool:
        return self.peek()[0] in ("op", "name") and self.peek()[1] in values

    def whole(self):
        e = self.ternary()
        if self.i < len(self.toks):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def ternary(self):
        e = self.either()
        if self.on("if"):
            self.take()
            cond = self.either()
            self.take("else")
            e = Op("?", [cond, e, self.ternary()])
        return e

    def either(self):
        e = self.both()
        while self.on("or"):
            self.take()
            e = Op("or", [e, self.both()])
        return e

    def both(self):
        e = self.negated()
        while self.on("and"):
            self.take()
            e = Op("and", [e, self.negated()])
        return e

    def negated(self):
        if self.on("not"):
            self.take()
            return Op("not", [self.negated()])
        return self.compared()

    def compared(self):
        e = self.joined()
        if self.on("==", "!=", "in"):
            return Op(self.take()[1], [e, self.joined()])
        return e

    def joined(self):
        e = self.filtered()
        while self.on("+", "~"):
            e = Op(self.take()[1], [e, self.filtered()])
        return e

    def filtered(self):
        e = self.atom()
        while self.on("|", ".", "["):
            op = self.take()[1]
            if op == "|":
                e = Filter(self.take()[1], e)
            elif op == ".":
                e = Get(e, Const(self.take()[1]))
            else:
                e = Get(e, self.ternary())
                self.take("]")
        return e

    def atom(self):
        kind, text = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name":
            return Const(WORDS[text]) if text in WORDS else Name(text)
        if text == "(":
            e = self.ternary()
            self.take(")")
            return e
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts, at, strip = [], 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        if m[0][2:3] == "-":
            text = text.rstrip()
        strip, at = m[0][-3:-2] == "-", m.end()
        if text:
            parts.append(("text", text))
        if m[1] is not None:
            parts.append(("print", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
    rest = source[at:].lstrip() if strip else source[at:]
    if rest:
        parts.append(("text", rest))
    tree, i, end = _block(parts, 0, ())
    if i < len(parts):
        raise TemplateError(f"unexpected {end}")
    return tree


def _block(parts: list, i: int, until: tuple) -> tuple[list, int, str]:
    out = []
    while i < len(parts):
        kind, text = parts[i]
        word = text.split(None, 1)[0] if kind == "tag" and text else ""
        if kind == "text":
            out.append(Print(Const(text)))
        elif kind == "print":
            out.append(Print(_Expr(text).whole()))
        elif word in until:
            return out, i, text
        elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(.*)", text, re.S)):
            out.append(Set(m[1], _Expr(m[2]).whole()))
        elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s(.*)", text, re.S)):
            body, i, _ = _block(parts, i + 1, ("endfor",))
            out.append(For(m[1], _Expr(m[2]).whole(), body))
        elif word == "generation":
            body, i, _ = _block(parts, i + 1, ("endgeneration",))
            out.append(Generation(body))
        elif word == "if":
            node, i = _if(parts, i, text[2:])
            out.append(node)
        else:
            raise TemplateError(f"unexpected tag {text!r}")
        i += 1
    if until:
        raise TemplateError(f"missing {until[-1]}")
    return out, i, ""


def _if(parts: list, i: int, cond: str) -> tuple[If, int]:
    then, i, tag = _block(parts, i + 1, ("elif", "else", "endif"))
    if tag.startswith("elif"):
        inner, i = _if(parts, i, tag[4:])
        return If(_Expr(cond).whole(), then, [inner]), i
    other = []
    if tag.startswith("else"):
        other, i, _ = _block(parts, i + 1, ("endif",))
    return If(_Expr(cond).whole(), then, other), i


# -- folding


def fold(node, filters: dict[str, Callable]):
    """The node with its constant parts computed; blocks lose branches that can't be reached and join their texts."""
    if isinstance(node, list):
        out = []
        for x in (y for n in node for y in _flat(fold(n, filters))):
            if isinstance(x, Print) and isinstance(x.expr, Const):
                text = _text(x.expr.value)
                if out and isinstance(out[-1], Print) and isinstance(out[-1].expr, Const):
                    out[-1] = Print(Const(out[-1].expr.value + text))
                elif text:
                    out.append(Print(Const(text)))
            else:
                out.append(x)
        return out
    if isinstance(node, Op):
        args = [fold(x, filters) for x in node.args]
        if all(isinstance(x, Const) for x in args):
            return Const(_OPS[node.op](*(lambda v=x.value: v for x in args)))
        if node.op == "?" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of, filters)
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Get):
        return Get(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Print):
        return Print(fold(node.expr, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr, filters))
    if isinstance(node, If):
        cond = fold(node.cond, filters)
        if isinstance(cond, Const):
            return fold(node.then if cond.value else node.other, filters)
        return If(cond, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _flat(x) -> list:
    return x if isinstance(x, list) else [x]


def _text(value) -> str:
    return "" if value is None else str(value)


def _in(a, b):
    a, b = a(), b()
    return b is not None and a in b


_OPS = {
    "+": lambda a, b: (lambda x, y: x + y if isinstance(x, int) and isinstance(y, int) else _text(x) + _text(y))(a(), b()),
    "~": lambda a, b: _text(a()) + _text(b()),
    "==": lambda a, b: a() == b(),
    "!=": lambda a, b: a() != b(),
    "in": _in,
    "and": lambda a, b: a() and b(),
    "or": lambda a, b: a() or b(),
    "not": lambda a: not a(),
    "?": lambda c, a, b: a() if c() else b(),
}


# -- compiling


def _expr(node, filters: dict[str, Callable]) -> Callable:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Get):
        of, key = _expr(node.of, filters), _expr(node.key, filters)

        def get(env):
            box = of(env)
            return box.get(key(env)) if isinstance(box, dict) else None

        return get
    if isinstance(node, Filter):
        of, f = _expr(node.of, filters), filters[node.name]
        return lambda env: f(of(env))
    op, args = _OPS[node.op], [_expr(x, filters) for x in node.args]
    return lambda env: op(*((lambda a=a: a(env)) for a in args))


def _body(nodes: list, filters: dict[str, Callable]) -> Callable:
    runs = [_statement(x, filters) for x in nodes]

    def run(env, learn):
        for r in runs:
            yield from r(env, learn)

    return run


def _statement(node, filters: dict[str, Callable]) -> Callable:
    if isinstance(node, Print):
        e = _expr(node.expr, filters)

        def show(env, learn):
            yield _text(e(env)), learn

        return show
    if isinstance(node, Set):
        e, name = _expr(node.expr, filters), node.name

        def put(env, learn):
            env[name] = e(env)
            yield from ()

        return put
    if isinstance(node, If):
        cond, then, other = _expr(node.cond, filters), _body(node.then, filters), _body(node.other, filters)
        return lambda env, learn: (then if cond(env) else other)(env, learn)
    if isinstance(node, Generation):
        inner = _body(node.body, filters)
        return lambda env, learn: inner(env, True)
    over, inner, name = _expr(node.over, filters), _body(node.body, filters), node.name

    def loop(env, learn):
        for i, x in enumerate(over(env) or ()):
            yield from inner({**env, name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, learn)

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Template:
    """Parse, fold and compile a template."""
    filters = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x or ())} | (filters or {})
    tree = fold(parse(source), filters)
    return Template(tree, _body(tree, filters))
