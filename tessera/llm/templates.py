"""A small template language, compiled to Python closures (operator 13).

A template is parsed to a syntax tree, constants are folded and neighbouring
texts joined, and each node becomes a closure. Rendering is lazy: a template
yields pieces (text, whether it stands between generation markers), and a loop
takes one item after another, so output of any length needs little memory.

    text                              as it stands
    {{ expression }}                  its value; none gives nothing
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% else %} {% endfor %}    with loop.index, loop.index0, loop.first, loop.last, loop.previtem, loop.nextitem
    {% set name = e %}
    {% generation %} {% endgeneration %}        the text between is what a model is to learn
    {# remark #}                      and a '-' inside a tag's ends takes the white space beside it

Expressions have strings, numbers, true, false, none, lists, names, ``a.b``,
``a[b]``, ``+ - * // % ~``, comparisons, ``in``, ``not``, ``and``, ``or``,
``x if c else y``, ``x is defined`` / ``none`` / ``string`` and filters
(``x | upper``).

The language is a sandbox: names come from the given values alone, ``.`` and
``[]`` read keys of dicts and items of lists and nothing else of an object,
the only calls are the listed filters, and a template's length, depth and
numbers are bounded. Nothing is evaluated as Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

MAX_SOURCE, MAX_DEPTH, MAX_NUMBER, MAX_STRING = 1 << 16, 32, 1 << 53, 1 << 20


class TemplateError(ValueError):
    """What is wrong with a template or its values."""


# the tree: expressions

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


# statements; a body is a tuple of them

@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple
    empty: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


class Undefined:
    """The value of a name or key that isn't there; it may be tested, not used."""


UNDEFINED = Undefined()
#: The words that expressions give a meaning of their own.
RESERVED = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none"}

_TAG = re.compile(r"\{#-?.*?-?#\}|\{\{-?|\{%-?", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
                        |(?P<sign>-?\}\}|-?%\}|//|==|!=|<=|>=|[-+*%~<>()\[\],.|=]))""", re.X | re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _lex(source: str) -> Iterator[tuple[str, object]]:
    """(kind, value): text, open ({{ or {%), close, number, name, string and sign."""
    at, strip = 0, False
    while at < len(source):
        tag = _TAG.search(source, at)
        text = source[at:tag.start() if tag else len(source)]
        text = text.lstrip() if strip else text
        if tag and tag.group()[2:3] == "-":
            text = text.rstrip()
        if text:
            yield "text", text
        if not tag:
            return
        at, strip = tag.end(), tag.group().endswith("-#}")
        if tag.group().startswith("{#"):
            continue
        opened = tag.group()[:2]
        yield "open", opened
        while True:
            token = _TOKEN.match(source, at)
            if not token:
                raise TemplateError(f"not understood: {source[at:at + 20]!r}")
            at = token.end()
            kind, value = token.lastgroup, token.group(token.lastgroup)
            if kind == "sign" and value[-1] == "}":
                if value.lstrip("-") != {"{{": "}}", "{%": "%}"}[opened]:
                    raise TemplateError(f"{opened} is closed by {value}")
                strip = value[0] == "-"
                yield "close", value
                break
            if kind == "number":
                if int(value) > MAX_NUMBER:
                    raise TemplateError("a number is too large")
                value = int(value)
            elif kind == "string":
                value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S)
            yield kind, value


class _Parser:
    """Recursive descent over the tokens."""

    def __init__(self, source: str) -> None:
        if len(source) > MAX_SOURCE:
            raise TemplateError(f"a template has at most {MAX_SOURCE} characters")
        self.tokens, self.at, self.depth = [*_lex(source), ("end", "")], 0, 0

    def peek(self, *wanted: object) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("sign", "name", "close") and value in wanted

    def take(self, *wanted: object) -> object:
        kind, value = self.tokens[self.at]
        if wanted and not self.peek(*wanted):
            raise TemplateError(f"{' or '.join(map(str, wanted))} expected, not {value!r}")
        self.at += 1
        return value

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name" or value in RESERVED or value.startswith("_"):
            raise TemplateError(f"not a name: {value!r}")
        self.at += 1
        return value

    def close(self) -> None:
        self.take("%}", "-%}")

    def nested(self, part: Callable) -> object:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError(f"nested more than {MAX_DEPTH} deep")
        got = part()
        self.depth -= 1
        return got

    def body(self, *ends: str) -> tuple[tuple, str]:
        """The statements up to a tag of ``ends``, and that tag's word."""
        out: list = []
        while True:
            kind, value = self.tokens[self.at]
            if kind == "end":
                if "" in ends:
                    return tuple(out), ""
                raise TemplateError(f"{ends[-1]} is missing")
            self.at += 1
            if kind == "text":
                out.append(Out(Const(value)))
            elif value == "{{":
                out.append(Out(self.expression()))
                self.take("}}", "-}}")
            else:
                word = self.take()
                if word in ends:
                    return tuple(out), word
                out.append(self.nested(lambda word=word: self.statement(word)))

    def statement(self, word: object) -> object:
        if word == "if":
            return self.branch()
        if word == "for":
            name = self.name()
            self.take("in")
            over = self.expression()
            self.close()
            body, end = self.body("else", "endfor")
            self.close()
            empty = ()
            if end == "else":
                empty, _ = self.body("endfor")
                self.close()
            return For(name, over, body, empty)
        if word == "set":
            name = self.name()
            self.take("=")
            value = self.expression()
            self.close()
            return Set(name, value)
        if word == "generation":
            self.close()
            body, _ = self.body("endgeneration")
            self.close()
            return Generation(body)
        raise TemplateError(f"unknown tag {word!r}")

    def branch(self) -> If:
        test = self.expression()
        self.close()
        then, end = self.body("elif", "else", "endif")
        if end == "elif":
            return If(test, then, (self.nested(self.branch),))
        self.close()
        other = ()
        if end == "else":
            other, _ = self.body("endif")
            self.close()
        return If(test, then, other)

    def expression(self) -> object:
        return self.nested(self.choice)

    def choice(self) -> object:
        value = self.either()
        if not self.peek("if"):
            return value
        self.take()
        test = self.either()
        self.take("else")
        return Op("?", (test, value, self.expression()))

    def either(self) -> object:
        left = self.both()
        while self.peek("or"):
            self.take()
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> object:
        left = self.negated()
        while self.peek("and"):
            self.take()
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> object:
        if self.peek("not"):
            self.take()
            return Op("not", (self.nested(self.negated),))
        return self.compared()

    def compared(self) -> object:
        left = self.added()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"):
            sign = self.take()
            if sign == "is":
                no = self.peek("not") and bool(self.take())
                kind = self.take("defined", "none", "string")
                left = Op("is " + kind, (left,))
                left = Op("not", (left,)) if no else left
            elif sign == "not":
                self.take("in")
                left = Op("not", (Op("in", (left, self.added())),))
            else:
                left = Op(sign, (left, self.added()))
        return left

    def added(self) -> object:
        left = self.multiplied()
        while self.peek("+", "-", "~"):
            left = Op(self.take(), (left, self.multiplied()))
        return left

    def multiplied(self) -> object:
        left = self.filtered()
        while self.peek("*", "//", "%"):
            left = Op(self.take(), (left, self.filtered()))
        return left

    def filtered(self) -> object:
        value = self.nested(self.single)
        while self.peek("|", ".", "["):
            sign = self.take()
            if sign == ".":
                value = Get(value, Const(self.name()))
            elif sign == "[":
                value = Get(value, self.expression())
                self.take("]")
            else:
                name, args = self.name(), [value]
                if self.peek("("):
                    self.take()
                    args += self.listed(")")
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                value = Filter(name, tuple(args))
        return value

    def listed(self, end: str) -> list:
        items: list = []
        while not self.peek(end):
            items.append(self.expression())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return items

    def single(self) -> object:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("number", "string"):
            return Const(value)
        if kind == "sign" and value == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "sign" and value == "[":
            return ListOf(tuple(self.listed("]")))
        if kind == "sign" and value == "-":
            return Op("-", (Const(0), self.nested(self.filtered)))
        if kind == "name" and value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        if kind == "name" and value not in RESERVED and not value.startswith("_"):
            return Name(value)
        raise TemplateError(f"a value expected, not {value!r}")


def parse(source: str) -> tuple:
    """The statements of a template."""
    return _Parser(source).body("")[0]


# values

def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError(f"no text: {type(value).__name__.lower()}")


def _number(value: object) -> object:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or abs(value) > MAX_NUMBER:
        raise TemplateError(f"no number of fitting size: {value!r:.40}")
    return value


def _plus(a: object, b: object) -> object:
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(_number(a) + _number(b))


def _known(value: object) -> object:
    if isinstance(value, Undefined):
        raise TemplateError("an undefined value is used")
    return value


def _within(a: object, b: object) -> bool:
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    if isinstance(b, (list, tuple, dict)):
        return a in b
    raise TemplateError("'in' needs a text, a list or a dict")


def _whole(a: object, b: object, sign: str) -> object:
    if _number(b) == 0:
        raise TemplateError("division by zero")
    return _number(a) // b if sign == "//" else _number(a) % b


def _ordered(a: object, b: object) -> None:
    if not (isinstance(a, str) and isinstance(b, str)):
        _number(a), _number(b)


def _compare(sign: str) -> Callable:
    signs = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

    def run(a: object, b: object) -> bool:
        _ordered(a, b)
        return signs[sign](a, b)

    return run


OPERATIONS: dict[str, Callable] = {
    "+": _plus, "-": lambda a, b: _number(_number(a) - _number(b)), "*": lambda a, b: _number(_number(a) * _number(b)),
    "//": lambda a, b: _whole(a, b, "//"), "%": lambda a, b: _whole(a, b, "%"), "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _within, **{s: _compare(s) for s in ("<", "<=", ">", ">=")}}


def _replaced(value: object, old: object, new: object) -> str:
    return _text(value).replace(_text(old), _text(new))


FILTERS: dict[str, Callable] = {
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "trim": lambda v: _text(v).strip(),
    "title": lambda v: _text(v)[:1].upper() + _text(v)[1:], "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else _number(None),
    "string": _text, "replace": _replaced, "default": lambda v, other: v, "escape": lambda v, *controls: escape(_text(v), tuple(map(_text, controls)))}


# control strings inside texts

def escape(text: str, controls: tuple[str, ...]) -> str:
    """``text`` with a backslash before each backslash and each control string, so that none of the latter stands there bare.

    Control strings must not begin inside one another. ``unescape`` takes it back.
    """
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    for control in controls:
        if control in text:
            text = text.replace(control, "\\" + control)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# constant folding

def fold(node: object) -> object:
    """The tree with constant expressions computed, branches on constants decided and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for one in map(fold, node):
            for part in one if isinstance(one, tuple) else (one,):
                if isinstance(part, Out) and isinstance(part.value, Const):
                    text = _text(part.value.value)
                    if not text:
                        continue
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(out[-1].value.value + text))
                        continue
                    part = Out(Const(text))
                out.append(part)
        return tuple(out)
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body), fold(node.empty))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Get):
        return Get(fold(node.of), fold(node.key))
    if isinstance(node, ListOf):
        return ListOf(tuple(map(fold, node.items)))
    if isinstance(node, (Op, Filter)):
        args = tuple(map(fold, node.args))
        again = type(node)(node.sign if isinstance(node, Op) else node.name, args)
        if isinstance(node, Op) and node.sign in ("and", "or", "?") and isinstance(args[0], Const):
            if node.sign == "?":
                return args[1] if args[0].value else args[2]
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        if all(isinstance(a, Const) for a in args):
            try:
                value = _value(again)({})
            except TemplateError:
                return again  # an error where it is reached, if it is
            if not isinstance(value, str) or len(value) <= MAX_STRING:
                return Const(value)
        return again
    return node


# closures

def _value(node: object) -> Callable[[dict], object]:
    """A closure that gives an expression's value from the names' values."""
    if isinstance(node, Const):
        constant = node.value
        return lambda names: constant
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name, UNDEFINED)
    if isinstance(node, ListOf):
        items = [_value(i) for i in node.items]
        return lambda names: [_known(i(names)) for i in items]
    if isinstance(node, Get):
        of, key = _value(node.of), _value(node.key)

        def get(names: dict) -> object:
            holder, k = _known(of(names)), _known(key(names))
            if isinstance(holder, dict):
                return holder.get(k, UNDEFINED) if isinstance(k, (str, int)) else UNDEFINED
            if isinstance(holder, (list, tuple, str)) and isinstance(k, int) and -len(holder) <= k < len(holder):
                return holder[k]
            return UNDEFINED

        return get
    args = [_value(a) for a in node.args]
    if isinstance(node, Filter):
        run = FILTERS[node.name]
        if node.name == "default":
            first, other = args
            return lambda names: other(names) if isinstance(first(names), Undefined) else first(names)

        def filtered(names: dict) -> object:
            try:
                return run(*[_known(a(names)) for a in args])
            except TypeError as wrong:
                raise TemplateError(f"filter {node.name}: {wrong}") from None

        return filtered
    first = args[0]
    if node.sign == "not":
        return lambda names: not _known(first(names))
    if node.sign == "is defined":
        return lambda names: not isinstance(first(names), Undefined)
    if node.sign == "is none":
        return lambda names: first(names) is None
    if node.sign == "is string":
        return lambda names: isinstance(first(names), str)
    if node.sign == "and":
        return lambda names: _known(first(names)) and _known(args[1](names))
    if node.sign == "or":
        return lambda names: _known(first(names)) or _known(args[1](names))
    if node.sign == "?":
        return lambda names: args[1](names) if _known(first(names)) else args[2](names)
    run, second = OPERATIONS[node.sign], args[1]
    return lambda names: run(_known(first(names)), _known(second(names)))


Piece = tuple[str, bool]


def _body(nodes: tuple, learn: bool) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields a body's pieces; ``learn`` says whether it stands between generation markers."""
    steps = [_statement(n, learn) for n in nodes]

    def run(names: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(names)

    return run


def _statement(node: object, learn: bool) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            always = ((node.value.value, learn),)
            return lambda names: always
        value = _value(node.value)
        return lambda names: ((_text(_known(value(names))), learn),)
    if isinstance(node, If):
        test, then, other = _value(node.test), _body(node.then, learn), _body(node.other, learn)
        return lambda names: then(names) if _known(test(names)) else other(names)
    if isinstance(node, Generation):
        return _body(node.body, True)
    if isinstance(node, Set):
        value, name = _value(node.value), node.name

        def assign(names: dict) -> tuple:
            names[name] = _known(value(names))
            return ()

        return assign
    over, body, empty, name = _value(node.over), _body(node.body, learn), _body(node.empty, learn), node.name

    def loop(names: dict) -> Iterator[Piece]:
        items = _known(over(names))
        if not isinstance(items, (list, tuple, Iterator)):
            raise TemplateError("a loop needs a list")
        items, before, number = iter(items), UNDEFINED, 0
        item = next(items, UNDEFINED)
        if item is UNDEFINED:
            yield from empty(names)
        while item is not UNDEFINED:
            after = next(items, UNDEFINED)
            loop = {"index": number + 1, "index0": number, "first": number == 0, "last": after is UNDEFINED}
            if before is not UNDEFINED:
                loop["previtem"] = before
            if after is not UNDEFINED:
                loop["nextitem"] = after
            # what a round sets is forgotten with it
            yield from body({**names, name: item, "loop": loop})
            before, item, number = item, after, number + 1

    return loop


@dataclass
class Template:
    """A compiled template: ``pieces(**values)`` yields (text, learn), ``render(**values)`` gives the whole text."""

    source: str
    tree: tuple = field(init=False)

    def __post_init__(self) -> None:
        self.tree = fold(parse(self.source))
        self._run = _body(self.tree, False)

    def __reduce__(self):
        return Template, (self.source,)

    def pieces(self, **values: object) -> Iterator[Piece]:
        return self._run(dict(values))

    def render(self, **values: object) -> str:
        return "".join(text for text, _ in self.pieces(**values))
