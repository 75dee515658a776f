"""A compiler for a small, sandboxed chat-template language.

Source is parsed to a syntax tree, constants are folded, and the tree becomes
nested Python closures that yield (text, generated) pieces. The language has
``{{ expression }}``, ``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = expression %}`` and ``{% generation %}`` (its text is what a model
would generate), with ``{%-``/``-%}`` to trim. Expressions: literals, names, ``a.b`` and
``a['b']`` on mappings and lists, ``not and or == != < > <= >= in + ~``,
``a if c else b`` and the filters below. There are no calls and no access to Python
attributes, and loops run over lists only, so a template can neither reach the
host nor run without end.

Control strings inside texts: the filter ``escape`` puts a backslash behind the
first character of each one and doubles backslashes; ``unescape`` undoes it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


class Escaper:
    """Breaks up control strings in a way that can be undone. A control string holds
    no backslash, has at least two characters and does not begin and end alike."""

    def __init__(self, control: Iterable[str]):
        self.control = tuple(control)
        for c in self.control:
            if len(c) < 2 or "\\" in c or any(c[:k] == c[-k:] for k in range(1, len(c))):
                raise TemplateError(f"{c!r} can't be a control string")
        found = "|".join(map(re.escape, sorted(self.control, key=len, reverse=True)))
        self.pattern = re.compile(rf"\\|(?=(?:{found}))." if found else r"\\", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


# --- source to tokens to tree: nodes are tuples (kind, ...)

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.,\[\]()=]))", re.DOTALL)
_CHAR = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none", "True", "False", "None"}
_CONST = {"true": True, "false": False, "none": None}


def _split(source: str) -> list[tuple[str, str]]:
    """(text | print | block, content) in order."""
    out, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        if m[1] or m[4]:
            text = text.rstrip()
        out.append(("text", text))
        if m[2] is not None:
            out.append(("print", m[2]))
        elif m[5] is not None:
            out.append(("block", m[5].strip()))
        trim, at = bool(m[3] or m[6]), m.end()
    out.append(("text", source[at:].lstrip() if trim else source[at:]))
    return [x for x in out if x != ("text", "")]


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else text

    def accept(self, *texts: str) -> str | None:
        if self.peek() in texts and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise TemplateError(f"{text!r} is missing")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or text in _WORDS:
            raise TemplateError(f"a name is missing before {text!r}")
        self.at += 1
        return text

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.accept("if"):
            test = self.either()
            self.expect("else")
            return ("if", test, node, self.choice())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.accept("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.accept("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.accept("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("op", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while op := self.accept("+", "~"):
            node = ("op", op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.accept("|"):
            node = ("filter", self.name(), node)
        return node

    def reached(self) -> tuple:
        node = self.atom()
        while True:
            if self.accept("."):
                node = ("get", node, ("const", self.name()))
            elif self.accept("["):
                node = ("get", node, self.choice())
                self.expect("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return ("const", int(text))
        if kind == "str":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _CHAR.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if self.accept("("):
            node = self.choice()
            self.expect(")")
            return node
        if text is not None and text.lower() in _CONST and text in _WORDS:
            self.at += 1
            return ("const", _CONST[text.lower()])
        return ("name", self.name())


def parse(source: str) -> tuple:
    """The syntax tree: ("seq", [nodes])."""
    parts = _split(source)
    at = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal at
        nodes = []
        while at < len(parts):
            kind, content = parts[at]
            at += 1
            if kind == "text":
                nodes.append(("text", content))
            elif kind == "print":
                nodes.append(("print", _Expression(content).whole()))
            else:
                word, _, rest = content.partition(" ")
                if word in ends:
                    return nodes, content
                nodes.append(block(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def block(word: str, rest: str) -> tuple:
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.expect("in")
            over = e.whole()
            inner, _ = body("endfor")
            return ("for", name, over, ("seq", inner))
        if word == "if":
            test = _Expression(rest).whole()
            then, end = body("elif", "else", "endif")
            if end.startswith("elif"):
                return ("cond", test, ("seq", then), block("if", end[5:]))
            other = body("endif")[0] if end == "else" else []
            return ("cond", test, ("seq", then), ("seq", other))
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.expect("=")
            return ("set", name, e.whole())
        if word == "generation":
            inner, _ = body("endgeneration")
            return ("generation", ("seq", inner))
        raise TemplateError(f"unknown block {word!r}")

    nodes, _ = body()
    return ("seq", nodes)


# --- the tree to closures

_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b),
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "seq":
        out: list[tuple] = []
        for n in (fold(n, filters) for n in node[1]):
            for m in n[1] if n[0] == "seq" else [n]:
                if m[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + m[1])
                elif m != ("text", ""):
                    out.append(m)
        return ("seq", out)
    if kind == "print":
        e = fold(node[1], filters)
        return ("text", _text(e[1])) if e[0] == "const" else ("print", e)
    if kind in ("cond", "if"):
        test, a, b = (fold(n, filters) for n in node[1:])
        return (a if test[1] else b) if test[0] == "const" else (kind, test, a, b)
    if kind in ("and", "or"):
        a, b = fold(node[1], filters), fold(node[2], filters)
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "filter" and node[1] not in filters:
        raise TemplateError(f"unknown filter {node[1]!r}")
    parts = [fold(n, filters) if isinstance(n, tuple) else n for n in node[1:]]
    folded = (kind, *parts)
    if kind in ("op", "not", "filter", "get") and all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        try:
            return ("const", _value(folded, filters)({}))
        except TemplateError:  # it may stand in a branch that is never taken
            return folded
    return folded


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, x=node[1]: x
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "get":
        a, b = _value(node[1], filters), _value(node[2], filters)
        return lambda env: _get(a(env), b(env))
    if kind == "not":
        a = _value(node[1], filters)
        return lambda env: not a(env)
    if kind in ("and", "or"):
        a, b = _value(node[1], filters), _value(node[2], filters)
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "op":
        f, a, b = _OPS[node[1]], _value(node[2], filters), _value(node[3], filters)
        return lambda env: _apply(f, a(env), b(env))
    if kind == "filter":
        f, a = filters[node[1]], _value(node[2], filters)
        return lambda env: _apply(f, a(env))
    test, a, b = (_value(n, filters) for n in node[1:])
    return lambda env: a(env) if test(env) else b(env)


def _apply(f: Callable, *values: Any) -> Any:
    try:
        return f(*values)
    except TypeError as e:
        raise TemplateError(str(e)) from None


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"{key!r} of something that is no mapping or list")


def _statement(node: tuple, filters: dict[str, Callable], generated: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], generated)

        def text(env):
            yield piece

        return text
    if kind == "print":
        value = _value(node[1], filters)

        def show(env):
            yield _text(value(env)), generated

        return show
    if kind == "seq":
        parts = [_statement(n, filters, generated) for n in node[1]]

        def seq(env):
            for p in parts:
                yield from p(env)

        return seq
    if kind == "generation":
        return _statement(node[1], filters, True)
    if kind == "set":
        value = _value(node[2], filters)

        def put(env, name=node[1]):
            env[name] = value(env)
            yield from ()

        return put
    if kind == "cond":
        test, a, b = _value(node[1], filters), _statement(node[2], filters, generated), _statement(node[3], filters, generated)

        def cond(env):
            yield from (a if test(env) else b)(env)

        return cond
    over, inner, name = _value(node[2], filters), _statement(node[3], filters, generated), node[1]

    def loop(env):
        items = over(env)
        if items is None or isinstance(items, (str, bytes, dict, int)):
            raise TemplateError("for needs a list")
        outer = {k: env.get(k) for k in ("loop", name)}
        ahead, i, end = iter(items), 0, object()
        item = next(ahead, end)
        while item is not end:
            after = next(ahead, end)
            env[name], env["loop"] = item, {"index": i + 1, "index0": i, "first": i == 0, "last": after is end}
            yield from inner(env)
            item, i = after, i + 1
        env.update(outer)

    return loop


def _uses(node: Any, name: str) -> int:
    return (node == ("name", name)) + sum(_uses(n, name) for n in node if isinstance(n, (tuple, list))) if isinstance(node, (tuple, list)) else 0


class Template:
    """render(messages, ...) yields (text, generated) pieces. Messages may be an
    iterator: it is read as the template reads it if one loop is all that uses it."""

    def __init__(self, source: str, control: Iterable[str] = ()):
        self.escaper = Escaper(control)
        filters: dict[str, Callable] = {
            "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
            "length": len, "escape": lambda x: self.escaper.escape(_text(x)),
        }
        self.tree = fold(parse(source), filters)
        self.run = _statement(self.tree, filters, False)
        loops = [n for n in self.tree[1] if n[0] == "for" and n[2] == ("name", "messages")]
        self.streams = len(loops) == 1 and _uses(self.tree, "messages") == 1

    def render(self, messages: Iterable[dict], **names: Any) -> Iterator[Piece]:
        return self.run({**names, "messages": messages if self.streams else list(messages)})
