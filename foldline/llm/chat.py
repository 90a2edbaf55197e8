"""Chat formatting by compiled templates.

A template is parsed to a syntax tree, constants are folded, and Python closures are generated.  The language has ``{{ }}``
output, ``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}``, ``{% set %}`` and
``{% generation %}/{% endgeneration %}``, which marks what a model learns to write.  Expressions have literals, names,
``a.b`` and ``a[b]`` on mappings and lists alone, ``+ ~ == != < > <= >= in not and or``, ``x if c else y`` and filters.  There
are no calls and no attributes of Python objects, so a template can reach nothing but its variables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship


class TemplateError(ValueError):
    """A template that the language doesn't allow, or a value it can't use."""


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|<=|>=|[-+~<>().,|\[\]])|(?P<name>[A-Za-z_]\w*))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
_CONTROL = str.maketrans({c: "\\" + c for c in "\\#<:"})
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(x: str) -> str:
    """Backslashes before the characters that control strings are made of; ``unescape`` undoes it."""
    return x.translate(_CONTROL)


def unescape(x: str) -> str:
    return _ESCAPED.sub(r"\1", x) if "\\" in x else x


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(),
    "length": lambda x: len(x),
    "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None,
}


def _text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str | int):
        return str(x)
    raise TemplateError(f"a {type(x).__name__} can't be written")


def _plus(a, b):
    if type(a) is type(b) and isinstance(a, str | int):
        return a + b
    raise TemplateError("+ takes two strings or two numbers")


_BINARY: dict[str, Callable] = {
    "+": _plus,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, not {self.peek()[1]!r}")

    def whole(self) -> tuple:
        tree = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def choice(self) -> tuple:
        a = self.either()
        if self.take("if"):
            c = self.either()
            return ("choice", c, a, self.choice() if self.take("else") else ("const", None))
        return a

    def either(self) -> tuple:
        a = self.both()
        while self.take("or"):
            a = ("or", a, self.both())
        return a

    def both(self) -> tuple:
        a = self.negated()
        while self.take("and"):
            a = ("and", a, self.negated())
        return a

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        a = self.added()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in", "not"):
            if op == "not":
                self.need("in")
                a = ("not", ("binary", "in", a, self.added()))
            else:
                a = ("binary", op, a, self.added())
        return a

    def added(self) -> tuple:
        a = self.piped()
        while op := self.take("+", "~"):
            a = ("binary", op, a, self.piped())
        return a

    def piped(self) -> tuple:
        a = self.reached()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            a = ("filter", name, a)
        return a

    def reached(self) -> tuple:
        a = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                kind, name = self.peek()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"{name!r} isn't a field")
                self.at += 1
                a = ("item", a, ("const", name))
            else:
                a = ("item", a, self.choice())
                self.need("]")
        return a

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "op" and value == "-" and self.peek()[0] == "num":
            self.at += 1
            return ("const", -int(self.tokens[self.at - 1][1]))
        if kind == "op" and value == "(":
            a = self.choice()
            self.need(")")
            return a
        if kind == "name":
            if value in ("true", "false", "none"):
                return ("const", {"true": True, "false": False, "none": None}[value])
            if value.startswith("_") or value in ("if", "else", "in", "and", "or", "not", "for"):
                raise TemplateError(f"{value!r} isn't a name")
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts = [p for p in _PARTS.split(source) if p]
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        out: list[tuple] = []
        while at < len(parts):
            p = parts[at]
            at += 1
            if p.startswith("{#"):
                continue
            if p.startswith("{{"):
                out.append(("put", _Expression(p[2:-2]).whole()))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word + " " + rest
                out.append(statement(word, rest))
            else:
                out.append(("put", ("const", p)))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"for {rest!r}")
            return ("for", m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "if":
            body, end = block("elif", "else", "endif")
            word, _, tail = end.partition(" ")
            if word == "elif":
                return ("if", _Expression(rest).whole(), body, [statement("if", tail)])
            return ("if", _Expression(rest).whole(), body, block("endif")[0] if word == "else" else [])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"set {rest!r}")
            return ("set", m[1], _Expression(m[2]).whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    tree, _ = block()
    return tree


def fold(tree):
    """The same tree with constant parts worked out and neighbouring constant output joined."""
    if isinstance(tree, list):
        out: list = []
        todo = [fold(x) for x in reversed(tree)]
        while todo:
            node = todo.pop()
            if node[0] == "if" and node[1][0] == "const":
                todo += reversed(node[2] if node[1][1] else node[3])
            elif node[0] == "put" and node[1][0] == "const":
                s = _text(node[1][1])
                if out and out[-1][0] == "put" and out[-1][1][0] == "const":
                    out[-1] = ("put", ("const", out[-1][1][1] + s))
                elif s:
                    out.append(("put", ("const", s)))
            else:
                out.append(node)
        return out
    if not isinstance(tree, tuple) or tree[0] in ("const", "name"):
        return tree
    node = tuple(fold(x) if isinstance(x, tuple | list) else x for x in tree)
    parts = [x for x in node[1:] if isinstance(x, tuple | list)]
    if node[0] in ("binary", "filter", "not", "and", "or", "choice", "item") and all(isinstance(x, tuple) and x[0] == "const" for x in parts):
        return ("const", _expression(node)({}))
    return node


def _get(a, b):
    if isinstance(a, dict):
        return a.get(b)
    if isinstance(a, list | str) and isinstance(b, int):
        return a[b] if -len(a) <= b < len(a) else None
    if a is None:
        return None
    raise TemplateError(f"a {type(a).__name__} has no parts to reach")


def _expression(t: tuple) -> Callable[[dict], object]:
    kind = t[0]
    if kind == "const":
        value = t[1]
        return lambda v: value
    if kind == "name":
        name = t[1]
        return lambda v: v.get(name)
    if kind == "item":
        a, b = _expression(t[1]), _expression(t[2])
        return lambda v: _get(a(v), b(v))
    if kind == "filter":
        f, a = FILTERS[t[1]], _expression(t[2])
        return lambda v: f(a(v))
    if kind == "binary":
        f, a, b = _BINARY[t[1]], _expression(t[2]), _expression(t[3])
        return lambda v: f(a(v), b(v))
    if kind == "not":
        a = _expression(t[1])
        return lambda v: not a(v)
    if kind == "choice":
        c, a, b = (_expression(x) for x in t[1:])
        return lambda v: a(v) if c(v) else b(v)
    a, b = _expression(t[1]), _expression(t[2])
    if kind == "and":
        return lambda v: a(v) and b(v)
    return lambda v: a(v) or b(v)


class _Out:
    __slots__ = ("parts", "length", "marks")

    def __init__(self):
        self.parts, self.length, self.marks = [], 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def _statements(tree: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_statement(t) for t in tree]
    if len(steps) == 1:
        return steps[0]

    def run(v: dict, out: _Out) -> None:
        for s in steps:
            s(v, out)

    return run


def _statement(t: tuple) -> Callable[[dict, _Out], None]:
    kind = t[0]
    if kind == "put":
        if t[1][0] == "const":
            s = t[1][1]
            return lambda v, out: out.put(s)
        e = _expression(t[1])
        return lambda v, out: out.put(_text(e(v)))
    if kind == "set":
        name, e = t[1], _expression(t[2])

        def assign(v: dict, out: _Out) -> None:
            v[name] = e(v)

        return assign
    if kind == "if":
        c, yes, no = _expression(t[1]), _statements(t[2]), _statements(t[3])
        return lambda v, out: yes(v, out) if c(v) else no(v, out)
    body = _statements(t[-1])
    if kind == "generation":

        def marked(v: dict, out: _Out) -> None:
            start = out.length
            body(v, out)
            out.marks.append((start, out.length))

        return marked
    name, e = t[1], _expression(t[2])

    def loop(v: dict, out: _Out) -> None:
        items = e(v) or []
        if not isinstance(items, list):
            raise TemplateError("for takes a list")
        for i, x in enumerate(items):
            body({**v, name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}}, out)

    return loop


class Template:
    """A compiled template: ``render(messages, **names)`` gives the text and the spans under generation markers, in code points."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _statements(self.tree)

    def render(self, messages: list[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        self._run({"messages": messages, **names}, out)
        return "".join(out.parts), out.marks


TURNS = (
    "{% for m in messages %}### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    " </turn>\n{% endfor %}"
)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.S)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn that ``TURNS`` wrote."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "conv_id long, n_turns long, text string, loss array<struct<start:int,stop:int>>"


def format_chats(rows: DataFrame, template: str = TURNS, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation: its formatted text and the spans under generation markers.

    Conversations are sorted and formatted as their rows stream by, so a task holds one conversation at a time.  A null
    text or role is empty, turns of equal number go by role and text, a null turn comes first, and rows without a conv_id
    are one conversation.  A conversation has one row at least; an empty table gives none.  As one conversation is one row of
    the result, its turns come together in one task, and that is the most a task holds.
    """
    ship(rows.sparkSession)
    picked = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, done, messages, now, size = Template(template), [], [], None, 0

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "text", "loss"])

        def close() -> None:
            body, marks = made.render(messages)
            done.append((now, len(messages), body, [{"start": a, "stop": b} for a, b in marks]))

        for b in batches:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if messages and c != now:
                    close()
                    size += len(done[-1][2])
                    messages = []
                    if size > 1 << 22:
                        yield table()
                        done, size = [], 0
                now = c
                messages.append({"role": r, "text": t})
        if messages:
            close()
        if done:
            yield table()

    return picked.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, both read from the formatted text."""

    def run(batches):
        for b in batches:
            rows = []
            for c, body, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                turns = read_turns(body)
                learned = "".join(unescape(body[s["start"] : s["stop"]]) for s in loss)
                rows.append((c, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), _sha(learned), len(body)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()
