"""Chat formatting: a small sandboxed template language, compiled to closures.

    {{ expression }}   {% for x in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   text under the loss mask

Expressions know strings, whole numbers, true and false, variables, ``.field`` of rows, ``loop.first``
and ``loop.last``, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``, parentheses and filters ``| name``. There is no
access to Python attributes, calls, imports or assignment. Parts that depend on no variable are folded
when the template is compiled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow


def escape(s: str) -> str:
    """Reversible: afterwards no control string ``<|`` and no lone backslash is left."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_name(s: str) -> str:
    """As escape, and on one line."""
    return escape(s).replace("\n", "\\n")


def unescape(s: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], s)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_name": escape_name, "trim": str.strip}

CHAT = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_name }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


class TemplateError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.+()]))")


class _Expression:
    """Recursive descent into a tree of tuples: ('lit', v), ('var', n), ('get', e, n), ..."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m[1] and ("str", m[1]) or m[2] and ("int", m[2]) or m[3] and ("name", m[3]) or ("op", m[4]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected {kind or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def chain(self, below, *ops: str) -> tuple:
        tree = below()
        while self.peek(*ops):
            tree = fold((self.take(), tree, below()))
        return tree

    def either(self) -> tuple:
        return self.chain(self.both, "or")

    def both(self) -> tuple:
        return self.chain(self.negated, "and")

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return fold(("not", self.negated()))
        return self.chain(self.joined, "==", "!=")

    def joined(self) -> tuple:
        return self.chain(self.filtered, "+")

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.peek("|", "."):
            if self.take() == ".":
                tree = ("get", tree, self.take("name"))
            else:
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = fold(("filter", tree, name))
        return tree

    def atom(self) -> tuple:
        if self.peek("("):
            self.take()
            tree = self.either()
            if not self.peek(")"):
                raise TemplateError("missing )")
            self.take()
            return tree
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
        value = self.take()
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("lit", int(value))
        if kind == "name":
            return ("lit", value == "true") if value in ("true", "false") else ("var", value)
        raise TemplateError(f"unexpected {value!r}")


def fold(tree: tuple) -> tuple:
    """A tree whose parts are all literals becomes one."""
    parts = [x for x in tree[1:] if isinstance(x, tuple)]
    return ("lit", closure(tree)({})) if all(x[0] == "lit" for x in parts) else tree


def closure(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "lit":
        return lambda scope, v=tree[1]: v
    if kind == "var":
        def variable(scope, n=tree[1]):
            if n not in scope:
                raise TemplateError(f"no variable {n!r}")
            return scope[n]
        return variable
    a = closure(tree[1])
    if kind == "get":
        def field(scope, n=tree[2]):
            row = a(scope)
            if not isinstance(row, dict) or n not in row:
                raise TemplateError(f"no field {n!r}")
            return row[n]
        return field
    if kind == "filter":
        return lambda scope, f=FILTERS[tree[2]]: f(_text(a(scope)))
    if kind == "not":
        return lambda scope: not a(scope)
    b = closure(tree[2])
    return {
        "or": lambda scope: a(scope) or b(scope), "and": lambda scope: a(scope) and b(scope),
        "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
        "+": lambda scope: _text(a(scope)) + _text(b(scope)),
    }[kind]


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%\s*(.*?)\s*%\}", re.S)
_ENDS = {"for": "endfor", "if": "endif", "generation": "endgeneration"}


def parse_template(source: str) -> list[tuple]:
    """Nodes: ('text', s), ('out', tree), ('for', name, tree, body), ('if', [(tree, body)]), ('gen', body)."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("expr", m[1]) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                nodes.append(("text", value))
                continue
            if kind == "expr":
                tree = _Expression(value).parse()
                nodes.append(("text", _text(tree[1])) if tree[0] == "lit" else ("out", tree))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return merged(nodes), value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                nodes.append(("for", m[1], _Expression(m[2]).parse(), block("endfor")[0]))
            elif word == "generation":
                nodes.append(("gen", block("endgeneration")[0]))
            elif word == "if":
                branches, test = [], _Expression(rest).parse()
                while True:
                    body, end = block("elif", "else", "endif")
                    branches.append((test, body))
                    if end == "endif":
                        break
                    test = _Expression(end[4:]).parse() if end.startswith("elif") else ("lit", True)
                live = [b for b in branches if b[0] != ("lit", False)]
                nodes += live[0][1] if live and live[0][0] == ("lit", True) else [("if", live)]
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return merged(nodes), ""

    return block()[0]


def merged(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for n in nodes:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        else:
            out.append(n)
    return out


def _body(nodes: list[tuple]) -> Callable[[dict, list, list], None]:
    """A closure that appends to (pieces, marks); marks hold piece numbers of generation spans."""
    steps = []
    for n in nodes:
        if n[0] == "text":
            steps.append(lambda scope, out, marks, s=n[1]: out.append(s))
        elif n[0] == "out":
            steps.append(lambda scope, out, marks, e=closure(n[1]): out.append(_text(e(scope))))
        elif n[0] == "gen":
            def generation(scope, out, marks, run=_body(n[1])):
                start = len(out)
                run(scope, out, marks)
                marks.append((start, len(out)))
            steps.append(generation)
        elif n[0] == "if":
            def choose(scope, out, marks, branches=[(closure(t), _body(b)) for t, b in n[1]]):
                for test, run in branches:
                    if test(scope):
                        return run(scope, out, marks)
            steps.append(choose)
        else:
            def loop(scope, out, marks, name=n[1], over=closure(n[2]), run=_body(n[3])):
                rows = over(scope)
                for i, row in enumerate(rows):
                    run(scope | {name: row, "loop": {"index": i + 1, "first": i == 0, "last": i == len(rows) - 1}}, out, marks)
            steps.append(loop)

    def run(scope, out, marks):
        for step in steps:
            step(scope, out, marks)

    return run


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """template -> messages -> (formatted text, code-point spans of generated text)."""
    run = _body(parse_template(source))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        marks: list[tuple[int, int]] = []
        run({"messages": messages}, out, marks)
        ends = [0]
        for piece in out:
            ends.append(ends[-1] + len(piece))
        return "".join(out), [(ends[a], ends[b]) for a, b in marks]

    return render


FORMATTED = "conv_id long, formatted string, spans array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _render(batches, template: str):
    render = compile_template(template)
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column(1).to_pylist():
            text, marks = render([{"role": t["role"] or "", "text": t["text"] or ""} for t in turns])
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in marks])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, _SPANS)], ["conv_id", "formatted", "spans"])


def format_conversations(turns: DataFrame, template: str = CHAT) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: conv_id, formatted, spans.

    Turns are ordered by turn, nulls first, then role and text; repeated rows are turns of their
    own. Null roles and texts count as empty; a null conv_id is one conversation; other columns
    are ignored. A conversation is one string of the result, so it is held whole by one task.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.transform(map_arrow, lambda it: _render(it, template), FORMATTED)


def _parse(batches):
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                         len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        yield pa.RecordBatch.from_pydict({
            "conv_id": pa.array([r[0] for r in rows], pa.int64()), "n_turns": pa.array([r[1] for r in rows], pa.int64()),
            "turns_sha256": pa.array([r[2] for r in rows], pa.string()), "loss_chars": pa.array([r[3] for r in rows], pa.int64()),
            "loss_sha256": pa.array([r[4] for r in rows], pa.string()), "formatted_chars": pa.array([r[5] for r in rows], pa.int64()),
        })


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, parsed again from formatted text and unescaped:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return formatted.select("conv_id", "formatted", "spans").transform(
            map_arrow,
        _parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
