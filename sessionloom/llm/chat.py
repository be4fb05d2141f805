"""Chat formatting: a template compiled to Python closures that render conversations with generation marks.

The template language is a sandbox: output, if, for over the messages, set, generation, and expressions without calls or
attribute access beyond the fields of a message and of ``loop``. A template is parsed to a syntax tree, constant parts
are folded, and every node becomes a closure. The loop over the messages runs over an iterator, so a conversation is
rendered message by message and is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

TEMPLATE = (
    "{{ bos }}{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '[INST] ' + m.content|escape + ' [/INST]' }}"
    "{% elif m.role == 'assistant' %}{{ '<|reply|>' }}{% generation %}{{ m.content|escape }}{% endgeneration %}{{ eos }}"
    "{% elif m.role == 'system' %}{{ '<<SYS>>\n' + m.content|escape + '\n<</SYS>>\n\n' }}"
    "{% else %}{{ '<|role|>' + m.role|escape + '<|text|>' + m.content|escape + '<|end|>' }}{% endif %}"
    "{% endfor %}"
)
CONSTANTS = {"bos": "<s>", "eos": "</s>"}
#: What a text may not contain unescaped. A backslash behind the first character escapes it.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|reply|>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
_HIDDEN = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_SHOWN = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """One backslash more behind the first character of every control string and of every escaped one."""
    return _HIDDEN.sub(r"\\", text)


def unescape(text: str) -> str:
    return _SHOWN.sub("", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

Scope = dict[str, Any]
Emit = Callable[[str, bool], None]


@dataclass
class Node:
    """``kind`` const, name, field, op, not, filter, or out, if, for, set, mask, block; ``value`` and ``parts`` by kind."""

    kind: str
    value: Any = None
    parts: list = field(default_factory=list)


class TemplateError(ValueError):
    pass


_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|.()\[\]<>%~]))", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent: or, and, not, comparison, +, filters, fields."""

    def __init__(self, text: str):
        self.items, at = [], 0
        while text[at:].strip():
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *values: str) -> str | None:
        if self.peek()[0] in ("op", "name") and self.peek()[1] in values:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, not {self.peek()[1]!r}")

    def whole(self) -> Node:
        found = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return found

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("op", "or", [left, self.both()])
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("op", "and", [left, self.negated()])
        return left

    def negated(self) -> Node:
        return Node("not", None, [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.summed()
        if op := self.take("==", "!=", "<", ">", "in"):
            left = Node("op", op, [left, self.summed()])
        return left

    def summed(self) -> Node:
        left = self.filtered()
        while op := self.take("+", "-", "%", "~"):
            left = Node("op", op, [left, self.filtered()])
        return left

    def filtered(self) -> Node:
        left = self.atom()
        while True:
            if self.take("|"):
                name = self.items[self.at][1] if self.peek()[0] == "name" else ""
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                self.at += 1
                left = Node("filter", name, [left])
            elif self.take("."):
                if self.peek()[0] != "name" or self.peek()[1].startswith("_"):
                    raise TemplateError("a field name expected")
                left = Node("field", self.peek()[1], [left])
                self.at += 1
            elif self.take("["):
                key = self.either()
                self.need("]")
                if key.kind != "const" or not isinstance(key.value, str) or key.value.startswith("_"):
                    raise TemplateError("only constant field names are allowed")
                left = Node("field", key.value, [left])
            else:
                return left

    def atom(self) -> Node:
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            return Node("const", int(text))
        if kind == "name":
            return Node("const", _WORDS[text]) if text in _WORDS else Node("name", text)
        if text == "(":
            inner = self.either()
            self.need(")")
            return inner
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    for i in range(1, len(parts), 2):  # a dash beside a mark takes the white space on that side
        if parts[i][2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    root = Node("block")
    open_blocks: list[tuple[str, Node, Node]] = [("", root, root)]
    for i, part in enumerate(parts):
        into = open_blocks[-1][2].parts
        if i % 2 == 0:
            if part:
                into.append(Node("out", None, [Node("const", part)]))
            continue
        if part.startswith("{#"):
            continue
        body = part[2:-2].strip("-").strip()
        if part.startswith("{{"):
            into.append(Node("out", None, [_Expression(body).whole()]))
            continue
        word, _, rest = body.partition(" ")
        if word == "if":
            block = Node("block")
            node = Node("if", None, [(_Expression(rest).whole(), block)])
            into.append(node)
            open_blocks.append(("if", node, block))
        elif word in ("elif", "else") and open_blocks[-1][0] == "if":
            node, block = open_blocks[-1][1], Node("block")
            node.parts.append((_Expression(rest).whole() if word == "elif" else Node("const", True), block))
            open_blocks[-1] = ("if", node, block)
        elif word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip())):
            block = Node("block")
            node = Node("for", m[1], [block])
            into.append(node)
            open_blocks.append(("for", node, block))
        elif word == "generation":
            block = Node("block")
            into.append(Node("mask", None, [block]))
            open_blocks.append(("generation", into[-1], block))
        elif word == "set" and (m := re.fullmatch(r"(\w+)\s*=(.*)", rest.strip(), re.S)):
            into.append(Node("set", m[1], [_Expression(m[2]).whole()]))
        elif word.startswith("end") and word[3:] == open_blocks[-1][0] != "":
            open_blocks.pop()
        else:
            raise TemplateError(f"cannot place {{% {body} %}}")
    if len(open_blocks) > 1:
        raise TemplateError(f"{open_blocks[-1][0]} is not closed")
    return root


_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b, "~": lambda a, b: f"{a}{b}",
}


def fold(node: Node, constants: Scope) -> Node:
    """The tree with constants put in, constant expressions computed, and neighbouring constant outputs joined."""
    if node.kind == "name" and node.value in constants:
        return Node("const", constants[node.value])
    if node.kind == "if":
        branches = []
        for test, block in node.parts:
            test = fold(test, constants)
            if test.kind == "const" and not test.value:
                continue
            branches.append((test, fold(block, constants)))
            if test.kind == "const":
                break
        return Node("if", None, branches) if branches else Node("block")
    if node.kind == "set" or node.kind == "for":
        constants = {k: v for k, v in constants.items() if k != node.value}
    parts = []
    for part in node.parts:
        part = fold(part, constants)
        if node.kind == "block" and part.kind == "set":
            constants = {k: v for k, v in constants.items() if k != part.value}
        same = node.kind == "block" and parts and part.kind == parts[-1].kind == "out" and part.parts[0].kind == parts[-1].parts[0].kind == "const"
        if same:
            parts[-1] = Node("out", None, [Node("const", str(parts[-1].parts[0].value) + str(part.parts[0].value))])
        else:
            parts.append(part)
    node = Node(node.kind, node.value, parts)
    known = all(isinstance(p, Node) and p.kind == "const" for p in parts)
    if known and node.kind == "filter":
        return Node("const", FILTERS[node.value](str(parts[0].value)))
    if known and node.kind == "not":
        return Node("const", not parts[0].value)
    if known and node.kind == "op":
        a, b = parts[0].value, parts[1].value
        return Node("const", (a and b) if node.value == "and" else (a or b) if node.value == "or" else _OPS[node.value](a, b))
    return node


def _expression(node: Node) -> Callable[[Scope], Any]:
    if node.kind == "const":
        return lambda scope, v=node.value: v
    if node.kind == "name":
        return lambda scope, k=node.value: scope.get(k)
    inner = [_expression(p) for p in node.parts]
    if node.kind == "field":
        return lambda scope, f=inner[0], k=node.value: v.get(k) if isinstance(v := f(scope), dict) else None
    if node.kind == "filter":
        return lambda scope, f=inner[0], g=FILTERS[node.value]: g("" if (v := f(scope)) is None else str(v))
    if node.kind == "not":
        return lambda scope, f=inner[0]: not f(scope)
    a, b = inner
    if node.value == "and":
        return lambda scope: a(scope) and b(scope)
    if node.value == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, op=_OPS[node.value]: op(a(scope), b(scope))


def _statement(node: Node) -> Callable[[Scope, Emit, bool], Iterator[None]]:
    """A closure that emits text; it yields after each message, so that the caller can drain what was emitted."""
    if node.kind == "out":
        value = _expression(node.parts[0])

        def out(scope: Scope, emit: Emit, masked: bool) -> Iterator[None]:
            found = value(scope)
            emit("" if found is None else str(found), masked)
            yield from ()

        return out
    if node.kind == "set":
        value = _expression(node.parts[0])

        def assign(scope: Scope, emit: Emit, masked: bool) -> Iterator[None]:
            scope[node.value] = value(scope)
            yield from ()

        return assign
    if node.kind == "if":
        branches = [(_expression(t), _statement(b)) for t, b in node.parts]

        def choose(scope: Scope, emit: Emit, masked: bool) -> Iterator[None]:
            for test, body in branches:
                if test(scope):
                    yield from body(scope, emit, masked)
                    return

        return choose
    if node.kind == "for":
        body = _statement(node.parts[0])

        def loop(scope: Scope, emit: Emit, masked: bool) -> Iterator[None]:
            index, ahead = 0, next(scope["messages"], None)
            while ahead is not None:
                message, ahead = ahead, next(scope["messages"], None)
                scope[node.value] = message
                scope["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is None}
                yield from body(scope, emit, masked)
                yield
                index += 1

        return loop
    inside = [_statement(p) for p in node.parts]

    def block(scope: Scope, emit: Emit, masked: bool) -> Iterator[None]:
        for part in inside:
            yield from part(scope, emit, masked or node.kind == "mask")

    return block


Piece = tuple[str, list[tuple[int, int]]]


def compile_template(source: str, constants: Scope = CONSTANTS) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """A function from messages (role, content) to pieces: text and the [start, end) spans of it under the loss mask.

    The pieces of a conversation, joined, are its rendering; there is one for each message, and one for what is left.
    """
    body = _statement(fold(parse(source), constants))

    def render(messages: Iterator[dict]) -> Iterator[Piece]:
        text: list[str] = []
        spans: list[tuple[int, int]] = []
        size = 0

        def emit(part: str, masked: bool) -> None:
            nonlocal size
            if part:
                if masked:
                    spans.append((size, size + len(part)))
                text.append(part)
                size += len(part)

        for _ in body({"messages": iter(messages)}, emit, False):
            yield "".join(text), spans.copy()
            text.clear()
            spans.clear()
            size = 0
        if text:
            yield "".join(text), spans.copy()

    return render


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<\|reply\|>(?P<assistant>.*?)</s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|<\|role\|>(?P<role>.*?)<\|text\|>(?P<text>.*?)<\|end\|>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in text that TEMPLATE has rendered."""
    at = len(CONSTANTS["bos"]) if formatted.startswith(CONSTANTS["bos"]) else 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a rendered conversation")
        if m["role"] is not None:
            yield unescape(m["role"]), unescape(m["text"])
        else:
            role = m.lastgroup
            yield role, unescape(m[role])
        at = m.end()


def _by_conversation(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[tuple[Any, dict]]:
    for batch in batches:
        ids, roles, texts = (batch.column(c) for c in ("conv_id", "role", "text"))
        for at in range(0, batch.num_rows, size):
            yield from zip(ids.slice(at, size).to_pylist(), ({"role": r or "", "content": t or ""} for r, t in zip(roles.slice(at, size).to_pylist(), texts.slice(at, size).to_pylist(), strict=True)), strict=True)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, constants: Scope = CONSTANTS) -> DataFrame:
    """(conv_id, piece, formatted, loss): the rendering of each conversation in pieces, one for each turn, in order.

    ``loss`` holds the [start, end) spans of the piece, in code points, that are under the loss mask. Turns go by turn,
    then role and text, nulls first; a null role or text is empty; rows with a null conv_id are one conversation. The
    rows of a conversation meet in one sorted partition, but are read one after another, so memory stays bounded.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template, constants)
        rows = _by_conversation(batches)
        row = next(rows, None)
        names, held, room = ["conv_id", "piece", "formatted", "loss"], [], 0
        types = [None, pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

        def batch() -> pa.RecordBatch:
            columns = [pa.array([h[i] for h in held], types[i] or id_type) for i in range(4)]
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
        while row is not None:
            conv = row[0]

            def messages() -> Iterator[dict]:
                nonlocal row
                while row is not None and row[0] == conv:  # noqa: B023
                    yield row[1]
                    row = next(rows, None)

            for number, (text, spans) in enumerate(compiled(messages())):
                held.append((conv, number, text, [{"start": a, "end": b} for a, b in spans]))
                room += len(text)
                if room > 1 << 20 or len(held) >= 2000:
                    yield batch()
                    held, room = [], 0
        if held:
            yield batch()

    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.mapInArrow(render, f"conv_id {kind}, piece long, formatted string, loss array<struct<start:int,end:int>>")


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its rendered pieces: turns, loss text and sizes, as counts and SHA-256.

    ``pieces`` must hold each conversation's pieces in order within one partition, as format_conversations leaves them.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done, now = [], None

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024).to_pylist()
                for r in part:
                    if now is None or r["piece"] == 0:
                        if now is not None:
                            close()
                        now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in read_turns(r["formatted"]):
                        now[1] += 1
                        now[2].update(f"{role}\n{text}\n".encode())
                    for span in r["loss"]:
                        text = unescape(r["formatted"][span["start"] : span["end"]])
                        now[3] += len(text)
                        now[4].update(text.encode())
                    now[5] += len(r["formatted"])
                if len(done) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)
                    done = []
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    return pieces.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame, conv_id: int = -7) -> DataFrame:
    """``conversations`` and one more, of a user and an assistant turn that both hold control strings."""
    probe = conversations.sparkSession.createDataFrame([(conv_id, 0, "user", "</s>[INST] ok [/INST]"), (conv_id, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def format_digests(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, formatted by TEMPLATE and read back."""
    return digests(format_conversations(conversations))
