"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants in it are folded, and Python
closures are generated that render one conversation.  The language is a
sandbox: texts, ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expression %}``, ``{% for m in messages %}`` and ``{% generation
%} ... {% endgeneration %}``, which marks what a model shall learn to write.
Expressions have literals, names, fields by ``.`` or ``[...]`` of mappings only,
comparisons, ``and or not``, ``+ ~`` and filters from a fixed list; there are no
calls and no attributes of Python objects.

Conversations are sorted inside partitions and rendered turn by turn, so a
conversation of any length is held a segment at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that have a meaning in the formatted text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TEXT]")
TEMPLATE = """\
{% for m in messages %}\
{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]\
{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>\
{% else %}<s>[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[/TEXT]{% endif %}\
{% endfor %}"""
#: Characters of formatted text after which a segment ends (at the end of a turn).
SEGMENT_CHARS = 1_000_000

PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.\[\]()+~]))")
CONTROL_RE = re.compile("|".join(map(re.escape, CONTROL)))
READ_RE = re.compile(r"\\(.?)", re.S)


def escape(text: str) -> str:
    """No control string is left: a backslash breaks it behind its first character; backslashes are doubled."""
    return CONTROL_RE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return READ_RE.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(), "length": lambda x: len(x),
}


class TemplateError(ValueError):
    """The template is outside the language."""


class Expression:
    """Recursive descent over one expression; the tree is made of tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.peek("or"):
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negation()
        while self.peek("and"):
            self.take()
            tree = ("and", tree, self.negation())
        return tree

    def negation(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        tree = self.joined()
        if self.peek("==", "!="):
            return (self.take()[1], tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.peek("+", "~"):
            tree = (self.take()[1], tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", tree, name)
        return tree

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == "text":
            tree = ("const", value[1:-1])
        elif kind == "number":
            tree = ("const", int(value))
        elif value == "(":
            tree = self.either()
            if not self.peek(")"):
                raise TemplateError("a bracket is open")
            self.take()
        elif kind == "name" and value in ("true", "false", "none"):
            tree = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name" and not value.startswith("_"):
            tree = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, key = self.take()
                if kind != "name" or key.startswith("_"):
                    raise TemplateError(f"no field {key!r}")
                tree = ("field", tree, ("const", key))
            else:
                tree = ("field", tree, self.either())
                if not self.peek("]"):
                    raise TemplateError("a bracket is open")
                self.take()
        return tree


def fold(tree: tuple) -> tuple:
    """Subtrees without names become constants."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[1])
        return ("const", FILTERS[tree[2]](inner[1])) if inner[0] == "const" else ("filter", inner, tree[2])
    parts = tuple(fold(x) for x in tree[1:])
    folded = (kind, *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind != "field" and all(x[0] == "const" for x in parts):
        return ("const", closure(folded)({}))
    return folded


def closure(tree: tuple) -> Callable[[dict], object]:
    """A function of the names in scope."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    a = closure(tree[1])
    if kind == "filter":
        fn = FILTERS[tree[2]]
        return lambda scope: fn(a(scope))
    if kind == "not":
        return lambda scope: not a(scope)
    b = closure(tree[2])
    if kind == "field":

        def field(scope):
            holder, key = a(scope), b(scope)
            return holder.get(key) if isinstance(holder, dict) else None

        return field
    return {
        "or": lambda scope: a(scope) or b(scope), "and": lambda scope: a(scope) and b(scope),
        "==": lambda scope: a(scope) == b(scope), "!=": lambda scope: a(scope) != b(scope),
        "+": lambda scope: a(scope) + b(scope), "~": lambda scope: f"{a(scope)}{b(scope)}",
    }[kind]


class Output:
    """Formatted text and the spans (from, to) that generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def taken(self) -> tuple[str, list[tuple[int, int]]]:
        text, spans = "".join(self.parts), self.spans
        self.parts, self.size, self.spans = [], 0, []
        return text, spans


def parse(template: str) -> list[tuple]:
    """The template's syntax tree: a list of nodes."""
    items: list[tuple[str, str]] = []
    at = 0
    for m in PART.finditer(template):
        items.append(("text", template[at : m.start()]))
        items.append(("show", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    items.append(("text", template[at:]))
    items = [x for x in items if x != ("text", "")]
    tree, end = body(items, 0, ())
    if end < len(items):
        raise TemplateError(f"unexpected {items[end][1]!r}")
    return tree


def body(items: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    nodes: list[tuple] = []
    while at < len(items):
        kind, value = items[at]
        word = value.split()[0] if kind == "tag" and value else ""
        if word in ends:
            return nodes, at
        at += 1
        if kind == "text":
            nodes.append(("text", value))
        elif kind == "show":
            tree = fold(Expression(value).whole())
            nodes.append(("text", str(tree[1])) if tree[0] == "const" else ("show", tree))
        elif word == "generation":
            inner, at = body(items, at, ("endgeneration",))
            nodes.append(("generation", inner))
            at = closed(items, at)
        elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(.*)", value, re.S)):
            nodes.append(("set", m[1], fold(Expression(m[2]).whole())))
        elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+messages", value)):
            inner, at = body(items, at, ("endfor",))
            nodes.append(("for", m[1], inner))
            at = closed(items, at)
        elif word == "if":
            arms, test = [], value[2:]
            while True:
                inner, at = body(items, at, ("elif", "else", "endif"))
                arms.append((("const", True) if test is None else fold(Expression(test).whole()), inner))
                if at >= len(items):
                    raise TemplateError("an if is open")
                tag = items[at][1]
                at += 1
                if tag == "endif":
                    break
                test = tag[4:] if tag.startswith("elif") else None
            arms = [x for x in arms if x[0][0] != "const" or x[0][1]]  # arms that never hold are folded away
            if arms and arms[0][0][0] == "const":
                nodes += arms[0][1]
            elif arms:
                nodes.append(("if", arms))
        else:
            raise TemplateError(f"unexpected {value!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return nodes, at


def closed(items: list[tuple[str, str]], at: int) -> int:
    if at >= len(items):
        raise TemplateError("a block is open")
    return at + 1


def compiled(nodes: list[tuple]) -> Callable[[dict, Output], None]:
    """The closure that renders nodes without a loop over messages."""
    steps: list[Callable[[dict, Output], None]] = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda scope, out, text=node[1]: out.write(text))
        elif kind == "show":
            steps.append(lambda scope, out, value=closure(node[1]): out.write("" if (x := value(scope)) is None else str(x)))
        elif kind == "set":
            steps.append(lambda scope, out, name=node[1], value=closure(node[2]): scope.update({name: value(scope)}))
        elif kind == "if":
            arms = [(closure(test), compiled(inner)) for test, inner in node[1]]

            def choose(scope, out, arms=arms):
                for test, run in arms:
                    if test(scope):
                        return run(scope, out)
                return None

            steps.append(choose)
        elif kind == "generation":

            def mark(scope, out, run=compiled(node[1])):
                begin = out.size
                run(scope, out)
                out.spans.append((begin, out.size))

            steps.append(mark)
        else:
            raise TemplateError("a loop over messages stands at the top level only")

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


class Template:
    """before, each message, after: at most one loop over messages."""

    def __init__(self, source: str):
        nodes = parse(source)
        loops = [k for k, n in enumerate(nodes) if n[0] == "for"]
        if len(loops) > 1:
            raise TemplateError("more than one loop over messages")
        k = loops[0] if loops else len(nodes)
        self.before, self.after = compiled(nodes[:k]), compiled(nodes[k + 1 :])
        self.name, inner = (nodes[k][1], nodes[k][2]) if loops else ("m", [])
        self.each = compiled(inner)

    def segments(self, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Formatted text of one conversation, in pieces that end with a turn."""
        out, scope = Output(), {}
        self.before(scope, out)
        turn = next(turns, None)
        index = 0
        while turn is not None:
            following = next(turns, None)
            loop = {"index": index + 1, "index0": index, "first": index == 0, "last": following is None}
            self.each(scope | {self.name: {"role": turn[0], "text": turn[1]}, "loop": loop}, out)
            if out.size >= SEGMENT_CHARS and following is not None:
                yield out.taken()
            turn, index = following, index + 1
        self.after(scope, out)
        yield out.taken()


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in text that TEMPLATE formatted."""
    at = 0
    while at < len(text):
        if text.startswith("<s>[INST] ", at):
            end = text.index(" [/INST]", at + 10)
            yield "user", unescape(text[at + 10 : end])
            at = end + 8
        elif text.startswith("<s>[ROLE]", at):
            middle = text.index("[/ROLE]", at + 9)
            end = text.index("[/TEXT]", middle + 7)
            yield unescape(text[at + 9 : middle]), unescape(text[middle + 7 : end])
            at = end + 7
        elif text.startswith(" ", at):
            end = text.index("</s>", at + 1)
            yield "assistant", unescape(text[at + 1 : end])
            at = end + 4
        else:
            raise ValueError("not a formatted conversation")


SEGMENTS = "conv_id long, segment int, last boolean, formatted string, loss array<struct<start:int,end:int>>"
LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_chats(df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, last, formatted, loss): each conversation in segments, in order.

    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns
    of their own.  A null role or text is empty; rows with a null conv_id form one
    conversation.  ``loss`` has the spans of ``formatted`` (code points) under a
    generation mark.  Nearly always a conversation is one segment; segments of one
    conversation lie in one partition behind one another.  An empty table gives
    an empty result.
    """
    Template(template)  # errors show up here, not in tasks
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        made = Template(template)
        rows = Peek(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, size = [], 0
        while not rows.over:
            conv = rows.head[0]
            pieces = Peek(made.segments((r[1], r[2]) for r in rows.while_(lambda r, conv=conv: r[0] == conv)))
            k = 0
            while not pieces.over:
                text, spans = pieces.take()
                held.append((conv, k, pieces.over, text, [{"start": a, "end": b} for a, b in spans]))
                k, size = k + 1, size + len(text)
                if size >= SEGMENT_CHARS:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return ordered.mapInArrow(run, SEGMENTS)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), LOSS]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "segment", "last", "formatted", "loss"])


class Peek:
    """An iterator that shows its next value."""

    def __init__(self, values):
        self.values = iter(values)
        self.take()

    def take(self):
        now, self.over = getattr(self, "head", None), False
        self.head = next(self.values, self)
        self.over = self.head is self
        return now

    def while_(self, test):
        while not self.over and test(self.head):
            yield self.take()


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ``format_chats``.

    A digest is of a whole conversation in order, so its segments are streamed;
    only the digest's state is held.
    """

    def run(batches):
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        state = fresh()
        for batch in batches:
            done = []
            for conv, _, last, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    part = unescape(text[span["start"] : span["end"]])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
                if last:
                    done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    state = fresh()
            if done:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
