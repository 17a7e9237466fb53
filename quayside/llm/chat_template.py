"""Chat formatting by a small template compiler.

A sandboxed template language (text, {{ output }}, {% if %}, {% for %}, {% set %}, {% generation %})
is parsed into a syntax tree, constants in the tree are folded, and the tree is turned into Python
closures.  Templates reach message fields, loop facts and a fixed list of filters, nothing else: no
attributes of Python objects, no calls, no imports.  Rendering yields (piece, is_generation) pairs
while it pulls messages, so a conversation of any length streams through one rendering, with what
stands before, between and after its turns, and the loss mask comes with the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches

Piece = tuple[str, bool]
Emit = Callable[[dict, bool], Iterator[Piece]]

#: Fixed: what marks turns in the default template. Every one starts with "<" or "[".
CHAT_TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'system' %}<<SYS>>{{ message.text | escape }}<</SYS>>"
    "{% elif message.role == 'user' %}[INST]{{ message.text | escape }}[/INST]"
    "{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ message.role | escape }}[TEXT]{{ message.text | escape }}[/ROLE]{% endif %}"
    "{% endfor %}"
)
ESCAPE = "\\"
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\([\\<\[])")


def escape(text: str) -> str:
    """Put a backslash before every backslash, < and [: no control string survives in the result."""
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _ESCAPED.sub(r"\1", text)


#: The filters a template may use.
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


#: Stands for the end of a stream of messages.
END = object()
#: Under this name, which no template can say, a scope may have what is called with the place of a message whose turn begins.
BEGUN = "-begun"


class TemplateError(ValueError):
    """The template isn't in the language, or asks for something outside the sandbox."""


# --- parsing ---------------------------------------------------------------------------------

_TAG = re.compile(r"\{([{%])(-?)(.*?)(-?)[}%]\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:('[^']*'|"[^"]*")|(\d+)|(==|!=|\||\+|\(|\)|\[|\]|\.)|([A-Za-z_]\w*))""")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        kind = ("string", "number", "sign", "name")[m.lastindex - 1]
        out.append((kind, m[m.lastindex][1:-1] if kind == "string" else m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """or < and < not < == != < + < filters < atoms; trees are tuples."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while sign := self.take("==", "!="):
            tree = (sign, tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("const", value)
        if kind == "number":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind != "name" or value in ("or", "and", "not"):
            raise TemplateError(f"unexpected {value!r}")
        if sign := self.take(".", "["):
            kind, field = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != ("name" if sign == "." else "string") or field.startswith("_"):
                raise TemplateError(f"no field {field!r}")
            self.at += 1
            if sign == "[" and not self.take("]"):
                raise TemplateError("missing ]")
            return ("field", value, field)
        return ("name", value)


def parse(source: str) -> tuple:
    """The syntax tree: ("block", [nodes]).  A dash inside a tag takes away the white space on that side."""
    parts: list[tuple[str, str]] = []
    at, bare = 0, False
    for m in _TAG.finditer(source):
        if m[0][-2] != ("}" if m[1] == "{" else "%"):
            raise TemplateError(f"unclosed {m[0][:10]!r}")
        text = source[at : m.start()]
        text = text.lstrip() if bare else text
        text = text.rstrip() if m[2] else text
        if text:
            parts.append(("text", text))
        parts.append(("output", m[3]) if m[1] == "{" else ("tag", m[3].strip()))
        at, bare = m.end(), bool(m[4])
    rest = source[at:].lstrip() if bare else source[at:]
    if rest:
        parts.append(("text", rest))
    tree, rest = _block(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {parts[rest][1]!r}")
    return tree


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    nodes: list[tuple] = []
    while at < len(parts):
        kind, body = parts[at]
        word = body.split(None, 1)[0] if kind == "tag" and body else ""
        if kind == "text":
            nodes.append(("text", body))
        elif kind == "output":
            nodes.append(("output", _Expression(body).whole()))
        elif word in ends:
            return ("block", nodes), at
        elif word == "if":
            node, at = _if(parts, at)
            nodes.append(node)
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(\w+)", body)
            if not m:
                raise TemplateError(f"bad loop {body!r}")
            inner, at = _block(parts, at + 1, ("endfor",))
            _closed(parts, at, "endfor")
            nodes.append(("for", m[1], m[2], inner))
        elif word == "generation":
            inner, at = _block(parts, at + 1, ("endgeneration",))
            _closed(parts, at, "endgeneration")
            nodes.append(("generation", inner))
        elif word == "set":
            m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(.*)", body, re.DOTALL)
            if not m:
                raise TemplateError(f"bad assignment {body!r}")
            nodes.append(("set", m[1], _Expression(m[2]).whole()))
        else:
            raise TemplateError(f"unknown tag {body!r}")
        at += 1
    return ("block", nodes), at


def _closed(parts: list[tuple[str, str]], at: int, end: str) -> None:
    if at >= len(parts):
        raise TemplateError(f"missing {end}")


def _if(parts: list[tuple[str, str]], at: int) -> tuple[tuple, int]:
    arms, otherwise = [], ("block", [])
    while True:
        body = parts[at][1]
        word, _, condition = body.partition(" ")
        inner, at = _block(parts, at + 1, ("elif", "else", "endif"))
        _closed(parts, at, "endif")
        if word == "else":
            otherwise = inner
        else:
            arms.append((_Expression(condition).whole(), inner))
        if parts[at][1].split(None, 1)[0] == "endif":
            return ("if", arms, otherwise), at
        if word == "else":
            raise TemplateError("a branch after else")


# --- folding ---------------------------------------------------------------------------------


def fold(tree: tuple) -> tuple:
    """The same tree with constant expressions computed, dead branches dropped and texts joined."""
    kind = tree[0]
    if kind in ("const", "name", "field", "text"):
        return tree
    if kind in ("or", "and", "==", "!=", "+"):
        left, right = fold(tree[1]), fold(tree[2])
        if left[0] == right[0] == "const":
            return ("const", _BINARY[kind](left[1], right[1]))
        return (kind, left, right)
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](_shown(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "output":
        inner = fold(tree[1])
        return ("text", _shown(inner[1])) if inner[0] == "const" else ("output", inner)
    if kind == "set":
        return ("set", tree[1], fold(tree[2]))
    if kind == "for":
        return ("for", tree[1], tree[2], fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    if kind == "if":
        arms = []
        for condition, inner in tree[1]:
            condition = fold(condition)
            if condition[0] == "const" and not condition[1]:
                continue
            if condition[0] == "const":
                return ("if", arms, fold(inner)) if arms else fold(inner)
            arms.append((condition, fold(inner)))
        return ("if", arms, fold(tree[2])) if arms else fold(tree[2])
    nodes: list[tuple] = []
    for node in map(fold, tree[1]):
        for part in node[1] if node[0] == "block" else [node]:
            if part[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + part[1])
            elif part != ("text", ""):
                nodes.append(part)
    return ("block", nodes)


def _shown(value) -> str:
    return "" if value is None else str(value)


_BINARY = {
    "or": lambda a, b: a or b,
    "and": lambda a, b: a and b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: _shown(a) + _shown(b),
}


# --- closures --------------------------------------------------------------------------------


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda scope, value=tree[1]: value
    if kind == "name":
        return lambda scope, name=tree[1]: scope.get(name)
    if kind == "field":
        return lambda scope, name=tree[1], field=tree[2]: held.get(field) if isinstance(held := scope.get(name), dict) else None
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    if kind == "filter":
        inner, apply = _value(tree[2]), FILTERS[tree[1]]
        return lambda scope: apply(_shown(inner(scope)))
    left, right, combine = _value(tree[1]), _value(tree[2]), _BINARY[kind]
    return lambda scope: combine(left(scope), right(scope))


def _leaves(tree) -> Iterator[tuple]:
    """The tree and all trees in it."""
    if isinstance(tree, tuple):
        yield tree
    if isinstance(tree, tuple | list):
        for part in tree:
            yield from _leaves(part)


def _closure(tree: tuple) -> Emit:
    kind = tree[0]
    if kind == "text":
        return lambda scope, marked, text=tree[1]: iter(((text, marked),))
    if kind == "output":
        value = _value(tree[1])
        return lambda scope, marked: iter(((_shown(value(scope)), marked),))
    if kind == "generation":
        inner = _closure(tree[1])
        return lambda scope, marked: inner(scope, True)
    if kind == "set":
        value, name = _value(tree[2]), tree[1]

        def assign(scope: dict, marked: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "if":
        arms = [(_value(condition), _closure(inner)) for condition, inner in tree[1]]
        otherwise = _closure(tree[2])

        def choose(scope: dict, marked: bool) -> Iterator[Piece]:
            return next((inner for condition, inner in arms if condition(scope)), otherwise)(scope, marked)

        return choose
    if kind == "for":
        _, name, over, inner = tree
        body, ahead = _closure(inner), ("field", "loop", "last") in _leaves(inner)

        def loop(scope: dict, marked: bool) -> Iterator[Piece]:
            # the items may be a stream: one is looked ahead, and only where the body asks for it
            items = iter(scope.get(over) or ())
            item, index, end, begun = next(items, END), 0, None, scope.get(BEGUN)
            while item is not END:
                end = next(items, END) if ahead else None
                if begun and over == "messages":
                    begun(index)
                yield from body({**scope, name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": ahead and end is END}}, marked)
                item, index = end if ahead else next(items, END), index + 1

        return loop
    inner = [_closure(node) for node in tree[1]]

    def run(scope: dict, marked: bool) -> Iterator[Piece]:
        for part in inner:
            yield from part(scope, marked)

    return run


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A renderer: messages (dicts with role and text, any iterable) and facts to (piece, is_generation).

    Messages are pulled as they are needed, and a piece comes before the next message is pulled.
    Facts are names that the template may ask for, such as add_generation_prompt.
    """
    body = _closure(fold(parse(source)))
    return lambda messages, **facts: body({**facts, "messages": messages}, False)


# --- reading back ----------------------------------------------------------------------------

#: Fixed: opening mark of a turn, its closing mark, and the role it stands for (None: named before [TEXT]).
Marks = tuple[tuple[str, str, str | None], ...]
MARKS: Marks = (("<<SYS>>", "<</SYS>>", "system"), ("[INST]", "[/INST]", "user"), ("<s>", "</s>", "assistant"), ("[ROLE]", "[/ROLE]", None))


class Reader:
    """Reads a template's output back by its marks, piece by piece: feed() returns finished turns.

    What stands between turns is skipped; texts are escaped, so a mark in them is none.
    """

    def __init__(self, marks: Marks = MARKS):
        self.buffer, self.marks = "", marks
        self.longest = max(len(m[0]) for m in marks)

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.buffer += piece
        turns, at = [], 0
        while at < len(self.buffer):
            found = [(k, m) for m in self.marks if (k := self.buffer.find(m[0], at)) >= 0]
            if not found:
                at = max(at, len(self.buffer) - self.longest + 1)  # a mark may begin here
                break
            first, mark = min(found, key=lambda x: (x[0], -len(x[1][0])))
            start = first + len(mark[0])
            end = _control(self.buffer, mark[1], start)
            if end < 0:
                at = first
                break
            body = self.buffer[start:end]
            if mark[2] is None:
                role, _, text = _parted(body, "[TEXT]")
            else:
                role, text = mark[2], body
            turns.append((unescape(role), unescape(text)))
            at = end + len(mark[1])
        self.buffer = self.buffer[at:]
        return turns

    def close(self) -> None:
        if any(m[0] in self.buffer for m in self.marks):
            raise ValueError("formatted text ends inside a turn")


def _control(text: str, mark: str, start: int) -> int:
    """Where the mark stands unescaped; escaped text has a backslash before every < and [."""
    at = text.find(mark, start)
    while at >= 0:
        first = at
        while first > start and text[first - 1] == ESCAPE:
            first -= 1
        if (at - first) % 2 == 0:
            return at
        at = text.find(mark, at + 1)
    return -1


def _parted(body: str, mark: str) -> tuple[str, str, str]:
    at = _control(body, mark, 0)
    return body[:at], mark, body[at + len(mark) :]


# --- on Spark --------------------------------------------------------------------------------

FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string"


class _Conversation:
    """Digests of one conversation, fed the pieces of its rendering."""

    def __init__(self, conv_id: int | None, marks: Marks | None):
        self.conv_id, self.reader = conv_id, Reader(marks) if marks else None
        self.turns, self.loss, self.whole = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, pieces: Iterable[Piece]) -> None:
        for piece, marked in pieces:
            self.chars += len(piece)
            self.whole.update(piece.encode())
            if marked:
                said = unescape(piece)
                self.loss.update(said.encode())
                self.loss_chars += len(said)
            for role, text in self.reader.feed(piece) if self.reader else ():
                self.n_turns += 1
                self.turns.update(f"{role}\n{text}\n".encode())

    def row(self) -> tuple:
        if self.reader:
            self.reader.close()
        read = (self.n_turns, self.turns.hexdigest()) if self.reader else (None, None)
        return self.conv_id, *read, self.loss_chars, self.loss.hexdigest(), self.chars, self.whole.hexdigest()


def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches, 200):
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def format_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE, marks: Marks | None = MARKS, **facts) -> DataFrame:
    """One row per conversation: digests of its formatted text, read back from that text.

    A conversation is rendered as one stream of messages.  Rows are ordered by turn, then role and
    text; null turns come first, null roles and texts count as empty, a null conv_id is a
    conversation of its own, repeated rows are repeated turns, an empty table gives no rows and
    further columns are not looked at.  `marks` tell how the template marks turns; without them the
    columns read back (n_turns, turns_sha256) are null.  Rows of a conversation meet in one task,
    since the digests run over all its turns in order, but stream through it: the task holds one
    turn at a time (two where the template asks for loop.last), so a conversation with very many
    turns needs no more memory.
    """
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("formatted_sha256", pa.string())])
        done = []
        for conv_id, turns in groupby(_rows(batches), key=itemgetter(0)):
            now = _Conversation(conv_id, marks)
            now.add(render(({"role": role, "text": text} for _, _, role, text in turns), **facts))
            done.append(now.row())
            if len(done) == 500:
                yield _batch(done, schema)
                done = []
        if done:
            yield _batch(done, schema)

    return _in_order(conversations).mapInArrow(run, FORMATTED)


def render_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE, **facts) -> DataFrame:
    """conv_id, turn, formatted, mask: the text of each turn and its generation spans [start, end).

    Joined in turn order, the rows of a conversation are its rendering: what stands before the first
    turn belongs to it, what comes after a turn and before the next to the former.  Order and nulls
    count as in format_conversations; a task holds one turn's text at a time.
    """
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("mask", spans)])
        for conv_id, turns in groupby(_rows(batches), key=itemgetter(0)):
            pulled: list[int | None] = []  # turns handed to the template and not yet given out
            out, mask, at, shown, now = [], [], 0, 0, [0]

            def messages(turns=turns, pulled=pulled) -> Iterator[dict]:
                for _, turn, role, text in turns:
                    pulled.append(turn)
                    yield {"role": role, "text": text}

            for piece, marked in render(messages(), **facts, **{BEGUN: partial(now.__setitem__, 0)}):
                while shown < now[0]:
                    yield _batch([(conv_id, pulled.pop(0), "".join(out), mask)], schema)
                    out, mask, at, shown = [], [], 0, shown + 1
                if marked and piece:
                    mask.append({"start": at, "end": at + len(piece)})
                out.append(piece)
                at += len(piece)
            for _ in messages():  # turns that the template did not ask for
                pass
            while pulled:
                yield _batch([(conv_id, pulled.pop(0), "".join(out), mask)], schema)
                out, mask = [], []

    return _in_order(conversations).mapInArrow(run, "conv_id long, turn long, formatted string, mask array<struct<start:long,end:long>>")
