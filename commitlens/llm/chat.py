"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree (literals, expressions, ``for``,
``if``, ``generation``), constants are folded, and Python closures are
generated from the tree, once per task. The language is sandboxed: names are the
loop variables and the conversation's fields, an attribute is a lookup in a
mapping, there are no calls but the filters below, and no way to reach a Python
object. Text written inside ``{% generation %}`` is marked, so a training loss
can be restricted to what the model should write.

Statements: ``{{ expr }}``, ``{% for x in expr %} ... {% endfor %}``,
``{% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}``,
``{% generation %} ... {% endgeneration %}``, ``{# comment #}``. Expressions: strings,
numbers, ``true``/``false``/``none``, names, ``a.b``, ``a['b']``, ``==``, ``!=``, ``and``, ``or``,
``not``, ``+`` (strings), ``loop.first``, ``loop.last``, ``loop.index0``, and the filters
``escape`` (control strings become ordinary text, reversibly), ``trim``, ``upper``, ``lower``.
A dash inside a brace (``{{- x -}}``, ``{%- ... -%}``) trims the white space of the
text on its side. Braces within a string are part of it. A name that nothing defines,
or a field that its mapping lacks, is none and renders as nothing; a field of anything
but a mapping is an error. Expressions and statements nest at most
``DEPTH`` deep; a deeper template is a :class:`TemplateError` like any other fault.

Escaping. A control string inside a text gets ``ESCAPE`` after its first character,
and so does every run that would read as an escaped one, so unescaping gives
the very text back and no text can forge a turn.

Conversations are gathered by id: rows of a conversation are ordered by turn;
repeated turns keep all rows, ordered by role and text, so the result is defined.

Edge cases. Null role or text: empty. Null turn sorts first. Null conv_id is a
conversation of its own. No rows give no conversations. Other columns are not
read. A conversation is one row; it must fit in a task, like any text.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import table

#: Control strings of the default template, longest first where one begins another.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]")
ESCAPE = "​"

#: Instructions in [INST], answers up to </s>, other roles in a named turn.
TEMPLATE = """<s>{% for m in messages %}{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]{% elif m.role == 'assistant' %}\
[TURN]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>{% else %}[SYS]{{ m.role | escape }}[/SYS]{{ m.text | escape }}[/TURN]{% endif %}{% endfor %}"""


def _escape_pattern(control=CONTROL) -> re.Pattern:
    """A control string with any number of escapes after its first character."""
    return re.compile("|".join(f"{re.escape(c[0])}{ESCAPE}*{re.escape(c[1:])}" for c in control))


PATTERN = _escape_pattern()
ESCAPED = re.compile("|".join(f"{re.escape(c[0])}{ESCAPE}+{re.escape(c[1:])}" for c in CONTROL))
PLAIN = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return PATTERN.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class TemplateError(ValueError):
    pass


# ---- parser: source -> syntax tree (nested tuples) ------------------------

_TEXT = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
PART = re.compile(rf"\{{\{{(-?)((?:{_TEXT}|(?!-?\}}\}}).)*+)(-?)\}}\}}|\{{%(-?)((?:{_TEXT}|(?!-?%\}}).)*+)(-?)%\}}|\{{#(-?)(?:(?!-?#\}}).)*+(-?)#\}}", re.S)
#: Nesting of brackets and negations in an expression, and of statements.
DEPTH = 100
LEX = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|+\[\]()]))""")
FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
CONSTANTS = {"true": True, "false": False, "none": None}


class Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.items.append((kind, m[kind]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *values) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] in (3, 4) and self.items[self.at][1] in values

    def take(self, *values):
        if self.at >= len(self.items) or values and not self.peek(*values):
            raise TemplateError(f"expected {values or 'a value'}")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def deeper(self, part):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("an expression is nested too deeply")
        tree = part()
        self.depth -= 1
        return tree

    def either(self):
        tree = self.both()
        while self.peek("or"):
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.peek("and"):
            self.take()
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.deeper(self.negated))
        tree = self.sum()
        if self.peek("==", "!="):
            return (self.take()[1], tree, self.sum())
        return tree

    def sum(self):
        tree = self.filtered()
        while self.peek("+"):
            self.take()
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.primary()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def primary(self):
        kind, value = self.take()
        if kind == 1:
            tree = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == 2:
            tree = ("const", int(value))
        elif kind == 3:
            if value in ("and", "or", "not", "in"):
                raise TemplateError(f"unexpected {value!r}")
            tree = ("const", CONSTANTS[value]) if value in CONSTANTS else ("name", value)
        elif value == "(":
            tree = self.deeper(self.either)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, value = self.take()
                if kind != 3:
                    raise TemplateError("a field has a name")
                tree = ("field", tree, ("const", value))
            else:
                tree = ("field", tree, self.deeper(self.either))
                self.take("]")
        return tree


def parse(source: str):
    """The syntax tree of a template."""
    parts, at, trim = [], 0, False
    for m in [*PART.finditer(source), None]:
        text = source[at:m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        if m and "-" in (m[1], m[4], m[7]):
            text = text.rstrip()
        if text:
            parts.append(("text", text))
        if m is None:
            break
        if m[2] is not None:
            parts.append(("write", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
        trim, at = "-" in (m[3], m[6], m[8]), m.end()
    position = depth = 0

    def body(*ends):
        nonlocal position, depth
        out = []
        depth += 1
        if depth > DEPTH:
            raise TemplateError("statements are nested too deeply")
        while position < len(parts):
            kind, value = parts[position]
            position += 1
            if kind == "text":
                out.append(("write", ("const", value)))
            elif kind == "write":
                out.append(("write", Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    depth -= 1
                    return ("body", *out), word, rest
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("body", *out), "", ""

    def statement(word, rest):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"bad loop: {rest!r}")
            return ("for", m[1], Expression(m[2]).whole(), body("endfor")[0])
        if word == "if":
            cases, test = [], Expression(rest).whole()
            while True:
                block, end, more = body("elif", "else", "endif")
                cases.append((test, block))
                if end == "elif":
                    test = Expression(more).whole()
                elif end == "else":
                    return ("if", tuple(cases), body("endif")[0])
                else:
                    return ("if", tuple(cases), ("body",))
        if word == "generation":
            return ("generation", body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# ---- constant folding -----------------------------------------------------

def fold(tree):
    """The tree with constant expressions computed, neighbouring constant
    writes joined and cases that can't be reached left out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "body":
        out = []
        for child in map(fold, tree[1:]):
            for x in child[1:] if child[0] == "body" else (child,):
                if x[0] == "write" and x[1][0] == "const" and out and out[-1][0] == "write" and out[-1][1][0] == "const":
                    out[-1] = ("write", ("const", _text(out[-1][1][1]) + _text(x[1][1])))
                elif not (x[0] == "write" and x[1][0] == "const" and _text(x[1][1]) == ""):
                    out.append(x)
        return ("body", *out)
    if kind == "if":
        cases = []
        for test, block in tree[1]:
            test = fold(test)
            if test[0] != "const":
                cases.append((test, fold(block)))
            elif test[1]:
                return ("if", tuple(cases), fold(block)) if cases else fold(block)
        return ("if", tuple(cases), fold(tree[2])) if cases else fold(tree[2])
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    parts = tuple(fold(x) for x in tree[1:])
    if kind in ("+", "==", "!=", "and", "or", "not") and all(p[0] == "const" for p in parts):
        return ("const", expression((kind, *parts))({}))
    return (kind, *parts)


# ---- code generation: tree -> closures -----------------------------------

def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _field(value, key):
    if isinstance(value, dict):
        return value.get(key)
    raise TemplateError("only mappings have fields")


def expression(tree):
    """A closure from the names in scope to the value."""
    kind, *rest = tree
    if kind == "const":
        return lambda scope, v=rest[0]: v
    if kind == "name":
        return lambda scope, n=rest[0]: scope.get(n)
    if kind == "filter":
        inner, run = expression(rest[1]), FILTERS[rest[0]]
        return lambda scope: run(_text(inner(scope)))
    a = expression(rest[0])
    if kind == "not":
        return lambda scope: not a(scope)
    b = expression(rest[1])
    return {
        "field": lambda scope: _field(a(scope), b(scope)),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "+": lambda scope: _text(a(scope)) + _text(b(scope)),
    }[kind]


def statement(tree):
    """A closure (scope, write, marked) that renders a statement."""
    kind, *rest = tree
    if kind == "write":
        value = expression(rest[0])
        return lambda scope, write, marked: write(_text(value(scope)), marked)
    if kind == "body":
        run = [statement(x) for x in rest]

        def body(scope, write, marked):
            for r in run:
                r(scope, write, marked)
        return body
    if kind == "generation":
        inner = statement(rest[0])
        return lambda scope, write, marked: inner(scope, write, True)
    if kind == "if":
        cases, other = [(expression(t), statement(b)) for t, b in rest[0]], statement(rest[1])

        def choose(scope, write, marked):
            for test, block in cases:
                if test(scope):
                    return block(scope, write, marked)
            return other(scope, write, marked)
        return choose
    name, values, block = rest[0], expression(rest[1]), statement(rest[2])

    def loop(scope, write, marked):
        rows = list(values(scope) or ())
        for i, row in enumerate(rows):
            block({**scope, name: row, "loop": {"first": i == 0, "last": i == len(rows) - 1, "index0": i}}, write, marked)
    return loop


def compile_template(source: str = TEMPLATE):
    """A function from the names in scope to (text, [(start, end), ...]):
    the rendered text and its marked ranges, in code points."""
    try:
        run = statement(fold(parse(source)))
    except RecursionError:  # a chain of operators without end
        raise TemplateError("the template is nested too deeply") from None

    def render(**scope):
        parts, ranges, at = [], [], 0

        def write(text, marked):
            nonlocal at
            if text:
                parts.append(text)
                if marked:
                    ranges.append((at, at + len(text)))
                at += len(text)

        run(scope, write, False)
        return "".join(parts), ranges

    return render


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text that the default template wrote,
    found by its control strings alone."""
    at = [(m.start(), m.end(), m[0]) for m in PLAIN.finditer(text)]
    out, i = [], 0

    def until(end: str) -> str:
        nonlocal i
        begin = at[i][1]
        i += 1
        if at[i][2] != end:
            raise ValueError(f"{end} expected")
        return unescape(text[begin:at[i][0]])

    while i < len(at):
        mark = at[i][2]
        if mark == "[INST]":
            out.append(("user", until("[/INST]")))
        elif mark == "[TURN]":
            out.append(("assistant", until("</s>")))
        elif mark == "[SYS]":
            role = until("[/SYS]")
            out.append((role, until("[/TURN]")))
        elif mark != "<s>" or i:
            raise ValueError(f"{mark} where a turn begins")
        i += 1
    return out


# ---- on Spark -------------------------------------------------------------

def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(id, formatted, marked): one row per conversation, its text by the
    template and the marked ranges in code points."""
    row = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
                   F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(f"`{id_col}`").alias(id_col)).agg(F.sort_array(F.collect_list(row)).alias("messages"))

    def render(conversations: pd.Series) -> pd.DataFrame:
        run = compile_template(template)
        done = [run(messages=list(c)) for c in conversations]
        return pd.DataFrame({"formatted": [d[0] for d in done], "marked": [[list(r) for r in d[1]] for d in done]})

    return grouped.select(id_col, F.pandas_udf(render, "formatted string, marked array<array<bigint>>")("messages").alias("f")).select(id_col, "f.*")


def digests(formatted: pd.Series, marked: pd.Series) -> pd.DataFrame:
    """What the text reads back as: turns, and the marked text unescaped."""
    rows = []
    for text, ranges in zip(formatted, marked):
        turns = read_back(text)
        loss = [unescape(text[int(a):int(b)]) for a, b in ranges]
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        rows.append((len(turns), sha, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    own = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(own, "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    kind = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return format_conversations(turns).select("conv_id", F.pandas_udf(digests, kind)("formatted", "marked").alias("d")).select("conv_id", "d.*")
