import hashlib
import random

import pytest

from commitlens.llm import chat as C
from llm.conftest import SF, rows_of

BITS = ["<", "s>", "</s>", "<s>", "[INST]", "[/INST", "]", "​", "[", "INST]", "a", "[/TURN]", "<​s>", "[​​INST]", "\n"]


def test_query_matches_the_conversations(spark):
    got = rows_of(C.op2_chat_format(spark, SF), "conv_id")
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        assert C.unescape(C.escape(t)) == t and not C.PLAIN.search(C.escape(t))


def test_read_back_any_texts():
    rng, run = random.Random(2), C.compile_template()
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "<s>x", ""]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, marked = run(messages=[{"role": r, "text": t} for r, t in turns])
        assert C.read_back(text) == turns
        assert [C.unescape(text[a:b]) for a, b in marked] == [t for r, t in turns if r == "assistant" and t]


def render(source, **scope):
    return C.compile_template(source)(**scope)[0]


def test_language():
    rows = [{"n": "a"}, {"n": "b"}, {"n": None}]
    assert render("{% for r in rows %}{% if loop.first %}[{% elif loop.last %}]{% else %},{% endif %}{{ r.n | upper }}{% endfor %}", rows=rows) == "[A,B]"
    assert render("{{ x['k'] + '-' + 'é\\n' }}{# no #}{{ 1 + 2 }}", x={"k": "v"}) == "v-é\n12"
    assert render("{% if not (a == 'x' or b) and c != 2 %}yes{% endif %}", a="y", b=False, c=1) == "yes"
    assert render("{{ missing }}{{ '  t ' | trim }}") == "t"


def test_constants_are_folded():
    assert C.fold(C.parse("a{{ 'b' | upper }}{% if 1 == 2 %}c{% elif true %}d{% else %}e{% endif %}{{ 'f' + 'g' }}")) == ("body", ("write", ("const", "aBdfg")))
    tree = C.fold(C.parse("{% if x %}1{% elif 1 == 1 %}2{% else %}3{% endif %}"))
    assert tree == ("body", ("if", ((("name", "x"), ("body", ("write", ("const", "1")))),), ("body", ("write", ("const", "2")))))


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a. }}", "{{ a | nothing }}", "{% do x %}", "{{ a() }}", "{{ 'a' 'b' }}", "{{ }}", "{% endfor %}", "{{ a ; b }}"])
def test_bad_templates(source):
    with pytest.raises(C.TemplateError):
        C.parse(source)


def test_sandbox():
    for source in ("{{ x.__class__ }}", "{{ x.upper }}"):
        with pytest.raises(C.TemplateError):
            render(source, x="text")
    assert render("{{ x.__class__ }}", x={}) == ""


def test_odd_rows(spark):
    rows = [(1, 2, "user", "second", 0), (1, 1, "user", None, 0), (1, 1, "assistant", "first", 0), (2, None, None, "x", 0), (2, 0, "user", "y", 0), (None, 0, "user", "lone", 0),
            (3, 0, "assistant", "long " * 100_000, 0), (4, 0, "user", "twice", 0), (4, 0, "user", "twice", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert C.read_back(got[1].formatted) == [("assistant", "first"), ("user", ""), ("user", "second")]
    assert C.read_back(got[2].formatted) == [("", "x"), ("user", "y")]
    assert C.read_back(got[None].formatted) == [("user", "lone")] and len(C.read_back(got[4].formatted)) == 2
    assert [tuple(m) for m in got[3].marked] == [(9, 500_009)]
    assert C.format_conversations(df.limit(0)).collect() == []


def test_dashes_trim_and_strings_hold_braces():
    assert render("a  {{- x -}}  b {%- if x %} c {% endif -%} \n d {#- no -#} e", x="X") == "aXb c de"
    assert render("a {{ x }} b", x="X") == "a X b"
    assert render("{{ '}}' + \"%}\" }}|{% if x == '%}' %}yes{% endif %}", x="%}") == "}}%}|yes"
    assert render("{{ missing }}{{ x.lacks }}", x={}) == ""


@pytest.mark.parametrize("source", ["{{ " + "(" * 2000 + "1" + ")" * 2000 + " }}", "{{ " + "not " * 2000 + "1 }}", "{% if x %}" * 2000, "{{ " + "a[" * 2000 + "1" + "]" * 2000 + " }}",
                                    "{{ 1" + " + 1" * 100_000 + " }}", "{{ 'open }}"])
def test_deep_templates_are_template_errors(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def test_many_open_quotes_take_no_time():
    assert render("' \" " * 3000) == "' \" " * 3000
