"""The template language, and an exact round trip of formatted conversations."""

import hashlib
import pickle
import random

import pytest

from tessera.llm import chat, templates
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries
from tessera.llm.templates import Const, Out, Template, TemplateError, escape, unescape
from tests.llm.helpers import CLASHING, SF001
from tests.oracle_harness import compare, duck


@pytest.mark.parametrize(("source", "values", "wanted"), [
    ("a {{ x }} b", {"x": 3}, "a 3 b"),
    ("{{ x ~ 1 + 2 * 3 }}|{{ 7 // 2 - 5 % 3 }}|{{ (1 + 2) * 3 }}|{{ -2 + 1 }}", {"x": "n"}, None),
    ("{% if x > 1 and not y %}p{% elif y %}q{% else %}r{% endif %}", {"x": 1, "y": False}, "r"),
    ("{% if x > 1 and not y %}p{% elif y %}q{% else %}r{% endif %}", {"x": 1, "y": "t"}, "q"),
    ("{% for i in x %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", {"x": ["a", "b"]}, "1a,2b"),
    ("{% for i in x %}{{ i }}{% else %}none{% endfor %}", {"x": []}, "none"),
    ("{% for i in [1, 2, 3] %}{{ loop.previtem | default('-') }}{{ loop.nextitem | default('-') }} {% endfor %}", {}, "-2 13 2- "),
    ("{% set y = 'p' %}{% for i in x %}{% set y = i %}{{ y }}{% endfor %}{{ y }}", {"x": ["q"]}, "qp"),
    ("a  {%- if true -%}  b  {%- endif -%}  c {#- d -#} e", {}, "abce"),
    ("{{ x['k'] }}{{ x.k }}{{ l[1] }}{{ l[-1] }}{{ 'abc'[0] }}", {"x": {"k": "v"}, "l": [1, 2]}, "vv22a"),
    ("{{ 'x' if a is defined else 'y' }}{{ 'x' if b is not none else 'z' }}{{ b }}", {"b": None}, "yz"),
    ("{{ 'b' in 'abc' }}{{ 2 in [1, 2] }}{{ 'k' not in d }}{{ 'a' < 'b' }}", {"d": {"k": 1}}, "truetruefalsetrue"),
    ("{{ x | trim | upper | replace('A', '-') }}{{ l | length }}{{ '\\n}}' }}", {"x": " aba ", "l": [1]}, "-B-1\n}}"),
    ("{{ 'a' or x }}{{ '' or 'b' }}{{ 0 and x }}", {}, "ab0"),
])
def test_rendering(source, values, wanted):
    if wanted is None:
        source, wanted = "{{ 1 + 2 * 3 }}|{{ 7 // 2 - 5 % 3 }}|{{ (1 + 2) * 3 }}|{{ -2 + 1 }}|{{ 'n' ~ 1 }}", "7|1|9|-1|n1"
    assert Template(source).render(**values) == wanted


@pytest.mark.parametrize("source", ["{{ x", "{% if x %}", "{% for x %}{% endfor %}", "{{ x.__class__ }}", "{{ _x }}", "{{ x() }}", "{{ x | eval }}", "{% import x %}", "{{ 'a }}",
                                    "{% endif %}", "{{ 99999999999999999999 }}", "{{ " + "(" * 90 + "1" + ")" * 90 + " }}", "x" * (templates.MAX_SOURCE + 1), "{{ x %}"])
def test_what_does_not_parse(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ x }}", "{{ x.a.b }}", "{{ 1 // y }}", "{{ y + 'a' }}", "{% for i in y %}{% endfor %}", "{{ o }}", "{{ o.real }}", "{{ 'a' < y }}", "{{ d | replace('a') }}"])
def test_what_does_not_render(source):
    with pytest.raises(TemplateError):
        Template(source).render(y=0, o=object(), d="a")


def test_objects_are_closed():
    assert Template("{{ x.upper is defined }}{{ x['__class__'] is defined }}{{ l.append is defined }}").render(x="a", l=[1]) == "falsefalsefalse"


def test_constants_fold():
    assert Template("a{{ 'b' ~ (1 + 1) }}{% if 1 > 2 %}x{% else %}c{% endif %}{{ 'd' | upper }}").tree == (Out(Const("ab2cD")),)
    assert Template("{% if false and x %}y{% endif %}").tree == ()
    assert Template("{% if x %}{{ 1 // 0 }}{% endif %}a").render(x=False) == "a"
    assert len(Template("{% if x %}a{{ 'b' }}c{% endif %}").tree[0].then) == 1


def test_generation_marks_and_pickles():
    made = pickle.loads(pickle.dumps(Template("u{% generation %}a{{ x }}{% if x %}b{% endif %}{% endgeneration %}v")))
    assert list(chat.joined(made.pieces(x="y"))) == [("u", False), ("ayb", True), ("v", False)]


def test_escapes_come_back():
    pick = random.Random(1)
    parts = ["\\", "### ", "#", "##", "</turn>", "</turn", ">", "\n", ": ", ":", " ", "a", "é", "<"]
    for _ in range(3000):
        role, text = ("".join(pick.choice(parts) for _ in range(pick.randint(0, 12))) for _ in range(2))
        assert unescape(escape(text, (chat.OPENER, chat.CLOSER))) == text
        made = Template(chat.TEMPLATE).render(messages=[{"role": role, "text": text}, {"role": "assistant", "text": text}], **chat.VALUES)
        cut = pick.randint(0, len(made))
        assert list(chat.read_turns(iter([made[:cut], made[cut:]]))) == [(role, text), ("assistant", text)]


def test_other_text_is_refused():
    with pytest.raises(TemplateError):
        list(chat.read_turns(iter(["### a: b"])))


def plain(rows):
    by: dict = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn is not None, turn, role or "", text or ""))
    esc = lambda s, *c: escape(s, ("### ", "</turn>", *c))
    out = []
    for conv_id, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        learnt = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"### {esc(t[2], ': ')}: {esc(t[3])}</turn>\n" for t in turns)
        out.append((conv_id, len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(),
                    len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole)))
    return sorted(out, key=str)


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b ### c</turn>\nd: e"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
        (2, 0, None, "x"), (2, None, "assistant", "first"), (None, 1, "system: ", "no id"), (None, None, None, None), (3, 5, "tool\n### ", "</turn>\n### user: hi</turn>\n"),
        (4, 0, "user", "long 日本 " * 40_000), (4, 1, "assistant", "\\" * 60_001), (4, 2, "assistant", "next"), (5, 1, "user", "b"), (5, 1, "user", "a")]


def test_whole_tables_come_back(spark):
    from pyspark.sql import functions as F
    rows = ROWS + [(6, i, ("user", "assistant")[i % 2], f"turn {i} \\") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASHING + ["piece", "learn", "n_turns"]})
    assert sorted((tuple(r) for r in chat.digest(chat.formatted(turns)).collect()), key=str) == plain(rows)


def test_pieces_are_the_text_and_its_mask(spark):
    turns = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    got = chat.formatted(turns).orderBy("piece").collect()
    assert "".join(r["text"] for r in got) == "### user: hi</turn>\n### assistant: a\\\\b \\### c\\</turn>\nd: e</turn>\n### user: </turn>\n"
    assert [r["text"] for r in got if r["learn"]] == ["a\\\\b \\### c\\</turn>\nd: e"]


def test_other_templates(spark):
    turns = spark.createDataFrame(ROWS[:3] + [(9, 0, "user", "")], "conv_id long, turn long, role string, text string")
    got = chat.formatted(turns, "{% for m in messages %}{{ m.text | upper }}{% if not loop.last %}{{ sep }}{% endif %}{% endfor %}", sep="|").orderBy("conv_id", "piece").collect()
    assert [(r["conv_id"], r["text"]) for r in got] == [(1, "HI|A\\B ### C</TURN>\nD: E|"), (9, "")]
    with pytest.raises(TemplateError):
        chat.formatted(turns, "{% for %}")


def test_empty_table(spark):
    assert chat.digest(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_query_equals_its_sql(spark):
    found = queries()["op13_chat"](spark, SF001)
    assert compare(found, duck(SF001), oracle_sql()["op13_chat"])["status"] == "exact"
    probe = [tuple(r) for r in found.collect() if r["conv_id"] == -7]
    assert probe == plain(chat.PROBE)
