import random

import pytest

from tuplewright.model import SchemaError
from tuplewright.plans.schema_language import Catalog, Subject, Term, digest, lex, next_version, parse, write

GOOD = """
schema 3 // a comment
type sailor
type watch { relation on_duty: sailor | watch#on_duty }
type deck { relation below: deck relation keeper: watch#on_duty permission open = keeper + below->open }
"""


def test_parse():
    s = parse(GOOD)
    assert s.version == 3 and list(s.types) == ["sailor", "watch", "deck"]
    assert s.types["watch"].relations["on_duty"] == (Subject("sailor"), Subject("watch", "on_duty"))
    assert s.types["deck"].permissions["open"] == (Term("keeper"), Term("open", "below"))
    assert s.tuplesets() == {("deck", "below")}


def test_canonical_form_round_trips():
    s = parse(GOOD)
    assert parse(write(s)) == s or write(parse(write(s))) == write(s)
    assert digest(parse(write(s))) == digest(s) and len(digest(s)) == 64


@pytest.mark.parametrize(
    "text,line",
    [
        ("schema 1\ntype user {", 2),
        ("schema x", 1),
        ("type user", 1),
        ("schema 1\ntype type", 2),
        ("schema 1\ntype a {\n relation r: b & c }", 3),
        ("schema 1\ntype a {\n permission p = x - y }", 3),
        ("schema 1\ntype a\ntype a", 3),
        ("schema 1\ntype a { relation r: a\nrelation r: a }", 3),
        ("schema 1\n§", 2),
    ],
)
def test_errors_carry_the_line(text, line):
    with pytest.raises(SchemaError, match=f"line {line}"):
        parse(text)


@pytest.mark.parametrize(
    "body",
    [
        "type a { relation r: b }",
        "type b { relation s: b } type a { relation r: b#t }",
        "type a { permission p = q }",
        "type a { permission p = q permission q = p }",
        "type a { permission p = p }",
        "type u type a { relation r: u permission p = r->x }",
        "type u type g { relation m: u } type a { relation r: g#m permission p = r->m }",
        "type a { relation r: a permission q = r permission p = q->q }",
        "type a { relation r: a | a }",
    ],
)
def test_validation(body):
    with pytest.raises(SchemaError):
        parse("schema 1 " + body)


def test_evolution():
    one = parse("schema 1 type user type doc { relation reader: user relation writer: user }")
    two = parse("schema 2 type user type doc { relation reader: user }")
    assert next_version(None, one) == set()
    assert next_version(one, two) == {("doc", "writer")}
    with pytest.raises(SchemaError):
        next_version(None, two)
    with pytest.raises(SchemaError):
        next_version(two, one)
    catalog = Catalog().evolve(one).evolve(two)
    assert catalog.ids == {"reader": 1, "writer": 2} and catalog.live == {"reader"}
    with pytest.raises(SchemaError):
        catalog.evolve(parse("schema 3 type user type doc { relation reader: user relation writer: user }"))


def test_becoming_a_link_is_guarded():
    one = parse("schema 1 type f { relation below: f relation keeper: f }")
    two = parse("schema 2 type f { relation below: f relation keeper: f permission open = keeper + below->open }")
    assert next_version(one, two) == {("f", "below")}


def test_damaged_text_never_crashes():
    rng = random.Random(0)
    for _ in range(3000):
        at = rng.randrange(len(GOOD))
        text = GOOD[:at] + rng.choice(["", "{", "}", "&", "->", "9", "x", "#"]) + GOOD[at + rng.randrange(3) :]
        try:
            parse(text)
        except SchemaError:
            pass


def test_lines():
    assert [t.line for t in lex("a\n\nb // c\nd")] == [1, 3, 4, 4]
