"""The permission schema language: text to rules, and rules to rows.

    schema 1
    type sailor
    type watch { relation on_duty: sailor | watch#on_duty }
    type deck { relation below: deck relation keeper: watch#on_duty permission open = keeper + below->open }

Permissions are unions of terms: a name of the same type, or relation->name, asked of what the relation's plain
subjects reach. Comments run from // to the end of the line.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from ..model import SchemaError

KEYWORDS = frozenset(("schema", "type", "relation", "permission"))
_TOKEN = re.compile(r"(?P<space>[ \t\r]+|//[^\n]*)|(?P<line>\n)|(?P<arrow>->)|(?P<mark>[{}:|#=+])|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)")
LARGEST_RELATION_ID = 65_535


@dataclass(frozen=True)
class Lexeme:
    kind: str
    text: str
    line: int


def lex(text: str) -> list[Lexeme]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            c = text[at]
            why = "reserved" if c in "&-" else "unexpected"
            raise SchemaError(f"line {line}: {why} character {c!r}")
        at = m.end()
        if m.lastgroup == "line":
            line += 1
        elif m.lastgroup != "space":
            out.append(Lexeme(m.lastgroup, m[0], line))
    out.append(Lexeme("end", "", line))
    return out


@dataclass(frozen=True)
class Subject:
    type: str
    relation: str = ""


@dataclass(frozen=True)
class Term:
    """name on the same object, or name on what `through` leads to."""

    name: str
    through: str = ""


@dataclass
class Type:
    name: str
    relations: dict[str, tuple[Subject, ...]] = field(default_factory=dict)
    permissions: dict[str, tuple[Term, ...]] = field(default_factory=dict)

    def has(self, name: str) -> bool:
        return name in self.relations or name in self.permissions


@dataclass
class Schema:
    version: int
    types: dict[str, Type]

    def type(self, name: str) -> Type:
        if name not in self.types:
            raise SchemaError(f"no type {name!r}")
        return self.types[name]

    def define(self, type_: str, name: str) -> None:
        if not self.type(type_).has(name):
            raise SchemaError(f"type {type_!r} has no relation or permission {name!r}")

    def allows(self, type_: str, relation: str, subject: Subject) -> bool:
        relations = self.type(type_).relations
        if relation not in relations:
            raise SchemaError(f"type {type_!r} has no relation {relation!r}")
        return subject in relations[relation]

    def tuplesets(self) -> set[tuple[str, str]]:
        """(type, relation) used to the left of an arrow."""
        return {(t.name, term.through) for t in self.types.values() for terms in t.permissions.values() for term in terms if term.through}

    def allowed_rows(self) -> list[tuple[str, str, str, str]]:
        return [(t.name, r, s.type, s.relation) for t in self.types.values() for r, subjects in t.relations.items() for s in subjects]

    def rule_rows(self) -> list[tuple[str, str, str, str]]:
        """(type, permission, name, through) of every term."""
        return [(t.name, p, term.name, term.through) for t in self.types.values() for p, terms in t.permissions.items() for term in terms]


class _Parser:
    def __init__(self, text: str):
        self.lexemes, self.at = lex(text), 0

    def fail(self, what: str):
        now = self.lexemes[self.at]
        raise SchemaError(f"line {now.line}: expected {what}, found {now.text!r}" if now.text else f"line {now.line}: expected {what}, found the end")

    def take(self, text: str) -> None:
        if self.lexemes[self.at].text != text:
            self.fail(repr(text))
        self.at += 1

    def maybe(self, text: str) -> bool:
        if self.lexemes[self.at].text == text:
            self.at += 1
            return True
        return False

    def name(self, what: str) -> str:
        now = self.lexemes[self.at]
        if now.kind != "name":
            self.fail(what)
        if now.text in KEYWORDS:
            raise SchemaError(f"line {now.line}: {now.text!r} is a keyword, not {what}")
        self.at += 1
        return now.text

    def schema(self) -> Schema:
        self.take("schema")
        number = self.lexemes[self.at]
        if number.kind != "number":
            self.fail("a version number")
        self.at += 1
        version = int(number.text)
        if not 1 <= version < 2**31:
            raise SchemaError(f"line {number.line}: version out of range")
        types: dict[str, Type] = {}
        while self.lexemes[self.at].kind != "end":
            line = self.lexemes[self.at].line
            one = self.type()
            if one.name in types:
                raise SchemaError(f"line {line}: type {one.name!r} is defined twice")
            types[one.name] = one
        return Schema(version, types)

    def type(self) -> Type:
        self.take("type")
        out = Type(self.name("a type name"))
        if self.maybe("{"):
            while not self.maybe("}"):
                now = self.lexemes[self.at]
                if now.text not in ("relation", "permission"):
                    self.fail("'relation', 'permission' or '}'")
                self.at += 1
                name = self.name(f"a {now.text} name")
                if out.has(name):
                    raise SchemaError(f"line {now.line}: {name!r} is defined twice")
                if now.text == "relation":
                    self.take(":")
                    out.relations[name] = self.several(self.subject, "|", now.line)
                else:
                    self.take("=")
                    out.permissions[name] = self.several(self.term, "+", now.line)
        return out

    def several(self, one, between: str, line: int) -> tuple:
        found = [one()]
        while self.maybe(between):
            found.append(one())
        if len(set(found)) < len(found):
            raise SchemaError(f"line {line}: the same alternative twice")
        return tuple(found)

    def subject(self) -> Subject:
        kind = self.name("a subject type")
        return Subject(kind, self.name("a relation") if self.maybe("#") else "")

    def term(self) -> Term:
        first = self.name("a relation or permission")
        return Term(self.name("a relation or permission"), first) if self.maybe("->") else Term(first)


def validate(schema: Schema) -> Schema:
    for t in schema.types.values():
        for r, subjects in t.relations.items():
            for s in subjects:
                if s.type not in schema.types:
                    raise SchemaError(f"{t.name}.{r}: no type {s.type!r}")
                if s.relation and s.relation not in schema.types[s.type].relations:
                    raise SchemaError(f"{t.name}.{r}: type {s.type!r} has no relation {s.relation!r}")
        for p, terms in t.permissions.items():
            for term in terms:
                if not term.through:
                    if not t.has(term.name):
                        raise SchemaError(f"{t.name}.{p}: no relation or permission {term.name!r}")
                    continue
                if term.through not in t.relations:
                    raise SchemaError(f"{t.name}.{p}: an arrow goes through a relation, and {term.through!r} is none")
                for s in t.relations[term.through]:
                    if s.relation:
                        raise SchemaError(f"{t.name}.{p}: {term.through!r} accepts sets of subjects, so no arrow can go through it")
                    if not schema.types[s.type].has(term.name):
                        raise SchemaError(f"{t.name}.{p}: type {s.type!r} has no {term.name!r}")
        _acyclic(t)
    return schema


def _acyclic(t: Type) -> None:
    """Terms without an arrow may not lead a permission back to itself."""
    state: dict[str, int] = {}
    for root in t.permissions:
        todo = [(root, iter(t.permissions[root]))] if root not in state else []
        if todo:
            state[root] = 1
        while todo:
            name, terms = todo[-1]
            for term in terms:
                if term.through or term.name not in t.permissions:
                    continue
                if state.get(term.name) == 1:
                    raise SchemaError(f"{t.name}.{name}: defined in terms of itself")
                if term.name not in state:
                    state[term.name] = 1
                    todo.append((term.name, iter(t.permissions[term.name])))
                    break
            else:
                state[name] = 2
                todo.pop()


def parse(text: str) -> Schema:
    return validate(_Parser(text).schema())


def write(schema: Schema) -> str:
    """The canonical text: types and members by name, alternatives in order."""
    lines = [f"schema {schema.version}"]
    for name in sorted(schema.types):
        t = schema.types[name]
        members = [f"  relation {r}: " + " | ".join(s.type + (f"#{s.relation}" if s.relation else "") for s in t.relations[r]) for r in sorted(t.relations)]
        members += [f"  permission {p} = " + " + ".join((f"{x.through}->" if x.through else "") + x.name for x in t.permissions[p]) for p in sorted(t.permissions)]
        lines += [f"type {name} {{", *members, "}"] if members else [f"type {name}"]
    return "\n".join(lines) + "\n"


def digest(schema: Schema) -> str:
    return hashlib.sha256(write(schema).encode()).hexdigest()


@dataclass
class Catalog:
    """Relation ids over all versions: only added, never used again."""

    ids: dict[str, int] = field(default_factory=dict)
    live: set[str] = field(default_factory=set)

    def evolve(self, schema: Schema) -> Catalog:
        names = {r for t in schema.types.values() for r in t.relations}
        retired = set(self.ids) - self.live
        if again := sorted(names & retired):
            raise SchemaError(f"relation {again[0]!r} was removed and its name can't come back")
        ids = dict(self.ids)
        for name in sorted(names):
            ids.setdefault(name, len(ids) + 1)
        if len(ids) > LARGEST_RELATION_ID:
            raise SchemaError("too many relations")
        return Catalog(ids, names)


def next_version(old: Schema | None, new: Schema) -> set[tuple[str, str]]:
    """Checks the step from old to new; returns the (type, relation) pairs that may hold no tuples for it."""
    want = old.version + 1 if old else 1
    if new.version != want:
        raise SchemaError(f"version {new.version} can't follow; it has to be {want}")
    if old is None:
        return set()
    before = {(t.name, r): set(s) for t in old.types.values() for r, s in t.relations.items()}
    after = {(t.name, r) for t in new.types.values() for r in t.relations}
    return (before.keys() - after) | ((old.tuplesets() ^ new.tuplesets()) & before.keys())
