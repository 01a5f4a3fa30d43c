"""The query language: words, "phrases", (any, of) groups, and a leading - for what must not occur."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD = re.compile(r"[^\s(\"]*")
BLANK = re.compile(r"\s")


class QueryError(ValueError):
    """``kind`` and ``pos``, the index of the character at fault."""

    def __init__(self, kind: str, pos: int):
        super().__init__(f"{kind} at {pos}")
        self.kind, self.pos = kind, pos


@dataclass(frozen=True)
class Limits:
    bytes: int = 10_240
    clauses: int = 256
    members: int = 64


@dataclass(frozen=True)
class Clause:
    kind: str  # term, phrase or anyof
    negated: bool = False
    text: str = ""
    members: tuple[str, ...] = field(default=())


def group_members(body: str) -> tuple[str, ...]:
    """What stands between commas, blanks of any kind as spaces, without empty ones."""
    plain = BLANK.sub(" ", body)
    return tuple(m for m in (part.strip() for part in plain.split(",")) if m)


def parse(query: str, limits: Limits = Limits()) -> list[Clause]:
    """The clauses in order.  There are no escapes and no nesting; an empty query has no clause."""
    if len(query.encode()) > limits.bytes:
        raise QueryError("QueryTooLong", 0)
    clauses: list[Clause] = []
    at, end = 0, len(query)
    while at < end:
        if query[at].isspace():
            at += 1
            continue
        negated = query[at] == "-"
        if negated:
            if at + 1 == end or query[at + 1].isspace():
                raise QueryError("TrailingDash", at)
            at += 1
        opener = query[at]
        if opener in '("':
            close = query.find(")" if opener == "(" else '"', at + 1)
            if close < 0:
                raise QueryError("UnclosedGroup" if opener == "(" else "UnclosedQuote", at)
            body = query[at + 1 : close]
            if opener == '"':
                clauses.append(Clause("phrase", negated, body.strip()))
            else:
                members = group_members(body)
                if not members:
                    raise QueryError("EmptyAnyOfGroup", at)
                if len(members) > limits.members:
                    raise QueryError("AnyOfGroupTooLarge", at)
                clauses.append(Clause("anyof", negated, members=members))
            at = close + 1
            continue
        stop = WORD.match(query, at).end()
        clauses.append(Clause("term", negated, query[at:stop]))
        at = stop
    if len(clauses) > limits.clauses:
        raise QueryError("TooManyClauses", 0)
    return clauses
