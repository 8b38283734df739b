"""Names, records and errors that everything shares."""

from __future__ import annotations

import re
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import types as T

#: Largest integer node.
LARGEST_NODE = 2**31 - 10

EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
TUPLE_COLUMNS = ("object_type", "object_id", "relation", "subject_type", "subject_id", "subject_relation")
TUPLE = T.StructType([T.StructField(c, T.StringType()) for c in TUPLE_COLUMNS])
LOG = T.StructType(
    [
        T.StructField("lsn", T.LongType()),
        T.StructField("commit_ts", T.TimestampType()),
        T.StructField("txn_lsn", T.LongType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("event", T.StringType()),
        *TUPLE.fields,
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("detail", T.StringType()),
    ]
)
EVENTS = ("add", "remove", "schema", "epoch", "erase")


class StoreError(Exception):
    """Any failure of this library."""


class SchemaError(StoreError, ValueError):
    """A schema document, a change of schema, or a tuple or question that the schema does not allow."""


class CheckDepthError(StoreError):
    """A check that neither found a grant nor searched everything within the depth limit."""


class StaleReadError(StoreError):
    """The state read is older than the token asks for."""


class TokenLostError(StoreError):
    """The write that the token names did not survive a change of writer."""


class HistoryExpiredError(StoreError):
    """The past asked for lies before what is kept, or before an erasure."""


class CorruptLogError(StoreError):
    """Segments that don't follow on each other, or don't match their digests."""


class ClosedError(StoreError):
    """Use after close."""


class KeyKindError(StoreError, TypeError):
    """Integer and string keys in one graph."""


class Token(NamedTuple):
    """A position in the log; tokens are ordered."""

    epoch: int
    lsn: int


class Tuple(NamedTuple):
    object_type: str
    object_id: str
    relation: str
    subject_type: str
    subject_id: str
    subject_relation: str


_NAME = re.compile(r"[^:]+:.+", re.S)


def split_object(name: str) -> tuple[str, str]:
    """type and id of a name type:id, split at the first colon."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise SchemaError(f"not an object name of the form type:id: {name!r}")
    kind, _, rest = name.partition(":")
    return kind, rest


def make_tuple(object: str, relation: str, subject: str, subject_relation: str | None = None) -> Tuple:
    return Tuple(*split_object(object), relation, *split_object(subject), subject_relation or "")


def check_node(node) -> int:
    if isinstance(node, bool) or not isinstance(node, int):
        raise TypeError(f"a node is an int, not {type(node).__name__}")
    if not 0 <= node <= LARGEST_NODE:
        raise ValueError(f"node out of range 0 to {LARGEST_NODE}: {node}")
    return node


def aware(when: datetime) -> datetime:
    if when.tzinfo is None:
        raise ValueError("the time needs a time zone")
    return when


def token_position(token: Token, tenures: list[tuple[int, int, int | None]], current: Token) -> int:
    """The lsn that a state must have reached to satisfy token.

    tenures: (epoch, first lsn, last lsn handed over or None) in order. A token of an epoch that is gone is lost if
    its lsn is beyond what was handed over to the first later tenure.
    """
    if token.epoch > current.epoch:
        raise StaleReadError(f"epoch {token.epoch} is newer than {current.epoch}")
    if token.epoch < current.epoch:
        later = [t for t in tenures if t[0] > token.epoch]
        if later and token.lsn > later[0][1] - 1:
            raise TokenLostError(f"{token} was not handed over to epoch {later[0][0]}")
    if token.lsn > current.lsn:
        raise StaleReadError(f"lsn {token.lsn} is after {current.lsn}")
    return token.lsn
