"""Search of stored tables: filters that reach the scan, one keyset page by a top-k, counts of related rows for that page alone, and signed cursors.

Defined cases: a filter that isn't given filters nothing; null values match no filter and are sorted last; ties are in order of the key;
an empty table gives an empty page. Settings out of bounds and cursors of another search raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keyset_page, severity_rank

MOST_ROWS, MOST_VALUES = 200, 20


@dataclass(frozen=True)
class Criteria:
    """equal: column -> value. among: column -> values. between: column -> (least or None, greatest or None). contains: array column -> element.
    prefix: column -> literal beginning. linked: (table, its column that names the key, whether it must). either: conditions, one of which must (or must not) hold."""

    equal: dict = field(default_factory=dict)
    among: dict = field(default_factory=dict)
    between: dict = field(default_factory=dict)
    contains: dict = field(default_factory=dict)
    prefix: dict = field(default_factory=dict)
    linked: tuple = ()
    either: tuple | None = None
    sort: str = "first_us"
    descending: bool = True
    size: int = 50
    after: tuple | None = None

    def __post_init__(self):
        if not 1 <= self.size <= MOST_ROWS:
            raise ValueError(f"a page has 1 to {MOST_ROWS} rows")
        if any(len(v) > MOST_VALUES for v in self.among.values()):
            raise ValueError(f"at most {MOST_VALUES} values a filter")
        for low, high in self.between.values():
            if any(isinstance(x, datetime) and x.tzinfo is None for x in (low, high)):
                raise ValueError("times need a zone")
            if low is not None and high is not None and low > high:
                raise ValueError("an empty range")


def matching(df: DataFrame, criteria: Criteria, key: str) -> DataFrame:
    """The rows that pass all filters."""
    for c, v in criteria.equal.items():
        df = df.where(F.col(c) == F.lit(v))
    for c, v in criteria.among.items():
        df = df.where(F.col(c).isin(*v)) if v else df
    for c, (low, high) in criteria.between.items():
        df = df if low is None else df.where(F.col(c) >= F.lit(low))
        df = df if high is None else df.where(F.col(c) <= F.lit(high))
    for c, v in criteria.contains.items():
        df = df.where(F.array_contains(c, v))
    for c, v in criteria.prefix.items():
        df = df.where(F.startswith(F.col(c), F.lit(v)))
    if criteria.either:
        conditions, wanted = criteria.either
        found = F.lit(False)
        for x in conditions:
            found = found | F.coalesce(F.expr(x), F.lit(False))
        df = df.where(found if wanted else ~found)
    for other, column, wanted in criteria.linked:
        df = df.join(other.select(F.col(column).alias(key)), key, "left_semi" if wanted else "left_anti")
    return df


def search(df: DataFrame, criteria: Criteria, key: str, counts: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One page (and a row more, if another follows). ``severity`` is sorted by rank. counts: name -> (table, its column that names the key), of page rows only."""
    found = matching(df, criteria, key)
    sort = criteria.sort
    if sort == "severity":
        sort, found = "_rank", found.withColumn("_rank", severity_rank(F.col("severity")))
    page = keyset_page(found, sort, key, criteria.size, criteria.after, criteria.descending)
    for name, (other, column) in (counts or {}).items():
        ids = F.broadcast(page.select(key))  # at most MOST_ROWS + 1 rows
        n = other.select(F.col(column).alias(key)).join(ids, key, "left_semi").groupBy(key).agg(F.count("*").alias(name))
        page = page.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return page.drop("_rank")


def _signature(secret: bytes, body: bytes) -> bytes:
    return hmac.new(secret, body, hashlib.sha256).digest()


def cursor(secret: bytes, resource: str, criteria: Criteria, value: object, key: object) -> str:
    """An opaque name of the place after (value, key), bound to resource, sort and direction. value: a number, text or null."""
    body = json.dumps([resource, criteria.sort, criteria.descending, value, key]).encode()
    return base64.urlsafe_b64encode(_signature(secret, body) + body).decode()


def place(secret: bytes, resource: str, criteria: Criteria, text: str) -> tuple:
    """What ``cursor`` named: (value, key)."""
    try:
        data = base64.urlsafe_b64decode(text.encode())
        if not hmac.compare_digest(data[:32], _signature(secret, data[32:])):
            raise ValueError("not signed here")
        kind, sort, descending, value, key = json.loads(data[32:])
    except (ValueError, TypeError) as e:
        raise ValueError("no valid cursor") from e
    if (kind, sort, descending) != (resource, criteria.sort, criteria.descending):
        raise ValueError("a cursor of another search")
    return value, key
