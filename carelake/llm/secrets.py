"""Secret scans with multipart credential linking (operator 6).

Each text is scanned once.  Base spans (assignments, access keys, long hex runs)
count by themselves.  Weak candidates are parts that mean little alone: user
names, account numbers and the like (identifiers), long mixed tokens (values),
and service addresses (endpoints).  Spark joins the parts of a text as
intervals: every span reaches ``REACH`` code points to both sides, its scope,
and two parts meet if their scopes do.  A weak candidate is reported only when
its complement is in its scope: a value with an access key or identifier, an
identifier with a secret (assignment, hex run or weak value), an endpoint with
both.

The interval join is an equi-join on (row, cell of the text): a span enters the
cells that its scope touches, at most a few, and a cell holds no more spans than
it has code points, so a text with very many spans spreads over many groups.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import stored, text_udf

# Fixed values of the contract: kinds in this order, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6

# The method's own kinds, after the base ones.
WEAK_KINDS = ("identifier", "value", "endpoint")
IDENTIFIER = (r"(?i:user(?:name)?|login|account(?:_?id)?|client_?id|tenant(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?"
              r"[A-Za-z0-9@._-]{3,}")
IDENTIFIER_WORDS = ("user", "login", "account", "client", "tenant")
VALUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}|(?:[a-z0-9-]+\.)+(?:com|net|org|io|internal)(?::\d{2,5})"
REACH = 200
KINDS = BASE_KINDS + WEAK_KINDS

SPANS = "array<struct<kind: int, begin: int, stop: int>>"

_assign, _access, _hex = re.compile(ASSIGN, re.A), re.compile(ACCESS), re.compile(HEX)
_identifier, _value, _endpoint = re.compile(IDENTIFIER, re.A), re.compile(VALUE, re.A), re.compile(ENDPOINT, re.A)


def _mixed(token: str) -> bool:
    """Long tokens that look drawn at random: digits and letters of both cases."""
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, stop) of all base spans and weak candidates, by begin, then kind.
    A weak candidate inside a base span is that span, and no candidate."""
    lower = text.lower()
    spans = []
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [(0, *m.span()) for m in _assign.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in _access.finditer(text)]
    spans += [(2, *m.span()) for m in _hex.finditer(text)]
    weak = []
    if any(w in lower for w in IDENTIFIER_WORDS):
        weak += [(3, *m.span()) for m in _identifier.finditer(text)]
    weak += [(4, *m.span()) for m in _value.finditer(text) if _mixed(m[0])]
    if "://" in text or ":" in text and "." in text:
        weak += [(5, *m.span()) for m in _endpoint.finditer(text)]
    base = sorted(spans, key=lambda s: s[1])
    stops, most = [], 0
    for s in base:
        most = max(most, s[2])
        stops.append(most)
    from bisect import bisect_left

    begins = [s[1] for s in base]
    for s in weak:
        i = bisect_left(begins, s[2])  # base spans that begin before the candidate stops
        if not i or stops[i - 1] <= s[1]:
            spans.append(s)
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def _scanned(texts: pa.Array) -> pa.Array:
    found = [scan(x) for x in texts.to_pylist()]
    flat = [s for own in found for s in own]
    at, n = [0], 0
    for own in found:
        n += len(own)
        at.append(n)
    columns = [pa.array([s[i] for s in flat], pa.int32()) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()),
                                    pa.StructArray.from_arrays(columns, ["kind", "begin", "stop"]))


def linked_parts(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak spans of ``spans`` (row, kind, begin, stop) whose complement is in scope.

    Two spans meet if they are at most ``reach`` code points apart: one's scope
    touches the other's own interval."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))
    weak = spans.where(F.col("kind") >= len(BASE_KINDS)).withColumn(
        "cell", cells(F.col("begin") - reach, F.col("stop") + reach))
    part = spans.select(F.col("row").alias("row_"), F.col("kind").alias("kind_"), F.col("begin").alias("begin_"),
                        F.col("stop").alias("stop_"), cells(F.col("begin"), F.col("stop")).alias("cell_"))
    near = ((F.col("row") == F.col("row_")) & (F.col("cell") == F.col("cell_"))
            & (F.col("begin_") <= F.col("stop") + reach) & (F.col("stop_") >= F.col("begin") - reach)
            & ((F.col("kind") != F.col("kind_")) | (F.col("begin") != F.col("begin_"))))
    names = {k: i for i, k in enumerate(KINDS)}
    is_name = F.col("kind_").isin(names["access"], names["identifier"])
    is_secret = F.col("kind_").isin(names["assign"], names["hex"], names["value"])
    met = weak.join(part, near).groupBy("row", "kind", "begin", "stop").agg(
        F.max(is_name).alias("name"), F.max(is_secret).alias("secret"))
    return met.where(F.when(F.col("kind") == names["value"], F.col("name"))
                     .when(F.col("kind") == names["identifier"], F.col("secret"))
                     .otherwise(F.col("name") & F.col("secret"))).select("row", "kind", "begin", "stop")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, base (array of base spans) and spans (with
    the linked weak ones), by begin, then kind.

    A null text counts as empty and has no spans; every row is scanned by itself,
    so repeated rows, ties and null keys give a row each.  Other columns are not
    read.  An empty table gives an empty table.  Places are code points, stops
    exclusive."""
    found = stored(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"),
                               text_udf(_scanned, SPANS)(F.col(text)).alias("found")), "op6-spans")
    weak = found.where(F.exists("found", lambda s: s["kind"] >= len(BASE_KINDS)))
    linked = linked_parts(weak.select("row", F.explode("found").alias("s")).select("row", "s.*"))
    added = linked.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("kind", "begin", "stop")).alias("added"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE_KINDS))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["begin"], s["kind"], s["stop"])))
    none = F.array().cast(SPANS)
    return found.join(added, F.col("row") == F.col("of"), "left").select(
        "key", order(base).alias("base"), order(F.concat(base, F.coalesce("added", none))).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Contract of op6: one row per document with counts and spans."""
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["begin"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return find_secrets(docs).select(
        F.col("key").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
