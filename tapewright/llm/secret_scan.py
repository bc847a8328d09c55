r"""Secret scan with multipart credential linking.

Every text is searched for parts of credentials, each an interval of code
points with a role:

* access identifiers: ``access`` (AKIA and more, 20 characters at least), and
  weakly ``account`` (an assigned user, account or client name, or an AKIA
  identifier that is too short);
* secrets: ``assign`` (a value of 6 characters or more assigned to a name such
  as password), ``hex`` (24 or more lower-case hexadecimal digits), and weakly
  ``opaque`` (a run of exactly 40 characters of the base64 alphabet with digits
  and both cases, also right after a name and '='), ``short`` (an assigned value
  of less than 6 characters) and ``secret_key`` (a value assigned to a secret
  access key, which is no account name);
* endpoints, always weak: ``endpoint`` (a URL, or an assigned host, in any case).

The strong kinds are always reported. A weak part is reported only if a part
that completes it lies in its scope, that is, overlaps the interval that reaches
SCOPE characters to both sides of it. A secret is completed by an access
identifier or an endpoint, and each of these by a secret; a name beside a link
is no credential. Parts and scopes are met by an interval
join in Spark: both are dealt out by document and by cells of CELL characters,
so that a document with very many parts is spread over many keys.

Spans of a kind don't overlap each other; the leftmost match wins. A weak part
inside a strong one is left out.

Edge cases: a null text is searched as an empty one; each row gives one row,
also for repeated rows and null ids; extra columns are ignored, whatever their
names; an empty table gives an empty table. Masking cuts each text once, so a
text of very many spans takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, hidden, own, shown, slices_by_bytes, text_key

SCOPE = 200
CELL = 512
#: Up to so many spans in all texts are broadcast when these are masked; more are joined by a shuffle.
BROADCAST_SPANS = 200_000
#: Kinds in the order in which spans of the same start are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "account", "opaque", "short", "endpoint", "secret_key")
ROLE_OF = {"assign": "secret", "access": "access", "hex": "secret", "account": "access", "opaque": "secret", "short": "secret", "endpoint": "endpoint", "secret_key": "secret"}

# Fixed patterns of the strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Patterns of the weak kinds.
ACCOUNT = re.compile(r"""(?:user(?:name)?|account|client|(?<!secret)(?<!secret[_\x20-])access)(?:[_-]?(?:id|name|key))?["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{4,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"""(?:(?<![A-Za-z0-9+/=_.-])|(?<=[A-Za-z0-9_"'\x20:\])]=))[A-Za-z0-9+/]{40}(?!\.*[A-Za-z0-9+/_-])""")
SECRET_KEY = re.compile(r"""secret[_\x20-]?access[_\x20-]?key["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,9}://[^\s"'<>]+|(?:host|endpoint|server)(?:name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9.-]+(?::[0-9]+)?""", re.IGNORECASE | re.ASCII)
ASSIGNED_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCOUNT_NAMES = ("user", "account", "client", "access")


def parts_of(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of all parts of a text, weak ones that nothing could complete left out."""
    if not text:
        return []
    lower = text.lower()
    strong, weak = [], []
    if any(name in lower for name in ASSIGNED_NAMES):
        for m in ASSIGN.finditer(text):
            (strong if len(m[2]) >= 6 else weak).append((m.start(), 0 if len(m[2]) >= 6 else 5, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            (strong if m.end() - m.start() >= 20 else weak).append((m.start(), 1 if m.end() - m.start() >= 20 else 3, m.end()))
    strong += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(name in lower for name in ACCOUNT_NAMES):
        weak += [(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)]
    if "secret" in lower and "access" in lower:
        weak += [(m.start(), 7, m.end()) for m in SECRET_KEY.finditer(text)]
    if "://" in text or "host" in lower or "endpoint" in lower or "server" in lower:
        weak += [(m.start(), 6, m.end()) for m in ENDPOINT.finditer(text)]
    if strong or weak:
        weak += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if any(c.isdigit() for c in m[0]) and m[0].upper() != m[0] != m[0].lower()]
    strong.sort()
    kept, k, reach = [], 0, -1
    for part in sorted(set(weak)):
        while k < len(strong) and strong[k][0] <= part[0]:
            reach = max(reach, strong[k][2])
            k += 1
        if part[2] > reach:
            kept.append(part)
    if len({ROLE_OF[KINDS[p[1]]] for p in strong + kept}) < 2:
        kept = []
    return sorted(strong + kept)


PART = "array<struct<start:bigint,rank:int,end:bigint>>"


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: row_id (distinct), id (the document's) and parts of its text by start."""
    kind = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, 2):
            ends, rows = [0], []
            for text in batch.column(2).to_pylist():
                rows += parts_of(text)
                ends.append(len(rows))
            flat = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(kind)], fields=list(kind))
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], ["row_id", "id", "parts"])

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"row_id bigint, id {kind_of_id}, parts {PART}")


def _role(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLE_OF[k]) for k in KINDS]), rank + 1)


def _in_cells(parts: DataFrame, reach: int) -> DataFrame:
    """Each part once for each cell that it, widened by reach, touches."""
    first, last = F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / CELL), F.floor((F.col("end") - 1 + reach) / CELL)
    return parts.withColumn("cell", F.explode(F.sequence(first, last)))


def complete_weak_parts(found: DataFrame) -> DataFrame:
    """The weak parts (row_id, start, rank, end) that have a complementary part in their scope: of another role, and one of both a secret."""
    parts = found.select("row_id", F.inline("parts")).withColumn("role", _role(F.col("rank")))
    weak, other = _in_cells(parts.filter("rank > 2"), SCOPE).alias("w"), _in_cells(parts, 0).alias("o")
    meets = (
        (F.col("w.row_id") == F.col("o.row_id"))
        & (F.col("w.cell") == F.col("o.cell"))
        & (F.col("w.role") != F.col("o.role"))
        & ((F.col("w.role") == "secret") | (F.col("o.role") == "secret"))
        & (F.col("o.start") < F.col("w.end") + SCOPE)
        & (F.col("o.end") > F.col("w.start") - SCOPE)
    )
    return weak.join(other, meets, "left_semi").groupBy("row_id", "start", "rank", "end").agg(F.lit(1).alias("met")).drop("met")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id; ``base``, the strong spans; ``spans``, these and the completed weak ones.

    Both are arrays of (start, rank, end) by start, then rank; KINDS[rank] is the kind.
    """
    found = Scratch(docs.sparkSession).cut(find_parts(docs, id_col, text_col), "parts")
    added = complete_weak_parts(found).groupBy("row_id").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    base = F.filter("parts", lambda p: p["rank"] < 3)
    return found.join(added, "row_id", "left").select(
        F.col("id").alias(id_col), base.alias("base"), F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(PART)))).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.element_at(kinds, p["rank"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans, given by start, replaced by a mark."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += (text[at:start], mark)
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all found spans masked in the text. What is found depends on the text alone, so texts are met by a 128-bit key."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    found = scan(keyed, "key", "text").filter("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("spans"))
    found = scratch.cut(found.select("key", F.transform("spans", lambda p: p["start"]).alias("starts"), F.transform("spans", lambda p: p["end"]).alias("ends")), "spans")
    short = found.agg(F.coalesce(F.sum(F.size("starts") + 1), F.lit(0))).first()[0] <= BROADCAST_SPANS
    rows, text = hidden(docs), own(docs, text_col)
    met = rows.withColumn("key", text_key(F.col(text))).join(F.broadcast(found) if short else found, "key", "left").select(*rows.columns, "starts", "ends")
    names, at = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, at):
            columns = list(batch.columns[:-2])
            if batch.column(batch.num_columns - 2).null_count < batch.num_rows:
                starts, ends = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
                texts = [t if s is None else masked(t, list(zip(s, e))) for t, s, e in zip(columns[at].to_pylist(), starts, ends)]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return shown(met.mapInArrow(run, rows.schema), docs)


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda rank: F.size(F.filter("base", lambda p: p["rank"] == rank)).cast("long")
    return scanned.select(
        id_col,
        *[count(rank).alias(f"n_{KINDS[rank]}") for rank in range(3)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
