"""Secret scan with multipart linking: parts of one credential that stand near each other within a scope.

Strong findings (``assign``, ``access``, ``hex``) count by themselves.  Weak candidates say little alone: an identifier (``user``), a short
or opaque value (``secret``), an address (``endpoint``).  A scope is a stretch of lines without a blank one between them.  Parts are
interval-joined with scopes by document, block of positions and containment; within a scope a weak candidate is reported only
if a complementary part starts at most ``reach`` code points away:

* a weak secret needs an identifier, an access id or an endpoint,
* an identifier needs a secret, weak or strong (assign or hex),
* an endpoint needs such a secret too.

No pairs are made: blocks of ``reach`` code points also get the parts of the blocks beside them, and one window over a block's parts
tells what stands near each, so a group has at most 3 * reach parts.  Only the places of parts are shuffled, never texts.

Spans are in code points, ends exclusive.  Weak candidates that overlap a strong span or an earlier weak one are none.  Null and empty texts have no spans;
texts may be of any length; repeated ids and rows are judged one by one, null ids too; equal starts go by kind as listed in KINDS.  An empty table gives no
rows.  Columns besides doc_id and text are kept by ``scan``, but for those named as its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import stage, table

#: Kinds of spans in the order in which those of one start are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "user", "secret", "endpoint")
#: Code points between the starts of parts that belong together.
REACH = 300
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
USER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|e?mail)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{2,}""", re.IGNORECASE | re.ASCII)
SHORT = re.compile(r"""\b(?:pass(?:phrase|code)?|pwd|credentials?|private_?key|signature|auth(?:orization)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:host(?:name)?|server|endpoint|base_?url|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{3,}""", re.IGNORECASE | re.ASCII)
BREAK = re.compile(r"\n[\x20\t\r\x0b\x0c]*\n\s*")
SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
SCOPE = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
Span = tuple[str, int, int]


def opaque(token: str) -> bool:
    """Whether a token mixes digits, capitals and small letters, as keys do and words do not."""
    return any(c.isdigit() for c in token) and any("A" <= c <= "Z" for c in token) and any("a" <= c <= "z" for c in token)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def parts_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """(strong spans, weak candidates) of one text, each by start and kind."""
    if not text:
        return [], []
    strong, weak = [], []
    for m in ASSIGN.finditer(text):
        (strong if len(m[2]) >= ASSIGN_CHARS else weak).append(("assign" if len(m[2]) >= ASSIGN_CHARS else "secret", *m.span()))
    strong += [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
    weak += [("user", *m.span()) for m in USER.finditer(text)] + [("secret", *m.span()) for m in SHORT.finditer(text)]
    weak += [("secret", *m.span()) for m in OPAQUE.finditer(text) if opaque(m[0])] + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not weak:
        return _sorted(strong), []
    stay, taken = [], 0
    covered = sorted((s, e) for _, s, e in strong)
    at = 0
    for kind, s, e in _sorted(weak):
        while at < len(covered) and covered[at][1] <= s:
            at += 1
        if s >= taken and not (at < len(covered) and covered[at][0] < e):
            stay.append((kind, s, e))
            taken = e
    return _sorted(strong), stay


def scopes_of(text: str) -> list[tuple[int, int]]:
    """Stretches of lines without a blank line, which tile the text: the break belongs to the scope before it."""
    ends = [m.end() for m in BREAK.finditer(text) if m.end() < len(text)]
    return list(zip([0, *ends], [*ends, len(text)], strict=True))


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with row (a number of its own), strong, weak and, where there are weak ones, scopes."""
    docs = docs.drop("row", "strong", "weak", "scopes", "spans")
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.ArrayType(k, False)) for c, k in (("strong", SPAN), ("weak", SPAN), ("scopes", SCOPE)))])
    span = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]))
    scope = pa.list_(pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strong, weak, scopes = [], [], []
            for t in b[text].to_pylist():
                s, w = parts_of(t)
                strong.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in s])
                weak.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in w])
                scopes.append([{"start": x, "end": y} for x, y in scopes_of(t)] if w else [])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(strong, span), pa.array(weak, span), pa.array(scopes, scope)], names=[*kept, "strong", "weak", "scopes"])

    return docs.select(*kept, text).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _block(at: Column, reach: int) -> Column:
    return F.floor(at / reach)


def scoped(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, scope, kind, start, end, strong): the parts of rows that have weak candidates, each with the scope that holds its start.

    An interval join: a scope stands in every block of positions that it touches, a part in that of its start."""
    some = found.where("size(weak) > 0")
    spans = lambda c: some.select("row", F.explode(c).alias("s"), F.lit(c == "strong").alias("strong")).select("row", "s.*", "strong")
    points = spans("strong").unionByName(spans("weak")).withColumn("block", _block(F.col("start"), reach))
    held = some.select("row", F.posexplode("scopes").alias("scope", "s")).select("row", "scope", F.col("s.start").alias("scope_start"), F.col("s.end").alias("scope_end"))
    held = held.withColumn("block", F.explode(F.sequence(_block(F.col("scope_start"), reach), _block(F.col("scope_end") - 1, reach))))
    inside = (F.col("start") >= F.col("scope_start")) & (F.col("start") < F.col("scope_end"))
    return points.join(held, ["row", "block"]).where(inside).select("row", "scope", "kind", "start", "end", "strong")


def linked(placed: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, end) of the weak candidates of scoped parts beside which a complementary part stands."""
    home = _block(F.col("start"), reach)
    halo = placed.withColumn("block", F.explode(F.array(home - 1, home, home + 1)))
    near = Window.partitionBy("row", "scope", "block").orderBy("start").rangeBetween(-reach, reach)
    there = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    wanted = F.when(F.col("kind") == "secret", there("user", "access", "endpoint")).otherwise(there("secret", "assign", "hex"))
    return halo.withColumn("met", wanted).where(F.col("met") & ~F.col("strong") & (F.col("block") == home)).select("row", "kind", "start", "end")


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """docs without the text, with strong and spans: strong spans alone, and with the linked weak candidates, (kind, start, end) by start and kind."""
    found = stage(parts(docs, text), "parts")
    links = linked(scoped(found, reach), reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))  # of one text
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat("strong", F.coalesce("more", F.array().cast(T.ArrayType(SPAN, False)))), lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    alone = found.where("size(weak) = 0").withColumn("spans", F.col("strong"))
    met = found.where("size(weak) > 0").join(links, "row", "left").withColumn("spans", spans).drop("more")
    return alone.unionByName(met).drop("row", "weak", "scopes")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("strong"), 256).alias("base_sha256"), listed("spans").alias("spans"))
