"""Secret scans with multipart credential linking, in DataFrame operations only.

Each kind of part has a pattern. Positions come from splitting a text at its matches: a
running sum over the lengths of gaps and matches gives code points. The kinds
``assign``, ``access`` and ``hex`` are reported wherever they stand. The kinds ``id``,
``key``, ``url`` and ``host`` are weak: on their own they are mostly harmless. Within a scope
(a stretch of ``REACH`` code points of one text) identifiers are interval-joined with
secrets and endpoints, and a weak part is reported only where complementary parts
co-occur: an identifier and a secret of which one is not weak, or, if both are weak,
with an endpoint beside them.

Every pattern is linear in a text's length and needs no recursion: repetitions are of
single characters or possessive, and a run that can't match is looked at from its first
character only. Very long texts are scanned whole like any others.

Defined results: a null text counts as empty and has no parts; rows are told apart even
if they repeat an id or are the same throughout; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import stored, text_or_empty

REACH = 256


@dataclass(frozen=True)
class Part:
    kind: str
    role: str
    weak: bool
    pattern: str
    #: Group and length in code points that a match must have to count.
    group: int = 0
    least: int = 1


# The patterns of the contract. A run of 16 or of 4 + 14 characters is found
# as such, since no shorter run can hide a longer one.
ASSIGN = Part("assign", "secret", False, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
ACCESS = Part("access", "identifier", False, r"AKIA[A-Z0-9]{14,}")
HEX = Part("hex", "secret", False, r"[0-9a-f]{16,}")
ID = Part("id", "identifier", True, r"""(?i)(client_?id|access_?key_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
KEY = Part("key", "secret", True, r"[A-Za-z0-9+/_-]{32,}={0,2}")
URL = Part("url", "endpoint", True, r"""https?://[^\x20\x09-\x0D"'<>]++""")
#: A host name that begins where a run of its characters (and of @ and /) begins.
HOST = Part("host", "endpoint", True, r"(?<![A-Za-z0-9.@/-])(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9-]))++(?<=\.(?i:amazonaws|internal|local|com|net|org|io))(?::[0-9]++)?+")
PARTS = (ASSIGN, ACCESS, HEX, ID, KEY, URL, HOST)


def _matches(text: Column, place: int, part: Part, wanted: Column | None = None) -> Column:
    """For each match, and for the end of the text, the gap before it and its lengths."""
    value = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(part.group)) if part.group else F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, part.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0)).alias("match"), value.alias("value"))
    rows = F.transform(pairs, lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("nth"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("length"), F.length(x["value"]).alias("value")))
    there = text.rlike(part.pattern) if wanted is None else wanted & text.rlike(part.pattern)
    return F.when(there, rows).otherwise(F.array().cast("array<struct<place:int,nth:int,gap:bigint,length:bigint,value:int>>"))


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, place, start, end``: a row per part, or one of nulls for a text without any.

    ``place`` is the kind's place in ``PARTS``; ``row`` tells input rows apart.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    text = F.col("text")
    has_id = text.rlike(ACCESS.pattern) | text.rlike(ID.pattern)
    wanted: dict[Part, Column] = {KEY: has_id, URL: has_id, HOST: has_id}
    every = F.concat(*(_matches(text, k, p, wanted.get(p)) for k, p in enumerate(PARTS)))
    flat = rows.select("row", "doc_id", F.explode_outer(every).alias("m")).select("row", "doc_id", "m.*")
    upto = Window.partitionBy("row", "place").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(upto)
    least = F.element_at(F.array(*(F.lit(p.least) for p in PARTS)), F.col("place") + 1)
    counted = F.col("value") >= least
    placed = flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    # the row of the end of the text stands for texts whose matches don't count
    return placed.select("row", "doc_id", F.when(counted, F.col("place")).alias("place"), F.when(counted, F.col("start")).alias("start"), F.when(counted, F.col("end")).alias("end"))


def _of_role(found: DataFrame, role: str, name: str) -> DataFrame:
    places = [k for k, p in enumerate(PARTS) if p.role == role]
    weak = F.col("place").isin([k for k, p in enumerate(PARTS) if p.weak])
    return found.where(F.col("place").isin(places)).select("row", F.struct("start", "place", "end").alias(name), weak.alias(f"{name}_weak"))


def _near(left: DataFrame, right: DataFrame, at: str, name: str) -> DataFrame:
    """Interval join: parts of one text whose starts are at most ``REACH`` apart."""
    cell = lambda c: F.floor(F.col(f"{c}.start") / REACH)
    around = left.withColumn("cell", F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)))
    close = F.abs(F.col(f"{at}.start") - F.col(f"{name}.start")) <= REACH
    return around.join(right.withColumn("cell", cell(name)), ["row", "cell"]).where(close).drop("cell")


def _apart(found: DataFrame) -> DataFrame:
    """Without weak secrets that overlap a strong one: those are reported already.

    Each span is dealt to the cells that it covers, so a text's spans meet only near by.
    """
    covers = F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor((F.col("end") - 1) / REACH)))
    strong = found.where(F.col("place").isin(PARTS.index(ASSIGN), PARTS.index(HEX))).select("row", covers.alias("cell"), F.col("start").alias("s"), F.col("end").alias("e"))
    weak = found.where(F.col("place") == PARTS.index(KEY)).withColumn("cell", covers)
    covered = weak.join(strong, ["row", "cell"]).where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))).select("row", "start", "place").distinct()
    return found.join(covered, ["row", "start", "place"], "left_anti")


def linked_parts(found: DataFrame) -> DataFrame:
    """``row, start, place, end`` of the weak parts that are reported."""
    roles = found.groupBy("row").agg(F.max(F.col("place").isin(PARTS.index(ACCESS), PARTS.index(ID))).alias("i"), F.max(F.col("place").isin(PARTS.index(ASSIGN), PARTS.index(HEX), PARTS.index(KEY))).alias("s"))
    both = _apart(found.where("place is not null").join(roles.where("i and s").select("row"), "row"))
    pairs = _near(_of_role(both, "identifier", "identifier"), _of_role(both, "secret", "secret"), "identifier", "secret")
    beside = _near(pairs.select("row", "identifier").distinct(), _of_role(both, "endpoint", "endpoint"), "identifier", "endpoint").select("row", "identifier", "endpoint")
    complete = beside.select("row", "identifier").distinct().withColumn("complete", F.lit(True))
    links = pairs.join(complete, ["row", "identifier"], "left").where("not (identifier_weak and secret_weak) or complete")
    ends = beside.join(links.select("row", "identifier").distinct(), ["row", "identifier"]).select("row", F.col("endpoint").alias("part"))
    weak = F.filter(F.array(F.when(F.col("identifier_weak"), F.col("identifier")), F.when(F.col("secret_weak"), F.col("secret"))), lambda p: p.isNotNull())
    return links.select("row", F.explode(weak).alias("part")).unionByName(ends).select("row", "part.*").distinct()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, all``: for every row its spans, as sorted arrays of ``start, place, end, kind``."""
    found = stored(parts(df, id_col, text_col), "parts")
    kind = F.element_at(F.array(*(F.lit(p.kind) for p in PARTS)), F.col("place") + 1)
    span = F.struct("start", "place", "end", kind.alias("kind"))
    base = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("place") < 3, span))).alias("base"))
    more = linked_parts(found).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("more"))
    both = base.join(more, "row", "left")
    return both.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more"))).alias("all"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
