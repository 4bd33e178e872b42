"""Line dedup by a log-template tree, in DataFrame operations only.

Lines go down a tree of fixed depth: the number of tokens (split at white space, runs of
digits masked), then the first three tokens. In a leaf, the tokens after the leading ones form
up to ``STRETCHES`` even stretches, single tokens in lines of up to 13. A template keeps all but ``k`` of
the stretches, which are its variable fields: k is two fifths of the tokens at most, 4 at most, and leaves a
stretch constant (a line of four tokens has one field, shorter ones have none). So a line belongs to
one template per choice of k stretches, and to one without fields: itself.

A template's support is the number of distinct texts that hold it (copies of a text have one vote).
Lines of templates with a support of ``MIN_DOCS`` or more are dropped from all texts, whatever
their share of a text. With ``one_vote_per_family``, near copies of an earlier text share its vote:
see ``families``.

What is constant is a matter of the line alone, never of other lines or of how often a token
occurs, so more input hides nothing: what goes from a table's subset goes from the table, too (votes of
families apart). Support falls as stretches are added, so the choices are tried
by rising size, and only for forms that had enough support before: single stretches, then half lines (one half of a
line has half of the fields at most), then whole lines.

Defined results: a null text counts as empty: one blank line; lines without a letter
(blank ones, rules, brackets, numbers) are never dropped; lines repeated within one text count
once; rows of equal text get the same result; a text of which all lines go is empty; an empty table
gives an empty result; other columns pass through, those of the added names are replaced.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WS, stored, text_or_empty

LEADING = 3
MIN_DOCS = 3
STRETCHES, FIELDS = 10, 4
#: Percent of two texts' lines, by length, that must be alike for one to share the other's vote.
ALIKE = 85


#: White space other than single spaces.
ODD_SPACE = rf"\x20[{WS}]+|[\x09-\x0D][{WS}]*"


def _told(rows: DataFrame) -> DataFrame:
    """Rows with a ``line`` get ``n, lead, tail, key, masked``; those whose line can't recur go."""
    masked = rows.withColumn("masked", F.trim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", "#"), ODD_SPACE, " "))).where(F.col("masked").rlike(r"\p{L}"))
    n = F.length("masked") - F.length(F.replace("masked", F.lit(" "))) + 1
    ends = [F.xxhash64(F.substring_index("masked", " ", k)).alias(name) for name, k in (("lead", LEADING), ("tail", -LEADING))]
    return masked.select("*", n.alias("n"), *ends, F.xxhash64("masked").alias("key"))


def _leaf() -> Column:
    return F.xxhash64("n", "lead")


def _flags(at: Column) -> Column:
    """An array that is true at these rising places, up to the last."""
    places = F.sequence(F.lit(0), F.size(at) - 1)
    return F.flatten(F.transform(places, lambda i: F.concat(F.array_repeat(F.lit(False), F.get(at, i) - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))


def _flagged(i: Column) -> Column:
    return F.coalesce(F.get("flags", i), F.lit(False))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))


def lines_of(rows: DataFrame, ends: bool = False) -> DataFrame:
    """The lines that can recur, once for each distinct text ``h``, without their words; ``first`` is the text's smallest id."""
    same = ["size", "n", "lead", "key", *(["tail"] if ends else [])]
    each = _told(rows.select("h", "id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))).withColumn("size", F.length("line"))
    once = each.groupBy("h", "at").agg(F.min("id").alias("first"), *(F.first(c).alias(c) for c in same))
    return once.withColumn("first", F.coalesce("first", "h"))


def n_fields(stretches: int) -> int:
    """Variable fields of a line with so many stretches after the leading tokens."""
    return max(1, min(FIELDS, 2 * (stretches + LEADING) // 5, stretches - 1))


def _single(n: int) -> list[int]:
    return [1 << i for i in range(n)]


def _halves(n: int) -> list[int]:
    """Choices of one half's stretches without half of the fields."""
    half = (n + 1) // 2
    return [sum(1 << i for i in kept) for part in (range(half), range(half, n)) for kept in combinations(part, max(0, len(part) - n_fields(n) // 2))]


def _wholes(n: int) -> list[int]:
    return [sum(1 << i for i in kept) for kept in combinations(range(n), n - n_fields(n))]


def _choices(of) -> Column:
    """The choices of stretches for a form's number of them, as bits; those with an unsupported stretch are left out."""
    table = F.expr(f"array({', '.join(f'array({str(of(n))[1:-1]})' for n in range(1, STRETCHES + 1))})")
    return F.filter(F.element_at(table, F.size("codes")), lambda m: m.bitwiseAND(F.col("ok")) == m)


def _chosen(forms: DataFrame, of, *more: str) -> DataFrame:
    """``leaf, key, choice, template``: a row for each choice of stretches."""
    template = lambda m: F.xxhash64("leaf", m, F.aggregate(F.filter("codes", lambda _, i: F.getbit(m, i) == 1), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    each = F.transform(_choices(of), lambda m: F.struct(m.alias("choice"), template(m).alias("template")))
    return forms.select("leaf", "key", *more, F.explode(each).alias("c")).select("leaf", "key", *more, "c.*")


def _supported(chosen: DataFrame, min_docs: int) -> DataFrame:
    enough = chosen.groupBy("template").agg(F.sum("texts").alias("total")).where(F.col("total") >= min_docs).select("template")
    return chosen.join(enough, "template")


def _codes() -> tuple[Column, Column]:
    """The tokens after the leading ones of ``masked``, and from them, as ``tail``, a hash per stretch."""
    tail = F.slice(F.split("masked", " ", -1), F.lit(LEADING + 1), F.lit(2**31 - 1))
    m, n = F.size("tail"), F.least(F.size("tail"), F.lit(STRETCHES))
    begin = lambda i: F.floor((i * m + n - 1) / n).cast("int")
    return tail, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(i, F.slice("tail", begin(i) + 1, begin(i + 1) - begin(i))))


def candidates(rows: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``leaf, key, codes, ok``: the forms of lines that may have enough support.

    ``codes`` is null for a form that only recurs as it stands; ``ok`` tells the stretches that
    enough texts of the leaf share.
    """
    held = lines.groupBy(_leaf().alias("leaf"), "key", "h").agg(F.min("at").alias("at"), F.first("n").alias("n"))
    forms = stored(held.groupBy("leaf", "key").agg(F.count("*").alias("texts"), F.min("h").alias("h"), F.min_by("at", "h").alias("at"), F.first("n").alias("n")), "line-forms")
    crowded = forms.where(f"n > {LEADING}").groupBy("leaf").agg(F.sum("texts").alias("total"), F.count("*").alias("forms")).where((F.col("forms") > 1) & (F.col("total") >= min_docs)).select("leaf")
    # the words of each such form, from one text that holds it
    wanted = stored(forms.join(crowded, "leaf").select("h", "at", "leaf", "key", "texts"), "wanted-forms")
    places = stored(wanted.groupBy("h").agg(F.array_sort(F.collect_set("at")).alias("at")).select("h", _flags(F.col("at")).alias("flags")), "wanted-lines")
    picked = F.array_compact(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(_flagged(i), x)))
    # both sides grow with the corpus, so neither is for broadcast
    words = _told(rows.select("h", "text").join(places.hint("merge"), "h").select(F.explode(picked).alias("line"))).groupBy(_leaf().alias("leaf"), "key").agg(F.first("masked").alias("masked"))
    tail, codes = _codes()
    coded = words.join(wanted.select("leaf", "key", "texts"), ["leaf", "key"]).withColumn("tail", tail)
    coded = stored(coded.select("leaf", "key", "texts", codes.alias("codes"), F.lit(2**STRETCHES - 1).alias("ok")), "line-codes")

    common = _supported(_chosen(coded, _single, "texts"), min_docs).groupBy("leaf", "key").agg(F.bit_or("choice").alias("common"))
    fields = F.element_at(F.array(*(F.lit(n_fields(n)) for n in range(1, STRETCHES + 1))), F.size("codes"))
    likely = coded.join(common, ["leaf", "key"], "left").withColumn("ok", F.coalesce("common", F.lit(0))).drop("common")
    likely = stored(likely.where(F.bit_count("ok") >= F.size("codes") - fields), "likely-forms")
    halves = stored(_chosen(likely, _halves, "texts"), "line-halves")
    left = likely.join(_supported(halves, min_docs).select("leaf", "key").distinct(), ["leaf", "key"])
    as_they_are = forms.where(F.col("texts") >= min_docs).select("leaf", "key")
    return left.select("leaf", "key", "codes", "ok").join(as_they_are, ["leaf", "key"], "full")


def recurring(forms: DataFrame, votes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``leaf, key`` of the forms of lines that go, from ``candidates`` and the distinct ``leaf, key, voter``."""
    counted = votes.groupBy("leaf", "key").agg(F.count("*").alias("texts"))
    found = stored(_chosen(forms.where("codes is not null").join(counted, ["leaf", "key"]), _wholes, "texts"), "line-templates")
    some = stored(found.groupBy("template").agg(F.sum("texts").alias("total"), F.max("texts").alias("most"), F.count("*").alias("forms")).where((F.col("forms") > 1) & (F.col("total") >= min_docs)), "some-templates")
    # forms of a template may be held by the same few texts
    few = found.join(some.where(F.col("most") < min_docs).select("template"), "template").join(votes, ["leaf", "key"])
    enough = few.groupBy("template").agg(F.count_distinct("voter").alias("votes")).where(F.col("votes") >= min_docs).select("template")
    enough = some.where(F.col("most") >= min_docs).select("template").unionByName(enough)
    go = found.where(F.col("texts") < min_docs).join(enough, "template").select("leaf", "key").distinct()
    return go.unionByName(counted.where(F.col("texts") >= min_docs).select("leaf", "key"))


def families(lines: DataFrame) -> DataFrame:
    """``h, family`` of the texts that are near copies of an earlier one, whose id is the family's name.

    A line belongs to the text with the smallest id that has a line with the same leading or the
    same last three tokens, so a few edited words leave it there. A text joins the family of
    an earlier one if ``ALIKE`` percent of both, by length, are such lines. Boilerplate does not make
    a family: it has to be nearly all of both texts.
    """
    marks = lines.select("h", "first", "at", "size", F.explode(F.array(F.xxhash64(F.lit(0), "lead"), F.xxhash64(F.lit(1), "tail"))).alias("mark"))
    owners = marks.groupBy("mark").agg(F.min("first").alias("family"), F.max("first").alias("last")).where("family != last").select("mark", "family")
    owned = marks.join(owners, "mark").where("family != first").groupBy("h", "family", "at").agg(F.first("size").alias("size")).groupBy("h", "family").agg(F.sum("size").alias("both"))
    sizes = stored(lines.groupBy("h").agg(F.min("first").alias("first"), F.sum("size").alias("all")), "line-sums")
    of_family = sizes.groupBy("first").agg(F.max("all").alias("all_of_family")).withColumnRenamed("first", "family")
    near = owned.join(sizes.select("h", "all"), "h").where("2 * both >= all").join(of_family, "family").where(f"100 * both >= {ALIKE} * (all + all_of_family - both)")
    return near.groupBy("h").agg(F.min("family").alias("family"))


def drops(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, one_vote_per_family: bool = False) -> DataFrame:
    """``h, dropped, flags``: for each distinct text that loses lines their numbers, from 0, and the same as true values."""
    rows = _keyed(df, id_col, text_col)
    lines = stored(lines_of(rows, one_vote_per_family), "lines")
    forms = stored(candidates(rows, lines, min_docs), "candidate-forms")
    mine = stored(lines.select("h", "first", "at", _leaf().alias("leaf"), "key").join(forms.select("leaf", "key"), ["leaf", "key"]), "candidate-lines")
    voters = mine.join(families(lines), "h", "left").withColumn("voter", F.coalesce("family", "first")) if one_vote_per_family else mine.withColumn("voter", F.col("h"))
    votes = stored(voters.select("leaf", "key", "voter").distinct(), "line-votes")
    gone = stored(recurring(forms, votes, min_docs), "recurring")
    return mine.join(gone, ["leaf", "key"]).groupBy("h").agg(F.array_sort(F.collect_set("at")).alias("dropped")).withColumn("flags", _flags(F.col("dropped")))


def without(text: Column) -> Column:
    """The text without the lines that ``flags`` marks."""
    return F.when(F.col("flags").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~_flagged(i)), "\n"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, one_vote_per_family: bool = False) -> DataFrame:
    """The rows with their text, where lines were dropped, replaced; adds ``n_lines`` and ``dropped``."""
    made = df.drop("n_lines", "dropped").withColumn("__h", F.xxhash64(text_or_empty(text_col)))
    found = stored(drops(df, id_col, text_col, min_docs, one_vote_per_family), "drops").withColumnRenamed("h", "__h")
    both = made.withColumnRenamed("flags", "__flags").join(found.hint("merge"), "__h", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    n_lines = F.size(F.split(text_or_empty(text_col), "\n", -1)).cast("long")
    kept = [F.col("__flags").alias(c) if c == "flags" else F.col(c) for c in df.columns if c not in ("n_lines", "dropped")]
    return both.withColumn("n_lines", n_lines).withColumn(text_col, without(F.col(text_col))).select(*kept, "n_lines", "dropped")
