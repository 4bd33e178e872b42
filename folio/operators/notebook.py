"""Notebooks as cells and outputs, by Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import escape_html, strip_ansi
from folio.operators.markdown import markdown_html
from folio.operators.rows import joined

IMAGES = ("image/png", "image/jpeg", "image/gif")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _string(v: Column, path: str) -> Column:
    """A string value, null for other types."""
    return F.when(F.schema_of_variant(_get(v, path, "variant")) == "STRING", _get(v, path))


def source_of(v: Column, path: str) -> Column:
    """A string, or the strings of an array, joined; else empty."""
    lines = F.filter(F.transform(_get(v, path, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", _get(x, "$"))), lambda x: x.isNotNull())
    return F.coalesce(_string(v, path), F.array_join(lines, ""), F.lit(""))


def notebooks(texts: DataFrame) -> DataFrame:
    """``path, nb, error_message, error_detail, language`` of ``path, text`` rows."""
    parsed = texts.select("path", F.try_parse_json(F.coalesce("text", F.lit(""))).alias("nb"))
    cells = _get(F.col("nb"), "$.cells", "array<variant>")
    message = F.when(F.col("nb").isNull(), "This notebook can't be read").when(cells.isNull(), "This notebook can't be read")
    detail = F.when(F.col("nb").isNull(), "it is no JSON").when(cells.isNull(), "it has no list of cells")
    language = F.coalesce(F.nullif(_string(F.col("nb"), "$.metadata.language_info.name"), F.lit("")), F.nullif(_string(F.col("nb"), "$.metadata.kernelspec.language"), F.lit("")), F.lit("python"))
    return parsed.select("path", "nb", message.alias("error_message"), detail.alias("error_detail"), language.alias("language"))


def ipynb_cells(texts: DataFrame) -> DataFrame:
    """``path, cell, cell_type, execution_count, source, language, outputs`` of markdown, code and raw cells."""
    good = notebooks(texts).where("error_message is null")
    rows = good.select("path", "language", F.posexplode(_get(F.col("nb"), "$.cells", "array<variant>")).alias("cell", "c"))
    kind = _string(F.col("c"), "$.cell_type")
    return rows.select("path", "cell", kind.alias("cell_type"), _get(F.col("c"), "$.execution_count", "int").alias("execution_count"), source_of(F.col("c"), "$.source").alias("source"), "language", _get(F.col("c"), "$.outputs", "array<variant>").alias("outputs")).where(F.col("cell_type").isin("markdown", "code", "raw"))


def ipynb_outputs(cells: DataFrame) -> DataFrame:
    """``path, cell, nth, kind, text``: what is shown of each output of code cells: stream, stderr, error, an image or a text."""
    rows = cells.where("cell_type = 'code'").select("path", "cell", F.posexplode("outputs").alias("nth", "o"))
    o = F.col("o")
    kind = F.coalesce(_string(o, "$.output_type"), F.lit(""))
    trace = F.filter(F.transform(_get(o, "$.traceback", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.concat(strip_ansi(_get(x, "$")), F.lit("\n")))), lambda x: x.isNotNull())
    data = lambda key: F.nullif(_string(o, f'$.data["{key}"]'), F.lit(""))
    has = lambda key: _get(o, f'$.data["{key}"]', "variant").isNotNull()
    shown = F.when(kind == "stream", F.struct(F.when(_string(o, "$.name") == "stderr", "stderr").otherwise("stream").alias("kind"), source_of(o, "$.text").alias("text"))).when(kind == "error", F.struct(F.lit("error").alias("kind"), F.coalesce(F.array_join(trace, ""), F.lit("")).alias("text")))
    for mime in IMAGES:
        shown = shown.when(data(mime).isNotNull(), F.struct(F.lit(mime).alias("kind"), F.regexp_replace(data(mime), "[ \r\n]", "").alias("text")))
    for mime in ("text/plain", "text/html"):
        shown = shown.when(has(mime), F.struct(F.lit(mime).alias("kind"), source_of(o, f'$.data["{mime}"]').alias("text")))
    return rows.withColumn("s", shown).where("s is not null").select("path", "cell", "nth", "s.kind", "s.text")


def ipynb_pieces(texts: DataFrame, strict: bool = True) -> DataFrame:
    """The cells as HTML. ``strict`` checks embedded base64 and shows it as text where it isn't."""
    cells = ipynb_cells(texts)
    is_image = F.col("kind").isin(*IMAGES) & ((F.lit(not strict)) | F.col("text").rlike("^[A-Za-z0-9+/]*={0,2}$"))
    css = F.when(F.col("kind").isin("stderr", "error"), "nb-out nb-err").when(F.col("kind") == "text/html", "nb-out nb-rawhtml").otherwise("nb-out")
    out = F.when(is_image, F.concat(F.lit('<img class="nb-img" src="data:'), "kind", F.lit(";base64,"), "text", F.lit('" alt="">'))).otherwise(F.concat(F.lit('<pre class="'), css, F.lit('">'), escape_html(F.col("text")), F.lit("</pre>")))
    outputs = ipynb_outputs(cells).groupBy("path", "cell").agg(joined(out, "nth").alias("outputs_html"))
    prompt = F.when(F.col("execution_count").isNotNull(), F.concat(F.lit("In ["), F.col("execution_count").cast("string"), F.lit("]:"))).otherwise("In [ ]:")
    language = F.when(F.col("language").rlike("^[A-Za-z0-9+_-]{1,20}$"), F.concat(F.lit(' class="language-'), "language", F.lit('"'))).otherwise("")
    code = F.concat(F.lit('<div class="nb-code"><div class="nb-prompt">'), prompt, F.lit("</div><pre><code"), language, F.lit(">"), escape_html(F.col("source")), F.lit("</code></pre></div>"), F.coalesce("outputs_html", F.lit("")))
    html = F.when(F.col("cell_type") == "markdown", F.concat(F.lit('<div class="nb-md">'), markdown_html(F.col("source")), F.lit("</div>"))).when(F.col("cell_type") == "code", code).otherwise(F.concat(F.lit('<pre class="nb-out">'), escape_html(F.col("source")), F.lit("</pre>")))
    return cells.join(outputs, ["path", "cell"], "left").select("path", F.col("cell").alias("seq"), F.col("cell_type").alias("kind"), html.alias("html"))
