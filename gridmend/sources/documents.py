"""Readers that turn nested recogniser output and separated text into long tables.

A text or a JSON document is one row, so numbering inside it is array work in that row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.functions import constants as K
from gridmend.functions import text as T
from gridmend.operators.standardize import clean_selection_marks

LAYOUT_SCHEMA = """job_id string, page_offset int,
 pages array<struct<page: int, width: double, height: double, angle: double>>,
 styles array<struct<is_handwritten: boolean, spans: array<struct<offset: int, length: int>>>>,
 tables array<struct<row_count: int, column_count: int, cells: array<struct<r: int, c: int, content: string, kind: string,
   row_span: int, column_span: int, page: int, polygon: array<double>, spans: array<struct<offset: int, length: int>>>>>>"""

WORDS_SCHEMA = """job_id string, engine string,
 pages array<struct<page: int, width: double, height: double,
   words: array<struct<content: string, confidence: double, polygon: array<double>>>>>"""


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT_SCHEMA).json(path)


def explode_layout(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(layout_cells, pages) with page numbers shifted by the chunk's offset."""
    offset = F.coalesce("page_offset", F.lit(0))
    tables = docs.select("job_id", offset.alias("off"), F.posexplode("tables").alias("table_id", "t"))
    real = tables.filter("t.row_count >= 1 and t.column_count >= 1")
    cells = (real.select("job_id", "off", "table_id", F.col("t.row_count").alias("rc"), F.col("t.column_count").alias("cc"),
                         F.posexplode("t.cells").alias("cell_ord", "x")).filter("x.r < rc and x.c < cc"))
    content = F.nullif(clean_selection_marks(F.col("x.content")), F.lit(""))
    layout = cells.select(
        "job_id", "table_id", F.col("x.r").alias("r"), F.col("x.c").alias("c"), (F.col("off") + F.coalesce("x.page", F.lit(1))).alias("page"),
        content.alias("content"), F.col("x.kind").alias("kind"), F.coalesce("x.row_span", F.lit(1)).alias("row_span"),
        F.coalesce("x.column_span", F.lit(1)).alias("column_span"), F.col("x.polygon").alias("polygon"), F.col("x.spans").alias("spans"), "cell_ord")
    pages = docs.select("job_id", offset.alias("off"), F.explode("pages").alias("p")).select(
        "job_id", (F.col("off") + F.coalesce("p.page", F.lit(1))).alias("page"), *[F.coalesce(f"p.{c}", F.lit(0.0)).alias(c) for c in ("width", "height", "angle")])
    return layout, pages


def style_spans(docs: DataFrame) -> DataFrame:
    """Handwritten character ranges of a document."""
    st = docs.select("job_id", F.explode("styles").alias("s")).filter("s.is_handwritten")
    return st.select("job_id", F.inline("s.spans")).select("job_id", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"))


def explode_words(docs: DataFrame, unsure_below: float = 0.80, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(words, pages). Unsure words carry a marker; a page's confidence is the mean over its words, rounded to ``digits``.

    A page that comes in several records is one page with the words of all.
    """
    pages = docs.select("job_id", "engine", F.explode("pages").alias("p"))
    conf = F.coalesce("w.confidence", F.lit(1.0))
    text = F.trim(F.coalesce("w.content", F.lit("")))
    words = pages.select("job_id", "engine", F.col("p.page").alias("page"), F.posexplode("p.words").alias("word_idx", "w")).select(
        "job_id", "engine", "page", "word_idx", text.alias("content"), F.round(conf, 4).alias("confidence"), F.col("w.polygon").alias("polygon"),
        F.when(conf < unsure_below, F.concat(text, F.lit("[?]"))).otherwise(text).alias("annotated"))
    confs = F.transform("p.words", lambda w: F.round(F.coalesce(w["confidence"], F.lit(1.0)), 4))
    one = pages.select("job_id", "engine", F.col("p.page").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"),
                       F.aggregate(confs, F.lit(0.0), lambda a, x: a + x).alias("s"), F.when(F.size(confs) > 0, F.size(confs)).otherwise(0).alias("n"))
    whole = one.groupBy("job_id", "engine", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    # the inner rounding takes off what binary sums leave, the outer one is the only one that shows
    page_rows = whole.select("job_id", "engine", "page", "width", "height",
                             F.when(F.col("n") > 0, F.round(F.round(F.col("s") / F.col("n"), 10), digits)).otherwise(F.lit(0.0)).alias("confidence"))
    return words, page_rows


def _cells_of(line: Column) -> Column:
    return F.transform(F.split(line, "\\|"), lambda c: F.trim(c))


def parse_pipe_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Separated lines to positional cells; row 0 is the header, ruler lines are skipped, other lines dropped.

    Rulers are recognised but still count as rows, so two readings of one sheet stay in step.
    """
    rows = F.filter(T.lines(F.col(text)), lambda x: x.contains("|"))
    numbered = docs.select(key, F.posexplode(rows).alias("row_idx", "line"))
    joined = F.replace(F.trim("line"), F.lit("|"), F.lit(""))
    kept = numbered.filter((F.col("row_idx") == 0) | ~joined.rlike("^[-:\\s]+$"))
    return kept.select(key, "row_idx", F.posexplode(_cells_of(F.trim("line"))).alias("col_idx", "value"))


def pipe_names(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per separated line the first cell after the first with two Arabic letters; only such lines advance the row."""
    def name(line):
        return F.filter(F.slice(_cells_of(line), F.lit(2), F.greatest(F.lit(0), F.size(_cells_of(line)) - 1)), lambda c: T.arabic_chars(c) >= 2)

    found = F.transform(F.filter(T.lines(F.col(text)), lambda x: x.contains("|")), name)
    names = F.transform(F.filter(found, lambda a: F.size(a) > 0), lambda a: a[0])
    return docs.select(key, F.posexplode(names).alias("row_idx", "text"))


def explode_structured(jobs: DataFrame, column: str = "structured_data") -> DataFrame:
    """Stored JSON rows of completed jobs to long cells; null-like text is null."""
    people = F.from_json(F.col(column), "array<map<string,string>>")
    rows = jobs.filter("status = 'completed'").select("job_id", F.posexplode(people).alias("row_idx", "m"))
    return rows.select("job_id", "row_idx", F.explode("m").alias("field", "value")).withColumn("value", T.blank_to_null(F.col("value")))


def load_vocab(*sources: DataFrame, min_len: int = 2) -> DataFrame:
    """Distinct folded tokens over all sources, each a frame with a ``name`` column."""
    names = sources[0].select("name")
    for s in sources[1:]:
        names = names.unionByName(s.select("name"))
    toks = names.select(F.explode(T.tokens(T.fold("name", "alef"))).alias("token"))
    return toks.filter(F.length("token") >= min_len).distinct()


LEXICON_SCHEMA = "places array<struct<canonical: string, variants: map<string, bigint>>>"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed lexicon file."""
    return spark.read.schema(LEXICON_SCHEMA).option("multiLine", "true").json(path)


def load_places(lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, variants). A variant that folds to its own canonical form carries nothing and is dropped."""
    items = lexicon.select(F.posexplode("places").alias("ord", "p")).filter("p.canonical is not null and p.canonical <> ''")
    places = items.select(F.col("p.canonical").alias("canonical"), "ord")
    variants = items.select(F.col("p.canonical").alias("canonical"), "ord", F.explode("p.variants").alias("variant", "count"))
    folded = variants.withColumn("variant_folded", T.fold("variant", "place"))
    return places, folded.filter(F.col("variant_folded") != T.fold("canonical", "place")).select("variant_folded", "canonical", "ord", "count")
