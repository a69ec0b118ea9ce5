"""Page layout on a table of text blocks (doc_id, block, ln, text, x1, y1, x2, y2); every step is by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..plans import reports
from .detect import unmatched
from .passes import run_sql


def layout(name: str, blocks: DataFrame) -> DataFrame:
    """One of merge_blocks, table_rows, table_columns, spatial_zone, horizontal_anchor over ``blocks``."""
    sql = getattr(reports, name)(SPARK)
    made = reports.blocks(SPARK)
    sql = sql.replace(f"WITH {made}, ", "WITH ", 1).replace(f"WITH {made} ", "", 1)
    return run_sql(sql, blocks=blocks)


def document_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of plain documents (doc_id, text), by line and " | "."""
    return run_sql(f"WITH {reports.blocks(SPARK)} SELECT * FROM blocks", documents=documents)


def redaction_boxes(regions: DataFrame, margin: float = 2.0) -> DataFrame:
    """Boxes to black out, a little larger than the regions."""
    return regions.selectExpr("doc_id", f"x1 - {margin} AS x1", f"y1 - {margin} AS y1", f"x2 + {margin} AS x2", f"y2 + {margin} AS y2")


def line_blocks(documents: DataFrame) -> DataFrame:
    """The lines of plain documents as blocks, with their offsets in the text: doc_id, block, s, e, x1, y1, x2, y2."""
    lines = documents.where("text IS NOT NULL").selectExpr("doc_id", "split(text, '\\n', -1) AS ls")
    # Offsets are running sums within the row's own array.
    starts = "aggregate(ls, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (a, l) -> named_struct('at', a.at + length(l) + 1, 'out', array_append(a.out, a.at)), a -> a.out)"
    rows = lines.selectExpr("doc_id", "ls", f"{starts} AS at").selectExpr("doc_id", "posexplode(arrays_zip(ls, at)) AS (block, x)")
    return rows.selectExpr("doc_id", "cast(block as bigint) AS block", "x.at AS s", "x.at + length(x.ls) AS e", "10D AS x1", "cast(14 * block as double) AS y1", "cast(10 + 6 * length(x.ls) as double) AS x2", "cast(14 * block + 12 as double) AS y2").where("e > s")


def _overlaps(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    other = blocks.selectExpr("doc_id AS d", "block", "s AS bs", "e AS be", "x1", "y1", "x2", "y2")
    return spans.join(other, (spans["doc_id"] == other["d"]) & (spans["s"] < other["be"]) & (other["bs"] < spans["e"]))


def entity_boxes(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """The box around all blocks that a span overlaps: doc_id, s, e, n_blocks, x1, y1, x2, y2."""
    return _overlaps(spans.select("doc_id", "s", "e").distinct(), blocks).groupBy("doc_id", "s", "e").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def substring_boxes(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """The part of each overlapped block that the span takes, by its share of the block's characters."""
    part = _overlaps(spans.select("doc_id", "s", "e").distinct(), blocks)
    place = lambda at: F.col("x1") + (F.col("x2") - F.col("x1")) * (at - F.col("bs")) / (F.col("be") - F.col("bs"))
    return part.select("doc_id", "s", "e", "block", F.round(place(F.greatest("s", "bs")), 4).alias("x1"), F.round(place(F.least("e", "be")), 4).alias("x2"), "y1", "y2")


def flip_boxes(boxes: DataFrame, width: float, height: float, padding: float = 2.0) -> DataFrame:
    """Boxes (x, y, w, h as shares of the page, from the bottom left) in pixels from the top left, padded and kept on the page."""
    x, y, w, h = (F.col(c) for c in "xywh")
    clip = lambda v, most: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(most)), 4)
    return boxes.select("id", clip(x * width - padding, width).alias("x1"), clip((1 - y - h) * height - padding, height).alias("y1"), clip((x + w) * width + padding, width).alias("x2"), clip((1 - y) * height + padding, height).alias("y2"))


def enhance_by_header(found: DataFrame) -> DataFrame:
    """Matches (id, entity_type, score, header_type) under a typed header: agreement adds 0.15 up to 0.99; under 0.5 the header's type takes over at
    0.75; under 0.7 it is suggested."""
    same = F.col("entity_type") == F.col("header_type")
    over = F.col("header_type").isNotNull() & ~same & (F.col("score") < 0.5)
    return found.select("id", F.when(over, F.col("header_type")).otherwise(F.col("entity_type")).alias("entity_type"), F.round(F.when(same, F.least(F.lit(0.99), F.col("score") + 0.15)).when(over, 0.75).otherwise(F.col("score")), 4).alias("score"), F.when(~same & ~over & (F.col("score") < 0.7), F.col("header_type")).alias("suggested"))


def selected(found: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """The matches that a reviewer chose, by their numbers."""
    return found.join(chosen.select(key).distinct(), key, "left_semi")


def header_cells(blocks: DataFrame) -> DataFrame:
    """Cells of two characters or more that stand below a typed header of their column: doc_id, block, text, entity_type.

    A page's first line of two blocks or more is its header line; a cell, of another such line, belongs to the header whose centre is within 50 of
    its own, the nearest, the first by block among equals. One shuffle by page brings lines and headers together.
    """
    cells = F.array_sort(F.collect_list(F.struct("block", "text", ((F.col("x1") + F.col("x2")) / 2).alias("x"))))
    lines = blocks.where("doc_id IS NOT NULL").repartition("doc_id").groupBy("doc_id", "ln").agg(cells.alias("cells")).where("size(cells) >= 2")
    page = Window.partitionBy("doc_id")
    typed = f"filter(transform(cells, c -> named_struct('x', c.x, 'block', c.block, 'kind', {reports.header_type(SPARK, 'c.text')})), h -> h.kind IS NOT NULL)"
    lines = lines.withColumn("top", F.min("ln").over(page)).withColumn("heads", F.when(F.col("ln") == F.col("top"), F.expr(typed)))
    below = lines.withColumn("heads", F.max("heads").over(page)).where("ln > top AND size(heads) > 0")
    near = "array_min(transform(filter(heads, h -> abs(c.x - h.x) <= 50), h -> named_struct('far', abs(c.x - h.x), 'block', h.block, 'kind', h.kind)))"
    rows = below.select("doc_id", "heads", F.explode("cells").alias("c")).where("length(c.text) > 1").select("doc_id", "c", F.expr(near).alias("head"))
    return rows.where("head IS NOT NULL").select("doc_id", F.col("c.block").alias("block"), F.col("c.text").alias("text"), F.col("head.kind").alias("entity_type"))


def fill_missing(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``header_cells`` that hold no match, with the header's type at 0.70. ``found`` has the (doc_id, block) of blocks with a match."""
    return header_cells(blocks).join(found.select("doc_id", "block").distinct(), ["doc_id", "block"], "left_anti").select("doc_id", "block", "entity_type", F.lit(0.70).alias("score"))


def fill_documents(documents: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """``fill_missing`` for plain documents (doc_id, text), where patterns are sought in the cells below typed headers only. A page without
    " | " has no line of two blocks."""
    cells = header_cells(document_blocks(documents.where(F.contains("text", F.lit(" | ")))))
    return unmatched(cells, families).select("doc_id", "block", "entity_type", F.lit(0.70).alias("score"))
