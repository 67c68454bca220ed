"""The page model: on which page each layout row begins, contents with pages, and lists of illustrations and tables.

A row's height follows from its style: lines of so many characters as the width holds, each of its size and spacing, and the space
around. Page breaks cut a document's rows into segments. Inside a segment heights are summed up row by row and divided by
what a page holds; over segments pages are summed up. So two running sums give every page, and no row is compared with
another. Widths are estimated (a character is CHARACTER of the size, a line LEADING of it), as a layout without the font must.

A list of illustrations goes before the table of contents, and the pages that it takes move all numbers of the text, so it takes two
passes: the first lays the list out with its numbers left blank, the second fills them in. A number has NUMBER
characters reserved, so the second pass moves nothing and a third would change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V
from lexmill.operators import layout as L
from lexmill.operators.captions import CAPTION, MAYBE_CAPTION

#: In hundredths of the size of the font.
CHARACTER = 45
LEADING = 115
#: Characters kept free for a page number in a list.
NUMBER = 5
_WIDTH = L.PAGE[0] - L.MARGINS[1] - L.MARGINS[3]
_HEIGHT = L.PAGE[1] - L.MARGINS[0] - L.MARGINS[2]
_STYLE = "struct<size:int,line:int,above:int,after:int,left:int,first:int>"
LISTS = (("LISTA DE ILUSTRAÇÕES", False), ("LISTA DE TABELAS", True))


def _styles() -> Column:
    """Style to what counts for heights."""
    parts = [x for style, (size, _, _, line, above, after, left, first) in L.STYLES.items() for x in (F.lit(style), F.struct(*[F.lit(v).alias(k) for k, v in zip(("size", "line", "above", "after", "left", "first"), (size, line, above, after, left, first), strict=True)]))]
    return F.create_map(*parts)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def heights(rows: DataFrame) -> DataFrame:
    """``rows`` with above (space before the first line), line (height of a line), lines and height, in twips; a page break has none.

    A style that isn't known counts as a paragraph's.
    """
    df = rows.withColumn("_s", F.coalesce(F.try_element_at(_styles(), F.col("style")), F.try_element_at(_styles(), F.lit("paragraph"))))
    s = F.col("_s")
    # half points to twips: times ten
    character = s["size"] * 10 * CHARACTER
    per_line = F.greatest(_div((F.lit(_WIDTH) - s["left"]) * 100, character), F.lit(1))
    indent = _div(s["first"] * 100, character)
    listed = F.when(F.col("style") == "toc", NUMBER).otherwise(0)
    # a number that is there already stands in the room kept for it
    said = F.when(F.col("style") == "toc", F.regexp_replace("text", r"\t\d+$", "")).otherwise(F.col("text"))
    each = F.transform(F.split(F.coalesce(said, F.lit("")), "\n"), lambda x, k: F.greatest(_div(F.length(x) + listed + F.when(k == 0, indent).otherwise(0) + per_line - 1, per_line), F.lit(1)))
    df = df.withColumn("lines", F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("line", _div(s["size"] * s["line"] * 10 * LEADING, F.lit(24000)))
    df = df.withColumn("above", F.coalesce(F.col("before"), s["above"]).cast("long")).withColumn("height", F.when(F.col("style") == "pageBreak", 0).otherwise(F.col("above") + F.col("lines") * F.col("line") + s["after"]).cast("long"))
    return df.drop("_s")


def paged(rows: DataFrame) -> DataFrame:
    """Layout rows with page: the sheet of the front, counted from 1, or the number in the body, counted from start_page.

    A row is on the page of its first line. A page break is on the page that it ends.
    """
    order = Window.partitionBy("doc_id", "part").orderBy("seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    cut = F.coalesce(F.col("style") == "pageBreak", F.lit(False))
    df = heights(rows).withColumn("_sum", F.coalesce(F.sum("height").over(before), F.lit(0))).withColumn("_opens", F.lag(cut, 1, True).over(order))
    # a segment's rows count from the sum at its first row, so all segments share one sort
    df = df.withColumn("_ahead", F.col("_sum") - F.last(F.when(F.col("_opens"), F.col("_sum")), ignorenulls=True).over(upto))
    # the break that closes a segment brings its pages to the next
    df = df.withColumn("_pages", F.when(cut, F.greatest(_div(F.col("_ahead") + F.col("height") + _HEIGHT - 1, F.lit(_HEIGHT)), F.lit(1))).otherwise(0))
    earlier = F.coalesce(F.sum("_pages").over(before), F.lit(0))
    into = F.when(cut, F.greatest(F.col("_ahead") - 1, F.lit(0))).otherwise(F.col("_ahead") + F.col("above") + F.col("line") - 1)
    first = F.when(F.col("part") == "body", F.col("start_page")).otherwise(1)
    return df.withColumn("page", (first + earlier + _div(into, F.lit(_HEIGHT))).cast("long")).select(*rows.columns, "page")


def contents(rows: DataFrame) -> DataFrame:
    """doc_id, seq, level, text, page of the body's headings: the table of contents as text. ``rows``: ``paged``."""
    level = F.try_element_at(F.create_map(*[F.lit(x) for pair in L.LEVELS.items() for x in pair]), F.col("style"))
    found = rows.where("part = 'body'").withColumn("level", level).where("level IS NOT NULL AND trim(text) <> ''")
    return found.select("doc_id", "seq", "level", "text", "page")


def with_lists(rows: DataFrame) -> DataFrame:
    """Layout rows with lists of illustrations and of tables in front of the table of contents, page numbers filled in.

    An entry is the title of a caption in the body and its page; documents without captions stay as they are. seq counts anew;
    start_page grows by the pages of the lists.
    """
    body, kind = F.col("part") == "body", rows.schema["seq"].dataType
    caption = F.regexp_extract(T.fold_upper(F.coalesce("text", F.lit(""))), CAPTION, 1)
    df = rows.withColumn("_label", F.nullif(F.when(body & F.col("style").isin("paragraph", "simple") & F.col("text").rlike(MAYBE_CAPTION), caption), F.lit("")))
    df = df.withColumn("of_tables", F.when(F.col("_label").isNotNull(), F.col("_label") == V.TABLE_LABEL))
    # in front of the break that leads to the table of contents, or behind all of the front
    whole, front = Window.partitionBy("doc_id"), F.col("part") == "front"
    contents_at, end = F.max(F.when(front & (F.col("style") == "title"), F.col("seq") - 1)).over(whole), F.max(F.when(front, F.col("seq"))).over(whole) + 1
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    nth = [F.sum(F.when(F.col("of_tables") == tables, 1).otherwise(0)).over(upto) for tables in (False, True)]
    df = df.withColumns({"at": F.coalesce(contents_at, end), "_of_illustrations": nth[0], "_of_tables": nth[1]})
    df = df.withColumn("nth", F.when(F.col("of_tables"), F.col("_of_tables")).otherwise(F.col("_of_illustrations")))

    def made(part: str | Column, style: str | Column, before: Column, text: Column, keys: tuple, own: Column) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        places = [k.cast(t).alias(f"k{n}") for n, (k, t) in enumerate(zip(keys, (kind, "int", "int", "long"), strict=True), 1)]
        return F.struct(as_column(part).alias("part"), as_column(style).alias("style"), before.cast("long").alias("before"), text.alias("text"), *places, own.cast(kind).alias("entry_of"))

    none = F.lit(None)
    entry = lambda style, text, place, own: made("front", style, none, text, (F.col("at"), F.lit(0), F.col("of_tables"), place), own)
    title = F.when(F.col("of_tables"), LISTS[1][0]).otherwise(LISTS[0][0])
    head = (entry("pageBreak", F.lit(""), F.lit(-1), none), entry("sectionTitle", title, F.lit(0), none))
    listed = entry("toc", F.col("text"), F.col("nth"), F.col("seq"))
    itself = made(F.col("part"), F.col("style"), F.col("before"), F.col("text"), (F.col("seq"), F.lit(1), F.lit(0), F.lit(0)), none)
    # a caption's row brings its entry with it, the first one of a list the list's head too
    shown = F.when(F.col("of_tables").isNull() | F.col("at").isNull(), F.array(itself)).when(F.col("nth") == 1, F.array(itself, *head, listed)).otherwise(F.array(itself, listed))
    both = df.select("doc_id", "start_page", F.inline(shown))
    both = both.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k1", "k2", "k3", "k4")) - 1).cast(kind))
    # first pass: how many pages the lists take
    sheets = paged(both)
    front_lists = (F.col("k2") == 0) & (F.col("style") != "pageBreak")
    moved = sheets.withColumn("_added", F.size(F.collect_set(F.when(front_lists, F.col("page"))).over(whole)))
    moved = moved.withColumn("start_page", F.col("start_page") + F.col("_added")).withColumn("page", F.col("page") + F.when(body, F.col("_added")).otherwise(0))
    # second pass: a caption and its entry share a key, which brings the page of the one to the other
    own = F.coalesce("entry_of", F.when(body, F.col("k1")))
    own_page = F.max(F.when(body, F.col("page"))).over(Window.partitionBy("doc_id", own))
    filled = moved.withColumn("_own_page", F.when(F.col("entry_of").isNotNull(), own_page))
    text = F.when(F.col("_own_page").isNotNull(), F.concat("text", F.lit("\t"), F.col("_own_page").cast("string"))).otherwise(F.col("text"))
    return filled.select("doc_id", "start_page", "seq", "part", "style", "before", text.alias("text"), "page")
