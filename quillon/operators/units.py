"""Units of documents: lines, pages, segments, groups; and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_MARK = "\f"


def lines(docs: DataFrame) -> DataFrame:
    """Units of non-blank lines: doc_id, unit_id, order_index, text, start, end (half-open in code points of the document)."""
    whole = F.split("text", "\n", -1)
    lengths = F.transform(whole, lambda t: F.length(t))
    starts = F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n + 1).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
    )["out"]
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(whole.alias("text"), starts.alias("start"))).alias("order_index", "u"))
    unit = rows.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("order_index").cast("string")).alias("unit_id"), "order_index", "u.text", "u.start")
    return unit.withColumn("end", F.col("start") + F.length("text")).where(F.trim("text") != "")


def joined_offsets(units: DataFrame, separator: int = 1) -> DataFrame:
    """start and end of units as they stand in the text that joins them, in order, by a separator of so many characters."""
    before = Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0)).cast("int")
    return units.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def context(units: DataFrame, size: int = 40) -> DataFrame:
    """The line before and after, at most ``size`` characters of each next to the unit."""
    order = Window.partitionBy("doc_id").orderBy("order_index")
    return units.withColumn("before", F.right(F.coalesce(F.lag("text").over(order), F.lit("")), F.lit(size))).withColumn(
        "after", F.left(F.coalesce(F.lead("text").over(order), F.lit("")), F.lit(size))
    )


def kinds(text: Column) -> Column:
    """A line's kind: blank, table_row (two and more tabs or wide gaps), title (short, no closing mark), else line."""
    cells = F.size(F.split(F.trim(text), r"\t| {3,}|\s\|\s"))
    return F.when(F.trim(text) == "", "spacer").when(cells >= 3, "table_row").when((F.length(text) <= 40) & ~text.rlike(r"[。.;；,，!?]\s*$"), "title").otherwise("line")


def blocks(units: DataFrame) -> DataFrame:
    """Runs of lines of one kind: doc_id, block, kind, first, last, n_lines. A session of equal kinds."""
    order = Window.partitionBy("doc_id").orderBy("order_index")
    kind = units.withColumn("kind", kinds(F.col("text")))
    changed = kind.withColumn("new", (F.col("kind") != F.coalesce(F.lag("kind").over(order), F.lit(""))).cast("int"))
    numbered = changed.withColumn("block", F.sum("new").over(order))
    return numbered.groupBy("doc_id", "block", "kind").agg(F.min("order_index").alias("first"), F.max("order_index").alias("last"), F.count("*").alias("n_lines"))


def merged_fragments(units: DataFrame, most: int = 6, chars: int = 180) -> DataFrame:
    """Each unit with the texts of it and the next, up to ``most`` units and ``chars`` characters: fragments array<string>."""
    ahead = Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(0, most - 1)
    near = units.withColumn("near", F.collect_list("text").over(ahead))
    grown = F.transform(F.sequence(F.lit(1), F.size("near")), lambda i: F.array_join(F.slice("near", 1, i), ""))
    return near.withColumn("fragments", F.filter(grown, lambda t, i: (i == 0) | (F.length(t) <= chars))).drop("near")


def segments(docs: DataFrame, size: int = 1800, overlap: int = 180) -> DataFrame:
    """Windows of a fixed step over the whole text: doc_id, segment, start, end, text. The last ends with the text."""
    n = F.length("text")
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / (size - overlap))).cast("int")
    each = docs.where(n > 0).select("doc_id", F.col("text").alias("whole"), F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    start = F.col("segment") * (size - overlap)
    placed = each.withColumn("start", start).withColumn("end", F.least(start + size, F.length("whole")))
    return placed.select("doc_id", "segment", "start", "end", F.substr("whole", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def soft_segments(units: DataFrame, most: int = 400, overlap: int = 40) -> DataFrame:
    """Lines of over ``most`` characters cut at the last mark within reach, else hard; the next begins ``overlap`` before
    the cut, after the first mark there. A walk along each line, as its steps depend on each other."""
    marks = r"[。；;，,、.\s]"

    def cut(text: Column) -> Column:
        head = lambda s: F.substr(text, s["at"] + 1, F.lit(most))
        soft = lambda h: F.length(F.regexp_extract(h, rf"^(?s)(.*{marks})", 1))
        end_of = lambda s: s["at"] + F.when((s["at"] + most >= F.length(text)) | (soft(head(s)) <= overlap), F.least(F.lit(most), F.length(text) - s["at"])).otherwise(soft(head(s)))
        again = lambda e: e - overlap + F.length(F.regexp_extract(F.substr(text, e - overlap + 1, F.lit(overlap)), rf"^(?s)([^。；;，,、.\s]*{marks})", 1))
        none = F.array().cast("array<struct<start:int,end:int>>")
        step = lambda s, _: F.when(s["at"] >= F.length(text), s).otherwise(
            F.struct(
                F.when(end_of(s) >= F.length(text), F.length(text)).when(again(end_of(s)) >= end_of(s), end_of(s)).otherwise(F.greatest(again(end_of(s)), s["at"] + 1)).cast("int").alias("at"),
                F.concat(s["out"], F.array(F.struct(s["at"].cast("int").alias("start"), end_of(s).cast("int").alias("end")))).alias("out"),
            )
        )
        rounds = F.sequence(F.lit(1), F.ceil(F.length(text) / (overlap + 1)).cast("int") + 1)
        return F.aggregate(rounds, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]

    each = units.select("doc_id", "unit_id", F.col("start").alias("from"), F.col("text").alias("whole"), F.posexplode(cut(F.col("text"))).alias("segment", "s"))
    return each.select("doc_id", "unit_id", "segment", (F.col("from") + F.col("s.start")).alias("start"), (F.col("from") + F.col("s.end")).alias("end"), F.substr("whole", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


def covered(intervals: DataFrame, by: str = "doc_id") -> DataFrame:
    """How much of each document intervals (start, end) cover, overlaps once: gaps and islands."""
    order = Window.partitionBy(by).orderBy("start", "end")
    top = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(top, F.col("start"))))
    return intervals.withColumn("__new", new).groupBy(by).agg(F.sum("__new").cast("long").alias("covered"), F.count("*").alias("n"))


def page_groups(pages: DataFrame, most_pages: int = 10, most_chars: int = 20_000) -> DataFrame:
    """Pages (doc_id, page_no, n_chars) in order into groups of at most so many pages and characters; a larger page is a
    group of its own, flagged. Greedy, so a fold along each document."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "n_chars")))
    start = F.struct(F.lit(-1).alias("group"), F.lit(0).alias("pages"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<struct<page_no:int,group:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["group"] >= 0) & (s["pages"] < most_pages) & (s["chars"] + p["n_chars"] < most_chars)
        group = F.when(fits, s["group"]).otherwise(s["group"] + 1)
        return F.struct(
            group.alias("group"), F.when(fits, s["pages"] + 1).otherwise(1).alias("pages"), F.when(fits, s["chars"] + p["n_chars"]).otherwise(p["n_chars"].cast("long")).alias("chars"),
            F.concat(s["out"], F.array(F.struct(p["page_no"].cast("int").alias("page_no"), group.alias("group")))).alias("out"),
        )

    folded = pages.groupBy("doc_id").agg(F.aggregate(ordered, start, step)["out"].alias("out"))
    return folded.select("doc_id", F.inline("out"))


def routed(docs: DataFrame, most_pages: int = 20, most_chars: int = 20_000, forced: Column | None = None) -> DataFrame:
    """large: whether a document (n_pages, n_chars) is worked on in groups."""
    large = (F.col("n_pages") > most_pages) | (F.col("n_chars") >= most_chars)
    return docs.withColumn("large", F.coalesce(forced, large) if forced is not None else large)


def inversions(units: DataFrame, slack: int = 3, by: str = "doc_id", position: str = "order_index", order: str = "seen") -> DataFrame:
    """The first unit of each document, in the order seen, that stands more than ``slack`` places before one seen earlier."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = units.withColumn("top", F.max(position).over(before)).where(F.col(position) + slack < F.col("top"))
    return top.groupBy(by).agg(F.min_by(F.struct(F.col(order), F.col(position), F.col("top")), F.col(order)).alias("x")).select(by, "x.*")


def next_cells(cells: DataFrame) -> DataFrame:
    """Label and value of table cells: the next cell of the row, and the cell at the same place of the row below."""
    by_row = Window.partitionBy("table_index", "row_index").orderBy("col_index")
    placed = cells.withColumn("place", F.row_number().over(by_row)).withColumn("right", F.lead("text").over(by_row))
    below = placed.select(F.col("table_index"), (F.col("row_index") - 1).alias("row_index"), "place", F.col("text").alias("below"))
    return placed.join(below, ["table_index", "row_index", "place"], "left")
