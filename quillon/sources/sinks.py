"""Sinks: masked texts, mappings, rewrite plans and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_text(masked: DataFrame, folder: str, by: int = 1000) -> None:
    """Masked documents (doc_id, masked) as JSON lines of text, in folders of about ``by`` documents."""
    masked.select((F.col("doc_id") / by).cast("long").alias("part"), "doc_id", "masked").write.mode("overwrite").partitionBy("part").json(folder)


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table of a report in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def replace_longest(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Text with strings replaced, longer ones first, none within what was put in: marks stand for them until all are found."""
    ordered = sorted({a: b for a, b in pairs if a}.items(), key=lambda p: (-len(p[0]), p[0]))
    out = text
    for i, (old, _) in enumerate(ordered):
        out = F.replace(out, F.lit(old), F.lit(f"{i}"))
    for i, (_, new) in enumerate(ordered):
        out = F.replace(out, F.lit(f"{i}"), F.lit(new))
    return out


def split_over(replacement: Column, lengths: Column) -> Column:
    """A replacement cut over the fragments (array of lengths) that its source touched, in proportion, by largest remainders."""
    total = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    n = F.length(replacement)
    whole = F.transform(lengths, lambda x: F.floor(n * x / total).cast("int"))
    left = n - F.aggregate(whole, F.lit(0), lambda a, x: a + x)
    rest = F.transform(lengths, lambda x, i: F.struct((-((n * x) % total)).alias("r"), i.alias("i")))
    more = F.transform(F.slice(F.array_sort(rest), F.lit(1), F.greatest(left, F.lit(0))), lambda x: x["i"])
    sizes = F.transform(whole, lambda x, i: x + F.array_contains(more, i).cast("int"))
    return F.transform(sizes, lambda x, i: F.substr(replacement, F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, y: a + y) + 1, x))


def export_entries(entities: DataFrame) -> DataFrame:
    """Replacements of a document, once for each text, the longest first: doc_id, place, text, replacement."""
    from pyspark.sql import Window

    once = entities.where("replacement <> text").groupBy("doc_id", "text").agg(F.min_by("replacement", F.struct("start", "end")).alias("replacement"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "text")))


def fragments_of(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Entries (doc_id, entry_id, start, end) with the one unit that touches them; those that several or none touch are dropped."""
    u = units.select(F.col("doc_id").alias("__doc"), "unit_id", F.col("start").alias("u_start"), F.col("end").alias("u_end"))
    met = entries.join(u, (F.col("doc_id") == F.col("__doc")) & (F.col("start") < F.col("u_end")) & (F.col("end") > F.col("u_start")))
    one = met.groupBy("doc_id", "entry_id").agg(F.count("*").alias("n"), F.first("unit_id").alias("unit_id"), F.bool_and((F.col("u_start") <= F.col("start")) & (F.col("end") <= F.col("u_end"))).alias("whole"))
    return one.where("n = 1 and whole").select("doc_id", "entry_id", "unit_id")
