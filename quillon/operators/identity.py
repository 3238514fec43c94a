"""Identity: which mentions are one subject, and what each subject is called in the masked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alpha_index, greek_index, serial_index
from ..session import checkpointed
from .unions import IN_TASK, in_groups

#: Order of types in a directory, and names of replacements.
TYPE_PRIORITY = {"ORGANIZATION": 1, "COMPANY_NAME": 1, "PERSON": 2, "PERSON_NAME": 2, "ALIAS": 3, "BANK_NAME": 4, "ACCOUNT_NAME": 5, "ADDRESS": 6, "LOCATION": 6}
REPLACEMENT_PREFIX = {"ORGANIZATION": "公司", "COMPANY_NAME": "公司", "PERSON": "人员", "PERSON_NAME": "人员", "ALIAS": "简称", "BANK_NAME": "银行", "ACCOUNT_NAME": "户名", "ADDRESS": "地址", "LOCATION": "地址"}


def _lookup(kind: Column, values: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def normalized(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[\s\p{Punct}]+", ""))


def must_links(candidates: DataFrame) -> DataFrame:
    """Mentions of one type and surface, each linked to the first: key (of the first), other, evidence."""
    order = Window.partitionBy("doc_id", "entity_type", normalized(F.col("text"))).orderBy("start", "candidate_id")
    first = candidates.withColumn("first", F.first("candidate_id").over(order))
    return first.where("first <> candidate_id").select("doc_id", F.lit("must_link").alias("kind"), F.col("first").alias("left_id"), F.col("candidate_id").alias("right_id"))


def type_conflicts(candidates: DataFrame) -> DataFrame:
    """Pairs of types that one surface of a document has. Mentions are grouped first, so a surface's types meet, not its mentions."""
    typed = candidates.select("doc_id", normalized(F.col("text")).alias("surface"), "entity_type").where("surface <> ''").groupBy("doc_id", "surface", "entity_type").agg(F.count("*").alias("mentions"))
    a, b = (typed.select("doc_id", "surface", F.col("entity_type").alias(f"{s}_type"), F.col("mentions").alias(f"{s}_mentions")) for s in ("left", "right"))
    return a.join(b, ["doc_id", "surface"]).where("left_type < right_type")


def maybe_links(surfaces: DataFrame, least_short: int = 2, least_long: int = 4, grams: int = 2) -> DataFrame:
    """Surfaces (doc_id, surface) of which one holds the other. Blocked by the short one's first grams, so only surfaces
    that share them are compared."""
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("surface") - grams + 1), lambda i: F.substr("surface", i, F.lit(grams))))
    own = surfaces.where(F.length("surface") >= least_short).distinct()
    longer = own.where(F.length("surface") >= least_long).select("doc_id", F.col("surface").alias("longer"), F.explode(pieces).alias("gram"))
    shorter = own.select("doc_id", F.col("surface").alias("shorter"), F.left("surface", F.lit(grams)).alias("gram"))
    found = longer.join(shorter, ["doc_id", "gram"]).where((F.length("longer") > F.length("shorter")) & F.contains("longer", "shorter"))
    return found.select("doc_id", "longer", "shorter").distinct()


def directory(candidates: DataFrame, most_surfaces: int = 8) -> DataFrame:
    """Per document and subject: id, type, canonical text, surfaces, mentions, replacement.

    must_link joins equal types and surfaces only, so its components are groups. A subject's type is the most frequent, of
    ties the first in order; surfaces are ordered by frequency, then length, then text; subjects by type, first mention,
    size and name; replacements count subjects of a type.
    """
    kind = F.col("entity_type")
    own = candidates.withColumn("key", normalized(F.col("text"))).where("key <> ''")
    counted = own.groupBy("doc_id", "entity_type", "key", "text").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    order = F.struct((-F.col("n")).alias("n"), (-F.length("text")).alias("l"), F.col("text").alias("t"))
    groups = counted.groupBy("doc_id", "entity_type", "key").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), 1, most_surfaces).alias("surfaces"), F.sum("n").alias("mentions"), F.min("first").alias("first_start")
    )
    named = groups.withColumn("canonical", F.element_at("surfaces", 1)).withColumn("priority", _lookup(kind, TYPE_PRIORITY, 99))
    keys = [F.col("priority"), F.col("first_start"), F.desc("mentions"), F.col("canonical"), F.col("entity_type")]
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys))
    of_type = F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy(*keys))
    prefix = _lookup(kind, REPLACEMENT_PREFIX, "主体")
    return named.withColumn("subject_id", F.format_string("CFD%05d", number)).withColumn("replacement", F.concat(prefix, of_type.cast("string"))).drop("priority")


def quality_gate(candidates: DataFrame) -> DataFrame:
    """Surfaces with several types, and keys with several surfaces: kind, key, n."""
    types = candidates.groupBy(F.col("text").alias("key")).agg(F.countDistinct("entity_type").alias("n")).select(F.lit("several_types").alias("kind"), "key", "n")
    surfaces = candidates.groupBy(normalized(F.col("text")).alias("key")).agg(F.countDistinct("text").alias("n")).select(F.lit("several_surfaces").alias("kind"), "key", "n")
    return types.unionByName(surfaces).where("n > 1 and key <> ''")


def card_components(cards: DataFrame) -> DataFrame:
    """Cards (doc_id, card, surface) that share surfaces, directly or by others: doc_id, card, subject (the smallest card).

    Documents of up to IN_TASK edges stream by, each united link after link; in others labels pass over card-surface edges, in rounds.
    """
    edges = checkpointed(cards.select("doc_id", "card", "surface").distinct())
    large = checkpointed(edges.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > IN_TASK).select("doc_id"))
    few, rest = edges, None
    if not large.isEmpty():
        few, rest = checkpointed(edges.join(large, "doc_id", "left_anti")), _components_in_rounds(edges.join(large, "doc_id", "left_semi"))

    def each(group: list[tuple]) -> list[tuple]:
        above = {card: card for _, card, _ in group}

        def top(card: int) -> int:
            while above[card] != card:
                above[card] = above[above[card]]
                card = above[card]
            return card

        first: dict = {}
        for _, card, surface in group:
            if surface is not None:
                a, b = sorted((top(card), top(first.setdefault(surface, card))))
                above[b] = a
        return [(group[0][0], card, top(card)) for card in above]

    types = dict(edges.dtypes)
    found = in_groups(few, "doc_id", ("card", "surface"), ("card", "surface"), each, f"doc_id {types['doc_id']}, card {types['card']}, subject {types['card']}")
    return found if rest is None else found.unionByName(rest)


def _components_in_rounds(edges: DataFrame) -> DataFrame:
    """card_components of edges: labels pass both ways in a round, and cards take the label of their label, until none changes."""
    edges = checkpointed(edges)
    labels = edges.groupBy("doc_id", "card").agg(F.min("card").alias("subject"))
    changed = True
    while changed:
        by_surface = edges.join(labels, ["doc_id", "card"]).groupBy("doc_id", "surface").agg(F.min("subject").alias("least"))
        reached = edges.join(by_surface, ["doc_id", "surface"]).groupBy("doc_id", "card").agg(F.min("least").alias("least"))
        root = labels.select("doc_id", F.col("card").alias("least"), F.col("subject").alias("root"))
        new = labels.join(reached, ["doc_id", "card"]).join(root, ["doc_id", "least"], "left")
        new = checkpointed(new.select("doc_id", "card", F.least("subject", "least", "root").alias("next"), "subject"))
        changed = not new.where("next <> subject").isEmpty()
        labels = new.select("doc_id", "card", F.col("next").alias("subject"))
    return labels


def suffixed(groups: DataFrame, base: str = "base", order: str = "first_start") -> DataFrame:
    """Groups of one document with the same base replacement get suffixes A, B ... in order; a base of one group gets none."""
    by = Window.partitionBy("doc_id", base)
    place = F.row_number().over(by.orderBy(order, "group_id")) - 1
    several = F.count("*").over(by) > 1
    return groups.withColumn("replacement", F.when(several, F.concat(F.col(base), alpha_index(place))).otherwise(F.col(base)))


def serials(groups: DataFrame, style: str = "letter", scope: str = "scope", order: str = "first_start") -> DataFrame:
    """Running names in a scope of a document: letters, 甲 乙 ..., or Greek letters."""
    index = F.row_number().over(Window.partitionBy("doc_id", scope).orderBy(order, "group_id")) - 1
    return groups.withColumn("alias", {"letter": alpha_index, "cn": serial_index, "greek": greek_index}[style](index))


def first_wins(entities: DataFrame, key: str = "key") -> DataFrame:
    """All entities of a key get the replacement of the first."""
    order = Window.partitionBy("doc_id", key).orderBy("start", "end")
    return entities.withColumn("replacement", F.first("replacement", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def renumbered(subjects: DataFrame) -> DataFrame:
    """Across groups of one document: the earliest subject keeps its replacement (prefix + number); others get the next
    numbers of their prefix that none has."""
    prefix, number = F.regexp_extract("replacement", r"^(.*?)[0-9]*$", 1), F.regexp_extract("replacement", r"([0-9]+)$", 1).try_cast("int")
    parts = subjects.withColumn("prefix", prefix).withColumn("number", number)
    keeps = F.row_number().over(Window.partitionBy("doc_id", "replacement").orderBy("first_start", "subject_id")) == 1
    marked = parts.withColumn("keeps", keeps)
    used = marked.where("keeps").groupBy("doc_id", "prefix").agg(F.collect_set("number").alias("used"), F.count("*").alias("n_used"))
    others = marked.where("not keeps").join(used, ["doc_id", "prefix"], "left")
    place = F.row_number().over(Window.partitionBy("doc_id", "prefix").orderBy("first_start", "subject_id"))
    total = F.count("*").over(Window.partitionBy("doc_id", "prefix"))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), (F.col("n_used") + total + F.coalesce(F.array_max("used"), F.lit(0))).cast("int")), "used"))
    moved = others.withColumn("replacement", F.concat("prefix", F.element_at(free, place).cast("string")))
    columns = subjects.columns
    return marked.where("keeps").select(*columns).unionByName(moved.select(*columns))


def memory(entities: DataFrame) -> DataFrame:
    """What is known of each group of entities: variants, sources, best confidence, first and last mention."""
    return entities.groupBy("doc_id", "group_id").agg(
        F.array_sort(F.collect_set("text")).alias("variants"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.max("score").alias("confidence"), F.min("start").alias("first_start"), F.max("start").alias("last_start"),
        F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("primary"), F.count("*").alias("mentions"),
    )


def inconsistencies(entities: DataFrame) -> DataFrame:
    """Keys and texts with several replacements: kind, key, n."""
    one = lambda column: entities.groupBy("doc_id", F.col(column).alias("key")).agg(F.countDistinct("replacement").alias("n")).where("n > 1").select("doc_id", F.lit(f"several_per_{column}").alias("kind"), "key", "n")
    return one("group_id").unionByName(one("text"))


def mapping(entities: DataFrame) -> DataFrame:
    """The first of each type, text and replacement that changes the text, in order: the mapping that goes with a masked document."""
    order = Window.partitionBy("doc_id", "entity_type", "text", "replacement").orderBy("start", "end")
    first = entities.where("replacement <> text").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "entity_type")))
