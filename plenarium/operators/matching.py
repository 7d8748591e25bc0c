"""Identity across sources: slugs, ids, names with seats, ownership of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_slugs(rows: DataFrame, slug: str, suffix: str, order: list[str]) -> DataFrame:
    """``rows`` with ``unique_slug``: the first holder keeps the slug, the second gets a suffix, further ones a number too."""
    nth = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    again = F.row_number().over(Window.partitionBy(slug, suffix, F.col("nth") > 1).orderBy(*order))
    longer = F.concat_ws("-", slug, suffix)
    out = F.when(F.col("nth") == 1, F.col(slug)).when(again == 1, longer).otherwise(F.concat_ws("-", longer, again.cast("string")))
    return rows.withColumn("nth", nth).withColumn("unique_slug", out).drop("nth")


def resolve_by_id_then_slug(rows: DataFrame, people: DataFrame) -> DataFrame:
    """``rows`` (id, name_slug) with ``person``: by id whatever its case, else by slug, else null.

    ``people``: person_id, slug.
    """
    by_id = people.where("person_id is not null").groupBy(F.lower("person_id").alias("low_id")).agg(F.max("slug").alias("id_slug"))
    by_slug = people.select(F.col("slug").alias("own_slug")).distinct()
    joined = rows.join(by_id, F.lower(rows["id"]) == by_id["low_id"], "left").join(by_slug, rows["name_slug"] == by_slug["own_slug"], "left")
    return joined.withColumn("person", F.coalesce("id_slug", "own_slug")).drop("low_id", "id_slug", "own_slug")


def match_name_then_seat(sources: DataFrame, people: DataFrame) -> DataFrame:
    """source_id, slug: a single person of that name whatever the seat, else the first in the same seat.

    ``sources``: source_id, name_slug, house, seat, state; ``people``: slug, name_slug,
    house, seat, state, ord.  A person is of that name by name or by slug.  Seats are
    compared by house and by electorate or state.
    """
    keys = F.explode(F.array_distinct(F.array_compact(F.array(F.col("name_slug").cast("string"), F.col("slug").cast("string")))))
    p = people.select("slug", keys.alias("key"), *[F.col(c).alias(f"p_{c}") for c in ("house", "seat", "state", "ord")])
    asked = sources.withColumn("key", F.col("name_slug").cast("string"))
    names = p.groupBy("key").agg(F.count("*").alias("n"), F.min("slug").alias("only"))
    counted = asked.join(names, "key")
    # A name that several bear never meets them all: only those of the same house and seat.
    several = counted.where("n > 1").drop("n", "only")
    by = lambda place: several.join(p, (several["key"] == p["key"]) & (several["house"] == p["p_house"]) & (several[place] == p[f"p_{place}"])).select("source_id", "slug", "p_ord")
    seated = by("seat").unionByName(by("state")).groupBy("source_id").agg(F.min_by("slug", "p_ord").alias("slug"))
    return counted.where("n = 1").select("source_id", F.col("only").alias("slug")).unionByName(seated)


def family_suffixes(slug: Column) -> Column:
    """What a person's slug may end with after a hyphen: ``anna-le-roy`` gives ``le-roy`` and ``roy``."""
    parts = F.split(slug, "-")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "-"))
    return F.filter(ends, lambda e: e != "")


def match_slug_then_family(sources: DataFrame, people: DataFrame) -> DataFrame:
    """source_id, slug: by either of two full-name slugs, else by family name and seat if exactly one fits.

    ``sources``: source_id, given_slug, preferred_slug, family_slug, seat, state;
    ``people``: slug, name_slug, seat, state, ord.  The family name fits where the person's
    name ends with it, after a hyphen of its slug.
    """
    names = sources.select("source_id", F.explode(F.array_distinct(F.array_compact(F.array("given_slug", "preferred_slug")))).alias("slug"))
    direct = names.join(people.select("slug", "ord"), "slug").groupBy("source_id").agg(F.min_by("slug", "ord").alias("slug"))
    rest = sources.join(direct, "source_id", "left_anti")
    p = people.select("slug", F.explode(family_suffixes(F.col("name_slug"))).alias("family_slug"), F.col("seat").alias("p_seat"), F.col("state").alias("p_state"))
    # A family never meets all its sources: those who fit are counted by seat, by state, and by both, who would count twice.
    near = rest.select("source_id", "family_slug", "seat", "state")
    for name, places in (("by_seat", ["seat"]), ("by_state", ["state"]), ("by_both", ["seat", "state"])):
        fits = p.groupBy("family_slug", *[F.col(f"p_{c}").alias(c) for c in places]).agg(F.struct(F.count("*").alias("n"), F.min("slug").alias("slug")).alias(name))
        near = near.join(fits, ["family_slug", *places], "left")
    n = lambda name: F.coalesce(F.col(name)["n"], F.lit(0))
    near = near.select("source_id", (n("by_seat") + n("by_state") - n("by_both")).alias("n"), F.coalesce(F.col("by_seat")["slug"], F.col("by_state")["slug"]).alias("slug"))
    only = near.groupBy("source_id").agg(F.sum("n").alias("n"), F.min("slug").alias("slug")).where("n = 1").drop("n")
    return direct.unionByName(only)


def unmatched(sources: DataFrame, found: DataFrame, name: str, order: str, n: int = 8) -> DataFrame:
    """How many sources found nobody, and the names of the first ``n``: a report of one row."""
    rest = sources.join(found.select("source_id"), "source_id", "left_anti")
    first = rest.orderBy(order).limit(n).agg(F.array_sort(F.collect_list(F.struct(order, name))).alias("first"))
    return rest.agg(F.count("*").alias("unmatched")).crossJoin(first.select(F.concat_ws(", ", F.col("first")[name]).alias("names")))


def crosswalk(votes: DataFrame, ids: DataFrame, name_slug: Column | str = "name_slug") -> DataFrame:
    """``votes`` with ``member``: the slug of the person's id (the last one where several share it), else the name's slug."""
    last = ids.groupBy("person_id").agg(F.max_by("slug", "ord").alias("id_slug"))
    return votes.join(last, "person_id", "left").withColumn("member", F.coalesce("id_slug", name_slug)).drop("id_slug")


def merge_owned(fresh: DataFrame, stored: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """Fresh rows; columns that another source owns keep the stored value where there is one."""
    old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in owned])
    return fresh.join(old, key, "left").withColumns({c: F.coalesce(f"old_{c}", c) for c in owned}).drop(*[f"old_{c}" for c in owned])


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Stored rows that the current set no longer has."""
    return stored.join(current.select(key), key, "left_anti")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where a small table of overrides says so."""
    new = overrides.select(key, F.col(column).alias("override"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("override", column)).drop("override")


def left_enrich(rows: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the side table's columns, of at most one side row a key: the least by its columns."""
    least = side.groupBy(key).agg(F.min(F.struct(*columns)).alias("side"))
    return rows.join(least.select(key, "side.*"), key, "left")
