"""Aliases as a table of any size: what a name stands for in its domain.

A rule of a domain holds for a name if the alias is equal and the two domains, without blanks and hyphens, contain each
other either way. Containment isn't an equality, so it is found on distinct domains alone, by grams: a text that lies in
another has all its grams there, so one of them, its anchor, is looked up among the grams of the others, and what is
found is verified. All else are joins by equal values, over distinct pairs of name and domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions.text import let

#: Characters of a gram; shorter texts are their own.
GRAM = 3
RULES = "rule long, domain string, alias string, canonical string"


def squeezed(domain: Column) -> Column:
    return F.replace(F.replace(N.clean_name(domain), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))


def _grams(x: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.char_length(x) - size + 1, F.lit(1)))
    return F.when(F.char_length(x) >= size, F.transform(places, lambda i: F.substring(x, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _anchor(x: Column) -> Column:
    """The text itself if it is no longer than a gram, else its gram with the least hash."""
    least = let(_grams(x, GRAM), lambda g: F.array_min(F.transform(g, lambda y: F.struct(F.xxhash64(y).alias("h"), y.alias("y"))))["y"])
    return F.when(F.char_length(x) <= GRAM, x).otherwise(least)


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: pairs of which the first lies in the second. Both have one column x of different texts."""
    anchors = inner.select(F.col("x").alias("inner"), _anchor(F.col("x")).alias("gram"))
    every = F.array_distinct(F.concat(*(_grams(F.col("x"), n) for n in range(1, GRAM + 1))))
    grams = outer.select(F.col("x").alias("outer"), F.explode(every).alias("gram"))
    return anchors.join(grams, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: pairs of texts that contain each other either way, each once. Empty texts have none."""
    left, right = (d.toDF("x").where("x <> ''").distinct() for d in (left, right))
    one = _within(left, right).toDF("left", "right")
    return one.unionByName(_within(right, left).toDF("right", "left").select("left", "right")).distinct()


def resolved(rows: DataFrame, rules: DataFrame, name: str = "name", domain: str = "domain") -> DataFrame:
    """rows with canonical: by the first rule of a domain that holds, else by the first without a domain, else the name.

    rules: rule (their order), domain (null: of all domains), alias, canonical. Names are compared in lower case without
    blanks around; a null name stays null, a null or empty domain has the general rules only.
    """
    key = rows.select(N.clean_name(F.col(name)).alias("alias"), F.coalesce(squeezed(F.col(domain)), F.lit("")).alias("d")).where("alias is not null").distinct()
    known = rules.select("rule", N.clean_name(F.col("alias")).alias("alias"), F.coalesce(squeezed(F.col("domain")), F.lit("")).alias("r"), F.col("domain").isNull().alias("general"), "canonical")
    asked = key.join(known.select("alias").distinct(), "alias", "left_semi")  # names that have a rule at all
    own = known.where("not general")
    pairs = containing(asked.select("d"), own.select("r")).toDF("d", "r")
    found = asked.join(pairs, "d").join(own, ["alias", "r"]).select("alias", "d", F.lit(0).alias("kind"), "rule", "canonical")
    found = found.unionByName(asked.join(known.where("general"), "alias").select("alias", "d", F.lit(1).alias("kind"), "rule", "canonical"))
    best = found.groupBy("alias", "d").agg(F.min(F.struct("kind", "rule", "canonical")).alias("best"))
    best = best.select(F.col("alias").alias("__alias"), F.col("d").alias("__d"), F.col("best.canonical").alias("__to"))
    keyed = rows.withColumns({"__alias": N.clean_name(F.col(name)), "__d": F.coalesce(squeezed(F.col(domain)), F.lit(""))})
    out = keyed.join(best, ["__alias", "__d"], "left").withColumn("canonical", F.coalesce("__to", F.col(name)))
    return out.drop("__alias", "__d", "__to")
