"""Knowledge-graph building: parsing extractions, normalising, merging across chunks, guarding, upserting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from kgloom.functions import names as N
from kgloom.functions import text as T
from kgloom.shared import sendable, stored

# Delimiters of extraction output.
FIELD, END = "<|#|>", "<|COMPLETE|>"


def normalized_entities(entities: DataFrame) -> DataFrame:
    """Names in lower case without blanks around, types in upper case, keywords never null."""
    return entities.withColumns({"name": N.clean_name(F.col("name")), "type": F.upper("type"), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})


def normalized_relationships(rels: DataFrame) -> DataFrame:
    """Ends in lower case without blanks around; the type stays and is the semantic type; strength 5 if missing or 0."""
    return rels.withColumns({"source": N.clean_name(F.col("source")), "target": N.clean_name(F.col("target")), "semantic_type": F.col("type"), "strength": F.coalesce(F.nullif(F.col("strength"), F.lit(0)), F.lit(N.DEFAULT_STRENGTH)), "keywords": F.coalesce("keywords", F.array().cast("array<string>"))})


def in_batch(df: DataFrame) -> DataFrame:
    """Only what names the document it is from."""
    return df.where(F.col("source_doc_id").isNotNull())


def _facts(rows: DataFrame, keys: list[str], best: Column, first: Column, raw: Column, chunks: bool) -> DataFrame:
    """keys, best, first, raws, keywords and, if they are asked for, chunks: what occurs in the rows of each key.

    Each row gives a fact for itself, its chunk and every keyword. Facts are reduced by key and value first, and only
    different values come together: a key that a third of all rows have is split by its values, and its arrays are as
    long as the results.
    """
    kind = rows.schema["chunk"].dataType
    fact = lambda k, text=None, chunk=None: F.struct(F.lit(k).alias("kind"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if chunk is None else chunk).cast(kind).alias("chunk"))
    keywords = F.coalesce("keywords", F.array().cast("array<string>"))
    given = F.concat(F.array(fact(0, raw), *([fact(1, chunk=F.col("chunk"))] if chunks else [])), F.transform(keywords, lambda k: fact(2, k)))
    facts = rows.select(*keys, best.alias("best"), first.alias("first"), F.explode(given).alias("v"))
    own = F.col("v.kind") == 0
    values = facts.groupBy(*keys, "v").agg(F.min(F.when(own, F.col("best"))).alias("best"), F.min(F.when(own, F.col("first"))).alias("first"), F.count(F.lit(1)).alias("n"))
    among = lambda k, x: F.collect_list(F.when(F.col("v.kind") == k, x))
    return values.groupBy(*keys).agg(
        F.min("best").alias("best"),
        F.min("first").alias("first"),
        among(0, F.struct(F.col("v.text").alias("raw"), "n", "first")).alias("raws"),
        F.array_sort(among(2, F.col("v.text"))).alias("keywords"),
        *([F.array_sort(among(1, F.col("v.chunk"))).alias("chunks")] if chunks else []),
    )


def merged_entities(rows: DataFrame, domain: Column | None = None, chunks: bool = True) -> DataFrame:
    """One row for each canonical name and type: name, type, description, keywords, chunks (unless not asked for), aliases.

    rows: chunk, seq, name, type, description, keywords; seq is the order of occurrence, of any type that has an order, on
    which the result depends: the longest description wins, of equally long ones the first; other names are aliases from
    the second occurrence on, that of the first only if it occurs again.
    """
    raw = N.clean_name(F.col("name"))
    rows = rows.withColumns({"raw": raw, "name": N.canonical_name(raw, domain), "type": F.upper(F.coalesce("type", F.lit("OTHER"))), "description": F.coalesce("description", F.lit(""))})
    longest = F.struct((-F.length("description")).alias("l"), "seq", "description")
    found = _facts(rows, ["name", "type"], longest, F.struct("seq", "raw"), F.col("raw"), chunks)
    later = F.filter("raws", lambda r: (r["raw"] != F.col("name")) & ((r["raw"] != F.col("first.raw")) | (r["n"] > 1)))
    return found.select("name", "type", F.col("best.description").alias("description"), "keywords", *(["chunks"] if chunks else []), F.array_sort(F.transform(later, lambda r: r["raw"])).alias("aliases"))


def merged_relationships(rows: DataFrame, domain: Column | None = None) -> DataFrame:
    """One row for each source, target and type: the longest description, the greatest strength, all keywords and chunks.

    rows: chunk, seq, source, target, type, description, strength, keywords, semantic_type.
    """
    ends = {end: N.canonical_name(N.clean_name(F.col(end)), domain) for end in ("source", "target")}
    rows = rows.withColumns({**ends, "type": F.coalesce("type", F.lit(N.DEFAULT_REL_TYPE)), "description": F.coalesce("description", F.lit("")), "strength": F.coalesce("strength", F.lit(N.DEFAULT_STRENGTH))})
    # all but the sets is the same however often a row comes, so that a row for each keyword does
    facts = rows.select(
        "source", "target", "type", "strength", "chunk",
        F.struct((-F.length("description")).alias("l"), "seq", "description").alias("best"),
        F.struct("seq", F.coalesce("semantic_type", "type").alias("semantic_type")).alias("first"),
        F.explode_outer("keywords").alias("keyword"),
    )
    return facts.groupBy("source", "target", "type").agg(
        F.min("best")["description"].alias("description"),
        F.max("strength").alias("strength"),
        F.min("first")["semantic_type"].alias("semantic_type"),
        F.array_sort(F.collect_set("keyword")).alias("keywords"),
        F.array_sort(F.collect_set("chunk")).alias("chunks"),
    )


def guarded(rels: DataFrame, entities: DataFrame, compat: bool = False) -> DataFrame:
    """Relationships whose ends are both known names. compat: no entities at all means no guard."""
    known = entities.select("name").distinct()
    kept = rels.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    if compat and entities.isEmpty():
        return rels
    return kept.select(rels.columns)


def loose_ends(extractions: DataFrame, domain: Column | None = None) -> DataFrame:
    """name: canonical names that relationships end at and that their own extraction doesn't have as an entity.

    Ends that it has are known names, whatever else there is, so that only the others need to be looked up.
    """
    of = lambda name, field: F.coalesce(F.transform(f"result.{name}", lambda x: N.clean_name(x[field])), F.array().cast("array<string>"))
    ends = F.concat(of("relationships", "source"), of("relationships", "target"))
    rows = extractions.select("chunk", F.explode(F.array_except(ends, of("entities", "name"))).alias("name"))
    return rows.where("name is not null").select(N.canonical_name(F.col("name"), domain).alias("name")).distinct()


def tied_relationships(rels: DataFrame, loose: DataFrame, entities: DataFrame) -> DataFrame:
    """As `guarded`, where only the given ends (name) may be unknown: relationships at the others aren't moved for it."""
    unknown = sendable(stored(loose.select("name").join(entities.select("name"), "name", "left_anti"), "unknown-ends"))
    out = rels.where("source is not null and target is not null")
    for end in ("source", "target"):
        out = out.join(unknown.withColumnRenamed("name", end), end, "left_anti")
    return out.select(rels.columns)


def merged_gleaning(initial: DataFrame, gleaned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, description: the last of the first pass, unless the second pass has a strictly longer one.

    Both: keys, seq, description. In the second pass too each strictly longer one replaces what is there.
    """
    first = initial.groupBy(*keys).agg(F.max_by("description", "seq").alias("a"))
    longest = gleaned.groupBy(*keys).agg(F.min_by("description", F.struct(-F.length("description"), "seq")).alias("b"))
    both = first.join(longest, keys, "full_outer")
    pick = F.when(F.col("a").isNull() | (F.length("b") > F.length("a")), F.col("b")).otherwise(F.col("a"))
    return both.select(*keys, pick.alias("description"))


def _kept(content: Column) -> Column:
    """Lines before the end mark, trimmed."""

    def cut(lines: Column) -> Column:
        stop = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(END))), F.lit(True))
        return T.let(stop, lambda at: F.when(at > 0, F.slice(lines, F.lit(1), at.cast("int") - 1)).otherwise(lines))

    return T.let(F.transform(F.split(F.trim(content), "\n"), lambda x: F.trim(x)), cut)


def _entries(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Lines before the end mark with their fields."""
    return df.select(*keys, F.posexplode(_kept(F.col(content))).alias("line_no", "line")).where("line <> ''")


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, r"<\|#\|>"), lambda x: F.trim(x))


def _typed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    parts = rows.withColumn("f", _fields(F.col("line")))
    at = lambda i: F.get("f", F.lit(i))
    entities = parts.where((at(0) == "entity") & (F.size("f") >= 4)).select(*keys, "line_no", at(1).alias("name"), F.upper(at(2)).alias("type"), at(3).alias("description"))
    rels = parts.where((at(0) == "relation") & (F.size("f") >= 5)).select(*keys, "line_no", at(1).alias("source"), at(2).alias("target"), at(3).alias("type"), at(4).alias("description"))
    return entities, rels


def parsed_columns(content: Column) -> Column:
    """struct(entities, relationships) of one output, by the rules of `parsed`, as arrays in the order of the lines."""
    at = lambda f, i: F.get(f, F.lit(i))

    def typed(lines: Column) -> Column:
        entities = F.filter(lines, lambda f: (at(f, 0) == "entity") & (F.size(f) >= 4))
        rels = F.filter(lines, lambda f: (at(f, 0) == "relation") & (F.size(f) >= 5))
        return F.struct(
            F.transform(entities, lambda f: F.struct(at(f, 1).alias("name"), F.upper(at(f, 2)).alias("type"), at(f, 3).alias("description"))).alias("entities"),
            F.transform(rels, lambda f: F.struct(at(f, 1).alias("source"), at(f, 2).alias("target"), at(f, 3).alias("type"), at(f, 4).alias("description"))).alias("relationships"),
        )

    return T.let(F.transform(_kept(content), _fields), typed)


def parsed(df: DataFrame, keys: list[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of delimited extraction output; lines after the end mark or with too few fields go."""
    return _typed(_entries(df, keys, content), keys)


def is_complete(content: Column) -> Column:
    return F.contains(content, F.lit(END))


def parsed_batch(df: DataFrame, batch_ids: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """The same for output of several documents, whose lines begin with doc_id:<id>; ids that weren't asked for go."""
    rows = _entries(df, [], content)
    head = F.regexp_extract("line", r"^doc_id:(-?\d+)<\|#\|>", 1)
    rows = rows.withColumn("doc_id", F.try_to_number(F.nullif(head, F.lit("")), F.lit("S999999999999999999")).cast("long")).where("doc_id is not null")
    rows = rows.withColumn("line", F.regexp_replace("line", r"^doc_id:-?\d+<\|#\|>", "")).join(batch_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return _typed(rows, ["doc_id"])


def upserted_nodes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge by key: a property of the new row replaces the old one unless it is null."""
    rest = [c for c in old.columns if c not in key] + [c for c in new.columns if c not in key and c not in old.columns]
    a, b = old.select(*key, F.struct(*[c for c in old.columns]).alias("a")), new.select(*key, F.struct(*[c for c in new.columns]).alias("b"))
    pick = lambda c: F.coalesce(*([F.col(f"b.{c}")] if c in new.columns else []), *([F.col(f"a.{c}")] if c in old.columns else [])).alias(c)
    return a.join(b, key, "full_outer").select(*key, *map(pick, rest))


def upserted_merge(old: DataFrame, new: DataFrame, key: list[str], lists: list[str], compat: bool = False) -> DataFrame:
    """As upserted_nodes, but the given list columns are united (compat: concatenated, with repeats)."""
    empty = F.array()
    a, b = old.select(*key, F.struct(*old.columns).alias("a")), new.select(*key, F.struct(*new.columns).alias("b"))
    rest = [c for c in old.columns if c not in key]

    def pick(c: str) -> Column:
        if c in lists:
            kind = old.schema[c].dataType
            x, y = F.coalesce(f"a.{c}", empty.cast(kind)), F.coalesce(f"b.{c}", empty.cast(kind))
            return (F.concat(x, y) if compat else F.array_sort(F.array_union(x, y))).alias(c)
        return F.coalesce(f"b.{c}", f"a.{c}").alias(c)

    return a.join(b, key, "full_outer").select(*key, *map(pick, rest))


#: What an upsert makes of a column's values. Lists are united, all else is replaced, unless told otherwise.
POLICIES = ("last", "first", "greatest", "longest", "unite", "concatenate")
NODE_POLICIES = {"description": "first", "domain": "first"}


def policy_of(schema: StructType, column: str, policies: dict[str, str]) -> str:
    policy = policies.get(column, "unite" if isinstance(schema[column].dataType, ArrayType) else "last")
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    return policy


def reduced(rows: DataFrame, key: list[str], policies: dict[str, str], order: str | None = None) -> DataFrame:
    """One row of each key, by each column's policy; first and last by the order column, or as the rows are read.

    Elements of united lists are rows of their own until they are different, so a key that a third of all rows have is
    reduced in each task first, and its lists are as long as the results.
    """
    names, kinds = [c for c in rows.columns if c not in key], {c: policy_of(rows.schema, c, policies) for c in rows.columns if c not in key}
    lists = [c for c in names if kinds[c] == "unite"]
    at = F.col(order) if order else F.monotonically_increasing_id()
    numbered = lambda i: lambda x: F.struct(F.lit(i).alias("i"), x.cast("string").alias("x"))
    elements = [F.transform(c, numbered(i)) for i, c in enumerate(lists)]
    rows = rows.withColumns({"__at": at, **({"__all": F.concat(*(F.coalesce(e, F.array().cast("array<struct<i:int,x:string>>")) for e in elements))} if lists else {})})
    spread = rows.select(*key, "__at", *(c for c in names if c not in lists), *(F.col(c).isNotNull().alias(f"__has_{c}") for c in lists), *([F.explode_outer("__all").alias("__e")] if lists else []))

    def one(c: str) -> Column:
        x, kind = F.col(c), rows.schema[c].dataType
        if kinds[c] == "unite":
            found = F.array_sort(F.collect_set(F.when(F.col("__e.i") == lists.index(c), F.col("__e.x")))).cast(kind)
            return F.when(F.bool_or(f"__has_{c}"), F.array_sort(found)).alias(c)
        if kinds[c] == "concatenate":
            parts = F.sort_array(F.collect_set(F.when(x.isNotNull(), F.struct("__at", x.alias("x")))))
            return F.when(F.count(x) > 0, F.flatten(F.transform(parts, lambda p: p["x"]))).alias(c)
        if kinds[c] == "greatest":
            return F.max(x).alias(c)
        if kinds[c] == "longest":
            return F.min_by(x, F.when(x.isNotNull(), F.struct((-F.length(x)).alias("l"), F.col("__at")))).alias(c)
        return (F.max_by if kinds[c] == "last" else F.min_by)(x, F.when(x.isNotNull(), F.col("__at"))).alias(c)

    return spread.groupBy(*key).agg(*map(one, names)) if names else spread.select(*key).distinct()


def merged_columns(old: DataFrame, new: DataFrame, key: list[str], policies: dict[str, str]) -> DataFrame:
    """Full outer merge by key of tables with one row for each, by each column's policy."""
    rest = [c for c in old.columns if c not in key] + [c for c in new.columns if c not in key and c not in old.columns]
    a, b = old.select(*key, F.struct(*old.columns).alias("a")), new.select(*key, F.struct(*new.columns).alias("b"))

    def pick(c: str) -> Column:
        if c not in old.columns or c not in new.columns:
            return F.col(f"{'a' if c in old.columns else 'b'}.{c}").alias(c)
        x, y, policy = F.col(f"a.{c}"), F.col(f"b.{c}"), policy_of(old.schema, c, policies)
        if policy == "unite":
            return F.coalesce(F.array_sort(F.array_union(x, y)), x, y).alias(c)
        if policy == "concatenate":
            return F.coalesce(F.concat(x, y), x, y).alias(c)
        if policy == "greatest":
            return F.greatest(x, y).alias(c)
        if policy == "longest":
            return F.when(F.length(y) > F.coalesce(F.length(x), F.lit(-1)), y).otherwise(x).alias(c)
        return (F.coalesce(y, x) if policy == "last" else F.coalesce(x, y)).alias(c)

    return a.join(b, key, "full_outer").select(*key, *map(pick, rest))


def created_relationships(rels: DataFrame, nodes: DataFrame, key: str = "name") -> DataFrame:
    """Relationships whose ends are nodes; each given row is one, repeats included."""
    known = nodes.select(key).distinct()
    return rels.join(known.withColumnRenamed(key, "source"), "source", "left_semi").join(known.withColumnRenamed(key, "target"), "target", "left_semi").select(rels.columns)


def upserted_relationships(old: DataFrame, new: DataFrame) -> DataFrame:
    """Once for each source, target and type; the last properties win."""
    return upserted_nodes(old, new, ["source", "target", "type"])


def last_title(rows: DataFrame) -> DataFrame:
    """Nodes merged on the name alone: the type and title of the last occurrence. rows: seq, name, type, title."""
    return rows.groupBy("name").agg(F.max_by("type", "seq").alias("type"), F.max_by("title", "seq").alias("title"))


def inferred_type(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, type: that of the first entity of the name, else OTHER. entities: name, type, seq."""
    first = entities.groupBy("name").agg(F.min_by("type", "seq").alias("type"))
    return names.select("name").join(first, "name", "left").select("name", F.coalesce("type", F.lit("OTHER")).alias("type"))


def by_document(entities: DataFrame, rels: DataFrame, batch_ids: DataFrame | None = None, order: str = "line_no") -> DataFrame:
    """doc_id, entities, relationships: arrays of what was found for each document, in the order column's
    order or, without one, sorted.

    Documents of the batch for which nothing was found have empty arrays; documents outside it are added. Both inputs carry
    doc_id; what one extraction of one document gives is bounded by the model's output.
    """

    def gather(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("doc_id", order)]
        at = [F.col(order).alias("__at")] if order in df.columns else []
        found = F.sort_array(F.collect_list(F.struct(*at, F.struct(*rest).alias("x"))))
        return df.groupBy("doc_id").agg(F.transform(found, lambda r: r["x"]).alias(name))

    both = gather(entities, "entities").join(gather(rels, "relationships"), "doc_id", "full_outer")
    if batch_ids is not None:
        both = both.join(batch_ids.select("doc_id").distinct(), "doc_id", "full_outer")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select("doc_id", empty("entities"), empty("relationships"))


def flattened(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of entities and relationships with their chunk and seq, their order: (chunk, position within the chunk).

    extractions: chunk, of any type that has an order, and result (struct of the arrays entities and relationships).
    """
    position = lambda name: F.posexplode(f"result.{name}").alias("pos", "x")
    seq = F.struct("chunk", "pos").alias("seq")
    entities = extractions.select("chunk", position("entities")).select("chunk", seq, "x.*")
    rels = extractions.select("chunk", position("relationships")).select("chunk", seq, "x.*")
    return entities, rels.withColumns({"keywords": F.array().cast("array<string>"), "semantic_type": F.col("type")})
