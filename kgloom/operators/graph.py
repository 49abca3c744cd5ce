"""Graph operators over edge tables: mentions (chunk, entity) and relationships (src, dst).

Every result has a total order, so it doesn't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.shared import sendable, stored

CHUNK_LIMIT, EXPAND_LIMIT, EXPAND_USED, CONTEXT_LIMIT, K = 10, 5, 3, 5, 5


def title_filter(title: Column | None, entity_title: Column | None = None, domain: Column | None = None, aliases: Column | None = None) -> Column:
    """Whether an entity is of the asked title: by its own title, or by domain or alias. No title asks for none."""
    if title is None:
        return F.lit(True)
    if aliases is not None:
        return title.isNull() | (domain == title) | F.array_contains(aliases, title)
    return title.isNull() | (entity_title == title)


def of_title(title: Column, columns: list[str]) -> Column:
    """title_filter by the columns that rows of entities have: aliases and domain (version 2), else title (version 1)."""
    if "aliases" in columns:
        return title_filter(title, domain=F.col("domain"), aliases=F.col("aliases"))
    return title_filter(title, entity_title=F.col("title")) if "title" in columns else F.lit(True)


def entity_chunks(asked: DataFrame, mentions: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """query_id, entity_pos, chunk_id: chunks that mention each asked entity, the `limit` least ids of each.

    asked: query_id, entity_pos, name and, if entities are to be of a title, title (null: of any); mentions: chunk_id, name
    and what tells the title of the mentioned entity.
    """
    said = mentions.where(F.col("chunk_id").isNotNull())
    keys = ["name", "title"] if "title" in asked.columns else ["name"]
    who = asked.select(*keys).distinct().withColumnsRenamed({"title": "__title"})
    found = said.join(who, "name")
    if "title" in keys:
        found = found.where(of_title(F.col("__title"), mentions.columns))
    # what an entity is asked by decides on its chunks: they are ranked once, whoever asks, and tasks send the first ones only
    by = [c if c == "name" else "__title" for c in keys]
    nth = F.dense_rank().over(Window.partitionBy(*by).orderBy("chunk_id"))
    firsts = found.select(*by, "chunk_id").withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth").distinct()
    firsts = firsts.withColumnRenamed("name", "__name")
    same = F.col("name") == F.col("__name")
    if "title" in keys:
        same &= F.col("title").eqNullSafe(F.col("__title"))
    rows = asked.join(firsts, same).select("query_id", "entity_pos", "chunk_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id", "entity_pos").orderBy("chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst in both directions, once each, without loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst and src is not null and dst is not null").distinct()


#: Neighbours of one list, in the mean.
LIST = 1024


#: Ways over two edges that one block of seeds has, at most and at least; blocks to a core in between.
BLOCK_MOST, BLOCK_LEAST, BLOCKS = 1 << 23, 1 << 20, 4


def neighbours(step: DataFrame) -> DataFrame:
    """src, near: the neighbours of each place as lists, of which a hub has as many as it needs."""
    sized = step.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("src")))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / LIST)).alias("part")
    return sized.groupBy("src", part).agg(F.collect_list("dst").alias("near")).drop("part")


def expanded(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int | None = EXPAND_LIMIT, entities: DataFrame | None = None) -> DataFrame:
    """name, related, hops: what is reached from each seed over at most `hops` edges, nearest first.

    Without a limit the first two hops go together (`_within_two`). Else each level is joined once and made distinct, and what
    was reached before doesn't go on: a hub is passed once for each seed, not once for each path. Ways are shuffled as lists, one for each of a seed's last places, never one by one. With a limit, seeds that have reached as many don't go on either. With entities (name and
    what tells their title) and seeds that have a title, only related entities of that title count; ways lead over any.
    """
    keys = ["name"] if entities is None else ["name", "title"]
    within = hops >= 2 and limit is None  # nothing stops: seeds that reach alike go together
    seen = seeds.select(*keys, F.col("name").alias("related"), F.lit(0).alias("hops")).distinct()
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]

    def counted(rows: DataFrame) -> DataFrame:
        if entities is None:
            return rows.where("hops > 0")
        of = entities.withColumnsRenamed({c: f"__{c}" for c in entities.columns if c not in ("domain", "aliases")})
        met = rows.where("hops > 0").join(of, F.col("related") == F.col("__name"))
        kind = of_title(F.col("title"), ["aliases"]) if "aliases" in entities.columns else title_filter(F.col("title"), entity_title=F.col("__title"))
        return met.where(kind).select(rows.columns).distinct()

    front = seen
    if within:
        kind = seeds.select("name").union(edges.select("src")).schema[0].dataType
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
        step = both.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).repartition("src").distinct()  # moved once, for the lists too
        near = neighbours(step)
        near = stored(near.withColumns({"least": F.array_min(F.transform("near", lambda x: F.hash(x))), "n": F.size("near")}), "neighbours")
        seen = _within_two(seen.select(*keys), near)
        front, near = seen.where("hops = 2"), near.select("src", "near")
    else:
        near = neighbours(undirected(edges))
    for h in range(3 if within else 1, hops + 1):
        # what is reached and what was before are dealt by seed as lists, which become rows, and these one each, where they arrive
        ways = front.join(near, F.col("related") == F.col("src")).select(*keys, "near", F.lit(h).alias("hops"))
        known = seen.select(*keys, F.array("related").alias("near"), "hops")
        dealt = ways.unionByName(known).repartition(*keys).select(*keys, F.explode("near").alias("related"), "hops")
        seen = dealt.groupBy(*keys, "related").agg(F.min("hops").alias("hops"))
        front = seen.where(F.col("hops") == h)
        if limit is not None and h < hops:
            full = counted(seen).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
            front = front.alias("a").join(full.alias("b"), same("a", "b"), "left_anti")
    out = counted(seen)
    if limit is None:
        return out
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hops", "related"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def _within_two(seeds: DataFrame, near: DataFrame) -> DataFrame:
    """seeds' columns (name, ...), related, hops: what is within two edges of each seed, itself included.

    Seeds are dealt in blocks, and a place's list is sent once to each block that has a way over it, not once for each
    seed; what a block reaches is made distinct where it arrives. Seeds that reach alike have the same least place among
    what they reach, and are of one block as long as its ways are bounded, so that few blocks need a list. Blocks decide
    on what is sent where, and never on the result.
    """
    spark, keys, kind = seeds.sparkSession, seeds.columns, near.schema["src"].dataType
    seed = lambda c: F.hash(F.col(c).cast(kind)).alias("seed")  # noqa: E731  equal numbers share a block
    seeds = stored(seeds, "seeds")
    ids = sendable(seeds.select(seed("name")).distinct())
    met = near.select("least", "n", F.explode("near").alias("to")).select(seed("to"), "least", "n")
    work = stored(met.join(ids, "seed", "left_semi").groupBy("seed").agg(F.min("least").alias("least"), F.sum("n").alias("ways")), "ways")
    all_ways = work.agg(F.sum("ways")).first()[0] or 0
    most = max(BLOCK_LEAST, min(BLOCK_MOST, all_ways // (BLOCKS * spark.sparkContext.defaultParallelism)))
    parts = work.groupBy("least").agg(F.ceil(F.sum("ways") / most).alias("parts"))
    block = F.xxhash64("least", F.pmod(F.xxhash64("seed"), F.col("parts"))).alias("block")
    blocks = stored(work.join(parts, "least").select("seed", block), "blocks")
    blocks = sendable(blocks)
    tasks = int(max(spark.sparkContext.defaultParallelism, min(20_000, 2 * all_ways // most)))

    # a seed's places go to its block once, and so do the lists of these places
    begun = near.select("src", "near", seed("src")).join(blocks, "seed").join(sendable(seeds), F.col("src") == F.col("name"))
    owned = begun.select("block", F.struct(*keys).alias("who"), F.lit(None).cast(kind).alias("place"), "near")
    asked = near.select("src", F.explode("near").alias("to")).select("src", seed("to")).join(blocks, "seed").select("src", "block").distinct()
    lists = near.join(asked, "src").select("block", F.lit(None).cast(owned.schema["who"].dataType).alias("who"), F.col("src").alias("place"), "near")
    dealt = owned.unionByName(lists).repartition(tasks, "block")

    # where they arrive they meet at the place; the list of a hub is several rows, which pass one by one
    over = F.explode(F.when(F.col("who").isNull(), F.array("place")).otherwise(F.col("near"))).alias("at")
    at = dealt.select("block", "who", F.when(F.col("who").isNull(), F.col("near")).alias("near"), over)
    whos = F.collect_list("who").over(Window.partitionBy("block", "at"))
    paired = at.withColumn("whos", F.when(F.col("who").isNull(), whos).otherwise(F.array("who")))
    ways = paired.select("block", F.explode("whos").alias("who"), F.coalesce("near", F.array("at")).alias("near"), F.when(F.col("who").isNull(), 2).otherwise(1).alias("hops"))
    met = ways.select("block", "who", F.explode("near").alias("related"), "hops").where("related <> who.name")
    reached = met.groupBy("block", "who", "related").agg(F.min("hops").alias("hops")).select("who.*", "related", "hops")
    return seeds.select(*keys, F.col("name").alias("related"), F.lit(0).alias("hops")).unionByName(reached)


def entity_context(asked: DataFrame, edges: DataFrame, mentions: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """name, related, chunks: the first related entities and chunks of each asked name, as sorted arrays.

    Both sides are aggregated before they meet, so related entities and chunks don't multiply. If asked has titles, chunks
    are those whose mention is of the title.
    """
    near = undirected(edges).join(asked.select(F.col("name").alias("src")).distinct(), "src")
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    related = near.withColumn("r", place).where(F.col("r") <= limit).groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("related"))
    if "title" in asked.columns:
        said = mentions.join(asked.select("name", F.col("title").alias("__title")).distinct(), "name").where(of_title(F.col("__title"), mentions.columns))
    else:
        said = mentions.join(asked.select("name").distinct(), "name")
    said = said.select("name", "chunk_id").distinct()
    place = F.row_number().over(Window.partitionBy("name").orderBy("chunk_id"))
    chunks = said.withColumn("r", place).where(F.col("r") <= limit).groupBy("name").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks"))
    return asked.select("name").distinct().join(related, "name", "left").join(chunks, "name", "left")


def search(asked: DataFrame, mentions: DataFrame, edges: DataFrame | None = None, k: int = K, max_hops: int = 1, entities: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, position: chunks of the asked entities in their order, k at most.

    With edges, entities near each asked one add their chunks after its own. Entities are taken until 2 k chunks have been
    found, counted after each; later ones aren't looked at. With entities (name and what tells their title), asked has a
    title: entities and the ones near them have to be of it, and only those asked with a title lead to others.
    """
    titled = ["title"] if entities is not None else []
    asked = asked.select("query_id", "entity_pos", "name", *titled)
    direct = entity_chunks(asked, mentions, max(k, CHUNK_LIMIT)).select("query_id", "entity_pos", F.lit(0).alias("far"), "chunk_id")
    found = direct
    if edges is not None:
        seeds = asked.select("name", *titled).distinct()
        near = expanded(seeds if entities is None else seeds.where("title is not null"), edges, max_hops, entities=entities).where(F.col("rank") <= EXPAND_USED)
        more = asked.join(near, ["name", *titled]).select("query_id", "entity_pos", F.col("related").alias("name"), "rank", *titled)
        via = entity_chunks(more.select("query_id", (F.col("entity_pos") * EXPAND_LIMIT + F.col("rank")).alias("entity_pos"), "name", *titled), mentions, max(k, CHUNK_LIMIT))
        back = F.floor((F.col("entity_pos") - 1) / EXPAND_LIMIT).cast("int")
        found = direct.unionByName(via.select("query_id", back.alias("entity_pos"), F.lit(1).alias("far"), "chunk_id"))
    first = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("entity_pos", "far")).alias("at")).select("query_id", "chunk_id", "at.entity_pos", "at.far")
    counts = first.groupBy("query_id", "entity_pos").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("entity_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = counts.withColumn("before", before).where(F.col("before") < 2 * k).select("query_id", "entity_pos")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("entity_pos", "far", "chunk_id"))
    return first.join(open_, ["query_id", "entity_pos"], "left_semi").withColumn("position", place).where(F.col("position") <= k).select("query_id", "chunk_id", "position")


# ---------------------------------------------------------------- maintenance


def collisions(entities: DataFrame) -> DataFrame:
    """name, type, n, titles: names of one type that stand under several titles."""
    grouped = entities.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("title")).alias("titles"))
    return grouped.where(F.size("titles") > 1)


def primaries(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """entity_id, primary_id: of entities equal in name and type the one with the most relationships, least id on ties."""
    ends = edges.select(F.col("src").alias("entity_id")).unionByName(edges.select(F.col("dst").alias("entity_id")))
    degree = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    rated = entities.join(degree, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = rated.groupBy("name", "type").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("entity_id").alias("id"))).alias("p"))
    return entities.join(best, ["name", "type"]).select("entity_id", F.col("p.id").alias("primary_id"))


def redirected(edges: DataFrame, mapping: DataFrame, ends: list[str]) -> DataFrame:
    """Edges with each end at its primary entity, once each. Ends without an entry stay."""
    out = edges
    for end in ends:
        m = mapping.select(F.col("entity_id").alias(end), F.col("primary_id").alias("__to"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("__to", F.col(end))).drop("__to")
    return out.select(edges.columns).distinct()


def collapsed(nodes: DataFrame, rels: DataFrame, mentions: DataFrame, mapping: DataFrame, key: str = "id", mention: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables when every entity of the mapping (entity_id, primary_id) has become its primary one.

    Duplicates go; relationships that are then equal in ends, type and description are one, as are mentions. What of equal
    relationships else differs is taken from the least of them.
    """
    gone = mapping.where("entity_id <> primary_id").select("entity_id", "primary_id")
    left = nodes.join(gone.select(F.col("entity_id").alias(key)), key, "left_anti")
    moved = _at_primary(rels, gone, ["source", "target"])
    same = [c for c in ("source", "target", "type", "description") if c in rels.columns]
    rest = [c for c in rels.columns if c not in same]
    once = moved.groupBy(*same).agg(F.min(F.struct(*rest)).alias("r")).select(*same, "r.*").select(rels.columns) if rest else moved.distinct()
    return left.select(nodes.columns), once, _at_primary(mentions, gone, [mention]).distinct()


def _at_primary(rows: DataFrame, gone: DataFrame, ends: list[str]) -> DataFrame:
    out = rows
    for end in ends:
        out = out.join(gone.toDF(end, "__to"), end, "left").withColumn(end, F.coalesce("__to", F.col(end))).drop("__to")
    return out.select(rows.columns)


def verified(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: entities, relationships, entities without a name, entities that no chunk mentions."""
    counts = entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.coalesce("name", F.lit("")) == "").alias("nameless"))
    rels = edges.agg(F.count(F.lit(1)).alias("relationships"))
    orphans = entities.join(mentions.select("entity_id").distinct(), "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return counts.crossJoin(rels).crossJoin(orphans)  # one row each
