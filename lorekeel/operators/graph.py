"""Graph and time: traversal, revisions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeel.errors import EntityNotFound, ResolutionAmbiguous, RevisionNotFound, ValidationError
from lorekeel.operators import ledger
from lorekeel.session import persist_table

EDGE_KEY = ("source_id", "target_id", "relation_type", "valid_from")


def dedup_edges(relationships: DataFrame) -> DataFrame:
    """One row for each (source, target, label, valid_from), NULL being a value of its own: the first discovered, then the
    one with the smallest description."""
    rest = [c for c in ("discovered_at", "description", "document_id", "run_id", "confidence", "qualifier_id", "relation_kind_id", "valid_until") if c in relationships.columns]
    first = F.min(F.struct(F.coalesce("discovered_at", F.lit("9999-01-01").cast("timestamp")).alias("_t"), *rest)).alias("f")
    return relationships.groupBy(*EDGE_KEY).agg(first).select(*EDGE_KEY, *[F.col(f"f.{c}") for c in rest])


def save_edges(new: DataFrame, held: DataFrame) -> DataFrame:
    """The edges of a batch that the table does not hold yet, valid ones only, each key once."""
    ok = dedup_edges(new.where(~temporal_violation()))
    h = held.select(*[F.col(c).alias(f"_{c}") for c in EDGE_KEY])
    cond = F.lit(True)
    for c in EDGE_KEY:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ok.join(h, cond, "left_anti")


def temporal_violation() -> Column:
    """A period that ends before it begins; an open one cannot."""
    return F.coalesce(F.col("valid_until") < F.col("valid_from"), F.lit(False))


def k_hop(relationships: DataFrame, root: str, hops: int, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_id, depth) and edges within ``hops`` of a root, along edges in either direction.

    Edges are the distinct edges met while expanding, so an edge between two nodes of the last layer isn't
    among them; 0 hops give the root alone. With ``least`` only edges of that confidence are followed. Each
    round joins the last layer with the edges once; layers are written so that the plan stays of one size.
    """
    edges = relationships.select(*EDGE_KEY, "confidence")
    if least is not None:
        edges = edges.where(F.col("confidence") >= least)
    edges = edges.select(*EDGE_KEY).distinct()
    both = edges.select("*", F.col("source_id").alias("here"), F.col("target_id").alias("there")).unionByName(edges.select("*", F.col("target_id").alias("here"), F.col("source_id").alias("there")))
    spark = relationships.sparkSession
    nodes = spark.createDataFrame([(root, 0)], "entity_id string, depth int")
    layer, met = nodes, None
    for depth in range(1, hops + 1):
        step = persist_table(both.join(layer.select(F.col("entity_id").alias("here")), "here"), "k-hop")
        met = step.select(*EDGE_KEY) if met is None else met.unionByName(step.select(*EDGE_KEY))
        new = step.select(F.col("there").alias("entity_id")).distinct().join(nodes, "entity_id", "left_anti").withColumn("depth", F.lit(depth))
        layer = persist_table(new, "k-hop-layer")
        nodes = nodes.unionByName(layer)
        if not layer.limit(1).count():
            break
    return nodes, met.distinct() if met is not None else edges.limit(0)


def root_of(entities: DataFrame, entity_id: str | None = None, name: str | None = None) -> str:
    """The id of the one entity a traversal starts at; an unknown one, or a name (without case) of several, is an error."""
    if (entity_id is None) == (name is None):
        raise ValidationError("give either an id or a name")
    rows = entities.where(F.col("entity_id") == entity_id if entity_id is not None else F.lower("canonical_name") == name.lower()).select("entity_id", "canonical_name").distinct().orderBy("entity_id").limit(6).collect()
    if not rows:
        raise EntityNotFound(entity_id or name)
    if len({r[0] for r in rows}) > 1:
        raise ResolutionAmbiguous(f"{name}: " + ", ".join(f"{r[0]} {r[1]}" for r in rows[:5]))
    return rows[0][0]


def subgraph(entities: DataFrame, aliases: DataFrame, relationships: DataFrame, root: str, hops: int, least: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The neighbourhood of a root: entities (position, .., aliases), edges (position, ..), documents of the edges.

    Entities are the root, then the others by name; ids without a record are left out. Edges go by their key, NULL dates first.
    """
    if hops < 0:
        raise ValidationError("hops must not be negative")
    nodes, met = k_hop(relationships, root, hops, least)
    names = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    near = entities.join(F.broadcast(nodes) if hops == 0 else nodes, "entity_id").join(names, "entity_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    # Positions over all rows, not by a window over all of them: a hub has any number of neighbours.
    at = lambda df, *order: ledger.numbered(df, list(order), "position").withColumn("position", F.col("position").cast("int"))
    near = at(near.withColumn("_other", F.col("entity_id") != root), "_other", "canonical_name", "entity_id").select("position", "entity_id", "canonical_name", "entity_type", "subtype", "description", "aliases", "status", "depth")
    cond = F.lit(True)
    for c in EDGE_KEY:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    keys = met.select(*[F.col(c).alias(f"_{c}") for c in EDGE_KEY])
    rows = relationships.where(F.col("confidence") >= least) if least is not None else relationships
    edges = dedup_edges(rows.join(keys, cond, "left_semi"))
    edges = persist_table(at(edges, *EDGE_KEY), "edges")
    return near, edges, edges.where("document_id is not null").select("document_id").distinct()


def resolve_root(entities: DataFrame, name: str) -> DataFrame:
    """The entities a traversal may start at: those of that id or, without case, that name."""
    return entities.where((F.col("entity_id") == name) | (F.lower("canonical_name") == name.lower()))


# ---------------------------------------------------------------- revisions
def revisions(snapshots: DataFrame) -> DataFrame:
    """The log of an entity's records: history_id, changed_at, operation (create, update, merge) and the record.

    Dumps bring exact repeats; a history_id counts once. The first revision of an entity creates it, and one whose
    status is merged where the one before was not merges it.
    """
    s = snapshots.dropDuplicates(["snapshot_id"]).withColumnRenamed("snapshot_id", "history_id").withColumnRenamed("snapshot_at", "changed_at")
    rows = ledger.with_previous(s.where("entity_id is not null"), "entity_id", "history_id", "status")
    op = F.when(F.col("is_first"), "create").when((F.col("status") == "merged") & ~F.col("previous_value").eqNullSafe(F.lit("merged")), "merge").otherwise("update")
    return rows.withColumn("operation", op).drop("previous_value", "is_first")


def state_at(log: DataFrame, moment: Column) -> DataFrame:
    """For each entity the revision with the greatest history_id of those changed at or before a moment.

    An aggregate, not a window: an entity with any number of revisions is combined on the map side.
    """
    cols = [c for c in log.columns if c not in ("entity_id", "history_id")]
    last = F.max(F.struct("history_id", *[F.col(c) for c in cols])).alias("r")
    return log.where(F.col("changed_at") <= moment).groupBy("entity_id").agg(last).select("entity_id", "r.*")


def revision(log: DataFrame, entity_id: str, history_id: int) -> DataFrame:
    """One revision of an entity; an unknown one is an error."""
    one = log.where((F.col("entity_id") == entity_id) & (F.col("history_id") == history_id))
    if not one.limit(1).count():
        raise RevisionNotFound(f"{entity_id} {history_id}")
    return one


def revert(log: DataFrame, entity_id: str, history_id: int | DataFrame, now: Column) -> DataFrame:
    """An old revision written as the newest one, with operation revert; its number, or a frame of one row that has it."""
    top = log.agg(F.max("history_id").alias("top"))
    old = log.where(F.col("entity_id") == entity_id)
    old = (old.where(F.col("history_id") == history_id) if isinstance(history_id, int) else old.join(F.broadcast(history_id), "history_id", "left_semi")).drop("history_id")
    return old.crossJoin(F.broadcast(top)).withColumn("history_id", F.col("top") + 1).drop("top").withColumn("operation", F.lit("revert")).withColumn("changed_at", now).select(log.columns)


# ---------------------------------------------------------------- merges
def closed_merges(mapping: DataFrame) -> DataFrame:
    """(old_id, new_id) with chains followed to their end; ids in a circle, or that lead into one, stay as they are.

    Each round doubles the steps taken. Of a chain that ends, some id arrives in every round, so once a round brings
    none to its end, all that still move go round in circles.
    """
    now = persist_table(mapping.where("old_id != new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id")), "merges")
    before = -1
    while True:
        nxt = now.join(now.toDF("_old", "_new"), F.col("new_id") == F.col("_old"), "left").select("old_id", F.coalesce("_new", "new_id").alias("to"), F.col("_new").isNotNull().alias("moved"))
        nxt = persist_table(nxt, "merges")
        now = nxt.select("old_id", F.col("to").alias("new_id"))
        moving = nxt.where("moved").count()
        if moving in (0, before):
            break
        before = moving
    circle = now.join(now.select(F.col("old_id").alias("_o")), F.col("new_id") == F.col("_o"), "left_semi")
    return now.join(circle.select("old_id"), "old_id", "left_anti")


def _moved(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    m = mapping.toDF("_old", "_new")
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def redirect_provenance(provenance: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions of merged entities as mentions of the survivors; where both have a key, the survivor's own row stays."""
    key = ["entity_id", "document_id", "mention_text"]
    rows = provenance.where("entity_id is not null").withColumn("_was", F.col("entity_id"))
    rows = _moved(rows, mapping, "entity_id").withColumn("_own", (F.col("_was") != F.col("entity_id")).cast("int"))
    rest = ["source", "context_snippet", "detected_at", "run_id"]
    first = F.min(F.struct("_own", F.coalesce("detected_at", F.lit("9999-01-01").cast("timestamp")).alias("_t"), *rest)).alias("f")
    return rows.groupBy(*key).agg(first).select(*key, *[F.col(f"f.{c}") for c in rest])


def redirect_relationships(relationships: DataFrame, mapping: DataFrame, drop_loops: bool = False) -> DataFrame:
    """Edges with merged ids replaced in all four columns that hold ids, then each key once; loops that a merge made
    are dropped on demand."""
    rows = relationships.withColumn("_loop", F.col("source_id") == F.col("target_id"))
    for c in ("source_id", "target_id", "qualifier_id", "relation_kind_id"):
        rows = _moved(rows, mapping, c)
    if drop_loops:
        rows = rows.where("_loop or source_id != target_id")
    return dedup_edges(rows.drop("_loop"))


def merged_entities(entities: DataFrame, mapping: DataFrame, now: Column) -> DataFrame:
    """The entity table after the merges: losers are merged into survivors and updated now."""
    m = mapping.toDF("_old", "_new")
    rows = entities.join(m, F.col("entity_id") == F.col("_old"), "left")
    hit = F.col("_new").isNotNull()
    return rows.withColumn("status", F.when(hit, "merged").otherwise(F.col("status"))).withColumn("merged_into", F.coalesce("_new", "merged_into")).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("_old", "_new")


def upsert(held: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Entities with new records in place of old ones of the same id; created_at stays, updated_at is now."""
    old = held.select(F.col("entity_id").alias("_id"), F.col("created_at").alias("_c"))
    fresh = new.join(old, F.col("entity_id") == F.col("_id"), "left").withColumn("created_at", F.coalesce("_c", "created_at", now)).withColumn("updated_at", F.when(F.col("_id").isNotNull(), now).otherwise(F.col("updated_at"))).drop("_id", "_c")
    return held.join(new.select("entity_id"), "entity_id", "left_anti").unionByName(fresh.select(held.columns))


def checked(relationships: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges against the rules (source_type, target_type, label): (.., problem), 'pair' for an unknown pair of types and
    'label' for an unusual label; edges in order are left out, and so are those with an end that is no entity."""
    e = entities.select("entity_id", "entity_type")
    rows = relationships.join(e.toDF("source_id", "source_type"), "source_id").join(e.toDF("target_id", "target_type"), "target_id")
    pairs = rules.select(F.col("source_type").alias("_s"), F.col("target_type").alias("_t")).distinct()
    labels = rules.toDF("_ls", "_lt", "_label")
    out = rows.join(F.broadcast(pairs), (F.col("source_type") == F.col("_s")) & (F.col("target_type") == F.col("_t")), "left")
    out = out.join(F.broadcast(labels), (F.col("source_type") == F.col("_ls")) & (F.col("target_type") == F.col("_lt")) & (F.col("relation_type") == F.col("_label")), "left")
    return out.where("_label is null").withColumn("problem", F.when(F.col("_s").isNull(), "pair").otherwise("label")).drop("_s", "_t", "_ls", "_lt", "_label")


def detail_counts(entities: DataFrame, relationships: DataFrame, provenance: DataFrame) -> DataFrame:
    """(entity_id, relationships, mentions) of every entity; a loop counts once. Ends are counted before the join, so a hot one is one row a task."""
    ends = relationships.select("source_id", "target_id").select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id"))
    r = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("relationships"))
    p = provenance.where("entity_id is not null").groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    return entities.select("entity_id").join(r, "entity_id", "left").join(p, "entity_id", "left").na.fill(0, ["relationships", "mentions"])


def histogram(relationships: DataFrame) -> DataFrame:
    """(relation_type, edges, mean_confidence); NULL confidence does not count in the mean."""
    return relationships.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
