"""Property graph of entities and contents: build, upsert, export, cleanup, payments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowloom.functions import ids
from knowloom.functions.text import filename_of, graph_name
from knowloom.functions.values import amount_of_names, graph_currency
from knowloom.operators.merge import first_wins, last_wins
from knowloom.session import materialise


def segments(texts: DataFrame, registry: DataFrame, attachments: DataFrame, messages: DataFrame, mentions: DataFrame, extractor: str, content_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that the extractor has not read, with their provenance, oldest content first.

    Registered content only; attachment and message rows may be missing.
    """
    done = mentions.filter(F.col("extractor") == extractor).select("content_id", "chunk_index").distinct()
    t = texts if content_id is None else texts.filter(F.col("content_id") == content_id)
    todo = t.join(done, ["content_id", "chunk_index"], "left_anti")
    r = registry.select("content_id", "message_id", "attachment_id", "content_type", "metadata", "created_at")
    a = attachments.select("message_id", F.col("id").alias("attachment_id"), F.col("filename").alias("a_name"))
    m = messages.select(F.col("id").alias("message_id"), F.col("subject").alias("m_subject")).dropDuplicates(["message_id"])
    out = todo.join(r, "content_id").join(a, ["message_id", "attachment_id"], "left").join(m, "message_id", "left")
    out = out.select(
        "content_id", "page", "chunk_index", "text", "message_id", "attachment_id", "content_type",
        filename_of(F.col("a_name"), F.col("metadata")).alias("filename"),
        F.coalesce("m_subject", F.get_json_object("metadata", "$.subject")).alias("subject"), "created_at",
    )
    return out if not limit or limit < 0 else out.orderBy("created_at", "content_id", "chunk_index").limit(limit)


def mention_rows(found: DataFrame, segs: DataFrame, extractor: str, created_at: Column) -> DataFrame:
    """Stored mentions of extracted ones (text, label, start_char, end_char, confidence, attributes).

    Attributes come out under ``attributes`` only if they are nested under that
    key themselves, and under ``source_metadata`` otherwise.
    """
    nested = F.get_json_object("attributes", "$.attributes")
    is_object = nested.startswith("{")
    info = segs.select("content_id", "chunk_index", "page", "filename", "subject", "message_id", "attachment_id")
    j = found.join(info, ["content_id", "chunk_index"], "left")
    entity = ids.entity_id(F.col("label"), F.col("text"))
    meta = F.to_json(
        F.struct(
            F.when(is_object, F.from_json(nested, "map<string,string>")).alias("attributes"),
            F.when(F.col("attributes").isNotNull() & ~F.coalesce(is_object, F.lit(False)), F.from_json("attributes", "map<string,string>")).alias("source_metadata"),
            "page", "filename", "subject", "message_id", "attachment_id",
        )
    )
    rows = j.select(
        ids.mention_id(F.col("content_id"), F.col("chunk_index"), F.col("start_char"), F.col("end_char"), entity, F.lit(extractor)).alias("mention_id"),
        F.lit(extractor).alias("extractor"), "content_id", "chunk_index", entity.alias("entity_id"), "label", "text", "start_char", "end_char",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), meta.alias("metadata"), created_at.alias("created_at"),
    )
    one = F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc_nulls_last("metadata")))
    return rows.withColumn("_n", one).filter("_n = 1").drop("_n")


def store_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions of a chunk by the same extractor replaced together; chunks without new mentions keep theirs."""
    keys = ["content_id", "chunk_index", "extractor"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def entities(mentions: DataFrame) -> DataFrame:
    """(entity_id, label, canonical, aliases, created_at, updated_at): one node per label and folded name."""
    return mentions.groupBy("entity_id", "label").agg(
        F.min(ids.normal_mention(F.col("text"))).alias("canonical"),
        F.array_sort(F.collect_set("text")).alias("aliases"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )


def merge_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entity upsert: aliases united and sorted, created_at kept, updated_at renewed."""
    both = old.unionByName(new).withColumn("alias", F.explode_outer("aliases"))
    return both.groupBy("entity_id", "label").agg(
        F.min("canonical").alias("canonical"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )


def entity_nodes(ents: DataFrame) -> DataFrame:
    """Entities as stored nodes with JSON properties."""
    return ents.select("entity_id", "label", F.to_json(F.struct("aliases", "canonical", "created_at", "updated_at")).alias("properties"))


def content_nodes(segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of contents, added where absent."""
    p = F.to_json(F.struct("attachment_id", "content_type", "filename", "message_id", "subject"))
    new = segs.select(F.col("content_id").alias("entity_id"), F.lit("Content").alias("label"), p.alias("properties")).distinct()
    return first_wins(nodes, new, ["entity_id"])


def edges(mentions: DataFrame) -> DataFrame:
    """MENTIONED_IN edges from entities to contents, one per mention."""
    p = F.to_json(F.struct("chunk_index", "content_id", "created_at", "end_char", "extractor", "start_char"))
    return mentions.select(
        ids.relation_id(F.col("mention_id")).alias("relation_id"), F.col("entity_id").alias("source_id"), F.col("content_id").alias("target_id"), F.lit("MENTIONED_IN").alias("relation_type"), p.alias("properties")
    )


def build(segs: DataFrame, found: DataFrame, extractor: str, created_at: Column, mentions: DataFrame, nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mentions, nodes, relations, counted segments) after reading the segments.

    Edges of replaced mentions stay, as a mention's removal does not remove its edge.
    """
    rows = mention_rows(found, segs, extractor, created_at)
    read = rows.select("content_id", "chunk_index").distinct()
    fresh = entities(rows)
    old = nodes.filter(F.col("label") != "Content")
    schema = "canonical string, aliases array<string>, created_at string, updated_at string"
    old_ents = old.withColumn("p", F.from_json("properties", schema)).select("entity_id", "label", "p.*")
    merged = entity_nodes(merge_aliases(old_ents, fresh))
    with_contents = content_nodes(segs.join(read, ["content_id", "chunk_index"], "left_semi"), nodes.filter(F.col("label") == "Content"))
    return store_mentions(mentions, rows), merged.unionByName(with_contents), last_wins(relations, edges(rows), ["relation_id"]), read


def export_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes for a graph store: clean label, properties as a map with the id among them."""
    m = F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    with_id = F.when(F.map_contains_key(m, F.lit("id")), m).otherwise(F.map_concat(m, F.create_map(F.lit("id"), F.col("entity_id"))))
    return nodes.select("entity_id", graph_name(F.coalesce("label", F.lit("Entity")), "Entity").alias("label"), with_id.alias("properties"))


def export_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges for a graph store; an edge with a missing end is left out."""
    n = nodes.select("entity_id").distinct()
    m = F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    typed = relations.select("relation_id", "source_id", "target_id", graph_name(F.coalesce("relation_type", F.lit("RELATED_TO")), "RELATED_TO").alias("relation_type"), m.alias("properties"))
    kept = typed.join(n.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi")
    return kept.join(n.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")


def _stored(spark, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:  # nothing stored yet
        return like.limit(0)


def export(nodes: DataFrame, relations: DataFrame, path: str | None = None, sink=None, clear: bool = False) -> tuple[int, int]:
    """Merge the graph into a Parquet export, or hand partitions to ``sink(kind, rows)``; returns the numbers of nodes and edges offered.

    Nodes are merged by id, edges by relation id, over what an earlier export
    left, unless ``clear`` empties it first (a sink is told by ``sink("clear",
    ())``).  Edges with a missing end are counted but not written.
    """
    out_nodes, out_edges = export_nodes(nodes), export_edges(relations, nodes)
    if path:
        for name, fresh, key in (("nodes", out_nodes, "entity_id"), ("edges", out_edges, "relation_id")):
            place = f"{path}/{name}"
            merged = fresh if clear else last_wins(_stored(fresh.sparkSession, place, fresh), fresh, [key])
            # The old export is read before it is written over.
            materialise(merged).write.mode("overwrite").parquet(place)
    if sink:
        if clear:
            sink("clear", ())
        out_nodes.foreachPartition(lambda rows: sink("node", rows))
        out_edges.foreachPartition(lambda rows: sink("edge", rows))
    return nodes.count(), relations.count()


def remove_extractor(mentions: DataFrame, nodes: DataFrame, relations: DataFrame, prefix: str = "spacy:") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without what extractors of a name prefix left: mentions, their edges, and nodes nothing points to.

    Nodes go by null-aware NOT IN: one null among the ids keeps all nodes.
    """
    kept_m = mentions.filter(~F.coalesce(F.col("extractor").ilike(f"{prefix}%"), F.lit(False)))
    kept_r = relations.filter(~F.coalesce(F.col("properties").ilike(f"%{prefix}%"), F.lit(False)))
    used = kept_m.select("entity_id").unionByName(kept_r.select(F.col("source_id").alias("entity_id"))).unionByName(kept_r.select(F.col("target_id").alias("entity_id"))).distinct()
    if not used.filter(F.col("entity_id").isNull()).isEmpty():
        return kept_m, nodes, kept_r
    return kept_m, nodes.join(used, "entity_id", "left_semi"), kept_r


def payments(nodes: DataFrame, relations: DataFrame, counterparty: str, limit: int | None = None) -> DataFrame:
    """Money mentioned in the same contents as a counterparty: amount, currency and provenance.

    The counterparty is found by its canonical name; the currency is read from
    the amount's text and the canonical name together.  Rows are distinct in what
    they show and, for a limit, ordered by it.
    """
    name = counterparty.strip().lower()
    who = nodes.filter(F.get_json_object("properties", "$.canonical") == name).select(F.col("entity_id").alias("source_id"))
    e = relations.filter(F.col("relation_type") == "MENTIONED_IN").select("source_id", "target_id")
    where = e.join(who, "source_id", "left_semi").select("target_id").distinct()
    money = nodes.filter(F.col("label") == "MONEY").select(F.col("entity_id").alias("source_id"), F.col("properties").alias("m"))
    content = nodes.filter(F.col("label") == "Content").select(F.col("entity_id").alias("target_id"), F.col("properties").alias("c"))
    # Properties are parsed last, for the few rows that are left.
    met = e.join(where, "target_id", "left_semi").distinct().join(money, "source_id").join(content, "target_id")
    amounts, infos = "canonical string, aliases array<string>", "subject string, filename string, content_type string, message_id string, attachment_id string"
    rows = met.select(F.from_json("m", amounts).alias("m"), F.from_json("c", infos).alias("c")).select("m.*", "c.*").distinct().withColumn("canonical", F.coalesce("canonical", F.lit("")))
    read = amount_of_names(F.col("canonical"), F.col("aliases"))
    out = rows.withColumn("r", read).select(
        F.col("r.value").alias("amount"), F.col("r.text").alias("amount_text"), graph_currency(F.concat_ws(" ", "r.text", "canonical")).alias("currency"), "subject", "filename", "content_type", "message_id", "attachment_id"
    )
    return out if not limit or limit < 0 else out.orderBy("message_id", "attachment_id", "filename", "subject", "amount_text").limit(limit)


def totals(mentions: DataFrame) -> DataFrame:
    """Sum of the amounts by currency; unknown amounts are left out, unknown currencies are UNKNOWN."""
    return mentions.filter(F.col("amount").isNotNull()).groupBy(F.coalesce("currency", F.lit("UNKNOWN")).alias("currency")).agg(F.sum("amount").alias("total"))
