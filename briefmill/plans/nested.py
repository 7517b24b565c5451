"""Problem 7: design outputs as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.operators.shred import entities, position, shred
from briefmill.runtime import cut, table

ROOTS = ["kpi_chart_mapping", "rationales", "interactions"]
ARRAYS = ["kpi_chart_mapping", "rationales", "interactions", "alternatives", "layers", "channels", "targets", "fields"]
#: Child record: the path of its elements and how many positions it has.
CHILDREN = {
    "mapping": ("kpi_chart_mapping", 1),
    "alternative": ("kpi_chart_mapping.alternatives", 2),
    "layer": ("kpi_chart_mapping.encoding.layers", 2),
    "channel": ("kpi_chart_mapping.encoding.layers.channels", 3),
    "rationale": ("rationales", 1),
    "interaction": ("interactions", 1),
    "target": ("interactions.targets", 2),
    "field": ("interactions.targets.fields", 3),
}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(table(spark, sf_dir, "design_outputs"), "output_id", ROOTS, ARRAYS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each child record, with its positions; see TESTDATA.md."""
    name = None
    for child, (path, depth) in CHILDREN.items():
        own = F.when((F.col("path") == path) & (F.size("positions") == depth), F.lit(child))
        name = own if name is None else F.coalesce(name, own)
    found = nodes(spark, sf_dir).withColumn("child", name).filter(F.col("child").isNotNull())
    return found.select("output_id", "child", *[position(F.col("positions"), i).alias(f"pos{i + 1}") for i in range(3)])


def p7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacency table itself: every node with its parent, label, ordinal and scalar."""
    ordinal = F.try_element_at(F.col("positions"), F.lit(-1)).alias("ordinal")
    return nodes(spark, sf_dir).select("output_id", "node", "parent", "path", "label", ordinal, "kind", "scalar")


def p7_mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings as a flat table: a row for each mapping with its scalar fields and the node it hangs from."""
    out = entities(nodes(spark, sf_dir), "output_id", "kpi_chart_mapping", ["kpi", "task_type", "chart_type"], ["pos"])
    return out.select("output_id", "pos", "kpi", "task_type", "chart_type")


def p7_rationale_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entities(nodes(spark, sf_dir), "output_id", "rationales", ["claim", "principle"], ["pos"])
    return out.select("output_id", "pos", "claim", "principle")


def p7_channel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels as a flat table; node and parent lead to the layer, and from there to the mapping."""
    path = "kpi_chart_mapping.encoding.layers.channels"
    return entities(nodes(spark, sf_dir), "output_id", path, ["name", "field"], ["mapping_pos", "layer_pos", "channel_pos"])


def p7_target_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(nodes(spark, sf_dir), "output_id", "interactions.targets", ["kpi"], ["interaction_pos", "target_pos"])


def p7_mapping_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings with node and parent and the scalars of their encoding; encoding_node is the parent of its layers."""
    path = "kpi_chart_mapping"
    # Both entities are made of the same few nodes, so records are walked once.
    paths = [path, f"{path}.encoding", *[f"{path}.{f}" for f in ("kpi", "task_type", "chart_type", "encoding.x", "encoding.y")]]
    own = cut(nodes(spark, sf_dir).filter(F.col("path").isin(paths)))
    encoding = entities(own, "output_id", f"{path}.encoding", ["x", "y"], ["pos"])
    encoding = encoding.select("output_id", F.col("parent").alias("node"), F.col("node").alias("encoding_node"), F.col("value").alias("encoding_text"), F.col("x").alias("encoding_x"), F.col("y").alias("encoding_y"))
    return entities(own, "output_id", path, ["kpi", "task_type", "chart_type"], ["pos"]).join(encoding, ["output_id", "node"], "left")


def p7_rationale_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(nodes(spark, sf_dir), "output_id", "rationales", ["claim", "principle"], ["pos"])


def p7_alternative_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(nodes(spark, sf_dir), "output_id", "kpi_chart_mapping.alternatives", [], ["mapping_pos", "alternative_pos"])


def p7_layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as a flat table; parent is the encoding of the mapping."""
    return entities(nodes(spark, sf_dir), "output_id", "kpi_chart_mapping.encoding.layers", ["mark"], ["mapping_pos", "layer_pos"])


def p7_interaction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions as a flat table; value holds those that are text."""
    return entities(nodes(spark, sf_dir), "output_id", "interactions", ["type", "label"], ["pos"])


def p7_field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(nodes(spark, sf_dir), "output_id", "interactions.targets.fields", [], ["interaction_pos", "target_pos", "field_pos"])


_ALL = (p7_found, p7_nodes, p7_mapping_table, p7_rationale_table, p7_channel_table, p7_target_table)
_ALL += (p7_mapping_entities, p7_rationale_entities, p7_alternative_table, p7_layer_table, p7_interaction_table, p7_field_table)
QUERIES = {f.__name__: f for f in _ALL}

_UNNEST = "(SELECT output_id, unnest(range(len({c}))) AS pos, unnest({c}) AS x FROM design_outputs)"
ORACLE = {
    "p7_mapping_table": f"SELECT output_id, CAST(pos AS INTEGER) AS pos, x.kpi AS kpi, x.task_type AS task_type, x.chart_type AS chart_type FROM {_UNNEST.format(c='kpi_chart_mapping')} WHERE x IS NOT NULL",
    "p7_rationale_table": f"SELECT output_id, CAST(pos AS INTEGER) AS pos, x.claim AS claim, x.principle AS principle FROM {_UNNEST.format(c='rationales')} WHERE x IS NOT NULL",
}
