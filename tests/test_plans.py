from briefmill.plans import data, nested
from briefmill.runtime import table


def test_every_prediction_is_rendered(spark, tiny):
    own = data.sc25_rendered_outputs(spark, tiny)
    assert own.count() == table(spark, tiny, "predictions").count() == own.filter("markdown <> ''").count()


def test_every_prediction_is_judged(spark, tiny):
    own = data.sc17_judge_prompts(spark, tiny)
    rows = table(spark, tiny, "predictions")
    assert own.count() == own.select("prediction_id").distinct().count() == rows.count()
    known = rows.join(table(spark, tiny, "briefs").select("item_id").distinct(), "item_id", "left_semi")
    assert own.filter("prompt NOT LIKE '%BRIEF:\n(brief unavailable)%'").count() == known.count()


def test_every_child_has_an_entity_row(spark, tiny):
    """A row for each child, with its parent's node, and every scalar below it in some table."""
    queries = nested.QUERIES
    nodes = {(r.output_id, r.node): r for r in queries["p7_nodes"](spark, tiny).collect()}
    found = {r.child: r["count"] for r in nested.p7_found(spark, tiny).groupBy("child").count().collect()}
    tables = {"mapping": "p7_mapping_entities", "rationale": "p7_rationale_entities", **{c: f"p7_{c}_table" for c in ("alternative", "layer", "channel", "interaction", "target", "field")}}
    scalars = 0
    for child, name in tables.items():
        rows = queries[name](spark, tiny).collect()
        assert len(rows) == found[child]
        assert all((r.output_id, r.parent) in nodes and nodes[r.output_id, r.node].parent == r.parent for r in rows)
        keep = [c for c in rows[0].asDict() if c not in ("output_id", "node", "parent", "encoding_node") and not c.endswith("pos")]
        scalars += sum(r[c] is not None for r in rows for c in keep)
    assert scalars == sum(n.kind == "scalar" for n in nodes.values())
