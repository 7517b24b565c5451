"""A mix of sources by target weights, in tokens.

Documents are the leaves' of a tree (domain, language, source); domain and language may be columns of the documents, and a source's
weight is then split over its branches by their tokens. Weights add up the tree. A total is handed down: each child gets its share
by weight but no more than its subtree can give (tokens times the greatest number of repeats), and what one child falls short is
taken by its siblings, by weight, before anything is asked of other branches. Each leaf then gives whole epochs of its
documents and, in a last epoch, a prefix of a seeded order of them. The order is by fine hash buckets in an epoch's own
permutation, then by hash, so the prefix is found from token sums of buckets, and only the documents of one bucket are ever sorted. What the prefixes of one
source's branches together fall short by buys the next document of some of them, so a source as a whole falls short by less than one.

Defined cases: null and empty texts have no tokens and are not taken; documents whose source (null included) has no target are not
taken; a null level is a branch of its own; a target without documents gives its weight to its siblings, or to all branches where
its place is only known from documents; a source never exceeds its budget; equal texts are documents of their own; without any usable target the mix is empty.
If no total is given, it is the largest with which every leaf that has documents reaches its share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefmill.runtime import BROADCAST_ROWS, cut, small

#: Hash buckets of each leaf; a power of two.
BUCKETS = 4096
#: Where a level is null.
UNKNOWN = "unknown"


@dataclass
class Node:
    """A node of the tree; leaves have a weight, the tokens that are there and the greatest number of repeats."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def tree_of(leaves: list[tuple[tuple[str, ...], float, float]]) -> Node:
    """A tree of (path, weight, capacity) leaves; a node's weight and capacity are the sums of its leaves'."""
    root = Node("")
    for path, weight, capacity in leaves:
        node = root
        for name in path:
            node.weight, node.capacity = node.weight + weight, node.capacity + capacity
            node = node.children.setdefault(name, Node(name))
        node.weight, node.capacity = node.weight + weight, node.capacity + capacity
    return root


def shared(budget: float, children: list[Node]) -> list[float]:
    """``budget`` by weight, no child above its capacity, shortages to the siblings."""
    given = [0.0] * len(children)
    open_ = [i for i, c in enumerate(children) if c.capacity > 0 and c.weight > 0]
    left = budget
    while open_ and left > 1e-9:
        weights = sum(children[i].weight for i in open_)
        full = [i for i in open_ if children[i].capacity <= left * children[i].weight / weights + 1e-9]
        if not full:
            for i in open_:
                given[i] = left * children[i].weight / weights
            break
        for i in full:
            given[i] = children[i].capacity
        left -= sum(given[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return given


def budgets(node: Node, total: float, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
    """The budget of each leaf."""
    if not node.children:
        return {path: min(total, node.capacity)}
    children = list(node.children.values())
    out: dict[tuple[str, ...], float] = {}
    for child, part in zip(children, shared(min(total, node.capacity), children), strict=True):
        out |= budgets(child, part, (*path, child.name))
    return out


def largest_total(leaves: list[tuple[tuple[str, ...], float, float]]) -> float:
    """The largest total with which every leaf that has documents reaches its share."""
    endless = budgets(tree_of([(p, w, 1e18 if c > 0 else 0.0) for p, w, c in leaves]), 1.0)
    limits = [c / endless[p] for p, _, c in leaves if c > 0 and endless[p] > 0]
    return min(limits, default=0.0)


def mixture(counted: DataFrame, targets: DataFrame, levels: list[str], leaf: str = "source", key: str = "doc_id", total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix (key, leaf, epoch, n_tokens) and its report, a row for each target.

    counted: key, ``leaf``, n_tokens and those of the columns ``levels`` that the documents have themselves. targets: ``leaf``, the
    other columns of ``levels`` (the last is ``leaf``), target_weight, max_repeats. Targets and branches are a row for each leaf of
    the tree on the driver; they are broadcast if they are counted to be few, else joined by shuffles.
    """
    spark = counted.sparkSession
    inner = [x for x in levels if x != leaf]
    here = [x for x in inner if x in counted.columns]
    rows = targets.select(*[x for x in inner if x not in here], leaf, "target_weight", "max_repeats").collect()
    names = [r[leaf] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a leaf has more than one target")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BUCKETS)).cast("int")
    wanted = small(spark.createDataFrame([(n,) for n in names], f"{leaf} string"))
    known = [F.coalesce(F.col(x).cast("string"), F.lit(UNKNOWN)).alias(x) for x in here]
    own = counted.filter(F.col("n_tokens") > 0).select(key, leaf, *known, "n_tokens", bucket.alias("bucket")).join(wanted, leaf)
    branch = [*here, leaf]
    by_bucket = cut(own.groupBy(*branch, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    sums = by_bucket.groupBy(*branch).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).orderBy(*branch).collect()
    there: dict[str, list] = {}
    for r in sums:
        there.setdefault(r[leaf], []).append(r)
    leaves, parts = [], []
    for r in rows:
        mine = there.get(r[leaf], [])
        whole = sum(x["tokens"] for x in mine)
        for x in mine or [None]:
            # A target without documents is a branch of its own below the root.
            path = tuple(str(x[n] if x and n in here else r[n] if n not in here else r[leaf]) for n in inner) + (str(r[leaf]),)
            share = x["tokens"] / whole if x else 1.0
            leaves.append((path, float(r["target_weight"] or 0) * share, float((x["tokens"] if x else 0) * (r["max_repeats"] or 0))))
            parts.append((r, x))
    total = largest_total(leaves) if total is None else total
    given = budgets(tree_of(leaves), total) if leaves else {}
    plan, budget_of = [], dict.fromkeys(names, 0.0)
    for (r, x), (path, _, _) in zip(parts, leaves, strict=True):
        budget, most = given[path], r["max_repeats"] or 0
        budget_of[r[leaf]] += budget
        if x:
            full = min(int(budget / x["tokens"] + 1e-9), most)
            rest = max(0.0, budget - full * x["tokens"])
            plan.append((*[x[n] for n in branch], full, full + 1 if rest > 0.5 and full < most else 0, rest))
    plans = small(spark.createDataFrame(plan, ", ".join(f"{n} string" for n in branch) + ", full int, partial int, rest double"))

    # The last epoch's order of buckets: an odd multiplier and a start of its own.
    place = F.pmod(F.col("bucket").cast("bigint") * (2 * (F.lit(seed * 7919) + F.col("partial") * 104729) + 1) + F.col("partial") * 15485863, F.lit(BUCKETS))
    ordered = by_bucket.join(plans, branch).filter("partial > 0").withColumn("place", place)
    so_far = Window.partitionBy(*branch).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut(ordered.withColumn("run", F.sum("tokens").over(so_far)).filter(F.col("run") - F.col("tokens") < F.col("rest")))
    whole = run.filter(F.col("run") <= F.col("rest")).select(*branch, "bucket")
    edge = run.filter(F.col("run") > F.col("rest")).select(*branch, "bucket", (F.col("rest") - (F.col("run") - F.col("tokens"))).alias("room"))

    everyone = own.join(plans.select(*branch, "full", "partial"), branch)
    out = [key, leaf, "epoch", "n_tokens"]
    epochs = everyone.filter("full > 0").select(key, leaf, F.explode(F.sequence(F.lit(1), F.col("full"))).alias("epoch"), "n_tokens")
    last = everyone.filter("partial > 0").withColumnRenamed("partial", "epoch")
    prefix = last.join(small(whole, 200_000), [*branch, "bucket"]).select(*out)
    in_bucket = Window.partitionBy(*branch).orderBy(F.xxhash64(F.lit(seed), "epoch", key), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = last.join(small(edge), [*branch, "bucket"]).withColumn("run", F.sum("n_tokens").over(in_bucket)).filter(F.col("run") - F.col("n_tokens") <= F.col("room"))
    # What the branches of a target fall short by, less than a document each, buys the next documents of some of them.
    following = border.filter(F.col("run") > F.col("room")).withColumn("left", F.col("room") - (F.col("run") - F.col("n_tokens")))
    of_target = Window.partitionBy(leaf)
    in_order = of_target.orderBy(F.xxhash64(F.lit(seed), "epoch", key), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bought = following.withColumn("all_left", F.sum("left").over(of_target)).withColumn("spent", F.sum("n_tokens").over(in_order)).filter(F.col("spent") <= F.col("all_left"))
    mix = epochs.unionByName(prefix).unionByName(border.filter(F.col("run") <= F.col("room")).select(*out)).unionByName(bought.select(*out))

    # A document's first epoch is 1, so documents are counted there.
    taken = mix.groupBy(leaf).agg(F.sum("n_tokens").alias("tokens_taken"), F.sum((F.col("epoch") == 1).cast("bigint")).alias("docs_taken"), F.max("epoch").alias("epochs"))
    stock = [(n, sum(x["tokens"] for x in there.get(n, [])), sum(x["docs"] for x in there.get(n, [])), float(budget_of[n])) for n in names]
    known_stock = small(spark.createDataFrame(stock, f"{leaf} string, tokens_there bigint, docs_there bigint, budget double"))
    report = targets.select(*[x for x in levels if x not in here], "target_weight", "max_repeats").join(known_stock, leaf, "left").join(F.broadcast(taken) if len(names) <= BROADCAST_ROWS else taken, leaf, "left")
    report = report.fillna(0, ["tokens_taken", "docs_taken", "epochs"])
    # A row for each target; the whole is summed over these few rows.
    whole_mix = F.sum("tokens_taken").over(Window.partitionBy(F.lit(0)))
    return mix, report.withColumn("share_reached", F.when(whole_mix > 0, F.col("tokens_taken") / whole_mix).otherwise(0.0))
