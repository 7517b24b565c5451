"""Metrics of structured outputs: (predictions, references) -> one row for each group.

``by`` names the columns that runs are told apart by; every metric is one or two aggregations over them, so many runs are
evaluated in one job. References are few columns and unique by item after ``last_wins``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.functions import jsonout, text, vocab
from briefmill.operators.relational import last_wins, value_range, zipped
from briefmill.runtime import cut, lookup_join, small


def token(x: Column) -> Column:
    return F.trim(F.lower(x))


def no_texts() -> Column:
    return F.array().cast("array<string>")


def charts(mapping: Column) -> Column:
    """The chart of each mapping, normalised; elements without one left out."""
    return F.coalesce(F.transform(F.filter(mapping, lambda m: m.isNotNull() & m["chart_type"].isNotNull()), lambda m: token(m["chart_type"])), no_texts())


def alternatives(mapping: Column) -> Column:
    """The alternatives of the first mapping, normalised."""
    first = F.try_element_at(mapping, F.lit(1))
    return F.coalesce(F.transform(F.filter(first["alternatives"], lambda a: a.isNotNull()), token), no_texts())


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def count_of(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def schema_compliance(predictions: DataFrame, by: list[str], raw: str = "raw_text", parsed: str | None = None) -> DataFrame:
    """Rates of parsable, complete and valid outputs over all rows; completeness counts a text without object as 0. ``parsed`` names
    what ``parsed_output`` made of ``raw``, if that is there already."""
    p = F.col(parsed) if parsed else jsonout.parsed_output(F.col(raw))
    own = predictions.select(*by, p.alias("p")).select(*by, F.col("p.object").isNotNull().alias("found"), F.col("p.keys").alias("keys"), F.col("p.filled_keys").alias("filled"), F.col("p.valid").alias("valid"))
    need = len(vocab.REQUIRED_KEYS)
    covered = [count_of(F.array_contains("keys", k)).alias(f"n_{k}") for k in vocab.REQUIRED_KEYS]
    out = own.groupBy(*by).agg(F.count("*").alias("n"), count_of(F.col("found")).alias("n_parsed"), count_of(F.size("keys") == need).alias("n_keys"), count_of(F.col("valid")).alias("n_valid"), F.sum(F.size("filled")).alias("filled"), *covered)
    return out.select(
        *by,
        "n",
        percent(F.col("n_parsed"), F.col("n")).alias("json_parse_rate"),
        percent(F.col("n_keys"), F.col("n")).alias("required_keys_rate"),
        percent(F.col("n_valid"), F.col("n")).alias("schema_validity_rate"),
        F.round(F.col("filled") / (need * F.col("n")), 4).alias("completeness_score"),
        *[percent(F.col(f"n_{k}"), F.col("n")).alias(f"coverage_{k}") for k in vocab.REQUIRED_KEYS],
    )


def with_reference(predictions: DataFrame, references: DataFrame, item: str, order: str, mapping: str = "kpi_chart_mapping") -> DataFrame:
    """Predictions with the charts of their item's reference, the last one winning; items without a chart are left out."""
    gold = last_wins(references.filter(F.col(item).isNotNull()).select(item, order, mapping), [item], [order])
    gold = gold.select(item, charts(F.col(mapping)).alias("gold")).filter(F.size("gold") > 0)
    return lookup_join(predictions, gold, [item])


def topk_accuracy(joined: DataFrame, by: list[str], mapping: Column, parsed: Column) -> DataFrame:
    """Top-1, and top-3 where at least half of the outputs name alternatives; rows without a parse are wrong, not skipped.

    All alternatives of the first mapping count, however many they are. Accuracy by KPI goes by position, as far as both have charts.
    """
    own = joined.select(*by, parsed.alias("parsed"), "gold", F.when(parsed, charts(mapping)).otherwise(no_texts()).alias("charts"), F.when(parsed, alternatives(mapping)).otherwise(no_texts()).alias("others"))
    gold, first = F.try_element_at("gold", F.lit(1)), F.try_element_at("charts", F.lit(1))
    pairs = zipped(F.col("gold"), F.col("charts"))
    own = own.select(
        *by,
        "parsed",
        F.coalesce(gold == first, F.lit(False)).alias("hit1"),
        (F.size("others") > 0).alias("others"),
        (F.coalesce(gold == first, F.lit(False)) | F.array_contains("others", gold)).alias("hit3"),
        F.size(F.filter(pairs, lambda p: p["a"] == p["b"])).alias("kpi_hits"),
        F.size(pairs).alias("kpis"),
    )
    out = own.groupBy(*by).agg(
        F.count("*").alias("n"),
        count_of(F.col("hit1")).alias("hits1"),
        count_of(F.col("hit3")).alias("hits3"),
        count_of(F.col("hit3") & F.col("others")).alias("hits3_supported"),
        count_of(F.col("others")).alias("n_with_alternatives"),
        count_of(F.col("parsed")).alias("n_predicted"),
        F.sum("kpi_hits").alias("kpi_hits"),
        F.sum("kpis").alias("kpis"),
    )
    enough = F.col("n_with_alternatives") / F.col("n") >= vocab.TOP3_VALID
    return out.select(
        *by,
        "n",
        percent(F.col("hits1"), F.col("n")).alias("top_1_accuracy"),
        enough.alias("top_3_valid"),
        F.when(enough, percent(F.col("hits3"), F.col("n"))).alias("top_3_accuracy"),
        percent(F.col("hits3_supported"), F.col("n_with_alternatives")).alias("top_3_accuracy_supported"),
        F.round(100.0 * F.col("kpi_hits") / F.greatest(F.col("kpis"), F.lit(1)), 2).alias("per_kpi_accuracy"),
        "n_predicted",
        (F.col("n") - F.col("n_predicted")).alias("n_parse_failures"),
        "n_with_alternatives",
    )


def macro_f1(joined: DataFrame, by: list[str], mapping: Column, parsed: Column, labels: str = "union") -> DataFrame:
    """Macro-F1 of the primary chart; a missing prediction is the class ''. labels: union of both sides, or gold."""
    own = joined.select(*by, F.col("gold")[0].alias("t"), F.coalesce(F.when(parsed, F.try_element_at(charts(mapping), F.lit(1))), F.lit("")).alias("p"))
    cells = own.groupBy(*by, "t", "p").agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    true_side = cells.select(*by, F.col("t").alias("c"), hit.alias("tp"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("actual"))
    guess_side = cells.select(*by, F.col("p").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("actual"))
    classes = true_side.unionByName(guess_side).groupBy(*by, "c").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("actual").alias("actual"))
    if labels == "gold":
        classes = classes.filter("actual > 0")
    f1 = 2.0 * F.col("tp") / (F.col("predicted") + F.col("actual"))
    return classes.groupBy(*by).agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.count("*").alias("n_classes"), F.sum("actual").alias("n"))


def latency(predictions: DataFrame, by: list[str], value: str = "latency_ms", qs: tuple[float, float] = (0.5, 0.95)) -> DataFrame:
    """Mean and interpolated percentiles of latencies, exact; nulls and NaN are skipped, groups without any are left out.

    Values are counted by narrow ranges first, which tells the ranges that hold the ranks asked for; only the values of these few
    ranges are looked at again and counted, so no group comes together in a task.
    """
    own = predictions.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("v"), value_range(F.col(value)).alias("r"))
    ranges = cut(own.groupBy(*by, "r").agg(F.count("*").alias("k"), F.sum("v").alias("s")))
    group = Window.partitionBy(*by)
    placed = ranges.withColumn("n", F.sum("k").over(group)).withColumn("before", F.sum("k").over(group.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k"))
    at = [F.lit(q) * (F.col("n") - 1) for q in qs]
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), f(p).cast("bigint").alias("rank")) for i, p in enumerate(at) for side, f in (("low", F.floor), ("high", F.ceil))])
    wanted = placed.withColumn("ranks", F.filter(ranks, lambda x: (x["rank"] >= F.col("before")) & (x["rank"] < F.col("before") + F.col("k")))).filter(F.size("ranks") > 0)
    wanted = wanted.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("r").alias("__r"), "before", "ranks")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("r") == F.col("__r"))
    near = own.join(small(wanted), same).groupBy(*by, "r", "v", "before", "ranks").agg(F.count("*").alias("k"))
    first = F.col("before") + F.sum("k").over(Window.partitionBy(*by, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    picked = near.withColumn("first", first).select(*by, "v", "k", "first", F.explode("ranks").alias("x")).filter((F.col("x.rank") >= F.col("first")) & (F.col("x.rank") < F.col("first") + F.col("k")))
    pick = lambda i, side: F.max(F.when((F.col("x.q") == i) & (F.col("x.side") == side), F.col("v")))
    ends = picked.groupBy(*by).agg(*[pick(i, side).alias(f"{side}{i}") for i in range(len(qs)) for side in ("low", "high")])
    sums = ranges.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("s").alias("s"))
    both = sums.join(small(ends.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in ends.columns if c not in by])), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]))
    mean = F.col("s") / F.col("n")
    between = [F.round(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (p - F.floor(p)), 1).alias(f"p{round(100 * q)}_latency_ms") for i, (q, p) in enumerate(zip(qs, at, strict=True))]
    return both.select(*by, "n", F.round(mean, 1).alias("avg_latency_ms"), F.round(mean / 1000, 3).alias("avg_latency_s"), *between)


def claims_of(rationales: Column) -> Column:
    """Claim and principle of each rationale in one text."""
    return F.transform(F.filter(rationales, lambda r: r.isNotNull()), lambda r: F.concat_ws(" ", F.when(r["claim"] != "", r["claim"]), F.when(r["principle"] != "", r["principle"])))


def passages_of(docs: Column) -> Column:
    return F.transform(F.filter(docs, lambda d: d.isNotNull()), lambda d: F.coalesce(d["text"], F.lit("")))


def supported(docs: Column, rationales: Column) -> Column:
    """(scored, lacking): how many claims of an output can be scored, and how many of them have too few words of its passages; null
    without passages."""
    context = F.array_distinct(F.flatten(F.transform(passages_of(docs), text.content_words)))
    scored = F.filter(F.transform(claims_of(rationales), text.content_words), lambda c: F.size(c) > 0)

    def counted(x: Column) -> Column:
        lacking = F.filter(x["scored"], lambda c: F.size(F.array_intersect(c, x["context"])) / F.size(c) < vocab.LEXICAL_SUPPORT)
        return F.struct(F.size(x["scored"]).alias("scored"), F.size(lacking).alias("lacking"))

    # A list of one binds both, so that the passages' words are read once and not for every claim.
    bound = F.transform(F.array(F.struct(scored.alias("scored"), context.alias("context"))), counted)
    return F.when(F.size(docs) > 0, bound[0])


def grounding(predictions: DataFrame, by: list[str], docs: Column, rationales: Column, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Share of claims that the retrieved passages don't support, averaged over items; items without a claim that can be scored are left out.

    encoder: makes an array of texts an array of their unit vectors; with it support is semantic, else by common words.
    """
    if not encoder:
        return unsupported_rates(predictions.select(*by, supported(docs, rationales).alias("support")), by, "lexical_proxy")
    own = predictions.select(*by, F.filter(claims_of(rationales), lambda c: F.trim(c) != "").alias("claims"), passages_of(docs).alias("passages"))
    own = own.filter((F.size("claims") > 0) & (F.size("passages") > 0))
    own = own.withColumn("claims", encoder(F.col("claims"))).withColumn("passages", encoder(F.col("passages")))
    lacking = F.filter("claims", lambda c: ~semantic_support(c, F.col("passages")))
    return unsupported_rates(own.select(*by, F.struct(F.size("claims").alias("scored"), F.size(lacking).alias("lacking")).alias("support")), by, "semantic")


def unsupported_rates(counted: DataFrame, by: list[str], mode: str) -> DataFrame:
    """Rates of ``grounding`` from (by, support) of each item."""
    own = counted.filter("support.scored > 0").select(*by, F.col("support.scored").alias("scored"), (F.col("support.lacking") / F.col("support.scored")).alias("unsupported"))
    out = own.groupBy(*by).agg(F.avg("unsupported").alias("rate"), F.count("*").alias("n"), F.sum("scored").alias("n_claims"))
    return out.select(*by, F.round(100 * F.col("rate"), 2).alias("unsupported_claim_rate"), F.round(100 * (1 - F.col("rate")), 2).alias("supported_claim_rate"), "n", "n_claims", F.lit(mode).alias("mode"))


def semantic_support(claim: Column, passages: Column, threshold: float = vocab.SEMANTIC_SUPPORT) -> Column:
    """Whether the claim's unit vector is near enough to any passage's; null without either."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, z: s + z)
    return F.array_max(F.transform(passages, lambda p: dot(claim, p))) >= threshold


def robustness(predictions: DataFrame, gold: DataFrame, by: list[str], item: str, variant: str, order: str, mapping: Column, parsed: Column, names: tuple[str, str] = ("original", "paraphrase")) -> DataFrame:
    """Consistency and accuracy of paraphrased runs against original ones, items joined last-wins.

    ``gold`` has item and gold charts; items without are left out of the accuracies but not of the consistency.
    """
    own = predictions.filter(F.col(variant).isin(*names)).select(*by, item, variant, order, F.when(parsed, F.try_element_at(charts(mapping), F.lit(1))).alias("chart"))
    own = last_wins(own, [*by, item, variant], [order])
    side = lambda v, c: F.max(F.when(F.col(variant) == v, F.coalesce(c, F.lit(""))))
    wide = own.groupBy(*by, item).agg(side(names[0], F.col("chart")).alias("o"), side(names[1], F.col("chart")).alias("p")).filter("o IS NOT NULL AND p IS NOT NULL")
    wide = wide.join(gold.select(item, F.try_element_at("gold", F.lit(1)).alias("g")), item, "left")
    out = wide.groupBy(*by).agg(
        F.count("*").alias("n_shared"),
        count_of((F.col("o") == F.col("p")) & (F.col("o") != "")).alias("same"),
        F.count("g").alias("n_gold"),
        count_of((F.col("o") == F.col("g")) & (F.col("o") != "")).alias("hits_o"),
        count_of((F.col("p") == F.col("g")) & (F.col("p") != "")).alias("hits_p"),
    )
    accuracy = 100.0 * F.col("hits_p") / F.nullif(F.col("n_gold"), F.lit(0))
    before = 100.0 * F.col("hits_o") / F.nullif(F.col("n_gold"), F.lit(0))
    return out.select(*by, "n_shared", "n_gold", percent(F.col("same"), F.col("n_shared")).alias("paraphrase_consistency"), F.round(accuracy, 2).alias("paraphrase_accuracy"), F.round(accuracy - before, 2).alias("paraphrase_accuracy_delta"))


def missing_info(predictions: DataFrame, by: list[str], raw: str = "raw_text", parsed: str | None = None) -> DataFrame:
    """How often outputs for reduced briefs ask back, and how often they give every key all the same."""
    keys = (F.col(parsed) if parsed else jsonout.parsed_output(F.col(raw)))["keys"]
    asks = F.col("asks") if "asks" in predictions.columns else text.asks_to_clarify(F.col(raw))
    own = predictions.select(*by, asks.alias("asks"), keys.alias("keys"))
    out = own.groupBy(*by).agg(F.count("*").alias("n"), count_of(F.col("asks")).alias("asks"), count_of(F.size("keys") == len(vocab.REQUIRED_KEYS)).alias("all"))
    return out.select(*by, "n", percent(F.col("asks"), F.col("n")).alias("missing_info_clarification_rate"), percent(F.col("all"), F.col("n")).alias("missing_info_schema_rate"))


def judge_means(scores: DataFrame, by: list[str], scored: str) -> DataFrame:
    """Mean of a judge's scores for each dimension, pooled over all where the dimension is null; ``scored`` is a map."""
    long = scores.filter(F.col(scored).isNotNull()).select(*by, F.explode(scored).alias("dimension", "s"))
    return means_by_dimension(long, by)


def means_by_dimension(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, dimension, mean, n) and, with dimension 'overall', the mean over all of them; one pass over grouping sets."""
    out = long.groupingSets([[F.col(c) for c in [*by, "dimension"]], [F.col(c) for c in by]], *by, "dimension").agg(F.round(F.avg("s"), 3).alias("mean"), F.count("s").alias("n"), F.grouping("dimension").alias("__all"))
    return out.select(*by, F.when(F.col("__all") == 1, "overall").otherwise(F.col("dimension")).alias("dimension"), "mean", "n")
