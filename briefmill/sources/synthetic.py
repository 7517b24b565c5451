"""Synthetic gold items: each depends on its index and the seed alone, so a longer set begins with the shorter one.

All draws are hashes of seed, index and the place of the draw, so items are made where they are needed, in the JVM, and in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions.text import keyword_task
from briefmill.functions.vocab import TASK_CHART

#: Domains of our own; any others of this form can be given.
DOMAINS: dict[str, dict[str, list[str]]] = {
    "Public Libraries": {
        "users": ["Branch Librarians", "Collection Planners"],
        "goals": ["keep shelves in use", "shorten waiting lists"],
        "kpis": ["Loan Volume", "Renewal Rate", "Visits by Region", "Waiting Time Distribution", "Cost Drivers", "Digital Share"],
    },
    "Ferry Lines": {
        "users": ["Port Captains", "Ticket Office Leads"],
        "goals": ["sail on time", "fill evening crossings"],
        "kpis": ["Passenger Volume", "On-Time Rate", "Revenue by Channel", "Delay Spread", "Fuel Variance", "Booking Funnel"],
    },
    "Greenhouses": {
        "users": ["Growers", "Energy Stewards"],
        "goals": ["hold the temperature", "waste less water"],
        "kpis": ["Water Usage", "Yield Score", "Sales by Product", "Humidity Range", "Heat Loss", "Light vs Growth"],
    },
}
#: How well users read charts, how often data arrive, and how many KPIs an item has.
READERS, RHYTHMS, KPIS = ["new to charts", "used to charts", "expert"], ["hourly", "daily", "weekly"], (3, 5)


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def drawn(seed: int, *place: Column | str) -> Column:
    """A number of the item's own for a place; not negative."""
    return F.xxhash64(F.lit(seed), "index", *[F.lit(p) if isinstance(p, str) else p for p in place]).bitwiseAND(F.lit((1 << 62) - 1))


def one_of(values: Column, number: Column) -> Column:
    return F.element_at(values, (number % F.size(values) + 1).cast("int"))


def some_of(values: Column, seed: int, place: str, least: int, most: int) -> Column:
    """Between ``least`` and ``most`` of the values, those whose own numbers are lowest."""
    ordered = F.array_sort(F.transform(values, lambda v: F.struct(drawn(seed, place, v).alias("at"), v.alias("v"))))
    return F.slice(F.transform(ordered, lambda x: x["v"]), F.lit(1), (drawn(seed, place) % (most - least + 1) + least).cast("int"))


def recommended(kpi: Column, seed: int) -> Column:
    """The mapping of a KPI: the task that its name tells, or any, and the chart that suits the task best."""
    task = F.coalesce(keyword_task(kpi), one_of(texts(sorted(TASK_CHART)), drawn(seed, "task", kpi)))
    best = F.create_map(*[F.lit(x) for t, (chart, _) in TASK_CHART.items() for x in (t, chart)])
    others = F.create_map(*[x for t, (_, more) in TASK_CHART.items() for x in (F.lit(t), texts(more))])
    encoding = F.struct(F.when(task == "trend", "day").otherwise("group").alias("x"), field_of(kpi).alias("y"))
    return F.struct(kpi.alias("kpi"), task.alias("task_type"), F.element_at(best, task).alias("chart_type"), F.element_at(others, task).alias("alternatives"), encoding.alias("encoding"))


def field_of(kpi: Column) -> Column:
    return F.regexp_replace(F.lower(kpi), "[^a-z0-9]+", "_")


def generate(spark: SparkSession, n: int = 600, seed: int = 42, domains: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """(index, brief, recommendation) as JSON text."""
    specs = domains or DOMAINS
    whole = F.array(*[F.struct(F.lit(name).alias("name"), *[texts(spec[k]).alias(k) for k in ("users", "goals", "kpis")]) for name, spec in sorted(specs.items())])
    own = spark.range(n).select(F.col("id").alias("index")).withColumn("d", one_of(whole, F.col("index")))
    own = own.withColumn("reader", one_of(texts(READERS), drawn(seed, "reader"))).withColumn("kpis", some_of(F.col("d.kpis"), seed, "kpis", *KPIS))
    own = own.withColumn("goals", some_of(F.col("d.goals"), seed, "goals", 1, 2)).withColumn("mapping", F.transform("kpis", lambda k: recommended(k, seed)))
    column = lambda name, dtype: F.struct(name.alias("name"), F.lit(dtype).alias("dtype"))
    fixed = F.array(column(F.lit("day"), "datetime"), column(F.lit("group"), "categorical"))
    users = F.concat(one_of(F.col("d.users"), drawn(seed, "users")), F.lit(" at "), "d.name", F.lit(", "), "reader")
    brief = {
        "users": users,
        "goals": F.col("goals"),
        "kpis": F.col("kpis"),
        "columns": F.concat(fixed, F.transform("kpis", lambda k: column(field_of(k), "numeric"))),
        "constraints": F.concat(F.lit("Data arrive "), one_of(texts(RHYTHMS), drawn(seed, "rhythm")), F.lit(".")),
    }
    reason = lambda m: F.struct(F.concat(m["kpi"], F.lit(" is shown as "), m["chart_type"]).alias("claim"), F.concat(F.lit("fits the task "), m["task_type"]).alias("principle"))
    wish = {
        "context_summary": F.struct(users.alias("audience"), F.col("d.name").alias("domain")),
        "kpi_chart_mapping": F.col("mapping"),
        "layout": F.struct(F.lit("most important figures first").alias("order")),
        "styling": F.struct(F.lit("high").alias("contrast")),
        "interactions": F.when(F.col("reader") == READERS[0], texts(["choose a period"])).otherwise(texts(["choose a period", "open details"])),
        "rationales": F.transform("mapping", reason),
    }
    as_json = lambda parts: F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()]))
    return reduce(lambda df, c: df.withColumn(*c), (("brief", as_json(brief)), ("recommendation", as_json(wish))), own).select("index", "brief", "recommendation")
