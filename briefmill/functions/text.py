"""Text expressions that stay in the JVM: tokens, paraphrase, prompts, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefmill.functions import vocab

NEWLINES = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def words(text: Column) -> Column:
    """Runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def content_words(text: Column) -> Column:
    """The distinct runs of four or more letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def token_count(text: Column) -> Column:
    """Parts between white space."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def paraphrased(text: Column, synonyms: dict[str, str] | None = None) -> Column:
    """All words swapped at once, their case kept (title, upper, else lower)."""
    table = F.create_map(*[F.lit(x) for pair in (synonyms or vocab.SYNONYMS).items() for x in pair])

    def swap(part: Column) -> Column:
        other = F.try_element_at(table, F.lower(part))
        title = (F.upper(F.substring(part, 1, 1)) == F.substring(part, 1, 1)) & (F.lower(F.substring(part, 2, 1000)) == F.substring(part, 2, 1000))
        cased = F.when(title, F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 1000))).when(F.upper(part) == part, F.upper(other)).otherwise(other)
        return F.coalesce(cased, part)

    parts = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.when(text == "", text).otherwise(F.array_join(F.transform(parts, swap), ""))


def all_but_last(items: Column) -> Column:
    """The list without its last element if it has more than one."""
    return F.when(F.size(items) > 1, F.slice(items, 1, F.size(items) - 1)).otherwise(items)


def listed(items: Column) -> Column:
    """Elements joined by commas; the stand-in for missing values without any."""
    return F.when(items.isNull() | (F.size(items) == 0), vocab.MISSING).otherwise(F.array_join(items, ", "))


def columns_listed(columns: Column) -> Column:
    one = lambda c: F.concat(F.coalesce(F.try_element_at(c, F.lit("name")), F.lit("?")), F.lit(" ("), F.coalesce(F.try_element_at(c, F.lit("dtype")), F.lit("?")), F.lit(")"))
    return listed(F.transform(columns, one))


def or_none(text: Column) -> Column:
    return F.when(text.isNull() | (text == ""), vocab.NO_CONSTRAINTS).otherwise(text)


def brief_fields(users: Column, goals: Column, kpis: Column, columns: Column, constraints: Column) -> list[Column]:
    """A line for each field of a brief, its label in bold."""
    shown = {"users": F.coalesce(users, F.lit(vocab.MISSING)), "goals": listed(goals), "kpis": listed(kpis), "columns": columns_listed(columns), "constraints": or_none(constraints)}
    return [F.concat(F.lit(f"**{label}:** "), shown[name]) for name, label in vocab.BRIEF_LABELS.items()]


def user_message(users: Column, goals: Column, kpis: Column, columns: Column, constraints: Column) -> Column:
    """The user's turn of a prompt for a brief."""
    keys = [F.lit(f"  {i}. {key}") for i, key in enumerate(vocab.REQUIRED_KEYS, 1)]
    allowed = [F.lit(f"Allowed {name} values: {', '.join(values)}.") for name, values in (("task_type", vocab.TASKS), ("chart_type", vocab.CHARTS))]
    fields = brief_fields(users, goals, kpis, columns, constraints)
    blank = F.lit("")
    return F.concat_ws("\n", F.lit(vocab.USER_OPENING), blank, *fields, blank, F.lit(vocab.USER_KEYS), *keys, blank, F.lit(vocab.USER_MAPPING), *allowed, F.lit(vocab.USER_RATIONALES))


def messages(user: Column, system: str = vocab.SYSTEM_PROMPT) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user))


def prompt(user: Column, system: str = vocab.SYSTEM_PROMPT) -> Column:
    """The prompt up to the assistant's turn, for models without a chat template."""
    return F.concat(F.lit(f"### System:\n{system}\n\n### User:\n"), user, F.lit("\n\n### Assistant:\n"))


def query_text(users: Column, goals: Column, kpis: Column) -> Column:
    """What retrieval looks for: users, goals and KPIs, without those that are empty."""
    parts = [users, F.array_join(goals, " "), F.array_join(kpis, " ")]
    return F.trim(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def passages_block(passages: Column) -> Column:
    """Numbered passages (structs of source, heading, text), blank lines between."""

    def one(p: Column, i: Column) -> Column:
        title = F.regexp_replace(F.concat(F.coalesce(p["source"], F.lit("")), F.lit(" — "), F.coalesce(p["heading"], F.lit(""))), "^[ —]+|[ —]+$", "")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), title, F.lit("\n"), F.coalesce(p["text"], F.lit("")))

    return F.array_join(F.transform(passages, one), "\n\n")


def brief_markdown(users: Column, goals: Column, kpis: Column, columns: Column, constraints: Column) -> Column:
    """A brief as a rater sees it."""
    return F.concat_ws("\n\n", *brief_fields(users, goals, kpis, columns, constraints))


def brief_line(users: Column, goals: Column, kpis: Column, constraints: Column) -> Column:
    """A brief as a judge sees it."""
    joined = {"users": users, "goals": F.array_join(goals, ", "), "kpis": F.array_join(kpis, ", "), "constraints": F.coalesce(constraints, F.lit(vocab.NO_CONSTRAINTS))}
    return F.concat_ws("\n", *[F.concat(F.lit(f"{vocab.BRIEF_LABELS[name]}: "), F.coalesce(value, F.lit(""))) for name, value in joined.items()])


def judge_prompt(brief: Column, output: Column, dimensions: list[str]) -> Column:
    wanted = "\n".join(f"- {d}" for d in dimensions)
    heads = [F.lit(p) for p in vocab.JUDGE_PARTS]
    return F.concat(F.lit(vocab.JUDGE_OPENING), heads[0], F.lit(wanted), heads[1], F.coalesce(brief, F.lit(vocab.NO_BRIEF)), heads[2], F.coalesce(output, F.lit("")), heads[3])


def asks_to_clarify(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){vocab.CLARIFY}")


def keyword_task(kpi: Column) -> Column:
    """The task that a KPI's name tells, null if none of the rules holds."""
    out = F.lit(None).cast("string")
    low = F.lower(kpi)
    for keywords, task in reversed(vocab.KEYWORD_TASK):
        any_of = F.lit(False)
        for k in keywords:
            any_of = any_of | F.contains(low, F.lit(k))
        out = F.when(any_of, task).otherwise(out)
    return out


def normal_enum(value: Column, valid: list[str], aliases: dict[str, str]) -> Column:
    """The valid value that a text stands for: itself, by alias, or by a prefix either way in the order of ``valid``."""
    s = F.lower(F.trim(value))
    names = F.array(*[F.lit(v) for v in valid])
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    by_prefix = F.try_element_at(F.filter(names, lambda v: s.startswith(v) | v.startswith(s)), F.lit(1))
    return F.when(F.array_contains(names, s), s).otherwise(F.coalesce(F.try_element_at(table, s), by_prefix))


def cliff_magnitude(delta: Column) -> Column:
    out = F.lit("large")
    for limit, name in reversed(vocab.CLIFF):
        out = F.when(F.abs(delta) < limit, name).otherwise(out)
    return out
