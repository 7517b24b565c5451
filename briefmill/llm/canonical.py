"""Mapping of freely written values to the entries of a reference list.

Values are deduplicated, normalised (Unicode forms, look-alike letters, case, marks, wrappers and enumerations off, words
apart, words that any entry may carry set aside), and their character n-grams looked up in an inverted index of all ways to write an entry
(canonical, label, aliases). Candidates are scored by the weighted cosine of two views, n-grams of single words and of the
joined words. An entry is accepted above a threshold and a margin over the next entry; where the cosine does not decide by itself, an
exact check of the edit distance follows, which also moves the score. Every other value is reported as unmatched. The result is
joined back to the rows, values that very many rows hold with a salt, so that one that a third of all rows hold is no hot spot.
The index is broadcast where it is counted to be small, and partitioned by n-gram where it is not; a list may be of any length.

Defined cases: null and blank values have no result; ties between entries are unmatched; a value of nothing but words that
any entry may carry ("chart") is unmatched; very long values are normalised whole and match nothing unless their words do; an empty table gives
no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from briefmill.runtime import cut, skew_join, small

#: Candidates are entries from this weighted cosine on; from SURE on they are accepted by it alone, below it the exact check of
#: edits must agree; MARGIN is what the score must be above the next entry's.
THRESHOLD, SURE, MARGIN = 0.1, 0.9, 0.04
#: Words that say what kind of thing an entry is or how it is to be used, but not which.
FILLERS = "chart charts diagram diagrams plot plots graph graphs view visual visuals viz visualisation visualization type task question analysis simple use with labels primary secondary recommended default basic a an the please maybe"
#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("авеіјкмнорсѕтухһԁԛԝьαβεικνορτυχωɡıⅼ", "abeijkmhopcstyxhdqwbabeiknoptuxwgil")
TAG = re.compile(r"<[^<>]*>")
BRACKETS = re.compile(r"\([^()]*\)")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[a-z]{2})(?=[A-Z])")
ENUMERATION = re.compile(r"^\s*(?:\d+|[a-z])[.)]\s+")
NAMED = re.compile(r"^\s*(?:task|chart)(?:[ _-]?type)?\s*[:=.]\s*", re.I)
WORD = re.compile(r"[^\W_]+")


def unwrapped(value: str) -> str:
    """The value without a JSON object or string around it."""
    for _ in range(3):
        if not value.lstrip().startswith(("{", '"', "[")):
            break
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            break
        while isinstance(inner, (dict, list)) and inner:
            inner = next(iter(inner.values())) if isinstance(inner, dict) else inner[0]
        if not isinstance(inner, str):
            break
        value = inner
    return value


def words_of(value: str) -> list[str]:
    """The normalised words of a value, fillers included."""
    text = unicodedata.normalize("NFKC", unwrapped(value))
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = NAMED.sub("", TAG.sub(" ", text))
    text = CAMEL.sub(" ", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).translate(ALIKE)
    text = ENUMERATION.sub("", text)
    bare = BRACKETS.sub(" ", text)
    return WORD.findall(bare) or WORD.findall(text)


def core_of(words: list[str], fillers: frozenset[str]) -> list[str]:
    return [w for w in words if w not in fillers]


def grams(core: list[str], full: list[str]) -> list[str]:
    """n-grams of single words (w), of the joined words (j) and of the joined words with fillers (f)."""
    if not core:
        return []
    own = {f"w{x[i : i + 3]}" for w in core for x in (f"^{w}$",) for i in range(len(x) - 2)}
    for kind, joined in (("j", "".join(core)), ("f", "".join(full))):
        own |= {f"{kind}{joined[i : i + 2]}" for i in range(max(1, len(joined) - 1))}
    return sorted(own)


def allowed(n: int) -> int:
    """Edits at which texts of n characters may still be the same entry."""
    return min(3, round(n / 4 + 0.25)) if n > 2 else 0


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, most + 1 if it is more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def likeness(forms: list[str], way: list[str]) -> float:
    """1 less the edits as a share of the length, of the form that comes nearest; 0 if none is near enough.

    Text of at least 4 letters that a way of writing begins with, and that has at least 45 % of it, is that way cut off.
    """
    best = 0.0
    # Where both carry a filler, it must not make different short words alike.
    pairs = list(zip(forms, way, strict=True))[: 2 if forms[0] != forms[2] and way[0] != way[2] else 4]
    for a, b in pairs:
        n = max(len(a), len(b))
        if n and (d := edits(a, b, allowed(n))) <= allowed(n):
            best = max(best, 1 - d / n)
    for a, b in pairs[::2]:
        if len(a) >= 4 and len(a) >= 0.45 * len(b) and b.startswith(a):
            best = max(best, 0.9 + 0.1 * len(a) / len(b))
    return best


@F.pandas_udf(DoubleType())
def likeness_of(forms: pd.Series, ways: pd.Series) -> pd.Series:
    return pd.Series([likeness(list(a), list(b)) for a, b in zip(forms, ways, strict=True)], dtype="float64")


def normalised(df: DataFrame, value: str, fillers: str = FILLERS) -> DataFrame:
    """``df`` with forms (the words that count joined, these sorted, all words joined, these sorted) and grams for each row."""
    drop = frozenset(fillers.split())
    schema = df.schema
    at = schema.fieldNames().index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [words_of(v) if v is not None else [] for v in batch.column(at).to_pylist()]
            core = [core_of(w, drop) for w in full]
            forms = [["".join(c), "".join(sorted(c)), "".join(w), "".join(sorted(w))] for c, w in zip(core, full, strict=True)]
            made = [grams(c, w) for c, w in zip(core, full, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.list_(pa.string())), pa.array(made, pa.list_(pa.string()))], [*batch.schema.names, "forms", "grams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.mapInArrow(run, f"{kinds}, forms array<string>, grams array<string>")


def written_ways(entries: DataFrame) -> DataFrame:
    """(field, canonical, way): every way to write an entry that the reference list names."""
    ways = F.explode(F.concat(F.array("canonical", "label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entries.select("field", "canonical", ways.alias("way")).filter("trim(way) <> ''").distinct()


def inverted_index(entries: DataFrame, fillers: str = FILLERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field, gram, way_id, w2), (way_id, canonical, forms, way_norm) and (field, unseen) of a reference list.

    w2 is the squared weight of an n-gram; an n-gram that no entry has weighs as one that a single entry has (unseen).
    """
    ways = normalised(written_ways(entries), "way", fillers).filter("size(grams) > 0").select("field", "canonical", "forms", "grams").distinct()
    ways = cut(ways.withColumn("way_id", F.monotonically_increasing_id()))
    posting = ways.select("field", "way_id", F.explode("grams").alias("gram"))
    n_ways = ways.groupBy("field").agg(F.count("*").alias("n"))
    weight = posting.groupBy("field", "gram").agg(F.count("*").alias("df")).join(n_ways, "field")
    weight = weight.select("field", "gram", F.pow(1 + F.log(F.col("n") / F.col("df")), 2).alias("w2"))
    index = cut(posting.join(weight, ["field", "gram"]))
    norm = index.groupBy("way_id").agg(F.sum("w2").alias("way_norm"))
    about = cut(ways.join(norm, "way_id").select("way_id", "canonical", "forms", "way_norm"))
    return index, about, n_ways.select("field", F.pow(1 + F.log("n"), 2).alias("unseen"))


def mapped_values(values: DataFrame, entries: DataFrame, fillers: str = FILLERS) -> DataFrame:
    """(list, value, canonical, score) for distinct (list, value); list names the field of ``entries`` that the value belongs to."""
    index, about, unseen = inverted_index(entries, fillers)
    # Values are normalised once; ids are numbers that the checkpoint fixes.
    own = cut(normalised(values, "value", fillers).withColumn("id", F.monotonically_increasing_id()))
    asked = own.select("id", F.col("list").alias("field"), F.explode("grams").alias("gram"))
    found = asked.join(small(index), ["field", "gram"]).groupBy("id", "way_id").agg(F.sum("w2").alias("dot"))
    # The list's n-grams of each value and those that the list lacks, as numbers, give the length of its vector.
    weight = small(index.groupBy("field", "gram").agg(F.first("w2").alias("w2")))
    length = asked.join(weight, ["field", "gram"], "left").join(F.broadcast(unseen), "field", "left").groupBy("id").agg(F.sum(F.coalesce("w2", "unseen")).alias("value_norm"))
    scored = found.join(length, "id").join(own.select("id", F.col("forms").alias("value_forms")), "id").join(small(about), "way_id")
    scored = scored.withColumn("cosine", F.col("dot") / F.sqrt(F.col("way_norm") * F.col("value_norm"))).filter(F.col("cosine") >= THRESHOLD)
    scored = scored.withColumn("like", likeness_of("value_forms", "forms")).withColumn("score", (F.col("cosine") + F.col("like")) / 2)
    best = scored.groupBy("id", "canonical").agg(F.max(F.struct("score", "cosine", "like")).alias("s")).select("id", "canonical", "s.*")
    by_score = Window.partitionBy("id").orderBy(F.desc("score"), "canonical")
    top = best.withColumn("rank", F.row_number().over(by_score)).withColumn("next", F.lead("score").over(by_score)).filter("rank = 1")
    margin = F.col("score") - F.coalesce("next", F.lit(0.0)) >= MARGIN
    accepted = margin & ((F.col("cosine") >= SURE) | (F.col("like") > 0))
    top = top.select("id", F.when(accepted, F.col("canonical")).otherwise("unmatched").alias("canonical"), "score")
    return own.select("id", "list", "value").join(top, "id", "left").select("list", "value", F.coalesce("canonical", F.lit("unmatched")).alias("canonical"), F.coalesce("score", F.lit(0.0)).alias("score"))


def occurrences(df: DataFrame, key: str, scalar: dict[str, str], arrays: dict[str, str]) -> DataFrame:
    """(key, field, list, pos, value) for each value that is neither null nor blank; scalar and arrays: column -> list."""

    def elements(column: str, where: str) -> Column:
        made = lambda x, i: F.struct(F.lit(column).alias("field"), F.lit(where).alias("list"), i.cast("int").alias("pos"), x.alias("value"))
        return F.coalesce(F.transform(F.col(column), made), F.array().cast("array<struct<field:string,list:string,pos:int,value:string>>"))

    structs = [F.array(F.struct(F.lit(c).alias("field"), F.lit(where).alias("list"), F.lit(0).alias("pos"), F.col(c).alias("value"))) for c, where in scalar.items()]
    structs += [elements(c, where) for c, where in arrays.items()]
    out = df.select(F.col(key), F.explode(F.flatten(F.array(*structs))).alias("o")).select(key, "o.*")
    return out.filter(F.col("value").isNotNull() & F.col("value").rlike(r"[^\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{205f}\x{3000}\x{feff}]"))


def map_to_list(found: DataFrame, entries: DataFrame, fillers: str = FILLERS) -> DataFrame:
    """``found`` (from ``occurrences``) without values that are letter for letter canonical, with canonical and score."""
    known = F.broadcast(entries.select(F.col("field").alias("list"), F.col("canonical").alias("value")).distinct())
    free = found.join(known, ["list", "value"], "left_anti")
    counts = cut(free.groupBy("list", "value").agg(F.count("*").alias("n")))
    return skew_join(free, mapped_values(counts.select("list", "value"), entries, fillers), ["list", "value"], counts)
