"""Texts that lost their end: a structural completeness check and a baseline of endings for each source.

One pass over the texts runs a stack automaton on each whole text. In JSON (from a brace, or from a bracket that begins a line and holds
values) it pushes what opens and pops what closes, each kind for itself, and skips quoted strings (in double quotes, or in
single quotes where the object is written so). In prose it pushes the tags of markup, and in the last paragraph round and
square brackets, quotes and code marks. What is open at the end of the text is a cut, and so is a broken multibyte sequence or
escape, and a fence that is not closed. A closer that fits nothing on the stack leaves it as it is. Behind what a later step may have put
there (an ellipsis, a note on a line of its own such as [stream closed], a closing fence) the automaton looks at what the model
wrote itself. Prose of which nothing is open must end, after the last sentence, with nothing, symbols, or a closed bracket or quote. Else it
is decided against baselines of the whole corpus: an ending after the last sentence counts as a terminator if it makes up ``SHARE`` of
such endings of its source or of all sources, counted over distinct texts, so that a text that is sent again often weighs as
one; the last entry of a list is whole if its last two words also end an entry that another entry follows.

Defined cases: null, empty and blank texts are no case; finished text that is malformed (missing or extra commas, single
quotes, a bracket left open in an earlier paragraph) or has no full stop is none; repeated rows are judged alike; texts of any
length are scanned whole; a null source is a source; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.runtime import cut, lookup_join, skew_join, spread

#: An ending is a terminator of a source if it makes up this share of the endings in question, and so many distinct texts have it at least.
SHARE, LEAST = 0.05, 5
DOUBLE = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]"]', re.S)
SINGLE = re.compile(r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[{}\[\]"']""", re.S)
#: Where JSON begins: a brace, or the bracket of an array that begins a line.
JSON = re.compile(r"\{|^[^\S\n]*\[(?=\s*[{\[\"\d-])", re.M)
BY_SINGLE = re.compile(r"[{\[\s]*+'")
PAIRS = {"}": "{", "]": "[", ")": "(", "”": "“", "»": "«"}
#: What a later step may have put behind the cut, besides an ellipsis: a line that is a note in brackets.
NOTE = re.compile(r"\s*(?:\[[^\[\]]*[^\W\d_]{2}[^\[\]]*\]|<[^<>/\"=]*[^\W\d_]{2}[^<>/\"=]*>)\s*")
SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]]*(?=\s|\Z)")
CLOSED = re.compile(r"\([^()]*\)|\"[^\"]*\"|“[^”]*”|\[[^\[\]]*\]|«[^»]*»|[^\w]+", re.S)
BULLET = re.compile(r"\s*(?:[-*•–]|\d+[.)])\s+\S")
ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#x?[0-9a-fA-F]*|amp|lt|gt|quot|nbsp|apos))\Z")
#: Elements of markup that have to be closed.
ELEMENTS = "a abbr article aside b blockquote body button code details div em figure footer form h1 h2 h3 h4 h5 h6 head header html i main nav ol pre q s section select small span strong style sub summary sup svg table textarea title u ul"
TAG = re.compile(rf"<(/?)({'|'.join(ELEMENTS.split())})(?:\s[^<>]*)?(>|\Z)", re.I)
CLOSING_TAG = re.compile(r"</\w+\s*>")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
INLINE = re.compile(r"[()\[\]“”„«»\"]|`+")


def closes(text: str, start: int) -> tuple[int, str]:
    """The place behind the object or array that begins at ``start``, and "" ; or the text's length and what is open at its end."""
    stack: list[str] = []
    for m in (SINGLE if BY_SINGLE.match(text, start) else DOUBLE).finditer(text, start):
        mark = m.group()
        if mark in ("{", "["):
            stack.append(mark)
        elif mark in PAIRS:
            if stack[-1] == PAIRS[mark]:
                stack.pop()
                if not stack:
                    return m.end(), ""
        elif len(mark) == 1:
            return len(text), "quote"
    return len(text), "bracket"


def open_markup(prose: str) -> bool:
    """Whether an element of markup, or a tag itself, is open at the end."""
    stack: list[str] = []
    for m in TAG.finditer(prose):
        name = m.group(2).lower()
        if not m.group(3):
            return True
        if m.group(1):
            if name in stack:
                while stack.pop() != name:
                    pass
        elif not m.group().endswith("/>"):
            stack.append(name)
    return bool(stack)


def open_inline(paragraph: str) -> str:
    """What is open at the end of a paragraph of prose: bracket, quote, code, or nothing.

    A quote opens where no word ends before it and text follows; an emoticon opens nothing."""
    stack: list[str] = []
    for m in INLINE.finditer(paragraph):
        mark, before, after = m.group(), paragraph[m.start() - 1 : m.start()], paragraph[m.end() : m.end() + 1]
        begins = not (before.isalnum() or before in (".", ",", "!", "?")) and after.strip() != ""
        top = stack[-1] if stack else ""
        if top[:1] == "`":
            if mark == top:
                stack.pop()
        elif (mark == '"' and top == '"') or (mark in "“”" and top == "„") or (mark == "«" and top == "»") or (mark in PAIRS and top == PAIRS[mark]):
            stack.pop()
        elif mark in PAIRS and PAIRS[mark] in stack:
            while stack.pop() != PAIRS[mark]:
                pass
        elif mark in ("(", "["):
            if before not in (":", ";", "-"):
                stack.append(mark)
        elif mark[0] == "`" or (mark in '"“„«»' and begins):
            stack.append(mark)
    return "" if not stack else "code" if stack[-1][0] == "`" else "bracket" if stack[-1] in "([" else "quote"


def unfenced(text: str) -> str:
    """The text without a fence that closes it."""
    return text[:-3].rstrip() if text.endswith("```") and text[:-3].rstrip(" \t").endswith("\n") else text


def before_ellipsis(text: str) -> str:
    """The text without an ellipsis at its end, which may be in brackets; read from the end, so in linear time."""
    inner = text[:-1].rstrip() if text.endswith("]") else text
    bare = inner[:-1] if inner.endswith("…") else inner.rstrip(".")
    if not inner.endswith("…") and len(inner) - len(bare) < 3:
        return text
    if inner is text:
        return bare.rstrip()
    return bare.rstrip()[:-1].rstrip() if bare.rstrip().endswith("[") else text


def written(text: str) -> str:
    """The text without what a later step may have put behind it."""
    text = text.rstrip()
    while True:
        head, line, last = text.rpartition("\n")
        if (shorter := before_ellipsis(text)) != text:
            text = shorter
        elif line and NOTE.fullmatch(last):
            text = head.rstrip()
        else:
            return text


def two(line: str) -> str:
    return " ".join(line.split()[-2:])


def state(text: str) -> tuple[str, str]:
    """(kind, key): cut with its reason, whole, or tail / entry with what the baselines must decide."""
    own = written(text)
    if own.endswith(("\ufffd", "â€")):
        return "cut", "multibyte"
    fenced = unfenced(own)
    inner = written(fenced) if fenced != own else own
    at, prose = 0, []
    while begin := JSON.search(inner, at):
        prose.append(inner[at : begin.start()])
        at, still = closes(inner, begin.end() - 1)
        if still:
            return "cut", still
    rest = inner[at:].strip()
    if fenced != own and inner.count("```") % 2 == 0:
        return "cut", "fence"  # a fence was closed that was not open
    if rest.startswith("```") and at:
        rest = rest[3:].strip()
    if not rest:
        return ("whole", "") if at else ("cut", "nothing")
    if ESCAPE.search(rest[-8:]):
        return "cut", "escape"
    if "<" in inner and open_markup("".join([*prose, rest])):
        return "cut", "markup"
    if fenced == own and (still := open_inline(PARAGRAPH.split(rest)[-1])):
        return "cut", still
    end = len(rest)
    while rest.endswith(">", 0, end) and (tag := rest.rfind("</", 0, end)) >= 0 and CLOSING_TAG.fullmatch(rest, tag, end):
        end = tag
    rest = rest[:end].rstrip()
    last = 0
    for m in SENTENCE_END.finditer(rest):
        last = m.end()
    tail = rest[last:].strip()
    if not tail or CLOSED.fullmatch(tail):
        return "whole", ""
    line = rest.rsplit("\n", 1)[-1]
    if BULLET.match(line) and line.strip() in tail:
        return "entry", two(line)
    return "tail", re.sub(r"\d", "0", " ".join(tail.split()))


def inner_endings(text: str) -> Iterator[str]:
    """The last two words of each list entry that another line follows."""
    lines = text.split("\n")
    return (two(x) for x in lines[:-1] if BULLET.match(x))


def judged(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(kind, about, source, of, n, same): a row for each text that isn't whole at first sight, ``of`` being its key in ``df``
    and ``same`` a hash of the whole text; endings of inner list entries (kind ending); and the number of texts of each source (kind texts). One pass."""
    slim = spread(df.select(F.col(key).alias("of"), F.col(source).alias("source"), F.col(text).alias("__text"), F.xxhash64(text).alias("same")))
    of = pa.int64() if df.schema[key].dataType.simpleString() == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            rows: list[tuple] = []
            texts: dict[str | None, int] = {}
            for i, where, t, same in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if t is None or not t.strip():
                    continue
                texts[where] = texts.get(where, 0) + 1
                kind, about = state(t)
                if kind != "whole":
                    rows.append((kind, about, where, i, 1, same))
                if "\n" in t and t.lstrip()[:1] not in ("{", "`"):
                    for x in inner_endings(written(t.strip())):
                        if x not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(x)
                            rows.append(("ending", x, None, None, 1, None))
            rows += [("texts", None, where, None, n, None) for where, n in texts.items()]
            if rows:
                a, b, c, d, e, f = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(d, of), pa.array(e, pa.int64()), pa.array(f, pa.int64())], ["kind", "about", "source", "of", "n", "same"])

    out = slim.mapInArrow(run, f"kind string, about string, source string, of {'bigint' if of == pa.int64() else 'string'}, n bigint, same bigint")
    return cut(out)


def truncated(states: DataFrame) -> DataFrame:
    """(of, source, reason) of the texts that were cut, from ``judged``."""
    structural = states.filter("kind = 'cut'").select("of", "source", F.col("about").alias("reason"))
    tails = states.filter("kind = 'tail'")
    # Copies of a text are combined before the shuffle; a text that several sources have counts once in each and once in all.
    texts = tails.groupBy("source", "about", "same").agg(F.lit(1).alias("one"))
    counted = texts.groupBy("source", "about").agg(F.count("*").alias("n"))
    by_source = counted.groupBy("source").agg(F.sum("n").alias("of_source"))
    everywhere = texts.groupBy("about", "same").agg(F.lit(1).alias("one")).groupBy("about").agg(F.count("*").alias("n"))
    total = everywhere.agg(F.sum("n").alias("of_all"))
    usual_here = (
        counted.withColumn("s", F.coalesce("source", F.lit("")))
        .join(by_source.select(F.coalesce("source", F.lit("")).alias("s"), "of_source"), "s")
        .filter((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("of_source")))
        .select("s", "about")
    )
    usual = everywhere.crossJoin(F.broadcast(total)).filter((F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("of_all"))).select("about")
    # At most 1 / SHARE endings of all texts are usual, and as many of each source.
    open_tails = tails.withColumn("s", F.coalesce("source", F.lit(""))).join(F.broadcast(usual), "about", "left_anti")
    open_tails = lookup_join(open_tails, usual_here, ["s", "about"], "left_anti")
    # Entries are decided by their endings, counted first; an ending that very many texts share is spread over tasks.
    entries = states.filter("kind = 'entry'")
    endings = states.filter("kind = 'ending'").select("about").distinct()
    counts = entries.groupBy("about").agg(F.count("*").alias("n"))
    open_entries = skew_join(entries, counts.select("about").join(endings, "about", "left_anti"), ["about"], counts)
    return structural.unionByName(open_tails.select("of", "source", F.lit("sentence").alias("reason"))).unionByName(open_entries.select("of", "source", F.lit("entry").alias("reason")))


def by_source(states: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share_cut) for each source that has a text."""
    found = truncated(states).select("source", F.lit(0).alias("texts"), F.lit(1).alias("cut"))
    texts = states.filter("kind = 'texts'").select("source", F.col("n").alias("texts"), F.lit(0).alias("cut"))
    out = texts.unionByName(found).groupBy("source").agg(F.sum("texts").alias("n_texts"), F.sum("cut").alias("n_cut"))
    return out.withColumn("share_cut", F.col("n_cut") / F.col("n_texts"))
