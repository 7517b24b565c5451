import json

import pytest
from briefmill.llm import truncation as tr
from pyspark.sql import functions as F

WHOLE = json.dumps({"a": [{"b": 'x "quoted" y'}], "c": "it's"})


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (WHOLE, "whole"),
        (f"Sure.\n```json\n{WHOLE}\n```", "whole"),
        ("{'a': \"it's\", 'b': [1,],}", "whole"),
        ('{"a": 1 "b": 2}', "whole"),
        (WHOLE + "\n\nAll good. (see tile 3)", "whole"),
        ("Which column holds the date?", "whole"),
        ('It stays. "as agreed"', "whole"),
        ("It stays. 👍\n***", "whole"),
        (WHOLE[:-3], "cut"),
        (f"```json\n{WHOLE[:20]}\n```", "cut"),
        (WHOLE[:15] + "…", "cut"),
        (WHOLE[:15] + " [...]", "cut"),
        (WHOLE[:15] + "\n[stream closed]", "cut"),
        ("The panel shows �", "cut"),
        ("The end\\", "cut"),
        (WHOLE + "\n\nThe panel sho", "tail"),
        ("The panel sho\n<connection reset>", "tail"),
        ("Tiles:\n- A: bar for Gro", "entry"),
        ('{"a":[1}}', "cut"),
        ('[{"a": 1}, {"a": 2},', "cut"),
        ('[{"a": 1}, {"a": 2}]', "whole"),
        ("  [1, 2", "cut"),
        ("<ul><li>item one.</li><li>item two.", "cut"),
        ("<ul><li>item one.</li><li>item two.</li></ul>", "whole"),
        ('<div class="pa', "cut"),
        ("See the note (as agreed.", "cut"),
        ("See (the note.\n\nAs agreed.", "whole"),
        ('They said "keep it.', "cut"),
        ("Er sagte „so bleibt es“.", "whole"),
        ('A 5" screen is fine.', "whole"),
        ("The column `order_id.", "cut"),
        ("The value \\u00", "cut"),
        (" " * 25 + "{'a': \"it's\"}", "whole"),
        (WHOLE + "\n[stream closed " + "by the proxy " * 40 + "]", "whole"),
        (WHOLE[:15] + "\n[stream closed " + "by the proxy " * 40 + "]", "cut"),
        ("The panel sho ...", "tail"),
    ],
)
def test_state(text, kind):
    assert tr.state(text)[0] == kind


def test_every_prefix_of_an_object_is_cut():
    assert all(tr.state(WHOLE[:i])[0] == "cut" for i in range(1, len(WHOLE)))


def test_long_texts_in_linear_time():
    for text in ('{"a": "' + "x" * 2_000_000, "[" * 500_000 + "{" * 500_000, " \n" * 500_000 + "a", '{"' + '\\"' * 500_000, "." * 1_000_000, "." * 500_000 + "a", "`" * 500_000, "(" * 300_000, "<b>" * 100_000, "[" + "1" * 500_000 + "]", "a\n" * 300_000 + "[x"):
        tr.state(text)


DDL = "id bigint, t string, s string, kind string, of string"


def test_baselines(spark):
    rows = [(i, f"The page is full. {'Tiles: %d' % (i % 9)}", "a", "clash", "clash") for i in range(30)]
    rows += [(100 + i, f"The page is full. Then {'y' * (i % 7 + 1)}{chr(97 + i)}", "a", None, None) for i in range(8)]
    rows += [(200, "Tiles:\n- A: bar for Fleet Buyers\n- B: pie for Ward Sisters", None, None, None), (201, "Tiles:\n- A: bar for Ward Sisters\n- B: pie for Fleet Buyers", None, None, None), (202, "Tiles:\n- A: bar for Ward Sisters\n- B: pie for Fleet Bu", None, None, None)]
    rows += [(300, None, "b", None, None), (301, "", "b", None, None), (302, "  \n", "b", None, None), (303, '{"a": 1', "b", None, None), (303, '{"a": 1', "b", None, None)]
    states = tr.judged(spark.createDataFrame(rows, DDL), "id", "t", "s")
    got = [(r.of, r.reason) for r in tr.truncated(states).collect()]
    assert sorted(got) == sorted([(100 + i, "sentence") for i in range(8)] + [(202, "entry"), (303, "bracket"), (303, "bracket")])
    shares = {r.source: (r.n_texts, r.n_cut) for r in tr.by_source(states).collect()}
    assert shares == {"a": (38, 8), None: (3, 1), "b": (2, 2)}


def test_copies_of_one_cut_text(spark):
    """A cut text that is sent again often is no terminator, nor do its copies make cuts of the real sign-offs."""
    rows = [(i, f"Page {i} is full. Best, the desk", "a", None, None) for i in range(8)]
    rows += [(100 + i, "The page is full. Then the pan", "a", None, None) for i in range(300)]
    rows += [(500 + i, "The page is full. Then the pan", "b", None, None) for i in range(300)]
    states = tr.judged(spark.createDataFrame(rows, DDL), "id", "t", "s")
    got = sorted((r.of, r.reason) for r in tr.truncated(states).collect())
    assert got == [(i, "sentence") for i in [*range(100, 400), *range(500, 800)]]
    assert {r.source: (r.n_texts, r.n_cut) for r in tr.by_source(states).collect()} == {"a": (308, 300), "b": (300, 300)}


def test_empty_table(spark):
    states = tr.judged(spark.createDataFrame([], DDL), "id", "t", "s")
    assert tr.truncated(states).count() == 0 and tr.by_source(states).count() == 0
    assert states.select(F.count("*")).first()[0] == 0


def test_hot_entries_are_whole(spark, monkeypatch):
    """An entry's ending that very many texts share is salted; copies are judged alike."""
    import functools

    monkeypatch.setattr(tr, "skew_join", functools.partial(tr.skew_join, limit=5, salts=4))
    rows = [(i, "Tiles:\n- A: bar for Fleet Bu", "a", None, None) for i in range(40)] + [(100 + i, "Tiles:\n- A: bar for Fleet Buyers\n- B: pie for Fleet Buyers", None, None, None) for i in range(40)]
    states = tr.judged(spark.createDataFrame(rows, DDL), "id", "t", "s")
    assert sorted(r.of for r in tr.truncated(states).collect()) == list(range(40))
