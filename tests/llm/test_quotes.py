import random

import duckdb

from skylattice.llm.quotes import ORACLE_SQL, link_quotes


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, path int")
    return link_quotes(docs).collect()


def test_links_levels_and_order(spark):
    rows = [
        (1, 0, "user", "How do tides work?\nAlso, what is a neap tide?"),
        (1, 1, "assistant", "The moon pulls the sea."),
        (1, 2, "user", "On Monday Ann wrote:\n> Also,  what is a NEAP tide\nPlease answer this part."),
        (1, 3, "assistant", "> > Also, what is a neap tide?\n> Please answer this part.\nA neap tide is weak.\n>> not mine\n"),
        (1, 4, "user", "> nothing that anyone said\nHm."),
        (2, 0, "user", "How do tides work?"),
        (2, 1, "user", "> The moon pulls the sea.\nwrong conversation"),
        (2, 2, "user", None),
        (None, None, "user", "alone"),
        (2, 0, "user", "How do tides work?"),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    at = {(g.conv_id, g.turn): g for g in got}
    assert at[1, 2].parent == 0 and at[1, 2].text == "Please answer this part." and (at[1, 2].n_quotes, at[1, 2].max_level) == (1, 1)
    assert at[1, 3].parent == 2 and at[1, 3].text == "A neap tide is weak.\n" and at[1, 3].max_level == 2
    assert at[1, 4].parent is None and at[1, 4].text == "Hm." and at[1, 4].n_quotes == 1
    assert at[2, 1].parent is None and at[2, 1].n_quotes == 1
    assert at[2, 2].text is None and at[None, None].text == "alone"
    assert [g.turn for g in got if g.conv_id == 1] == [0, 2, 3, 1, 4]
    assert (at[1, 3].thread, at[1, 3].depth) == (0, 2) and (at[1, 4].thread, at[1, 4].depth) == (4, 0)


def test_without_quotes_nothing_changes(spark):
    rows = [(1, i, "user", f"line {i} a > b") for i in range(5)]
    got = run(spark, rows)
    assert [(g.turn, g.text, g.parent, g.n_quotes) for g in got] == [(i, f"line {i} a > b", None, 0) for i in range(5)]


def test_deep_chain_and_empty_table(spark):
    rows = [(1, 0, "u", "first thing said")] + [(1, i, "u", f"> answer number {i - 1}\nanswer number {i}" if i > 1 else "> first thing said\nanswer number 1") for i in range(1, 8)]
    got = {g.turn: g for g in run(spark, rows)}
    assert [(got[i].parent, got[i].thread, got[i].depth) for i in range(8)] == [(i - 1 if i else None, 0, i) for i in range(8)]
    assert run(spark, rows[:0]) == []


def test_deeper_levels_are_linked(spark):
    rows = [
        (1, 0, "u", "the original line"),
        (1, 1, "u", "an answer to that"),
        (1, 2, "u", ">> the original line\nanswered over two marks"),
        (1, 3, "u", "> > the original line\n> an answer to that\nboth at once"),
        (1, 4, "u", "> nobody said so\n>>> an answer to that\ndeeper"),
        (1, 5, "u", "> an answer to that\n>> the original line\ntwice\n> both at once\n>> answered over two marks\n"),
    ]
    got = {g.turn: g for g in run(spark, rows)}
    assert [got[t].parent for t in range(6)] == [None, None, 0, 1, 1, 3]
    assert [sorted((q.level, q.original) for q in got[t].quoted) for t in range(6)] == [[], [], [(2, 0)], [(1, 1), (2, 0)], [(3, 1)], [(1, 1), (1, 3), (2, 0), (2, 2)]]
    assert got[5].n_quotes == 4
    assert (got[2].thread, got[2].depth) == (0, 1)


def test_long_quotations_many_marks_and_long_threads(spark):
    long = "\n".join(f"> quoted line number {i}" for i in range(100_000))
    alternating = "\n".join(("> " if i % 2 else ">> ") + f"line {i}" for i in range(20_000))
    rows = [(1, 0, "u", "the first words\nquoted line number 5"), (1, 1, "u", long + "\nan answer"), (1, 2, "u", ">" * 5000 + " the first words\nfar down"), (1, 3, "u", alternating)]
    rows += [(2, i, "u", f"> say {i - 1}\nsay {i}" if i else "say 0") for i in range(3000)]
    got = {(g.conv_id, g.turn): g for g in run(spark, rows)}
    assert (got[1, 1].text, got[1, 1].n_quotes, got[1, 1].parent) == ("an answer", 1, 0)
    assert (got[1, 2].text, got[1, 2].max_level, got[1, 2].parent) == ("far down", 5000, 0)
    assert (got[1, 3].text, got[1, 3].n_quotes) == ("", 20_000)
    assert all((g.parent, g.thread, g.depth) == (g.turn - 1 if g.turn else None, 0, g.turn) for k, g in got.items() if k[0] == 2)


def test_random_threads_equal_the_statement(spark):
    r = random.Random(5)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(r.randint(1, 14)):
            lines = [f"word{r.randint(0, 25)} and {r.choice('abc')}" for _ in range(r.randint(0, 3))]
            for _ in range(r.randint(0, 3) if said else 0):
                marks = "".join(r.choice([">", "> ", " >"]) for _ in range(r.randint(1, 4)))
                if r.random() < 0.3:
                    lines.append("Then Bob wrote: ")
                lines += [marks + " " * r.randint(0, 2) + r.choice(said).upper() + r.choice(["", "!", " x"]) for _ in range(r.randint(1, 3))]
                lines += [r.choice(said)] if r.random() < 0.3 else []
            said += [x for x in lines if ">" not in x] or ["nothing"]
            text = r.choice([None, "", "\n".join(lines)]) if r.random() < 0.1 else "\n".join(lines)
            rows += [(conv, turn if r.random() < 0.95 else None, "u", text)] * r.choice([1, 1, 1, 2])
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().astype({"turn": "Int64"})  # noqa: F841
    want = duckdb.sql(ORACLE_SQL["op3_quote_links"])
    names = want.columns
    plain = sorted(repr(tuple(x)) for x in want.fetchall())
    got = run(spark, rows)
    assert sorted(repr(tuple(getattr(g, n) for n in names)) for g in got) == plain
    assert sum(g.parent is not None for g in got) > 20 and max(g.depth for g in got) > 2
