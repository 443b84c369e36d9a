from pyspark.sql import functions as F

from nearkin.llm import log_templates
from nearkin.llm.log_templates import dedup_lines
from tests.llm.cases import clashing, documents


def kept(spark, texts, **options):
    rows = dedup_lines(documents(spark, texts), **options).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows), key=repr)


def test_recurring_line_stays_in_the_first_document(spark):
    line = "Terms of use apply here."
    own = {1: "Alpha has a line", 2: "Beta begins unlike the others", 3: "No third one is like it"}
    texts = [(i, f"{own[i]}\n{line}\n{line}") for i in (3, 1, 2)]
    got = kept(spark, texts)
    assert got[0][1].count(line) == 2 and got[0][3] == 0
    assert [g[3] for g in got[1:]] == [2, 2] and all(line not in g[1] for g in got[1:])


def test_two_documents_are_not_enough(spark):
    line = "Terms of use apply here."
    assert all(g[3] == 0 for g in kept(spark, [(1, line), (2, line), (2, line)]))


def test_variable_fields(spark):
    numbers = [(i, f"Posted at 1{i}:00 by user{i}") for i in range(4)]
    assert [g[3] for g in kept(spark, numbers)] == [0, 1, 1, 1]
    names = ["anna", "bert", "carl", "dora"]
    fields = [(i, f"This page was last edited by {n} on a monday") for i, n in enumerate(names)]
    assert [g[3] for g in kept(spark, fields)] == [0, 1, 1, 1]
    blanks = [(i, f"\tTerms  of use{' ' * i} apply \r") for i in range(4)]
    assert [g[3] for g in kept(spark, blanks)] == [0, 1, 1, 1]


def test_several_templates_in_a_leaf(spark):
    words = [f"{a}{b}" for a in "bdfgklmnpr" for b in ("asa", "ele", "iro", "omu")]
    desks = [f"Please contact our {w} desk for help today" for w in words]
    more = [f"Please contact our {w} when you need more" for w in words[:30]]
    last = [f"Please contact our {w} if all has failed" for w in words[:4]]
    got = sorted(kept(spark, list(enumerate(desks + more + last))))
    assert [g[3] for g in got] == [0] + 39 * [1] + [0] + 29 * [1] + [0] + 3 * [1]
    # the same with a token that two of them share
    shared = [line.replace("more", "today") for line in more]
    got = sorted(kept(spark, list(enumerate(desks + shared))))
    assert [g[3] for g in got] == [0] + 39 * [1] + [0] + 29 * [1]


def test_long_lines_without_blanks(spark):
    line = "本站所有内容均为原创未经许可不得转载或用于任何商业用途谢谢您的理解和配合支持"
    got = kept(spark, [(i, f"{line}\n短行{i}\n短行") for i in range(4)])
    assert [g[3] for g in got] == [0, 1, 1, 1]


def test_own_counts_stay(spark):
    docs = clashing(documents(spark))
    for name in ("_doc", "_dh", "_gone", "owner", "LOST", "part", "counts", "pos", "t"):
        docs = docs.withColumn(name, F.lit(7))
    got = dedup_lines(docs, counts=False)
    assert got.columns == docs.columns
    assert {r.n_lines for r in got.collect()} == {r.owner for r in got.collect()} == {7}


def test_unlike_lines_of_a_leaf_stay(spark):
    texts = [(i, f"It was the {a} {b} {c} {d} {e}") for i, (a, b, c, d, e) in
             enumerate(["abcde", "fghij", "klmno", "pqrst", "uvwxy"])]
    assert all(g[3] == 0 for g in kept(spark, texts))


def test_short_lines_and_odd_texts(spark):
    texts = [(i, "So be\n\nit.") for i in range(5)] + [(10, None), (11, ""), (12, "\n"), (None, "So be")]
    got = {g[0]: g[1:] for g in kept(spark, texts)}
    assert got[0] == ("So be\n\nit.", 3, 0)
    assert got[10] == (None, 0, 0) and got[11] == ("", 1, 0) and got[12] == ("\n", 2, 0)
    long = [(i, "Same long line of words here\n" * 400 + "tail " * 2000) for i in range(3)]
    assert [g[3] for g in kept(spark, long)] == [0, 401, 401]


def test_repeated_rows_and_columns(spark):
    docs = clashing(documents(spark))
    got = dedup_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    assert got.count() == docs.count() and got.agg({"n_dropped": "sum"}).first()[0] == 0
    assert dedup_lines(docs.limit(0)).count() == 0


def test_texts_are_hashed_before_they_are_broken(spark, capsys):
    """Neither a text nor a line is worked on once for each line or condition."""
    places = log_templates._places(spark.createDataFrame([(1, "a b c\nd")], "doc_id long, text string"), "doc_id", "text")
    places.explain()
    above = capsys.readouterr().out.split("Generate")[0]
    assert "xxhash64(text" not in above and "Filter" not in above
    assert sorted((r.pos, r.counts, r.th is None) for r in places.collect()) == [(0, True, False), (1, False, True)]
