import random

import duckdb

from tidefold.llm import lines


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(lines.OP9_SQL).fetchall())


def test_templates_and_edge_cases(spark):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(1, 8))]
        if d % 3 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), f"Posted on day {d} by the site team of our  page")
        if d % 4 == 1:
            parts.append(f"Share this page with {word()} and all of your friends today or any day")
        if d % 5 == 2:
            parts += ["", "Rare header line", "Rare header line"]
        if d % 20 == 7:
            parts.append("only in three documents")
        rows.append((d, "\n".join(parts)))
    rows += [(100 + i, rows[2][1]) for i in range(12)]  # exact copies are no recurrence
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " "), (204, "Rare header line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pos", "2 AS rk").repartition(4)
    out = lines.drop_recurring_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    got = sorted((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect())
    assert got == oracle(rows)
    by = {r[0]: r for r in got}
    assert by[204][1] == "" and by[200] == (200, None, 0, 0) and by[105][3] == by[104][3]
    assert sum("Posted on day" in (r[1] or "") for r in got) == 1 and sum("Share this page" in (r[1] or "") for r in got) == 1
    assert sum("only in three" in (r[1] or "") for r in got) == 3
    assert lines.drop_recurring_lines(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b\nc d"), (None, "a b\nc d"), (1, "c d")], "doc_id long, text string")
    assert [r.text for r in lines.drop_recurring_lines(odd, min_docs=2).orderBy("doc_id").collect()] == ["a b", "a b", "c d"]


def test_templates_that_share_a_leaf(spark):
    """A template is found by its own lines, whatever else begins alike, and two templates of a leaf stay apart."""
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    rows = []
    for d in range(200):
        if d < 40:
            line = f"This page was updated by {word()} for all of the {word()} readers"
        elif d < 70:
            line = f"This page was printed in {word()} with some ink from {word()} ltd"
        elif d < 160:
            line = "This page was " + " ".join(word() for _ in range(9))
        else:
            line = f"Written down by {word()}"
        rows.append((d, f"{word()} {word()}\n{line}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in lines.drop_recurring_lines(df).collect())
    assert got == oracle(rows)
    kept = lambda a, b: sum(r[1].count("\n") for r in got[a:b])
    assert (kept(0, 40), kept(40, 70), kept(70, 160), kept(160, 200)) == (1, 1, 90, 1)


def test_query_matches_the_oracle(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lines.op9_lines(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == oracle(rows)
