"""Line dedup with a log-template tree, in DataFrame operations only.

A line's tokens are its blank-separated words; words with a digit are variable
fields (``<*>``).  The tree has a fixed depth: the token count, the first
``LEADS`` tokens, then up to ``DEPTH - 1`` further tokens.  In a node, a position
is constant if one token holds it in more than half of the node's distinct
lines; where constants make up ``SIMILAR`` of the positions, all lines that agree
with so many are one template with variable fields elsewhere.  Any other line
descends by its most frequent token that is not constant there, if ``MIN_DOCS``
lines have it, so that a template counts by its own lines and not by its share
of a leaf.  Lines that match nowhere are templates of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import fresh, row_key, stored, table, wide_hash

LEADS = 3
DEPTH = 3
#: Tenths of the positions that have to agree.
SIMILAR = 7
#: A template in so many different documents (exact copies count once) is boilerplate.
MIN_DOCS = 5


def _exploded(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """One row per line that has a token: row key, position, token count, template text and hashes, and ``more`` of the document.

    Tokens are counted and led by byte operations on the line; no array of them is made.
    """
    line = F.col("line")
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)
    loose = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    tidy = F.when(loose, F.regexp_replace(F.trim("masked"), " +", " ")).otherwise(F.col("masked"))
    blanks = F.octet_length("tpl_text") - F.octet_length(F.replace("tpl_text", F.lit(" "), F.lit("")))
    return (
        docs.select(
            row_key(id_col, text_col).alias("rk"),
            *more,
            F.posexplode(F.split(text_col, "\n")).alias("pos", "line"),
        )
        .withColumn("masked", masked)
        .withColumn("tpl_text", tidy)
        .drop("line", "masked")
        .where("tpl_text <> ''")
        .withColumn("n", blanks + 1)
        .withColumn("leaf", F.xxhash64("n", F.substring_index("tpl_text", " ", LEADS)))
        .withColumn("tpl", wide_hash("tpl_text"))
    )


def _templates(words: DataFrame, min_docs: int) -> DataFrame:
    """``(tpl, node)`` of the lines of ``words(node, tpl, n, at, token)`` that match a template of the tree.

    ``at`` counts from 0 and leaves out the leading tokens, which all lines of a
    node have in common.  Every level is two aggregations and a join, whose small
    side is a table, so that a token which very many lines have can be split.
    """
    alike = F.lit(10 * LEADS) >= SIMILAR * F.col("n")  # the leading tokens are enough
    found = [words.where(alike & (F.col("at") == LEADS)).select("tpl", "node")]
    words = words.where(~alike)
    for level in range(DEPTH):
        size = words.where(F.col("at") == LEADS).groupBy("node").agg(F.count(F.lit(1)).alias("nt")).where("nt > 1")
        telling = stored(
            words.groupBy("node", "at", "token")
            .agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
            .join(size, "node")
            .where((2 * F.col("c") > F.col("nt")) | (F.col("c") >= min_docs))
            .withColumn("constant", 2 * F.col("c") > F.col("nt")),
            "telling",
        )
        shaped = (
            telling.where("constant")
            .groupBy("node")
            .agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
            .select("node", (10 * (F.col("k") + LEADS) >= SIMILAR * F.col("n")).alias("shaped"))
        )
        best = F.max(F.when(~F.col("constant"), F.struct("c", (-F.col("at")).alias("before"), "token"))).alias("best")
        judged = (
            words.join(telling.select("node", "at", "token", "c", "constant"), ["node", "at", "token"])
            .groupBy("node", "tpl")
            .agg(F.count_if("constant").alias("k"), F.first("n").alias("n"), best)
            .join(shaped, "node", "left")
            .withColumn("match", F.col("shaped") & (10 * (F.col("k") + LEADS) >= SIMILAR * F.col("n")))
        )
        judged = stored(judged.select("node", "tpl", "match", F.when(F.col("best.c") >= min_docs, F.col("best")).alias("best")), "judged")
        found.append(judged.where("match").select("tpl", "node"))
        if level + 1 < DEPTH:
            deeper = judged.where("match IS NOT TRUE AND best IS NOT NULL").select("tpl", F.xxhash64("node", "best.before", "best.token").alias("node"))
            words = stored(words.drop("node").join(deeper, "tpl"), "words")
    return reduce(DataFrame.unionByName, found)


def _in_documents(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Keys found in ``min_docs`` different texts, counted in two steps so that no key is one task's load."""
    return rows.select(key, "content").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``(rk, drops array<int>)``: positions of the lines to drop, for each row key that has any."""
    docs = docs.select(id_col, text_col)
    keys = (wide_hash(text_col).alias("content"), F.col(id_col).alias("id"))
    lines = stored(_exploded(docs, id_col, text_col, *keys).select("rk", "id", "content", "pos", "leaf", "tpl"), "lines")
    hot = (
        _in_documents(lines, "leaf", min_docs)
        .join(lines.select("leaf", "tpl").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("nt")).where("nt > 1"), "leaf")
        .select("leaf", "nt")
    )
    # one occurrence of each distinct line of those leaves, found without the texts
    wanted = (
        lines.groupBy("leaf", "tpl")
        .agg(F.min(F.struct("rk", "pos")).alias("at"))
        .join(hot.select("leaf"), "leaf")
        .groupBy(F.col("at.rk").alias("_rk"))
        .agg(F.collect_list("at.pos").alias("_wanted"))
    )
    owners = docs.withColumn("_rk", row_key(id_col, text_col)).join(wanted, "_rk")
    distinct = (
        _exploded(owners, id_col, text_col, F.col("_wanted"))
        .where(F.array_contains("_wanted", F.col("pos")))
        .select("leaf", "tpl", "n", "tpl_text")
        .dropDuplicates(["tpl"])
    )
    tokens = F.posexplode(F.split("tpl_text", " ")).alias("at", "token")
    words = stored(distinct.select(F.col("leaf").alias("node"), "tpl", "n", tokens).where(F.col("at") >= LEADS), "words")
    matched = stored(_templates(words, min_docs), "matched")
    grouped = stored(
        lines.join(matched, "tpl", "left").select(
            "rk", "id", "content", "pos", F.when(F.col("node").isNotNull(), F.struct("node", F.lit(None).cast("bigint").alias("more"))).otherwise(F.struct(F.col("tpl.a").alias("node"), F.col("tpl.b").alias("more"))).alias("group")
        ),
        "grouped",
    )
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "pos", "rk")).alias("first"))
    recurring = stored(
        first.join(_in_documents(grouped, "group", min_docs), "group").select("group", F.col("first.rk").alias("rk0"), F.col("first.pos").alias("pos0")),
        "recurring",  # a table, so that the join can split the rows of a template that very many documents have
    )
    return (
        grouped.join(recurring, "group")
        .where((F.col("rk") != F.col("rk0")) | (F.col("pos") != F.col("pos0")))
        .select("rk", "pos")
        .distinct()
        .groupBy("rk")
        .agg(F.collect_list("pos").alias("drops"))
    )


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """``docs`` with recurring lines dropped, and the columns ``counts`` of lines and dropped lines.

    A recurring template keeps its first occurrence (smallest id, then position;
    null ids last).  Lines without a token stay.  A null text stays null with no
    lines; an empty text has one line; repeated rows get the same text; a
    document may lose all its lines and is then empty.
    """
    rk, gone = fresh(docs, "_rk"), fresh(docs, "_drops")
    drops = dropped_lines(docs, id_col, text_col, min_docs).withColumnsRenamed({"rk": rk, "drops": gone})
    text = F.col(text_col)
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1

    def rebuilt(lines):  # a lambda variable, so that the text is split once
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    shorter = F.get(F.transform(F.array(F.split(text, "\n")), rebuilt), F.lit(0))
    return (
        docs.withColumn(rk, row_key(id_col, text_col))
        .join(drops, rk, "left")
        .withColumns(
            {
                counts[0]: F.coalesce(n_lines, F.lit(0)).cast("bigint"),
                counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
                text_col: F.when(F.col(gone).isNull(), text).otherwise(shorter),
            }
        )
        .drop(rk, gone)
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without recurring lines; nulls, repeated rows and empty tables: as ``drop_recurring_lines``."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def _levels_sql() -> str:
    """CTEs w1 .. and j0 ..: the words of lines that descend, and the verdict on each line, by level."""
    out = []
    for i in range(DEPTH):
        out.append(f"""
s{i} AS (SELECT node, count(DISTINCT tpl) AS nt FROM w{i} GROUP BY node HAVING count(DISTINCT tpl) > 1),
t{i} AS (SELECT w.node, w.at, w.token, any_value(w.n) AS n, count(*) AS c, 2 * count(*) > any_value(s.nt) AS constant
  FROM w{i} w JOIN s{i} s ON s.node = w.node GROUP BY w.node, w.at, w.token HAVING 2 * count(*) > any_value(s.nt) OR count(*) >= {MIN_DOCS}),
h{i} AS (SELECT node FROM t{i} WHERE constant GROUP BY node HAVING 10 * (count(*) + {LEADS}) >= {SIMILAR} * any_value(n)),
k{i} AS (SELECT w.node, w.tpl, any_value(w.n) AS n, count(*) FILTER (WHERE constant) AS k,
    max(CASE WHEN NOT constant AND c >= {MIN_DOCS} THEN {{'c': c, 'before': -w.at, 'token': w.token}} END) AS best
  FROM w{i} w JOIN t{i} t ON t.node = w.node AND t.at = w.at AND t.token = w.token GROUP BY w.node, w.tpl),
j{i} AS (SELECT node, tpl, best, node IN (SELECT node FROM h{i}) AND 10 * (k + {LEADS}) >= {SIMILAR} * n AS match FROM k{i}),""")
        if i + 1 < DEPTH:
            out.append(f"""
w{i + 1} AS (SELECT j.node || chr(10) || j.best.before || ' ' || j.best.token AS node, w.tpl, w.n, w.token, w.at
  FROM w{i} w JOIN j{i} j ON j.tpl = w.tpl WHERE NOT j.match AND j.best IS NOT NULL),""")
    return "".join(out)


def lines_sql(source: str = "documents") -> str:
    """CTEs ending in ``deduped(doc_id, text, n_lines, n_dropped)`` over ``source(doc_id, text)``; doc_id is unique there."""
    return f"""
l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {source}),
l1 AS (SELECT doc_id, text, pos, list_filter(string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda x: x <> '') AS tokens FROM l0),
lines AS (
  SELECT doc_id, md5(text) AS content, pos, tokens, len(tokens) AS n,
    len(tokens) || '|' || array_to_string(tokens[1:{LEADS}], ' ') AS leaf, array_to_string(tokens, ' ') AS tpl
  FROM l1 WHERE len(tokens) > 0),
hot AS (SELECT leaf, count(DISTINCT tpl) AS nt FROM lines GROUP BY leaf HAVING count(DISTINCT content) >= {MIN_DOCS} AND count(DISTINCT tpl) > 1),
tpls AS (SELECT DISTINCT l.leaf, l.tpl, l.n, l.tokens FROM lines l JOIN hot h ON h.leaf = l.leaf WHERE l.n > {LEADS}),
w0 AS (
  SELECT leaf AS node, tpl, n, unnest(tokens[{LEADS + 1}:]) AS token, generate_subscripts(tokens[{LEADS + 1}:], 1) + {LEADS} AS at
  FROM tpls WHERE {10 * LEADS} < {SIMILAR} * n),
{_levels_sql()}
matched AS (SELECT tpl, leaf AS node FROM tpls WHERE {10 * LEADS} >= {SIMILAR} * n UNION ALL {" UNION ALL ".join(f"SELECT tpl, node FROM j{i} WHERE match" for i in range(DEPTH))}),
grouped AS (
  SELECT l.doc_id, l.content, l.pos, CASE WHEN m.tpl IS NULL THEN 'T' || l.tpl ELSE 'L' || m.node END AS g
  FROM lines l LEFT JOIN matched m ON m.tpl = l.tpl),
recurring AS (SELECT g, min((doc_id::HUGEINT << 32) + pos) AS first FROM grouped GROUP BY g HAVING count(DISTINCT content) >= {MIN_DOCS}),
drops AS (
  SELECT o.doc_id, o.pos FROM grouped o JOIN recurring r ON r.g = o.g WHERE (o.doc_id::HUGEINT << 32) + o.pos <> r.first),
gone AS (SELECT doc_id, count(*) AS k FROM drops GROUP BY doc_id),
rebuilt AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM l0 l LEFT JOIN drops d ON d.doc_id = l.doc_id AND d.pos = l.pos
  WHERE d.pos IS NULL AND l.doc_id IN (SELECT doc_id FROM gone) GROUP BY l.doc_id),
deduped AS (
  SELECT s.doc_id, CASE WHEN k IS NULL THEN s.text ELSE coalesce(r.text, '') END AS text,
    coalesce(len(string_split(s.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_dropped
  FROM {source} s LEFT JOIN gone ON gone.doc_id = s.doc_id LEFT JOIN rebuilt r ON r.doc_id = s.doc_id)
"""


OP9_SQL = "WITH " + lines_sql() + " SELECT doc_id, text, n_lines, n_dropped FROM deduped"
