import duckdb

import corpus_pipeline
from tests.llm.test_packing import check
from tests.llm.test_simhash import groups
from tidefold.llm import decontaminate, lines, quality


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            check(list(before.items()), out.collect())
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            base = {d for d, t in before.items() if (c := quality.statistics(t)[0])[0] >= 50 and 100 * c[4] <= 50 * c[0]}
            assert after.items() <= before.items() and after.keys() <= base and len(after) > 0.7 * len(base)
        elif name == "line_dedup":
            con = duckdb.connect()
            con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?)", list(before.items()))
            assert after == {r[0]: r[1] for r in con.sql(lines.OP9_SQL).fetchall()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_dedup":
            assert after == {d: before[d] for d, c in groups(before).items() if d == c}
        else:
            items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            joined = {d: b" ".join(decontaminate.words_of(t)) for d, t in before.items()}
            must = {d for d, t in joined.items() if any(b" ".join(w) in t for w in items.values())}
            assert after.items() <= before.items() and not must & after.keys() and len(after) > 0.8 * len(before)
        docs, before = out, after


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    some = rows[0]
    rows += [some, some, (None, some[1], None, None, None), (None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", None, None, 0)]
    rows += [(None, " ".join(f"w{i}x" for i in range(90)), None, None, None), (900003, " ".join(f"long{i} words." for i in range(60_000)), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS _rk", "2 AS id", "'x' AS _drops", "3 AS fp", "4 AS _n_dropped", "5 AS shard")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        last = name == "packing"
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        stage(spark, empty, sf).write.parquet(str(tmp_path / f"{name}-empty"))
        docs, empty = spark.read.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / f"{name}-empty"))
        assert empty.count() == 0
        if not last:
            assert docs.columns[-6:] == ["_rk", "id", "_drops", "fp", "_n_dropped", "shard"]
            assert docs.where("doc_id = 900003").count() == 1 or name != "quality"
    assert docs.count() > 0


def test_decontamination_is_fitted_on_all_items_and_no_sample(spark, monkeypatch):
    """The stage's basis comes from every item of the benchmark and from no document; its projection has their features only."""
    fit, build, seen, made = decontaminate.latent_basis, decontaminate.build_index, [], []
    monkeypatch.setattr(decontaminate, "latent_basis", lambda passages, *a: seen.append({r.text for r in passages.collect()}) or fit(passages, *a))
    monkeypatch.setattr(decontaminate, "build_index", lambda *a: made.append(build(*a)) or made[-1])
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    assert kept.columns and seen == [{b" ".join(p).decode() for w in items if w for p in decontaminate.indexed_passages(w)}]
    assert len(made[0].projection) <= len({f for w in items for f in decontaminate.features_of(w).tolist()}) + 1
