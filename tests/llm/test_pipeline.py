import math
import time
from pathlib import Path

import duckdb
import pytest

import brute
import __spark_entry__ as entry
import corpus_pipeline as P
from fleetscope.llm.common import Scratch, setting


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out.append(docs)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert len(P.STAGES) == 4 and all(s.columns == stages[0].columns for s in stages[:4])


def test_quality_stage(spark, sf_dir, stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:2])
    assert set(after) < set(before) and all(before[d] == t for d, t in after.items())
    assert not any(brute.quality(t)[5] for t in after.values())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and d in before and not brute.quality(before[d])[5]]
    assert sum(d in after for d in good) >= 0.95 * len(good)


def test_near_duplicate_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[1:3])
    gone = set(before) - set(after)
    for d in gone:
        assert any(e < d and brute.jaccard(before[e], before[d]) >= 0.5 for e in before), d
    kept = sorted(after)
    assert sum(brute.jaccard(after[a], after[b]) >= 0.8 for i, a in enumerate(kept) for b in kept[i + 1 :]) == 0


def test_substring_stage(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    want = brute.substring(list(before.items()))
    assert set(before) == set(after)
    for d, t in after.items():
        assert len(brute.WORD.findall(t or "")) == want[d][0] - want[d][1]


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and (k == 3 or none.columns == docs.columns)
    text = " ".join(f"odd{i}" for i in range(40))
    rows = spark.createDataFrame([(None, text, 1), (7, text, 1), (7, text, 1), (8, text, 1), (9, None, 1), (10, "", 1)], "doc_id long, text string, root long")
    near = sorted((r["doc_id"] for r in P.near_duplicates(spark, rows, sf_dir).collect()), key=repr)
    assert near == sorted([None, 7, 7, 9], key=repr)
    cut = sorted(((r["doc_id"], r["text"]) for r in P.substrings(spark, rows, sf_dir).collect()), key=repr)
    assert cut == sorted([(None, text), (7, text), (7, text), (8, ""), (9, None), (10, "")], key=repr)
    assert P.packing(spark, rows, sf_dir).count() == 6


def test_near_duplicate_stage_leaves_little_on_disk(spark, sf_dir, docs_of, prose):
    tables = lambda: {p.parent for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet")}
    docs, held = docs_of(prose), tables()
    kept = P.near_duplicates(spark, docs, sf_dir)
    assert len(tables() - held) == 1  # the ids that go
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 55} <= ids and not ids & {53, 54, 56, 57}


def test_written_tables_release_their_shuffles(spark, docs_of, prose):
    shuffles = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffles()
    with setting(spark, "spark.sql.adaptive.enabled", "true"):
        table = Scratch(spark, release=True).cut(docs_of(prose).groupBy("doc_id").count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:  # files go in the background
        time.sleep(0.1)
    assert not shuffles() - before
    assert table.count() == len(prose)


def test_packing_stage(stages):
    rows = stages[4].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[3].collect()}
    assert len({r["sequence_id"] for r in rows}) == math.ceil(sum(r["length"] for r in rows) / 2048)


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_substring_dedup", "op7_embedding_near_dedup", "op8_license_scan"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, entry.queries()[name](spark, sf_dir).select(*columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op2_best_fit_packing", None), ("op3_simhash_near_dedup", "documents"), ("op4_bpe_round_trip", "documents"), ("op5_quality_rules", "documents"), ("op6_substring_dedup", "documents"), ("op7_embedding_near_dedup", "embeddings"), ("op9_context_tree_scores", "documents"), ("op10_html_extraction", "pages")])
def test_queries_cover_whole_tables(spark, sf_dir, name, table):
    got = entry.queries()[name](spark, sf_dir)
    if table is None:
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert got.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_simhash_query_on_the_table(spark, sf_dir):
    rows = {r["doc_id"]: brute.fingerprint(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(rows)
    root = brute.components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (rows[a] ^ rows[b]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.queries()["op3_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {d: (f"{rows[d]:016x}", root[d]) for d in ids}
