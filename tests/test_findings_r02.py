"""What the second round's reviewer found, on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold import plans
from inkfold.operators import html, overlap


def test_references_cut_off_are_text_as_in_sql(spark, tmp_path):
    """Titles are cut at a length, also within a reference; the parser completes those by itself."""
    ends = ["&quot", "&quo", "&lt", "&gt", "&#39", "&#3", "&#", "&amp", "&am", "&", "&quotx;", "&ampx", "&amp;quot", "&quot;", "&lt;b&gt;", "&#39;s"]
    rows = [(i, f"<article><h1>Title of it {end}</h1><p>It is said {end} here.</p></article>") for i, end in enumerate(ends)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = plans.QUERIES["e01_html_blocks"](spark, str(tmp_path))
    c = pytest.importorskip("duckdb").connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(c.execute(plans.ORACLE["e01_html_blocks"]).fetchall()) and len(got) == 2 * len(ends)
    assert html.page_blocks("<h1>Said &quot</h1>") == [("title", [], "Said &quot")]
    assert html.page_blocks("<h1>Caf&eacute; &nbsp;&#8217; &copy;</h1>") == [("title", [], "Café ’ ©")]


def _plain_pairs(rows, least):
    sets = {}
    for i, value in rows:
        if i is not None and value is not None:
            sets.setdefault(i, set()).add(value)
    ids = sorted(sets)
    return sorted((a, b, n) for k, a in enumerate(ids) for b in ids[k + 1 :] if (n := len(sets[a] & sets[b])) >= least)


@pytest.mark.parametrize("least", [1, 4])
@pytest.mark.parametrize("codes", [12, 300, 3000])
def test_pairs_by_shared_values(spark, monkeypatch, codes, least):
    """Frequent values, rare ones beside some that most have, and rare ones only; several blocks, batches and spreads."""
    monkeypatch.setattr(overlap, "BLOCK_VALUES", 500)
    r = random.Random(codes)
    rows = [(r.randrange(-60, 60), r.randrange(codes) * (1 << 40)) for _ in range(1500)] + [(None, 0), (3, None), (500, None)]
    if codes == 300:
        rows += [(i, -k) for i in range(-60, 60) for k in range(1, 5) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "id bigint, value bigint")
    assert sorted(map(tuple, overlap.shared_values(df, least, 25).collect())) == _plain_pairs(rows, least)
    sets = df.where("id IS NOT NULL AND value IS NOT NULL").groupBy("id").agg(F.collect_set("value").alias("values"))
    for way in (overlap._multiplied(sets, least, 7), overlap._indexed(sets.select("id", F.explode("values").alias("value")), least)):
        assert sorted(map(tuple, way.collect())) == _plain_pairs(rows, least)


def test_products_in_strips_and_spreads(monkeypatch):
    monkeypatch.setattr(overlap, "STRIP", 64)
    monkeypatch.setattr(overlap, "SPREAD", 5)
    r = random.Random(1)
    rows = sorted({(r.randrange(70), r.randrange(90)) for _ in range(600)} | {(i, 1000) for i in range(70)})
    t = {i: [v for j, v in rows if j == i] for i in range(70)}

    def side(ids):
        return np.array(ids), np.repeat(np.arange(len(ids)), [len(t[i]) for i in ids]), np.array([v for i in ids for v in t[i]])

    blocks = side([i for i in range(70) if i % 2]), side([i for i in range(70) if not i % 2])
    got = [p for a, b, inner in ((*blocks, False), (blocks[0], blocks[0], True), (blocks[1], blocks[1], True)) for batch in overlap._counted(a, b, 1, inner) for p in zip(*(x.tolist() for x in batch))]
    assert sorted(got) == _plain_pairs(rows, 1)


def test_no_pair_is_exchanged_where_codes_are_frequent(spark):
    """The join made a row for each code that two documents share: 100 of them here for each pair."""
    rows = spark.range(300).select("id", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("value"))
    df = overlap.shared_values(rows)
    assert "Join" not in df._jdf.queryExecution().toString()
    assert df.groupBy("weight").count().collect() == [(100, 300 * 299 // 2)]


def _events(spark, tmp_path, rows):
    """``events`` of (user, k), k null where a record has no code."""
    made = [(i, user, "view", 1.0, "{}" if k is None else f'{{"k": {k}}}') for i, (user, k) in enumerate(rows)]
    df = spark.createDataFrame(made, "event_id bigint, user_id bigint, event_type string, value double, props string")
    df.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    c = pytest.importorskip("duckdb").connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return c


@pytest.mark.parametrize("name", ["d10_shared_code_pairs", "d12_thematic_edges", "l08_bipartite_projection"])
def test_projections_equal_their_sql_and_make_no_row_for_a_shared_code(spark, tmp_path, name):
    """Also users without a code, with one of their own, and records without a user."""
    r = random.Random(3)
    rows = [(r.randrange(80), r.randrange(20)) for _ in range(700)] + [(200, None), (201, 999), (None, 3), (None, None), (5, None)]
    c = _events(spark, tmp_path, rows)
    df = plans.QUERIES[name](spark, str(tmp_path))
    got, want = [sorted(x, key=str) for x in (map(tuple, df.collect()), c.execute(plans.ORACLE[name]).fetchall())]
    assert got == want and len(got) > 50
    if name != "l08_bipartite_projection":
        assert "Join" not in df._jdf.queryExecution().toString()
    else:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the codes' counts
