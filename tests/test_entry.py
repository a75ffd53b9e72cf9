"""The registry against DuckDB, and the package without its optional part."""

import os
import subprocess
import sys

import pytest

from inkfold import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(list(value)) if isinstance(value, (list, tuple)) else str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


CHECKED = ["i04_status_by_genre", "e19_sections", "f05_coding_units", "f07_echo_phrases", "f09_masked_references", "d04_pending_pairs", "d17_rank_matched_join", "i07_majority_vote", "i12_expression_frequency", "j10_gaps_and_islands", "k05_upsert", "l04_threshold_clusters", "l12_modularity", "m03_verdict", "a09_corrupt_lines_skipped", "b05_partitioned_replace", "h02_coding_function", "n01_incremental_intake", "x02_session_windows", "e01_html_blocks", "e02_container_choice", "e04_heading_path", "e07_stop_at_boilerplate", "e13_attribution_merge", "e18_publication_date", "a14_thin_page_resolution"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cur = duck.execute(plans.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(names, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(plans.ORACLE) <= set(plans.QUERIES) and len(plans.QUERIES) > 100


def test_the_rest_works_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('inkfold.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
