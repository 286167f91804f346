import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from nodeweave.queries import core
from tests.conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Queries whose plans the others contain; each runs several searches or traversals.
LONG = {
    "traverse_read_full", "traverse_max_visited", "traverse_single_path", "traverse_included", "traverse_rejected", "traverse_default", "traverse_indexed", "insert_edges", "compare_methods", "compare_hits", "indexed_purity", "score_counts",
    "eval_retrieval", "seeds_preferred", "lsh_seeds", "lsh_buckets", "score_relation", "score_relation_attach", "attach_relation_rank", "candidate_union", "teacher_asked", "eval_mrr", "eval_attach", "metric_gates", "vec_dot", "vec_norm",
}
CHECKED = sorted(n for n in core.oracle_sql() if n not in LONG)


def plain(v):
    """Values as told apart here: numbers to six places, a negative zero is not a zero."""
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = core.queries()[name](spark, SF)
    cur = duck.execute(core.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(str([plain(dict(zip(cols, r))[c]) for c in sorted(cols)]) for r in cur.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(cols)]) for r in got.collect()) == want


def test_names_need_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1]) > 80


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_core_does_not_import_the_training_data_part():
    for path in glob.glob(f"{ROOT}/nodeweave/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "nodeweave.llm" not in f.read(), path
