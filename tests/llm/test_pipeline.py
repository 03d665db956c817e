import os
import re
import subprocess
import sys

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_dedup import clean, near_by_hand
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_by_hand(spark):
    from tierwatch.functions.shared import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "test")
        assert docs.columns == columns
        tables[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = tables["quality classifier"]
    kept = {d for d, _ in good}
    assert set(good) <= set(given)
    assert np.mean([(d in kept) == (labels[d] == 1) for d, _ in given if d in labels]) > 0.95
    first = {}
    for d, t in sorted(good):
        first.setdefault(clean(t), d)
    assert sorted(d for d, _ in tables["exact dedup"]) == sorted(first.values())
    left = [r[0] for r in near_by_hand(tables["exact dedup"]) if r[3]]
    assert sorted(d for d, _ in tables["near dedup"]) == sorted(left)
    masked = [(d, re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t)) for d, t in tables["near dedup"]]
    assert sorted(tables["secret scan"]) == sorted(masked)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(packed, tables["secret scan"])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect()) == sorted(
        (r["doc_id"], r["start"], r["length"]) for r in packed
    )


def test_stages_on_awkward_rows(spark, clashing, nothing):
    for table in (clashing, nothing):
        docs = table
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, SF)
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_the_rest_works_without_this_subpackage(tmp_path):
    """The entry module imports and lists the other queries where the text operators are gone."""
    for name in ("workload", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tierwatch")
    for name in os.listdir(f"{ROOT}/tierwatch"):
        if name != "llm":
            os.symlink(f"{ROOT}/tierwatch/{name}", tmp_path / "tierwatch" / name)
    code = (
        "import importlib.util, sys; s = importlib.util.spec_from_file_location('e', '__spark_entry__.py');"
        "m = importlib.util.module_from_spec(s); sys.path.insert(0, '.'); "
        "src = open('__spark_entry__.py').read().replace('os.path.dirname(os.path.abspath(__file__))', repr('.'));"
        "exec(compile(src, 'e', 'exec'), m.__dict__); q = m.queries(); o = m.oracle_sql();"
        "assert 'classify' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    assert public_tokenizers.PATTERN
