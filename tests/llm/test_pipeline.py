"""The corpus pipeline, stage by stage, and without the subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
from sluiceway.llm import pii, simhash
from tests.llm.conftest import FOLDER
from tests.llm.test_learned import plain as statistics
from tests.llm.test_tokens import whole

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark, given, tmp_path):
    docs = given("documents")
    documents = docs.columns
    labels = {r.doc_id: r for r in given("labels").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == documents
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            assert sum(labels[i].toxic for i in gone if i in labels) >= 0.9 * sum(i in labels for i in gone)
        elif name == "quality":
            for i, r in before.items():
                n, *_, repeated = statistics(r.text)
                if n < 50 or 100 * repeated > 50 * n:
                    assert i not in after
            clean = [i for i in before if i in labels and labels[i].quality and statistics(before[i].text)[0] >= 50]
            assert sum(i in after for i in clean) >= 0.97 * len(clean)
        elif name == "near_duplicates":
            prints = {i: simhash.fingerprint(r.text) for i, r in before.items()}
            for i in set(before) - set(after):
                assert any((prints[i] ^ p).bit_count() <= 4 for j, p in prints.items() if j != i)
            kept = sorted(after)
            assert all((prints[i] ^ prints[j]).bit_count() > 4 for i in kept for j in kept if i < j)
        elif name == "personal_data":
            assert set(after) == set(before)
            assert all(r.n_chars == len(r.text) for r in rows)
            emails = sum("<email>" in r.text for r in rows)
            assert emails == sum("@mail" in r.text for r in before.values())
            assert not any("@mail" in r.text for r in rows)
        else:
            whole(rows, [(i, r.text) for i, r in before.items()], 2048)
        before = after


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns[0] == "doc_id" and rows.count() > 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_lines' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_kinds_of_personal_data_are_ordered():
    assert pii.KINDS == ["email", "ip", "card", "phone", "id"]
