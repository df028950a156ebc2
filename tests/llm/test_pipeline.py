"""The pipeline against brute force, stage by stage, and its registration."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from rosterlake.llm import bpe
from rosterlake.llm.oracle import ORACLE

from .helpers import edge_documents, jaccard_groups, no_documents, texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names_are_registered():
    names = driver.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLE) <= set(names)


@pytest.mark.parametrize("name", list(ORACLE))
def test_equal_to_duckdb(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    result = driver.queries()[name](spark, sf_dir)
    assert sorted(result.columns) == sorted(columns)
    found = map(tuple, result.select(*columns).collect())
    assert sorted(found, key=repr) == sorted(cursor.fetchall(), key=repr)


def test_stages_equal_brute_force(spark, sf_dir):
    documents = texts(spark, sf_dir)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    kept = {r[0] for r in connection.execute(f"SELECT doc_id FROM ({ORACLE['op6_quality_rules']}) WHERE kept").fetchall()}
    groups, _ = jaccard_groups({d: documents[d] for d in kept})
    kept = {d for d in kept if groups[d] == d}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {d for d in kept if not any(i in documents[d] for i in items)}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(found) == kept
    for d in kept:
        text = documents[d]
        if re.search(r"(?i)token|secret|passw|key|akia|[0-9a-z]{20}", text):
            assert "11111" not in text or found[d]
            continue
        assert found[d] == tokenizer.encode(text, add_special_tokens=False).ids


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    frame = edge_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns, name
        out.count()
        assert stage(spark, no_documents(spark), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents(spark), sf_dir).count() == 0
