"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
from graphloom.llm import langid
from graphloom.llm.common import materialize, table
from graphloom.llm.registry import QUERIES, SQL
from tests.llm.test_operators import brute_leaks, brute_lines, brute_near, sha


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns, seen = docs.columns, {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), f"test-{name}")
        seen[name] = docs.collect()
        if name != "source_mixing":
            assert docs.columns == columns
    first = {r.doc_id for r in seen["language_id"]}
    known = [r for r in seen["documents"] if any(c.isalpha() for c in r.text or "")]
    assert first <= {r.doc_id for r in known} and len(first) >= 0.99 * len(known)
    pairs = [(r.doc_id, r.text) for r in seen["language_id"]]
    lines = {d: h for d, _, _, h in brute_lines(pairs)}
    assert {r.doc_id: sha(r.text or "") for r in seen["line_dedup"]} == lines and all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    near = brute_near([(r.doc_id, r.text) for r in seen["line_dedup"]])
    assert {r.doc_id for r in seen["near_duplicates"]} == {d for d, (_, c) in near.items() if c == d}
    leaks = brute_leaks([(r.doc_id, r.text) for r in seen["near_duplicates"]], [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()])
    assert {r.doc_id for r in seen["decontamination"]} == {d for d, x in leaks.items() if not x[4]}
    mixed = seen["source_mixing"]
    assert {r.doc_id for r in mixed} == {r.doc_id for r in seen["decontamination"]}
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(r["size"] for r in mixed)) <= 20


def test_empty_table(spark, no_docs, data):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), f"empty-{name}")
        assert docs.count() == 0


def test_queries_with_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, text in SQL.items():
        want = con.sql(text)
        cols = sorted(want.columns)
        got = QUERIES[name](spark, data).select(*cols).collect()
        assert Counter(map(tuple, got)) == Counter(want.select(", ".join(cols)).fetchall()), name


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert langid.remainder is not None and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_go_through(spark, odd_docs, data):
    docs, counts = odd_docs, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), f"odd-{name}")
        counts.append(docs.count())
        if name != "source_mixing":
            assert docs.columns == odd_docs.columns
    # what has no letter goes, then the copy of document 4; a row without an id stays
    assert counts[0] == counts[1] and counts[2] == counts[1] - 1 == counts[3] == counts[4]


def test_run_cleans_up(spark, data):
    from graphloom.scratch import tables_made

    with tables_made() as made:
        out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    left = [p for p in made if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert left == made[-1:]
