"""The pipeline's stages, each on its own input and against brute force."""

import re

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, quality
from strandline.llm.queries import oracle_sql, queries
from strandline.llm.shared import local_roots
from tests.llm.test_operators import brute_lines, rule_statistics

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against what it should keep of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        after = {r.doc_id: r for r in docs.collect()}
        assert tuple(docs.columns) == P.COLUMNS and after.keys() <= before.keys()
        kept[name] = before, after
    before, after = kept["quality_rules"]
    for doc, r in before.items():
        n, *_, repeats = rule_statistics(r.text)
        assert doc not in after or not (n < 50 or 100 * repeats > 50 * n)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert after.keys() == {r.doc_id for r in quality.judged(source, quality.fit(source, labels)).where("kept").collect()}
    before, after = kept["language_id"]
    rows = spark.createDataFrame(list(before.values()))
    judged = langid.identified(rows, langid.fit(rows, F.lit(True))).collect()
    assert after.keys() == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= P.LEAST_LANGUAGE_SCORE}
    before, after = kept["line_dedup"]
    assert {k: r.text for k, r in after.items()} == brute_lines([(k, r.text) for k, r in before.items()]) and all(r.n_chars == len(r.text) for r in after.values())
    before, after = kept["simhash_near_dedup"]
    ids, sets = sorted(before), []
    for k in ids:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in before[k].text))
        sets.append({tuple(words[j : j + 5]) for j in range(len(words) - 4)} or {tuple(words)})
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = local_roots(len(ids), *(np.array(x, int) for x in (zip(*pairs, strict=True) if pairs else ([], []))))
    assert after.keys() == {k for k, r in zip(ids, root.tolist(), strict=True) if ids[r] == k}
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count() == len(after)
    whole = P.run(spark, SF)
    assert whole.agg(F.sum("length"), F.count_distinct("sequence_id")).first() == packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(None, first.text, None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "word " * 30_000, "en", "s", 1), (first.doc_id, first.text, first.lang, first.source, first.n_chars)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clash = {c: F.lit("x") for c in ("kept", "score", "lang_pred", "n_lines", "keys", "key", "component_id", "length", "piece", "ids", "good", "_keys")}
    rows = rows.withColumns(clash)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert tuple(out.columns) == P.COLUMNS and out.count() > 0
        if name == "simhash_near_dedup":  # null ids stay; repeated rows of a document that stays stay
            assert out.where("doc_id is null").count() == 1
    assert P.STAGES[-1][1](spark, rows, SF).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import duckdb

    for view in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    ours, theirs = queries()[name](spark, SF).toPandas(), duckdb.sql(oracle_sql()[name]).df()
    key = sorted(ours.columns)
    assert sorted(map(tuple, ours[key].to_numpy().tolist()), key=str) == sorted(map(tuple, theirs[key].to_numpy().tolist()), key=str)
