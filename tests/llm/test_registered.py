"""The registered queries, and the pipeline's stages, over a whole small table."""

import hashlib

import pytest

import corpus_pipeline
from tessavec.llm import ngram_join, secrets, toxicity, urlfilter
from tessavec.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import secret_spans
from tests.oracle import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_sql(ORACLE_SQL[name], SF)


def test_secret_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_secret_scan"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        spans = secret_spans(text[r.doc_id] or "")
        base = [x for x in spans if x[1] < 3]
        said = lambda xs: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in xs)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest() and r.spans == said(spans)


def test_url_rules(spark):
    names, want = rows_of_sql(urlfilter.RULES_SQL, "/root/testdata/sf0.01")
    assert names == ["host", "page_id", "path", "rule", "rule_verdict"]
    got = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(want)
    for host, page, path, rule, verdict in want:
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and r.verdict == (verdict or r.verdict)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op7_toxicity"](spark, SF).where("toxic").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    last: dict = {}
    for i, t in left.items():
        last[t.encode().lower()] = max(i, last.get(t.encode().lower(), -1))
    kept = [(i, left[i]) for i in last.values()]
    want = {i for i, (_, c) in ngram_join.brute_force(kept).items() if i == c}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns, name
    assert not [r for r in secrets.scan_secrets(step).collect() if r.secret_spans]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_severity(docs, labels.where("doc_id % 2 = 0"))
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1").select("doc_id", labels.toxic.alias("said")), "doc_id").collect()
    hits = sum(r.toxic and r.said for r in found)
    assert hits >= 0.94 * sum(r.said for r in found)
    assert sum(r.toxic and not r.said for r in found) <= 0.005 * len(found)
