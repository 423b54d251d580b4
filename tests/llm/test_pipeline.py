import re

import corpus_pipeline as cp
from brindle.llm.quality import quality_rules
from test_decontaminate import brute as leaks
from test_near_dedup import brute as classes


def test_run_equals_brute_force(spark, sf_dir, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    kept = {r.doc_id for r in quality_rules(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.kept}
    rows = [r for r in rows if r[0] in kept]
    rows = [r for i, (r, c) in enumerate(zip(rows, classes(rows), strict=True)) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not leaks(r[1], items)]
    got = cp.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    total = sum(fill.values())
    assert max(fill.values()) <= 4096 and len(fill) <= 1.02 * total / 4096 + 1


def test_personal_data_is_replaced(spark, sf_dir, documents):
    out = cp.pii(spark, documents, sf_dir)
    assert out.columns == documents.columns
    texts = [r.text for r in out.collect()]
    assert not any(re.search(r"[\w.+-]+@[\w-]+\.[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}", t) for t in texts)
    assert any("[EMAIL]" in t for t in texts) and len(texts) == documents.count()
