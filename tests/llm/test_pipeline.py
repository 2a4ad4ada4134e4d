"""The pipeline against its rules, stage by stage, and run() against brute force."""

import duckdb
import numpy as np

import corpus_pipeline
from lithos.llm import op5_mixing, op8_quality
from lithos.llm.op6_minhash import similar
from lithos.llm.shared import stored, table
from lithos.llm.wordhash import closest_within

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [" ".join(r.text.lower().split()) for r in table(spark, DIR, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DIR), f"test-{name}")
        rows = out.collect()
        assert set(columns) <= set(out.columns) and all(before[r.doc_id] == r.text for r in rows)
        if name != "shard":
            assert out.columns == columns
        if name in ("quality", "near_duplicates", "decontaminate"):
            assert len({r.doc_id for r in rows}) == len(rows)
        if name == "near_duplicates":
            assert len({r.text for r in rows}) == len(rows)
        if name == "decontaminate":
            assert not any(i in " ".join(r.text.lower().split()) for r in rows for i in items)
        if name == "mix":
            mixed = sorted(r.doc_id for r in rows)
        if name == "shard":
            assert sorted(r.doc_id for r in rows) == mixed
        docs = out
    assert corpus_pipeline.ORACLE_SQL is None


def brute_force():
    """doc_ids of run(): the SQL of the quality rules and of the mix, all pairs, and every item against every document."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT * FROM '{DIR}/documents.parquet'")
    kept = con.sql(f"SELECT doc_id FROM ({op8_quality.SQL}) WHERE kept").df()["doc_id"]  # noqa: S608
    docs = con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").df()
    docs = docs[docs["doc_id"].isin(kept)]
    ids, texts = docs["doc_id"].tolist(), docs["text"].fillna("").tolist()
    codes = {w: i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    words = [np.array([codes[w] for w in t.split()], np.uint32) for t in texts]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if find(i) != find(j) and similar(words[i], words[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    first = [i for i in range(len(ids)) if find(i) == i]
    clean = []
    items = [(t or "").lower().split() for (t,) in con.sql(f"SELECT text FROM '{DIR}/benchmark.parquet'").fetchall()]
    patterns = []
    for item in filter(None, items):
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        patterns.append((masks, len(item)))
    for i in first:
        text = texts[i].lower().split()
        if not any(closest_within(masks, n, text)[0] <= int(0.2 * n + 1e-9) for masks, n in patterns):
            clean.append(ids[i])
    con.sql(f"DELETE FROM documents WHERE doc_id NOT IN ({','.join(map(str, clean))})")  # noqa: S608
    taken = con.sql(op5_mixing.SQL).df()
    return sorted(d for d, size, n in taken[["doc_id", "size", "taken"]].itertuples(index=False) if n for _ in range(-(-n // size)))


def test_run_against_brute_force(spark):
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).select("doc_id").collect())
    want = brute_force()
    assert len(want) > 50 and got == want
