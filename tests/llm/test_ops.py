"""Each operator on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; and against
brute force, round trips or SQL."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithos.llm import files, op1_sharding, op2_licences, op3_repair, op4_lines, op5_mixing, op6_minhash, op7_warc, op8_quality, op9_decontaminate, op10_toxicity, registry
from lithos.llm.shared import shared_dir
from lithos.llm.wordhash import banded_distance

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, path string, key string"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(800)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = "\n".join(prose(40, 100 + i) for i in range(200))
ODD = [
    (1, "Same line\n" + prose(60, 1), "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, LONG, "en", "b"),
    (5, prose(60, 5), "en", "b"),
    (5, prose(60, 5), "en", "b"),
    (None, "  \n\t", "de", "a"),
    (None, prose(60, 7), None, "c"),
    (8, "one two", "fr", ""),
    (9, "Licensed under CC BY-NC 4.0.\nidiot", "xx", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, 99, "clash", "k") for r in ODD], SCHEMA)


def table_sql(spark, name):
    con = duckdb.connect()
    for t in "documents benchmark labels pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    ours, theirs = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(theirs.columns)
    assert set(cols) <= set(ours.columns) and plain(ours, cols) == plain(theirs, cols)


def plain(frame, cols):
    """The rows of a frame as sorted texts; nulls of any kind and numbers of any type are the same."""

    def cell(v):
        if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    table_sql(spark, name)


def empty(odd):
    return odd.where("false")


def test_sharding(spark, odd):
    store = op1_sharding.ShardStore(spark, shared_dir(spark, "t"), target_bytes=1 << 20)
    assert store.compact() == 0
    for _ in range(4):
        store.append(odd)
    assert store.versions() == [1, 2, 3, 4] and store.manifest(2).count() <= store.manifest().count()
    assert store.compact() == 5
    assert store.read().count() == 40 and store.read(1).count() == 10 and store.read().columns == odd.columns
    assert sorted(map(str, store.read().select("text").collect())) == sorted(map(str, odd.select("text").collect() * 4))
    assert store.manifest(5).count() < store.manifest(4).count() and store.compact() == 5
    with pytest.raises(op1_sharding.VersionConflict):
        store._commit(store.manifest(), store.schema(), 5)
    assert store.versions() == [1, 2, 3, 4, 5]
    store.append(empty(odd))
    assert store.read().count() == 40
    store.append(odd.withColumn("late", F.lit(1)))
    assert store.read().count() == 50 and store.read().where("late IS NULL").count() == 40 and "late" not in store.read(5).columns
    assert op1_sharding.shard(empty(odd), shared_dir(spark, "t")).count() == 0


CLASHES = "row path group part arrival merged shard shard_rows shard_bytes carried_row matches taken tie key block node class many order hash _id _node doc_id_ _class _copy".split()


def clashing(df):
    """df with every name that the operators use inside as a further column."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns])


def test_sharding_plan_and_arrivals(spark):
    r = random.Random(3)
    sizes = [(f"p{i:03d}", r.choice([0, r.randint(1, 90), r.randint(100, 500), r.randint(900, 1500)]), 1) for i in range(120)]
    store = op1_sharding.ShardStore(spark, shared_dir(spark, "t"), target_bytes=1000)
    got = {x.path: x.group for x in store.plan(spark.createDataFrame(sizes, op1_sharding.MANIFEST)).collect()}
    tiers = {}
    for path, size, _ in sizes:
        tier = 0 if size < 1 else int(np.floor(np.log(float(size)) / np.log(4.0)))
        if size < 1000:
            tiers.setdefault(tier, []).append((path, size))
    want, n = {}, -1
    for tier in sorted(t for t, x in tiers.items() if len(x) >= 4):
        before, pack = 0, -1
        for path, size in sorted(tiers[tier]):
            if before // 1000 != pack:
                pack, n = before // 1000, n + 1
            want[path] = n
            before += size
    assert got == want
    docs = spark.createDataFrame([(i, prose(20, i)) for i in range(200)], "doc_id long, text string")
    versions = store.append(docs, op1_sharding.arrival(F.col("doc_id"), 5))
    assert versions == [1, 2, 3, 4, 5]
    for v in versions:
        batch = {x.doc_id for x in store.read(v).collect()} - ({x.doc_id for x in store.read(v - 1).collect()} if v > 1 else set())
        assert batch == {x.doc_id for x in docs.where(op1_sharding.arrival(F.col("doc_id"), 5) == v - 1).collect()}
    assert store.compact() in (5, 6) and sorted(x.doc_id for x in store.read().collect()) == list(range(200))


def test_sharding_without_text(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "doc_id long, value string")
    out = op1_sharding.shard(rows, shared_dir(spark, "t"), 300)
    assert out.count() == 50 and out.agg(F.min("shard_bytes")).first()[0] > 0


@pytest.mark.parametrize("stage", ["quality", "near", "clean", "mix", "shard"])
def test_stages_by_row(spark, odd, stage):
    """Repeated and null ids are judged row by row, and no name of a column clashes."""
    good, junk = prose(80, 1), "a a a a"
    rows = [(1, good, "en", "a"), (1, junk, "en", "a"), (None, good + " end", "en", "a"), (None, junk, None, None), (2, "", "en", "b"), (None, None, "de", "b")]
    docs = clashing(spark.createDataFrame([(*x, 7, 99, "clash", "k") for x in rows], SCHEMA))
    items = spark.createDataFrame([(1, good)], "item_id long, text string")
    run = {
        "quality": op8_quality.kept_documents,
        "near": op6_minhash.first_documents,
        "clean": lambda d: op9_decontaminate.clean_documents(d, items),
        "mix": op5_mixing.mixed_documents,
        "shard": lambda d: op1_sharding.shard(d, shared_dir(spark, "t")),
    }[stage]
    out = run(docs)
    texts = sorted((x.text or "" for x in out.collect()))
    if stage == "shard":
        assert out.columns == [*docs.columns, "shard_", "shard_bytes_", "shard_rows_"]
    else:
        assert out.columns == docs.columns
    want = {
        "quality": [good, good + " end"],
        "near": sorted([good, junk, ""]),
        "clean": sorted([junk, junk, "", ""]),
        "shard": sorted(x[1] or "" for x in rows),
    }
    if stage in want:
        assert texts == want[stage]
    else:
        target = {x.source: x.target for x in op5_mixing.mix(docs).collect()}
        words = sum(len(t.split()) for t in texts)
        assert abs(words - sum(target.values())) <= 81 and "" not in texts
    assert run(docs.where("false")).count() == 0


def test_decontamination_against_brute_force(spark):
    """A document is contaminated exactly if some part of it is within a fifth of an item's words."""
    r = random.Random(12)
    items = [(i, prose(r.randint(8, 40), 8000 + i)) for i in range(15)]
    docs = []
    for i in range(60):
        w = items[i % 15][1].split()
        for _ in range(r.choice([0, len(w) // 10, len(w) // 5, len(w) // 4 + 1, len(w) // 2])):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([[], [r.choice(VOCAB)], [w[p], r.choice(VOCAB)]])
        docs.append((i, prose(r.randint(0, 60), 8100 + i) + " " + " ".join(w) + " " + prose(r.randint(0, 60), 8200 + i)))

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    want = {(d, i): least(t.split(), x.split()) for d, x in docs for i, t in items}
    want = {(d, i): n for (d, i), n in want.items() if n <= int(0.2 * len(items[i][1].split()) + 1e-9)}
    got = op9_decontaminate.with_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, m.item_id): m.distance for x in got.collect() for m in x.matches}
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items()) and len(got) >= 0.95 * len(want) and len(want) >= 30


def test_licences(spark, odd):
    got = {(r.file_id, r.path): r for r in op2_licences.scan(op2_licences.as_files(odd)).collect()}
    assert got[9, "a/9"].own_licence == "CC-BY-NC-4.0" and got[1, "a/1"].licence == "CC-BY-NC-4.0" and got[1, "a/1"].inherited_from == "a"
    assert got[4, "b/4"].licence is None
    files = spark.createDataFrame([(1, None, "Released under the MIT License."), (2, "x/LICENSE", "Released under the MIT License."), (3, "x/y/z.c", ""), (4, "w/z.c", None)], "file_id long, path string, text string")
    got = {r.file_id: (r.own_licence, r.licence, r.inherited_from) for r in op2_licences.scan(files).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: ("MIT", "MIT", None), 3: (None, "MIT", "x"), 4: (None, None, None)}
    mit, gpl = op2_licences.TEMPLATES["MIT"][1], op2_licences.TEMPLATES["GPL-3.0"]
    wrap = lambda t, n: "\n".join(" * " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = ["MIT License\n\nCopyright (c) 2020 Someone Else\n\n" + wrap(mit, 11), "#!/bin/sh\n" + wrap(gpl[2], 9) + "\n\n" + prose(200, 1), "This work is licensed under\nthe GNU General Public License,\nversion 3.\n" + prose(90, 2), prose(30, 3) + " Copyright 2019 A Person. Released under the MIT License. All else follows. " + prose(30, 4), prose(300, 5)]
    got = op2_licences.scan(spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "file_id long, path string, text string")).orderBy("file_id").collect()
    assert [r.own_licence for r in got] == ["MIT", "GPL-3.0", "GPL-3.0", "MIT", None]
    # one line of 100,000 words, and 20,000 lines of template words, take time with their length
    slow = [(0, "a/x", prose(50_000, 1) + ". Released under the MIT License. " + prose(50_000, 2)), (1, "b/x", "software license\n" * 20_000)]
    start = time.monotonic()
    got = op2_licences.scan(spark.createDataFrame(slow, "file_id long, path string, text string")).orderBy("file_id").collect()
    assert [r.own_licence for r in got] == ["MIT", None] and time.monotonic() - start < 60
    assert op2_licences.scan(files, {}).where("licence IS NOT NULL").count() == 0 and op2_licences.scan(files.where("false")).count() == 0


def test_repair_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(op3_repair.vocabulary())
    shards = op3_repair.write_shards(odd, shared_dir(spark, "t"), op3_repair.vocabulary(), shard_tokens=500)
    got = op3_repair.read_shards(shards).orderBy("start").collect()
    assert len(got) == len(ODD) and [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 8, 9]
    at = 0
    want = sorted((i if i is not None else -1, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t, *_ in ODD)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert op3_repair.read_shards(op3_repair.write_shards(empty(odd), shared_dir(spark, "t"), op3_repair.vocabulary())).count() == 0


def test_repair_random_access():
    ids = np.random.default_rng(1).integers(0, 6, 5000).astype(np.uint32)
    ends = np.append(np.sort(np.random.default_rng(2).choice(np.arange(10, 4990), 9, replace=False)), 5000)
    counts = np.diff(np.concatenate(([0], ends)))
    ids[ends - 1] = 1
    data, symbols = op3_repair.pack(list(range(10)), counts, ids, 100)
    shard = op3_repair.Shard(data)
    assert symbols < 5000
    for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
        assert (shard.decode(k) == ids[a:b]).all() and (shard.decode(k, 3, 8) == ids[a + 3 : min(a + 8, b)]).all()


def test_perfect_hash():
    r = np.random.default_rng(3)
    a, b = (r.integers(0, 2**63, 5000).astype(np.uint64) for _ in "ab")
    ph = op4_lines.PerfectHash.build(a, b)
    assert sorted(ph(a, b)) == list(range(5000))
    assert (op4_lines.PerfectHash.from_bytes(*ph.to_bytes())(a, b) == ph(a, b)).all()


def test_lines_odd(odd):
    got = op4_lines.dedup_lines(odd, min_docs=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(ODD) and by[2][0].n_lines == 1 and by[3][0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_dropped for r in by[5]] == [1, 1] and by[4][0].n_dropped == 0
    assert op4_lines.dedup_lines(empty(odd)).count() == 0


def test_mixing_odd(odd):
    got = op5_mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= 1 for t, target in by.values())
    assert op5_mixing.mix(empty(odd)).count() == 0
    rows = op5_mixing.mixed_documents(odd)
    assert rows.columns == odd.columns


def similar(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return bool(a) and bool(b) and banded_distance(a, b, most) <= most


def test_minhash_against_brute_force(spark):
    r = random.Random(8)
    texts = []
    for i in range(40):
        base = prose(r.randint(30, 120), 900 + i).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            w = base[:]
            for _ in range(max(1, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [prose(30, 1) + " " + texts[5], None, "", " ", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in op6_minhash.near_duplicates(df).collect()}
    words = [(t or "").split() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similar(words[i], words[j]):
                parent[find(i)] = find(j)
    first = {}
    for i in range(len(texts)):
        first.setdefault(find(i), i)
    assert got == {i: first[find(i)] for i in range(len(texts))}


def minhash_classes(spark, texts):
    """doc_id -> class_id by the operator and by brute force over all pairs."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in op6_minhash.near_duplicates(df).collect()}
    words, parent = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and op6_minhash.similar(words[i], words[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return got, {i: find(i) for i in range(len(texts))}


def edited(words, n, r):
    w = words[:]
    for i in r.sample(range(len(w)), n):
        w[i] = "".join(r.choice("klmnop") for _ in range(8))
    return " ".join(w)


def test_minhash_family_of_far_copies(spark):
    r, base = random.Random(1), prose(150, 4000).split()
    got, want = minhash_classes(spark, [" ".join(base)] + [edited(base, 18, r) for _ in range(250)])
    assert set(want.values()) == {0} and got == want


def test_minhash_shared_passage(spark):
    r, passage, texts = random.Random(2), prose(117, 4100).split(), []
    for i in range(150):
        base = passage + prose(33, 4200 + i).split()
        texts += [" ".join(base), edited(base, 12, r)]
    got, want = minhash_classes(spark, texts)
    assert len(set(want.values())) >= 100 and got == want


@pytest.mark.parametrize(("n", "edits"), [(10, 1), (10, 2), (20, 4), (40, 8), (150, 30), (150, 24)])
def test_minhash_recall_of_sketches(n, edits):
    r, hit = random.Random(n + edits), 0
    for i in range(200):
        base = prose(n, 5000 + i)
        words, offsets = op6_minhash.word_hashes(pa.array([base, edited(base.split(), edits, r)]))
        keys, upto = op6_minhash.all_sketches(words, offsets)
        hit += bool(set(keys[: upto[1]].tolist()) & set(keys[upto[1] :].tolist()))
    assert hit >= 190


def test_minhash_odd(odd):
    got = op6_minhash.near_duplicates(odd)
    assert got.count() == len(ODD) and got.where("doc_id = 5 AND class_size = 2").count() == 2 and got.where("doc_id = 2 AND class_id = 2 AND class_size = 2").count() == 1
    kept = op6_minhash.first_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 3").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert op6_minhash.near_duplicates(empty(odd)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 3, 9])
def test_banded_distance(k):
    r = random.Random(k)
    for _ in range(300):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        b = [x for x in a if r.random() > 0.2] + [r.randint(0, 3)] * r.randint(0, 2)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert banded_distance(a, b, k) == min(row[-1], k + 1)


def test_warc(spark):
    big = prose(3000, 4)
    rows = [(3, "http://a/\r\nx", "<p>é"), (1, "http://b", "<p>é"), (2, None, None), (4, "u", ""), (None, "n", "<p>é"), (9, "b", big), (9, "b", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    chunks = op7_warc.chunked(op7_warc.with_roles(pages), 1000)
    archives = op7_warc.write_archives(chunks, shared_dir(spark, "t"), 2000).checkpoint()
    heads = b"".join(gzip.decompress(files.read_whole(r.path)) for r in archives.collect()).decode()
    ids = re.findall("WARC-Record-ID: (.*)\r", heads)
    assert len(ids) == len(rows) == len(set(ids)) and heads.count("WARC-Refers-To-Target-URI: http://b\r") == 2
    table = op7_warc.read_archives(archives, chunk_bytes=1000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table.where("last").collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(3, 5, digest("<p>é"), "revisit", 1), (1, 5, digest("<p>é"), "response", None), (2, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 2), (None, 5, digest("<p>é"), "revisit", 1)] + [(9, len(big), digest(big), "response", None)] * 2
    assert got == sorted(want, key=str)
    body = b"".join(bytes(r.chunk) for r in sorted(table.where("page_id = 9").collect(), key=lambda r: r.chunk_no)[::2])
    assert body == big.encode() and table.where("page_id = 9").count() > 10
    assert op7_warc.write_archives(op7_warc.chunked(op7_warc.with_roles(pages.where("false"))), shared_dir(spark, "t")).count() == 0


def test_quality_odd(odd):
    got = {r.doc_id: r for r in op8_quality.judge(odd).collect()}
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept and got[4].n_words == 8000 and got[5].kept
    assert op8_quality.judge(empty(odd)).count() == 0
    assert op8_quality.kept_documents(odd).columns == odd.columns and op8_quality.kept_documents(odd).where("doc_id = 5").count() == 2


def test_decontamination(spark, odd):
    items = [(i, prose(n, 500 + i)) for i, n in enumerate([14, 20, 30, 45, 60] * 4)] + [(97, None), (98, ""), (None, prose(25, 77))]
    bench = op9_decontaminate.Benchmark([i for i, _ in items], [t for _, t in items])
    r, hits, n = random.Random(4), 0, 0
    for k, (_, text) in enumerate(items[:20] * 5):
        w = text.split()
        for _ in range(int(0.2 * len(w))):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([[], [r.choice(VOCAB)], [w[p], r.choice(VOCAB)]])
        doc = prose(50, 2000 + k) + " " + " ".join(w) + " " + prose(50, 3000 + k)
        found = {bench.ids[j] for j, _, _ in bench.search(pa.array([doc.upper()]))[0]}
        hits, n = hits + (k % 20 in found), n + 1
    assert hits / n >= 0.95
    assert not any(bench.search(pa.array([prose(300, 4000 + k) for k in range(20)])))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = odd.where("doc_id < 4").unionByName(odd.where("doc_id = 1").withColumn("text", F.lit("x " + items[2][1] + " " + items[-1][1])))
    got = op9_decontaminate.with_matches(docs, table, block_words=100)
    assert sorted(len(x.matches) for x in got.collect()) == [0, 0, 0, 2]
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # a worker, whatever the number of blocks
    many, one = ({(x.doc_id, x.text, *map(tuple, sorted(x.matches, key=str))) for x in op9_decontaminate.with_matches(docs, table, block_words=b).collect()} for b in (30, 10**6))
    assert many == one
    assert op9_decontaminate.clean_documents(docs, table).columns == docs.columns
    assert op9_decontaminate.clean_documents(docs, table.where("false")).count() == docs.count() and op9_decontaminate.clean_documents(empty(odd), table).count() == 0


def test_toxicity(spark, odd):
    r = random.Random(6)
    rows = [(i, (prose(r.randint(5, 80), 7000 + i) + (" wretch " if i % 4 == 0 else " ") + prose(5, 9000 + i)), ["en", None][i % 2], int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = op10_toxicity.train(docs, labels)
    got = {x.doc_id: x for x in op10_toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == rows[i][3] for i in held]) >= 0.95
    scored = op10_toxicity.score(odd, model)
    assert scored.count() == len(ODD) and scored.where("score BETWEEN 0 AND 1 AND predicted = int(score >= 0.5)").count() == len(ODD)
    assert op10_toxicity.score(empty(odd), model).count() == 0
    assert {x.score for x in op10_toxicity.score(odd, op10_toxicity.train(docs, labels.where("false"))).collect()} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that stands in one labelled row moves its own rows of the table, also with several learners."""
    n = 400
    docs = spark.createDataFrame([(k, f"einzelwort{k}x alle {'schlimm' if k % 2 else 'freundlich'} tage", "de") for k in range(n)], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id long, toxic int")
    model = op10_toxicity.train(docs, labels, learner_rows=100)
    fresh = op10_toxicity.Classifier()
    rows = {x.doc_id: (x.score, x.held_out) for x in op10_toxicity.score(docs, model).collect()}
    assert all((rows[k][0] >= 0.5) == bool(k % 2) for k in rows)
    assert (model.seen["table"] > fresh.seen["table"]).any(1).sum() > 100
    assert not hasattr(op10_toxicity, "SAMPLE_TOXIC")


def test_toxicity_moves_as_much_a_row_at_any_size(spark, odd, monkeypatch):
    """Few labels are joined as many are, without a broadcast, and changes of learners grow slower than the rows."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = op10_toxicity.labelled(odd, labels)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.toxic for r in rows.collect()) == sorted({1: 1, 2: 0}[d] for d, *_ in ODD if d in (1, 2) and zlib.crc32(str(d).encode()) % 5)
    assert op10_toxicity.learners(3_300) == 1 and op10_toxicity.learners(4_800_000) <= 8 * op10_toxicity.learners(80_000)
    docs = spark.createDataFrame([(k, f"wort{k} {'schlimm' if k % 2 else 'gut'}", "de") for k in range(400)], "doc_id long, text string, lang string").repartition(8)
    parts = []
    monkeypatch.setattr(op10_toxicity, "_round", lambda model, rows, weights, k: parts.append(rows.rdd.getNumPartitions()))
    op10_toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), learner_rows=100)
    assert set(parts) <= {1, 2}
