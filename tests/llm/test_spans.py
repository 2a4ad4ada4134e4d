"""Operators 11 to 13 against plain Python, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import bisect
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lithos.llm import op3_repair, op10_toxicity, op11_substrings, op12_merkle, op13_alignment
from lithos.llm.wordhash import blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, n long, pair long"


def order(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=order)


def docs_of(spark, rows, parts=5):
    """Texts with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", 2, 3) for d, t in rows], DOCS).repartition(parts)


# operator 11


def repeats(rows, k=13):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - k + 1 if d is not None else 0):
            x = tuple(w[i : i + k])
            least[x] = min(least.get(x, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1 if d is not None else 0):
            if least[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=order)


def passages(seed):
    """Documents of passages that start and end anywhere, with changed words, runs of one or two words, and ties."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocab, k=80) for _ in range(12)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.6:
                x = rng.randint(0, 60)
                part = list(rng.choice(base))[x : x + rng.randint(5, 80)]
                if part and rng.random() < 0.3:
                    part[rng.randrange(len(part))] = "changed"
                w += part
            else:
                w += rng.choices(vocab, k=rng.randint(1, 30))
        if rng.random() < 0.1:
            w = rng.choice([["a"], ["a", "b"]]) * rng.randint(1, 40)
        rows.append((rng.choice([i, i, i, 7, None, -i]), rng.choice([" ", "\n", "\t "]).join(w)))
    same = " ".join("q w e r t y u i o p a s d f g".split())
    long = " ".join(rng.choices(vocab, k=20_000))
    return rows + rows[:5] + [(500, None), (501, ""), (502, " \n"), (503, long), (504, "x " + long)] + [(i, same) for i in range(600, 700)]


@pytest.mark.parametrize("bits", [(64, 64, 64), (5, 64, 64)])
def test_repeated_spans(spark, bits):
    """With 5 bits the first attempt confuses words; the sources' words show it and the second attempt is taken."""
    rows = passages(3)
    got = op11_substrings.remove_repeats(docs_of(spark, rows), bits=bits)
    assert rows_of(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == repeats(rows)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_collisions_are_never_returned(spark):
    with pytest.raises(RuntimeError, match="differ"):
        op11_substrings.remove_repeats(docs_of(spark, passages(4)), bits=(3, 3, 3))


def test_repeated_spans_of_nothing(spark):
    assert op11_substrings.remove_repeats(docs_of(spark, [], 1)).collect() == []


def test_spans_are_compact(spark):
    """A passage that many documents hold is a few spans of each, with the coordinates of a smaller document."""
    rng = random.Random(5)
    own = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{own()} {passage} {own()}") for i in range(40)]
    docs = op11_substrings.named(docs_of(spark, rows))
    shared = op11_substrings.shared_anchors(docs, 13, 6, "seed", 64)
    found = op11_substrings.links(docs, shared, 13, 6, "seed", 64).cache()
    spans = op11_substrings.spans(found, op11_substrings.sources(found)).collect()
    covered = defaultdict(int)
    for s in spans:
        assert s["source"] < s["doc_id"] and s["start"] == s["source_start"]
        covered[s["doc_id"]] += s["n"]
    assert covered == {i: 48 for i in range(1, 40)}
    assert sum(s["n"] >= 30 for s in spans) == 39 and len(spans) < 39 * 24


# operator 12


def merkle(rows):
    """By recursion over whole lists; rows are doc_id, source, lang, n_chars, text."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(enc, r)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(lv, i):
        out = []
        for nodes in lv[:-1]:
            j = i - i % 3
            out.append((nodes[j:i], nodes[i + 1 : j + 3]))
            i //= 3
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            proof = path(trees[s], i) + path(top, k)
            changed = r[:4] + (r[4].replace("\n", ""),) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
            acc = leaf(changed)
            for a, b in proof:
                acc = sha("".join(a) + acc + "".join(b))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in proof)), acc, acc == top[-1][0]))
    return sorted(out, key=order)


def merkle_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS i", "2 AS n", "'x' AS tree", "'y' AS digest").repartition(6)
    return rows_of(op12_merkle.verified(*op12_merkle.manifest(docs)), ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def test_merkle(spark):
    rng = random.Random(1)
    text = lambda: rng.choice([None, "", "a\nb", "é\n", "x", "line\n" * rng.randint(1, 9)])
    rows = [(rng.choice([i, None, i % 7]), rng.choice([None, "", "a", "b", "é", "hot", "hot", "hot", "hot"]), rng.choice([None, "en"]), rng.choice([None, i]), text()) for i in range(300)]
    rows += rows[:4] + [(1, "alone", "en", 1, "one\nrow"), (2, "two", None, None, "x" * 200_000), (3, "two", "de", 2, "\n")]
    got = merkle_rows(spark, rows)
    assert got == merkle(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82])
def test_merkle_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"t\n{i}") for i in range(n)]
    assert merkle_rows(spark, rows) == merkle(rows)


def test_merkle_of_many_sources_and_none(spark):
    rows = [(i, f"s{i:03d}", "en", 1, "t") for i in range(40)]
    assert merkle_rows(spark, rows) == merkle(rows)
    assert merkle_rows(spark, []) == []


def test_merkle_stores_every_third_level(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "t") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    sources, top = op12_merkle.manifest(docs)
    assert [x.count() for x in sources.levels] == [100, 4, 1] and [x.count() for x in top.levels] == [1]


# operator 13


def aligned(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    alphabet = op13_alignment.byte_alphabet()
    piece = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, parts):
        end = np.cumsum([0, *map(len, parts)]).tolist()
        return list(zip(ids, end[:-1], end[1:]))

    found, count = [], Counter()
    for d, t in rows:
        a, b = a_model.encode(f" {t}", add_special_tokens=False).ids if t else [], b_model.encode(t) if t else []
        at, bt = [bytes(alphabet[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not t or not b"".join(at) == b"".join(bt) == f" {t}".encode():
            found.append((d, None))
            continue
        sides, groups = (spans(a, at), spans(b, bt)), (defaultdict(list), defaultdict(list))
        cuts = sorted({x[2] for x in sides[0]} & {x[2] for x in sides[1]})
        for side, group in zip(sides, groups):
            for x in side:
                group[bisect.bisect_left(cuts, x[2])].append(x)
        text = ";".join("|".join(",".join(str(x[0]) for x in g[k]) for g in groups) for k in range(len(cuts)))
        links = [(x[0], y[0]) for k in range(len(cuts)) for x in groups[0][k] for y in groups[1][k] if x[1] < y[2] and y[1] < x[2]]
        count.update(set(links))
        found.append((d, (len(a), len(b), len(cuts), links, text)))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d, x in found:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, x[0], x[1], x[2], len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest()))
    return sorted(out, key=order)


def odd_texts():
    rng = random.Random(2)
    bits = [*"ab  \n\t.,'1", "é", "　", " ", "日", "\U0001f642", " x", " the", " don't", "▁", "<|endoftext|>", "</s>", "<0x41>", "\x00", "​", "\x1c"]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice([1, 3, 10, 200])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " "), (902, "x " * 2000), (None, "日本" * 600), (903, "  "), (904, "a" * 4000), (905, "lo ng " * 9000), (905, "lo ng " * 9000)]
    return rows


@pytest.mark.parametrize(("chunk_bytes", "fan"), [(32_768, 8), (50, 2), (7, 3)])
def test_alignment(spark, chunk_bytes, fan):
    rows = odd_texts()
    got = op13_alignment.aligned(docs_of(spark, rows), op13_alignment.vocabularies(), 2000, chunk_bytes, fan)
    assert rows_of(got, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]) == aligned(rows)


def test_alignment_of_nothing(spark):
    assert op13_alignment.aligned(docs_of(spark, [], 1), op13_alignment.vocabularies()).collect() == []


def test_fragments_are_a_monoid():
    """Composing in any order gives the same, with the empty fragment as identity."""
    both = op13_alignment.tokenizers(op13_alignment.vocabularies())
    same = lambda x, y: op13_alignment.to_bytes(x) == op13_alignment.to_bytes(y)
    text = "unverbesserliche Tokenisierung, naïve cafés 日本語 und 1234567 mehr " * 3
    for size in (1, 2, 5, 30):
        parts = [f for _, _, f in op13_alignment.chunks(text, both, size)]
        left = op13_alignment.open_fragment()
        for f in parts:
            left = op13_alignment.compose(left, f, both)
        right = op13_alignment.open_fragment()
        for f in reversed(parts):
            right = op13_alignment.compose(f, right, both)
        assert same(left, right)
        for x, y, z in zip(parts, parts[1:], parts[2:]):
            c = op13_alignment.compose
            assert same(c(c(x, y, both), z, both), c(x, c(y, z, both), both))


@pytest.mark.parametrize("op", [op11_substrings, op12_merkle])
def test_oracle_of_spans(spark, op):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    theirs = con.sql(op.SQL)
    assert rows_of(op.query(spark, "/root/testdata/sf0.001"), theirs.columns) == sorted(theirs.fetchall(), key=order)


# shared parts and earlier operators


def test_blocks_are_bounded():
    """Texts of 20,000 words stand in blocks of their own, short ones together; nulls and empty texts count as one byte."""
    texts = ["w " * 20_000, "a b", None, "", "c " * 20_000, "d"] * 3
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = list(blocks(iter([batch]), 30_000))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") + 1 for t in b.column("text").to_pylist()) <= 30_000 for b in got)
    assert max(b.num_rows for b in got) == 3 and list(blocks(iter([batch.slice(0, 0)]), 10)) == []


def test_convolution_equals_loops():
    """Logits of texts of any length, also below a filter's width, against plain loops over words and filters."""
    rng = np.random.default_rng(1)
    model = op10_toxicity.Classifier()
    model.bias = rng.normal(0, 0.3, len(model.bias)).astype(np.float32)
    texts = ["one", "one two", "one two three one four five six", " ".join(f"w{i % 37}" for i in range(500)), "six five"]
    got = model.logits(pa.array(texts))
    for text, logit in zip(texts, got):
        rows, codes, offsets = op10_toxicity._words(pa.array([text]))
        vectors = [model.table[rows[c]].sum(0) for c in codes[offsets[0] : offsets[1]]]
        pooled = []
        for f in model.filters:
            at = [sum(vectors[p + j] @ f[j] for j in range(len(f)) if p + j < len(vectors)) for p in range(len(vectors))]
            pooled.append(at)
        values = np.concatenate([np.array(x) for x in pooled], 1) + model.bias
        assert logit == pytest.approx(float(np.maximum(values, 0).max(0) @ model.out + model.base), abs=1e-4)


def test_repair_refuses_a_large_vocabulary():
    with pytest.raises(ValueError, match="16 bits"):
        op3_repair.pack([1], np.array([2]), np.array([5, 1], np.uint32), 70_000)


def test_alignment_encodes_a_slice_of_units_at_a_time(monkeypatch):
    """The ids are those of all units at once, and no tokenizer holds more than a slice."""
    both = op13_alignment.tokenizers(op13_alignment.vocabularies())
    units, most, one = ["wort", "ein satz", "", "ü" * 40, "a▁b"] * 20, [], both._encode
    whole = one(units)
    monkeypatch.setattr(both, "_encode", lambda u: most.append(len(u)) or one(u))
    sliced = both.encode(units, at_once=7)
    assert max(most) == 7 and sum(most) == len(units)
    for name in ("a", "a_at", "b", "b_at", "good"):
        assert (getattr(whole, name) == getattr(sliced, name)).all()
    assert both.encode([]).a_at.tolist() == [0]


def test_repair_encodes_a_stem_once_for_all_punctuation():
    """Ids as of each word alone; a word before different marks is encoded once."""
    from tokenizers import Tokenizer

    tok, asked = Tokenizer.from_str(op3_repair.vocabulary()), []
    words = ["haus", "haus.", "haus,", "Haus!?", "straße;", "İ.", "x'.", "'s.", "...", "1.", "a\x01b.", "\x01", "", "ΣΑΣ.", "a.b."]

    class Counting:
        def encode(self, *a, **k):
            return tok.encode(*a, **k)

        def encode_batch_fast(self, texts, **k):
            asked.extend(texts)
            return tok.encode_batch_fast(texts, **k)

    plain = [x for x in words if "\x01" not in x]
    for some in (words, plain):
        asked.clear()
        got = op3_repair.WordCache()(some, Counting())
        assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [tok.encode(x, add_special_tokens=False).ids for x in some]
    assert len(asked) == 1 and asked[0].count("haus") == 1


def test_repair_gives_words_of_letters_to_the_model():
    """Only other words go through the whole tokenizer; all ids are those of each word alone, also with another vocabulary."""
    import json

    from tokenizers import Tokenizer

    text = op3_repair.vocabulary()
    tok, asked = Tokenizer.from_str(text), []

    class Counting:
        model, pre_tokenizer, encode = tok.model, tok.pre_tokenizer, tok.encode

        def encode_batch_fast(self, texts, **k):
            asked.extend(texts)
            return tok.encode_batch_fast(texts, **k)

    words = ["Haus", "haus", "HAUS***", "straße,", "STRASSE", "ÉÀÿÞ&&&", "niño|||", "x<<<", "µm", "aªb", "ẞ", "h\u0331", "H\u0331", "e\u0301", "ŉ.", "a1", "it's", "'s", "a#b#",
             "<|endoftext|>", "ab<|endoftext|>.", "<|endoftext|", "..", "", "\x00a", "ΣΑΣ$", "Ⅷ", "a\u0300,", "q" * 3000]
    got = op3_repair.WordCache()(words, Counting())
    alone = lambda t: [t.encode(x, add_special_tokens=False).ids for x in words]
    read = lambda got: [np.frombuffer(x, np.uint32).tolist() for x in got]
    assert read(got) == alone(tok)
    sent = set(" ".join(asked).split())
    assert sent and not sent & {"Haus", "haus", "straße", "niño", "x", "q" * 3000}
    # a tokenizer that puts a mark before words or keeps capitals apart is asked as a whole, and a cache does not mix two
    cache, other = op3_repair.WordCache(), json.loads(text)
    other["normalizer"] = None
    cased = Tokenizer.from_str(json.dumps(other))
    assert op3_repair.letter_table(tok) and op3_repair.letter_table(cased) is None
    cache(["Haus"], tok)
    assert read(cache(["Haus"], cased)) == [cased.encode("Haus", add_special_tokens=False).ids]
    assert op3_repair.tokenizer_of(text) is op3_repair.tokenizer_of(text)


def test_repair_packs_a_shard_of_one_empty_text():
    """A shard of a lone end id has no pairs at all."""
    for ids in ([1], [7, 1]):
        shard = op3_repair.Shard(op3_repair.pack([3], np.array([len(ids)]), np.array(ids, np.uint32), 100)[0])
        assert shard.doc_ids == [3] and shard.decode(0).tolist() == ids
