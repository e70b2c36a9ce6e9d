"""Quality, packing, LM scores, SimHash, BPE, nearest neighbours, and the pipeline."""

import hashlib
import math
import re
import tempfile
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tierspark.llm import ann, bpe, common, components, exact_dedup, lm_score, near, packing, pretoken, quality, queries, simhash

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["it's don't 'tis ''s \"'s they've we'll I'd  'm\n 're x 'll  ", "  a\n\nb \t c   ", "", " ", "12a  3!?  e\u0301 \u4e2d\u6587 <|endoftext|> x<|startoftext|>", "a'", "'", "''", "a're'", "\u00a0x\u3000y \U0001f600 z", "x" * 3000 + "y", "\u0130STANBUL \u03a3\u0391\u03a3 \u00df \ufb01 \u212b", "!" * 300, "\ud7a3\u1100\u1161", "\x1c\x85 a"]


def held(i, mod):
    return zlib.crc32(str(i).encode() if i is not None else b"") % mod == 1


# ---- quality


def test_quality_is_learnt(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == held(r.doc_id, 3) and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted == 0 for r in rows if r.quality == 0]) > 0.9
    assert np.mean([(r.score - r.quality) ** 2 for r in rows]) < 0.03  # calibrated


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.judge(none, labels).count() == 0
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.score(docs, quality.Classifier.fit([], np.zeros(0)).dump(), out="quality")
    assert kept.columns == [*docs.columns, "quality"]


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.is_fold(3), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.judge(docs, x).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_quality_is_what_its_definition_says():
    """Word vectors, pooling and score of a small corpus, worked out word by word."""
    texts = ["The cat sat, the DOG ran 12 times!", "", "cat cat", "Buy NOW now!!! 99", "a b c d e f g the cat"]
    labels = np.array([1, 0, 1, 0, 1])
    index = quality._index_vectors()

    def cut(t):
        got = pretoken.split_pattern([t], spaced=False)
        return [got.words[int(c)].as_py() for c in got.codes]

    form, kind = (lambda w: quality._row(w.lower())), (lambda w: quality._row(quality.shape(w)))
    vectors = np.zeros((quality.ROWS, quality.DIMS))
    for t in texts:
        words = cut(t)
        for i, w in enumerate(words):
            around = sum((index[form(x)] + index[kind(x)] for j, x in enumerate(words) if 0 < abs(i - j) <= quality.WINDOW), np.zeros(quality.DIMS))
            vectors[form(w)] += around
            vectors[kind(w)] += around
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(size, 1e-9)
    got, seen = quality.fit_vectors(texts)
    assert np.allclose(got, vectors, atol=1e-5) and (seen == (size[:, 0] > 0)).all()
    for t, row in zip(texts, quality.features(texts, got, seen), strict=True):
        words = cut(t)
        n = max(1, len(words))
        want = [*(sum((vectors[form(w)] for w in words), np.zeros(quality.DIMS)) / n), *(sum((vectors[kind(w)] for w in words), np.zeros(quality.DIMS)) / n)]
        want += [len(set(words)) / n, sum(not seen[form(w)] for w in words) / n, sum(map(len, words)) / n, math.log1p(len(words))]
        assert np.allclose(row, want, atol=1e-5)
    model = quality.Classifier.fit(texts, labels)
    a = model.arrays
    x = np.clip((quality.features(texts, a["vectors"].astype(np.float32), a["seen"]) - a["mean"]) / a["spread"], -8, 8)
    plain = [1 / (1 + math.exp(-(sum(math.tanh(x[i] @ a["w1"][:, h] + a["b1"][h]) * a["w2"][h] for h in range(quality.HIDDEN)) + a["b2"]) / a["temperature"])) for i in range(len(texts))]
    assert model.score(texts) == pytest.approx(plain, rel=1e-9)


# ---- tokenizers


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_pieces_are_the_librarys(path, spaced):
    tok = Tokenizer.from_file(path)
    texts = [t for t in ODD if "<|" not in t]
    if not spaced:
        texts = [tok.normalizer.normalize_str(t) for t in texts]
    got = pretoken.split_pattern(texts, spaced)
    for d, t in enumerate(texts):
        if got.sure[d]:
            want = [t[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(t)]
            assert [got.words[int(c)].as_py() for c in got.codes[got.first[d] : got.first[d + 1]]] == want


def test_words():
    texts = ["a  b\x0bc", "", " ", "x\u00a0y z", "\t"]
    got = pretoken.split_words(texts)
    for d, t in enumerate(texts):
        assert [got.words[int(c)].as_py() for c in got.codes[got.first[d] : got.first[d + 1]]] == re.findall(r"[^\x20\x09-\x0D]+", t)


def test_bpe_against_the_library(spark, docs, none):
    tok = Tokenizer.from_file(WORD)
    rows = [r.text or "" for r in docs.collect()] + ODD
    for text, (n, ids, shown) in zip(rows, bpe.model(WORD).encode(rows), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert shown == tok.decode(want, skip_special_tokens=False) == bpe.decode(want, WORD)
    got = bpe.encode_decode(docs, WORD, texts=True).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == Counter((r.doc_id, hashlib.sha256(" ".join(map(str, tok.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest()) for r in docs.collect())
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert bpe.encode_decode(none, WORD).count() == 0


def test_bpe_whole_table(spark):
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in queries.op10_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_segment_tree_is_the_plain_algorithm():
    m = bpe.model(WORD)
    ranks = {int(c): int(r) for c, r in zip(m.pairs, m.ranks, strict=True)}
    for word in ["hello", "mississippi", "aaaaaaaaaaa", "\u00e9t\u00e9", "x", "zzzzqq" * 9]:
        raw = word.encode()
        ids = [int(m.inner[b]) for b in raw[:-1]] + [int(m.last[raw[-1]])]
        while True:
            found = [(ranks[a * m.size + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a * m.size + b in ranks]
            if not found:
                break
            rank, i = min(found)
            ids[i : i + 2] = [int(m.made[rank])]
        assert m.encode_words([word])[0].tolist() == ids


# ---- packing


def check_packing(rows, texts, capacity=1024, ids=None):
    tok = Tokenizer.from_file(BYTE)
    want = Counter()
    whole = {}
    for i, t in zip(ids or [None] * len(texts), texts, strict=True):
        codes = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[codes.tobytes()] += 1
        first = len(codes) % capacity or capacity
        for k, start in enumerate([0, *range(first, len(codes), capacity)] if len(codes) > first else [0]):
            size = first if k == 0 else capacity
            whole.setdefault(i, Counter())[k, start, size, zlib.crc32(codes[start : start + size].tobytes())] += 1
    if ids:
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, Counter())[r.piece, r.start, r.length, r.ids_crc32] += 1
        assert by_doc == whole
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= capacity
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sum(len(k) // 4 * n for k, n in want.items()) == sum(r.length for r in rows)
    return len(sequences)


def test_packing(spark, docs, none):
    rows = packing.pack(docs, BYTE).collect()
    check_packing(rows, [r.text for r in docs.collect()], ids=[r.doc_id for r in docs.collect()])
    tok = Tokenizer.from_file(BYTE)
    long = next(r.text for r in docs.collect() if r.doc_id == 7)
    ids = np.array([*tok.encode(long, add_special_tokens=False).ids, 2], "<u4")
    for r in rows:
        if r.doc_id == 7:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 7)
    assert [p for p, _, _ in own] == list(range(-(-len(ids) // 1024))) and all(n == 1024 for _, _, n in own[1:])
    assert packing.pack(none, BYTE).count() == 0


def test_packing_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op4_packing(spark, SF).collect()
    told = docs.collect()
    n = check_packing(rows, [r.text for r in told], ids=[r.doc_id for r in told])
    assert n <= math.ceil(sum(r.length for r in rows) / 1024) * 1.03 + 1


def test_encoding_is_the_librarys():
    tok = Tokenizer.from_file(BYTE)
    for text, ids in zip(ODD, packing.encode(ODD, BYTE), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_search_raises_the_objective_and_keeps_items(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1024, 300)
    start = [[i] for i in range(0, 300)]
    search = packing._Search(start, sizes, 1024)
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sizes[b].sum() <= 1024 for b in bins)
    assert len(bins) < 0.75 * len(start)
    assert len(packing.pack_sizes(sizes, 1024)) <= len(packing.best_fit(sizes, 1024))
    search.table()
    before = sum(v * v for v in search.fill.values())
    for a in list(search.bins)[:20]:
        while a in search.bins and search.step(a):
            after = sum(v * v for v in search.fill.values())
            assert after > before
            before = after


def test_search_ends_at_a_local_optimum():
    """Many alike bins that nothing helps do not end the search for the bins behind them."""
    sizes = np.array([600] * 60 + [650, 60, 640, 70])
    search = packing._Search([*[[i] for i in range(60)], [60, 61], [62, 63]], sizes, 1024)
    assert len(search.bins) > search.least
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(64))
    search.table()
    assert not any(search.step(a) for a in list(search.bins) if search.fill[a] < 1024)


@pytest.mark.parametrize("tokens", [1, 3, 5, 10, 500])
def test_many_equal_pieces_pack_at_once(tokens):
    start = time.perf_counter()
    bins = packing.pack_sizes(np.full(8192, tokens), 1024)
    assert len(bins) == -(-8192 // (1024 // tokens)) and time.perf_counter() - start < 5
    assert sorted(i for b in bins for i in b) == list(range(8192))


def test_the_search_empties_bins_that_best_fit_leaves():
    sizes = np.random.default_rng(0).integers(257, 400, 3000)
    before, after = len(packing.best_fit(sizes, 1024)), packing.pack_sizes(sizes, 1024)
    assert len(after) < 0.97 * before and all(sizes[b].sum() <= 1024 for b in after)
    assert sorted(i for b in after for i in b) == list(range(3000))


def test_null_and_large_ids_stay_exact(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a"), (None, "b"), (big + 1, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack(df, BYTE).collect()} == {big, None, big + 1}


# ---- language model


def brute_scores(rows, order=lm_score.ORDER):
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
    counts, levels = Counter(), [{} for _ in range(order + 1)]
    for i, t in rows:
        if not held(i, 5):
            counts.update(words(t))
            raw = b"\0" * order + t.encode()
            for p in range(order, len(raw)):
                for k, level in enumerate(levels):
                    level.setdefault(raw[p - k : p], Counter())[raw[p]] += 1

    def prob(ctx, s):
        p, barred = 1.0, set()
        for k in range(order, -1, -1):
            here = {x: n for x, n in levels[k].get(ctx[order - k :], {}).items() if x not in barred}
            if here:
                barred |= set(here)
                escapes = 0 if len(barred) == 256 else len(here)
                whole = sum(here.values()) + escapes
                if s in here:
                    return p * here[s] / whole
                p *= escapes / whole
        return p / (256 - len(barred))

    total = sum(counts.values())
    norm = total + 0.5 * (len(counts) + 1)
    out = []
    for i, t in rows:
        w, raw = words(t), b"\0" * order + t.encode()
        score = sum(math.log10(prob(raw[p - order : p], raw[p])) for p in range(order, len(raw)))
        out.append((i, held(i, 5), len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.5) / norm) for x in w), score))
    return out, prob


def test_lm_scores(spark, docs, none):
    some = docs.where("doc_id is null or doc_id not in (8)")
    rows = [(r.doc_id, r.text or "") for r in some.collect()]
    want, prob = brute_scores(rows)
    got = [tuple(r) for r in lm_score.score(some).collect()]
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-6)
    for c in (b"n the", b"\1\2\3\4\5", bytes(5)):
        assert sum(prob(c, s) for s in range(256)) == pytest.approx(1)
    assert lm_score.score(none).count() == 0
    assert {r.score for r in lm_score.score(docs.where("doc_id = 4")).collect()} == {0.0}


def test_lm_contexts_are_exact_and_long(spark, monkeypatch):
    """The longest of 0 to 5 bytes that knows the byte predicts it, over several batches and buckets."""
    monkeypatch.setattr(lm_score, "BUCKET_DOCS", 20)
    monkeypatch.setattr(lm_score, "BATCH_CHARS", 3000)
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abc \u00e9\u4e2d"), 200))) for i in range(60)]
    levels = [{} for _ in range(6)]
    for i, t in rows:
        raw = b"\0" * 5 + t.encode()
        for p in range(5, len(raw)) if not held(i, 5) else ():
            for k, level in enumerate(levels):
                level.setdefault(raw[p - k : p], Counter())[raw[p]] += 1

    def prob(ctx, s):
        p, barred = 1.0, set()
        for k in range(5, -1, -1):
            here = {x: n for x, n in levels[k].get(ctx[5 - k :], {}).items() if x not in barred}
            barred |= set(here)
            if s in here:
                return p * here[s] / (sum(here.values()) + len(here))
            if here:
                p *= len(here) / (sum(here.values()) + len(here))
        return p / (256 - len(barred))

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.mode("overwrite").parquet(path := f"{tempfile.mkdtemp()}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op7_lm_score(spark, path.rsplit("/", 1)[0]).collect()}
    assert len(got) == 60
    for i, t in rows:
        raw = b"\0" * 5 + t.encode()
        assert got[i] == pytest.approx(sum(math.log10(prob(raw[p - 5 : p], raw[p])) for p in range(5, len(raw))), rel=1e-5)


# ---- SimHash


def brute_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, most=4):
    u = np.array(prints, np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= most
    label = np.arange(len(u))
    while True:
        new = np.where(near, label[None, :], len(u)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, docs, none):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    label = brute_components([p for _, p in rows])
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{p:016x}", least.get(c)) for (i, p), c in zip(rows, label, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near(none).count() == 0


def test_links_lose_nothing_and_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ENTRIES", 64)
    rng = np.random.default_rng(3)
    prints = []
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(6):
            p = base
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                p ^= np.uint64(1) << np.uint64(b)
            prints.append(p)
    for _ in range(400):  # one cluster of very many
        p = prints[0]
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            p ^= np.uint64(1) << np.uint64(b)
        prints.append(p)
    label = brute_components(prints)
    df = spark.createDataFrame([(i, int(p.astype(np.int64))) for i, p in enumerate(prints)], "_id long, _fp long")
    got = {int(np.int64(r._fp).astype(np.uint64)): r.component_id for r in simhash.classes(df).collect()}
    first = {}
    for i, c in enumerate(label):
        first.setdefault(c, i)
    assert got == {int(p): first[c] for p, c in zip(prints, label, strict=True)}


@pytest.mark.parametrize("parts", [6, 7, 9])
def test_any_number_of_parts_gives_the_same_links(spark, parts):
    rng = np.random.default_rng(parts)
    prints = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for most in range(1, 6):
        flips = np.array([sum(1 << int(b) for b in rng.choice(63, most, replace=False)) for _ in range(40)], np.uint64)
        prints = np.concatenate([prints, prints[:40] ^ flips])
    df = spark.createDataFrame([(int(p),) for p in prints.astype(np.int64)], "_fp long").distinct()
    got = {r.node: r.root for r in components.components(simhash.links(df, parts=parts)).collect()}
    label = brute_components(prints)
    for i, c in enumerate(label):
        for j in range(i):
            a, b = (int(np.int64(prints[k].astype(np.int64))) for k in (i, j))
            assert (got.get(a, a) == got.get(b, b)) == (label[j] == c) or prints[i] == prints[j]
    assert simhash.parts_for(250_000) == 6 < simhash.parts_for(10**8) <= 9


def test_the_embedding_bounds_the_distance_from_below():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a ^ rng.integers(0, 2**63, 2000, dtype=np.uint64) & rng.integers(0, 2**63, 2000, dtype=np.uint64)
    odd = np.uint64(0x5555555555555555)
    packed = [x - ((x >> np.uint64(1)) & odd) for x in (a, b)]
    fields = [np.stack([(x >> np.uint64(2 * k)) & np.uint64(3) for k in range(32)], 1).astype(int) for x in packed]
    distance = np.abs(fields[0] - fields[1]).sum(axis=1)
    assert (simhash._distance(*packed) == distance).all() and (distance <= np.bitwise_count(a ^ b)).all()


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 30), (4, 1)) for i in range(n)] + [(9, 0)], "k long, i long")
    keyed = rows.where("k < 9").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("m"))
    got = common.join_counted(rows, keyed, ["k"], "n", rows.count())
    assert Counter(map(tuple, got.select("k", "i", "n", "m").collect())) == Counter(map(tuple, rows.join(keyed, "k").select("k", "i", "n", "m").collect()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- nearest neighbours


def test_nearest_reaches_the_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = queries.op6_nearest(spark, SF).collect()
    hit = n = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(r.score == pytest.approx(score[ids == r.vec_id][0], abs=1e-12) for r in found)
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(found, found[1:], strict=False))
        hit, n = hit + len({ids[i] for i in order} & {r.vec_id for r in found}), n + 20
    assert hit / n >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (40, []), (None, [1.0, 1.0]), (10, [1.0]), (60, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 4, 2.0), (2, 3, 1.0), (3, 20, 1.0)], 20: [(1, 4, 2.0), (2, 0, 1.0), (3, 3, 1.0)]}
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_over_many_shards_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "TASK_BLOCKS", 2)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    for share in (ann.SHARE, 1.0):
        got, hit, n = {}, 0, 0
        for r in ann.nearest(df, share=share).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert sorted(got) == sorted(ids[ids % 20 == 0])
        for q, found in got.items():
            score = x @ x[ids == q][0]
            order = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
            assert sorted(found) == list(range(1, 21))
            hit, n = hit + len(set(order) & set(found.values())), n + 20
            if share == 1:
                assert [found[k] for k in range(1, 21)] == order
        assert hit / n >= 0.9


def test_forest_gathers_the_rows_under_the_prefixes():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 16)), rng.normal(size=(7, 16))
    forest = ann.Forest(x, 8)
    got = forest.candidates(q, 60)
    rows, wanted = ann.hash_strings(x, 8), ann.hash_strings(q, 8)
    for i in range(len(q)):
        for depth in range(64, -1, -1):
            under = ((rows ^ wanted[:, i : i + 1]) >> np.uint64(64 - depth) == 0).any(axis=0) if depth else np.ones(300, bool)
            if under.sum() >= 60:
                break
        assert (got[i] == under).all()


# ---- pipeline


def brute_near(rows):
    """The least id of each component of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    return sorted(least.values())


def test_large_groups_split_and_lose_no_link(spark, monkeypatch):
    """Many documents around one passage, chains of edited copies among them, in groups above the limit."""
    monkeypatch.setattr(near, "GROUP", 8)
    monkeypatch.setattr(near, "BUCKET_MEMBERS", 50)
    monkeypatch.setattr(near, "COLUMNS", 64)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(80)]
    texts = []
    for k in range(60):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 15)]
        texts.append(" ".join([*passage, *own]))
        for edits in range(k % 4):
            own[edits] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join([*passage, *own]))
    base = [f"b{x}" for x in rng.integers(0, 10**6, 120)]
    for _ in range(40):  # each some edits from the one before
        for at in rng.integers(0, 120, 2):
            base[at] = f"e{rng.integers(0, 10**6)}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_near(list(enumerate(texts)))
    assert sorted(r.doc_id for r in near.drop_near(df).collect()) == want and 10 < len(want) < len(texts) - 10


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).withColumn("_quality", F.lit("mine"))
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert good.columns == docs.columns and {r._quality for r in good.collect()} == {"mine"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    (_, first), (_, second), (_, third), (_, last) = corpus_pipeline.STAGES
    good = first(spark, docs, SF)
    judged = {r.doc_id for r in queries.op1_quality(spark, SF).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == judged
    unique = second(spark, good, SF)
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(good).where("kept").collect()}
    apart = third(spark, unique, SF)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == brute_near([(r.doc_id, r.text) for r in unique.collect()])
    packed = last(spark, apart, SF).collect()
    check_packing(packed, [r.text for r in apart.collect()])
    assert {r.doc_id for r in packed} == {r.doc_id for r in apart.collect()}


def test_pipeline_takes_odd_rows(spark, docs):
    plain = docs.selectExpr("doc_id", "text", "lang", "_id as source", "length(text) as n_chars")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        plain = stage(spark, plain, SF)
        assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[3][1](spark, plain, SF).count() >= plain.count()
    good = corpus_pipeline.STAGES[0][1](spark, plain.limit(0), SF)
    assert good.count() == 0


def test_pipeline_near_stage_links_edited_copies(spark):
    """All pairs of a five-word Jaccard similarity of 0.8 or more are linked, no others, whatever their fingerprints."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        base = rng.integers(0, 5000, 200).tolist()
        for edits in (0, 1, 2, 3, 4, 5, 8):
            words = list(base)
            for p in rng.integers(0, 200, edits):
                words[p] = int(rng.integers(5000, 9000))
            texts.append(" ".join(f"w{x}" for x in words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    label = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    least = {}
    for i, c in enumerate(label):
        least.setdefault(c, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, SF).collect())
    assert kept == sorted(least.values())
    assert len(kept) < simhash.drop_near(df).count()
    assert [near.bands(near.shingles(t)).size for t in ("", "a", texts[0])] == [0, near.BANDS, near.BANDS]


def test_pipeline_near_stage_finds_its_pairs_by_simhash(spark, monkeypatch):
    """Without near fingerprints nothing is linked; pairs of 0.8 or more have near ones and share cells."""
    rng = np.random.default_rng(6)
    close = []
    for n in (4, 9, 40, 200, 2000):  # shingles; a ninth of them is edited, or one is added
        for _ in range(20):
            words, new = [[f"{c}{x}" for x in rng.integers(0, 10**6, n + 4)] for c in "wx"]
            other = words + new[:1] if n < 9 else words[: -(n // 9)] + new[: n // 9]
            close.append((" ".join(words), " ".join(other)))
    for a, b in close:
        sets = [near.shingles(t) for t in (a, b)]
        both = len(np.intersect1d(*sets))
        assert 5 * both >= 4 * (len(sets[0]) + len(sets[1]) - both) and not np.array_equal(*sets)
        x, y = (np.frombuffer(near.fingerprint(near.votes(s)), np.uint64) for s in sets)
        assert np.bitwise_count(x ^ y).sum() <= near.MOST_BITS and np.intersect1d(*map(near.bands, sets)).size
    keys, nodes = np.arange(3).repeat(4), np.arange(12) % 6  # cells {0 1 2 3}, {4 5 0 1}, {2 3 4 5}
    prints = np.zeros((6, 4), np.uint64)
    prints[3:] = ~prints[3:]
    forest = near._near_prints(keys, nodes, prints[nodes])
    assert len(forest) == 4 and all((a < 3) == (b < 3) for a, b in forest)
    df = spark.createDataFrame(list(enumerate(t for pair in close for t in pair)), "doc_id long, text string")
    assert near.drop_near(df).count() == len(close)
    monkeypatch.setattr(near, "near_prints", lambda nodes: spark.createDataFrame([], "a long, b long"))
    assert near.drop_near(df).count() == 2 * len(close)


def test_large_cells_of_fingerprints_are_split(spark):
    """Cells above the limit are dealt to pairs of blocks, and the same fingerprints hang together."""
    rng = np.random.default_rng(7)
    base, rows = rng.integers(0, 256, 32).astype(np.uint8), []
    for i in range(120):
        print_ = base.copy() if i % 2 else rng.integers(0, 256, 32).astype(np.uint8)
        print_[i % 32] ^= 1 << i % 8
        rows.append((i, bytearray(print_.tobytes()), [7, 100 + i]))
    nodes = spark.createDataFrame(rows, "_node long, _print binary, _cells array<int>")
    for limit in (8, 4096):
        got = components.components(near.near_prints(nodes, limit))
        assert {(r.node, r.root) for r in got.collect()} == {(i, 1) for i in range(1, 120, 2)}


def test_links_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Of one group of near copies in large cells and parts, dealt to many tasks, few more links than members leave them."""
    monkeypatch.setattr(near, "BUCKET_ENTRIES", 100)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, 32).astype(np.uint8)
    for g in (60, 240):
        prints = base ^ (rng.random((g, 32)) < 0.3) * np.uint8(4)
        cells = np.where(rng.random((g, 20)) < 0.9, np.arange(20), 1000 + rng.integers(0, 10**6, (g, 20)))
        df = spark.createDataFrame([(i, bytearray(p.tobytes()), c.tolist()) for i, (p, c) in enumerate(zip(prints, cells, strict=True))], "_node long, _print binary, _cells array<int>")
        links = common.stored(near.near_prints(df, 8))
        assert links.count() <= 2 * g and {r.root for r in components.components(links).collect()} == {0}
    counts = Counter()

    def stored(df, name="table"):
        out = common.stored(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(near, "stored", stored)
    monkeypatch.setattr(near, "GROUP", 8)
    monkeypatch.setattr(near, "BUCKET_MEMBERS", 16)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    texts = [" ".join([*words[:k], f"n{k}", *words[k + 1 :]]) for k in range(120)]
    kept = near.drop_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert counts["links"] <= 2 * len(texts)
