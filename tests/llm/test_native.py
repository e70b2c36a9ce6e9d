"""URL filter, chat formatting, exact dedup and sharding."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from duck import compare
from pyspark.sql import functions as F

from tierspark.llm import chat_format, exact_dedup, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    ours, theirs = compare(df.collect(), df.columns, queries.ORACLE_SQL[name], SF)
    assert ours == theirs


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_chat_format", "op5_exact_dedup", "op8_sharding"])
def test_native_plans_hold_no_python(spark, name):
    if name in queries.QUERIES:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- URL filter


def split(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(5)
    names = ["com", "net", "a.com", "b.a.com", "aa.com", "x.net", "c.b.a.com", ""]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/fr/\u00e9", "/e\U0010ffffz"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((rng.choice(names), rng.choice(paths)) for _ in range(25))}.values())
    urls = [None, "", "no scheme", "http://", "HTTP://A.com/en/", "x://a.com?q#f", "x://a.com#f/en/", "a://b://c"]
    urls += ["s://" + rng.choice(["", "www.", "m."]) + rng.choice(names) + rng.choice(paths) + rng.choice(["", "?x=/en/", "#y"]) for _ in range(300)]
    rows = [(i % 200 if i % 50 else None, u, "h", "r") for i, u in enumerate(urls)] + [(1, "x://a.com/en/x", "h", "r")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(5)
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules), blocks=6).collect()
    want = [(i, *judged(u, rules)) for i, u, *_ in rows]
    assert Counter(map(tuple, got)) == Counter(want)


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "x://a.com/")], "page_id long, url string")
    some = url_filter.rule_table(spark, [("block", "com", "/")])
    assert [tuple(r) for r in url_filter.filter_urls(pages, some.limit(0), default="block").collect()] == [(1, "a.com", "/", None, "block")]
    assert url_filter.filter_urls(pages.limit(0), some).count() == 0


# ---- chat formatting

HOSTILE = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s>", "a<", "[", "</s", "<s>", "[/INST", "x[\\INST]", "", "plain", "<s>a</s>", "l1\nl2", "\U0001f600 [INST]"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "<s>", "to[INST]ol"]), rng.choice([*HOSTILE, None, "z" * 3000 + "<" + "y" * 3000])))
    rows += [(None, 0, "user", "a"), (3, 0, "user", "again"), (3, 0, "user", "again"), (4, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "k", "v") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string").repartition(4)
    out = chat_format.format_chats(df)
    got = {r.conv_id: r for r in out.collect()}
    convs = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        assert got[c].same and [(t.role, t.text) for t in got[c].turns] == turns
        assert all(t.loss == (t.role == "assistant") for t in got[c].turns)
    marks = chat_format.loss_spans(out.where("conv_id is not null")).collect()
    for m in marks:
        turn = got[m.conv_id].turns[m.turn_no]
        assert got[m.conv_id].formatted[m.start : m.start + m.length] == turn.raw and turn.role == "assistant"
    assert len(marks) == sum(role == "assistant" for c, ts in convs.items() if c is not None for role, _ in ts)
    for r in chat_format.digests(out).collect():
        turns = convs[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_parser_rejects_what_breaks_the_grammar(spark):
    bad = ["", "<s>user[INST]x", "<s>user x</s>", "user[INST]x</s>", "<s>u[INST]a[INST]b</s>", "<s>u[INST]<s>b</s>", "<s>u[INST]a</s>tail"]
    df = spark.createDataFrame([(b,) for b in bad], "f string").select("f", chat_format.parse(F.col("f")).alias("p"))
    assert [(r.f, r.p) for r in df.collect() if r.p] == []


# ---- exact dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0, i))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(members)[3], len(members))
        assert not r.kept or r.doc_id == r.keep_id
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by_hash)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0


def test_hash_collisions_are_split_by_bytes(spark, monkeypatch):
    """With a hash of one value for all texts, bytes alone tell classes apart."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df).collect()} == {1: (3, False), 2: (2, True), 3: (3, True)}


# ---- sharding


def test_shards(spark, docs, none):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count() and sharding.shard(none).count() == 0
    for r in got:
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    told = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == told
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(1)).collect()}


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    key = F.col("id").cast("string")
    even, one, heavy = [1.0] * 8, [1.0] * 9, [1.0] * 7 + [3.0]
    df = spark.range(20000).select(sharding.shard_of(key, even).alias("a"), sharding.shard_of(key, one).alias("b"), sharding.shard_of(key, heavy).alias("c")).collect()
    assert all(2300 < n < 2700 for n in Counter(r.a for r in df).values())
    assert all(r.b in (r.a, 8) for r in df) and 1900 < sum(r.b == 8 for r in df) < 2550
    # shard 7 is heavier: region 0 loses rows only, region 1 gains
    assert all(r.c >= 4 for r in df if r.c != r.a) and 5400 < sum(r.c == 7 for r in df) < 6600
    with pytest.raises(ValueError):
        sharding.shard_of(key, [])


def brute_draw(key, shard, weight):
    """-ln(u) / weight, with u from 53 bits of the hash of key and name, chained as Spark chains hashes."""
    h = xxhash.xxh64_intdigest(f"shard {shard}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def brute_shard(key, weights):
    """Down the tree, each node's draw being the least below it."""
    tree = sharding.topology(weights)
    rack = lambda r: min((brute_draw(key, s, w), s) for s, w in r)
    region = min(tree, key=lambda g: min(map(rack, g)))
    return rack(min(region, key=rack))[1]


def test_the_descent_is_the_plain_one_and_growth_moves_rows_only_into_the_new_shard(spark):
    keys = [str(i) for i in range(600)]
    counts = range(1, 11)
    key = F.col("id").cast("string")
    rows = spark.range(600).select(*[sharding.shard_of(key, [1.0] * n).alias(f"n{n}") for n in counts], sharding.shard_of(key, [1.0, 2.0, 0.5]).alias("w"), "id").orderBy("id").collect()
    for r, k in zip(rows, keys, strict=True):
        assert r.w == brute_shard(k, [1.0, 2.0, 0.5])
        for n in counts:
            assert r[f"n{n}"] == brute_shard(k, [1.0] * n)
            assert n == 1 or r[f"n{n}"] in (r[f"n{n - 1}"], n - 1)
    for n in counts:
        share = np.bincount([r[f"n{n}"] for r in rows], minlength=n) / 600
        assert abs(share - 1 / n).max() < 5 * (1 / n / 600) ** 0.5


def test_slots_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 3)
    got = sharding.shard(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 5).collect()
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_rule_hosts_are_lowered_like_urls(spark):
    pages = spark.createDataFrame([(1, "http://www.\u00c9A.com/x"), (2, "http://\u00e9a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("\u00c9A.COM", "/", "block")], "host string, path string, verdict string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()} == {1: ("\u00c9a.com/", "block"), 2: (None, "allow")}


def test_what_does_not_read_back_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "escape", lambda c: c)
    turns = spark.createDataFrame([(1, 0, "user", "a</s>b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="not read back"):
        chat_format.digests(chat_format.format_chats(turns)).collect()
