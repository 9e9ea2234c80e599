"""WARC, mixing, packing, search, URL filters, near-duplicates, pipeline: brute force, round trips and odd rows."""

import gzip
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, mixing, neardup, packing, topk, urlfilter, warc

SF = "/root/testdata/sf0.001"


# --- shared ---


def test_keyed_join_with_many_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_KEYS", 3)
    left = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{0 if i % 3 else i}", {"a": i}) for i in range(300)], "i int, key string, m map<string,int>")
    right = common.stored(left.filter("key is not null").groupBy("key").agg(F.count("*").alias("w")).withColumn("v", F.length("key")))
    got = {r.i: r.v for r in common.keyed_join(left, right, "key", "w", ["v"]).collect()}
    assert got == {r.i: len(r.key) if r.key else None for r in left.collect()}


# --- WARC ---


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>" + "x" * 200, "<p>" + "x" * 200, "short", "short", None, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n" * 9, "é" * 60, "é" * 60, "é" * 60, "y" * 500_000]
    rows = [(i + 10, f"http://h/{i} \n", h, "own") for i, h in enumerate(html)] + [(17, "http://h/7", "é" * 60, "own"), (None, None, "z" * 150, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    warc.write(pages, f"file://{tmp_path}/w", date="2024-01-01T00:00:00Z")
    back = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert len(back) == len(rows)
    by = {r.page_id: r for r in back if r.page_id != 17}
    assert by[11].record_type == "revisit" and by[11].refers_to == 10 and by[11].payload is None and by[11].payload_bytes == 203
    assert by[12].record_type == by[13].record_type == by[14].record_type == "response" and by[14].payload == b""
    assert by[16].payload.decode() == html[6] and by[20].payload_bytes == 500_000
    assert [r.record_type for r in back if r.page_id == 17] == ["response", "response"]
    assert by[18].refers_to == by[19].refers_to == 17
    assert by[None].record_type == "response"
    for r in back:
        if r.record_type == "response":
            assert len(r.payload) == r.payload_bytes
    first = gzip.decompress(sorted((tmp_path / "w").glob("*.gz"))[0].read_bytes())
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" in first
    heads = [h for f in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse(f.read_bytes())]
    assert {h["warc-refers-to-target-uri"] for h in heads if h["warc-type"] == "revisit"} == {"http://h/0%20", "http://h/7"}
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "CLASS_BYTES", (2_000, 10_000))
    rng = random.Random(1)
    rows = [(i, "http://h", "".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([10] * 100 + [5_000] * 30 + [50_000] * 3)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), f"file://{tmp_path}/w", compression="none")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("*.txt")]
    assert sorted(s > 40_000 for s in sizes)[-4:] == [False, True, True, True] and len(sizes) >= 5 + 8 + 3
    monkeypatch.setattr(warc, "CHUNK_BYTES", 700)
    monkeypatch.setattr(warc, "BATCH_BYTES", 3_000)
    back = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert {(r.page_id, r.payload.decode()) for r in back} == {(i, h) for i, _, h in rows}


def test_archives_are_read_in_a_stream(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 7)
    blocks = [b"x" * n + b"\r\n\r\nWARC/1.1\r\n" for n in (0, 5, 400)]
    records = [b"WARC/1.1\r\nContent-Length: %d\r\nK: v\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [(h["k"], b) for h, b in warc.parse(data)] == [("v", b) for b in blocks]
    with pytest.raises(ValueError):
        list(warc.parse(b"".join(records)[:-10]))
    assert list(warc.parse(b"")) == []


# --- mixing ---


def slow_targets(sizes):
    """sizes: source -> words; shares by weight, cut at the limit, the excess shared again."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def test_mixing_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", "é", "z", None, "\U00010000"]), i) for i in range(800)] + [(9000, None, "empty", 1), (None, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[r.source]
        assert r.taken in (r.size * math.floor(r.target / r.source_size), r.size * math.ceil(r.target / r.source_size)) if r.source_size else r.taken == 0
        taken[r.source] += r.taken
    assert abs(sum(taken.values()) - sum(want.values())) < 0.1 * sum(want.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(docs.repartition(5)).collect()), key=str)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_ids_come_near_their_target(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * 5, "b") for i in range(600)] + [(1, "x " * 1000, "a"), (2, "y " * 200, "c")], "doc_id long, text string, source string")
    got = mixing.plan(docs).filter("source = 'b'").collect()
    assert 0.2 < got[0].target / got[0].source_size % 1 < 0.99
    assert abs(sum(r.taken for r in got) - got[0].target) < 0.1 * got[0].target
    assert mixing.mix(docs).filter("source = 'b'").count() == sum(r.copies for r in got)


# --- packing ---


def test_packing_by_brute_force(spark):
    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    texts |= {-1: None, -2: "", -3: "It's 20%! <|endoftext|> 日本語\u00a0naïve İstanbul ǅ x\u0301", -4: "ab " * 9000, -5: "ÀÉ, thé. don't!! a..", -6: "x" * 3000}
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = total = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        total += at
        padded += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padded < 0.02 * total
    assert packing.pack(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id = -2").union(docs.filter("doc_id = -2"))
    assert packing.pack(twice).count() == 2


def test_ids_equal_the_tokenizers_with_special_tokens():
    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    tokenizer, ours, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "Be", "né", ".", "'s", " ", "\n", "\u00a0", "日本", "12", "_"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert ours.encode(text.encode()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
    assert ours.encode(b"x <|endoftext|> y").tolist()[1] == 49407


def test_words_with_marks_take_no_way_of_their_own(monkeypatch):
    """A word's forms (marks behind it, capitals) are one word to the model, in any block and with a small memory."""
    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    tokenizer, ours, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(7)
    asked = []
    monkeypatch.setattr(ours, "_full", lambda word, full=ours._full: asked.append(word) or full(word))
    cores = ["".join(rng.choice("abcdefghéüßñº") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    marks = ["", ".", ",", "###", ",$$$", "'", "...", "<|", "'\"", "\\]^_`{|}~"]
    words = [form(core) + mark for core in cores for mark in marks for form in (str.lower, str.capitalize, str.upper)]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + ["'s", "don't 's's", "x\u0301. e\u0301", "", " \n", "ab12", "J\u030c", "\u00c5. A\u030a,", "İ. ǅ,", "(a) [b] \u00abc\u00bb", "\u00b5m, \u039cM."]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    assert [(i, ids.tolist()) for i, ids in ours.documents(rows)] == list(enumerate(want))
    assert len(asked) < 150
    monkeypatch.setattr(packing, "BLOCK", 200)
    monkeypatch.setattr(packing, "MEMO_WORDS", 20)
    assert [ids.tolist() for _, ids in packing.WordIds(path).documents(rows)] == want
    assert ours.encode(b"ab\xff, Cd \xc3").tolist() == ours.encode("ab\ufffd, cd \ufffd".encode()).tolist()


def test_classes_hold_a_fixed_count():
    packer = packing.HarmonicPacker(100)
    out = [x for i in range(9) for x in packer.add((i,), 33)]
    assert len(out) == 9 and {n for _, n, _, _ in out} == {0, 1, 2} and not packer.open.get(3)


# --- exact search ---


def slow_search(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in sorted(ok, reverse=True) if i % 50 == 0}.items():
        hits = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_by_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("TILE_ROWS", 7), ("SLICE_QUERIES", 2), ("FAN_IN", 2), ("BLOCK_QUERIES", 3), ("LAZY_BLOCKS", 1)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(5)
    hot = [0.5] * 8
    rows = [(i, hot if rng.random() < 0.3 else [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [math.nan] * 8), (1050, [math.inf] * 8), (1100, [1.0, 2.0]), (1101, [3.0, -1.0]), (1150, []), (None, hot), (7, rows[7][1]), (1200, [3e9] * 8)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = topk.search(vectors, vectors.filter("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == [r for r in slow_search(rows) if True]
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_search_in_blocks_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 40 * 20)
    monkeypatch.setattr(topk, "TILE_BYTES", 8 * 40 * 3)
    monkeypatch.setattr(topk, "LEAST_QUERIES", 20)
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(vectors, vectors.filter("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == slow_search(rows)


# --- URL filters ---


def slow_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fit, key=len, default=None)


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.NET/x", "http://net/", "http://net", "x://a.example.net/en/1", "http://a.example.com/de/", "http://example.com/d", "http://b.org/fr/?x", "http://xorg/fr/", "a://b://c.net/", "http://u@h.net:8/p#f", "HTTP://É.NET/", "http://a.org/en/1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    empty = spark.createDataFrame([], "items array<string>, confidence double, support double")
    for r in urlfilter.judge(pages.select("page_id", "url", "host"), empty).collect():
        host, path, rule = slow_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (urlfilter.RULES[rule] if rule else "allow")
    assert urlfilter.judge(pages.limit(0), empty).count() == 0


def test_mined_rules(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        site, part = rng.choice(["alpha", "beta", "gamma"]), rng.choice(["shop", "news"])
        bad = site == "beta" and part == "shop" or site == "gamma" and rng.random() < 0.3
        rows.append((i, f"http://{site}.example.org/{part}/{i}", None if i % 50 == 0 else bad))
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = urlfilter.mine(labelled.select("url", "bad"), urlfilter.Limits(support=0.02))
    found = [frozenset(r["items"]) for r in rules.collect()]
    # brute force: all sets of up to three tokens with enough support and confidence, the least ones only
    from itertools import combinations

    sets = [(frozenset(r.t), r.bad) for r in labelled.filter("bad is not null").select("bad", urlfilter.tokens(urlfilter.host(F.col("url")), urlfilter.path(F.col("url"))).alias("t")).collect()]
    count, hits = defaultdict(int), defaultdict(int)
    for tokens, bad in sets:
        frequent = sorted(t for t in tokens if not re.search(r"\d", t))
        for n in range(1, len(frequent) + 1):
            for c in combinations(frequent, n):
                count[frozenset(c)] += 1
                hits[frozenset(c)] += bad
    good = {c for c in count if hits[c] >= 0.02 * len(sets) and hits[c] >= 0.8 * count[c]}
    assert set(found) == {c for c in good if not any(o < c for o in good)} and len(found) == len(set(found)) > 0
    for limit in (urlfilter.MAX_BROADCAST_RULES, 0):
        monkeypatch.setattr(urlfilter, "MAX_BROADCAST_RULES", limit)
        got = {r.page_id: r.verdict for r in urlfilter.judge(labelled, rules).collect()}
        assert len(got) == 1200 and all((v == "block") == ("beta" in rows[i][1] and "shop" in rows[i][1]) for i, v in got.items())
    assert urlfilter.mine(labelled.select("url", "bad").limit(0)).count() == 0


def test_rules_of_many_tokens(spark, monkeypatch):
    """Only four path parts together tell bad URLs, and urls without frequent tokens count as rows."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        parts = [rng.choice(["a", "b"]) + str(k) for k in range(4)]
        rows.append((i, "http://h/" + "/".join(x.replace("0", "w").replace("1", "x").replace("2", "y").replace("3", "z") for x in parts), all(p[0] == "a" for p in parts)))
    rows += [(5000 + i, f"u{i}://{i}", False) for i in range(500)]
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = urlfilter.mine(labelled, urlfilter.Limits(support=0.01, rows=5)).collect()
    assert {len(r["items"]) for r in rules} == {4} and any(set(r["items"]) == {"p:aw", "p:ax", "p:ay", "p:az"} for r in rules)
    bad = sum(b for _, _, b in rows)
    assert all(abs(r.support - bad / len(rows)) < 1e-9 for r in rules)
    frame = spark.createDataFrame([(r["items"], r.confidence, r.support) for r in rules], "items array<string>, confidence double, support double")
    for most, chunk in ((10_000, 100), (0, 1)):
        monkeypatch.setattr(urlfilter, "MAX_BROADCAST_RULES", most)
        monkeypatch.setattr(urlfilter, "CHUNK_RULES", chunk)
        got = {r.page_id: r.verdict for r in urlfilter.judge(labelled, frame).collect()}
        assert got == {i: "block" if b else "allow" for i, _, b in rows}


# --- near-duplicates ---


def slow_clusters(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {(i, len(s), root(i)) for i, s in sets}


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    if block == 16:  # a pivot's members lie in several slots, and blocks are cut by bytes too
        monkeypatch.setattr(neardup, "SLOT", 7)
        monkeypatch.setattr(neardup, "BLOCK_BYTES", 9_000)
    rng = random.Random(block)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for size, most, length in ((120, 8, 150), (40, 3, 60), (30, 30, 200)):
        texts += variants(rng, [word() for _ in range(length)], size, most)
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rng.randint(5, 90))] + passage) for _ in range(60)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(60)] + ["same text here"] * 20 + ["SAME text\x0bhere", "same text", "a b c d e", "A  B\tC d\ne", None, "", " \n", "x " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string")
    got = neardup.cluster(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == slow_clusters(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_near_duplicates_of_odd_rows(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame([(None, same), (None, None), (5, same), (5, same), (3, same), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.cluster(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)], key=str)
    stay = neardup.deduplicate(docs.union(docs.filter("doc_id in (3, 9)")))
    assert sorted((r.doc_id for r in stay.collect()), key=str) == [3, 9, None, None]
    assert neardup.cluster(docs.limit(0)).count() == 0


def test_pruning_bounds_keep_similar_pairs():
    least = neardup.least_matches(85, 1e-8)
    assert list(least) == sorted(least) and least[-1] > 60
    rng = np.random.default_rng(0)
    for _ in range(2000):
        same = rng.random(neardup.HASHES) < 0.85
        seen = np.add.reduceat(same, np.arange(0, neardup.HASHES, neardup.BATCH)).cumsum()
        assert (seen >= least).all()


# --- pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, kept, SF))
        assert out.columns == columns, name
        kept = out
    distinct = kept.select("doc_id").distinct().count()
    assert 0 < distinct <= docs.count()
    assert kept.filter(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.example\.com")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == distinct
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_take_null_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, 0), (2, "", "en", None, 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        stage(spark, docs.limit(0), SF).collect()


def test_stages_pass_extra_columns_through(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    extra = docs.select("*", F.col("doc_id").alias("node"), F.lit("c").alias("c0"), F.lit(1).alias("size"), F.create_map(F.lit("k"), F.lit("v")).alias("rows"), F.lit("d").alias("digest"))
    kept = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, kept, SF))
        assert out.columns == extra.columns, name
        row = out.first()
        assert (row.node, row.c0, row["size"], row["rows"], row.digest) == (row.doc_id, "c", 1, {"k": "v"}, "d"), name
        kept = out
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() > 0
