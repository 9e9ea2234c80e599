"""The whole pipeline against plain Python on some 200 documents."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from lodestrata.llm import common, langid, packing, pii

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_each_group(rows):
    """The rows that are the first, by id, of all that links of 0.8 and more reach."""
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return [r for r in rows if root(r["doc_id"]) == r["doc_id"]]


def mixed(rows):
    """Each row as often as the mix takes it: weights 5, 2, 1 by source, 150 % of all words, no source over twice its own."""
    words = Counter()
    for r in rows:
        words[r["source"]] += len((r["text"] or "").encode().split())
    order = sorted(words, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(words.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(2 * words[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * words[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * words[s] if s in full else level * weight[s] for s in order}
    out = []
    for r in rows:
        rate = target[r["source"]] / words[r["source"]] if words[r["source"]] else 0.0
        drawn = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 16**12
        out += [r] * (int(rate) + (drawn < rate - int(rate)))
    return out


def test_the_pipeline_equals_plain_python(spark, tmp_path):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:180]
    make = lambda i, text, source="src1": {"doc_id": 10_000 + i, "text": text, "lang": "en", "source": source, "n_chars": len(text or "")}
    long = max(rows, key=lambda r: len(r["text"]))["text"]
    words = long.split(" ")
    rows += [make(0, None), make(1, ""), make(2, "12 34 😀"), make(3, long), make(4, " ".join([*words[:-2], "other", "end"])), make(5, " ".join(words[: len(words) // 2]))]
    rows += [make(6, " ".join(words[::-1]) + " Write to joe.doe@mail.example.com or +49 30 1234567, card 4111 1111 1111 1111.", "src0"), make(7, rows[7]["text"].upper(), None), make(8, "<|endoftext|> " + rows[9]["text"], None)]
    sf = tmp_path / "sf"
    sf.mkdir()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist(rows, schema), sf / "documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{sf}").collect()

    frame = lambda some: spark.createDataFrame([tuple(r[c] for c in schema.names) for r in some], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(frame(rows))
    known = []
    for r in rows:
        x = langid.features(r["text"] or "")
        if x is not None and (found := model.predict(x[None])[0])[1] >= corpus_pipeline.LEAST_SCORE and found[0] != langid.UND:
            known.append(r)
    assert {r["doc_id"] for r in rows} - {r["doc_id"] for r in known} >= {10_000, 10_001, 10_002}
    single = first_of_each_group(known)
    assert not {10_003, 10_004} & {r["doc_id"] for r in single} and any(r["doc_id"] == 10_005 for r in single)
    net = pii.net_for(frame(single))
    clean = []
    for r in single:  # one by one
        ((_, text, base, more),) = pii._search(net, iter([(r["doc_id"], r["text"].encode())]))
        clean.append(r | {"text": pii.mask(text, base + more)})
    assert any("[EMAIL]" in r["text"] and "[PHONE]" in r["text"] and "[CARD]" in r["text"] for r in clean)
    taken = mixed(clean)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(common.tokenizer_file("word_bpe_49k.json"))
    copies = Counter(r["doc_id"] for r in taken)
    texts = {r["doc_id"]: r["text"] for r in taken}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(copies)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        covered = np.zeros(len(ids), dtype=int)
        for p in pieces[doc]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            covered[p.start : p.start + p.length] += 1
        assert (covered == copies[doc]).all()
    for some in sequences.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
