"""Token counts, language, quality rules, personal data: brute force, held-out accuracy and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import bilstm_crf, langid, pii, quality, tokencount

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "日本語 \u00a0x \x1f y"), (6, "###"), (7, "word " * 50_000), (8, "x" * 200_000), (8, "x" * 200_000), (None, "a b c")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 9, "clash") for i, t in ODD], "doc_id long, text string, lang string, source string, n_words long, c0 string")


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


# --- token counts ---


def greedy(word, pieces, mark, alone):
    text, i, n = mark + word, 0, 0
    while i < len(text):
        end = next((j for j in range(len(text), i, -1) if text[i:j] in pieces or (alone and i == 0 and text[i:j] == mark)), None)
        if end is None:
            return 0
        i, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.text("ab", min_size=0, max_size=5)), max_size=12), st.lists(st.text("ab", min_size=1, max_size=14), max_size=20))
def test_automaton_equals_greedy_matching(vocab, words):
    pieces = [("▁" if first else "") + p for first, p in vocab]
    counter = tokencount.GreedyCounter(pieces)
    for w in words:
        assert counter.count(w) == greedy(w, {p for p in pieces if p not in ("", "▁")}, "▁", "▁" in pieces)


def test_token_counts_of_documents(spark):
    pieces = tokencount.vocabulary()
    known, alone = set(pieces) - {"▁"}, "▁" in pieces
    got = {r.doc_id: r for r in tokencount.count_tokens(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d in documents()[:40]:
        counts = [greedy(w, known, "▁", alone) for w in re.findall(r"[^\x20\x09-\x0D]+", d["text"])]
        r = got[d["doc_id"]]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(counts), sum(n or 1 for n in counts), counts.count(0))
    assert len(got) == len(documents())


def test_token_counts_of_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in tokencount.count_tokens(odd.filter("doc_id is not null")).collect())
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert got[0][1:] == got[1][1:] == got[2][1:] == (0, 0, 0)
    assert got[4][1] == 4 and got[6][1] == 50_000
    assert tokencount.count_tokens(odd).count() == len(ODD)
    assert tokencount.count_tokens(odd.limit(0)).count() == 0


# --- language ---


def test_language_held_out(spark):
    from lodestrata.llm.queries import op2_language_id

    truth = {d["doc_id"]: d for d in documents()}
    got = op2_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, odd):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert {(1, True), (2, True), (3, True), (6, True), (4, False), (5, False)} <= got
    kept = langid.identified(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 0
    assert kept.filter("doc_id = 7").first().c0 == "clash"
    untrained = langid.fit(odd)
    assert {r.lang_pred for r in langid.predict(odd, untrained, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model, ["doc_id"]).count() == 0


def test_one_language_alone(spark):
    docs = spark.createDataFrame([(i, "the of and to in", "xx") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs), ["doc_id"]).collect()} == {"xx"}


def slow_features(text):
    """Counts of 1-, 2- and 3-grams of codes, by loops."""
    codes = [32]
    for ch in text.lower():
        c = ord(ch) if ord(ch) >= 0x10000 else int(langid.letter_table()[ord(ch)])
        if c != 32 or codes[-1] != 32:
            codes.append(c)
    if not any(c != 32 for c in codes):
        return None
    codes.append(32)
    mask, mul = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    out = [0.0] * langid.DIMENSIONS
    for i, c in enumerate(codes):
        one = c * mul[0] & mask
        out[(one * 0xFF51AFD7ED558CCD & mask) >> 51] += 1
        if i + 1 < len(codes):
            two = (one ^ codes[i + 1] * mul[1] & mask) * 0xFF51AFD7ED558CCD & mask
            out[two >> 51] += 1
        if i + 2 < len(codes):
            out[((two ^ codes[i + 2] * mul[2] & mask) * 0xC4CEB9FE1A85EC53 & mask) >> 51] += 1
    norm = math.sqrt(sum(out))
    return [math.sqrt(v) / norm for v in out]


@settings(max_examples=60, deadline=None)
@given(st.text("aÉß 1.\n日𝔄", max_size=40), st.integers(1, 7))
def test_features_by_brute_force(text, width):
    whole, langid_slice = langid.features(text), langid.SLICE_CHARS
    want = slow_features(text)
    langid.SLICE_CHARS = width
    try:
        sliced = langid.features(text)
    finally:
        langid.SLICE_CHARS = langid_slice
    assert (whole is None) == (want is None) == (sliced is None)
    if want is not None:
        assert np.allclose(whole, want, atol=1e-6) and np.allclose(sliced, want, atol=1e-6)


def test_language_decision_by_brute_force(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    chance = lambda m, v: 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * v + m.shift))))
    for d in documents()[:60]:
        x = langid.features(d["text"])
        if x is None:
            continue
        margins = {f: float(x @ m.weights + m.bias) for f, m in model.rest.items()}
        family = max(margins, key=margins.get)
        sure = chance(model.rest[family], margins[family]) / sum(chance(model.rest[f], v) for f, v in margins.items())
        wins = {}
        for lang in model.families[family]:
            duels = [(float(x @ m.weights + m.bias) * (1 if a == lang else -1), chance(m, float(x @ m.weights + m.bias)), a == lang) for (a, b), m in model.pairs.items() if lang in (a, b)]
            wins[lang] = (sum(v > 0 for v, _, _ in duels), sum(v for v, _, _ in duels), min([p if first else 1 - p for _, p, first in duels], default=1.0))
        best = max(wins, key=lambda k: wins[k][:2])
        ((lang, score, kin),) = model.predict(x[None])
        assert (lang, kin) == (best, family) and abs(score - sure * wins[best][2]) < 1e-5


def test_any_number_of_languages_is_learned(spark):
    rng = random.Random(6)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    rows = [(i, " ".join(rng.choice(letters[4 * k : 4 * k + 4]) * 2 for _ in range(30)), f"x{k}") for i, k in enumerate([k for k in range(150) for _ in range(3)])]
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)
    few = langid.sample(docs, rows=40).collect()  # fewer rows than languages: languages are drawn
    assert 1 <= len(few) <= 40 and len({r.lang for r in few}) == len(few)
    assert len(langid.sample(docs, rows=300).collect()) == 300


def test_families_are_told_apart_before_languages():
    rng = random.Random(1)
    make = {"de": "der die und ein sch ung", "en": "the of and ing tion", "fr": "le des et que eau", "es": "el los y ción ado"}
    texts = [(lang, " ".join(rng.choice(w.split()) for _ in range(60))) for lang, w in make.items() for _ in range(30)]
    x = np.stack([langid.features(t) for _, t in texts])
    langs = np.array([lang for lang, _ in texts])
    (machine,) = langid.train(x, np.isin(langs, ["de", "en"])[:, None])
    assert ((machine.margins(x) > 0) == np.isin(langs, ["de", "en"])).all()
    assert langid.features("123 ### ") is None and langid.features("") is None


# --- quality rules ---


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text("ab#| \n\r\x0b\x1c\xa0é", max_size=60))
def test_base_counts(text):
    c = quality.count(text.encode(), quality._Places([]))
    assert (c.words, c.chars, c.symbols, c.lines, c.repeated) == slow_counts(text)


def test_base_counts_of_long_texts(monkeypatch):
    from lodestrata.llm import common

    monkeypatch.setattr(common, "SLICE", 5)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab# \n\r\xa0é") for _ in range(rng.randint(0, 120)))
        assert b"".join(common.slices(text.encode())) == text.encode()
        c = quality.count(text.encode(), quality._Places([b"a"]))
        assert (c.words, c.chars, c.symbols, c.lines, c.repeated) == slow_counts(text)
        assert (c.classes == quality.class_counts(text)).all() and c.common[0] == sum(quality.plain(w) == b"a" for w in text.encode().split())


def slow_js(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return 1.0
    p, q = [x / a for x in p], [x / b for x in q]
    half = lambda x, y: sum(u * math.log2(u / ((u + v) / 2)) for u, v in zip(x, y, strict=True) if u)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def slow_verdict(text, lang, refs, limits):
    """Kept, distances and nearest language by plain loops."""
    n, _, _, _, repeated = slow_counts(text)
    failed = n < 50 or 100 * repeated > 50 * n
    if not refs.classes or lang is not None and lang not in refs.classes:
        return not failed, None, None
    table, own = quality.class_table(), [0] * 8
    for ch in text:
        own[table[min(ord(ch), 0x10000)]] += 1
    found = [quality.plain(w) for w in text.encode().split()]
    best = None
    for name, common in refs.common.items():
        by_class = slow_js(own, refs.classes[name]) if len(text) >= limits.min_chars else None
        by_word = None
        if n >= limits.min_words:
            uses = [found.count(w) for w in common]
            by_word = slow_js([*uses, n - sum(uses)], [*common.values(), refs.others[name]])
        over = max((by_class or 0) / limits.char_distance, (by_word or 0) / limits.word_distance)
        if best is None or over < best[0] - 1e-12:
            best = over, by_class, by_word
    return not failed and best[0] <= 1, best[1], best[2]


def test_quality_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    refs = quality.references(docs)
    got = {r.doc_id: r for r in quality.judge(docs, refs).collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    # references by brute force
    classes, common, total = {}, {}, Counter()
    for d in documents():
        words = [quality.plain(w) for w in d["text"].encode().split()]
        classes[d["lang"]] = classes.get(d["lang"], 0) + quality.class_counts(d["text"])
        common.setdefault(d["lang"], Counter()).update(w for w in words if w)
        total[d["lang"]] += len(words)
    for lang in classes:
        top = sorted(common[lang].items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
        assert (refs.classes[lang] == classes[lang]).all() and refs.common[lang] == dict(top)
        assert refs.others[lang] == total[lang] - sum(n for _, n in top)
    for d in documents():
        r = got[d["doc_id"]]
        n, *rest = slow_counts(d["text"])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (r.base_failed and r.kept)
        if labels.get(d["doc_id"]) == 1 and not r.base_failed:
            assert r.kept
        kept, by_class, by_word = slow_verdict(d["text"], d["lang"], refs, quality.Limits())
        assert r.kept == kept and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in ((r.char_distance, by_class), (r.word_distance, by_word)))


def test_jensen_shannon():
    assert quality.jensen_shannon(np.array([1.0, 0]), np.array([0, 2.0])) == 1
    assert quality.jensen_shannon(np.array([1.0, 3]), np.array([2.0, 6])) == 0
    assert quality.jensen_shannon(np.zeros(2), np.array([1.0, 1])) == 1


def test_quality_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[7].base_failed and got[7].n_repeat_words == 50_000
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_of_a_rare_language(spark):
    rng = random.Random(1)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(0, "big", text("abcdefgh", 400_000)), (1, "rare", text("กขคงจฉชซ", 150)), (2, "tiny", text("ΑΒΓΔΕΖΗΘ", 60)), (3, "tiny", text("ΑΒΓΔΕΖΗΘ", 20))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    limits = quality.Limits(reference_words=100)
    assert set(quality.references(docs).classes) == {"big"}
    refs = quality.references(docs, limits=limits)
    assert set(refs.classes) == {"big", "rare"}  # "tiny" has 80 words
    assert any(len(w) > 12 for w in refs.common["rare"])
    got = {r.doc_id: r for r in quality.judge(docs, limits=limits).collect()}
    assert got[1].kept and got[1].nearest == "rare"
    assert got[2].kept and got[2].char_distance is None and got[3].base_failed and not got[3].kept


def test_quality_of_more_languages_than_are_sent(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))
    scripts = {"a": "abcde", "b": "бвгдж", "c": "กขคงจ", "d": "אבגדה", "e": "αβγδε"}
    rows = [(i, lang, text(letters, 300 + 10 * i), "x") for i, (lang, letters) in enumerate(k for k in scripts.items() for _ in range(3))]
    rows += [(100, "a", text("#$%&*", 300), "x"), (101, None, text("αβγδε", 300), "x"), (102, "f", text("αβγδε", 300), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, own string")
    limits = quality.Limits(reference_words=800)
    want = {r.doc_id: r for r in quality.judge(docs, limits=limits).collect()}
    told = {k: (r.kept, r.nearest) for k, r in want.items()}
    assert told[100][0] is False and told[101] == (True, "e") and told[102] == (True, None) and told[4] == (True, "b")
    for most in (1, 2):  # the result doesn't depend on how many languages a block holds
        monkeypatch.setattr(quality, "BROADCAST", most)
        assert len(list(quality.blocks(docs, limits=limits))) == -(-5 // most)
        assert {r.doc_id: r for r in quality.judge(docs, limits=limits).collect()} == want
        with pytest.raises(ValueError):
            quality.references(docs, limits=limits)
    dirty = docs.withColumn("lang", docs.doc_id.cast("string"))
    assert quality.references(dirty).classes == {}


def test_only_letters_make_a_language():
    for text in ("😀 😀😀", "\u0301\u0302", "12 34 !?", "\U0001F600\u0301", ""):
        assert langid.features(text) is None
    for text in ("a", "\U00010400", "字", "e\u0301", "\U00020000 \U0001F600"):
        assert langid.features(text) is not None


def test_tokens_of_long_texts_are_counted_in_slices(spark, monkeypatch):
    from lodestrata.llm import common, mixing, packing

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (0, 1, 5, 300, 2000)]
    rows = [(i, t, t.encode()) for i, t in enumerate(texts)]
    want = list(tokencount._count(None, iter([(i, b) for i, _, b in rows])))
    sizes = list(mixing._sizes(iter([(i, None, "s", b) for i, _, b in rows])))
    encoder = packing.WordIds(common.tokenizer_file("word_bpe_49k.json"))
    ids = [encoder.encode(b).tolist() for _, _, b in rows]
    monkeypatch.setattr(common, "SLICE", 50)
    assert len(list(common.slices(rows[-1][2]))) > 100
    assert list(tokencount._count(None, iter([(i, b) for i, _, b in rows]))) == want
    assert list(mixing._sizes(iter([(i, None, "s", b) for i, _, b in rows]))) == sizes
    assert [encoder.encode(b).tolist() for _, _, b in rows] == ids


def test_words_are_counted_in_bounds(monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", f"z{rng.randrange(30)}"]), " ".join(rng.choice(["a", "B.", "b", "q" * 300, f"w{rng.randrange(50)}"]) for _ in range(20)).encode()) for _ in range(200)]
    want = sum_by(quality._count(iter(rows)))
    monkeypatch.setattr(quality, "HELD_WORDS", 10)
    monkeypatch.setattr(quality, "HELD_LANGS", 3)
    assert sum_by(quality._count(iter(rows))) == want and want["x", "word", "b"] == sum(quality.plain(w) == b"b" for lang, t in rows for w in t.split() if lang == "x")


def sum_by(rows):
    out = Counter()
    for lang, kind, name, n in rows:
        out[lang, kind, name] += n
    return out


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def slow_spans(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.text("a_@.-1259 +(%é", max_size=40))
def test_rules_equal_their_patterns(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_rules_on_documents(spark):
    got = {r.doc_id: r for r in pii.find(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d in documents():
        want = slow_spans(d["text"])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        r = got[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in want) for x in pii.KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_long_digit_runs_take_linear_time():
    text = "1" * 300_000 + " " + "a" * 300_000 + "@" + ".5" * 100_000
    assert isinstance(pii.base_spans(text), list)


def test_net_finds_what_rules_miss():
    net, test = pii.default_net(), pii.invented(300, 99)
    right = extra = missed = base = 0
    for (_, _, own, more), (_, want) in zip(pii._search(net, ((i, t.encode()) for i, (t, _) in enumerate(test))), test, strict=True):
        got = set(own) | set(more)
        right, extra, missed = right + len(got & set(want)), extra + len(got - set(want)), missed + len(set(want) - got)
        base += len(set(own) & set(want))
    assert right / (right + missed) > 0.9 and right / (right + extra) > 0.9 and right > 1.5 * base


def test_the_net_tells_readings_of_one_shape_apart():
    """Numbers whose shape doesn't say what they are: what the rules find, what fixed patterns find and what the net finds."""
    shape = re.compile(r"(?<![0-9])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}(?![0-9])|(?<![0-9])[0-9]{10,15}(?![0-9])")
    test = pii.ambiguous(600, 77)
    told = {name: [0, 0] for name in ("rules", "patterns", "net")}
    for (_, text, own, more), (_, want) in zip(pii._search(pii.default_net(), ((i, t.encode()) for i, (t, _) in enumerate(test))), test, strict=True):
        by_shape = {(m.start(), m.end(), "phone") for m in shape.finditer(text) if 10 <= len(pii.digits(m[0])) <= 15}
        for name, got in (("rules", set(own)), ("patterns", set(own) | by_shape), ("net", set(own) | set(more))):
            told[name][0] += len(got & set(want))
            told[name][1] += len(got - set(want) - set(own))
    total = sum(len(want) for _, want in test)
    assert told["rules"][0] == 0  # no rule reads these
    assert told["net"][0] > 0.9 * total and told["net"][1] < 0.1 * total
    assert told["patterns"][1] > 0.8 * total  # by shape alone, about as many are wrong as right


def test_spans_of_the_net_are_checked():
    good = [("email", "joe @ example . com"), ("email", "a.b (at) host (dot) org"), ("phone", "0049 89 1234567"), ("phone", "0171 2345678"), ("phone", "(0171) 234 5678"), ("phone", "017 555 7713"), ("phone", "01 23 45 67 89"), ("ip", "10[.]0[.]0[.]1"), ("card", "4111 1111 1111 1111")]
    good += [("phone", "0123456789"), ("phone", "1234 567890"), ("email", "joe at home dot org")]
    bad = [("email", "joe @ home"), ("email", "joe at home"), ("phone", "(012 3456789"), ("phone", "123 456 789"), ("phone", "1234567890123456"), ("phone", "12345678,901"), ("ip", "10.0.0.256"), ("card", "4111 1111 1111 1112")]
    assert all(pii.plausible(t, k) for k, t in good) and not any(pii.plausible(t, k) for k, t in bad)


def test_labelled_passages_come_from_documents(spark):
    from zlib import crc32

    rows = [(i, f"write to joe{i}@example.com as soon as you can or rather call +49 {i:03d} 5551234 when you have the time, said the man") for i in range(200)] + [(None, None), (900, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.labelled(docs, 20)
    assert 0 < len(got) <= 80 and got == pii.labelled(docs.repartition(5), 20)
    used = set()
    for text, ((start, end, kind),) in got:
        assert (start, end, kind) in pii.base_spans(text) and len(text) <= pii.WINDOW
        used |= {int(x) for x in re.findall(r"joe(\d+)@", text)}
    assert used and all(crc32(str(i).encode()) % 5 for i in used)
    assert pii.labelled(docs.limit(0)) == []


def test_windows_hold_all_that_can_be_a_span():
    text = "word " * 100 + "call (017) 555-7713 or 4111" + " word" * 200 + " bob [at] host.org"
    inside = lambda a, b: any(s <= a and b <= s + pii.WINDOW for s in pii.windows(text))
    for piece in ("(017) 555-7713", "4111", "bob [at] host.org"):
        at = text.index(piece)
        assert inside(at - 5, at + len(piece))
    assert len(pii.windows("no digit in here " * 100)) == 0


def test_long_spans_are_found_at_all_offsets():
    span = "firstname.lastname (at) department.university-name.example.com"
    for offset in range(0, pii.OVERLAP, 5):
        before = ("word " * 80)[: 191 + offset] + " "
        ((_, _, _, more),) = pii._search(pii.default_net(), [(0, (before + span + " und so weiter" * 10).encode())])
        assert (len(before), len(before) + len(span), "email") in more


def test_reconcile_keeps_the_most_confident_spans():
    spans = [(0, 10, "ip", 2.0), (0, 10, "ip", 1.0), (5, 15, "card", 2.5), (12, 20, "ip", 1.0), (30, 40, "ip", -1.0)]
    assert pii.reconcile(spans) == [(0, 10, "ip"), (12, 20, "ip")]


def test_gradients_of_the_net():
    net = bilstm_crf.Net.new(5, 3, 3, 1)
    for name in ("inputs", "state", "out", "bias", "moves", "begin"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = np.random.default_rng(0).integers(0, 5, (3, 6)), np.array([[0, 1, 2, 2, 0, 1]] * 3)
    penalty = bilstm_crf.allowed(["O", "B-a", "I-a"])
    _, grads = bilstm_crf.gradients(net, x, y, penalty)
    for p, g in zip(net.parameters(), grads, strict=True):
        i = np.unravel_index(np.argmax(abs(g)), g.shape)
        p[i] += 1e-2
        up = bilstm_crf.gradients(net, x, y, penalty)[0]
        p[i] -= 2e-2
        down = bilstm_crf.gradients(net, x, y, penalty)[0]
        p[i] += 1e-2
        assert abs(g[i] - (up - down) / 2e-2) < 1e-2


def test_personal_data_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    clear = odd.withColumn("n_chars", odd.n_words)
    out = pii.redact(clear)
    assert out.columns == clear.columns and out.filter("doc_id = 1").first().text is None
    mailed = spark.createDataFrame([(1, "to a.b@c.org now", 16)], "doc_id long, text string, n_chars long")
    assert tuple(pii.redact(mailed).first()) == (1, "to [EMAIL] now", 14)
    assert pii.find(odd.limit(0)).count() == 0
