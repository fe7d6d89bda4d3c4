"""Operators 1, 2, 4, 5, 6 and 8: held-out accuracy, brute force and round trips."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest

from sieveline.llm import decontaminate, language_id, pii, quality, secrets, token_file
from sieveline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None), (901, ""), (902, " \n\t 123 !!"), (903, "x" * 200_000), (None, "no id here"), (904, "twice"), (904, "twice")]
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["str", "ent", "ich", "ung"], "cc": ["ção", "nha", "oes", "eu"]}


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_id(spark):
    rng = random.Random(1)
    truth = {i: rng.choice(list(SYLLABLES)) for i in range(300)}
    rows = [(i, words(rng, SYLLABLES[lang], rng.randint(3, 60)), lang if i % 11 else None) for i, lang in truth.items()]
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows] + [(i, t, None, None, None) for i, t in ODD], SCHEMA)
    got = language_id.identified(df).collect()
    assert len(got) == len(rows) + len(ODD)
    main = {r.doc_id: r for r in got if r.doc_id in truth}
    assert np.mean([main[i].lang_pred == truth[i] for i in truth]) > 0.98
    assert all(r.held_out == held_out(r.doc_id) for r in main.values())
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)}
    assert odd == {900: ("und", 0.0), 901: ("und", 0.0), 902: ("und", 0.0)}
    kept = {r.doc_id for r in language_id.accepted(df).collect()}
    assert set(truth) <= kept and not kept & {900, 901, 902}
    one, same = language_id.trained(df), language_id.trained(df.repartition(9))
    assert one.langs == same.langs == ["aa", "bb", "cc"] and np.array_equal(one.whole, same.whole)
    assert language_id.identified(df.limit(0)).count() == 0


def brute_language_id(texts, of):
    """(language, score) by the method's definition: one trigram after another, a vector for each letter."""
    draw = lambda point: np.random.default_rng([7, point]).choice([-1, 1], language_id.DIM)
    out = []
    for text in texts:
        line = re.sub("_+", "_", "_" + "".join(c.lower()[0] if c.isalpha() else "_" for c in text or "") + "_")
        vector = {c: draw(0 if c == "_" else ord(c)) for c in set(line)}
        bundle = sum((vector[a] * np.roll(vector[b], 1) * np.roll(vector[c], 2) for a, b, c in zip(line, line[1:], line[2:]) if b != "_"), np.zeros(language_id.DIM))
        if not bundle.any():
            out.append(("und", 0.0))
            continue
        apart = bundle / np.sqrt(bundle @ bundle) - of.mean
        share = np.exp(language_id.SHARP * (of.centred @ apart) / np.sqrt(apart @ apart))
        out.append((of.langs[int(share.argmax())], share.max() / share.sum()))
    return out


def test_language_id_equals_brute_force_with_twenty_languages(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñßøåæçабвгдежзиклмнопрстуфхцч日本語中文字ΑΒΓΔαβγδ"
    kinds = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(8)] for k in range(20)}
    rows = []
    for i in range(400):
        lang = f"l{i % 20:02}"
        text = words(rng, kinds[lang], rng.randint(20, 60))
        rows.append((i, text.upper() if i % 7 == 0 else text.replace(" ", "\n1") if i % 5 == 0 else text, lang))
    junk = {1000: "日" * 3 + " ".join(chr(0x1200 + rng.randrange(300)) * 2 for _ in range(80)), 1001: "12 !! 34"}
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows] + [(i, t, None, None, None) for i, t in junk.items()], SCHEMA)
    got = {r.doc_id: r for r in language_id.identified(df).collect()}
    of = language_id.trained(df)
    want = brute_language_id([t for _, t, _ in rows], of)
    assert [got[i].lang_pred for i, _, _ in rows] == [x for x, _ in want]
    assert np.allclose([got[i].score for i, _, _ in rows], [p for _, p in want], atol=1e-6)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if held_out(i)]) > 0.98
    assert {r.doc_id for r in language_id.accepted(df).collect()} == {i for i, _, _ in rows}


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = words(rng, SYLLABLES["aa"], rng.randint(5, 80))
        t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "*** "), t.replace(" ", " | ")]) if bad else t.capitalize() + "."
        rows.append((i, t))
        if i % 5:
            labels.append((i, 0 if bad else 1, None))
    labels += [(1, 5, None), (2, None, None), (7777, 1, 0)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows + ODD], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scored(df, lab).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    seen = {r.doc_id: r for r in got}
    aside = [i for i, _ in rows if held_out(i)]
    assert np.mean([seen[i].predicted == (i % 4 != 0) for i in aside]) > 0.97
    flat = quality.scored(df, lab.filter("quality = 1")).select("score").distinct().collect()
    assert [r.score for r in flat] == [1.0]
    assert quality.scored(df.limit(0), lab).count() == 0


def test_quality_scores_equal_plain_python_on_whole_texts(spark):
    rng = random.Random(22)
    rows = [(i, words(rng, SYLLABLES["aa" if i % 2 else "bb"], rng.randint(5, 60))) for i in range(200)]
    more = [(500, "漢字" * 3000 + "。" * 9), (501, "!" * 500), (502, "x" * 100_000), (503, "a b a b !!!!!!!! c")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows + more + ODD], SCHEMA)
    lab = spark.createDataFrame([(i, i % 2, None) for i, _ in rows], "doc_id long, quality int, toxic int")
    context, network = quality.trained(df, lab)

    def vector(term):
        if term in context:
            return context[term]
        term = f"w#{min(len(term) - 2, 30)}" if term[0] == "w" else term
        return context.get(term, quality.index_vector(term) / np.sqrt(quality.NONZERO))

    def score(text):
        tokens = [t[k : k + quality.LONGEST] for t in (text or "").split() for k in range(0, len(t), quality.LONGEST)]
        x = np.zeros(2 * quality.DIM + 3)
        if tokens:
            m = np.array([sum(vector(t) for t in quality.terms(token)) for token in tokens], np.float64)
            share = max(tokens.count(t) for t in set(tokens)) / len(tokens) if len(tokens) < 3000 else max(np.unique(tokens, return_counts=True)[1]) / len(tokens)
            x = np.concatenate([m.mean(0), m.std(0), [np.log1p(len(tokens)), len(set(tokens)) / len(tokens), share]])
        z = np.clip((x - network.mean) / network.std, -8, 8)
        logit = np.maximum(z @ network.p[0] + network.p[1], 0) @ network.p[2] + network.p[3]
        return 1 / (1 + np.exp(-np.clip(logit / network.temperature, -30, 30)))

    got = sorted((r.doc_id or -1, r.score) for r in quality.scored(df, lab).collect())
    want = sorted((i or -1, score(t)) for i, t in rows + more + ODD)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([p for _, p in got], [p for _, p in want], atol=2e-3)
    # A text without white space is not judged by its first characters.
    lead = "漢字" * 20
    words_ = quality.Words(context)
    a, b = words_.pooled([lead + "かな" * 200, lead + "!?" * 200])
    assert not np.allclose(a, b)


def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_patterns_equal_brute_force():
    rng = random.Random(3)
    signs = ["@", ".", "-", " ", "+", "(", ")", "1", "25", "256", "0007", "4539148803436467", "a", "mail", "%", "é", "\n", "@@", "..", "10.0.0.1", "x@y.z", "555"]
    for _ in range(20_000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == brute_base(t), t


def test_pii(spark):
    model = pii.trained()
    chars, gold = pii.training_windows(300, seed=1234)
    hit = model.decode(chars) == gold
    assert hit.mean() > 0.97 and hit[gold > 0].mean() > 0.93
    texts = ["call (415) 555-2671 today", "write joe.doe (at) acme.org please", "paid 4539.1488.0343.6467 now", "ip 10.0.0.1, a@b.co +1 (499) 555-6503", "é" * 50 + " a@b.co", "the year 2024-01-02, 12:30, version 1.2.3"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(i, t, None, None, None) for i, t in ODD], SCHEMA)
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts) + len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[k].spans for k in range(6)] == ["phone:5:19", "email:6:27", "card:5:24", "email:13:19,ip:3:11,phone:20:37", "email:51:57", ""]
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert by[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    assert by[900].spans == by[903].spans == "" and pii.personal_data(df.limit(0)).count() == 0
    long = "word " * 20_000 + "(415) 555-2671 " + "word " * 500
    (_, more), = pii.found_spans(["mail john.smith at example dot com or look at polka dot dresses"], model)
    assert more == [("email", 5, 34)]
    (_, more), = pii.found_spans([long], model)
    assert more == [("phone", 100_000, 100_014)]


def test_windows_are_decoded_as_one_sequence():
    tagger, rng = pii.Tagger(seed=2), np.random.default_rng(3)
    tagger.p["t"], tagger.p["s"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)), rng.normal(0, 1, pii.TAGS)
    scores = rng.normal(0, 2, (8, pii.STRIDE, pii.TAGS)).astype(np.float32)
    first, whole = np.array([1, 0, 0, 1, 1, 0, 0, 0], bool), np.array([1, 0, 0, 0, 0, 0, 0, 0], bool)
    got = tagger.best_path(scores, first, whole)
    for a, b in ((0, 3), (3, 4), (4, 8)):
        rows = scores[a:b].reshape(-1, pii.TAGS).astype(float)
        best, back = rows[0] + tagger.p["s"] + np.where(whole[a] & np.isin(np.arange(pii.TAGS), [2, 4, 6, 8]), -1e4, 0), []
        for row in rows[1:]:
            paths = best[:, None] + tagger.p["t"] + pii._allowed()
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        assert got[a:b].ravel().tolist() == path[::-1]
    assert tagger.best_path(scores[:0], first[:0], whole[:0]).shape == (0, pii.STRIDE)


def test_tagger_gradients():
    tagger = pii.Tagger(seed=8)
    chars, gold = pii.training_windows(3, seed=5)
    chars, gold = chars[:, :9], gold[:, :9]
    _, grads = tagger._gradients(chars, gold)
    rng = np.random.default_rng(0)
    for name, p in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape) if name != "e" else (chars[0, 0], 3)
        eps = 1e-5
        p[at] += eps
        up = tagger._gradients(chars, gold)[0]
        p[at] -= 2 * eps
        down = tagger._gradients(chars, gold)[0]
        p[at] += eps
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-6), name


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 4097])
def test_packed_ids_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n), 50_000).astype(np.uint32)
    if n > 4:
        ids[:2] = [0, 2**31]
    assert np.array_equal(token_file.unpack(*token_file.pack(ids), n), ids)
    wide = rng.integers(0, 2**32, 70_000, dtype=np.uint32)
    assert np.array_equal(token_file.unpack(*token_file.pack(wide), len(wide)), wide)


def test_token_file(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(rng.randrange(10**6), words(rng, ["The", " ", "é", "'s", "\n\n", "12", "  ", "日本", "don't"], rng.randint(0, 50)), None) for _ in range(200)] + [(i, t, None) for i, t in ODD] + [(77, "<|endoftext|> x", None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], SCHEMA)
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((-1 if i is None else i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    blocks = token_file.written(df, tokenizer_path())
    got = token_file.index(blocks).orderBy("start").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert token_file.token_index(df.limit(0), tokenizer_path()).count() == 0


def test_ids_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_file, "REMEMBERED", 300)
    encode, rng = token_file.Encoder(tokenizer_path()), random.Random(7)
    signs = [" ", " ", "\n", "\t", "a", "B", "é", "日", "1", "12", "!", "'s", "'", "\xa0", "\u3000", "\r", "  ", "#", "\x1c", "\x85", "word", "\u200b", "😀", "\u0301", "<|endoftext|>", " the"]
    for _ in range(300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(40)]
        raw = [t.encode() for t in texts]
        got = encode(np.frombuffer(b"xx" + b"".join(raw), np.uint8), np.cumsum([2, *map(len, raw)]))
        for t, ids in zip(texts, got):
            assert ids.tolist() == encode.whole(t).tolist(), repr(t)


def test_secrets(spark):
    rows, y = secrets.labelled(99, 600)
    of, forest = secrets.trained()
    p = forest(np.array([secrets.features(*r, of, set()) for r in rows]))
    assert ((p >= 0.5) == y).mean() > 0.95
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [f'one token = "{hexes}" two', f"see commit {hexes} of main", f"TOKEN = \"{hexes.upper()}\"!! X", "a very-long-hyphenated-word-with-number-1 here", "plain words only"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(i, t, None, None, None) for i, t in ODD], SCHEMA)
    got = secrets.findings(df).collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in got) == [(0, hexes), (2, hexes.upper())]
    brute = [(i, *f[:2]) for i, t in enumerate(texts) for f in secrets.scan(t, of, forest) if f[-1] >= 0.5]
    assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted(brute)
    assert secrets.findings(df.limit(0)).count() == 0


def brute_candidates(text):
    """Spans by plain patterns without bounds, quadratic in the worst case."""
    name = r"[A-Za-z0-9_.-]*"
    assigned = re.compile(rf"(?i)({name}(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth){name})[\"']?\s*(?:=>|:=|=|:)\s*[\"']?([A-Za-z0-9+/_=.~-]{{8,}})")
    found = [(*m.span(2), "assigned") for m in assigned.finditer(text)]
    for kind, pattern in (("prefixed", secrets._PREFIXED), ("run", re.compile(r"[A-Za-z0-9+/_=-]{20,}"))):
        for m in pattern.finditer(text):
            fits = kind == "prefixed" or (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))
            if fits and all(m.end() <= a or b <= m.start() for a, b, _ in found):
                found.append((*m.span(), kind))
    return sorted(found)


def test_secret_candidates_equal_brute_force():
    rng = random.Random(11)
    parts = ["token", "api_key", "PASSWORD", "auth", " ", "=", ": ", " => ", '"', "'", ".", "-", "_", "a1B2", "0f9e8d7c", "word", "\n", "é", "ghp_" + "a1" * 18, "x" * 9, "{", "my."]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [c[:3] for c in secrets.candidates(text)] == brute_candidates(text), text


def test_secrets_of_any_length_and_repeated_ones():
    of, forest = secrets.trained()
    rng = random.Random(12)
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    long = "".join(rng.choice(wide) for _ in range(10_000))
    text = f"{'x' * 5000}_token = \"{long}\" and so on"
    (a, b, kind, name, score), = secrets.scan(text, of, forest)
    assert text[a:b] == long and kind == "assigned" and name == "x" * 5000 + "_token" and score >= 0.5
    for seed in range(20):
        rng = random.Random(seed)
        value = "".join(rng.choice(wide) for _ in range(40))
        line = f'some words here token = "{value}" more words there\n'
        one, two = secrets.scan(line, of, forest), secrets.scan(line + line, of, forest)
        assert [f[4] >= 0.5 for f in two] == [one[0][4] >= 0.5] * 2 == [True, True]


def test_secret_scores_equal_a_walk_through_the_trees(spark):
    of, forest = secrets.trained()

    def walk(tree, x, at=0):
        f, cut, low, high, share = tree[at]
        return share if f < 0 else walk(tree, x, int(low if x[int(f)] <= cut else high))

    rows, _ = secrets.labelled(7, 60)
    texts = [r[0] for r in rows] + [None, ""]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.start, r.end): r.score for r in secrets.findings(df).collect()}
    want = {}
    for i, t in enumerate(texts):
        found = secrets.candidates(t or "")
        around = t or ""
        for a, b, *_ in reversed(found):
            around = around[:a] + " " + around[b:]
        low = re.findall(r"[^\W\d_]{4,}", around.lower())
        own = {w[k : k + 4] for w in low if low.count(w) > 1 for k in range(len(w) - 3)}
        for c in found:
            x = secrets.features(t, *c, of, own)
            p = sum(walk(tree, x) for tree in forest.trees) / len(forest.trees)
            if p >= 0.5:
                want[(i, *c[:2])] = round(p, 6)
    assert got == want and want


def test_decontamination(spark):
    rng = random.Random(6)
    item = "Ana buys 12 apples for 3 dollars each and then sells half of them to Bob on the market at noon today"
    other = "Two trains leave the station at 9 and meet after 40 miles when one of them has lost its whole load"
    noise = lambda n: words(rng, SYLLABLES["aa"], n)
    texts = {
        1: f"{noise(20)}. {item} {noise(9)}",
        2: f"{noise(5)}. {item.replace('12', '97').replace('Bob', 'Zed')}. {noise(30)}",
        3: noise(60),
        4: " ".join(item.split()[:6]) + " " + noise(40),
        5: "Ana buys 12 apples for 3 dollars",
        6: f"{noise(3)} {other}",
        7: None,
        8: "",
    }
    items = [(1, item), (2, other), (3, None), (4, ""), (None, item), (5, "what is the least prime now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()] + [(None, item, None, None, None), (1, texts[1], None, None, None)], SCHEMA)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(1, 1), (2, 1), (6, 2)]
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in decontaminate.clean(df, bench).collect())
    assert kept == [-1, 3, 4, 5, 7, 8]
    clash = spark.createDataFrame([(1, "From 7 to 7 she counted all the 7 birds near the old 7 oaks by the river bank")], "item_id long, text string")
    same = "From {} to {} she counted all the {} birds near the old {} oaks by the river bank"
    df = spark.createDataFrame([(1, same.format(5, 5, 5, 5), None, None, None), (2, same.format(5, 6, 7, 8), None, None, None)], SCHEMA)
    assert [r.doc_id for r in decontaminate.leaks(df, clash).collect()] == [1]
    assert decontaminate.leaks(df.limit(0), clash).count() == 0 == decontaminate.leaks(df, clash.limit(0)).count()


def test_decontamination_of_several_occurrences(spark):
    rng = random.Random(16)
    item = "Ana buys 12 apples for 3 dollars each and then sells half of them to Bob on the market at noon today"
    noise = words(rng, SYLLABLES["aa"], 20)
    again = item.replace("12", "97").replace("Bob", "Zed")
    put_in = " ".join([*item.split()[:11], noise.split()[0], *item.split()[11:]])
    texts = {
        1: f"{noise}. {item}. {again}",
        2: f"{noise}. {item}. {noise}. {' '.join(again.split()[:9])}",
        3: f"{noise}. {put_in}. {noise}. {put_in.replace('12', '31')}",
        4: f"{noise}. {item.replace('12', '97')}",
        5: f"{noise}. {' '.join(item.split()[:12])}",
        6: noise,
    }
    bench = spark.createDataFrame([(1, item), (2, again)], "item_id long, text string")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(i, k) for i in (1, 2, 3, 4) for k in (1, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [5, 6]


def test_decontamination_of_short_and_numeric_items(spark):
    rng = random.Random(26)
    noise = lambda n: words(rng, SYLLABLES["aa"], n)
    long = noise(400).split()
    items = {1: "What is 37 times 48?", 2: "Solve 12 + 7 * 3 - 4 / 2", 3: " ".join(long), 4: "日本で一番高い山は何ですか。", 5: "Yes.", 6: "Add 1 2 3 4 5 6 7 8 9 and 10"}
    texts = {
        1: f"{noise(9)}. What is 37 times 48? {noise(9)}",
        2: f"{noise(9)}. What is 36 times 48? {noise(9)}",
        3: f"{noise(9)} solve 12 + 7 * 3 - 4 / 2 {noise(9)}",
        4: f"{noise(9)} {' '.join(long[150:250])} {noise(9)}",
        5: "これは本です。日本で一番高い山は何ですか。富士山です。",
        6: f"{noise(4)} yes {noise(4)}",
        7: "yes",
        8: f"{noise(9)} {' '.join(long[150:165])} {noise(9)}",
        9: f"{noise(5)} add 1 2 3 4 5 6 7 8 9 and 10",
        10: f"{noise(5)} add 1 2 3 4 5 7 8 9 6 and 11",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    # Text 2 asks item 1 with another number; text 10 is an enumeration of others.
    assert got == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (7, 5), (9, 6)]


def test_decontamination_whatever_the_case(spark):
    rng = random.Random(36)
    noise = lambda n: words(rng, SYLLABLES["aa"], n)
    named = "On Monday the old Anna met Bruno near Vienna and then Clara took Dora from Essen over Fulda to see Gera before Hanna came with Ines"
    items = {1: named, 2: "Which of these rivers is the longest one"}
    texts = {
        1: f"{noise(9)}. {named.lower()} {noise(9)}",
        2: f"{noise(9)}. {named.upper()} {noise(9)}",
        3: f"{noise(9)} {items[2]} {noise(9)}",
        4: f"{noise(9)} x.&&& {items[2]} {noise(9)}",
        5: f"{noise(9)}. {named.replace('Bruno', 'Boris')} {noise(9)}",
        6: f"{noise(9)} {items[2].replace('rivers', 'trees')} {noise(9)}",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 1)]


def test_language_id_takes_long_texts_and_large_alphabets_in_bounded_memory():
    rng = random.Random(46)
    line = lambda n: "".join(rng.choice("ab cd日本 語éß") for _ in range(n))
    texts = [line(700), "", line(90), None, "..", line(9), line(333)]
    size = language_id.TOGETHER_LETTERS, language_id.SLICE
    whole = {row: (bundle, n) for row, bundle, n in language_id._bundles([t or "" for t in texts])}
    try:
        language_id.TOGETHER_LETTERS, language_id.SLICE = 64, 7
        pieces = {row: (bundle, n) for row, bundle, n in language_id._bundles([t or "" for t in texts])}
    finally:
        language_id.TOGETHER_LETTERS, language_id.SLICE = size
    assert set(whole) == set(pieces) == {0, 2, 5, 6}
    assert all(np.array_equal(whole[k][0], pieces[k][0]) and whole[k][1] == pieces[k][1] for k in whole)
    code = """
import random, resource
from sieveline.llm import language_id
rng = random.Random(1)
cjk = lambda n: "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(n))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for texts in ([cjk(1000) for _ in range(256)], [cjk(1_000_000)]):
    assert sum(1 for _ in language_id._bundles(texts)) == len(texts)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    peak = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout)
    assert peak < 400, peak


def test_template_words():
    of = lambda text: [w for t in text.split() for w in decontaminate.template_words(t)]
    number, unit, word, sign = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.WORD, decontaminate.SIGN
    assert of("5km (12kg), seven -- Twenty-one") == [(number, "5"), (unit, "km"), (number, "12"), (unit, "kg"), (number, "7"), (sign, "--"), (number, "20"), (number, "1")]
    assert of("3x+4=10") == [(number, "3"), (word, "x"), (sign, "+"), (number, "4"), (sign, "="), (number, "10")]
    assert of("covid19 well-known 1,000.5 $40 ...") == [(word, "covid19"), (word, "well-known"), (number, "1,000.5"), (number, "$40")]
    raw = "drives 5 km in 3 h and in s. m 7".encode()
    kinds = decontaminate.Templates()(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]
    assert kinds.tolist() == [word, number, unit, word, number, unit, word, word, word, word, number]


def brute_templates(text):
    """(kind, value, word) of each template word of a text, one token after another."""
    out, opens = [], True
    for token in (text or "").split():
        core = token.strip(decontaminate._SIGNS)
        parts = decontaminate.template_words(token)
        for kind, value in parts:
            if kind == decontaminate.WORD and len(parts) == 1 and not opens and len(core) > 1 and core[0].isupper() and core[1:].islower():
                kind = decontaminate.NAME
            if kind == decontaminate.UNIT and not (out and out[-1][0] == decontaminate.NUMBER):
                kind = decontaminate.WORD
            out.append((kind, value))
        opens = not core or bool(decontaminate._ENDS.search(token))
    return out


def brute_windows(words, width):
    """(form, content, place, slots) of the windows of one text."""
    d = decontaminate
    for at in range(len(words) - width + 1):
        part = words[at : at + width]
        count = lambda kind: sum(k == kind for k, _ in part)  # noqa: B023, E731
        plain, names, signs = count(d.WORD), count(d.NAME), count(d.SIGN)
        if width < d.ALONE and len(words) != width:
            continue
        shown = lambda kinds: tuple(str(k) if k in kinds else "=" + v for k, v in part)  # noqa: B023, E731
        slots = lambda kinds: "\x1f".join(f"{k}{v}" for k, v in part if k in kinds)  # noqa: B023, E731
        few = min(d.FEW, width)
        asks = plain >= min(d.PROSE, width) if names else plain > 0 and plain + signs >= few
        named = names > 0 and plain + names + signs >= few
        if asks:
            yield d.TEMPLATE, shown((d.NUMBER, d.NAME, d.UNIT)), at, slots((d.NUMBER, d.NAME, d.UNIT))
        if named:
            yield d.NAMED, shown((d.NUMBER, d.UNIT)), at, slots((d.NUMBER, d.UNIT))
        if not asks and not named:
            yield d.LITERALLY, shown(()), at, ""


def brute_leaks(texts, items):
    """Every text against every item: their windows by content, then judged()."""
    out = {}
    for item_id, item in items.items():
        words_ = brute_templates(item)
        width = min(len(words_), decontaminate.WIDTH)
        own = list(brute_windows(words_, width)) if width else []
        places = lambda forms: len({at for f, _, at, _ in own if f in forms})  # noqa: B023, E731
        usable = [places((0,)), places((0, 1)), places((0, 1, 2))]
        for doc_id, text in texts.items():
            met = [(a, b) for a in brute_windows(brute_templates(text), width) for b in own if a[1] == b[1]] if width else []
            if met:
                column = lambda side, k: [m[side][k] for m in met]  # noqa: B023, E731
                got = decontaminate.judged(np.array(column(0, 2)), np.array(column(1, 2)), column(0, 3), column(1, 3), np.array(column(1, 0)), len(words_), usable)
                if got:
                    out[doc_id, item_id] = got
    return out


ASKED = [
    "If {A} walks {n} km in {m} hours, how many km does {B} walk in {k} hours at the same pace",
    "What is {n} times {m}?",
    "Solve for x: {n}x+{m}={k}",
    "A box holds {n} red and {m} blue balls; {A} takes {k} of them without looking. How many are left?",
    "Add {n}kg to {m}kg and give the sum",
    "{A} has seven cats, buys {n} more and gives {m} of them to {B} before the end of the week",
]


def asked(rng, template):
    names = rng.sample(["Anna", "Bruno", "Clara", "Dora", "Emil", "Fritz", "Gustav"], 2)
    n, m, k = rng.sample(range(11, 99), 3)
    return template.format(A=names[0], B=names[1], n=n, m=m, k=k).replace("seven", rng.choice(["seven", "nine", "four"]))


def test_decontamination_equals_brute_force_and_recalls_other_parameters(spark):
    rng = random.Random(56)
    noise = lambda n: words(rng, SYLLABLES["aa"], n)
    items = {i: asked(rng, t) for i, t in enumerate(ASKED)} | {50: noise(30), 51: "Yes.", 52: "1 2 3 4 5 6 7 8 9 10 11", 53: None, 54: "x=3"}
    texts, planted = {}, set()
    for i in range(150):
        k = rng.randrange(len(ASKED))
        if i % 3 == 0:
            planted.add((i, k))
            texts[i] = f"{noise(rng.randint(0, 30))}. {asked(rng, ASKED[k])} {noise(rng.randint(0, 30))}"
        elif i % 3 == 1:
            texts[i] = noise(40)
        else:
            # Half of an item, its words turned round, and numbers by themselves.
            own = asked(rng, ASKED[k]).split()
            texts[i] = f"{noise(5)} {' '.join(own[::-1])} {noise(5)} {rng.randint(1, 9)} km in 4 h {rng.randint(1, 9)} {noise(3)}"
    texts |= {200: items[50].upper(), 201: "yes", 202: f"so {items[52]}", 203: "so 2 3 4 5 6 7 8 9 10 11 12 13 14", 204: None, 205: "", 206: f"{items[50]} {items[0]}", 207: "x=4"}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, round(r.share, 9)) for r in decontaminate.leaks(df, bench).collect()}
    want = {k: (n, round(share, 9)) for k, (n, share) in brute_leaks(texts, items).items()}
    assert got == want
    assert len(planted & set(got)) >= 0.9 * len(planted)
    assert {i for i, _ in got if i < 200} <= {i for i, _ in planted}
