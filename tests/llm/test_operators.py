"""The numbered operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, fingerprint, langid, neardup, pii, quality, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", "  \n\t ", "same same", "same same", "é" * 5000, "word " * 20000, "+1 (389) 555-5010 x@y.example.com 10.0.0.1"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and very long texts, with columns whose names clash with the operators' own."""
    rows = [(i, t, None, None, 0) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "key", "label", "score", "part", "n", "a", "b", "digest", "shard")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_matches_tiktoken_and_round_trips(odd, docs):
    path, pattern = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    every = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    for r in bpe.digests(every, path, pattern).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(every, path, pattern), path).collect()} == texts


def test_bpe_head_is_bounded_and_changes_no_id(spark, odd, docs, monkeypatch):
    path, pattern = bpe.vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    every = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100000).alias("doc_id"), "text"))
    count = {}
    for r in every.collect():
        for w in bpe.regex.findall(pattern, r.text or ""):
            count[w] = count.get(w, 0) + 1
    assert {r.word: r.n for r in bpe.counted(every, path, pattern).collect()} == {w: n for w, n in count.items() if len(w) <= bpe.HEAD_BYTES}
    whole = bpe.head(every, path, pattern)
    assert whole.keys() == {w for w, n in count.items() if n > 1 and len(w) <= bpe.HEAD_BYTES} and all(list(ids) == own.encode_ordinary(w) for w, ids in whole.items())
    want = sorted(bpe.digests(every, path, pattern).collect())
    for most in (0, 50, 1000):
        monkeypatch.setattr(bpe, "HEAD_WORDS", most)
        few = bpe.head(every, path, pattern)
        assert len(few) <= most and min((count[w] for w in few), default=math.inf) >= max((n for w, n in count.items() if w in whole and w not in few), default=0)
        assert sorted(bpe.digests(every, path, pattern).collect()) == want


def test_langid_sums_all_segmentations():
    m = langid.Model(["a", "b"], {"▁a": (0.1, 0.2), "a": (0.3, 0.1), "aa": (0.01, 0.05)}, 3, 1e-7)
    text = "▁aaab"
    for k in range(2):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            p = 1.0
            for a, b in zip([0, *ends], ends):
                piece = text[a:b]
                p *= m.pieces[piece][k] if piece in m.pieces else 1e-7 if len(piece) == 1 else 0.0
            total += p
        assert m.word("aaab")[k] == pytest.approx(math.log(total))


def enumerated(text, pieces, unseen):
    """(probability, pieces) of every segmentation."""
    out = []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
        parts, p = [text[a:b] for a, b in zip([0, *ends], ends)], 1.0
        for piece in parts:
            p *= pieces[piece] if piece in pieces else unseen if len(piece) == 1 else 0.0
        out.append((p, parts))
    return out


def test_langid_expects_what_enumeration_expects():
    pieces = {"▁a": 0.1, "a": 0.3, "aa": 0.01, "ab": 0.2, "ba": 0.05, "aba": 0.02}
    for word in ("aab", "abab", "c", "aacba", "baaab"):
        found = langid.expected([("x", word, 3)], {"x": pieces}, 3, 1e-7)
        every = enumerated("▁" + word, pieces, 1e-7)
        total = sum(p for p, _ in every)
        want = {}
        for p, parts in every:
            for piece in parts if p else ():
                want[piece] = want.get(piece, 0.0) + 3 * p / total
        assert {k[1]: pytest.approx(v) for k, v in found.items()} == want


def test_langid_takes_whole_words_however_long_or_unlikely(monkeypatch):
    pieces = {"▁a": (0.1, 0.02), "a": (0.03, 0.1), "ab": (0.2, 1e-9), "b": (1e-9, 1e-9), "bab": (1e-5, 0.2)}
    m = langid.Model(["x", "y"], pieces, 3, 1e-7)
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=k)) for k in [*range(1, 40), 80, 300, 5000]] + ["c" * 36, "b" * 36]
    assert np.allclose(m.words(words), [m.word(w) for w in words])
    own = {"x": {k: v[0] for k, v in pieces.items()}}
    for word in (*words[:20], "c" * 36):  # sums and logarithms agree
        arcs = langid.arcs_of("▁" + word, own["x"], 3, 1e-7)
        plain = langid.shares(arcs)
        monkeypatch.setattr(langid, "TINY", math.inf)
        assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(plain, langid.shares(arcs)))
        monkeypatch.undo()
    for word in ("c" * 500, "ab" * 1000):  # every character of a word is in one piece of each segmentation
        found = langid.expected([("x", word, 1)], own, 3, 1e-7)
        assert sum(len(k[1]) * v for k, v in found.items()) == pytest.approx(len(word) + 1)


def test_langid_held_out_accuracy_and_odd_texts(spark, docs, odd):
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97
    model = langid.fit(docs, langid.vocabulary(), langid.Settings(rounds=1))
    found = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert {found[i].lang_pred for i in (0, 1, 3)} == {"und"} and all(0 <= r.score <= 1 for r in found.values())
    nothing = langid.fit(docs.limit(0), langid.vocabulary())
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def edits(piece, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_decontam_finds_what_full_alignment_finds():
    rng, letters, s = random.Random(5), "abcdefghijklmnop ", decontam.Settings()
    items = [(i, decontam.normal("".join(rng.choices(letters, k=rng.randint(60, 200))))) for i in range(5)]
    index = decontam.build(items, s)
    for _ in range(60):
        _, text = rng.choice(items)
        own = list(text[: rng.choice([70, 90, 130])])
        for _ in range(rng.randint(0, 9)):
            j = rng.randrange(len(own))
            own[j : j + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        doc = decontam.normal("".join(rng.choices(letters, k=150)) + "".join(own) + "".join(rng.choices(letters, k=150)))
        x = decontam.points(doc)
        got = {r[0] for r in decontam.regions(doc, x, decontam.grams(x, s.q), index)}
        assert got == {p[0] for p in index.pieces if edits(p[2], doc) <= p[3]}


def test_decontam_finds_every_copied_run(spark):
    """Runs of ``least`` characters from anywhere in an item, with up to ``budget`` edits, are found whatever their place; unrelated texts are not."""
    rng, letters, s = random.Random(6), "abcdefghijklmnopqrst ", decontam.Settings()
    items = [(i, decontam.normal("".join(rng.choices(letters, k=600)))) for i in range(4)]
    index = decontam.build(items, s)
    for edits_made in (0, 1, 3, 6):
        for length in (s.least, s.least + 1, 130, 300):
            for _ in range(12):
                item, text = rng.choice(items)
                at = rng.randrange(len(text) - length + 1)
                own = list(text[at : at + length])
                for j in rng.sample(range(len(own)), edits_made):
                    own[j] = rng.choice(["", "z", own[j] + "z"])
                noise = ["".join(rng.choices(letters, k=120)) for _ in range(2)]
                assert item in {r[0] for r in decontam.looked_for(noise[0] + "".join(own) + noise[1], index, s.q)} and not decontam.looked_for("".join(noise), index, s.q)
    small = decontam.Settings(broadcast_chars=700)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, items[0][1]), (2, items[3][1][100:300]), (2, "fine"), (None, "fine"), (3, None)], "doc_id long, text string")
    assert len(list(decontam.groups(bench, small))) == 4
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench, small).collect()} == {(1, 0), (2, 3)}
    assert [(r.doc_id, r.text) for r in decontam.clean(docs, bench, small).collect()] == [(2, "fine"), (None, "fine"), (3, None)]


def test_decontam_edges(spark, odd):
    bench = spark.createDataFrame([(1, "word " * 20), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(odd, bench).collect()} == {(7, 1)}
    assert decontam.find(odd, bench.limit(0)).count() == decontam.find(odd.limit(0), bench).count() == decontam.clean(odd.limit(0), bench).count() == 0
    assert decontam.clean(odd, bench).count() == len(ODD) - 1


def test_chat_reads_back(spark):
    rng = random.Random(2)
    for _ in range(3000):
        role, text = rng.choice(["user", "as\\s\nist", "assistant", ""]), "".join(rng.choices([*chat.CONTROL, "<", "\\", "|", "\n", "a"], k=rng.randint(0, 8)))
        whole = "".join(chat.Visitor(chat.Settings(), role).turn([{"kind": "text", "text": text}]).out)
        assert chat.read_back(whole) == [(role, text)]


def test_chat_parts_and_digests(spark):
    parts = [{"kind": "text", "text": "see "}, {"kind": "image", "ref": "i", "width": 56.0, "height": 30.0}, {"kind": "audio", "ref": "s", "seconds": 2.0}, {"kind": "document", "ref": "d", "pages": 2.0}]
    v = chat.Visitor(chat.Settings(), "assistant").turn(parts)
    assert [(k, r, n) for _, k, r, n in v.attached] == [("image", "i", 4), ("audio", "s", 50), ("document", "d", 512)]
    rows = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (2, 0, None, "", 0)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.conversations(chat.render(rows)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert got[2].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.conversations(chat.render(rows.limit(0))).count() == 0


def test_chat_defines_odd_parts(spark):
    rows = [
        (1, 0, "user", [None, {"kind": None, "text": "a"}, {"kind": "video", "ref": "v"}, {"kind": "image", "ref": "i", "width": float("nan"), "height": float("inf")}]),
        (1, 1, "assistant", [{"kind": "text", "text": "<|image|>\\"}, {"kind": "audio", "seconds": -3.0}, {"kind": "document", "pages": 0.0}, {"kind": "text", "text": "b"}]),
        (2, 0, "assistant", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("text", F.lit("unread"))
    got = {(r.conv_id, r.turn): r for r in chat.render(df).collect()}
    assert [(a.kind, a.ref, a.tokens) for a in got[1, 0].attached] == [("video", "v", 1), ("image", "i", 1)]
    assert [(a.kind, a.tokens) for a in got[1, 1].attached] == [("audio", 1), ("document", 256)] and got[1, 1].expanded_tokens == 257
    for r in got.values():
        assert all(r.formatted[a.position :].startswith(chat.PLACEHOLDER.get(a.kind, chat.OTHER)) for a in r.attached)
    assert chat.read_back(got[1, 1].formatted) == [("assistant", "<|image|>\\b")]
    assert [chat.unescape(got[1, 1].formatted[x.start : x.end]) for x in got[1, 1].loss] == ["<|image|>\\", "b"]
    found = {r.conv_id: r for r in chat.conversations(chat.render(df)).collect()}
    assert (found[1].n_attachments, found[1].expanded_tokens, found[2].n_turns) == (4, 259, 1)
    clash = spark.createDataFrame([(1, 0, "user", "t", 5)], "conv_id long, turn long, role string, text string, parts int")
    assert chat.read_back(chat.render(clash).first().formatted) == [("user", "t")]


def test_chat_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == turns.keys()
    for conv, own in turns.items():
        loss = "".join(text for role, text in own if role == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(loss))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_ftrl_matches_the_written_out_update(spark):
    rng, s = random.Random(8), toxicity.Settings(l1=0.4)
    model, z, n = toxicity.Ftrl(s), {}, {}
    bias = 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else s.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(400):
        at, label = sorted(rng.sample(range(30), 6)), rng.randint(0, 1)
        own = [*at, bias]
        w = [weight(i) for i in own]
        g = 1 / (1 + math.exp(-sum(w))) - label
        for i, x in zip(own, w):
            before = n.get(i, 0.0)
            n[i] = before + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / s.alpha * x
        assert model.learn(np.array(at), label) - label == pytest.approx(g)
    assert model.weights(np.array([*range(30), bias])) == pytest.approx([weight(i) for i in (*range(30), bias)])


def test_toxicity(spark, odd, docs):
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95
    flat = toxicity.fit(odd.select("doc_id", "text", F.lit(0).alias("label")).limit(0))
    assert {r.score for r in toxicity.score(odd, flat).collect()} == {0.5} and toxicity.drop_toxic(odd, flat).where("text IS NULL OR text = ''").count() == 2


def naive_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return pii.in_order(out)


def test_pii_base_spans_and_tagger(spark, odd, docs):
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choices("a@.1250 +-()@.", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == naive_spans(text)
    model = pii.fit(docs, pii.Settings(epochs=1))
    for r in pii.find(odd, model).collect():
        text = ODD[r.doc_id] or ""
        base = naive_spans(text)
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest() and {pii.written([b]) for b in base} <= set(r.spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redact(odd, model).collect()}
    assert clean[1] is None and "555-5010" not in clean[8] and "example" not in clean[8]
    assert pii.tag(["1" * 10], pii.fit(docs.limit(0)), pii.Settings()) == [[]]


def test_pii_disguised_addresses_without_digit_or_at(spark):
    rng, letters = random.Random(11), "abcdefghijklmnopqrstuvwxyz"

    def word(k=None):
        return "".join(rng.choices(letters, k=k or rng.randint(2, 8)))

    def address():
        return f"{word()}.{word()}@mail.{word()}.com"

    rows = [(i, f"{' '.join(word() for _ in range(20))} {address()} {' '.join(word() for _ in range(20))}.") for i in range(400)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [(i, address().replace("@", rng.choice([" (at) ", " [at] "]))) for i in range(60)]
    texts = {i: f"{' '.join(word() for _ in range(30 * (i % 4)))} {a} {' '.join(word() for _ in range(10))}." for i, a in held}
    assert not any(pii.TELL.search(t) for t in texts.values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(docs, model).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    hit = sum(spans[i] == f"email:{texts[i].index(a)}:{texts[i].index(a) + len(a)}" for i, a in held)
    assert hit >= 50 and sum("[email]" in clean[i] and a not in clean[i] for i, a in held) >= hit


def test_pii_decode_is_viterbi(docs):
    texts, s = [r.text for r in docs.where("text rlike '[0-9]@|@[a-z]'").orderBy("doc_id").limit(20).collect()], pii.Settings()
    model = pii.fit(docs)
    x = np.concatenate([pii.cut_windows(pii.codes(t), s.span, s.span - s.lap) for t in texts])
    got, want = model.decode(x), model.viterbi(x)
    assert (got == want).mean() > 0.9999 and want.any()
    sizes = np.sort(np.random.default_rng(1).integers(1, s.span + 1, len(x)))[::-1]
    short = model.decode(x, sizes)  # rows of several lengths: each as if it were alone
    for k in range(0, len(x), 7):
        assert (short[k, : sizes[k]] == model.viterbi(x[k : k + 1, : sizes[k]])[0]).mean() > 0.99 and not short[k, sizes[k] :].any()
    assert [pii.tag([t], model, s)[0] for t in texts] == pii.tag(texts, model, s)


def test_pii_decodes_without_tanh_and_with_large_weights(monkeypatch):
    """States are those of learning, whatever the weights, and need no tanh, which costs twice as much as exp without AVX-512."""
    x, sizes = np.random.default_rng(3).integers(1, pii.CHARS, (9, 40)).astype(np.uint8), np.array([40, 40, 31, 31, 17, 5, 2, 1, 1])
    for scale in (1, 300):
        model = pii.Tagger(16)
        model.p = {k: v * np.float32(scale) for k, v in model.p.items()}
        want = [[model._run(x[i : i + 1, :k], d, False)[0][:, 0] for d in "fb"] for i, k in enumerate(sizes)]
        with monkeypatch.context() as m, np.errstate(all="raise", under="ignore"):
            m.setattr(np, "tanh", None)
            got = model._states(x, sizes)
        for i, k in enumerate(sizes):
            steps = k if scale == 1 else 1  # large weights make steps that follow out of rounding
            assert np.abs(got[0, :steps, i] - want[i][0][:steps]).max() < 1e-4 and np.abs(got[1, k - steps : k, i] - want[i][1][k - steps :]).max() < 1e-4
            assert np.abs(got[:, :k, i]).max() <= 1 and not got[:, k:, i].any()


def test_pii_repeated_windows_are_decoded_once_and_searches_are_pooled(monkeypatch):
    rng, s, model = random.Random(5), pii.Settings(), pii.Tagger(16)
    texts = ["".join(rng.choices("ab @.1\u00e9\u4e2d", k=k)) for k in (700, 40, 300, 1000)]
    want, rows, searches = [pii.tag([t], model, s)[0] for t in texts], [], []
    decode, paths = pii.Tagger.decode, pii.Tagger._paths
    monkeypatch.setattr(pii.Tagger, "decode", lambda self, x, sizes=None: rows.append(len(x)) or decode(self, x, sizes))
    monkeypatch.setattr(pii.Tagger, "_paths", lambda self, e, sizes: searches.append(len(sizes)) or paths(self, e, sizes))
    assert any(want) and pii.tag(texts * 300, model, s) == want * 300
    assert rows == [sum(len(pii.windows(len(t) + len(pii.END), s.span, s.span - s.lap)) for t in texts)] and len(searches) == 1
    monkeypatch.setattr(pii, "RUN_WINDOWS", 3)
    assert pii.tag(texts, model, s) == want


def test_pii_held_out_spans_that_patterns_miss(spark):
    """Recall and precision by kind on disguised spans of documents that were not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    model, s = pii.fit(docs.where("doc_id % 2 = 0")), pii.Settings()
    held = [r.text for r in docs.where("doc_id % 2 = 1").orderBy("doc_id").collect() if r.text]
    found, wrong = {k: [0, 0] for k in pii.KINDS}, 0
    for i, text in enumerate(held):
        base = pii.base_spans(text)
        if not base:
            continue
        changed, own = pii.disguised(text, base, np.random.default_rng(i))
        still = pii.base_spans(changed)
        every = pii.merged(changed, still, pii.tag([changed], model, s)[0])
        missed = [x for x in own if all(x[2] <= b[1] or b[2] <= x[1] for b in still)]
        for x in missed:
            found[x[0]][0] += x in every
            found[x[0]][1] += 1
        wrong += sum(x not in still and all(x[2] <= o[1] or o[2] <= x[1] for o in own) for x in every)
    hits, many = (sum(v[k] for v in found.values()) for k in (0, 1))
    assert many > 50 and hits > 0.85 * many and wrong < 0.1 * many, (found, wrong)
    plain = [t for t in held if not pii.base_spans(t)][:500]
    assert sum(map(len, pii.tag(plain, model, s))) <= 10


def test_pii_windows_are_reconciled_by_the_farther_edge():
    rng, width, stride = np.random.default_rng(3), 16, 10
    for n in (1, 5, 16, 17, 26, 27, 100, 333):
        starts = pii.windows(n, width, stride)
        decoded = rng.integers(0, 9, (len(starts), width)).astype(np.int8)
        want = []
        for c in range(n):
            over = [k for k, a in enumerate(starts) if a <= c < a + width]
            # the distance to an edge that has text behind it
            edge = {k: min(c - starts[k] if k else width, starts[k] + width - 1 - c if k < len(starts) - 1 else width) for k in over}
            best = max(edge.values())
            want.append(int(decoded[min(k for k in over if edge[k] == best), c - starts[min(k for k in over if edge[k] == best)]]))
        got = pii.reconciled(decoded, n, stride)
        assert got.tolist() == want
    text = "x" * 300 + " anna (at) mail.example.com " + "y" * 700
    assert pii.cut_windows(pii.codes(text), 256, 224).shape == (5, 256)


def test_crf_sums_all_tag_sequences():
    m, rng = pii.Tagger(3), np.random.default_rng(1)
    m.p = {k: v + rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in m.p.items()}
    x, y = rng.integers(1, 130, (1, 4)), pii.tags_of(4, [("card", 1, 3)])[None]
    e, move = m.scores(x)[0][:, 0].astype(float), (m.p["t"] + m.bar).astype(float)

    def path(tags):
        return m.p["s"][tags[0]] + sum(e[i, t] for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:]))

    every = {tags: path(tags) for tags in itertools.product(range(pii.TAGS), repeat=4)}
    best = max(every, key=every.get)
    assert tuple(m.viterbi(x)[0]) == best
    loss = np.logaddexp.reduce(list(every.values())) - every[tuple(y[0])]
    assert m.learn(x, y, 0.0) == pytest.approx(loss, rel=1e-4)


def test_crf_gradient_is_the_likelihoods():
    m, rng = pii.Tagger(3), np.random.default_rng(0)
    x, y = rng.integers(1, 130, (4, 12)), pii.tags_of(12, [("ip", 2, 6)])[None].repeat(4, 0)
    losses = [m.learn(x, y, 0.05) for _ in range(40)]
    assert losses[-1] < 0.3 * losses[0] and (m.viterbi(x) == y).mean() > 0.9


def brute_components(texts, words=2):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(s) for s in sets], root


def test_near_duplicates_match_brute_force(spark):
    rng, rows = random.Random(1), list(ODD)
    words = [f"w{i}" for i in range(300)]
    shared = rng.choices(words, k=60)
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(5, 80))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += [" ".join(shared + rng.choices(words, k=rng.randint(0, 20))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, label int")
    got = sorted(neardup.near_duplicates(df).collect())
    sizes, root = brute_components(rows)
    assert [(r.n_shingles, r.component_id) for r in got] == list(zip(sizes, root))
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.distinct_documents(df).count() == len(set(root))


def test_near_duplicates_of_ids_that_repeat_and_copies_in_crowds(spark):
    """Each text of a repeated id keeps its links, a crowd of near copies is one group, and nothing but the result stays in the shared folder."""
    import os

    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d = (" ".join(rng.choices(words, k=60)) for _ in range(4))

    def near(text):
        return text.rsplit(" ", 2)[0] + " x y"

    rows = [(5, a), (5, b), (9, near(a)), (11, near(b)), (12, c), (12, c), (13, near(c)), (20, None), (20, a), (21, ""), (21, "")]
    crowd = [(100 + i, d if i % 3 else near(d) + f" z{i}") for i in range(1200)] + [(2000 + i, " ".join(rng.choices(words, k=40))) for i in range(100)]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    tables = spark.catalog.listTables()
    found = neardup.near_duplicates(spark.createDataFrame(rows + crowd, "doc_id long, text string")).collect()
    assert len(set(os.listdir(folder)) - before) == 1 and spark.catalog.listTables() == tables
    got = sorted((r.doc_id, r.component_id) for r in found if r.doc_id < 100)
    assert got == sorted([(5, 5)] * 2 + [(9, 5), (11, 5)] + [(12, 12)] * 2 + [(13, 12)] + [(20, 5)] * 2 + [(21, 21)] * 2)
    assert {r.component_id for r in found if 100 <= r.doc_id < 2000} == {100} and all(r.component_id == r.doc_id for r in found if r.doc_id >= 2000)


def test_near_duplicates_lose_no_link_on_whole_tables(spark):
    """Recall against all pairs: every link that brute force finds among 1,000 documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    _, root = brute_components([r.text for r in rows])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {r.doc_id: rows[k].doc_id for r, k in zip(rows, root)} and len(set(root)) < len(rows) - 50


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k, i) for i in range(3000) for k in (0, i % 2, i)], "key long, id long")
    facts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    for how in ("inner", "left"):
        want = sorted(rows.join(facts, "key", how).collect(), key=str)
        assert sorted(neardup.by_key(rows, facts, "key", "n", rows.count(), how).collect(), key=str) == want


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b = keys[:2400], keys[600:]
    ra, rb = (neardup.registers(k, 1024, 1.001) for k in (a, b))
    assert (neardup.merge(ra, rb) == neardup.registers(keys, 1024, 1.001)).all()
    assert abs(neardup.estimate(ra[None], rb[None], np.array([2400.0]), np.array([2400.0]), 1.001)[0] - 0.6) < 0.06


def test_warc_records_are_linked(spark):
    page = "<html lang='de'><title>T &amp; t</title><script>x<p></script><p>Ein<br>Text</p><!-- c --><a href='/a?b=1&amp;c'>l</a>"
    rows = spark.createDataFrame([(1, "http://x.example/", page, "z"), (2, None, None, "z"), (3, "u", "<script>open", "z")], "page_id long, url string, html string, record string")
    found = warc.responses(rows)
    ids = {r.page_id: r.record_id for r in found.collect()}
    got = {(r.page_id, r.record_type): r for r in warc.derivatives(found).collect()}
    assert len(got) == 6 and all(r.refers_to == ids[k[0]] for k, r in got.items())
    assert got[1, "conversion"].record.split("\r\n\r\n")[1] == "T & t\nEin\nText\nl"
    assert "outlink: /a?b=1&c\r\n" in got[1, "metadata"].record and got[3, "conversion"].content_length == 0
    for r in got.values():
        block = r.record.encode().split(b"\r\n\r\n", 1)[1][:-4]
        assert len(block) == r.content_length and warc.digest(block) == r.block_digest


def test_warc_reads_what_is_shown_in_linear_time(spark):
    import time

    page = warc.read("<!-- <html lang=xx><a href=no> --><script><title>no</title><a href='no'></script><HTML lang=en><title>T</title><a href=x>1</a><a class=b href = \"y&amp;z\">2</a><a name=q>3")
    assert (page.title, page.lang, page.links) == ("T", "en", ["x", "y&z"]) and page.text == "T\n123"
    for bad in ("<a ", "<html ", "<title ", "<script ", "<!-- ", "<a href=\"", "<a x='", "<", "&lt", "<p", "</script "):
        began = time.perf_counter()
        warc.read(bad * 100_000)
        assert time.perf_counter() - began < 5, bad
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(none)).count() == 0


def test_quality_gradient_is_the_likelihoods():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, raw, grade, e = rng.normal(), rng.normal(size=3), int(rng.integers(0, 4)), 1e-6
        g, up, _ = quality.slopes(x, raw, grade)

        def like(x, raw):
            return math.log(quality.slopes(x, raw, grade)[2])

        assert g == pytest.approx((like(x + e, raw) - like(x - e, raw)) / (2 * e), rel=1e-3, abs=1e-5)
        for k in range(3):
            d = np.eye(3)[k] * e
            assert up[k] == pytest.approx((like(x, raw + d) - like(x, raw - d)) / (2 * e), rel=1e-3, abs=1e-5)


def test_quality(spark, odd):
    where = "/root/testdata/sf0.1"
    got = quality.query(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["selected"] == (got["quality"] == 1)).mean() > 0.95
    s = quality.Settings()
    rows = [(np.array([g]), np.array([1.0]), g) for g in (0, 1, 2)] * 50
    m = quality.train(rows, s)
    assert m.thresholds[0] < m.thresholds[1] and m.weight[0] < m.weight[1] < m.weight[2]
    assert quality.score(odd, m).count() == len(ODD)


def test_fingerprints(spark, odd, docs):
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(60):
        u = np.unique(rng.integers(1, 1 << 63, rng.integers(0, 200), dtype=np.uint64))
        pairs.append((u[rng.random(len(u)) < 0.7], u[rng.random(len(u)) < 0.7]))
    for (a, b), (left, right, _) in zip(pairs, fingerprint.differences(pairs, 24)):
        assert set(left) == set(a) - set(b) and set(right) == set(b) - set(a)
    texts = [t or "" for t in ODD]
    got = sorted(fingerprint.fingerprint(odd).collect())
    assert [r.doc_id for r in got] == list(range(len(ODD)))
    for i, r in enumerate(got):
        changed = fingerprint.edited(texts[i], texts[(i + 1) % len(texts)])
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(texts[i])
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0
    assert fingerprint.fingerprint(odd.limit(0)).count() == 0


def test_stored_fingerprints_are_read_subtracted_and_peeled(spark, docs):
    s = fingerprint.Settings()
    base = " ".join(f"Sentence number {i} stands here." for i in range(40))
    other = base.replace("number 7 ", "number seven ").replace("number 30 ", "number thirty ")
    rows = spark.createDataFrame([(1, base), (2, other), (3, " ".join(f"Quite another line {i}." for i in range(300)))], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint(rows).collect()}
    a, b = (fingerprint.digests(t, s.words) for t in (base, other))
    left, right, like = fingerprint.compare(got[1].fingerprint, got[2].fingerprint)
    assert set(left) == set(a) - set(b) and set(right) == set(b) - set(a) and like == pytest.approx(got[1].near_next)
    n, sketch = fingerprint.Sketch.read(got[1].fingerprint)
    assert n == len(a) and sketch.written(n) == got[1].fingerprint
    assert fingerprint.compare(got[1].fingerprint, got[3].fingerprint) is None  # larger sketches are due
    assert fingerprint.compare(got[1].fingerprint, got[1].fingerprint)[2] == 1.0


def test_fingerprint_ranges_follow_each_other(spark):
    ids = [3, 3, 3, 7, 8, 20, 21, 22, 22, 100]
    rows = spark.createDataFrame([(i, f"t{k:02d} " * 3) for k, i in enumerate(ids)], "doc_id long, text string")
    for pieces in (1, 2, 5, 40):
        held = {}
        for r in fingerprint.with_next(rows, pieces).collect():
            held.setdefault(r.part, []).append(r)
        pairs = []
        for part in held.values():
            part.sort(key=lambda r: (r.halo, r.doc_id, r.text))
            assert [r.halo for r in part] == [False] * (len(part) - 1) + [True]
            pairs += [(x.text[:3], y.text[:3]) for x, y in zip(part, part[1:])]
        assert sorted(pairs) == [(f"t{k:02d}", f"t{(k + 1) % len(ids):02d}") for k in range(len(ids))]


def test_all_operators_take_no_rows(spark, odd):
    none = odd.limit(0)
    path, pattern = bpe.vocabulary()
    assert bpe.digests(none, path, pattern).count() == toxicity.score(none, toxicity.fit(none.withColumn("label", F.lit(1)))).count() == 0
    assert quality.score(none, quality.fit(none.withColumn("grade", F.lit(1)))).count() == 0
    model = langid.Model(["x"], {"a": (0.5,)}, 1, 1e-7)
    assert langid.predict(none, model).count() == pii.find(none, pii.fit(none)).count() == pii.redact(none, pii.fit(none)).count() == bpe.round_trip(none, path, pattern).count() == 0
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_batches_are_dealt_whole_and_in_order():
    import pyarrow as pa

    from tidemark.llm import common

    texts = ["x" * n for n in (10, 5 << 20, 3, 0, *[1 << 20] * 9)] + [None]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(common.runs(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= common.RUN_BYTES for p in parts) and len(parts) > 3
    empty = batch.slice(0, 0)
    assert [p.num_rows for p in common.runs(empty)] == [0]
