"""The operators against plain versions on small tables, with nulls, ties, repeats, empty tables and
columns whose names clash."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graftline.llm import attention_lm, chat, cotraining, decontaminate, langid, line_dedup, mixing, simhash, subwords, token_files, winnowing, words

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and thin ere onst tion ing ed nder whre atha lyre stea ouble".split()


def text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    base = [(i, text(i, 5 + 13 * i % 160), "en", f"s{i % 4}", 0) for i in range(40)]
    base += [(40, base[3][1], "en", "s1", 0), (41, base[4][1] + " extra", "en", None, None), (42, None, None, "s0", None), (43, "", "en", "s0", 0), (44, "!!! ...", "en", "s2", 7), (45, "x", "en", "s2", 1),
             (45, "x", "en", "s2", 1), (None, "null id", "en", "s3", 2), (46, text(99, 4000), "en", "s3", 9), (47, "\t\n  ", None, None, None), (48, "Ünï  çôdé x 日本語", "en", "s1", 3)]
    return base


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    """Further columns with names that the operators use inside."""
    names = ["row", "_row", "_id", "_hash", "fp", "key", "start", "spans", "score", "copies", "_doc", "_source", "_size"]
    return docs.withColumns({n: F.lit(1) for n in names})


def test_chat(spark):
    t = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "<|im_end|>x"), (2, 0, "system", "alone"), (None, None, "ann", "z")], "conv_id int, turn int, role string, text string")
    r = {(x.conv_id, x.perspective): x for x in chat.rotate(t.withColumn("own", F.lit(1))).collect()}
    assert set(r) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    a = r[(1, "ann")]
    assert a.text.startswith("<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n") and a.n_turns == 5 and a.n_own == 1
    assert [a.text[m.start:m.end] for m in a["mask"]] == ["hi<|im_end|>"] and "<| im_end|>x" in a.text
    assert [r[(1, "bob")].text[m.start:m.end] for m in r[(1, "bob")]["mask"]] == ["<|im_end|>"] * 2
    assert chat.rotate(t.limit(0)).count() == 0
    crowd = spark.createDataFrame([(1, i // 40, "ab"[i % 2], str(i)) for i in range(4000)], "conv_id int, turn int, role string, text string")
    parts = chat.rotate(crowd).where("perspective = 'a'").collect()
    assert sum(p.n_turns for p in parts) == 4000 and max(p.n_turns for p in parts) < 500 and len({p.part for p in parts}) == 10 and {p.block for p in parts} == {0, 1}


def test_language(spark, docs, clashing):
    fr = ["le la des queai eauxer ouré tre ment", "ment eau les aire tion lement oui que"]
    train = docs.unionByName(spark.createDataFrame([(1000 + i, (fr[i % 2] + " ") * (1 + i % 7), "fr", "s", 1) for i in range(60)], DOC))
    model = langid.fit(train)
    assert model.langs == ["en", "fr"]
    # The filter has every n-gram that it was given, and its false positives are as rare as it says.
    h, _ = langid.grams([text(1, 50)])
    f = langid.LanguageFilter(["a"])
    f.add(0, h)
    assert (f.languages(h)[:, 0] & np.uint64(1) == 1).all()
    other = np.random.default_rng(0).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert abs((f.languages(other)[:, 0] & np.uint64(1)).mean() - f.false_rates()[0]) < 0.01
    names, scores, _ = model.predict([None, "", "!! 12", fr[0], text(500, 30), "ж"])
    assert names[:3] == [langid.UND] * 3 and names[3:5] == ["fr", "en"] and names[5] == "en" and scores[5] == 0 and (scores >= 0).all() and (scores <= 1).all()
    one, all_at_once = [model.predict([t])[1][0] for t in fr], model.predict(fr)[1]
    assert np.allclose(one, all_at_once)
    kept = langid.accepted(clashing, model)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} >= set(range(40)) and kept.where("doc_id in (42, 43, 44, 47)").count() == 0
    assert langid.fit(docs.limit(0)).predict(["abc"])[0] == [langid.UND] and langid.accepted(docs.limit(0), model).count() == 0


def plain_languages(train, texts, min_share=langid.MIN_SHARE, min_docs=langid.MIN_DOCS):
    """Languages by exact sets of n-grams: (lang, text) of training -> best language and score per text."""
    from collections import Counter

    def grams_of(t):
        line = "".join(c.lower() if c.isalpha() else " " for c in t or "")
        line = " " + " ".join(line.split()) + " "
        return [line[i : i + langid.N] for i in range(len(line) - langid.N + 1)] if line.strip() else []

    sets, cover = {}, {}
    for lang in {k for k, _ in train}:
        own = [t for k, t in train if k == lang]
        docs = Counter(g for t in own for g in set(grams_of(t)))
        least = min(max(docs.values()), max(min_docs, min_share * len(own)))
        sets[lang] = {g for g, n in docs.items() if n >= least}
        cover[lang] = np.mean([sum(g in sets[lang] for g in grams_of(t)) / max(1, len(grams_of(t))) for t in own])
    out = []
    for t in texts:
        g = grams_of(t)
        even = {k: sum(x in s for x in g) / max(1, len(g)) / max(0.05, cover[k]) for k, s in sets.items()}
        first, second = sorted(even.values(), reverse=True)[:2]
        out.append((max(sorted(even), key=even.get), first / (first + second) if first else 0.0))
    return out


def test_language_against_plain(spark):
    r = random.Random(8)
    parts = {"a": WORDS, "b": "der und ung sch keit lich ein ver ße".split(), "c": "le la queai eaux ouré tre ment the und".split(), "d": ["solo uno dos"]}
    make = lambda k, n: " ".join("".join(r.choices(parts[k], k=2)) for _ in range(n))
    train = [(k, make(k, r.randint(1, 60))) for k in "abc" for _ in range(80)] + [("d", parts["d"][0])]  # d: one document alone
    model = langid.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(train)], "doc_id bigint, text string, lang string"))
    texts = [make(r.choice("abc"), r.randint(1, 40)) for _ in range(120)] + [parts["d"][0], make("b", 60_000), make("a", 20) + " " + make("b", 22)]
    names, scores, _ = model.predict(texts)
    want = plain_languages(train, texts)
    assert names == [k for k, _ in want] and np.allclose(scores, [s for _, s in want], atol=0.01) and names[120] == "d"
    few = langid.fit(spark.createDataFrame([(1, "solo uno", "x"), (2, "der die", "y"), (3, None, "z"), (4, "drei", None)], "doc_id bigint, text string, lang string"))
    assert few.langs == ["x", "y", "z"] and few.predict(["uno", "die", None])[0] == ["x", "y", "und"] and (few.cover > 0).all()


def plain_cotraining(rows, labels):
    """The rounds with all rows at hand; every sure document is handed over, as fewer than HANDED are."""
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    good: dict = {}
    for d, q, toxic in labels:
        if q is not None:
            good[d] = min(good.get(d, 1), int(q == 1 and not toxic))
    make = lambda r: {"text": cotraining.text_features(r[1]), "meta": cotraining.meta_features(*r[2:5])}
    train = [(make(r), good[r[0]]) for r in rows if r[0] in good and r[0] is not None and crc(r[0]) not in (1, 3)]
    check = [(make(r), good[r[0]]) for r in rows if r[0] in good and r[0] is not None and crc(r[0]) == 3]
    pool = [make(r) for r in rows if (r[0] is None or r[0] not in good) and crc(r[0]) not in (1, 3)]
    model, gained = cotraining.CoTraining(), {"text": {}, "meta": {}}
    model.constant = None
    split = lambda part: {c: [x[c] for x, _ in part] for c in ("text", "meta")}
    for r in range(cotraining.ROUNDS + 1):
        model.train(split(train), np.array([y for _, y in train], float), gained)
        for name, other in (("text", "meta"), ("meta", "text")) if r < cotraining.ROUNDS else ():
            for k, x in enumerate(pool):
                p = cotraining.sigmoid(model.views[name].raw(cotraining.View.pack([x[name]])))[0]
                if max(p, 1 - p) >= cotraining.SURE:
                    gained[other].setdefault(k, (x[other], float(p > 0.5)))
    model.combine_views(split(check), np.array([y for _, y in check], float))
    return model


def test_cotraining(spark, docs):
    r = random.Random(5)
    junk = [(2000 + i, text(i, 40).replace(" ", "$$$ ") if i % 2 else text(i, 40) + " moron idiot", "en", "bad", 5) for i in range(60)]
    good = [(3000 + i, text(10_000 + i, r.randint(20, 60)), "en", "fine", 50) for i in range(60)]
    table = docs.unionByName(spark.createDataFrame(junk + good, DOC))
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0 if i % 2 else 1) for i, *_ in junk] + [(i, 1, None) for i, *_ in good] + [(9, None, 1), (3000, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = {x.row.doc_id: x.score for x in cotraining.score(table, cotraining.fit(table, labels)).collect()}
    assert np.mean([found[i] < 0.5 for i, *_ in junk]) > 0.9 and np.mean([found[i] >= 0.5 for i, *_ in good]) > 0.9
    held = [i for i in found if zlib.crc32(str(i).encode()) % 5 == 1 and i and i >= 2000]
    assert held and np.mean([(found[i] >= 0.5) == (i >= 3000) for i in held]) > 0.9
    assert {x.score for x in cotraining.score(docs, cotraining.fit(docs, labels.limit(0))).collect()} == {0.5}
    # Against one machine's view of the same rounds: all of the pool is scored, the surest go over.
    alone = plain_cotraining([tuple(x) for x in table.collect()], [tuple(x) for x in labels.collect()])
    text_, meta = zip(*[(cotraining.text_features(x[1]), cotraining.meta_features(*x[2:5])) for x in table.collect()])
    assert np.allclose(alone.score(list(text_), list(meta))[2], [found[x.doc_id] for x in table.collect()], atol=1e-6)
    odd = docs.withColumns({n: F.lit(1) for n in ("row", "good", "part", "lot", "meta", "p_text", "key")})
    assert cotraining.score(odd, cotraining.fit(odd, labels)).select("row.*").columns == odd.columns
    assert cotraining.score(docs.limit(0), cotraining.fit(docs, labels)).count() == 0


def test_attention_model():
    m = attention_lm.AttentionModel(50, classes=4, members=4, width=6, hidden=5, length=8, lead=3)
    rng = np.random.default_rng(1)
    ids = [np.append(rng.integers(0, 50, n), 50) for n in (0, 1, 4, 5, 6, 30)]
    m.arrange(np.concatenate(ids * 5))
    # Each id is scored once, and padding or later ids change nothing.
    x, t, owner = m.windows([m.symbol[s] for s in ids])
    assert (np.bincount(owner[:, None].repeat(5, 1)[t >= 0]) == [len(s) for s in ids]).all()
    y, _ = m.states(x)
    slow = np.bincount(np.broadcast_to(owner[:, None], t.shape)[t >= 0], m.log_probabilities(y[t >= 0], t[t >= 0]), len(ids)) / np.log(10)
    slow += [m.rest_log[s[m.symbol[s] == m.rest]].sum() for s in ids]
    assert np.allclose(m.score(ids), slow, atol=1e-4) and np.allclose(m.score(ids[3:4]), slow[3], atol=1e-4)
    # All symbols together have probability 1.
    every = np.arange(16)
    assert np.exp(m.log_probabilities(np.repeat(y[:1, 0], 16, 0), every)).sum() == pytest.approx(1, abs=1e-4)
    g, loss = m.gradients(x, t)
    for k in ("E", "P", "Wq", "Wk", "Wv", "Wo", "W1", "W2", "Wc", "Wm"):
        m.p[k] = m.p[k].astype(np.float64)
    at = np.unravel_index(np.argmax(np.abs(g["Wk"])), g["Wk"].shape)
    for k, i in (("Wk", at), ("Wq", np.unravel_index(np.argmax(np.abs(g["Wq"])), g["Wq"].shape)), ("W1", np.unravel_index(np.argmax(np.abs(g["W1"])), g["W1"].shape))):
        m.p[k][i] += 1e-4
        up = m.gradients(x, t)[1]
        m.p[k][i] -= 2e-4
        down = m.gradients(x, t)[1]
        m.p[k][i] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[k][i], rel=0.05, abs=1e-4)


def test_attention_cost_and_overflow():
    # The gradients of one batch of a round against the plain way forward: before 2.3 to 2.4 times that, now 1.2 to 1.4.
    m = attention_lm.AttentionModel(5000)
    rng = np.random.default_rng(2)
    texts = [np.append(rng.zipf(1.3, 400) % 5000, 5000) for _ in range(20)]
    m.arrange(np.concatenate(texts))
    x, t, _ = m.windows([m.symbol[s] for s in texts])
    x, t, times = x[:256], t[:256], []
    for _ in range(20):
        begin = time.thread_time()
        m.log_probabilities(m.states(x)[0][t >= 0], t[t >= 0])
        middle = time.thread_time()
        m.gradients(x, t)
        times.append((middle - begin, time.thread_time() - middle))
    forward, whole = map(min, zip(*times))
    assert whole < 1.85 * forward
    # Every parameter's gradient by differences.
    s = attention_lm.AttentionModel(50, classes=4, members=4, width=6, hidden=5, length=8, lead=3)
    ids = [np.append(rng.integers(0, 50, n), 50) for n in (0, 1, 4, 5, 6, 30)]
    s.arrange(np.concatenate(ids))
    x, t, _ = s.windows([s.symbol[i] for i in ids])
    s.p = {k: v.astype(np.float64) for k, v in s.p.items()}
    g, loss = s.gradients(x, t)
    for k, v in s.p.items():
        for i in np.argsort(-np.abs(g[k]).ravel())[:3]:
            at = np.unravel_index(i, v.shape)
            keep = v[at]
            v[at] = keep + 1e-5
            up = s.gradients(x, t)[1]
            v[at] = keep - 1e-5
            assert (up - s.gradients(x, t)[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-4, abs=1e-8)
            v[at] = keep
    # The careful way gives the same, and takes over where exponentials overflow.
    same, loss_ = s.gradients(x, t, careful=True)
    assert loss_ == pytest.approx(loss) and all(np.allclose(g[k], same[k]) for k in g)
    for k in ("Wc", "Wq"):
        large = attention_lm.AttentionModel(50, classes=4, members=4, width=6, hidden=5, length=8, lead=3)
        large.symbol = s.symbol
        large.p[k] *= np.float32(5000)
        g, loss = large.gradients(x, t)
        assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values()) and np.isfinite(large.score(ids)).all()


def test_attention_scores(spark, docs, rows):
    held = langid.remainder(F.col("doc_id"), 5) == 1
    found = attention_lm.score_documents(docs.select("doc_id", "text"), ~held, passes=1, head_share=0.01).collect()
    train = [t for d, t, *_ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    split = lambda t: (t or "").encode().lower().split() + [b""]
    counts: dict = {}
    for t in train:
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in split(t))
    key = lambda d, a, b, c, e: (-1 if d is None else d, a, b, c, round(e, 6))
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found) == sorted(key(d, len(split(t)), sum(w in counts for w in split(t)), n, base(t)) for d, t, *_ in rows)
    assert all(r.score < 0 for r in found)


def test_attention_words():
    # Words by array operations, as split gives them.
    odd = ["a B\tb\n\x0bX\x1cy", None, "", "  ", "zz", " \u00c4 a\u00a0b", "x" * 15 + " " + "x" * 16 + " \x00 \x00\x00", "A", " q ", " ".join(f"w{i}" for i in range(3000)) * 2]
    own = [(i or "").encode().lower().split() for i in odd]
    h, sizes = words.hashed_words(pa.array(odd))
    names: dict = {}
    for w, i in zip([w for o in own for w in o], h.tolist()):
        names.setdefault(w, set()).add(i)
    assert sizes.tolist() == [len(o) for o in own] and all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == len(names)
    assert [len(words.hashed_words(pa.array(z, pa.string()))[1]) for z in ([], [None], [" ", ""])] == [0, 1, 2] and int(words.END) not in h.tolist()
    table = words.HashTable(len(names))
    slot = table.find(h, add=True)
    assert (table.keys[slot] == h).all() and (table.find(h) == slot).all() and (table.find(h + np.uint64(1)) == -1).all() and table.held == len(names)


def test_attention_cost_of_words():
    # Counting the words of four batches against splitting one: before 13.1 to 13.8 times that, now 5.6 to 6.7.
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"w{i}" for i in (rng.zipf(1.2, 800) % 30_000).tolist()) for _ in range(640)])
    batch, times = pa.RecordBatch.from_arrays([texts], ["text"]), []
    for _ in range(5):
        begin = time.thread_time()
        for t in batch.column("text").to_pylist():
            t.encode().lower().split()
        middle = time.thread_time()
        list(attention_lm._count_words(iter([batch] * 4)))
        times.append((middle - begin, time.thread_time() - middle))
    plain, whole = map(min, zip(*times))
    assert whole < 10 * plain


def test_attention_counts_words_in_parts(monkeypatch):
    monkeypatch.setattr(attention_lm, "WORDS", 40)
    texts = [" ".join(f"w{i % 90}" for i in range(j, j + 50)) for j in range(100)]
    found: dict = {}
    for b in attention_lm._count_words(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        for h, n in zip(*(b.column(i).to_pylist() for i in range(2))):
            found[h] = found.get(h, 0) + n
    named = dict(zip(" ".join(texts).split(), words.hashed_words(pa.array(texts))[0].view(np.int64).tolist()))
    expected = {named[w]: sum(t.split().count(w) for t in texts) for w in named}
    assert found == expected | {int(words.END.view(np.int64)): 100}


def test_attention_gathers_from_all_documents(spark):
    # Each text has words of its own, and the common start sees about one text.
    words = [w[1:] for w, i in subwords.encoder().model.get_vocab().items() if i > 20_000 and w[1:].isascii() and w[1:].isalpha() and w[1:].islower() and w[0] == "Ġ"][:1500]
    t = spark.createDataFrame([(i, " ".join(words[5 * i : 5 * i + 5] * 4)) for i in range(300)], "doc_id bigint, text string")
    found = attention_lm.score_documents(t, F.lit(True), sample=1).collect()
    assert len(found) == 300 and min(r.score / r.n_tokens for r in found) > -5.5
    rows = attention_lm.encoded(t.select(F.col("doc_id").alias("id"), "text"))
    start, ids = attention_lm.fit(rows.limit(0)), rows.collect()
    model = attention_lm.fit(rows, sample=0)
    assert all((model.symbol[np.frombuffer(r.ids, "<u2")] != model.rest).all() for r in ids)
    assert any((model.p[k] != start.p[k]).any() for k in start.p)  # without a start, the rounds alone train


def test_winnowing(spark, docs, rows):
    def plain(t, k=winnowing.K, w=winnowing.WINDOW):
        points = np.array([ord(c) for c in t], np.uint64)
        k = min(k, len(t))
        hashes = [int(winnowing.gram_hashes(points[i:i + k], k)[0]) for i in range(len(t) - k + 1)] if t else []
        w, out = min(w, len(hashes)), []
        for i in range(len(hashes) - w + 1 if hashes else 0):
            best = min(hashes[i:i + w])
            at = max(j for j in range(i, i + w) if hashes[j] == best)
            if not out or out[-1] != (best, at):
                out.append((best, at))
        return out

    for t in ["", "a", "abc" * 5, "x" * 100, text(1, 60), "é日" * 40]:
        assert list(zip(*(a.tolist() for a in winnowing.select(t)))) == plain(t)
    passage = text(7, 12)[:winnowing.K + winnowing.WINDOW - 1]
    a, b = (set(winnowing.select(x + passage + y)[0].tolist()) for x, y in ((text(1, 30), text(2, 30)), (text(3, 30), text(4, 30))))
    assert a & b
    got = winnowing.compare_with_next(docs, ranges=5).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (d, t, *_), (_, n, *_) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), winnowing.encode(winnowing.select(t)[0]), winnowing.encode(winnowing.select(e)[0])))
    name = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    assert sorted(name((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)) for r in got) == sorted(map(name, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert winnowing.compare_with_next(docs.limit(0)).count() == 0 and winnowing.fingerprints(docs).count() == len(rows)


def test_mixing(spark, docs, clashing, rows):
    s = mixing.sample(docs).collect()
    assert len(s) == len(rows)
    by: dict = {}
    for r in s:
        by.setdefault(r._source, []).append(r)
        assert 0 <= r.copies <= 3
    weights = dict(zip(sorted(k for k in by if k is not None) + [None], [5, 2, 1, 5, 2, 1]))
    sizes = {k: sum(r._size for r in v) for k, v in by.items()}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[k] for k in capped)
        free = sum(weights[k] for k in by if k not in capped)
        over = {k for k in by if k not in capped and rest * weights[k] / free > 3 * sizes[k]}
        if not over:
            break
        capped |= over
    for k, v in by.items():
        target = 3 * sizes[k] if k in capped else rest * weights[k] / free
        assert v[0].target == pytest.approx(target) and v[0].source_size == sizes[k]
    again = mixing.sample(docs).collect()
    assert sorted(map(str, s)) == sorted(map(str, again))
    m = mixing.mix(clashing)
    assert m.columns == clashing.columns and m.count() == sum(r.copies for r in s)
    assert mixing.sample(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def plain_line_dedup(rows, unit, min_run):
    """(doc_id, text) rows -> per row (text, spans), one row and one unit after the other."""
    import re

    def units(x):
        if unit == "paragraph":
            return [m.group() for m in re.finditer(r"(?s).+?(?:\n\n+|\Z)", x)]
        lines = re.findall(r"[^\n]*\n|[^\n]+", x)
        if unit == "line":
            return lines
        out = []
        for line in lines:
            held = ""
            for sentence in re.findall(r".*?(?:[.!?] |\Z)", line, re.S):
                held += sentence
                if len(re.findall(r"[^\x20\x09-\x0D]+", sentence)) >= 4:
                    out.append(held)
                    held = ""
            out += [held] if held else []
        return out

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest()[:15], i))
    seen, result = set(), [None] * len(rows)
    for i in order:
        text, at, runs = rows[i][1], 0, [[]]
        for u in units(text or ""):
            norm = " ".join(re.findall(r"[^\x20\x09-\x0D]+", u.lower()))
            if norm and norm in seen:
                runs[-1].append((at, at + len(u), norm.count(" ") + 1))
            elif norm:
                seen.add(norm)
                runs.append([])
            at += len(u)
        gone = [(a, z) for run in runs if sum(w for *_, w in run) >= min_run for a, z, _ in run]
        result[i] = (None if text is None else "".join(c for k, c in enumerate(text) if not any(a <= k < z for a, z in gone)), gone)
    return result


@pytest.mark.parametrize("unit,min_run,hot", [("soft", 25, 1e-4), ("soft", 1, 0.02), ("line", 1, 1e-4), ("line", 6, 1.0), ("paragraph", 1, 1e-4)])
def test_line_dedup_against_plain(spark, monkeypatch, unit, min_run, hot):
    r = random.Random(min_run)
    sentences = [text(900 + k, r.randint(1, 9)) for k in range(30)]
    glue = [" ", " ", "\n", "\n\n", "  \n", "! ", "\n \n"]
    make = lambda: "".join(x for _ in range(r.randint(0, 14)) for x in (r.choice(sentences), r.choice(glue)))
    rows = [(r.choice([None, k, k, k, 3]), make()) for k in range(60)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, rows[7][1]), (90, None), (91, ""), (92, "\n \n"), (93, "Ünï çôdé wörds hëre. " * 9), (94, "ünï ÇÔDÉ wörds hëre. x")]
    # Two different texts without an id and of equal crc32, which share a line.
    rows += [(None, "shared line of five words\n" + x) for x in ("plumless", "buckeroo")]
    plain = [(a, b, c, d) for (a, b), (c, d) in zip(rows, plain_line_dedup(rows, unit, min_run))]
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    t = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    got = [(x.row.doc_id, x.row.text, x.text, [(s.start, s.end) for s in x.spans]) for x in line_dedup.dedup(t, unit=unit, min_run=min_run).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain)) and any(x[3] for x in got)


def test_line_dedup(spark, clashing):
    t = spark.createDataFrame([(1, "a b.\n\nOnce here.\n"), (2, "A  b.\n\nx\n"), (3, "x\n \nOnce there.\na b."), (4, None), (5, "")], "doc_id bigint, text string")
    assert {r.row.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(t, min_run=1).collect()} == {
        1: ("a b.\n\nOnce here.\n", 0), 2: ("\nx\n", 1), 3: (" \nOnce there.\n", 2), 4: (None, 0), 5: ("", 0)}
    assert line_dedup.dedup(t).count() == 5 and line_dedup.dedup(t.limit(0)).count() == 0
    assert line_dedup.dedup(clashing).select("row.*").columns == clashing.columns
    for unit in ("line", "soft", "paragraph"):
        for x in ("a\n\nb. c! d\n", "\n\n\n", "x\0y. z", "", " ".join(["one two three four."] * 20_000)):
            assert "".join(line_dedup.cut(x, unit)) == x


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(subwords.tokenizer_path()), subwords.SubwordEncoder()
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>\n<|endoftext|>  y", "<|ENDOFTEXT|> z", "no mark <|endof text|>", "just words"]
    whole = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == [whole(t) for t in texts]
    lower = [" " + " ".join(w.decode() for w in t.encode().lower().split()) for t in texts]
    assert 50256 in whole(texts[0])
    plain.encode_special_tokens = True  # words are ordinary text
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode_words(texts)] == [whole(t) for t in lower]
    odd = ["\0abc", " abc", "a\u00a0b \u00a0 c\u2003", "it's 3.14, x_y", "\0", "", None]
    lower = ["".join(" " + w.decode() for w in (t or "").encode().lower().split()) for t in odd]
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode_words(odd)] == [whole(t) for t in lower]


def test_turan_system():
    from itertools import combinations

    triples = [set(t) for t in simhash.turan_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash_classes():
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fps = np.unique(np.concatenate([[c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), False))) for _ in range(80)] for c in center]).astype(np.uint64))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    for dense in (10_000, 1):
        assert (simhash.classes(fps, dense) == label).all()


def test_simhash(spark, docs, clashing, rows):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_components(docs, ["doc_id"]).collect())
    fps = [(d, simhash.fingerprint(t)) for d, t, *_ in rows]
    label = list(range(len(fps)))
    for _ in fps:
        label = [min(label[j] for j in range(len(fps)) if (fps[i][1] ^ fps[j][1]).bit_count() <= 4) for i in range(len(fps))]
    ids = [min((fps[j][0] for j in range(len(fps)) if label[j] == label[i] and fps[j][0] is not None), default=None) for i in range(len(fps))]
    assert got == sorted((-1 if d is None else d, f, c) for (d, f), c in zip(fps, ids))
    kept = simhash.near_dedup(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(set(label))
    assert simhash.near_dedup(docs.limit(0)).count() == 0
    import xxhash

    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash.fingerprint(None) == 0


def test_token_codes():
    rng = np.random.default_rng(0)
    for counts in ([5], [1, 1], [0, 3, 0, 9, 1], 2.0 ** np.arange(40), rng.zipf(1.3, 5000) % 100000):
        counts = np.asarray(counts, np.int64)
        bits = token_files.code_lengths(counts)
        assert bits.max() <= 16 and (bits[counts > 0] > 0).all() and sum(2.0 ** -int(b) for b in bits if b) <= 1
        ids = rng.choice(np.flatnonzero(counts), 1000)
        codes = token_files.canonical_codes(bits)
        for n in (0, 1, 63, 64, 65, 1000):
            payload, marks = token_files.pack(ids[:n], bits, codes)
            assert (token_files.Decoder(bits).unpack(payload, marks, n) == ids[:n]).all()
    # Optimal: as long as an unlimited Huffman code where that stays below the limit.
    import heapq

    weights = list(map(int, rng.integers(1, 1000, 200)))
    heap, total = weights[:], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((token_files.code_lengths(np.array(weights)) * np.array(weights)).sum()) == total


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(subwords.tokenizer_path())  # the library alone
    whole = lambda t: np.asarray(plain.encode(t or "", add_special_tokens=False).ids, "<u4")
    odd = ["", " ", "\n", " a", "a  b", "x\n\ny \t z", "a\x1cb c", "<|endoftext|> hi", "don't stop 's", "3.14,5 ...!? a_b ._x", "日本語 テスト。x", "a b c", "Ġx Ċ y", "\0a b", "a\0", "a", None, "x\u00a0 y", "x\u3000\n y", "\u2003", "x\u00a0\n\n z", "e\u2019s \u201cq\u201d", "y" * 70, "z" * 14 + " " + "z" * 15 + " " + "z" * 16]
    r = random.Random(5)
    odd += ["".join(r.choices([*"aé1.' \n\t\0", "\u00a0", "\u2003", "  ", "it's", "<|endoftext|>", "\x1c", "漢"], k=r.randint(1, 14))) for _ in range(500)]
    texts = odd + [t for _, t, *_ in rows] * 2
    for e in (subwords.SubwordEncoder(), subwords.SubwordEncoder(limit=50, slot_bits=7)):
        assert all((np.frombuffer(b, e.dtype) == whole(t)).all() for b, t in zip(e.encode(texts), texts))
    long = [" ".join(t or "" for t in texts if "<|" not in (t or "")) * 12, "x" * 700_000 + " y", "q" + " " * 600_000 + "r"]
    assert all((np.frombuffer(b, e.dtype) == whole(t)).all() for b, t in zip(e.encode(long), long))
    # Several blocks of a partition, a document longer than a block, added tokens and NULs in the table.
    rows = rows + [(1000 + i, t, None, None, None) for i, t in enumerate(odd)] + [(None, "<|endoftext|> x", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    got = token_files.token_digests(docs.coalesce(2), block=300).collect()
    place = {(r.doc_id, r.start): r for r in got}
    assert len(place) == len(got)
    start = 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d or 0))
    by_id = {}
    for d, t, *_ in rows:
        ids = np.append(whole(t), 0).astype("<u4")
        by_id.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in ordered:
        by_id[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert r.start == start
        start += r.n_tokens
    got = token_files.token_digests(docs.where("doc_id < 45")).collect()
    start = 0
    for r, (d, t, *_) in zip(sorted(got, key=lambda r: r.start), sorted((r for r in rows if r[0] is not None and r[0] < 45), key=lambda r: r[0])):
        ids = np.append(whole(t), 0).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == 45 and token_files.token_digests(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, clashing, rows):
    w = rows[7][1].split()
    items = [("i1", " ".join(w[:20])), ("i2", " ".join(w[5:14])), ("short", "x"), ("none", "..."), ("null", None), (None, " ".join(w[3:12])), ("i1", " ".join(w[:20]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in decontaminate.brute_force([(d, t) for d, t, *_ in rows], items))
    for size in (1 << 20, 40):
        got = decontaminate.digest(decontaminate.match(docs, bench, ["doc_id"], block_bytes=size)).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in got) == want
    kept = decontaminate.decontaminated(clashing, bench, min_items=1)
    assert kept.columns == clashing.columns and kept.where("doc_id in (7, 45)").count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows) and decontaminate.match(docs.limit(0), bench, ["doc_id"]).count() == 0
