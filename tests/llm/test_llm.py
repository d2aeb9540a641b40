"""The operators for training data against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeshred.llm import ann, bitpack, chat, decontam, kdshard, lm, mixing, quality, setsketch, tokencount
from treeshred.llm.common import Words, shingle_hashes, words_of
from treeshred.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, block int, score string"


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else "".join(r.choice(["an", "ti", "re", "ou", "sh", "É"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus():
    r = random.Random(4)
    texts = [prose(r, r.randint(5, 120)) for _ in range(60)]
    out = list(texts)
    for t in texts[:25]:  # near copies at many distances, chained
        for edits in (1, 2, 4, 8):
            w = t.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = prose(r, 1)
            out.append(" ".join(w))
    out += texts[:5] * 3 + [None, "", " \n\t", "one", "One", "one two three", "ONE two three", "x" * 30_000, prose(r, 6000), "<|endoftext|> </s> ▁ \x00é́"]
    rows = [(i, t, "en", [None, "", "a", "b"][i % 4], 1, 1, "h", 2, "s") for i, t in enumerate(out)]
    return [*rows, rows[3], rows[3], (7, "another text under the id seven", "en", "a", 1, 1, "h", 2, "s"), (None, "no id at all", None, None, None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_those_of_the_contract():
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "B", " ", "\n", "\x0b", "\x1c", " ", "É", "é"]) for _ in range(r.randint(0, 12))).encode() for _ in range(300)]
    w = Words([None, *texts])
    names = {}
    for i, t in enumerate([None, *texts]):
        assert len(w.of(i)) == len(words_of(t))
        for word, h in zip(words_of(t), w.of(i).tolist(), strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


# 1. Chat formatting


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a\\[INST]"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", "é\\"), (3, None, "user", "last"), (None, 0, "user", "x")]
    rows += [(4, i, ["user", "assistant"][i % 2], f"turn {i} <s>") for i in range(90)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, formatted int"))).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns = [(x[2], x[3]) for x in sorted(turns)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.inst_template(turns)) and not got[c].rewrites_history


def test_chat_black_boxes():
    turns = [("user", "a"), ("assistant", "bb"), ("user", "c"), ("assistant", "dd")]
    plain = lambda m: "<bos>" + "".join(f"<{r}>{t}<end>" for r, t in m)
    out, spans, rewrites = chat.locate(plain, turns)
    assert not rewrites and [out[s.text_start : s.text_end] for s in spans] == ["a", "bb", "c", "dd"]
    forgets = lambda m: "".join(f"<{r}>{t if k >= len(m) - 2 else ''}|" for k, (r, t) in enumerate(m))
    assert chat.locate(forgets, turns)[2]
    counts = lambda m: f"{len(m)} turns:" + plain(m)
    assert chat.locate(counts, turns)[2]
    numbered = lambda m: "".join(f"{k}.{r}:{t};" for k, (r, t) in enumerate(m))
    long = [("user", str(i)) for i in range(40)]  # turns know their number: no window of prefixes can tell
    out, spans, rewrites = chat.locate(numbered, long)
    assert not rewrites and [out[s.text_start : s.text_end] for s in spans] == [str(i) for i in range(40)]


def test_escape_is_reversible():
    r = random.Random(2)
    for _ in range(2000):
        x = "".join(r.choice(["\\", "<", "s>", "</s>", "[INST]", "[/INST]", "[", "/", "a"]) for _ in range(r.randint(0, 8)))
        assert chat.unescape(chat.escape(x)) == x and not chat._CONTROL.search(chat.escape(x))


# 2. Language-model scores


def test_lm_against_counting(docs, none):
    assert lm.score(none).count() == 0
    tokens = [(d, [*words_of(t.encode() if t else None), b"\n"]) for d, t, *_ in ROWS]
    train = [w for d, w in tokens if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c, bi = Counter(x for w in train for x in w), Counter()
    for w in train:
        bi.update(zip([b" ", *w[:-1]], w, strict=True))
    n, ch, total = Counter(h for h, _ in bi), dict(c) | {b" ": len(train)}, sum(c.values())
    want = []
    for d, w in tokens:
        base = full = 0.0
        for h, x in zip([b" ", *w[:-1]], w, strict=True):
            p1 = (c[x] + 1) / (total + len(c) + 1)
            k = ch.get(h, 0)
            base += math.log10(p1)
            full += math.log10((max(bi[h, x] - 0.9, 0) / k if k else 0) + (0.9 * n[h] / k if k else 1) * p1)
        want.append((-1 if d is None else d, len(w), sum(c[x] > 0 for x in w), total, round(base, 6), round(full, 6)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs).collect()]
    assert sorted(got) == sorted(want)


def test_lm_spreads_and_sums_to_one(docs, monkeypatch):
    want = sorted((r.doc_id or -1, round(r.score, 6)) for r in lm.score(docs).collect())
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lm, "BUCKET_WORDS", 300)
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in lm.score(docs).collect()) == want
    # A state with arcs to 2 of 4 words: seen and unseen arcs, one more for what was never seen.
    c, n = np.array([3, 1, 2, 1]), np.array([2, 1, 1, 1])
    arcs = lm.Automaton(c, n, np.zeros(4, int), np.arange(4), np.array([2, 0, 1, 0]), 7, 4)
    assert math.isclose(arcs.arc.sum() + arcs.failure[0] / 12, 1)


# 3. Nearest neighbours


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 24)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[7].tolist()) for i in range(300)] + [(3000, None), (3050, [0.0] * 24), (3100, [float("nan")] * 24), (3150, [None] * 24), (3200, [float("inf")] * 24), (None, x[1].tolist()), (50, x[50].tolist())]
    got = defaultdict(dict)
    for q in ann.nearest(spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<float>, bucket int")).collect():
        got[q.query_id][q.rank] = (q.vec_id, q.score)
    ids = np.array([*range(1500), *range(2000, 2300)])
    v = np.concatenate([x, np.repeat(x[7:8], 300, 0)]).astype(float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        s = v @ v[np.flatnonzero(ids == q)[0]]
        order = [int(ids[k]) for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in found.values()} & set(order))
        if q in (2000, 2050):  # copies: ties go to the smallest ids
            assert [found[k][0] for k in range(1, 6)] == order
        for i, score in found.values():
            assert math.isclose(score, s[np.flatnonzero(ids == i)[0]], abs_tol=1e-9)
    assert hits >= 0.9 * 5 * len(got)
    wide = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (50, [1e-200, 3e-200]), (3, [5e-324, 0.0])]
    found = {(f.query_id, f.vec_id): f.score for f in ann.nearest(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()}
    assert found[0, 1] == pytest.approx(3 / math.sqrt(10)) and found[50, 1] == pytest.approx(7 / math.sqrt(50)) and found[50, 3] == pytest.approx(1 / math.sqrt(10)) and len(found) == 6
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [-1.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    assert sorted((f.query_id, f.rank, f.vec_id) for f in few) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_equal_vectors_tie():
    r = np.random.default_rng(0)
    for n in (3, 30, 500):
        x = r.normal(size=(n, 24))
        ids = r.permutation(10 * n)[: 2 * n]
        both = np.concatenate((x, x))
        a, b, c = ann.best(x[: min(n, 40)], np.full(min(n, 40), -1), both, ids, 5)
        assert len(a) == 5 * min(n, 40)
        for i in range(min(n, 40)):
            got = list(zip(b[5 * i : 5 * i + 5], c[5 * i : 5 * i + 5], strict=True))
            assert got == sorted(got, key=lambda y: (-y[1], y[0])) and got[0][1] == got[1][1] and {got[0][0], got[1][0]} == {ids[i], ids[i + n]}
    same = np.repeat(x[:1], 60, 0)  # more ties than are proposed
    assert ann.best(x[:1], np.array([-1]), same, np.arange(60)[::-1], 5)[1].tolist() == [0, 1, 2, 3, 4]


# 4. Token counts


def test_token_counts(docs, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit, r.fit_chars) for r in tokencount.token_counts(docs, path, 100).collect())
    counter = tokencount.counter(path)
    want = []
    for d, t, *_ in ROWS:
        t = t or ""
        n = len(sp.encode(t))
        fits = [i for i, k in enumerate(counter.counts(t)) if k <= 100]
        want.append((d or -1, len(t.encode()), n, n > 100, fits[-1]))
    assert got == sorted(want)
    assert tokencount.token_counts(none, path).count() == 0


def test_prefix_counts_of_any_prefix():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, counter, r = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.counter(path), random.Random(0)
    for _ in range(300):
        x = "".join(r.choice(["a", "b", " ", "▁", "\n", "é", "ing", "the", "<s>", "\U00010348", "\x00", "日", "  ", ",", "'s", "1"]) for _ in range(r.randint(0, 12)))
        assert counter.counts(x).tolist() == [len(sp.encode(x[:i])) for i in range(len(x) + 1)]


# 5. Packed ids


def test_pack_round_trip(tmp_path):
    r = np.random.default_rng(1)
    for bits in (1, 5, 8, 13, 16, 17, 31):
        ids = r.integers(0, 1 << bits, 1001).astype(np.uint32)
        assert (bitpack.unpack(bitpack.pack(ids, bits), len(ids), bits) == ids).all()
    w = bitpack.Writer(str(tmp_path / "x.tsb"), 50_000)
    parts = [r.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 40_000, 70_000, 3)]
    for i, p in enumerate(parts):
        w.add(None if i == 1 else i, p)
    w.close()
    f = bitpack.Reader(str(tmp_path / "x.tsb"))
    assert all((f.doc(i) == p).all() for i, p in enumerate(parts)) and f.valid.tolist() == [1, 0, 1, 1, 1]
    assert (f.ids(39_990, 80_000) == np.concatenate(parts)[39_990:80_000]).all()


def test_packed_ids(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_crc32) for r in bitpack.encode_and_read(docs, path).collect())
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x, *_ in ROWS]
    assert got == sorted((-1 if d is None else d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, *_), i in zip(ROWS, ids, strict=True))
    starts = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in bitpack.encode_and_read(docs, path).collect())
    at = 0
    for start, n, _ in starts:
        assert start == at
        at += n
    assert [d for _, _, d in starts] == sorted(d for _, _, d in starts)
    assert bitpack.encode_and_read(none, path).count() == 0


# 6. Quality


def test_quality(spark, none):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = prose(r, 150)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, 0.0, 1))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None, 0.0, 1), (1001, "", 0.0, 1), (None, "a b", 0.0, 1), (5, rows[5][1], 0.0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    lab = spark.createDataFrame([*labels, (None, 0, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab)
    got = quality.score(d, model).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 300]
    assert all(zlib.crc32(str(g.doc_id).encode()) % 5 == 0 for g in held)
    assert sum(g.predicted == (g.doc_id % 3 != 0) for g in held) >= 0.95 * len(held)
    assert quality.score(none, model).count() == 0
    assert quality.score(d, quality.train(d, lab.limit(0))).first().score == pytest.approx(0.5)


def test_scores_by_plain_loops():
    r = random.Random(12)
    texts = [prose(r, n) for n in (1, 63, 64, 65, 200, 700)] + ["", None, " \n ", "  lead AND trail!!  ", "a a a 7 7 $ É" * 40, "x" * 500, "\n\nOne two"]
    rng = np.random.default_rng(4)
    m = quality.Model()
    m.mean, m.scale = rng.normal(0, 0.1, quality.FEATURES), rng.uniform(0.5, 2, quality.FEATURES)
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,", b"!?", b"|", b"#$%&*@^~+=<>", b"\"'()-:;/_\\[]{}`", b"\n", b" \t\r\x0b\x0c"]
    kind = lambda c: 11 if c >= 128 else next((k for k, x in enumerate(sets, 1) if c in x), 0)

    def features(data, begin, end, words):
        out = [0.0] * quality.FEATURES
        if not words:
            return out
        for c in data[begin:end]:
            out[kind(c)] += 1 / (end - begin)
        names = [data[a:b].lower() if data[a:b].isascii() else Words([data[a:b]]).hashes.tobytes() for a, b in words]
        share = lambda hits: sum(hits) / len(words)
        dense = [share([(b - a) / 10 for a, b in words]), share([b - a > 20 for a, b in words]), share([data[b - 1] in b".," for a, b in words]), share([data[b - 1] in b"!?|" for a, b in words]), share([kind(data[a]) == 1 and b - a > 1 for a, b in words]), share([b - a == 1 for a, b in words])]
        dense += [share([i > 0 and names[i] == names[i - 1] for i in range(len(words))]), share([i > 1 and names[i] == names[i - 2] for i in range(len(words))]), len(set(names)) / len(words)]
        out[12:21] = dense
        bag = Counter(int(Words([data[a:b]]).hashes[0]) % quality.HASHED for a, b in words)
        for k, n in bag.items():
            out[21 + k] = math.sqrt(n / len(words))
        return out

    def plain(text):
        data, words, at = (text or "").encode(), [], 0
        while at < len(data):
            end = at
            while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            if end > at:
                words.append((at, end))
            at = end + 1
        groups = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)] or [[]]
        edges = [0, *[g[0][0] for g in groups[1:]], len(data)]
        hidden, energy = [], []
        for g, begin, end in zip(groups, edges[:-1], edges[1:], strict=True):
            x = (np.array(features(data, begin, end, g)) - m.mean) / m.scale
            h = [math.tanh(sum(x[i] * m.p["W"][i, j] for i in range(len(x))) + m.p["b"][j]) for j in range(len(m.p["b"]))]
            gate = [math.tanh(sum(h[i] * m.p["V"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * m.p["U"][i, j] for i in range(len(h))))) for j in range(len(m.p["w"]))]
            hidden.append(h)
            energy.append(math.exp(sum(a * b for a, b in zip(gate, m.p["w"], strict=True))))
        z = [sum(e * h[j] for e, h in zip(energy, hidden, strict=True)) / sum(energy) for j in range(len(m.p["c"]))]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, m.p["c"], strict=True)) - m.p["d"][0]))

    want = [plain(t) for t in texts]
    values = [None if t is None else t.encode() for t in texts]
    assert m.scores(values) == pytest.approx(want, abs=1e-5)
    assert [m.scores([v])[0] for v in values] == pytest.approx(want, abs=1e-5)  # whatever texts stand beside it


def test_attention_gradient():
    r = np.random.default_rng(0)
    m, first, y = quality.Model(), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(7, quality.FEATURES))
    loss = lambda: -np.mean(y * np.log(m.forward(x, first)["y"]) + (1 - y) * np.log(1 - m.forward(x, first)["y"]))
    g = m.gradient(m.forward(x, first), y, first)
    for k, at in (("W", (3, 2)), ("b", (1,)), ("V", (2, 1)), ("U", (2, 1)), ("w", (3,)), ("c", (4,)), ("d", (0,))):
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# 7. Mixing


def test_mix(docs, none):
    assert mixing.mix(none).count() == 0
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(ROWS)
    sizes = Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(words_of(t.encode() if t else None))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rate = left / sum(w for s, w in weight.items() if s not in full)
        over = {s for s in order if s not in full and weight[s] * rate > 2 * sizes[s]}
        if not over:
            break
        full |= over
        left -= sum(2 * sizes[s] for s in over)
    for s in order:
        target[s] = 2 * sizes[s] if s in full else weight[s] * rate
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.PACKET for s in order)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    queue = mixing.queue(docs).collect()
    assert [r.virtual_finish for r in queue] == sorted(r.virtual_finish for r in queue)
    assert sum(r.words for r in queue) == sum(taken.values())
    # By hand: packets of each source's turns, sorted by virtual finish time, until the budget is served.
    hashed = lambda d, t: hashlib.md5(f"7|{'null' if d is None else d}|{'null' if t is None else hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
    packets = []
    for s in order:
        rows, at = sorted((hashed(d, t), d, len(words_of(t.encode() if t else None))) for d, t, _, x, *_ in ROWS if x == s), 0
        for turn in (0, 1):
            for h, d, n in rows:
                for k in range(0, n, mixing.PACKET):
                    at += min(mixing.PACKET, n - k)
                    packets.append((at / weight[s], order.index(s), h, min(mixing.PACKET, n - k)))
    left, want = int(1.5 * sum(sizes.values())), Counter()
    for _, _, h, n in sorted(packets):
        want[h] += min(n, left)
        left -= min(n, left)
    assert {h: n for h, n in want.items() if n} == {h: n for h, n in ((h, sum(r.words for r in queue if r.h == h)) for h in {r.h for r in queue}) if n}


# 8. Near duplicates


def brute_components():
    sets = []
    for d, t, *_ in ROWS:
        w = words_of(t.encode() if t else None)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((-1 if d is None else d, len(s), -1 if d is None else root(d), d is None or root(d) == d) for d, s in sets)


def test_near_duplicates(docs, none, monkeypatch):
    want = brute_components()
    rows = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())
    assert rows(setsketch.near_duplicates(docs)) == want
    monkeypatch.setattr(setsketch, "BLOCK", 2)
    assert rows(setsketch.near_duplicates(docs)) == want
    assert setsketch.near_duplicates(none).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = x[:2500], x[500:]
    ra, rb = setsketch.registers(setsketch.minima(a)), setsketch.registers(setsketch.minima(b))
    assert (setsketch.merge(ra, rb) == setsketch.registers(setsketch.minima(x))).all()
    j = setsketch.estimate(ra[None], rb[None], np.array([2500.0]), np.array([2500.0]))[0]
    assert abs(j - 2000 / 3000) < 0.12


# 9. Decontamination


def test_decontamination(spark, docs, none):
    r = random.Random(6)
    items = [(i, prose(r, r.randint(12, 50)), 0.5) for i in range(30)]
    items += [(90, items[0][1], 0.5), (91, None, 0.5), (92, "", 0.5), (93, "three word item", 0.5), (None, prose(r, 20), 0.5)]
    leaky, want = [], set()
    for i in range(30):
        words = items[i][1].split()
        for edits in (0, 1, 3, 6):
            w = list(words)
            for k in r.sample(range(len(w)), min(edits, len(w))):
                w[k] = "changed" + str(r.random())
            leaky.append((1000 + len(leaky), prose(r, r.randint(0, 60)) + " " + " ".join(w) + " " + prose(r, 40)))
    leaky += [(2000, "here a THREE word\nItem stands"), (None, items[1][1]), (2001, items[2][1])]
    for d, t in leaky:
        h = shingle_hashes(Words([t.encode()]).hashes).tolist()
        for i, text, _ in items[:30]:
            s = Counter(shingle_hashes(Words([text.encode()]).hashes).tolist())
            n = sum(s.values())
            if max(decontam.weighted(Counter(h[k : k + n]), s) for k in range(max(1, len(h) - n + 1))) >= 0.75:
                want.add((d, i))
    want.add((2000, 93))
    bench = spark.createDataFrame(items, "item_id long, text string, similarity double")
    rows = spark.createDataFrame(leaky, "doc_id long, text string")
    got = decontam.leaks(rows, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert decontam.leaks(docs, bench).count() == 0
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(rows, bench.limit(0)).count() == 0
    assert {x.doc_id for x in decontam.clean(rows, bench).collect()} == {d for d, _ in leaky} - {d for d, _ in want if d is not None}


def test_long_texts_in_pieces(monkeypatch):
    r = np.random.default_rng(8)
    word = lambda: b"w%d" % r.integers(0, 300)
    items = [(i, b" ".join(word() for _ in range(r.integers(3, 40)))) for i in range(60)]
    text = b" ".join(x for _ in range(200) for x in (items[r.integers(0, 60)][1], word(), items[r.integers(0, 60)][1][: r.integers(0, 90)]))
    known, words = decontam.Items(items), decontam.Words([text]).hashes
    whole = known.leaks(words)
    assert len(whole) >= 50 and all(like == 1 for like, _ in whole.values())
    monkeypatch.setattr(decontam, "PIECE", 16)
    assert known.leaks(words) == whole


def test_blocks_guarantee_the_radius_and_prune():
    r = np.random.default_rng(5)
    prints = r.integers(0, 1 << 16, (40, decontam.BLOCKS)).astype(np.uint16)
    index = decontam.Index(prints)
    for _ in range(500):
        i = int(r.integers(0, 40))
        bits = np.unpackbits(prints[i : i + 1].view(np.uint8), bitorder="little")
        bits[r.choice(len(bits), r.integers(0, decontam.RADIUS + 1), replace=False)] ^= 1
        w, found = index.near(np.packbits(bits, bitorder="little").view(np.uint16)[None])
        assert i in found.tolist() and not w.any()
    random_windows = r.integers(0, 1 << 16, (5000, decontam.BLOCKS)).astype(np.uint16)
    w, i = index.named(random_windows)
    assert 0.15 < len(w) / (5000 * 40) < 0.25  # of all pairs, so many are compared
    far = np.bitwise_count(random_windows[:, None, :] ^ prints[None]).sum(2)
    assert {(a, b) for a, b in zip(*index.near(random_windows), strict=True)} == set(zip(*np.nonzero(far <= decontam.RADIUS), strict=True))


# 10. Sharding


def test_shards(docs, none):
    got = kdshard.shards(docs, 6).collect()
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(6))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    sums = [sum(r.size for r in by[s]) for s in range(6)]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    many = 0
    for n in (6, 3):
        placed = kdshard.shards(docs, n).collect()
        share, texts_of = sum(r.size for r in placed) / n, defaultdict(list)
        for r in placed:
            texts_of[r.text_crc32, r.size].append(r.shard)
        many += sum(len(v) > 1 for v in texts_of.values())
        assert all(len(set(v)) == 1 for (_, size), v in texts_of.items() if size * len(v) <= share)
    assert many
    assert kdshard.shards(none).count() == 0


def test_tree_is_that_of_plain_loops(spark):
    r = np.random.default_rng(9)
    n, room = 300, [3.0, 1.0, 2.0, 2.0, 4.0]
    pts = [(i, int(r.integers(1, 50)), float(r.integers(0, 40)), float(r.normal()), int(r.integers(0, 1 << 30))) for i in range(n)]
    got = {x.i: x.shard for x in kdshard.tree(spark.createDataFrame(pts, "i int, bytes long, d_a double, d_b double, tie long"), ["d_a", "d_b"], room).collect()}
    whole = [max(p[d] for p in pts) - min(p[d] for p in pts) for d in (2, 3)]
    want = {}

    def split(some, first, k):
        if k == 1:
            want.update({p[0]: first for p in some})
            return
        spread = [(max(p[d] for p in some) - min(p[d] for p in some)) / whole[d - 2] for d in (2, 3)]
        d = 2 if spread[0] >= spread[1] else 3
        lo, hi = min(p[d] for p in some), max(p[d] for p in some)
        key = lambda p: (min((1 << 30) - 1, math.floor((p[d] - lo) / ((hi - lo) or 1.0) * float(1 << 30))), p[4])
        some = sorted(some, key=key)
        goal, below, at = sum(p[1] for p in some) * sum(room[first : first + k // 2]) / sum(room[first : first + k]), 0, 0
        while at < len(some) - 1 and below + some[at][1] <= goal:
            below, at = below + some[at][1], at + 1
        if abs(below + some[at][1] - goal) <= abs(below - goal):
            at += 1
        split(some[:at], first, k // 2)
        split(some[at:], first + k // 2, k - k // 2)

    split(pts, 0, len(room))
    assert got == want


def test_heavy_groups_are_whole_where_they_fit():
    out, room = kdshard._place([(1, 10, 1, 9), (2, 10, 2, 5), (3, 10, 3, 4), (4, 10, 4, 30), (5, 500, 5, 1)], 100.0, 6)
    pieces = Counter(x[0] for x in out)
    assert pieces[1] == pieces[2] == pieces[3] == pieces[5] == 1 and pieces[4] >= 3
    assert all(math.isclose(sum(x[4] - x[3] for x in out if x[0] == h), 1) for h in pieces) and min(room) >= 0


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(3)
    rows = []
    for i in range(240):
        text = prose(r, r.randint(40, 90))
        rows.append((i, text.upper().replace(" ", "!! ") if i % 4 == 0 else text, "en", f"s{i % 3}", len(text)))
    rows += [(300 + i, rows[1][1], "en", "s0", 1) for i in range(5)]
    item = prose(r, 30)
    rows.append((400, rows[2][1] + " " + item + " " + prose(r, 200), "en", "s1", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = []
    for _, stage in p.STAGES[:4]:  # columns that a stage might use itself, or that need quotes
        more = {"_n": F.lit(1), "_copies": F.lit(2), "_predicted": F.lit(0), "_leaked": F.lit(3), "_again": F.lit(4), "_key": F.lit("k"), "a.b": F.lit(5), "_dropped": F.lit(6), "size": F.lit(7), "c1": F.lit("c")}
        odd = spark.createDataFrame([(None, "no id", None, None, None), (500, None, "en", "s0", 1), (501, "", "en", "s1", 1), (502, "w " * 50_000, "en", "s2", 1), (502, "w " * 50_000, "en", "s2", 1)], docs.schema)
        wide = docs.unionByName(odd).withColumns(more)
        assert stage(spark, wide, str(tmp_path)).columns == wide.columns
        assert sorted(map(str, stage(spark, wide, str(tmp_path)).collect())) == sorted(map(str, stage(spark, wide.repartition(3), str(tmp_path)).collect()))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    for _, stage in p.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == columns
        kept.append([x.doc_id for x in docs.collect()])
    assert set(kept[0]) == {i for i, *_ in rows if i % 4 or i >= 240}
    assert set(kept[1]) == set(kept[0]) - set(range(300, 305)) and set(kept[2]) == set(kept[1]) - {400}
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    final = p.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sorted(x.doc_id for x in final) == sorted(kept[3])
