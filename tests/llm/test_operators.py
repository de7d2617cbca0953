"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewheel.llm import common, decontam, embeddings, langid, licenses, minhash, packing, quality, substrings, suffixes, token_shards, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"
WORDS = "the of and river mountain a license mit under ocean Éclair straße token permit sky tree 42".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    long_ = prose(rng, 4000)
    near = base[0].split(" ")
    near[3] = "changed"
    return [None, "", "a", "  ", "42 !!", *base, base[1], base[1], " ".join(near), base[2][:300] + " " + base[3], long_, long_[: len(long_) // 2]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "en", None, None, "x", 1) for i, t in enumerate(texts)]
    rows += [(7, texts[7], None, None, None, None, None), (None, "a null id is kept here", "en", "s", 3, "y", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < -1")


def words(t):
    return common.words(t)


def test_words_follow_the_pattern():
    import regex

    s = "Ab-C 9é_x\x7f\x00Zß—İK"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    assert [w.decode() for w in words(s)] == regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_word_hashes_agree_over_batches():
    h = common.WordHasher()
    a, n = h.of([b"one two", b"", b"  Two ONE x"])
    assert n.tolist() == [2, 0, 3] and a[0] == a[3] and a[1] == a[2] and len(set(a.tolist())) == 3


def test_suffix_array_and_windows_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(texts, size):
    raw = [(t or "").encode() for t in texts]
    n = Counter(x[p : p + size] for x in raw for p in range(len(x) - size + 1))
    out = []
    for x in raw:
        spans = substrings.union([(p, p + size) for p in range(len(x) - size + 1) if n[x[p : p + size]] > 1])
        left = b"".join(x[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(x)]))
        out.append((len(x), len(x) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("size, group", [(12, 2000), (60, 2000), (12, 3), (60, 2)])
def test_repeated_strings(spark, docs, nothing, size, group, monkeypatch):
    rows = docs.collect()
    monkeypatch.setattr(substrings, "PART", 5000)  # long texts are cut, parts are many
    got = substrings.remove_repeats(docs, size, group).collect()
    assert substrings.remove_repeats(nothing, size).count() == 0
    want = removed([r["text"] for r in rows], size)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((r["doc_id"], *w)) for r, w in zip(rows, want))


@pytest.mark.parametrize("limit", [2, 1000])
def test_groups_of_an_anchor_held_or_counted(limit):
    rng = random.Random(3)
    anchor = bytes(rng.choices(b"xyz", k=10))
    pieces = []
    for i in range(60):
        left, right = (bytes(rng.choices(b"ab", k=rng.randint(0, 14))) for _ in range(2))
        if len(left) + len(right) >= 10:
            pieces.append((left + anchor + right, len(left), [{"k": bytes([i]), "s": 100 * i}]))
    pieces += [(pieces[0][0], pieces[0][1], [{"k": b"copy", "s": 7}]), (pieces[1][0], pieces[1][1], [{"k": b"u", "s": 1}, {"k": b"v", "s": 2}])]
    spans, windows = [], []
    g = substrings.Group(20, limit, spans, windows)
    for p in pieces:
        g.add(*p)
    g.close()
    n = Counter(w[3] for w in windows)
    got = {}
    for k, a, b in [*spans, *((k, a, b) for k, a, b, w in windows if k is not None and n[w] > 1)]:
        got.setdefault(k, set()).update(range(a, b))
    all_ = Counter(p[i : i + 20] for p, _, who in pieces for i in range(len(p) - 19) for _ in who)
    want = {}
    for p, _, who in pieces:
        for m in who:
            for i in range(len(p) - 19):
                if all_[p[i : i + 20]] > 1:
                    want.setdefault(m["k"], set()).update(range(m["s"] + i, m["s"] + i + 20))
    assert got == want and (limit == 1000) == (not windows)


def test_documents_without_repeats_keep_their_columns(spark):
    same = "a passage that stands in two texts and has many bytes"
    rows = [(1, "first words " + same + " é end", "k1", 2), (2, same + " other text", "k2", None), (3, None, "k3", 1), (3, "short", None, 1), (4, "whole copy of one long text here", "x", 1), (5, "whole copy of one long text here", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, raw string, uses long")
    got = substrings.without_repeats(df, 30)
    assert got.columns == df.columns
    want = [(1, "first words é end", "k1", 2), (2, "other text", "k2", None), (3, None, "k3", 1), (3, "short", None, 1)]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_language(spark, docs, nothing):
    de = [(1000 + i, " ".join(random.Random(i).choice("der die und ist nicht schön straße über".split()) for _ in range(30)), "de") for i in range(40)]
    fr = [(2000 + i, " ".join(random.Random(i).choice("le la les est pas été où garçon".split()) for _ in range(30)), "fr") for i in range(40)]
    t = spark.createDataFrame([*de, *fr, (1, None, "de"), (2, "12 34", "fr"), (None, "le la les", None)], "doc_id long, text string, lang string")
    model = langid.learn(t)
    got = {r["doc_id"]: r for r in langid.identify(t, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[None]["lang_pred"] == "fr"
    assert all(got[i]["lang_pred"] == x for i, _, x in [*de, *fr])
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in de)
    assert langid.learn(nothing) is None and langid.identify(docs, None).count() == docs.count()


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(tokens.default_paths()[1], 4)
    rng = np.random.default_rng(0)
    p = rng.random((pieces.size + 1, 2))
    p[-1] = 0

    def brute(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, min(4, len(w)) + 1):
            h = 0
            for b in w[:k]:
                h = (h * int(pieces.base) + int(pieces.table[b])) & (2**64 - 1)
            total = total + p[pieces.find(np.array([h], np.uint64))[0]] * brute(w[k:])
        return total

    with np.errstate(divide="ignore"):
        logp = np.log(p)
    ws = [b" the", b" a", b" \xc3\xa9t"]
    assert np.allclose(langid.forward(pieces, logp, ws), [np.log(brute(w)) for w in ws])


def test_long_words_are_summed_like_short_ones(monkeypatch):
    pieces = langid.Pieces(tokens.default_paths()[1])
    assert pieces.longest > 10
    rng = random.Random(4)
    ws = [b" " + bytes(rng.choices(b"theonandri", k=n)) for n in (1, 5, 30, 63, 64, 90)]
    counts = {w: np.array([1.0 + k, 2.0]) for k, w in enumerate(ws)}
    short, logp = {}, {}
    for limit in (3, 1000):
        monkeypatch.setattr(langid, "LONG", limit)
        logp[limit] = langid.fit(counts, pieces, 2)
        short[limit] = langid.forward(pieces, logp[limit], ws)
    assert np.allclose(logp[3], logp[1000]) and np.allclose(short[3], short[1000])
    p = np.exp(logp[3])
    whole = langid.Chain(pieces, p, ws[-1]).forward()[0]
    assert np.allclose(langid.Chain(pieces, p, ws[-1], 7).forward()[0], whole)
    assert np.isfinite(langid.Chain(pieces, p, b" " + b"ab" * 20_000).forward()[0]).all()


def test_expected_counts_by_brute_force():
    pieces = langid.Pieces(tokens.default_paths()[1], 4)
    words_, codes = {b" the": 3.0, b" on": 1.0}, {}

    def piece(x):
        h = 0
        for b in x:
            h = (h * int(pieces.base) + int(pieces.table[b])) & (2**64 - 1)
        return int(pieces.find(np.array([h], np.uint64))[0])

    def cuts(w):
        if not w:
            yield []
        for k in range(1, min(4, len(w)) + 1):
            if piece(w[:k]) >= 0:
                for rest in cuts(w[k:]):
                    yield [piece(w[:k]), *rest]

    p = np.zeros(pieces.size + 1)
    p[:-1] = 1.0 / 256.0 ** pieces.lengths.clip(max=3)
    p /= p.sum()
    expected = np.zeros(pieces.size + 1)
    for w, n in words_.items():
        all_ = [(c, np.prod(p[c])) for c in cuts(w)]
        total = sum(v for _, v in all_)
        for c, v in all_:
            for k in c:
                expected[k] += n * v / total
    want = expected[:-1] + 0.01
    got = np.exp(langid.fit({w: np.array([n]) for w, n in words_.items()}, pieces, 1, rounds=1))[:-1, 0]
    assert np.allclose(got, want / want.sum())


def test_decontamination(spark, docs, nothing, texts):
    longest = words(texts[-2])
    bench = [(1, b" ".join(longest[10:30]).decode()), (10, b" ".join(longest[50:70]).decode()), (2, "mountain"), (3, ""), (4, None), (None, "sky"), (2, "mountain"), (5, "zzz qqq not here at all ever so long")]
    b = spark.createDataFrame(bench, "item_id long, text string")

    def brute(t):
        ws, hit, items = words(t), set(), set()
        for i, x in bench:
            own = words(x)
            n = min(8, len(own))
            for s in range(len(own) - n + 1 if n and i is not None else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == own[s : s + n]:
                        hit.update(range(p, p + n))
                        items.add(str(i))
        return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2

    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(repr((r["doc_id"], *brute(r["text"]))) for r in docs.collect())
    for limit in (32 << 20, 40):  # one block, and several
        got = decontam.match(docs, b, limit_bytes=limit).select(cols).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
    assert decontam.match(nothing, b).count() == 0
    assert decontam.match(docs, b.where("item_id < 0")).where("n_items > 0").count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_contained_items_by_brute_force(spark, threshold):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(25)]
    items[3] = ["a", "b"] * 12  # repeated shingles
    rows = []
    for d in range(60):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            own = list(rng.choice(items))
            if rng.random() < 0.7 and len(own) > 3:
                own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.3:
                own = own[: len(own) // 2] + ["x"] * 20 + own[len(own) // 2 :]  # apart: no window has it
            ws += own + [rng.choice(vocabulary)]
        rows.append((d, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")

    def shares(ws):
        out = {}
        for i, own in enumerate(items):
            n = min(4, len(own))
            sets = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            best = 0
            for s in range(max(1, len(ws) - len(own) + 1)):
                part = ws[s : s + len(own)]
                best = max(best, len(sets & {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}))
            if best and best >= np.ceil(threshold * len(sets) - 1e-9):
                out[str(i)] = best / len(sets)
        return out

    for limit in (32 << 20, 500):
        got = {r["doc_id"]: r for r in decontam.match(docs, bench, window=4, threshold=threshold, limit_bytes=limit).collect()}
        found = 0
        for d, t in rows:
            want = shares(t.split())
            found += len(want)
            assert got[d]["contained"] == sorted(want)
            best = min(want, key=lambda i: (-want[i], i), default=None)
            assert got[d]["best_item"] == best and got[d]["best_containment"] == want.get(best, 0.0)
        assert found > 20


def test_cut_spans():
    assert decontam.cut_spans("One, two THREE four.", [[1, 3]]) == "One,  four."


def test_token_ids_equal_the_library(texts):
    f = tokens.bpe(*tokens.default_paths())
    rng = random.Random(2)
    extra = ["".join(rng.choice("abZé'stdrvmel  \n\t\r190_-.!ßñ²Ⅷ中 \x1c\x85<|endoftext|>") for _ in range(30)) for _ in range(500)]
    some = [t or "" for t in texts] + extra
    assert [x.tolist() for x in f.encode(some)] == [e.ids for e in f.slow.encode_batch(some, add_special_tokens=False)]


def test_token_ids_of_clashing_hashes_and_cut_texts(texts):
    rng = random.Random(3)
    extra = ["".join(rng.choice("abZé''stdrvmel  \n\t\r190_-.!ßñ\x00\x0b\x1b") for _ in range(rng.randrange(60))) for _ in range(1000)]
    some = [t or "" for t in texts] + extra
    want = [e.ids for e in tokens.bpe(*tokens.default_paths()).slow.encode_batch(some, add_special_tokens=False)]
    for f in (tokens.FastBPE(*tokens.default_paths(), limit=50, block=16), tokens.FastBPE(tokens.default_paths()[0])):
        assert [x.tolist() for x in f.encode(some)] == want
    f = tokens.FastBPE(*tokens.default_paths())
    f.hasher.table[:] = 1  # words of one length have one hash
    assert [x.tolist() for x in f.encode(some)] == want and [x.tolist() for x in f.encode(some)] == want


def test_packing(spark, docs, nothing):
    f = tokens.bpe(*tokens.default_paths())
    got = packing.pack(docs, capacity=64).collect()
    bins, by = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(bins) <= total / 64 * 1.15 + 2
    for r in docs.where("doc_id is not null and doc_id <> 7").collect():
        ids = [*f.encode([r["text"]])[0].tolist(), 0]
        want = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
        assert sorted(by[r["doc_id"]]) == want
    assert packing.pack(nothing).count() == 0


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 11, 200)
    bins, offsets = packing.sum_of_squares(lengths, 10)
    gap, n = {}, Counter()
    for size, b, off in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        before = gap.get(b, 10)
        assert off == 10 - before and before >= size

        def after(g):
            m = n.copy()
            if g < 10:
                m[g] -= 1
            if g - size:
                m[g - size] += 1
            return sum(v * v for v in m.values())

        choices = [g for g in range(size, 11) if g == 10 or n[g] > 0]
        assert after(before) == min(after(g) for g in choices)
        if before < 10:
            n[before] -= 1
        gap[b] = before - size
        if gap[b]:
            n[gap[b]] += 1


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 257, 5000):
        assert sorted(token_shards.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


def test_token_shards_round_trip(spark, docs, nothing, tmp_path):
    out = f"file://{tmp_path}/s"
    got = token_shards.write_shards(docs, out, length=32, shard_sequences=16).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(len(got)))
    f = tokens.bpe(*tokens.default_paths())
    parts = {}
    for (ids, (size, who, starts, places)), r in zip(token_shards.read(out, 0, len(got)), got):
        assert common.crc_of(ids) == r["ids_crc32"] and size == len(ids) == r["n_tokens"]
        for k, (d, s, p) in enumerate(zip(who, starts, places)):
            parts.setdefault(d, []).append((s, ids[p : (places + [size])[k + 1]].tolist()))
    for r in docs.where("doc_id <> 7").collect():
        assert sum((x for _, x in sorted(parts[r["doc_id"]])), []) == [*f.encode([r["text"]])[0].tolist(), 0]
    assert len(list(token_shards.read(out, 20, 3))) == 3
    assert token_shards.write_shards(nothing, f"file://{tmp_path}/e").count() == 0


def test_log_count_ratios_and_features_by_brute_force():
    f = quality.Features(17)
    ts = ["One two two three", None, "", "a b c d e f g a a"]
    got = f.of(ts)
    assert [len(x) for x in got][1:3] == [0, 0] and all(len(set(x.tolist())) == len(x) for x in got)
    again = quality.Features(17).of([ts[3]])[0]
    assert set(again.tolist()) == set(got[3].tolist())
    n1, n0 = np.array([3.0, 0.0, 5.0]), np.array([1.0, 2.0, 5.0])
    want = [np.log(((a + 1) / 11) / ((b + 1) / 11)) for a, b in zip(n1, n0)]
    assert np.allclose(quality.log_count_ratio(n1, n0), want)


def test_dual_descent_finds_the_least_hinge_loss():
    rng = np.random.default_rng(2)
    size, n, cost = 12, 40, 0.7
    ratio = rng.standard_normal(size)
    rows = [np.flatnonzero(rng.random(size) < 0.4) for _ in range(n)]
    rows = [r if len(r) else np.array([0]) for r in rows]
    y = np.where(rng.random(n) < 0.6, 1.0, -1.0)
    x = np.zeros((n, size + 1))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, -1] = 1.0  # the bias is a weight of its own
    c = cost * np.where(y > 0, 1.0, max(1.0, (y > 0).sum() / (y < 0).sum()))
    loss = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    w, bias = quality.dual_descent(rows, y, ratio, cost, 3000)
    found = loss(np.append(w, bias))
    # Projected gradient ascent on the dual bounds the least loss from below.
    q = (y[:, None] * x) @ (y[:, None] * x).T
    a = np.zeros(n)
    for _ in range(60_000):
        a = np.clip(a + (1 - q @ a) / np.linalg.norm(q, 2), 0, c)
    assert a.sum() - 0.5 * a @ q @ a <= found + 1e-9 <= a.sum() - 0.5 * a @ q @ a + 1e-2 * found


def test_quality_of_clashing_labels_and_columns(spark):
    rows = [(i, "good plain words here" if i % 2 else "X!! Y!! Z!!", "t", 1) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, y string, most int")
    marks = [(i, i % 2) for i in range(40)]
    twice = [*marks, *marks, (3, 0), (4, 1)]  # two clash
    one = quality.fit(d, spark.createDataFrame([m for m in marks if m[0] not in (3, 4)], "doc_id long, quality int"))
    two = quality.fit(d, spark.createDataFrame(twice, "doc_id long, quality int"))
    assert np.array_equal(one.gain, two.gain)
    assert quality.score(d.where("doc_id < 0"), two).count() == 0
    assert quality.score(d.union(spark.createDataFrame([(77, "long " * 60_000, None, None)], d.schema)), two).count() == 41


def test_quality(spark, nothing):
    rng = random.Random(0)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        t = prose(rng, 40)
        rows.append((i, t if good else t.upper().replace(" ", "!! ")))
        if i % 10:
            marks.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (None, "text")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(d, quality.fit(d, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    assert quality.fit(nothing, labels) is None and quality.score(d, None).count() == len(rows)


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 3000
    rows = [(3, "http://a/", big), (1, None, big), (2, "u\r\n", ""), (9, "x", None), (4, "y", "<b>"), (4, "y", "<b>"), (None, "z", "<b>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least in (0, 5):
        got = warc.read(warc.write(pages, min_bytes=least), payloads=True).collect()
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", 99), i)
        want = []
        for i, _, h in rows:
            raw = (h or "").encode()
            again = len(raw) >= least and i != first[h or ""]
            want.append((i, len(raw), warc.base32_sha1(raw), "revisit" if again else "response", first[h or ""] if again else None))
        assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, want))
        assert all(bytes(r["payload"]) in (big.encode(), b"", b"<b>") for r in got if r["record_type"] == "response")
        assert max(r["segments"] for r in got) > 2
    assert warc.read(warc.write(pages.where("page_id < 0"))).count() == 0
    extra = pages.withColumn("key", F.lit("k")).withColumn("first", F.lit(1)).withColumn("data", F.lit("d"))
    assert warc.read(warc.write(extra)).count() == len(rows)
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab\r\n0\r\n\r\n")


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    v = [(centres[i % 60] + 0.12 * rng.standard_normal(16)).astype("float32").tolist() for i in range(600)]
    v[5] = v[4]
    rows = [(i, x, 0) for i, x in enumerate(v)]
    bad = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [None] + [1.0] * 15, 0), (1003, [float("nan")] * 16, 0), (1004, [], 0), (1005, [1.0, 2.0], 0)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    x = embeddings.unit(np.array(v, float))
    links = (x @ x.T) >= 0.95
    np.fill_diagonal(links, False)
    for block in (1024, 40):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, leaf_rows=64, block_rows=block).collect()}
        assert len(got) == 606 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i, *_ in bad)
        n = np.array([got[i]["n_links"] for i in range(600)])
        assert (n <= links.sum(1)).all() and n.sum() >= 0.9 * links.sum()
        assert all(got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i) for i in range(600))
    assert embeddings.near_duplicates(df.where("vec_id > 999 and vec_id < 1005")).count() == 5


def test_embeddings_of_several_lengths_and_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 7), (2, [1.0, 2.0], 7), (3, [2.0, 4.01], 7), (4, [1.0, 0.0, 0.0], 7), (5, [1.0, 0.01, 0.0], 7), (6, [0.0, 1.0, 0.0], 7)]
    rows += [(None, [1.0, 2.0], 7), (6, [0.0, 0.0, 1.0], 7), (9, [5.0], 7), (4, [1.0, 0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long").withColumn("copies", F.lit("x"))
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False)]
    want += [(6, 0, 6, True), (6, 0, 6, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_embeddings_keep_the_links_of_a_dense_group_at_depth(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4500, 64))
    x[:1500] = rng.standard_normal(64) + 0.2 * x[:1500]  # a third, with pairwise cosines of about 0.96
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    y = embeddings.unit(x)
    links = (y @ y.T) >= 0.95
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, leaf_rows=4).collect()}  # 9 levels, as of 130,000 rows
    n = np.array([got[i]["n_links"] for i in range(4500)])
    assert (n <= links.sum(1)).all() and n.sum() >= 0.9 * links.sum()
    assert {got[i]["component_id"] for i in range(1500)} == {0}


def test_near_duplicates(spark, docs, nothing):
    got = minhash.classes(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and len(a & b) >= 0.8 * max(len(a), len(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by == {i: find(i) for i in root}
    assert minhash.classes(nothing).count() == 0


def test_banding_bounds():
    for p in range(7):
        j = minhash.jaccard_bound(p, 0.8)
        b, r = minhash.tune(j)
        assert b * r <= 128 and (j >= 1 or (1 - j**r) ** b <= 1.01e-3)


def test_licenses(spark, docs, nothing):
    full = licenses.TEMPLATES["bsd-notice"]
    extra = [(500, f"intro\n{full.upper()}.\nend", *[None] * 5), (501, "Under the MIT License, under the mit license; CC BY-NC 4.0", *[None] * 5), (502, " ".join(full.split()[:12]), *[None] * 5)]
    t = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r["doc_id"]: r for r in licenses.scan(t).collect()}
    assert got[500]["labels"] == "bsd-notice" and got[500]["base_labels"] == "" and got[500]["score"] == 1.0
    assert (got[501]["n_base"], got[501]["first_word"], got[501]["last_word"], got[501]["base_labels"]) == (3, 0, 8, "cc-by-nc,mit")
    assert got[502]["labels"] == "" and got[0]["n_words"] == 0 and got[0]["first_word"] is None
    for r in t.where("doc_id is not null").collect():
        ws, at = words(r["text"]), []
        for p in licenses.PHRASES:
            q = p.encode().split()
            at += [i for i in range(len(ws) - len(q) + 1) if ws[i : i + len(q)] == q]
        assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_base"]) == (len(ws), len(at))
    assert licenses.scan(nothing).count() == 0
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()


def test_licenses_in_wrapped_notices(spark):
    import textwrap

    rows, want = [], {}
    for i, (label, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        for width in (72, 80):
            lines = textwrap.wrap(f"words of another kind stand here {t} and so they do behind it", width)
            rows.append((10 * i + width % 7, "\n".join(f" * {x}" for x in lines)))
            want[rows[-1][0]] = label
    far = licenses.TEMPLATES["bsd-notice"].split()
    rows.append((900, "\n".join(w + " apple" * 30 for w in far)))  # its words, but nowhere together
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1.0 for i, label in want.items())
    assert got[900]["labels"] == "" and got[900]["score"] == 0.0


def test_lookup_and_components(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, key string")
    right = left.where("key is not null").groupBy("key").agg(F.count("*").alias("uses"), F.min("id").alias("first"))
    for hot in (1, 2, 1000):
        got = common.lookup(left, right, "key", "uses", hot).collect()
        assert len(got) == 301 and all(r["first"] == (1 if r["key"] == "hot" else r["id"]) for r in got if r["key"])
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["v"]: r["c"] for r in common.components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 103: 100}


def test_token_shards_shuffle_little(spark, tmp_path):
    """Few of the shards' bytes pass the shuffle, also where a bundle is a single sequence."""

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p: p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}

    rng = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(5000)]
    share = 1 / np.arange(10, 5010)
    rows = [(i, " ".join(rng.choice(vocabulary, 3000, p=share / share.sum()))) for i in range(60)]
    before = shuffled()
    out = f"file://{tmp_path}/s"
    got = token_shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), out, shard_sequences=4)
    got = got.select("slot", "n_tokens", "ids_crc32").collect()
    passed = sum(size for p, size in shuffled().items() if p not in before)
    f = tokens.bpe(*tokens.default_paths())
    assert sum(r["n_tokens"] for r in got) == sum(len(x) + 1 for x in f.encode([t for _, t in rows]))
    assert {r["slot"]: r["ids_crc32"] for r in got} == {k: common.crc_of(ids) for k, (ids, _) in enumerate(token_shards.read(out, 0, len(got)))}
    whole = sum(p.stat().st_size for p in tmp_path.rglob("*.bin"))
    print("share", passed / whole)
    assert passed < 0.6 * whole


def test_ids_are_squeezed_exactly():
    order = np.random.default_rng(0).permutation(1 << 16).astype("<u2")
    ids = np.concatenate([np.arange(1 << 16), [0, 65535, 7]]).astype("<u2")
    data = token_shards.squeeze(ids, np.argsort(order).astype("<u2"), zstandard.ZstdCompressor())
    assert (token_shards.unsqueeze(data, order, zstandard.ZstdDecompressor()) == ids).all()
