import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import ODD, text

from pellucid.llm import langid, license, media, mixing, topk


# -- language ID


def language(seed, kind):
    r = random.Random(f"{kind}{seed}")
    parts = {"aa": ["la", "ti", "on", "re"], "bb": ["sch", "ung", "ei", "zu"], "cc": ["õä", "kk", "uu", "ij"]}[kind]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(r.randint(5, 150)))


def test_language_id(docs):
    rows = [(1000 + i, language(i, k), k) for i, k in enumerate(["aa", "bb", "cc"] * 100)] + [(d, t, "aa") for d, t in ODD] + [(400, "12 34 !?", "bb")]
    df = docs(rows)
    model = langid.train(df)
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    truth = {d: k for d, _, k in rows if d is not None}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    real = [r for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.held_out]
    assert len(real) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in real]) > 0.98
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert none == {100, 101, 102, 400}
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and not none & {r.doc_id for r in kept.collect()}
    again = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in got}


def test_language_id_without_labels(docs):
    df = docs([(1, "abc"), (2, None)])
    assert langid.train(df) is None
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, None).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(docs([]), None).count() == 0


def test_tables_equal_the_plain_network():
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8), r.integers(0, 2, 40)
    m = langid.fit(x, y, ["a", "b"], epochs=1)
    e = m.embed[x]
    top = []
    for k, w, b in zip(langid.WIDTHS, m.filters, m.bias):
        cols = np.concatenate([e[:, j : langid.WINDOW - k + 1 + j] for j in range(k)], 2)
        top.append(np.maximum((cols @ w.reshape(-1, langid.FILTERS) + b).max(1), 0))
    z = np.concatenate(top, 1) @ m.out + m.out_bias
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(m.probabilities(x), p, atol=1e-4)


def test_numerals_are_no_letters_and_scores_are_weighted_means(docs):
    rows = [(1000 + i, language(i, k), k) for i, k in enumerate(["aa", "bb"] * 30)]
    odd = [(1, "½ ²"), (2, "Ⅷ ①"), (3, "٣ 12 !"), (4, "x½"), (5, "ª"), (6, " ".join(language(i, "aa") for i in range(30)))]
    df = docs(rows + odd)
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred == "und" for i in range(1, 7)] == [True, True, True, False, False, False]
    for d, t, *_ in rows + odd[3:]:
        data = t.encode()
        cut = [data[i : i + 256] for i in range(0, len(data), 256)]
        x = np.stack([np.frombuffer(c.ljust(256, b"\0"), np.uint8) for c in cut])
        mean = np.average(model.probabilities(x), axis=0, weights=[len(c) for c in cut])
        assert got[d].score == pytest.approx(mean.max(), abs=1e-5) and mean[model.langs.index(got[d].lang_pred)] == pytest.approx(mean.max(), abs=1e-5)


def test_every_language_is_learned(docs):
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]} " * 9, f"l{i % 300}") for i in range(1200)]
    model = langid.train(docs(rows), per_lang=2, windows=2, most=300)
    assert len(model.langs) > 250


# -- licenses


def brute_scan(rows, templates=license.TEMPLATES):
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for d, t in rows:
        own = grams(cut(t or ""))
        for name, tt in templates.items():
            g = grams(cut(tt))
            if len(own & g) >= 0.8 * len(g):
                out.add((d, name, len(own & g), len(g)))
    return out


def test_license_scan(docs):
    r = random.Random(4)
    rows = []
    for i in range(120):
        w = text(r.randrange(3, 80), i).split()
        if i % 2:
            at = r.randrange(len(w))
            w[at:at] = r.choice(list(license.TEMPLATES.values())).replace(",", "").upper().split()
        rows.append((i, " ".join(w)))
    rows += [x for x in ODD if x[0] != 105] + [(300, "Licensed under the Apache License, Version"), (300, None)]
    got = {(r.doc_id, r.template_id, r.matched, r.total) for r in license.scan(docs(rows)).collect()}
    assert got == brute_scan(rows) and len(got) >= 50
    assert license.scan(docs([])).count() == 0
    with pytest.raises(ValueError):
        license.scan(docs([]), {"x": "too short"})


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_license_scan_finds_edited_notices(docs, monkeypatch, broadcast):
    """Long templates with words replaced, dropped and added, down to the least containment; equal rows; both kinds of join."""
    monkeypatch.setattr(license, "BROADCAST_ROWS", broadcast)
    r = random.Random(11)
    templates = {f"t{n}": text(n, 900 + n) for n in (5, 14, 15, 16, 30, 90, 300)}
    rows = []
    for i in range(500):
        name = r.choice(list(templates))
        w = templates[name].split()
        for _ in range(r.randrange(0, len(w) // 22 + 2)):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = [f"x{i}"] * r.randrange(2)
        at = r.randrange(60)
        around = text(120, i).split()
        rows.append((i, " ".join(around[:at] + w + around[at:])))
    rows += rows[:20]
    want = brute_scan(rows, templates)
    got = [(x.doc_id, x.template_id, x.matched, x.total) for x in license.scan(docs(rows), templates).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) >= 200 and len(got) >= 0.995 * len(want)


# -- mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by capping one by one."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        total = sum(w[s] for s in names if s not in capped)
        t = {s: cap * sizes[s] if s in capped else left * w[s] / total for s in names}
        over = {s for s in names if s not in capped and t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixing(docs, scratch, monkeypatch):
    r = random.Random(6)
    rows = [(i, text(r.randrange(1, 400), i), None, r.choice(["b", "b", "b", "b", "a", "é", "z"])) for i in range(300)]
    rows += [(1000 + i, text(20, i), None, None) for i in range(5)] + [(d, t, None, "c") for d, t in ODD if d != 107]
    df = docs(rows)
    out = mixing.mix(df, scratch, ["doc_id", "source"], block=64, shards=8).select("row.doc_id", "row.source", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"), "pieces").collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for x in out:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.taken <= 3 * x.size
        assert sum(p.length for p in x.pieces) == x.taken
    want = fill(sizes)
    for x in out:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5
    blocks: dict = {}
    for x in out:
        for p in x.pieces:
            blocks.setdefault((x.source, p.block), set()).add(p.shard)
    assert all(len(s) == 1 for s in blocks.values())  # a block goes to one shard
    per_shard = np.bincount([next(iter(s)) for s in blocks.values()], minlength=8)
    assert per_shard.max() - per_shard.min() <= 3  # halves of halves
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    again = mixing.mix(df, scratch, ["doc_id", "source"], block=64, shards=8).select("row.doc_id", mixing.taken(F.col("pieces")).alias("taken")).collect()
    key = lambda rs: sorted((x.doc_id is None, x.doc_id or 0, x.taken) for x in rs)
    assert key(again) == key(out)
    assert mixing.mix(docs([]), scratch, ["doc_id"]).count() == 0


def test_apply_keeps_columns_and_words(docs, scratch):
    rows = [(i, text(50, i), "en", "a" if i % 10 else "b") for i in range(60)]
    df = docs(rows)
    out = mixing.apply(df, scratch)
    assert out.columns == df.columns
    got: dict = {}
    for x in out.collect():
        got[x.source] = got.get(x.source, 0) + len(x.text.split())
        assert dict((i, t) for i, t, *_ in rows)[x.doc_id].startswith(x.text) and x.n_chars == len(x.text)
    want = fill({"a": 54 * 50, "b": 6 * 50})
    assert all(abs(got[s] - want[s]) <= 0.5 for s in want)


def log_p(pop, good, draws, x):
    f = lambda n: math.lgamma(n + 1)
    return f(good) - f(x) - f(good - x) + f(pop - good) - f(draws - x) - f(pop - good - draws + x) - f(pop) + f(draws) + f(pop - draws)


@pytest.mark.parametrize("pop,good,draws", [(50, 20, 25), (10, 10, 4), (7, 0, 3), (3_600, 1_800, 1_800), (100_000, 50_000, 60_000), (360_000, 180_000, 180_000), (1_000_000, 900_000, 700_000), (36_000_000, 18_000_000, 18_000_000), (10**9, 10**8, 5 * 10**8)])
def test_hypergeometric_draws(spark, pop, good, draws):
    """Against the exact distribution, at deviations of 0 to 5000."""
    u = lambda c: (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    x = mixing.hypergeometric(F.lit(pop).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"), u(1), u(2))
    n = 4000
    got = np.array([r.x for r in spark.range(n).select(x.alias("x")).collect()])
    lo, hi = max(0, draws - (pop - good)), min(good, draws)
    assert got.min() >= lo and got.max() <= hi
    mean, sd = draws * good / pop, (draws * good / pop * (1 - good / pop) * (pop - draws) / max(1, pop - 1)) ** 0.5
    assert abs(got.mean() - mean) <= 5 * sd / n**0.5 + 1e-9 and abs(got.std() - sd) <= 0.1 * sd + 1e-9
    if sd < 3:
        return
    # chi-square over 20 bins of about equal probability
    a, b = max(lo, int(mean - 8 * sd)), min(hi, int(mean + 8 * sd))
    cdf = np.cumsum(np.exp([log_p(pop, good, draws, k) for k in range(a, b + 1)]))
    cdf /= cdf[-1]
    cuts = np.unique(np.searchsorted(cdf, np.arange(1, 20) / 20))
    p = np.diff(np.concatenate([[0], cdf[cuts], [1]]))
    seen = np.bincount(np.searchsorted(a + cuts, got, "left"), minlength=len(p))
    assert ((seen - n * p) ** 2 / (n * p)).sum() < 50  # 19 degrees of freedom: above 50 once in 8000


def test_shards_hold_random_blocks_of_many_sources(spark):
    rows = [(f"{i:05d}", 10 + i % 7) for i in range(5000)]
    got = mixing.split_tree(spark.createDataFrame(rows, "key string, blocks long"), 8, 3).collect()
    assert len(got) == 5000
    counts = np.array([np.diff([0, *r.bounds]) for r in got])
    assert {r.key: r.bounds[-1] for r in got} == dict(rows) and counts.min() >= 0
    assert counts.sum(0).max() - counts.sum(0).min() <= 1
    expect = counts.sum(1)[:, None] / 8
    assert 0.9 < ((counts - expect) ** 2 / expect).sum() / (5000 * 7) < 1.1
    again = mixing.split_tree(spark.createDataFrame(rows[::-1], "key string, blocks long"), 8, 3).collect()
    assert sorted(again) == sorted(got)


# -- top-k


def brute_top(rows, k):
    good = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            s = sorted((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(r.normal(size=4), 1)]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)] + [(260, None), (261, [1.0, None]), (262, [float("nan")] * 4), (280, [float("inf")] * 4), (None, [1.0] * 4), (300, []), (320, [1.0, 2.0]), (321, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as vector", "1 as uid", "2 as shard").repartition(4)
    for size in (7, 1000):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, query_rows=5, shard_rows=size).collect()
        assert sorted(map(tuple, got)) == brute_top(rows, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact():
    a, b = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0]])
    assert topk._products(a, b)[0, 0] == 2**60 + 3
    with pytest.raises(OverflowError):
        topk._products(np.array([[2.0**40]]), np.array([[2.0**40]]))


# -- media


def test_media_payload_that_looks_like_a_tag(docs, scratch):
    texts = ["x" * (192 * n + 89) + "TAG" + "y" * 100 for n in (0, 1, 5)]
    got = media.media_table(docs(list(enumerate(texts))), scratch).collect()
    want = [(i, len(t), hashlib.sha256(media.padded(t.encode())).hexdigest()) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == want
    for t in texts:
        data = media.wrap(media.padded(t.encode()), len(t))
        title = b"TAG" + b"a title".ljust(125, b"\0")
        for tail, tags in ((b"", 0), (title, 1), (media.HEAD + bytes(120) + title, 1)):
            s = media.parse(data + tail)
            assert media.unwrap(data, s) == media.padded(t.encode()) and ("title" in s.tags) == tags
        s = media.parse(data[: -media.SIZE] + b"foreign" + data[-media.SIZE :])
        assert media.unwrap(data[: -media.SIZE] + b"foreign" + data[-media.SIZE :], s) == media.padded(t.encode())


def test_media_round_trip(docs, scratch):
    rows = [(i, text(r, i)) for i, r in enumerate((1, 30, 400))] + ODD
    got = media.media_table(docs(rows), scratch).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = media.padded(raw)
        want.append((d is None, d or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(media.wrap(p, len(raw))).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got) == sorted(want)
    for r in got:
        assert r.frames == r.payload_bytes // 192 and r.samples == 1152 * r.frames and f"crc_ok={r.frames};resyncs=0" in r.feature
    assert media.media_table(docs([]), scratch).count() == 0


def frame(version, layer, rate, hz, pad, mono, crc=False):
    b1 = 0xE0 | version << 3 | (4 - layer) << 1 | (not crc)
    head = bytes((0xFF, b1, rate << 4 | hz << 2 | pad << 1, 0xC0 if mono else 0))
    h = media.header(head)
    body = bytes(h.side) if layer == 3 else b""
    check = media.crc16(head[2:] + body).to_bytes(2, "big") if crc else b""
    return (head + check + body).ljust(h.size, b"\x55"), h


def test_header_sizes():
    assert frame(3, 3, 9, 0, 0, False)[1].size == 417 and frame(3, 3, 9, 0, 1, False)[1].size == 418
    assert frame(3, 2, 8, 1, 0, False)[1].size == 384 and frame(3, 1, 12, 0, 0, False)[1].size == 416
    assert frame(2, 3, 8, 0, 0, True)[1].size == 208 and frame(0, 3, 1, 2, 0, True)[1].samples == 576
    for bad in (b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff"):
        assert media.header(bad) is None


def test_resync_tags_and_checksums():
    frames = [frame(3, 3, r, 0, i % 2, False, True) for i, r in enumerate((9, 5, 11, 9, 9, 14))]
    good = b"".join(f for f, _ in frames)
    junk = b"\xff\xfb junk \xff\xff\xff " * 9
    tag1 = b"TAG" + b"title".ljust(30, b"\0") + b"artist".ljust(30, b"\0") + bytes(65)
    title = b"TIT2" + b"\0\0\0\x06" + b"\0\0" + b"\x03hello"
    tag2 = b"ID3\x04\0\0" + bytes((0, 0, 0, len(title))) + title
    s = media.parse(tag2 + junk + good + junk + good + b"\xff\xfb\x90" + tag1)
    assert len(s.offsets) == 12 and s.resyncs == 2 and s.checked == 12 and s.damaged == 0
    assert s.tags["TIT2"] == "hello" and s.tags["title"] == "title" and s.duration == Fraction(12 * 1152, 44100)
    assert s.offsets[0] == len(tag2) + len(junk)
    spoiled = bytearray(good)
    spoiled[10] ^= 1
    assert media.parse(bytes(spoiled)).damaged == 1
    empty = media.parse(b"no audio here")
    assert empty.offsets == [] and empty.duration == 0 and media.parse(b"").samples == 0


def test_vbr_tables():
    f, h = frame(3, 3, 9, 0, 0, False)
    vbri = bytearray(f)
    vbri[36:] = (b"VBRI" + b"\0\1\0\0\0\0" + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\6" + b"\0\x10\0\x20").ljust(h.size - 36, b"\0")
    s = media.parse(bytes(vbri) + f * 12)
    assert s.table == {"kind": "VBRI", "bytes": 5000, "frames": 12, "points": [16, 32], "frames_per_point": 6} and len(s.offsets) == 12
    s = media.parse(media.wrap(media.padded(b"abc"), 3))
    assert s.table["kind"] == "Info" and s.table["frames"] == 1 and len(s.table["toc"]) == 100 and s.tags["TXXX:payload"] == "3"


def test_stored_streams_by_hand(docs, scratch):
    """Wanted values without the module: payload, digests, duration and frame places."""
    texts = ["", "a", "x" * 192, "é" * 97, "word " * 1000, "\0\xff TAG"]
    stored = {r.doc_id: r for r in media.store(docs(list(enumerate(texts)))).collect()}
    for r in media.media_table(docs(list(enumerate(texts))), scratch).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        frames = len(payload) // 192
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:])) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        data, s = stored[r.doc_id].media, stored[r.doc_id]
        assert s.seek_offsets == r.seek_offsets and all(data[o : o + 2] == b"\xff\xfa" for o in s.seek_offsets) and len(s.seek_offsets) == frames
        assert (s.samples, s.hz) == (1152 * frames, 48000) and r.seconds == pytest.approx(0.024 * frames) and hashlib.sha256(data).hexdigest() == r.media_sha256


def test_damaged_streams_are_parsed():
    r = random.Random(9)
    whole = media.wrap(media.padded(b"some payload " * 40), 520)
    vbri = bytearray(media.HEAD.ljust(media.SIZE, b"\0"))
    vbri[36:62] = b"VBRI" + bytes([255] * 22)
    seeds = [whole, whole + b"TAG" + bytes(125), b"ID3\x04\0\x50\x7f\x7f\x7f\x7f" + whole, b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"ID3\x03\0\x40\0\0\0\1", b"ID3\x02\0\0\0\0\0\x08TXX\xff\xff\xff", bytes(vbri) * 3, b""]
    for _ in range(3000):
        data = bytearray(r.choice(seeds))
        for _ in range(r.randrange(4)):
            if data:
                data[r.randrange(min(len(data), 400))] ^= 1 << r.randrange(8)
        data = bytes(data[: r.randrange(len(data) + 1)]) if r.random() < 0.6 else bytes(data)
        s = media.parse(data)
        assert all(0 <= o < len(data) for o in s.offsets) and media.feature(s) and s.duration >= 0
        media.unwrap(data, s)


def test_tasks_leave_no_free_memory_in_their_processes(monkeypatch):
    from pellucid.llm import chaining, common, simhash

    calls = []
    for module in (common, chaining, simhash):
        monkeypatch.setattr(module, "trim", lambda name=module.__name__: calls.append(name))
    common._state.clear()
    common.release()  # with no state of its own, too
    assert calls == ["pellucid.llm.common"]
    common.process_state("key", dict)
    assert calls == ["pellucid.llm.common"] * 3  # before making it, and what making it left
    for run, module in ((simhash._fingerprints, simhash), (chaining._blocks, chaining), (chaining._aligned(50, 0.8), chaining), (chaining._without, chaining)):
        calls.clear()
        assert list(run(iter([]))) == [] and calls[-1] == module.__name__
    common._state.clear()
