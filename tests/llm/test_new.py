"""Filter audit, collocations and reversible line dedup against brute force, over odd rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from texts import ODD, text

from pellucid.llm import collocations as col
from pellucid.llm import interaction, linededup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit


def brute_audit(rows, labels):
    texts = [(d, s or "", t or "") for d, t, _, s in rows]
    least = {}
    for d, _, t in texts:
        if d is not None:
            least[t] = min(least.get(t, d), d)
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    docs = []
    for d, s, t in texts:
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        docs.append((s, {f for f, bad in fails.items() if bad}, d is not None and d in good, d is not None and d in toxic))
    out, of = {}, Counter()
    for part in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                of[part, f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: tuple([*v, of[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def test_audit(spark, docs, scratch):
    r = random.Random(5)
    rows = [(i, (text(r.randrange(30, 90), i % 20).upper() if i % 7 == 0 else text(r.randrange(30, 90), i % 20)) + r.choice(["", " #", " x x x x x x"] * 2), None, ["s", None, "", "t"][i % 4]) for i in range(120)]
    rows += [(200 + i, "the same text", "en", ["s", "u"][i % 2]) for i in range(30)] + [(d, t, None, "odd") for d, t in ODD]
    rows += [(None, "the same text", None, "s"), (200, "the same text", None, "u"), (0, None, None, "s")]
    labels = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 240, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part", "'clash' as n")
    got = interaction.audit(docs(rows), table, scratch).collect()
    want = brute_audit(rows, labels)
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got} == want
    assert len(got) == len(want)
    one = interaction.audit(docs(rows), table, scratch, whole=True).collect()
    assert {(x.filter_order, x.step): x.kept for x in one} == {k[1:]: v[0] for k, v in brute_audit([(d, t, s, "all") for d, t, _, s in rows], labels).items() if k[0] == "all"}


# --- collocations


def test_bitmaps_meet_as_sets_do():
    r = np.random.default_rng(3)
    for n in (0, 1, 50, 4096, 4097, 60_000):
        for m in (0, 1, 300, 4096, 5000, 65_536):
            a, b = (np.sort(r.choice(col.PLACES, k, replace=False)) for k in (n, m))
            data, cards = col.bitmap(a) + col.bitmap(b), np.array([n, m])
            assert col.places(memoryview(data), cards).tolist() == [*a.tolist(), *b.tolist()] and len(data) == col.size_of(cards).sum()
            for ends in (set(a.tolist()), col.bits_of(a)):
                got = col.both(col.shifted(ends), col.Bitmap(b))
                want = {x + 1 for x in a.tolist()} & set(b.tolist())
                assert (got if isinstance(got, set) else set(np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little")).tolist())) == want
                assert col.popcount(got, 4) == sum(w >= 4 for w in want)


def pieces(t):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]


def brute_collocations(rows, least, top):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f = Counter()
        for r in rows:
            if (r[2] or "und") == lang:
                f.update(tuple(w[i : i + k]) for w in pieces(r[1]) for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {}
        for p, c in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(c, inside.get(p[i : i + k], 0))
        scored = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) < 100 * a:
                s, _, head, rest = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), head, rest))
        out += [(lang, i + 1, p.decode(), -a, head, rest, n, -s) for i, (s, a, p, head, rest) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((x.lang, x.rank, x.phrase, x.a, x.l, x.r, x.n, x.score) for x in df.collect())


@pytest.mark.parametrize("places", [col.PLACES, 512])
def test_collocations(spark, docs, scratch, places, monkeypatch):
    """Also over shards whose tasks end them often, and past which phrases run."""
    r = random.Random(9)
    rows = []
    for i in range(160):
        w = [r.choice(["New", "york", "city", "été", "a", "b", "the"]) if r.random() < 0.7 else f"w{r.randrange(400)}" for _ in range(r.randrange(1, 300))]
        rows.append((i, "".join(x + r.choice([" "] * 8 + [". ", "\n", "\t", ",", "!? ", "\r\n"]) for x in w), ["en", "en", None, "fr"][i % 4]))
    rows += [(d, t, "en") for d, t in ODD] + [(900, "endless " * 3000, "fr"), (901, "," * 50, "de")]
    want = brute_collocations(rows, 20, 40)
    assert len({x[0] for x in want}) == 3 and max(len(x[2].split()) for x in want) == 5
    if places != col.PLACES:  # shards of fewer words, through the same code in this process
        monkeypatch.setattr(col, "PLACES", places)
        layout = col._Layout(0)
        made = [s for words in ([w for p in pieces(rows[0][1] * 20) for w in [x.encode() for x in p] + [col._END]],) for s in layout.add("en", words)] + list(layout.rest())
        total = Counter()
        for _, _, _, words, counts, _, _ in made:
            total.update(dict(zip(words, counts.tolist())))
        assert len(made) > 3 and total == Counter(w for p in pieces(rows[0][1] * 20) for w in p)
        return
    assert rows_of(col.collocations(docs(rows), scratch, least=20, top=40)) == want
    for few in (0, 60):  # joins instead of tables for all tasks: for both, and for neighbours alone
        monkeypatch.setattr(col, "BROADCAST", few)
        assert rows_of(col.collocations(docs(rows), scratch, least=20, top=40)) == want


def test_phrases_over_the_ends_of_shards(spark, docs, scratch):
    """One text of several shards without a piece's end, and one with a piece's end just there."""
    body = ["alpha", "beta", "gamma", "delta", "epsilon"] * (3 * col.PLACES // 5)
    cut = body[: col.PLACES - 2] + ["beta,", "gamma"] + body[:1000]
    rows = [(1, " ".join(body), "en"), (2, " ".join(cut), "en")]
    assert rows_of(col.collocations(docs(rows), scratch, least=50)) == brute_collocations(rows, 50, 2000)


@pytest.mark.parametrize("pairs", [8_000_000, 0])
def test_neighbours_that_a_shard_has_in_its_overlap_alone(docs, scratch, pairs, monkeypatch):
    """Sent to every task, or joined to the shards."""
    monkeypatch.setattr(col, "BROADCAST_PAIRS", pairs, raising=False)
    if not pairs:
        monkeypatch.setattr(col, "BROADCAST", 0)
    phrase = ["one", "two", "three", "four", "five"]
    body = phrase * 4 + ["fill"] * (col.PLACES - 3 - 20) + phrase
    f, _ = col.frequent(docs([(1, " ".join(body), "en")]).coalesce(1), scratch, 2)
    got = {r.phrase: r.f for r in f.collect()}
    assert [got.get(" ".join(phrase[:k])) for k in range(1, 6)] == [5] * 5


def test_shards_are_stored_in_small_files(docs, scratch, monkeypatch):
    monkeypatch.setattr(col, "ROWS", 2, raising=False)
    made, save = [], scratch.save
    monkeypatch.setattr(scratch, "save", lambda df, **k: made.append(out := save(df, **k)) or out)
    monkeypatch.setattr(scratch, "drop", lambda df: None)
    col.frequent(docs([(1, "alpha beta gamma " * (2 * col.PLACES), "en")]).coalesce(1), scratch, 2)
    shards = [df for df in made if "maps" in df.columns]
    assert len(shards) == 2 and all(df.count() == 7 and len(df.inputFiles()) == 4 for df in shards)


def test_exact_scores(spark, scratch):
    """Products beyond 64 bits, over a table of counts instead of texts."""
    n, counts = 4 * 10**15 + 7, {"a": 3 * 10**15 + 1, "b": 10**15 + 3, "a b": 9 * 10**14 + 5}
    f = spark.createDataFrame([("en", p, len(p.split()), c) for p, c in counts.items()], "lang string, phrase string, size int, f long")
    was = col.frequent
    try:
        col.frequent = lambda *_: (f, spark.createDataFrame([("en", n)], "lang string, total long"))
        row = col.collocations(None, scratch).first()
    finally:
        col.frequent = was
    assert row.score == 1000 * counts["a b"] * n // (counts["a"] * counts["b"])


# --- line dedup


def brute_lines(rows, threshold=10):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").encode().lower() for x in (t or "").split("\n")]
    n = Counter(k for _, t, *_ in rows for k in set(keys(t)) if k)
    out = []
    for d, t, *_ in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if n[k] < threshold]
        out.append((d, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(n=150, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [r.choice([f"Line {r.randrange(60)}", f"  line {r.randrange(60)}\t", "SHARED", "shared \r", "é É", "", " ", text(6, r.randrange(10**6))]) for _ in range(r.randrange(0, 12))]
        rows.append((i, "\n".join(lines)))
    return rows + [(d, t) for d, t in ODD] + [(3, rows[3][1]), (999, "x\n" * 5000)]


def digests(df):
    return sorted(((x.doc_id, x.n_lines, x.n_dropped, hashlib.sha256(x.kept.encode()).hexdigest()) for x in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast", [linededup.BROADCAST, 0])
def test_line_dedup(spark, docs, tmp_path, broadcast):
    rows = line_rows()
    index = linededup.LineIndex(spark, f"{tmp_path}/i", broadcast=broadcast).insert(docs(rows))
    assert digests(index.clean(docs(rows))) == brute_lines(rows)


def test_line_dedup_is_reversible(spark, docs, tmp_path):
    first, second, third = line_rows(120), line_rows(90, 2), line_rows(60, 3)
    index = linededup.LineIndex(spark, f"{tmp_path}/i").insert(docs(first))
    state = lambda: sorted((x.h1, x.h2, x.n) for x in index.references().filter("n > 0").collect())
    slots = lambda: sorted((x.shard, x.n, sorted(np.frombuffer(x.slots, np.uint16)[np.frombuffer(x.slots, np.uint16) > 0].tolist())) for x in index.filters().collect())
    refs, filters = state(), slots()
    index.insert(docs(second))
    assert digests(index.clean(docs(first + second))) == brute_lines(first + second)
    index.insert(docs(third)).delete(docs(second))
    assert digests(index.clean(docs(first + third))) == brute_lines(first + third)
    index.delete(docs(third))
    assert (state(), slots()) == (refs, filters) and digests(index.clean(docs(first))) == brute_lines(first)
    with pytest.raises(ValueError, match="not inserted"):
        index.delete(docs(second))
    assert digests(linededup.LineIndex(spark, f"{tmp_path}/i").clean(docs(first))) == brute_lines(first)


def test_keys_that_a_filter_mistakes_stay(spark, docs, tmp_path, monkeypatch):
    """With fingerprints of two values nearly every key looks like another; lines of rare keys still stay."""
    rows = [(i, f"common {i % 8}\nrare {i}") for i in range(200)]
    monkeypatch.setattr(linededup.Cuckoo, "_print", staticmethod(lambda h2: (h2 % np.uint64(2) + np.uint64(1)).astype(np.uint16)))
    few = linededup.filled(np.random.default_rng(1).integers(0, 1 << 60, (9, 2)).astype(np.uint64))
    assert few.has(np.random.default_rng(2).integers(0, 1 << 60, (500, 2)).astype(np.uint64)).mean() > 0.1
    monkeypatch.undo()
    index = linededup.LineIndex(spark, f"{tmp_path}/i").insert(docs(rows))
    real = linededup.LineIndex._probe
    try:  # a probe that says yes to a third of the keys besides
        linededup.LineIndex._probe = staticmethod(lambda tables, h, opened: real(tables, h, opened) | (h[:, 0] % np.uint64(3) == 0))
        assert digests(index.clean(docs(rows))) == brute_lines(rows)
    finally:
        linededup.LineIndex._probe = staticmethod(real)


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(0, 1 << 63, (30_000, 2)).astype(np.uint64)
    f = linededup.filled(h[:20_000])
    assert f.has(h[:20_000]).all() and f.has(h[20_000:]).mean() < 0.001
    f.remove(h[5_000:20_000])
    assert f.has(h[:5_000]).all() and f.has(h[5_000:20_000]).mean() < 0.001 and np.count_nonzero(f.table) == 5_000
    full = linededup.Cuckoo(10)
    assert not full.add(h[:500])


def test_empty_tables(spark, docs, scratch, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs([]), labels, scratch).count() == 0
    assert col.collocations(docs([]), scratch).count() == 0
    index = linededup.LineIndex(spark, f"{tmp_path}/i").insert(docs([]))
    assert index.clean(docs([])).count() == 0
