import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from texts import ODD, text, words

from pellucid.llm import chaining, graph, simhash


def brute_components(fps, ids, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(fps))]


def brute_fingerprint(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = low.encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(sh))


def near(seed, n, base=200):
    r = random.Random(seed)
    w = words(base, seed)
    out = []
    for _ in range(n):
        v = list(w)
        for _ in range(r.randrange(3)):
            v[r.randrange(len(v))] = f"x{r.randrange(9)}"
        out.append(" ".join(v))
    return out


def test_near_duplicates_match_brute_force(docs, scratch):
    rows = [(i, t) for i, t in enumerate(near(1, 40) + near(2, 10) + [text(120, s) for s in range(50, 80)])] + ODD
    got = simhash.near_duplicates(docs(rows), scratch).collect()
    assert len(got) == len(rows)
    fps = [g.fp & (1 << 64) - 1 for g in got]
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(brute_fingerprint(t))
    for g, fp in zip(got, fps):
        assert fp in by[g.doc_id]
    assert [g.component_id for g in got] == brute_components(fps, [g.doc_id for g in got])


def test_chains_of_links_and_hubs(spark, scratch):
    """Fingerprints in a long chain, a ball around a centre, and loners."""
    r = random.Random(3)
    chain, at = [], r.getrandbits(64)
    for _ in range(60):
        chain.append(at)
        for b in r.sample(range(64), 4):
            at ^= 1 << b
    centre = r.getrandbits(64)
    ball = [centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(8))) for _ in range(150)]
    fps = list({*chain, *ball, *(r.getrandbits(64) for _ in range(50)), 0, 1, (1 << 64) - 1})
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {x.fp: x.lab for x in simhash.clusters(nodes, scratch).collect()}
    signed = [simhash._signed(f) for f in fps]
    want = brute_components(fps, signed)
    assert [got.get(s, s) for s in signed] == want
    got7 = {x.fp: x.lab for x in simhash.clusters(nodes, scratch, blocks=7, rounds=0).collect()}
    assert [got7.get(s, s) for s in signed] == want


def test_pivot_table_never_discards_a_link(spark):
    r = random.Random(5)
    rows = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a ^ sum(1 << i for i in r.sample(range(64), r.randrange(9)))
        rows.append((simhash._signed(a), simhash._signed(b), (a ^ b).bit_count()))
    df = spark.createDataFrame(rows, "a long, b long, n int")
    from pyspark.sql import functions as F

    left = df.select(F.col("a").alias("fp"), *simhash.pivot_table(F.col("a")), "a", "b", "n").alias("row")
    right = df.select(F.col("b").alias("fp"), *simhash.pivot_table(F.col("b")), F.col("a").alias("a2")).alias("other")
    both = left.join(right, F.col("row.a") == F.col("other.a2")).select("n", simhash._near("row", "other", 4).alias("near"))
    assert all(x.near == (x.n <= 4) for x in both.collect())


def test_a_crowd_in_one_block_is_split(spark, scratch):
    """Thousands of fingerprints that agree on 22 bits and differ in six or more others are not all compared."""
    r = random.Random(11)
    basis = [r.getrandbits(42) for _ in range(12)]
    words_ = set()
    for i in range(1 << 12):
        x = 0
        for j in range(12):
            x ^= basis[j] if i >> j & 1 else 0
        words_.add(x)
    far = [w for w in words_ if w == 0 or w.bit_count() >= 6]
    fps = [f << 22 | 0x2AAAA5 for f in far] + [(far[7] << 22 | 0x2AAAA5) ^ 0b1111]
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {x.fp: x.lab for x in simhash.clusters(nodes, scratch, rounds=0).collect()}
    signed = [simhash._signed(f) for f in fps]
    assert [got.get(x, x) for x in signed] == brute_components(fps, signed)
    keyed = simhash._keyed(nodes.select("fp", F.col("fp").alias("lab")), 4, 6)
    pairs = lambda df: df.groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    split = keyed
    for level in range(simhash.LEVELS):
        split = simhash._split(split, 4, 6, level)
    assert pairs(split) < pairs(keyed) / 20


def test_the_pivot_table_discards_most_pairs_of_a_block(spark):
    r = random.Random(13)
    fps = [r.getrandbits(42) << 22 for _ in range(200)]
    t = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").select("fp", *simhash.pivot_table(F.col("fp")))
    pairs = t.alias("row").join(t.alias("other"), F.col("row.fp") < F.col("other.fp"))
    left = pairs.filter(simhash._apart("row", "other", 4)).count()
    assert left < 0.01 * pairs.count()


def test_empty(docs, scratch):
    assert simhash.near_duplicates(docs([]), scratch).count() == 0
    assert simhash.keep_one(docs([]), scratch).count() == 0
    assert chaining.passages(docs([]), scratch).count() == 0


def test_keep_one(docs, scratch):
    rows = [(i, t) for i, t in enumerate(near(1, 20) + [text(120, 9)])] + ODD
    df = docs(rows)
    kept = simhash.keep_one(df, scratch)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 20, 100, 103, 104, 105, 107, None} <= set(ids) and not {101, 102, 106} & set(ids)


def test_components(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def passage_rows():
    shared, fuzzy = words(80, 1), words(120, 2)
    changed = list(fuzzy)
    for i in range(7, 120, 20):
        changed[i] = "changed"
    del changed[50]
    return [
        (1, " ".join(words(60, 10) + shared + words(30, 11))),
        (2, " ".join(words(20, 12) + shared + words(90, 13))),
        (3, " ".join(shared)),
        (4, " ".join(words(40, 14) + fuzzy)),
        (5, " ".join(changed + words(40, 15))),
        (6, text(300, 16)),
        (7, text(300, 16)),
        (8, text(400, 17)),
        (9, " ".join(words(30, 18) + shared[:20])),
    ] + ODD


def test_passages(docs, scratch):
    rows = passage_rows()
    got = chaining.passages(docs(rows), scratch).collect()
    pairs = {(r.doc_id, r.ref_doc_id): r for r in got}
    assert set(pairs) == {(2, 1), (3, 1), (5, 4), (7, 6)}
    assert (pairs[2, 1].start_word, pairs[2, 1].n_words, pairs[2, 1].ref_start_word, pairs[2, 1].similarity) == (20, 80, 60, 1.0)
    assert (pairs[7, 6].n_words, pairs[7, 6].matched_words) == (300, 300)
    assert 100 <= pairs[5, 4].n_words <= 125 and 0.9 < pairs[5, 4].similarity < 1


def test_every_long_exact_run_is_found(docs, scratch):
    r = random.Random(8)
    pool = [words(r.randrange(51, 90), 100 + i) for i in range(12)]
    rows = []
    for d in range(60):
        parts = [words(r.randrange(5, 60), 1000 + 50 * d + j) for j in range(3)]
        rows.append((d, " ".join(parts[0] + r.choice(pool) + parts[1] + r.choice(pool) + parts[2])))
    spans = {}
    for x in chaining.passages(docs(rows), scratch).collect():
        spans.setdefault(x.doc_id, []).append((x.start_word, x.start_word + x.n_words))
    seen = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            first = seen.setdefault(tuple(w[i : i + 50]), d)
            assert first == d or any(a <= i and i + 50 <= b for a, b in spans[d])


def test_parts_of_one_id_are_kept_apart(docs, scratch):
    shared = text(80, 1)
    rows = [(1, shared), (2, text(90, 2)), (2, text(30, 3) + " " + shared), (2, text(90, 2))]
    got = chaining.passages(docs(rows), scratch).collect()
    assert [(r.doc_id, r.ref_doc_id, r.start_word, r.n_words) for r in got] == [(2, 1, 30, 80)]
    out = sorted(r.text for r in chaining.remove_repeats(docs(rows), scratch).collect())
    assert out == sorted([shared, text(90, 2), text(90, 2), text(30, 3) + " "])


def test_remove_repeats(docs, scratch):
    df = docs(passage_rows())
    out = chaining.remove_repeats(df, scratch)
    assert out.columns == df.columns
    left = {r.doc_id: r for r in out.collect()}
    assert 3 not in left and 7 not in left and left[1].text.count(" ") == 169
    assert left[2].text.split() == words(20, 12) + words(90, 13) and left[2].n_chars == len(left[2].text)
    assert {100, 101, 102, 103, 104, 105, 107, None, 9} <= set(left)


def test_chaining_prefers_one_diagonal():
    pos, ref = np.array([0, 5, 10, 10, 200, 205]), np.array([100, 105, 50, 110, 300, 305])
    order = np.lexsort((ref, pos))
    got = [set(order[c].tolist()) for c in chaining.chains(pos[order], ref[order])]
    assert {0, 1, 3} in got and {4, 5} in got and {2} in got


@pytest.mark.parametrize("seed", range(20))
def test_common(seed):
    r = random.Random(seed)
    a, b = (np.array([r.randrange(4) for _ in range(r.randrange(30))]) for _ in range(2))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert chaining.common(a, b) == table[-1][-1]


def test_cut_words():
    assert chaining.cut_words(" a b\nc  d ", [(1, 2)]) == " a d "
    assert chaining.cut_words("a b c", [(0, 2), (1, 2)]) == ""


def substituted(shared, share, seed):
    r = random.Random(seed)
    at = set(r.sample(range(5, len(shared) - 5), round(share * len(shared))))
    return [f"changed{seed}x{i}" if i in at else w for i, w in enumerate(shared)]


def test_fuzzy_passages_are_found(docs, scratch):
    rows, near = [], set()
    for i in range(120):
        shared = words(60, 5000 + i)
        changed = substituted(shared, 0.15, 5000 + i)
        rows += [(2 * i, " ".join(words(30, 6000 + i) + shared)), (2 * i + 1, " ".join(words(30, 7000 + i) + changed))]
        near.add((2 * i + 1, 2 * i))
    got = {(r.doc_id, r.ref_doc_id) for r in chaining.passages(docs(rows), scratch).collect()}
    assert got <= near and len(got) >= 0.98 * len(near)


def test_a_passage_of_two_earlier_halves_is_found(docs, scratch):
    a, b = words(35, 9000), words(35, 9001)
    fuzzy = substituted(a + b, 0.1, 9002)
    rows = [(1, " ".join(words(20, 9003) + a)), (2, " ".join(b + words(20, 9004))), (3, " ".join(words(9, 9005) + a + b)), (4, " ".join(a + b + words(9, 9006)))]
    got = [(r.doc_id, r.ref_doc_id, r.start_word, r.n_words) for r in chaining.passages(docs(rows), scratch).collect()]
    assert got == [(4, 3, 0, 70)]
    got = {(r.doc_id, r.ref_doc_id) for r in chaining.passages(docs([*rows[:3], (4, " ".join(fuzzy + words(9, 9006)))]), scratch).collect()}
    assert got == {(4, 3)}


def brute_pairs(rows):
    """Pairs of a later and an earlier document with a passage, by all common seeds of all pairs, chained and aligned."""
    ids = {}
    for _, t in rows:
        for w in t.split():
            ids.setdefault(w, len(ids))
    coded = {d: np.array([ids[w] for w in t.split()]) for d, t in rows}
    places = {}
    for d, w in coded.items():
        places[d] = {}
        for i in range(len(w) - 4):
            places[d].setdefault(tuple(w[i : i + 5].tolist()), []).append(i)
    out = set()
    for d, mine in places.items():
        for e, other in places.items():
            pairs = sorted((i, j) for s, at in mine.items() for i in at for j in other.get(s, ())) if e < d else []
            if pairs:
                pos, ref = np.array(pairs).T
                for c in chaining.chains(pos, ref):
                    if any(True for _ in chaining.alignments(coded[d], coded[e], pos[c], ref[c], 50, 0.8)):
                        out.add((d, e))
    return out


def test_recall_against_all_pairs(docs, scratch):
    """Random splices: passages of 55 to 120 words with words replaced, left out and put in, beside frequent lines."""
    r = random.Random(12)
    lines = [words(r.randrange(6, 14), 9100 + i) for i in range(6)]
    rows = []
    for i in range(150):
        shared = words(r.randrange(55, 120), 9200 + i)
        changed = []
        for w in shared:
            x = r.random() / r.choice((0.02, 0.06, 0.12, 0.15))
            changed += [] if x < 0.2 else [w, f"new{r.random()}"] if x < 0.4 else [f"other{r.random()}"] if x < 1 else [w]
        around = [words(r.randrange(5, 40), 9500 + 4 * i + j) + r.choice(lines) for j in range(4)]
        rows += [(2 * i, " ".join(around[0] + shared + around[1])), (2 * i + 1, " ".join(around[2] + changed + around[3]))]
    want = brute_pairs(rows)
    got = {(x.doc_id, x.ref_doc_id) for x in chaining.passages(docs(rows), scratch).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want), (len(got), len(want))


def test_passages_composed_of_earlier_lines_are_found(docs, scratch):
    lines = [words(n, 8000 + n) for n in (30, 21, 12, 40, 6)]
    both = sum(lines, [])
    parts = [both[at : at + 30] for at in range(0, len(both), 20)]  # they overlap, so that every seed occurs earlier
    rows = [(i, " ".join(words(20, 8100 + i) + part + words(20, 8200 + i))) for i, part in enumerate(parts)]
    rows += [(10, " ".join(words(25, 8300) + both)), (11, " ".join(both + words(35, 8301))), (12, " ".join(words(7, 8302) + both[20:80]))]
    rows += [(13, " ".join(lines[3] + lines[0] + words(9, 8303)))]  # no earlier document has these in this order
    got = {(r.doc_id, r.ref_doc_id, r.start_word, r.n_words) for r in chaining.passages(docs(rows), scratch).collect()}
    # 11 has all that 10 has: either is an earlier document that 12 shares its passage with
    assert got in ({(11, 10, 0, 109), (12, 10, 7, 60)}, {(11, 10, 0, 109), (12, 11, 7, 60)})
    out = {r.doc_id: r.text.split() for r in chaining.remove_repeats(docs(rows), scratch).collect()}
    assert out[11] == words(35, 8301) and out[12] == words(7, 8302)


def test_growing_tables_are_not_broadcast(spark, docs):
    """Stored, tables of rows, fingerprints and edges look small enough long after the driver can't hold them."""
    from pellucid.llm.common import Scratch

    plans = []

    class Watched(Scratch):
        def save(self, df, *args):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, *args)

    rows = docs([(i, t) for i, t in enumerate(near(1, 12) + [text(120, s) for s in range(5)])])
    kept = simhash.keep_one(rows, Watched(spark))
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (kept, simhash.near_duplicates(rows, Watched(spark)))]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]
