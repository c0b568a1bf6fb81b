import io
import random
import zlib
from itertools import pairwise

import numpy as np
import pytest
from texts import ODD, text

from pellucid.llm import binary, packing, wordpiece
from pellucid.llm.encoding import Encoder
from pellucid.llm.queries import vocabulary

STRANGE = ["", " ", "  a  b\n\n c 's 'S don't İSTANBUL ΣΑΣ 1234 ½² x²y", "<|endoftext|> a<|startoftext|>", "é   \x1c a\x85b \t\t x", "日本語 \U0001f600 abc", "a" * 5000, "!!'s ''s 'll'LL", "word \n", "\n\n\n", "ÀÉÎ õ ŉ Ǆ ǅ ß", "é Å"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_librarys_ids(name):
    e = Encoder(vocabulary(name))
    r = random.Random(1)
    mixed = ["".join(r.choice("ab 'sT.\n\té½0") for _ in range(60)) for _ in range(200)]
    latin = [chr(c) for c in range(1, 0x250)] + [chr(c) for c in range(0x2000, 0x2100)]
    every = [x for c in latin for x in (c, f"x{c}y", f" {c} b{c}", f"1{c}{c}'s")]
    parts = [*"ab 'stT.\n\té½0Éß–’Σ", "'s", "'ll", "12", "  ", " \n "]
    mixed += ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    texts = STRANGE + every + mixed + [text(200, 1)]
    want = [[*x.ids, 7] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for step in (1, 50, 50, len(texts)):
        for lo in range(0, len(texts), step):
            ids, counts = e.encode(texts[lo : lo + step], 7)
            assert ids.tolist() == [i for x in want[lo : lo + step] for i in x] and counts.tolist() == [len(x) for x in want[lo : lo + step]]


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr("pellucid.llm.encoding.KEPT", 50)
    e = Encoder(vocabulary("byte_bpe_50k.json"))
    texts = [text(80, i) for i in range(40)]
    want = [[*x.ids, 0] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [e.encode([t], 0)[0].tolist() for t in texts] == want and e.table.entries < 1000


def brute(rows, name, end):
    e = Encoder(vocabulary(name))
    return [(d, np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t, *_ in rows]


def test_token_files(docs, scratch):
    rows = [(i, text(50 + i, i)) for i in range(30)] + ODD
    uri, manifest = binary.write_ids(docs(rows), vocabulary("word_bpe_49k.json"), 1, scratch)
    got = sorted(binary.read_ids(uri, manifest).collect(), key=lambda r: r.start)
    want = sorted(brute(rows, "word_bpe_49k.json", 1), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in pairwise(got))
    store, path = binary.open_folder(uri)
    files = [r for r in manifest.collect()]
    found = []
    for f in files:
        with store.open_input_file(f"{path}/{f.file}") as s:
            found += binary.FrameReader(s).find(105)
    ids = next(x for d, x in want if d == 105).tobytes()
    assert found == [ids, ids]
    uri, manifest = binary.write_ids(docs([]), vocabulary("word_bpe_49k.json"), 1, scratch)
    assert binary.read_ids(uri, manifest).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_damage_is_noticed():
    sink = io.BytesIO()
    w = binary.FrameWriter(sink)
    for i in range(5):
        w.add(i, bytes([i]) * 1000)
    w.close()
    r = binary.FrameReader(Source(sink.getvalue()))
    assert [r.document(i) for i in range(5)] == [bytes([i]) * 1000 for i in range(5)] and r.find(9) == []
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(bytes([i]) * 1000 for i in range(5))
    broken = bytearray(sink.getvalue())
    broken[-12] ^= 1  # a checksum in the seek table
    with pytest.raises(ValueError):
        binary.FrameReader(Source(bytes(broken))).document(4)


def check_pieces(got, rows):
    ids = {}
    for d, x in brute(rows, "byte_bpe_50k.json", 0):
        ids.setdefault(d, []).append(x)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for s in range(len(seqs)):
        at = 0
        for r in sorted(seqs[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    return sizes


def test_packing(docs, scratch):
    r = random.Random(2)
    rows = [(i, text(r.randrange(1, 900), i), None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(200)] + ODD
    got = packing.pack(docs(rows), vocabulary("byte_bpe_50k.json"), 0, scratch, 256).collect()
    sizes = check_pieces(got, rows)
    assert all(s == 256 for s in sizes[:-1]) and 0 < sizes[-1] <= 256
    assert packing.pack(docs([]), vocabulary("byte_bpe_50k.json"), 0, scratch).count() == 0


def test_packing_follows_weights(docs, scratch):
    rows = [(i, text(300, i), None, "a" if i % 2 else "b") for i in range(60)]
    source = {i: s for i, _, _, s in rows}
    got = packing.pack(docs(rows), vocabulary("byte_bpe_50k.json"), 0, scratch, 100, {"a": 3, "b": 1}).collect()
    sizes = check_pieces(got, rows)
    for w in range(len(sizes) // 2):
        a = sum(r.length for r in got if r.sequence_id == w and source[r.doc_id] == "a")
        assert abs(a - 75) <= 1


@pytest.mark.parametrize("seed", range(30))
def test_schedule(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 10 ** int(r.integers(1, 6)), int(r.integers(1, 12)))
    weights = sizes.astype(float) if seed % 2 else r.random(len(sizes)) + 0.01
    length = int(r.integers(1, 200))
    windows = -(-int(sizes.sum()) // length)
    got = packing.served(np.arange(windows + 1), sizes, weights, length)
    assert (np.diff(got, axis=0) >= 0).all() and (got[-1] == sizes).all()
    assert (got.sum(1) == np.minimum(np.arange(windows + 1) * length, sizes.sum())).all()
    if seed % 2:
        due = np.arange(windows + 1)[:-1, None] * length * sizes / sizes.sum()
        assert np.abs(got[:-1] - due).max() < 1 + len(sizes)


def test_word_pieces_match_greedy():
    r = random.Random(1)
    for _ in range(300):
        entries = {tuple(r.choices(b"ab", k=r.randint(1, 4))) + ((wordpiece.END,) if r.random() < 0.5 else ()) for _ in range(r.randint(1, 8))}
        auto = wordpiece.Automaton(entries)
        for _ in range(5):
            w = bytes(r.choices(b"ab", k=r.randint(1, 9)))
            assert auto.count(w) == wordpiece.greedy(w, entries)


def test_token_counts(docs):
    rows = [(i, text(40, i)) for i in range(10)] + ODD
    path = vocabulary("word_bpe_49k.json")
    entries = set(wordpiece.read_entries(path))
    got = wordpiece.token_counts(docs(rows), path).collect()
    want = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        n = {x: wordpiece.greedy(x, entries) for x in set(w)}
        want.append((d is None, d or 0, len(w), sum(n[x] for x in w)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_pieces) for r in got) == sorted(want)
    assert wordpiece.token_counts(docs([]), path).count() == 0


def test_more_sources_than_queues(docs, scratch):
    rows = [(i, text(3, i), None, f"host{i % 5000}", 0) for i in range(6000)]
    got = packing.pack(docs([(*r[:2], "en", r[3], 1) for r in rows]), vocabulary("byte_bpe_50k.json"), 0, scratch).collect()
    check_pieces(got, rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for q, pieces in by.items():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end == 1024 or q == max(by)
    plan = packing.Schedule(np.full(1024, 10**9), np.full(1024, 1.0), 1024)
    for b in range(40):
        plan.block(b)
    assert sum(a.nbytes + o.nbytes for a, o in plan.blocks.values()) <= packing.KEPT_BYTES


def test_ids_at_the_ends_of_their_range_and_many_files(spark, docs, scratch):
    """No id stands for none; files roll, and places go on over them."""
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [(least, "the first"), (None, "no id"), (None, "no id either"), (0, "zero"), (most, "the last"), *[(i, f"document {i} " * 3) for i in range(1, 6000)]]
    uri, manifest = binary.write_ids(docs(rows), vocabulary("word_bpe_49k.json"), 1, scratch, roll=1)
    assert manifest.filter("piece > 0").count() > 0 or manifest.count() > 1
    got = sorted(binary.read_ids(uri, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, least, *range(6000), most]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    store, path = binary.open_folder(uri)
    counts = dict.fromkeys((least, 0, most), 0)
    for f in manifest.collect():
        with store.open_input_file(f"{path}/{f.file}") as s:
            reader = binary.FrameReader(s)
            for i in counts:
                counts[i] += len(reader.find(i))
    assert set(counts.values()) == {1}
