import random

import numpy as np
import pytest

import brute
from tidepanel.llm import near_dedup, substring_dedup, words
from tidepanel.llm.near_dedup import near_duplicates
from tidepanel.llm.substring_dedup import repeated_windows_removed


def _texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base) if k % 3 else [r.choice(vocabulary) for _ in range(r.randint(1, 150))]
        for _ in range(r.randint(0, 9)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocabulary)
        if k % 5 == 0:
            at = r.randint(0, len(w))
            w[at:at] = base[30:30 + r.randint(10, 40)]
        out.append((k * 7 % 61, r.choice([" ", "\n", "\t "]).join(w)))
    return out


EDGES = [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "ONE two"), (105, "one two three"), (106, "é à ü"),
         (107, "a b c d e"), (108, "A B C D E"), (109, "a b c d e f"), (110, "x " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(make_docs, seed):
    rows = _texts(seed) + EDGES
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_with_many_ring_members(make_docs):
    """Members of one bucket that their hub does not link, among them links that only they have."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(40):
        w, at = list(base), r.randint(0, 90)
        w[at:at + 8] = [f"v{k // 2}x{j}" for j in range(8)]  # two by two alike, and far enough from the rest
        w[(at + 50) % 95] = f"u{k}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(make_docs(rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_rows_without_or_with_repeated_ids(make_docs):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_duplicates(make_docs(rows).limit(0)).collect() == []


def test_sketch_fills_every_bin_and_estimates_similarity():
    r = np.random.default_rng(0)
    common = r.integers(0, 2**63, 600).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, r.integers(0, 2**63, 200).astype(np.uint64)])) for _ in range(2)] + [common[:1], common[:0]]
    got = near_dedup.sketch(sets, 400)
    assert (got[:3] != np.uint64(2**64 - 1)).all() and (got[3] == np.uint64(2**64 - 1)).all()
    assert abs((got[0] == got[1]).mean() - 0.6) < 0.1
    bands = near_dedup.band_count()
    assert (1 - 0.75 ** near_dedup.ROWS) ** bands <= near_dedup.MISS


def test_word_kernel_matches_split():
    import pyarrow as pa
    texts = ["a  b", None, "", "\x0bé ü x\n", " lead", "x" * 5000, "same same"]
    for limit in (1, 10, 1 << 20):
        seen = []
        for c in words.chunks(pa.array(texts), limit):
            w = words.words(c.data, c.offsets)
            found = [c.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
            hashes = words.word_hashes(c.data, w)
            assert len(set(zip(found, hashes.tolist()))) == len(set(found)) == len(set(hashes.tolist()))
            seen += [found[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        assert seen == [brute.split(t) for t in texts]


@pytest.mark.parametrize("window", [13, 5, 30])
def test_repeated_windows_match_brute_force(make_docs, window):
    rows = _texts(3) + EDGES + [(200 + k, "p q r s t " * n) for k, n in enumerate([2, 3, 3, 40])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text)
           for r in repeated_windows_removed(make_docs(rows), window=window, with_text=True).collect()}
    want = brute.repeated_windows(rows, window)
    assert got == {i: (n, k, brute.sha(t), t) for i, (n, k, t) in want.items()}


def test_repeated_windows_of_rows_without_or_with_repeated_ids(make_docs):
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(None, long), (5, long), (5, long), (6, long + " end"), (7, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeated_windows_removed(make_docs(rows)).collect())
    assert got == [(5, 20, 0), (5, 20, 0), (6, 21, 20), (7, 0, 0)]
    assert repeated_windows_removed(make_docs(rows).limit(0)).collect() == []


def test_levels_double():
    for n in range(8, 200):
        found = substring_dedup.levels(n)
        assert found[-1] == n and all(a < b <= 2 * a for a, b in zip(found, found[1:]))
