import hashlib
import random
import re

import numpy as np
import pytest
from llm_cases import hard_rows, no_rows, tuples

from hourglass.llm import fingerprint as fp, ngram_join as nj


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (class, links) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a != b and sets[a] and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in links[a]:
                root[a] = root[b] = min(root[a], root[b])
    return {i: (root[i], len(links[i])) for i in ids}


def near_copies(n, seed, words=60):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(words)] = f"v{draw.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_links_and_classes(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 9)  # the large group meets in many pairs of blocks
    monkeypatch.setattr(nj, "WIDE", 5)
    texts = near_copies(40, 1) + near_copies(6, 2, 300) + near_copies(5, 3, 12) + ["lonely text " * 9, "", None, "a b", "a  b", "a b c"]
    shared = " ".join(f"s{i}" for i in range(80))
    texts += [f"{shared} " + " ".join(f"o{k}_{i}" for i in range(60)) for k in range(12)]  # a common passage is no link
    rows = list(enumerate(texts)) + [(500 + i, texts[0]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_a_shared_band_joins_no_groups(spark, monkeypatch):
    """Texts that collide in bands but are unlike stay apart; texts of one key that its smallest text does not tie meet in blocks."""
    from hourglass.llm.common import components

    monkeypatch.setattr(nj, "WIDE", 7)
    draw = np.random.default_rng(3)
    wide = nj.BANDS * nj.ROWS
    bases = draw.integers(0, 256, (5, wide), "u1")
    sigs = {}
    for k in range(60):
        sig = bases[k % 5].copy()
        sig[draw.integers(0, wide, 8)] = draw.integers(0, 256, 8)
        sigs[k] = sig
    rows = [(k, 1, bytearray(s.tobytes()), [7, 8 if k < 30 else 100 + k]) for k, s in sigs.items()]  # all share one key, half a second
    reps = spark.createDataFrame(rows, "node long, copies long, sig binary, bands array<long>")
    assert tuples(nj.plausible_groups(reps, 0.8, 1e-9), "node", "root") == [(k, k % 5) for k in range(60)]

    edges = [(i, i + 1) for i in range(20)] + [(50, k) for k in range(51, 90)] + [(90, 89), (91, 91), (40, 20)]
    want = [(k, 0) for k in [*range(21), 40]] + [(k, 50) for k in range(50, 91)]
    assert tuples(components(spark.createDataFrame(edges, "a long, b long")), "node", "root") == sorted(want)


def test_texts_that_share_an_id_stay_apart(spark):
    import corpus_pipeline as cp

    near = near_copies(12, 8)
    rows = [(1, near[0]), (2, near[1]), (2, "an unrelated text " + " ".join(f"u{i}" for i in range(40)))]
    rows += [(3, f"own text {k} " + " ".join(f"x{k}_{i}" for i in range(30))) for k in range(20)] + [(3, near[2])]  # one id on most rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = tuples(cp.near_duplicates(spark, docs, ""), "doc_id", "text")
    assert kept == sorted(r for r in rows if r[1] not in near[1:3])
    classes = tuples(nj.jaccard_join(docs), "doc_id", "class_id")
    assert classes.count((2, 2)) == classes.count((2, 1)) == classes.count((3, 1)) == 1 and classes.count((3, 3)) == 20


def test_join_of_hard_rows(spark):
    rows = [(r.doc_id, r.class_id, r.n_links) for r in nj.jaccard_join(hard_rows(spark)).collect()]
    assert len(rows) == 14 and (None, None, 0) in rows and (3, 3, 0) in rows and (11, 10, 1) in rows and rows.count((2, 1, 2)) == 2
    assert nj.jaccard_join(no_rows(spark)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    need = nj.least_matches(0.8, 1e-9)
    assert list(need) == sorted(need) and need[-1] < 0.75 * nj.BANDS * nj.ROWS
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 400, "u8")
    sets = [np.concatenate([base, draw.integers(0, 2**63, k, "u8")]) for k in (0, 50, 95, 1200)]
    sig = nj.signatures(sets)
    share = (sig[0] == sig).mean(1)
    for s, exact in zip(share, (1, 400 / 450, 400 / 495, 400 / 1600), strict=True):
        assert abs(s - exact) < 0.15
    i, j = nj.plausible_pairs(*[((sig ^ (sig >> 16)) & 255).astype("u1")] * 2, True, 0.8, 1e-9)
    assert {(0, 1), (0, 2), (1, 2)} <= set(zip(i.tolist(), j.tolist(), strict=True)) and (0, 3) not in set(zip(i.tolist(), j.tolist(), strict=True))


def edited(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        following = rows[(k + 1) % len(rows)][1]
        out[i] = (t[: len(t) - q] + following[:q], following)
    return out


def test_fingerprints_of_edited_texts(spark):
    draw = random.Random(4)
    rows = [(i * 3, " ".join(f"w{draw.randint(0, 900)}" for _ in range(draw.choice([0, 1, 3, 40, 900])))) for i in range(120)]
    want = edited(rows)
    got = {r.doc_id: r for r in fp.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    exact = {r.doc_id: r for r in fp.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string"), fraction=1.0).collect()}
    assert got.keys() == want.keys()
    for i, t in rows:
        new, following = want[i]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b, c = shingles(t), shingles(new), shingles(following)
        for x, name in ((b, "near_edited"), (c, "near_next")):
            assert exact[i][name] == pytest.approx(len(a & x) / len(a | x) if a | x else 1.0)
            assert 0 <= got[i][name] <= 1
        if len(a) > 500:
            assert abs(got[i].near_edited - exact[i].near_edited) < 0.3 and abs(got[i].contained_edited - len(a & b) / min(len(a), len(b))) < 0.3


def test_equal_texts_and_merging():
    a, b = fp.sketches(["x y z " * 50 + "q", "x  y\nz " * 50 + "q"])
    assert fp.as_text(a) == fp.as_text(b) and (fp.from_text(fp.as_text(a)) == a).all()
    words = [f"w{i}" for i in range(4000)]
    long, short = fp.sketches([" ".join(words), " ".join(words[1000:1400])])
    assert fp.containment(short, long) > 0.95 and fp.likeness(short, long) < 0.25


def test_fingerprints_of_hard_rows(spark):
    assert fp.edited_pairs(hard_rows(spark)).count() == 14
    assert fp.edited_pairs(no_rows(spark)).count() == 0
    one = fp.edited_pairs(spark.createDataFrame([(4, "abcd efgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest() and one.near_next == 1.0
