import functools
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from llm_cases import hard_rows, no_rows
from tokenizers import Tokenizer

from hourglass.llm import align as al
from hourglass.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@functools.cache
def libraries():
    whole = Tokenizer.from_file(FILES[0])
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=FILES[1]), al._coder(*FILES)


def whole_groups(text):
    """Groups of a text whose whole is encoded at once by the libraries; None where the tokens do not spell it."""
    a_model, b_model, coder = libraries()
    a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
    plain = (" " + text).encode()
    if not text or b"".join(coder.bytes_a[i] for i in a) != plain or b"".join(coder.bytes_b[i] for i in b) != plain:
        return None
    sides = []
    for ids, table in ((a, coder.bytes_a), (b, coder.bytes_b)):
        at, side = 0, []
        for i in ids:
            at += len(table[i])
            side.append((i, at))
        sides.append(side)
    cuts = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
    groups, at = [], [0, 0]
    for cut in cuts:
        group = []
        for side in (0, 1):
            start = at[side]
            while at[side] < len(sides[side]) and sides[side][at[side]][1] <= cut:
                at[side] += 1
            group.append(tuple(i for i, _ in sides[side][start : at[side]]))
        groups.append(tuple(group))
    return groups


def brute(rows):
    """Per (doc_id, text): the contract's columns, by plain loops."""
    found = [whole_groups(t or "") or [] for _, t in rows]
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in found]
    docs = Counter(p for c in links for p in c)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), groups, c in zip(rows, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        numbers = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), c.total()
        out.append((i, *numbers, sum(n for p, n in c.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), docs


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = al.align(df, *FILES, **options)
    want, docs = brute(rows)
    assert sorted([(r.doc_id, *[r[c] for c in NAMES]) for r in found.documents.collect()], key=str) == want
    pairs = {(r.a, r.b): r.n_docs for r in found.pairs.collect()}
    assert pairs == docs


BITS = [" ", "  ", "\n", "\t", " ", "　", "word", "Nachbarschaft", "don't", "12345", "é", "日本語", "🙂", "▁", "<s>", "<0x41>", "<|endoftext|>", "\x00", "\x1c", "...", "a" * 40, "//", "naïve"]


def mixed(rng, most):
    return "".join(rng.choices(BITS, k=rng.randrange(most), weights=[12, 1, 1, 1, 0.3, 0.3, 6, 4, 3, 3, 3, 3, 2, 0.2, 0.5, 0.5, 0.5, 0.3, 0.3, 2, 1, 1, 2]))


def test_words_give_the_tokens_of_the_whole():
    rng = random.Random(4)
    coder = libraries()[2]
    for _ in range(4000):
        text = mixed(rng, 30)
        if not text:
            continue
        words = al.words_of(text)
        assert " ".join(words) == text
        made = al.words_aligned(coder, words)
        want = whole_groups(text)
        assert (want is not None) == bool(made.exact.all())
        if want is not None:
            assert "".join(made.texts)[:-1] == al.groups_record(want).text


def test_fragments_of_any_cutting_compose_to_the_whole_in_any_order():
    rng = random.Random(6)
    coder = libraries()[2]
    for n in range(600):
        text = mixed(rng, 60) or "x"
        want = whole_groups(text)
        parts = list(al.cut_ranges(text, rng.randrange(1, 30), rng.choice([3, 20, 200])))
        assert parts[0][0] == 0 and parts[-1][1] == len((" " + text).encode()) and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        found = [al.range_fragment(coder, *p) for p in parts]
        while len(found) > 1:  # neighbours in random order
            i = rng.randrange(len(found) - 1)
            found[i : i + 2] = [al.compose(found[i], found[i + 1])]
        (made,) = found
        block = al.Block()
        block.add(made.closed)
        (*_, (exact,), (spelled,), (_, refs), (_, times)), (a, b, units) = block.tables(coder, False)
        assert exact == (want is not None)
        if exact:
            assert made.cut and made.head == made.tail == al.NOTHING and spelled == al.groups_record(want).text
            assert Counter({int(a[r]) << 32 | int(b[r]): int(t) for r, t in zip(refs, times, strict=True)}) == al._pairs_of(want)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    coder = libraries()[2]
    words = ["日本語" * 5, "word", "é" * 9, "1234567890" * 4]
    want = al.words_aligned(coder, words)
    monkeypatch.setattr(al, "LARGE", 1)
    made = al.words_aligned(coder, words)
    for w in (want, made):
        of = [i for i, n in enumerate(w.counts) for _ in range(n)]
        total = Counter()
        for i, p, n in zip(of, w.pairs, w.times, strict=True):
            total[i, int(p)] += int(n)
        assert w is want or total == first
        first = total


def test_compose_has_a_neutral_element():
    coder = libraries()[2]
    for part in al.cut_ranges("some words to be composed, één", 7, 50):
        f = al.range_fragment(coder, *part)
        assert al.compose(al.EMPTY, f) == f == al.compose(f, al.EMPTY)


def rows_of_all_kinds():
    rng = random.Random(8)
    rows = [(i, mixed(rng, 80)) for i in range(300)]
    rows += [(7, rows[7][1]), (7, "another text with the same id"), (None, "a text without id"), (None, None), (400, ""), (401, "▁ is a space here"), (402, "é" * 500), (403, "  two  spaces  everywhere  " * 40)]
    return rows


@pytest.mark.parametrize("options", [{}, {"size": 40, "halo": 30}, {"size": 5, "halo": 60}], ids=["whole", "ranges", "tiny ranges"])
def test_equals_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(al, "FAN", 3)
    check(spark, rows_of_all_kinds(), **options)


def test_hard_rows(spark):
    for options in ({}, {"size": 1000}):
        docs = hard_rows(spark)
        found = al.align(docs, *FILES, **options).documents
        want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted([(r.doc_id, *[r[c] for c in NAMES]) for r in found.collect()], key=str) == want
        assert al.align(no_rows(spark), *FILES, **options).documents.collect() == []


def test_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op11_fragment_alignment"](spark, SF)
    assert found.columns == ["doc_id", *NAMES]
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute(rows)[0]
