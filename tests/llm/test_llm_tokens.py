import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from llm_cases import hard_rows, no_rows
from tokenizers import Tokenizer

from hourglass.llm import packing
from hourglass.llm.bpe import encode_decode, read_ranks
from hourglass.llm.common import BYTE_PATTERN, WORD_PATTERN, ByteRanks, ChunkTokens, RankTokens, WordRanks, WordTokens, library_encoder
from hourglass.llm.token_files import _tokens, read_metadata, read_tokens, token_digest, write_tokens

PATTERN = public_tokenizers.PATTERN
RANKS, BYTES, WORDS = map(public_tokenizers.path, ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = [
    "", " ", "a  b", "foo\n bar", "foo\n\n bar ", " x", "don't we'll  \t\n x", "\x1c\x1d a", "1" * 900 + "a" * 900, "é à   b", "日本語のテキスト", "🙂 🙂👍🏽", "՘abc a՘ ᲊ \U00010d40",
    "x y　z", "\x00﻿ ​", "ŔÏ ß İstanbul ŉ ǅx", "Ⱥ Σας ΟΔΟΣ é", "<|endoftext|> a <|startoftext|>", "x\x85y ª²¼",
]


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bytes_as_the_reference_library(spark):
    coder = reference()
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(HARD)] + [(99, None, "n")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encode_decode(docs, RANKS, PATTERN).collect()}
    for i, text in [*enumerate(HARD), (99, "")]:
        ids = coder.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), text
    assert encode_decode(hard_rows(spark), RANKS, PATTERN).count() == 14 and encode_decode(no_rows(spark), RANKS, PATTERN).count() == 0
    kept = encode_decode(docs, RANKS, PATTERN, keep_ids=True).filter("doc_id = 4").first()
    assert kept.ids == coder.encode_ordinary(HARD[4])
    assert len(read_ranks(RANKS)) == 50256


@pytest.mark.parametrize(("path", "pattern", "lead"), [(BYTES, PATTERN, True), (WORDS, WORD_PATTERN, False)])
def test_chunks_as_the_whole_text(path, pattern, lead):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    tokens = ChunkTokens(library_encoder(path, pattern, not lead), lead, most=2000)  # forgets all the time
    draw = random.Random(3)
    texts = HARD + ["".join(draw.choice("ab é,.\n 's1Z") for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert tokens([t])[0] == packed(whole.encode(t, add_special_tokens=False).ids), t


def test_ranks_as_the_whole_text():
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    tokens, draw = RankTokens(BYTES, PATTERN, most=2000), random.Random(5)  # forgets all the time
    assert tokens.ranked
    pieces = [t.replace("\u0120", " ") for t in whole.get_vocab() if t.replace("\u0120", "").isascii()]
    texts = HARD + ["<s> x </s><mask>", "a" * 20_000, " " * 3000 + "x"] + ["".join(draw.choices(pieces, k=6)) for _ in range(3000)]
    texts += ["".join(draw.choice("ab é,.\n 's1Z") for _ in range(200)) for _ in range(50)]
    assert [*tokens(texts)] == [packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_as_the_whole_text_and_merged_once():
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    tokens, draw = WordTokens(WORDS, WORD_PATTERN, most=2000), random.Random(4)  # forgets all the time
    texts = HARD + ["".join(draw.choice("ab é,.\n 's1ZÉİº\u0307") for _ in range(200)) for _ in range(80)]
    for t in texts:
        assert tokens([t])[0] == packed(whole.encode(t, add_special_tokens=False).ids), t
    tokens, merged = WordTokens(WORDS, WORD_PATTERN), []
    merge = tokens.merge
    tokens.merge = lambda word: merged.append(word) or merge(word)
    tokens(["Quillon (quillon) quillon, QUILLON quillon's", "Quillon, 's"])
    assert sorted(merged) == sorted({"quillon", "(", ")", ",", "'s"})


def test_words_by_ranks_as_the_whole_text():
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    tokens, draw = _tokens(WORDS, WORD_PATTERN, False), random.Random(6)
    assert isinstance(tokens, WordRanks) and tokens.ranked
    words = [w.removesuffix("</w>") for w in whole.get_vocab() if w.isascii()]
    plain = [" ".join(words[at : at + 60]) for at in range(0, len(words), 60)]
    plain += ["'", "'s", "''s", "x's't", "'re'r'l\n'l'll", "1's2'", "'S 'LL\"'d", "a\r\t\x85b\xa0'", "\n", "Ⱥ Ⱦ İ"]
    plain += ["".join(draw.choice("ab é,.\n 's1ZÉİº²''tmdrevl_\t") for _ in range(60)) for _ in range(3000)]
    texts = plain + HARD
    want = [packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens(plain) == want[: len(plain)] and "library" not in vars(tokens)
    assert tokens(texts) == want and [tokens([t])[0] for t in HARD] == want[len(plain) :] and tokens([]) == []


def test_ranks_hold_little_memory():
    tokens = RankTokens(BYTES, PATTERN)
    tokens([f"word{i} x{i}" for i in range(1000)])
    assert "library" not in vars(tokens) and 0 < tokens.held < tokens.most <= 40_000_000
    assert tokens(["日本"]) and "library" in vars(tokens)


def test_packing_remembers_no_texts_and_codes_as_the_whole_text():
    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    tokens, draw = packing._tokens(BYTES, PATTERN), random.Random(8)
    assert isinstance(tokens, ByteRanks) and tokens.ranked and BYTE_PATTERN == PATTERN
    words = [w for w in (t.replace("\u0120", " ") for t in whole.get_vocab()) if w.isascii() and "\x00" not in w and "\x01" not in w]
    plain = ["x".join(words[at : at + 60]) for at in range(0, len(words), 60)] + [" ".join(words[at : at + 60]) for at in range(0, len(words), 60)]
    plain += ["'", "'s", " 's", "\n's", "\n 's", " \n's", "''s", "x's't", "'re'r'l\n'l'll", "1's22'", "'S 'LL\"'d", "a\r\t\x85b\xa0'", "\n", "a \n ", "  a", " \n\n"]
    plain += ["".join(draw.choice("ab é,.\n  's1ZÉº²''tmdrevl_\t") for _ in range(60)) for _ in range(3000)]
    texts = plain + HARD + ["a\x01b", "\x01"]
    want = [packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens(plain) == want[: len(plain)] and not {"library", "held", "known"} & vars(tokens).keys()
    assert tokens(texts) == want and [tokens([t])[0] for t in texts[len(plain) :]] == want[len(plain) :]


def test_files_hold_ids_in_id_order(spark, tmp_path):
    whole = Tokenizer.from_file(WORDS)
    docs = hard_rows(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want, start = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_digest(docs, WORDS, WORD_PATTERN).collect()} == want
    folder = write_tokens(docs, f"{tmp_path}/t", WORDS, WORD_PATTERN, False)
    assert {r.doc_id: (r.start, r.n_tokens) for r in read_metadata(spark, folder).collect()} == {k: v[:2] for k, v in want.items()}
    assert [r.tokens for r in read_tokens(spark, folder, 10, 10).collect()] == [whole.encode("two words", add_special_tokens=False).ids + [2]]
    assert token_digest(no_rows(spark), WORDS, WORD_PATTERN).count() == 0
    assert token_digest(hard_rows(spark), WORDS, WORD_PATTERN).count() == 14


def best_fit(counts, length):
    rooms = []
    for item in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((i for i, r in enumerate(rooms) if r >= item), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(length - item)
        else:
            rooms[fit] -= item
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_everything_in_few_sequences(seed):
    draw = random.Random(seed)
    length = 64
    counts = {draw.randint(1, length) if seed % 2 else draw.randint(1, 20): draw.randint(1, 60) for _ in range(30)}
    plan = packing.make_plan(counts, length)
    used = {}
    for runs, n in plan:
        assert sum(item * each for item, each in runs) <= length and n > 0
        for item, each in runs:
            used[item] = used.get(item, 0) + each * n
    assert used == counts
    assert sum(n for _, n in plan) <= best_fit(counts, length) + 1


def test_every_piece_has_its_place(spark):
    whole = Tokenizer.from_file(BYTES)
    docs = hard_rows(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = packing.pack(docs, BYTES, PATTERN).collect()
    ids = {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length]))
    for doc_id, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        n = len(ids[doc_id])
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == n
        assert all(r.length == 1024 for r in rows[1:]) and (n <= 1024) == (len(rows) == 1)
    assert by_doc.keys() == ids.keys()
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(no_rows(spark), BYTES, PATTERN).count() == 0
    assert packing.pack(hard_rows(spark), BYTES, PATTERN).filter("piece = 0").count() == 14
