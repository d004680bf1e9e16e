import collections
import hashlib
import random
import re

import numpy as np
from llm_cases import hard_rows, no_rows

from hourglass.llm import langid, licenses, pii, quality
from hourglass.llm.common import documents

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_patterns_as_plain_regular_expressions(spark):
    draw = random.Random(5)
    parts = ["a@b.co", "x.y+z@mail-1.example.com", "1.2.3.4", "10.20.300.4", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "@", ".", "-", "_", "%", "+", " ", "  ", "9", "é", "🙂", "\n", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "00000000255.1.1.1"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(400)] + ["1" * 30_000, "a." * 20_000, "a@" + "b." * 9_000, "+1" + "2 " * 9_000, "1 " * 20_000]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("term")) == want, t[:200]
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        counts = collections.Counter(s.split(":")[0] for s in want.split(",") if s)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [counts[k] for k in PATTERNS]


def test_words_that_give_an_entity_away(spark):
    common = "the people of this town were very fond of long walks"
    rows = [(i, f"note {i} {common} by Zebulon at zeb@mail.co for the people") for i in range(5)] + [(10 + i, f"{common} number {i} the people by for at") for i in range(200)] + [(999, "Zebulon is a name in a clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    text = dict(rows)[3]
    named = {tuple(map(int, s.split(":")[1:])) for s in got[3].spans.split(",") if s.startswith("term")}
    assert {text[a:b] for a, b in named} == {"Zebulon"} and got[999].spans == "" and got[10].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[999] == dict(rows)[999] and clean[3] == text.replace("zeb@mail.co", "[EMAIL]").replace("Zebulon", "" if "[NAME]" not in clean[3] else "[NAME]")


def test_words_of_an_entity_in_one_text_and_far_from_it(spark):
    common = "the people of this town were very fond of long walks and of quiet evenings"
    rows = [(i, f"{common} number {i}") for i in range(400)] + [
        (1000, f"Quillon wrote from mia@mail.co about {common}. Quillon {common}"), (1001, f"Vexar wrote from tom@mail.co. {common}"), (1002, f"tom@mail.co {common} {common} Vexar"),
        *[(1100 + i, f"about wrote from {common}") for i in range(9)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: r for r in pii.find(docs.union(docs.filter("doc_id = 1000"))).collect()}
    named = lambda i: [text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"]
    assert named(1000) == ["Quillon", "Quillon"] and named(1001) == named(1002) == ["Vexar"] and got[0].spans == got[1100].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1000] == text[1000].replace("mia@mail.co", "[EMAIL]").replace("Quillon", "[NAME]") and "Vexar" not in clean[1001] + clean[1002] and clean[1100] == text[1100]


def named_by_brute_force(rows):
    """Term spans by document, all words of a document being candidates."""
    word = re.compile(r"[^\W\d_](?:[^\W_]|['-])+[^\W\d_]")
    words = [{w.lower() for w in word.findall(t)} for _, t in rows]
    spans = [[(int(a), int(b)) for _, a, b in (s.split(":") for s in base_spans(t).split(",") if s)] for _, t in rows]
    held = [{t[a:b].lower() for a, b in s} for (_, t), s in zip(rows, spans)]
    df, out = collections.Counter(w for ws in words for w in ws), {}
    for i, (doc, text) in enumerate(rows):
        told = set()
        for e in held[i]:
            content = np.log(len(rows) / sum(e in h for h in held))
            for w in words[i]:
                both = [t for (_, t), ws, h in zip(rows, words, held) if w in ws and e in h]
                if content > 0 and 1 - (np.log(df[w] / len(both)) + np.log1p(1 / len(set(both)))) / content >= 0.85:
                    told.add(w)
        out[doc] = {(m.start(), m.end()) for m in word.finditer(text) if m[0].lower() in told and not any(a < m.end() and b > m.start() for a, b in spans[i])}
    return out


def term_places(row):
    return {(int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s) if k == "term"}


def test_every_word_of_a_document_may_give_its_entity_away(spark, tmp_path):
    from hourglass.llm.queries import QUERIES

    common = "the people of this town were very fond of long walks and of quiet evenings by the river, "
    rows = [(i, f"{common} number {i}") for i in range(300)] + [(1000 + i, f"Zebulon {common * (i + 2)} wrote from zeb@mail.co {common}end/Quillon") for i in range(4)] + [(2000 + i, f"wrote end from {common}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    text = dict(rows)
    got = {r.doc_id: r for r in QUERIES["op6_disclosure"](spark, str(tmp_path)).collect()}
    for i in range(1000, 1004):
        assert {text[i][a:b] for a, b in term_places(got[i])} == {"Zebulon", "Quillon"}
    assert got[0].spans == got[2000].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), near=None).collect()}
    assert "Zebulon" not in clean[1003] and "Quillon" not in clean[1003] and "[EMAIL]" in clean[1003] and clean[2000] == text[2000]


def test_words_of_entities_as_brute_force(spark):
    draw = random.Random(8)
    words = ["alpha", "Beta", "gamma's", "del-ta", "eps1lon", "Ζήτα", "été", "kappa,mu", "x/lambda", "no", "🙂 theta"] + [f"rare{c}" for c in "abcdefghijklmnop"]
    people = [f"p{i}@mail.co" for i in range(8)] + ["10.1.2.3", "alpha@rarea.com"]
    rows = []
    for i in range(400):
        with_any = draw.sample(range(10), draw.randint(0, 2)) if i % 9 == 0 else []
        traits = [f"Trait{'abcdefghij'[k]}z" for k in with_any if draw.random() < 0.9] + [f"trait{draw.choice('abcdefghij')}z"] * (draw.random() < 0.02)
        rows.append((i, " ".join(traits + draw.choices(words, k=draw.randint(1, 9)) + [people[k] for k in with_any] + draw.choices(words, k=3))))
    rows += [(500 + i, rows[9 * i][1]) for i in range(12)] + [(600, " ".join([f"u{i}@mail.co" for i in range(40)] + [f"unique{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]))]
    got = {r.doc_id: term_places(r) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), near=None).collect()}
    want = named_by_brute_force(rows)
    assert got == want and sum(map(len, want.values())) > 60


def test_personal_data_of_hard_rows(spark):
    docs = hard_rows(spark)
    assert pii.find(docs).count() == 14 and pii.find(no_rows(spark)).count() == 0
    out = pii.sanitise(docs)
    assert out.schema == docs.schema and out.filter("doc_id = 8").first().text == "mail [EMAIL] and [IP] now"
    assert out.filter("doc_id <> 8").exceptAll(docs).count() == 0 and pii.sanitise(no_rows(spark)).count() == 0


def test_language_on_held_out_text(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    tested = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_hard_rows(spark):
    docs = hard_rows(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == 14 and {r.doc_id: r.lang_pred for r in rows}[4] == "und" and {r.doc_id: r.lang_pred for r in rows}[9] == "und"
    assert langid.identify(no_rows(spark)).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("false").unionByName(docs.selectExpr("* except (lang)", "cast(null as string) lang")))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_tables_score_as_the_network_itself():
    net = langid.train([("a", "aaab abba baab"), ("b", "xyz zyx yzx")] * 30)
    x = langid.as_windows([b"abba aaab", b"zyx xyz", b""])
    emb = net.embedding[x]
    hidden = [np.concatenate([emb[:, k : langid.WINDOW - w + 1 + k] for k in range(w)], 2) @ f for w, f in zip(langid.WIDTHS, net.filters, strict=True)]
    h = np.maximum(np.concatenate([v.max(1) + b for v, b in zip(hidden, net.biases, strict=True)], 1), 0) @ net.dense + net.dense_bias
    p = np.exp(h) / np.exp(h).sum(1, keepdims=True)
    assert np.allclose(langid.Scorer(net).windows(x), p, atol=1e-4) and p[0].argmax() == 0 and p[1].argmax() == 1


def test_language_tables_cover_the_bytes_seen():
    net = langid.train([("a", "plain words of one kind " * 5), ("b", "0123 456 789 " * 9)] * 20, epochs=1)
    scorer, texts = langid.Scorer(net), ["some plain words", "12 34 words " * 60, ""]
    before = scorer.texts(texts)
    assert sum(table.nbytes for _, pairs, _ in scorer.tables for table in pairs) < 4_000_000
    odd = scorer.texts(["".join(map(chr, range(0x900)))])
    again = langid.Scorer(net).texts(["".join(map(chr, range(0x900)))])
    assert scorer.seen.sum() > 160 and (scorer.texts(texts) == before).all() and (odd == again).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score(documents(spark, sf), labels).collect()
    tested = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y, _ in tested if y], [s for s, y, _ in tested if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean([y == p for _, y, p in tested]) > 0.93
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_hard_rows(spark):
    docs = hard_rows(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (2, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == 14 and quality.score(no_rows(spark), labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.filter("false")).collect()} == {0.5}
    assert len({r.score for r in quality.score(docs, labels.filter("quality = 1")).collect()}) == 1


def test_additive_model_learns_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.random((4000, 4)).astype("f4")
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.logits(x) > 0) == (y > 0)).mean() > 0.95 and (0, 1) in [(i, j) for i, j, *_ in model.pairs]


def test_licences_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "print(1)"), ("a/b/y.py", None), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/z.py", "code"),
        ("a/b/c/own.py", "x = 1\n# This work is licensed under the GNU General Public License, version 3.\ny"), ("q/w.py", "we licence nothing here at all"), ("top.py", "code"), (None, "code"), ("a/x.py", "print(1)"),
    ]
    got = licenses.scan(spark.createDataFrame([(p, t, "o") for p, t in rows], "path string, text string, origin string"))
    found = collections.Counter((r.path, r.licence, r.origin, r.licence_from) for r in got.collect())
    assert found == collections.Counter([
        ("a/LICENSE", "MIT", "own", None), ("a/x.py", "MIT", "inherited", "a"), ("a/x.py", "MIT", "inherited", "a"), ("a/b/y.py", "MIT", "inherited", "a"), ("a/b/c/LICENSE", "Apache-2.0", "own", None),
        ("a/b/c/d/z.py", "Apache-2.0", "inherited", "a/b/c"), ("a/b/c/own.py", "GPL-3.0", "own", None), ("q/w.py", None, "none", None), ("top.py", None, "none", None), (None, None, "none", None),
    ])
    docs = hard_rows(spark).withColumnRenamed("source", "path")
    assert licenses.scan(docs).count() == 14 and licenses.scan(docs.filter("false")).count() == 0


def test_whole_licence_texts_speak_with_their_own_licence(spark):
    full = dict(licenses.full_texts())
    rows = [r for n, t in full.items() for r in ((f"{n}/LICENSE", t.replace("year", "2024").replace("holder", "Ann Example")), (f"{n}/x.py", "print(1)"))]
    cut = full["Apache-2.0"].split("APPENDIX")[0] + "Copyright 2020 Ann Example"
    got = {r.path: r for r in licenses.scan(spark.createDataFrame([*rows, ("cut/LICENSE", cut), ("cut/x.py", "1")], "path string, text string")).collect()}
    assert all(got[f"{n}/LICENSE"].licence == got[f"{n}/x.py"].licence == n for n in full) and got["cut/x.py"].licence == "Apache-2.0"


def test_wrapped_notices_are_found(spark):
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, other) + {i}" for i in range(300))
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    free = "# This is free and unencumbered software released into the public\n# domain."
    files = [("m.c", f"{mpl}\n{code}"), ("u.py", f"{code}\n{free}\n{code}"), ("n.py", f"# no licence\n# of any kind\n{code}"), ("e.py", "licence")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: (r.licence, r.origin) for p, r in got.items()} == {"m.c": ("MPL-2.0", "own"), "u.py": ("Unlicense", "own"), "n.py": (None, "none"), "e.py": (None, "none")}
