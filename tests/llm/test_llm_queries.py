import collections
import hashlib

import pytest
from llm_cases import hard_rows, no_rows
from oracle import duck

from hourglass.llm import pii
from hourglass.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cur = duck(SF).execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = collections.Counter(tuple(r[cols.index(c)] for c in names) for r in cur.fetchall())
    assert collections.Counter(tuple(r[c] for c in names) for r in df.collect()) == want


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline as cp
    from test_llm_pairs import brute

    docs = cp.documents(spark, SF)
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        before, docs = docs, cp.settle(stage(spark, docs, SF))
        rows = {r.doc_id: r for r in before.collect()}
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert all(not any(c.isalpha() for c in rows[i].text) for i in rows.keys() - kept[name].keys())
        elif name == "exact_dedup":
            first = {}
            for i in sorted(rows):
                first.setdefault(" ".join(rows[i].text.split(" ")), i)
            groups = collections.defaultdict(list)
            for i, r in rows.items():
                groups[hashlib.sha256(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", r.text).encode()).hexdigest()].append(i)
            assert kept[name].keys() == {min(g) for g in groups.values()}
        elif name == "near_duplicates":
            assert kept[name].keys() == {c for c, _ in brute([(i, r.text) for i, r in rows.items()]).values()}
        elif name == "personal_data":
            spans = {r.doc_id: r.spans for r in pii.find(before).collect()}
            assert kept[name].keys() == rows.keys() and all((kept[name][i].text == rows[i].text) == (spans[i] == "") for i in rows)
            assert all(r.n_chars == len(r.text) for r in kept[name].values())
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == kept["personal_data"].keys() and max(r.offset + r.length for r in pieces) <= 1024


def test_language_stage_keeps_texts_when_there_is_nothing_to_learn(spark):
    import corpus_pipeline as cp

    docs = hard_rows(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    kept = cp.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == 10 and kept.filter("doc_id in (3, 4, 9)").count() == 0


def test_language_stage_rejects_text_in_no_language(spark):
    import random

    import corpus_pipeline as cp

    draw = random.Random(4)
    docs = cp.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    clean = [r.text for r in docs.limit(60).collect() if len(r.text) > 100]
    noise = [(10**6 + i, "".join(draw.choices([chr(c) for c in range(0x21, 0x7F)], k=600)), None) for i in range(40)]
    noise += [(2 * 10**6 + i, "".join(draw.sample(t, len(t))), None) for i, t in enumerate(clean[:40])]
    both = docs.union(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in cp.language_id(spark, both, "").select("doc_id").collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= kept  # clean documents stay, held out of training or not
    assert len([i for i, _, _ in noise if i not in kept]) >= 0.8 * len(noise)


def test_repeated_rows_count_once_in_the_sample(spark):
    from hourglass.llm.langid import training_sample

    docs = spark.range(20_000).selectExpr("id % 40 doc_id", "concat('text of id ', id % 40) text", "'en' lang").union(spark.range(100, 400).selectExpr("id", "concat('some words ', id)", "'en'"))
    sample = [text for _, text in training_sample(docs) if len(text) > 8]
    assert sample and max(map(sample.count, sample)) <= 3  # windows of one text may be equal


def test_pipeline_stages_take_hard_rows(spark):
    import corpus_pipeline as cp

    for make in (hard_rows, no_rows):
        docs = make(spark)
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
