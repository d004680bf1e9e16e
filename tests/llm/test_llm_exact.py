import collections
import hashlib
import re

from llm_cases import hard_rows, no_rows, tuples

from hourglass.llm.exact import content_sort, deduplicate


def brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=lambda t: tuple((v is None, v) for v in t))


def test_hard_rows(spark):
    docs = hard_rows(spark)
    got = content_sort(docs)
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert collections.Counter(r.keep_id for r in got.filter("kept").collect()) == {1: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    assert content_sort(no_rows(spark)).count() == 0


def test_a_text_with_most_rows_crosses_ranges(spark):
    rows = [(i, "the same  text" if i % 3 else f"text {i % 50}") for i in range(3000)] + [(i, "x" * 60 + str(i % 7)) for i in range(3000, 3500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = content_sort(docs)
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_kept_rows_are_unchanged(spark):
    docs = hard_rows(spark)
    out = deduplicate(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 7, 8, 9, 10]
    assert out.exceptAll(docs).count() == 0
    assert deduplicate(no_rows(spark)).count() == 0
