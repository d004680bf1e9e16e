"""The registered queries of this package: thin applications of its operators to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourglass.llm.align import align
from hourglass.llm.bpe import encode_decode
from hourglass.llm.catalog import QUERIES, SQL, query
from hourglass.llm.common import WORD_PATTERN, documents
from hourglass.llm.exact import content_sort
from hourglass.llm.fim import restore, transform
from hourglass.llm.fingerprint import edited_pairs
from hourglass.llm.langid import identify
from hourglass.llm.licenses import oracle, scan
from hourglass.llm.ngram_join import jaccard_join
from hourglass.llm.packing import pack
from hourglass.llm.pii import find
from hourglass.llm.quality import score
from hourglass.llm.secrets import find as find_secrets
from hourglass.llm.token_files import token_digest


__all__ = ["QUERIES", "SQL"]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


@query("op2_pattern_packing")
def op2(spark, sf_dir):
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), pattern())


EXACT_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


@query("op4_content_sort", EXACT_SQL)
def op4(spark, sf_dir):
    return content_sort(documents(spark, sf_dir).select("doc_id", "text"))


@query("op5_threshold_sketch")
def op5(spark, sf_dir):
    return edited_pairs(documents(spark, sf_dir))


JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 5 >= 4 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""


@query("op9_jaccard_join", JOIN_SQL)
def op9(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))


@query("op10_token_files")
def op10(spark, sf_dir):
    return token_digest(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), WORD_PATTERN)


@query("op6_disclosure")
def op6(spark, sf_dir):
    return find(documents(spark, sf_dir), near=None)


@query("op7_byte_cnn")
def op7(spark, sf_dir):
    return identify(documents(spark, sf_dir))


@query("op8_additive_quality")
def op8(spark, sf_dir):
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Documents have no path of their own: source and id give one, a directory for every 1,000 and every 100 ids.
PATHS = "SELECT doc_id, text, source || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' AS path FROM documents"


@query("op3_license_scan", oracle(PATHS))
def op3(spark, sf_dir):
    block = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", "source", block(1000), block(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(documents(spark, sf_dir).select("doc_id", "text", path.alias("path"))).drop("text")


@query("op11_fragment_alignment")
def op11(spark, sf_dir):
    return align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), pattern()).documents


@query("op12_layered_secrets")
def op12(spark, sf_dir):
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    counts = ["n_assign", "n_access", "n_hex"]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers", "complete")


@query("op13_displacement_fim")
def op13(spark, sf_dir):
    made = restore(transform(documents(spark, sf_dir).select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c), 256).alias(c.replace("fim_text", "output") + "_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("fim_text"), digest("restored"))
