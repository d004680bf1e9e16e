"""Personal data by pattern and by disclosure, with DataFrame operations only.

Patterns find protected entities. The corpus then tells how strongly the words around an entity give it away: the pointwise
mutual information of word and entity against the entity's own information content, -log p. A word that reaches a share
``generalise`` of that content is generalised, one that reaches ``remove`` is removed. How far a word determines an entity is
weighted by its support, k / (k + 1) for k different texts with both, so one text is weak evidence but not none. Any word of a
document may give its entities away (``near=None``, as the queries have it), or only words near an entity in some text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourglass.llm.common import set_aside, settle

#: The four patterns in the order of the kinds, written so that none can backtrack over a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
SPAN = "struct<start:int,rank:int,end:int,value:string>"
REACH = 80  # where candidates are to stand near an entity: code points of context on either side of it
NEAREST = 5  # and words of context on either side
GENERALISE, REMOVE = 0.85, 0.95
WORD = r"\p{L}[\p{L}\p{M}\p{N}'-]+\p{L}"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.regexp_replace(p, "^0+(?=[0-9])", "").cast("long") <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _located(text: Column, kind: str, matches: Column) -> Column:
    """Spans of ``matches`` in code points: what lies between matches comes from splitting the text by the same pattern."""
    gaps = F.split(text, PATTERNS[kind], -1)
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, m: Column) -> Column:
        begin = a.at + F.length(F.get(gaps, a.i))
        end = begin + F.length(m)
        span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), m.alias("value")))
        return F.struct((a.i + 1).alias("i"), end.alias("at"), F.when(_valid(kind, m), F.concat(a.out, span)).otherwise(a.out).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(matches, start, step, lambda a: a.out)).otherwise(none)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``__spans``: all valid pattern matches as (start, rank, end, value), by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({f"__{k}": F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    spans = F.array_sort(F.concat(*[_located(whole, k, F.col(f"__{k}")) for k in KINDS]))
    return found.withColumn("__spans", spans).drop(*[f"__{k}" for k in KINDS])


def _words(context: Column, offset: Column) -> Column:
    """Words of a piece of text as (term, start, end) in code points of the whole text; the piece is short."""
    tokens = F.split(context, r"[\x20\x09-\x0D]", -1)
    start = F.struct(offset.cast("int").alias("at"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        core = F.regexp_extract(t, WORD, 0)
        begin = a.at + F.instr(t, core) - 1
        word = F.array(F.struct(F.lower(core).alias("term"), begin.alias("start"), (begin + F.length(core)).alias("end")))
        return F.struct((a.at + F.length(t) + 1).alias("at"), F.when(F.length(core) > 2, F.concat(a.out, word)).otherwise(a.out).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a.out)


def _around(text: Column, span: Column, near: int) -> Column:
    """The nearest ``near`` whole words on both sides of a span."""
    low = F.greatest(span.start - REACH, F.lit(0))
    left = F.substr(text, low + 1, span.start - low)
    # a word that the cut may have halved goes
    halved = F.when(low > 0, F.length(F.regexp_extract(left, r"^[^\x20\x09-\x0D]*", 0))).otherwise(0)
    before = _words(F.substr(left, halved + 1, F.length(left)), low + halved)
    right = F.substr(text, span.end + 1, F.lit(REACH))
    right = F.when(F.length(text) > span.end + REACH, F.regexp_replace(right, r"[^\x20\x09-\x0D]*$", "")).otherwise(right)
    after = _words(right, span.end)
    return F.concat(F.slice(F.reverse(before), 1, near), F.slice(after, 1, near))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["rank"].cast("string"), F.when(span["rank"].isin(0, 1), F.lower(span.value)).otherwise(F.regexp_replace(span.value, "[^0-9]", "")))


def _occurrences(held: DataFrame, told: DataFrame, text: str) -> DataFrame:
    """(doc, version, start, end, removed) of all ``told`` words (doc, version, term, removed) anywhere in their texts; words that
    overlap an entity are left out. Places are running sums over the words of a text, so long texts take no more per word."""
    key = ["__doc", "__version"]
    parts = F.arrays_zip(F.split(F.col(text), WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    cut = held.join(told.select(*key).distinct(), key, "left_semi").select(*key, F.posexplode(parts).alias("at", "part")).select(*key, "at", "part.*").toDF(*key, "at", "gap", "word")
    so_far = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("end", F.sum(F.length("gap") + F.coalesce(F.length("word"), F.lit(0))).over(so_far).cast("int")).filter("word IS NOT NULL")
    words = placed.select(*key, F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end").join(told, [*key, "term"])
    # of the spans that start before a word ends, the one that reaches furthest must end before the word starts
    events = words.select(*key, (F.col("end") - 1).alias("at"), "start", "end", "removed", F.lit(None).cast("int").alias("reach"))
    spans = held.select(*key, F.explode("__spans").alias("s")).selectExpr(*key, "s.start AS at", "cast(null AS int) AS start", "s.end AS end", "cast(null AS boolean) AS removed", "s.end AS reach")
    before = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    reached = events.unionByName(spans).withColumn("reach", F.coalesce(F.max("reach").over(before), F.lit(0)))
    return reached.filter("start IS NOT NULL AND reach <= start").select(*key, "start", "end", "removed")


def contexts(held: DataFrame, text: str = "text", near: int = NEAREST) -> DataFrame:
    """Distinct (entity, term) for the ``near`` words around every entity; words that overlap an entity are left out."""
    rows = held.select(F.col(text).alias("t"), "__spans", F.explode("__spans").alias("s"))
    words = rows.select("__spans", _entity(F.col("s")).alias("entity"), F.explode(_around(F.col("t"), F.col("s"), near)).alias("w"))
    apart = ~F.exists("__spans", lambda s: (s.start < F.col("w.end")) & (s.end > F.col("w.start")))
    return words.filter(apart).select("entity", "w.term").distinct()


def _distinct_words(text: str) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """In how many documents each word occurs: words are combined per document, then per task, then shuffled."""
    return docs.select(F.explode(_distinct_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _same_texts() -> Column:
    """A name (two sums of 64 bits) for the set of texts that a group's rows stand in."""
    return F.concat_ws(":", *[F.bit_xor(F.xxhash64("__doc", "__version", F.lit(seed))).cast("string") for seed in (0, 1)])


def revealing(held: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, text: str = "text", around: DataFrame | None = None) -> DataFrame:
    """(doc, version, term, removed) for words that give one of the document's entities away: PMI(entity; term) / IC(entity) >=
    ``generalise``, with P(entity | term) = both / df weighted by texts / (texts + 1).

    Candidates are all words of a document with the entity, or of these the (entity, term) in ``around``; ``both`` counts whole
    documents (rows, as df does). Pairs that no count could lift to the limit go first: what is left of a frequent word belongs to
    few, frequent entities. Entities that stand in the same texts have the same counts with any word, as have words of one df in the
    same texts, so both are paired as groups: a long list of entities that occur nowhere else is one group, not one a line.
    """
    key = ["__doc", "__version"]
    total = float(docs.count())
    slack = lambda of, support: (F.log("df") - F.log(of) + F.log1p(F.lit(1.0) / support)) / F.col("content")
    entities = held.select(*key, "copies", F.explode(F.array_distinct(F.transform("__spans", _entity))).alias("entity"))
    frequent = entities.groupBy("entity").agg(F.sum("copies").alias("with_entity"), _same_texts().alias("entities"))
    frequent = frequent.withColumn("content", F.log(F.lit(total) / F.col("with_entity"))).filter("content > 0")
    # the largest df that any entity lets reach the limit, with room for rounding
    reach = F.exp((1 - generalise) * F.col("content") - F.log1p(1 / F.col("with_entity")))
    most = frequent.agg(F.max(F.col("with_entity") * F.greatest(F.lit(1.0), reach))).first()[0]
    words = held.select(*key, F.explode(_distinct_words(text)).alias("term"))
    terms = words.groupBy("term").agg(_same_texts().alias("terms")).join(document_frequency(docs, text), "term").filter(F.col("df") <= (most or 0.0) * (1 + 1e-9))
    terms = terms.withColumn("terms", F.concat_ws(":", "terms", "df"))
    if around is not None:
        frequent, terms = frequent.withColumn("entities", F.col("entity")), terms.withColumn("terms", F.col("term"))
    words = settle(words.join(terms, "term"))
    entities = entities.join(frequent, "entity").select(*key, "copies", "entities", "with_entity", "content").distinct()
    least = F.least("df", "with_entity")
    matched = words.select(*key, "terms", "df").distinct().join(entities, key).filter(1 - slack(least, least) >= generalise).drop("with_entity")
    if around is not None:
        matched = matched.join(around.toDF("entities", "terms"), ["entities", "terms"], "left_semi")
    matched = settle(matched)
    pair = ["entities", "terms", "content", "df"]
    counted = matched.groupBy(*pair, "__version").agg(F.sum("copies").alias("n")).groupBy(*pair).agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    told = counted.withColumn("share", 1 - slack(F.least("both", "df"), F.col("texts"))).filter(F.col("share") >= generalise).select("entities", "terms", (F.col("share") >= remove).alias("removed"))
    named = matched.join(told, ["entities", "terms"]).groupBy(*key, "terms").agg(F.max("removed").alias("removed"))
    return words.join(named, [*key, "terms"]).select(*key, "term", "removed")


def _keyed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    return docs.withColumn("__doc", F.coalesce(F.col(ident).cast("long"), F.lit(-(2**63)))).withColumn("__version", F.xxhash64(text))


def term_spans(found: DataFrame, docs: DataFrame, generalise: float, remove: float, text: str, near: int | None) -> DataFrame:
    """Per document the spans of words that disclose one of its entities: (start, end, removed)."""
    with_any = found.filter(F.size("__spans") > 0).groupBy("__doc", "__version")
    held = settle(with_any.agg(F.count("*").alias("copies"), F.first(text).alias(text), F.first("__spans").alias("__spans")))
    around = None if near is None else settle(contexts(held, text, near))
    told = settle(revealing(held, docs, generalise, remove, text, around))
    return _occurrences(held, told, text).groupBy("__doc", "__version").agg(F.collect_list(F.struct("start", "end", "removed")).alias("__terms"))


def find(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, text: str = "text", ident: str = "doc_id", near: int | None = NEAREST) -> DataFrame:
    """Per row: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_terms.

    ``near=None`` scores every word of the documents with an entity; a number only the so many words on either side of it (within
    80 code points) in some text.
    NULL text counts as empty; a NULL id is a document of its own text; repeated rows each get their row, and like copies
    count in all frequencies but are one text of evidence; ties cannot occur, since spans of one kind never overlap. Other input
    columns are ignored. No rows give no rows.
    """
    keyed = _keyed(docs.select(ident, text), text, ident)
    found = with_base_spans(keyed, text)
    base = settle(found.select(ident, "__doc", "__version", F.col("__spans").alias("spans")))
    terms = term_spans(found, docs, generalise, remove, text, near)
    rows = base.join(terms, ["__doc", "__version"], "left").withColumn("__terms", F.coalesce("__terms", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")))
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    name = lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s.start.cast("string"), s.end.cast("string"))
    light = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end")))
    extra = F.transform("__terms", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("rank"), s.end.alias("end")))
    counts = [F.size(F.filter("spans", _of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    every = F.array_join(F.transform(F.array_sort(F.concat(light, extra)), name), ",")
    return rows.select(ident, *counts, F.sha2(F.array_join(F.transform("spans", name), ","), 256).alias("base_sha256"), every.alias("spans"), F.size("__terms").cast("long").alias("n_terms"))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, text: str = "text", ident: str = "doc_id", near: int | None = NEAREST) -> DataFrame:
    """The rows with entities replaced by their kind, disclosing words generalised to the kind of word, or removed.

    Rows without entities are passed on as they are; only the others are joined with their words. ``near`` as in ``find``.
    """
    given, back = set_aside(docs, (text, ident))
    found = with_base_spans(_keyed(given, text, ident), text)
    terms = term_spans(found, given, generalise, remove, text, near)
    clean = found.filter(F.size("__spans") == 0).select(*back)
    held = found.filter(F.size("__spans") > 0).join(terms, ["__doc", "__version"], "left")
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    whole = F.col(text)
    base = F.transform("__spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.get(tags, s["rank"]).alias("tag")))

    def generalised(s: Column) -> Column:
        word = F.substr(whole, s.start + 1, s.end - s.start)
        kind = F.when(word.rlike("[0-9]"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.struct(s.start.alias("start"), s.end.alias("end"), F.when(s.removed, "").otherwise(kind).alias("tag"))

    words = F.transform(F.coalesce("__terms", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")), generalised)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s.start >= a.at
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.when(fresh, F.concat(a.out, F.substr(whole, a.at + 1, s.start - a.at), s.tag)).otherwise(a.out).alias("out"))

    rest = lambda a: F.concat(a.out, F.substr(whole, a.at + 1, F.length(whole)))
    cleaned = held.withColumn("__new", F.aggregate(F.array_sort(F.concat(base, words)), start, step, rest))
    return clean.unionByName(cleaned.withColumn(text, F.col("__new")).select(*back))
