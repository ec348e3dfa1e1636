"""The queries of the retrieval library over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions import analysis
from lexiloom.functions import metrics as M
from lexiloom.functions import text as X
from lexiloom.functions.analysis import analyze
from lexiloom.functions.analysis import cover_density as density_of
from lexiloom.functions.embedding import HashedEmbedder, embed
from lexiloom.operators import answers, chunking, dense, evaluation, lexical, records, retrievers, showcase, terms
from lexiloom.plans.registry import query, table
from lexiloom.sources.stored import stored
from lexiloom.streaming import policies

#: Of a table that is searched, the rows whose id is divisible by this ask.
ASKING = 50


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text) of all paragraphs, stored: a search reads them more than once, and they are put together once."""
    return stored(chunking.paragraph_chunks(table(spark, sf_dir, "documents")).select("chunk_id", "text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_COSINES = f"""c AS (SELECT q.vec_id AS qid, e.vec_id AS id, q.label AS q_label, e.label AS label,
  round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % {ASKING} = 0)"""
_TOP = f"WITH {_COSINES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS place, rank() OVER (PARTITION BY qid ORDER BY cosine DESC) AS rank FROM c)"


@query(f"{_TOP} SELECT qid, id, cosine, rank FROM r WHERE place <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every asking one."""
    v = _vectors(spark, sf_dir)
    return dense.top_dense(v, v.where(F.col("id") % ASKING == 0), 10)


@query(f"WITH {_COSINES}, s AS (SELECT * FROM c WHERE label IN (0, 1)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS place, rank() OVER (PARTITION BY qid ORDER BY cosine DESC) AS rank FROM s) SELECT qid, id, cosine, rank FROM r WHERE place <= 10")
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where only some labels may be found: the filter comes before the ranks."""
    v = _vectors(spark, sf_dir)
    return dense.top_dense(v.where(F.col("label").isin(0, 1)), v.where(F.col("id") % ASKING == 0), 10)


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense_topk(spark, sf_dir)
    return found.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), "id")))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant is what has the label of the asking vector: counted by label, flagged among the ten found."""
    v = _vectors(spark, sf_dir)
    sizes = v.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_n"))
    asking = v.where((F.col("id") % ASKING == 0) & F.col("label").isNotNull()).select(F.col("id").alias("qid"), "label")
    facts = asking.join(sizes, F.col("label") == F.col("_label")).where("_n > 1").select("qid", "label", (F.col("_n") - 1).alias("n_relevant"))
    found = _ranking(spark, sf_dir).join(v.select("id", F.col("label").alias("_found")), "id").join(asking.select("qid", "label"), "qid")
    return evaluation.per_flagged(found.select("qid", "id", "position", (F.col("_found") == F.col("label")).alias("hit")), facts)


_ITEMS = f"""{_TOP}, n AS (SELECT q.vec_id AS qid, q.label, count(*) AS n FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label = q.label WHERE q.vec_id % {ASKING} = 0 GROUP BY ALL),
g AS (SELECT qid, q_label = label AS hit, place FROM r WHERE place <= 10),
items AS (SELECT n.qid, n.label, count(*) FILTER (hit AND place <= 1) / n.n::DOUBLE AS recall_1, count(*) FILTER (hit AND place <= 5) / n.n::DOUBLE AS recall_5, count(*) FILTER (hit) / n.n::DOUBLE AS recall_10,
  round(coalesce(1.0::DOUBLE / min(place) FILTER (hit), 0), 6) AS rr, min(place) FILTER (hit)::INT AS hit_rank, count(*) FILTER (hit) / 10.0::DOUBLE AS precision, count(*)::INT AS candidates,
  round(coalesce(sum(1 / log2(place + 1)) FILTER (hit), 0) / list_sum(list_transform(range(1, least(n.n, 10)::INT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
  FROM n JOIN g USING (qid) GROUP BY n.qid, n.label, n.n)"""
_MEANS = "count(*) AS questions, round(avg(recall_1) + 1e-9, 6) AS recall_at_1, round(avg(recall_5) + 1e-9, 6) AS recall_at_5, round(avg(recall_10) + 1e-9, 6) AS recall_at_10, round(avg(rr) + 1e-9, 6) AS mrr, round(avg(ndcg) + 1e-9, 6) AS ndcg_at_k, round(avg(precision) + 1e-9, 6) AS precision_at_k, round(avg(candidates) + 1e-9, 6) AS candidates_at_k"


@query(f"{_ITEMS} SELECT {_MEANS} FROM items")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aggregate(_items(spark, sf_dir))


@query(f"{_ITEMS} SELECT label, {_MEANS} FROM items GROUP BY label")
def metrics_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aggregate(_items(spark, sf_dir), ["label"])


@query(f"{_ITEMS} SELECT coalesce(hit_rank::VARCHAR, 'miss') AS hit_rank, count(*) AS questions FROM items GROUP BY 1")
def hit_rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.histogram(_items(spark, sf_dir))


@query(f"""{_ITEMS}, m AS (SELECT {_MEANS} FROM items), run AS (UNPIVOT (SELECT mrr, ndcg_at_k, recall_at_10, precision_at_k FROM m) ON COLUMNS(*) INTO NAME metric VALUE measured),
base AS (SELECT * FROM (VALUES ('mrr', 0.9::DOUBLE, true), ('ndcg_at_k', 0.01::DOUBLE, true), ('recall_at_1', 0.5::DOUBLE, true), ('precision_at_k', 0.99::DOUBLE, false)) t(metric, promoted, gated))
SELECT 'dense' AS strategy, metric, promoted, measured, round(measured - promoted, 6) AS delta, CASE WHEN coalesce(gated, false) THEN round(promoted - 0.014::DOUBLE, 6) END AS floor,
CASE WHEN promoted IS NULL THEN 'new' WHEN measured IS NULL THEN CASE WHEN coalesce(gated, false) THEN 'missing' ELSE 'ok' END WHEN coalesce(gated, false) AND promoted - measured > 0.014 THEN 'failed' WHEN measured - promoted > 0.013 THEN 'improved' ELSE 'ok' END AS verdict
FROM base FULL JOIN run USING (metric)""")
def gate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run against a fixed baseline."""
    means = retrieval_metrics(spark, sf_dir)
    run = means.unpivot([], ["mrr", "ndcg_at_k", "recall_at_10", "precision_at_k"], "metric", "value").withColumn("strategy", F.lit("dense"))
    base = spark.createDataFrame([("dense", "mrr", 0.9, True), ("dense", "ndcg_at_k", 0.01, True), ("dense", "recall_at_1", 0.5, True), ("dense", "precision_at_k", 0.99, False)], "strategy string, metric string, value double, gated boolean")
    return evaluation.gate(base, run, 0.014, 0.013)


@query(f"""{_TOP}, one AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS p FROM r WHERE place <= 10),
f AS (SELECT * FROM c WHERE label IN (0, 1)), two AS (SELECT qid, id, p FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS p FROM f) WHERE p <= 10),
s AS (SELECT qid, id, one.p AS a, two.p AS b FROM one FULL JOIN two USING (qid, id))
SELECT qid, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS common, count(*) FILTER (b IS NULL) AS only_one, count(*) FILTER (a IS NULL) AS only_other, bool_and(a IS NOT DISTINCT FROM b) AS same_order, count(*) FILTER (b IS NULL OR a IS NULL) = 0 AS same_members FROM s GROUP BY qid""")
def arm_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels against some of them."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), "id"))
    return records.agreement(records.overlap(_ranking(spark, sf_dir), dense_filtered(spark, sf_dir).withColumn("position", place)))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH d AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents), q AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), h AS (SELECT item_id, doc_id, count(*) AS held FROM q JOIN d USING (w) GROUP BY ALL),
m AS (SELECT h.*, n, max((held = n)::INT) OVER (PARTITION BY item_id) AS strict FROM h JOIN n USING (item_id))
SELECT item_id, strict, count(*) AS documents, max(held) AS most FROM m WHERE strict = 0 OR held = n GROUP BY item_id, strict""")
def strict_or_loose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every benchmark text the documents that hold all its words, or one of them where none holds all."""
    return _word_matches(spark, sf_dir).groupBy(F.col("qid").alias("item_id"), F.col("strict").cast("int").alias("strict")).agg(F.count("*").alias("documents"), F.max("held").alias("most"))


def _word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lexical.matches`` of benchmark and document texts, with plain words as lexemes and without positions."""
    words = lambda t: F.explode(F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))).alias("lexeme")
    index = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), words(F.col("text")))
    return lexical.matches(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words(F.col("text"))), index)


@query(f"""WITH d AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents), q AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), h AS (SELECT item_id, doc_id, count(*) AS held FROM q JOIN d USING (w) GROUP BY ALL),
m AS (SELECT h.*, n, max((held = n)::INT) OVER (PARTITION BY item_id) AS strict FROM h JOIN n USING (item_id)),
r AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY held DESC) AS l, CASE WHEN held / n >= 0.6 THEN rank() OVER (PARTITION BY item_id ORDER BY held / n DESC) END AS t FROM m WHERE strict = 0 OR held = n),
s AS (SELECT *, round(0.7::DOUBLE / (60 + l) + coalesce(0.3::DOUBLE / (60 + t), 0), 12) AS score FROM r)
SELECT item_id, doc_id, l::INT AS lexical_rank, coalesce(t, 0)::INT AS trigram_rank, score, p::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS p FROM s) WHERE p <= 10""")
def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retriever's fusion of two signals of a match: the words held, and their share of the words asked for; a rank of 0 is none."""
    signals = _word_matches(spark, sf_dir).select("qid", "chunk_id", F.col("held").cast("double").alias("lexical"), (F.col("held") / F.col("wanted")).alias("trigram"))
    return lexical.fuse(signals).select(F.col("qid").alias("item_id"), F.col("chunk_id").alias("doc_id"), "lexical_rank", F.coalesce("trigram_rank", F.lit(0)).alias("trigram_rank"), "score", "position")


@query("""WITH s AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS a, length(text) - length(replace(text, ',', '')) AS b FROM documents),
r AS (SELECT *, rank() OVER (ORDER BY a DESC) AS a_rank, CASE WHEN b > 0 THEN rank() OVER (ORDER BY b DESC) END AS b_rank FROM s)
SELECT doc_id, a_rank, b_rank, round(0.7::DOUBLE / (60 + a_rank) + coalesce(0.3::DOUBLE / (60 + b_rank), 0), 12) AS score FROM r""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals of a text (its lines, its commas) as ranks with ties, fused. Ranks come from counts of the signals'
    values, which are few, not from one sorted task."""
    text = F.col("text")
    s = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text, "\n")).cast("long").alias("a"), (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).alias("b"))

    def ranks(c: str) -> DataFrame:
        values = s.groupBy(c).agg(F.count("*").alias("n"))
        above = W.orderBy(F.desc(c)).rowsBetween(W.unboundedPreceding, -1)
        return values.select(c, (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).alias(f"{c}_rank"))

    joined = s.join(ranks("a"), "a").join(ranks("b"), "b").withColumn("b_rank", F.when(F.col("b") > 0, F.col("b_rank")))
    return joined.select("doc_id", "a_rank", "b_rank", F.round(M.fused(0.7, F.col("a_rank")) + M.fused(0.3, F.col("b_rank")), 12).alias("score"))


_PARAGRAPHS = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
p AS (SELECT doc_id, line, trim(raw, ' ') AS own FROM l WHERE trim(raw, ' ') <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ordinal, list_filter(string_split(regexp_replace(own, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') AS sentences FROM p)"""


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, ordinal::INT AS ordinal, printf('%d#%04d', doc_id, ordinal) AS chunk_id, concat_ws(' ', lag(coalesce(sentences[-1], own)) OVER (PARTITION BY doc_id ORDER BY line), own) AS text, own FROM o")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraph_chunks(table(spark, sf_dir, "documents"))


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunker over the documents."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "chunk_id", "kind", "text")


@query(r"""WITH t AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' ') AS own FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, list_filter(string_split(regexp_replace(own, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')[-1] AS last FROM t),
c AS (SELECT conv_id, i AS ordinal, 1 AS page, 'spec' AS kind, 'Talk ' || conv_id || ' — turn: ' || turn || '; role: ' || role AS text FROM s UNION ALL SELECT conv_id, n + i, 1, 'procedure', 'Talk ' || conv_id || ' — step ' || (i + 1) || ': say ' || length(own) || ' signs as ' || role FROM s
UNION ALL SELECT conv_id, 2 * n + i, 2, 'prose', concat_ws(' ', lag(last) OVER (PARTITION BY conv_id ORDER BY turn), own) FROM s)
SELECT conv_id, ordinal::INT AS ordinal, printf('%d#%04d', conv_id, ordinal) AS chunk_id, page::INT AS page, 'Talk ' || conv_id AS section, kind, text FROM c""")
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunker over a Markdown report of each conversation: a table of its turns, numbered steps that run over two lines, and on
    a second page its texts as paragraphs."""
    own = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    t = table(spark, sf_dir, "conversations").withColumn("own", own)
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.length("own").alias("signs"))))
    part = lambda of, between: F.array_join(F.transform("turns", of), between)
    rows = part(lambda x: F.concat(F.lit("| "), x["turn"].cast("string"), F.lit(" | "), x["role"], F.lit(" |")), "\n")
    steps = part(lambda x, i: F.concat((i + 1).cast("string"), F.lit(". say "), x["signs"].cast("string"), F.lit(" signs\n   as "), x["role"]), "\n")
    head = F.concat(F.lit("# Talk "), F.col("conv_id").cast("string"), F.lit("\n<!-- page: 1 -->\n\n| turn | role |\n|---|---|\n"))
    markdown = F.concat(head, rows, F.lit("\n\n"), steps, F.lit("\n\n<!-- page: 2 -->\n"), part(lambda x: x["text"], "\n\n"), F.lit("\n"))
    docs = t.groupBy("conv_id").agg(turns.alias("turns")).select(F.col("conv_id").alias("doc_id"), markdown.alias("text"))
    return chunking.chunk_documents(docs).select(F.col("doc_id").cast("long").alias("conv_id"), "ordinal", "chunk_id", "page", "section", "kind", "text")


_TERMS = ["valve", "licensed", "model", "data", "river", "training"]


@query(f"WITH {_PARAGRAPHS} SELECT doc_id, ordinal::INT AS ordinal, array_to_string(list_filter({_TERMS}, lambda t: regexp_matches(strip_accents(lower(own)), '\\b' || t || '\\b')), ',') AS jargon_terms FROM o")
def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a vocabulary that each chunk's own text uses."""
    chunks = chunking.paragraph_chunks(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "ordinal", F.array_join(X.detect_terms(F.col("own"), _TERMS), ",").alias("jargon_terms"))


# letters that keep their mark are letters, which DuckDB's word boundaries don't know
_FOLDED = "translate(strip_accents(lower({})), 'ßæœøđłþðı', 'qqqqqqqqq')"


@query(rf"""WITH {_PARAGRAPHS}, v AS (SELECT term, min(p) AS position, {_FOLDED.format('term')} AS folded FROM (SELECT regexp_extract(text, '^\p{{L}}+ \p{{L}}+') AS term, 2 * item_id AS p FROM benchmark UNION ALL SELECT regexp_extract(text, '^\p{{L}}+'), 2 * item_id + 1 FROM benchmark) WHERE term <> '' GROUP BY term),
x AS (SELECT '\b(?:' || string_agg(folded, '|' ORDER BY length(folded) DESC, folded) || ')\b' AS re FROM (SELECT DISTINCT folded FROM v)), f AS (SELECT doc_id, ordinal, list_distinct(regexp_extract_all({_FOLDED.format('own')}, re)) AS found FROM o, x)
SELECT doc_id, ordinal::INT AS ordinal, coalesce(string_agg(term, ',' ORDER BY position), '') AS terms FROM f LEFT JOIN v ON list_contains(found, folded) GROUP BY doc_id, ordinal""")
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a large vocabulary that each paragraph uses: the first word, and the first two, of every benchmark text."""
    b = table(spark, sf_dir, "benchmark")
    first = lambda pattern, place: b.select(F.regexp_extract("text", pattern, 0).alias("term"), (F.col("item_id") * 2 + place).alias("position"))
    vocabulary = first(r"^\p{L}+ \p{L}+", 0).unionByName(first(r"^\p{L}+", 1)).where("term <> ''").groupBy("term").agg(F.min("position").alias("position"))
    chunks = chunking.paragraph_chunks(table(spark, sf_dir, "documents")).select(F.struct("doc_id", "ordinal").alias("chunk"), F.col("own").alias("text"))
    return terms.used_terms(chunks, vocabulary, "chunk").select("chunk.doc_id", "chunk.ordinal", F.array_join("terms", ",").alias("terms"))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '\\s+'), lambda w: w <> '') AS w FROM documents), q AS (SELECT item_id, list_filter(string_split_regex(strip_accents(lower(text)), '\\s+'), lambda w: w <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS d, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d), qg AS (SELECT item_id, unnest(range(0, len(w) - 4)) AS c, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM q),
m AS (SELECT item_id, doc_id, c, d, c - row_number() OVER (PARTITION BY item_id, doc_id, d - c ORDER BY c) AS island FROM qg JOIN dg USING (g)), r AS (SELECT item_id, doc_id, count(*) + 4 AS run, min(c) AS claim_at, min(d) AS chunk_at FROM m GROUP BY item_id, doc_id, d - c, island)
SELECT item_id, run::INT AS run, doc_id, claim_at::INT AS claim_at, chunk_at::INT AS chunk_at FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY run DESC, claim_at, doc_id, chunk_at) = 1""")
def corpus_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of words of every benchmark text that stands in any document, from five words on."""
    split = X.tokens(F.col("text")).alias("tokens")
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), split)
    found = records.corpus_verbatim(claims, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), split))
    return found.select(F.col("claim_id").alias("item_id"), "run", F.col("chunk_id").alias("doc_id"), "claim_at", "chunk_at")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def joined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct languages of each source as one text, in order."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.listagg_distinct("lang", F.lit(",")).alias("langs")).withColumn("langs", F.array_join(F.array_sort(F.split("langs", ",")), ","))


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS folded FROM documents")
def fold_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folding that knows all of Unicode."""
    return table(spark, sf_dir, "documents").select("doc_id", X.fold_full(F.col("text")).alias("folded"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS question FROM conversations")
def normalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_question(F.col("text")).alias("question"))


@query(r"""SELECT conv_id, turn, sha256('{"embedder":null,"k":10,"question":' || to_json(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}') AS key FROM conversations""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", X.cache_key(F.col("text"), role=F.col("role"), k=F.lit(10), embedder=F.lit(None).cast("string")).alias("key"))


@query(r"""SELECT doc_id, list_count(list_filter(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda n: abs(replace(n, ',', '.')::DOUBLE - 2.0) <= 0.5)) > 0 AS matches_number,
contains(strip_accents(lower(text)), 'licensed') AS matches_text FROM documents""")
def value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("double")
    return t.select("doc_id", X.value_matches(F.lit("2,0"), F.col("text"), F.lit(0.5)).alias("matches_number"), X.value_matches(F.lit("Licensed"), F.col("text"), none).alias("matches_text"))


@query("""SELECT doc_id, found, n_chars FROM (SELECT DISTINCT doc_id FROM labels UNION SELECT DISTINCT item_id + 1000000000 FROM benchmark) w LEFT JOIN (SELECT doc_id, n_chars, true AS there FROM documents) d USING (doc_id), LATERAL (SELECT coalesce(there, false) AS found)""")
def hydrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids, and some that aren't stored, against the documents."""
    wanted = table(spark, sf_dir, "labels").select("doc_id").unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id")))
    return records.hydrate(wanted, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "found", "n_chars")


@query("SELECT digest, count(*) AS copies FROM (SELECT sha256(text) AS digest FROM documents) GROUP BY digest HAVING count(*) > 1")
def duplicate_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("SELECT conv_id, count(*) AS n, min(length(text))::INT AS minimum, max(length(text))::INT AS maximum, count(DISTINCT length(text)) AS distinct_values, list(length(text)::INT ORDER BY turn)::VARCHAR AS spread_values FROM conversations GROUP BY conv_id")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    out = records.spread(rows, ["conv_id"], "chars", "turn")
    return out.withColumn("spread_values", F.concat(F.lit("["), F.array_join(F.col("spread_values").cast("array<string>"), ", "), F.lit("]")))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE i = (n - 1) // 2 + 1")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    return records.displayed(rows, ["conv_id"], "chars", "turn").select("conv_id", "turn", "role")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), X.utc_day(F.col("ts").cast("timestamp")).alias("day"), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS clients FROM events GROUP BY 1")
def utc_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("day").agg(F.count("*").alias("events"), F.count_distinct("client").alias("clients"))


@query("""WITH n AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) AS nth FROM events),
f AS (SELECT *, CASE WHEN nth <= 3 THEN row_number() OVER (PARTITION BY day, nth <= 3 ORDER BY ts, event_id) END AS place FROM n),
u AS (SELECT *, count(CASE WHEN place <= 150 THEN 1 END) OVER (PARTITION BY day, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM f)
SELECT event_id, day, CASE WHEN place <= 150 THEN NULL WHEN used >= 3 THEN 'client_daily' ELSE 'global_daily' END AS reason FROM u""")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a day for each client, 150 for all."""
    e = _events(spark, sf_dir).select("event_id", "client", "day", (F.col("micros") / 1e6).alias("at"))
    return policies.admitted(e, 3, 150).select("event_id", "day", "reason")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id::VARCHAR AS client, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT client, i, event_id, s, 1.0::DOUBLE AS had FROM e WHERE i = 1 UNION ALL
SELECT e.client, e.i, e.event_id, e.s, least(1.0::DOUBLE, CASE WHEN w.had >= 1 THEN w.had - 1 ELSE w.had END + greatest(0, e.s - w.s) * (1 / 60.0::DOUBLE)) FROM w JOIN e ON e.client = w.client AND e.i = w.i + 1)
SELECT event_id, client, had >= 1 AS allowed, CASE WHEN had >= 1 THEN 0 ELSE greatest(1, floor((1 - had) / (1 / 60.0::DOUBLE))::INT + 1) END::INT AS retry_after FROM w""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "client", (F.col("micros") / 1e6).alias("at"))
    return policies.token_bucket(e, 1).select("event_id", "client", "allowed", "retry_after")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id || '/' || event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT key, i, event_id, us, us AS stored, false AS hit FROM e WHERE i = 1 UNION ALL
SELECT e.key, e.i, e.event_id, e.us, CASE WHEN e.us - w.stored < 86400000000 THEN w.stored ELSE e.us END, e.us - w.stored < 86400000000 FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1)
SELECT event_id, key, hit FROM w""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each user and kind of event, kept for a day."""
    e = _events(spark, sf_dir).select("event_id", F.concat("client", F.lit("/"), "event_type").alias("key"), (F.col("micros") / 1e6).alias("at"))
    return policies.cached(e, 86_400.0).select("event_id", "key", "hit")


_CHUNK_TEXTS = f"""{_PARAGRAPHS}, k AS (SELECT printf('%d#%04d', doc_id, ordinal) AS chunk_id, concat_ws(' ', lag(coalesce(sentences[-1], own)) OVER (PARTITION BY doc_id ORDER BY line), own) AS text FROM o)"""
_GRAMS = "SELECT {0}, row_number() OVER (PARTITION BY {0} ORDER BY wi, gi) AS pos, g FROM (SELECT {0}, wi, generate_subscripts(gs, 1) AS gi, unnest(gs) AS g FROM (SELECT {0}, wi, list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)) AS gs FROM (SELECT {0}, generate_subscripts(ws, 1) AS wi, unnest(ws) AS w FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {1}))))"


@query(f"""WITH {_CHUNK_TEXTS}, cg AS ({_GRAMS.format('chunk_id', 'k')}), qg AS (SELECT DISTINCT item_id, g FROM ({_GRAMS.format('item_id', 'benchmark')})), qn AS (SELECT item_id, count(*) AS n FROM qg GROUP BY item_id),
h AS (SELECT item_id, chunk_id, n FROM qg JOIN (SELECT DISTINCT chunk_id, g FROM cg) USING (g) JOIN qn USING (item_id) GROUP BY ALL HAVING count(*) >= 0.6 * n - 1e-9)
SELECT item_id AS qid, count(*) AS chunks FROM h GROUP BY item_id""")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs hold six tenths of the trigrams of each benchmark text: what the count filter of the trigram index asks for, exactly."""
    chunks = _paragraphs(spark, sf_dir)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return lexical.trigram_candidates(questions, chunks).groupBy("qid").agg(F.count("*").alias("chunks"))


@query()
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions, paragraphs as chunks: the pairs of a word similarity of 0.6 or more."""
    chunks = _paragraphs(spark, sf_dir)
    return lexical.trigram_signal(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")), chunks)


@query(f"""WITH d AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents), q AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS position FROM h)
SELECT item_id, position::INT AS position, doc_id, hits FROM r WHERE position <= 10""")
def impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every benchmark text the ten documents in which its words stand most often, by blocks with upper bounds."""
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words(F.col("text"))).alias("lexeme"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").repartition("chunk_id")
    held = docs.select("chunk_id", F.explode(words(F.col("text"))).alias("lexeme")).join(lexical.sized(asked.select("lexeme").distinct()), "lexeme")
    index = held.groupBy("chunk_id", "lexeme").agg(F.count("*").alias("times"))
    return lexical.ImpactIndex(index).search(asked).select(F.col("qid").alias("item_id"), "position", F.col("chunk_id").alias("doc_id"), "hits")


@query(f"""WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents), q AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
p AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM d), h AS (SELECT item_id, id, q.w, pos FROM q JOIN p ON p.w = q.w), s AS (SELECT item_id, id, n FROM h JOIN n USING (item_id) GROUP BY ALL HAVING count(DISTINCT w) = n),
a AS (SELECT h.* FROM h JOIN s USING (item_id, id)), e AS (SELECT x.item_id, x.id, x.pos AS start, y.w, min(y.pos) AS nearest FROM (SELECT DISTINCT item_id, id, pos FROM a) x JOIN a y ON y.item_id = x.item_id AND y.id = x.id AND y.pos >= x.pos GROUP BY ALL),
f AS (SELECT e.item_id, e.id, start, max(nearest) AS stop FROM e JOIN n USING (item_id) GROUP BY e.item_id, e.id, start, n HAVING count(*) = n), c AS (SELECT item_id, id, max(start) AS start, stop FROM f GROUP BY item_id, id, stop),
o AS (SELECT c.*, (SELECT count(DISTINCT pos) FROM a WHERE a.item_id = c.item_id AND a.id = c.id AND a.pos BETWEEN c.start AND c.stop) AS own FROM c)
SELECT item_id, id AS doc_id, round(sum(0.1::DOUBLE / (1 + stop - start + 1 - own)), 6) AS density FROM o GROUP BY item_id, id""")
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cover density of every benchmark text in the documents that hold all its words."""
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(words(F.col("text")))).alias("lexeme"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").repartition("chunk_id")
    placed = docs.select("chunk_id", F.posexplode(words(F.col("text"))).alias("pos", "lexeme")).join(lexical.sized(asked.select("lexeme").distinct()), "lexeme")
    index = placed.groupBy("chunk_id", "lexeme").agg(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("positions"))
    found = lexical.strict_matches(asked, index)
    return found.select(F.col("qid").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round(density_of(F.col("lists")).cast("double"), 6).alias("density"))


@query()
def lexical_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical retriever over paragraphs, with the benchmark texts as questions."""
    chunks = _paragraphs(spark, sf_dir)
    found = lexical.retrieve(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")), chunks)
    return found.select("qid", "position", "chunk_id", "score", "lexical", "trigram", "lexical_rank", "trigram_rank")


def _stems() -> str:
    """The stemmer over a table t of distinct words w: stems (w, stem). Regions are kept as the numbers of their letters."""
    any_of = lambda suffixes: "(" + "|".join(sorted(suffixes, key=lambda x: (-len(x), x))) + ")$"
    after = "'^.*?[aeiou][^aeiou](.*)$'"
    standard = [*analysis._DELETE, "logia", "logias", "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"]
    return rf"""g AS (SELECT w, regexp_extract(w, {after}, 1) AS one, CASE WHEN regexp_matches(w, '^.[^aeiou]') THEN regexp_extract(w, '^.[^aeiou]+[aeiou](.*)$', 1) WHEN regexp_matches(w, '^[aeiou]') THEN regexp_extract(w, '^[aeiou]+[^aeiou](.*)$', 1) ELSE regexp_extract(w, '^...(.*)$', 1) END AS verbs, regexp_extract(w, '{any_of(standard)}') AS suffix FROM t),
h AS (SELECT *, length(one) AS n1, length(regexp_extract(one, {after}, 1)) AS n2, length(verbs) AS nv, left(w, length(w) - length(suffix)) AS rest FROM g),
j AS (SELECT *, CASE WHEN suffix = '' THEN w WHEN suffix = 'amente' THEN CASE WHEN n1 >= 6 THEN rest ELSE w END WHEN suffix IN ('ira', 'iras') THEN CASE WHEN nv >= length(suffix) AND rest LIKE '%e' THEN rest || 'ir' ELSE w END WHEN n2 < length(suffix) THEN w WHEN suffix LIKE 'logia%' THEN rest || 'log' ELSE rest END AS cut FROM h),
k AS (SELECT *, CASE WHEN cut = w THEN '' WHEN suffix = 'amente' THEN regexp_extract(cut, '(ativ|iv|os|ic|ad)$') WHEN suffix = 'mente' THEN regexp_extract(cut, '(ante|avel)$') WHEN suffix LIKE 'idade%' THEN regexp_extract(cut, '(abil|ic|iv)$') WHEN suffix LIKE 'iv%' THEN regexp_extract(cut, '(at)$') ELSE '' END AS also, length(w) - n2 AS r2, length(w) - nv AS rv FROM j),
l AS (SELECT *, CASE WHEN also <> '' AND length(cut) - length(also) >= r2 THEN left(cut, length(cut) - length(also)) WHEN also = 'ativ' AND length(cut) - 2 >= r2 THEN left(cut, length(cut) - 2) ELSE cut END AS whole FROM k),
m AS (SELECT *, CASE WHEN whole = w THEN left(w, length(w) - length(regexp_extract(verbs, '{any_of(analysis._VERB)}'))) ELSE whole END AS bare FROM l),
n AS (SELECT *, CASE WHEN bare <> w THEN CASE WHEN bare LIKE '%ci' AND length(bare) - 1 >= rv THEN left(bare, length(bare) - 1) ELSE bare END ELSE left(w, length(w) - length(regexp_extract(verbs, '(os|a|i|o)$'))) END AS short FROM m),
q AS (SELECT *, CASE WHEN short LIKE '%e' AND length(short) - 1 >= rv THEN left(short, length(short) - 1) ELSE short END AS last FROM n),
stems AS (SELECT w, CASE WHEN last <> short AND regexp_matches(last, '(gu|ci)$') AND length(last) - 1 >= rv THEN left(last, length(last) - 1) ELSE last END AS stem FROM q)"""


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS ws FROM conversations), p AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM c),
t AS (SELECT DISTINCT w FROM p WHERE w NOT IN ({', '.join(f"'{x}'" for x in sorted(analysis.ENGLISH | analysis.PORTUGUESE))})), {_stems()}
SELECT stem AS lexeme, count(*) AS n, sum(pos)::BIGINT AS positions FROM p JOIN stems USING (w) GROUP BY stem""")
def analyzed_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each lexeme stands in the conversations, and the sum of its positions."""
    words = table(spark, sf_dir, "conversations").select(F.explode(analyze("text")).alias("w"))
    return words.groupBy(F.col("w.lexeme").alias("lexeme")).agg(F.count("*").alias("n"), F.sum("w.pos").alias("positions"))


@query()
def verbatim_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before it: the longest common run and subsequence of tokens."""
    t = table(spark, sf_dir, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn")
    pairs = t.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("position"), X.tokens(F.col("text")).alias("claim_tokens"), F.lag(X.tokens(F.col("text"))).over(order).alias("chunk_tokens"), F.col("turn").cast("string").alias("chunk_id"))
    out = records.worst_verbatim(pairs.where("chunk_tokens is not null"))
    return out.select("question_id", F.col("run.tokens").alias("run"), F.col("subsequence.tokens").alias("subsequence"), "leaks")


@query("""SELECT url_host, count(*) AS pages FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS url_host FROM pages) GROUP BY 1""")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("url_host")).agg(F.count("*").alias("pages"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 OR doc_id % 7 = 0 THEN 'abstained' ELSE 'ok' END AS status,
CASE WHEN doc_id % 7 = 0 THEN 0 ELSE (CASE WHEN quality = 0 THEN 1 ELSE 0 END) + 1 END AS invalid_citations,
CASE WHEN toxic = 1 OR doc_id % 7 = 0 THEN 'not_applicable' WHEN quality = 0 THEN 'unsupported' ELSE 'supported' END AS support, toxic = 1 AND doc_id % 7 <> 0 AS contradictory FROM labels""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made from the labels: one claim that cites passage ``quality`` of three, and one that isn't there."""
    t = table(spark, sf_dir, "labels")
    claim = F.format_string('{"text": "claim %d", "citations": [%d, 9]}', F.col("doc_id"), F.col("quality"))
    payload = F.format_string('{"abstained": %s, "claims": [%s]}', F.when(F.col("toxic") == 1, "true").otherwise("false"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(claim))
    context = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    out = answers.validate(t.select("doc_id", payload.alias("payload"), context.alias("context")))
    return out.select("doc_id", "status", "invalid_citations", "support", "contradictory")


@query("""SELECT role, sum(length(text) + turn)::BIGINT AS tokens_total, CASE WHEN role = 'user' THEN round(sum((length(text) * 0.10 + turn * 0.40) / 1000000), 9)::DOUBLE END AS cost_usd FROM conversations GROUP BY role""")
def answer_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: those of users by a model with a price, the others without one."""
    t = table(spark, sf_dir, "conversations")
    rows = t.select("role", F.when(F.col("role") == "user", "small").otherwise("unpriced").alias("model"), F.length("text").cast("long").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return answers.with_cost(rows, {"small": (0.10, 0.40)}).groupBy("role").agg(F.sum("tokens_total").alias("tokens_total"), F.round(F.sum("cost_usd"), 9).cast("double").alias("cost_usd"))


@query(r"""WITH r AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY q, role ORDER BY turn DESC, conv_id DESC) AS i FROM r) SELECT r.conv_id, r.turn, n.conv_id * 1000 + n.turn AS record_id FROM r JOIN n USING (q, role) WHERE n.i = 1""")
def precomputed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a question, against all turns as records: the newest of the same role and normalized text."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("strategy"), F.lit(10).alias("k"), F.lit("cited").alias("contract"), F.lit("h").alias("corpus_hash"))
    rec = t.withColumn("tiers", F.array(F.lit("B"), F.lit("A"))).withColumn("recorded_at", F.col("turn")).withColumn("record_id", F.col("conv_id") * 1000 + F.col("turn"))
    return showcase.precomputed(rec, t.withColumn("tiers", F.array(F.lit("A"), F.lit("B")))).select("conv_id", "turn", "record_id")


@query("""WITH d AS (SELECT conv_id, turn, length(text) AS took, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, turn, (i - 1)::INT AS depth FROM d""")
def span_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a trace: each turn is the parent of the next."""
    order = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(order).alias("before"))
    spans = t.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), F.col("before").cast("string").alias("parent_span_id"), F.col("turn").cast("long").alias("started"), (F.col("turn") + 1).cast("long").alias("ended"))
    return records.span_tree(spans).select(F.col("trace_id").cast("long").alias("conv_id"), F.col("span_id").cast("long").alias("turn"), "depth")


@query()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals fused by rank over paragraphs, with the hashed embedder."""
    chunks = _paragraphs(spark, sf_dir)
    own = HashedEmbedder()
    # texts travel to where their ids are met, and become vectors there
    vectors = chunks.repartition("chunk_id").select("chunk_id", F.lit(own.model_key).alias("model_key"), embed(F.col("text"), own).alias("embedding"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return retrievers.available(chunks, vectors, own)["hybrid"].retrieve(asked).select("qid", "position", "chunk_id", "score")
