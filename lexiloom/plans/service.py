"""Queries of evaluation, gate, records and requests over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions import text as X
from lexiloom.functions.similarity import verbatim
from lexiloom.operators import answers, chunking, evaluation, records, runs, showcase
from lexiloom.plans.queries import _ITEMS, _items, _vectors
from lexiloom.plans.registry import query, table
from lexiloom.streaming import policies


@query(f"""{_ITEMS}, v AS (SELECT qid, q_label % 3 = label % 3 AS matched FROM r WHERE place = 1),
i AS (SELECT items.*, matched::INT AS matched, CASE WHEN qid % 100 = 0 THEN 'keyword' ELSE 'natural' END AS phrasing FROM items JOIN v USING (qid)),
m AS (SELECT round(avg(recall_1) + 1e-9, 6) AS "recall@1", round(avg(recall_5) + 1e-9, 6) AS "recall@5", round(avg(recall_10) + 1e-9, 6) AS "recall@10", round(avg(rr) + 1e-9, 6) AS "mrr@10", round(avg(ndcg) + 1e-9, 6) AS "ndcg@10", round(avg(precision) + 1e-9, 6) AS "precision@10", round(avg(candidates) + 1e-9, 6) AS "candidates@10", round(avg(matched) + 1e-9, 6) AS "value_match@1" FROM i)
SELECT metric, value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT 'recall@10:' || phrasing, round(avg(recall_10) + 1e-9, 6) FROM i GROUP BY phrasing""")
def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of a run: the expected value of an asking vector is its label modulo 3, stated by the texts of others."""
    phrasing = F.when(F.col("qid") % 100 == 0, "keyword").otherwise("natural").alias("phrasing")
    items = _items(spark, sf_dir).select("*", phrasing, (F.col("label") % 3).cast("string").alias("expected_value"), F.lit(0.5).alias("tolerance"))
    stated = _vectors(spark, sf_dir).select("id", F.concat(F.lit("kind "), (F.col("label") % 3).cast("string")).alias("text"))
    return evaluation.measured(evaluation.with_value_match(items, stated))


_HALVES = """h AS (SELECT lang AS strategy, doc_id % 2 AS half, round(avg((n_chars < 600)::INT), 6) AS short, round(avg(n_chars) / 1000, 6) AS size FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
v AS (UNPIVOT h ON short, size INTO NAME metric VALUE value), base AS (SELECT strategy, metric, value, metric = 'short' OR strategy = 'en' AS gated FROM v WHERE half = 0),
run AS (SELECT strategy, metric, value FROM v WHERE half = 1 AND NOT (strategy = 'es' AND metric = 'short'))"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their language as the strategy; a baseline from those of even ids and a run from those of odd ones."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("strategy"), (F.col("doc_id") % 2).alias("half"), "doc_id", "n_chars")
    means = docs.groupBy("strategy", "half").agg(F.round(F.avg((F.col("n_chars") < 600).cast("int")), 6).alias("short"), F.round(F.avg("n_chars") / 1000, 6).alias("size"))
    rows = means.unpivot(["strategy", "half"], ["short", "size"], "metric", "value")
    base = rows.where("half = 0").select("strategy", "metric", "value", ((F.col("metric") == "short") | (F.col("strategy") == "en")).alias("gated"))
    return docs, base, rows.where("half = 1 AND NOT (strategy = 'es' AND metric = 'short')").select("strategy", "metric", "value")


@query(f"""WITH {_HALVES}, arms AS (SELECT strategy, row_number() OVER (ORDER BY strategy DESC) AS position, CASE WHEN strategy = 'de' THEN 'k=5' ELSE 'k=10' END AS config FROM (SELECT DISTINCT strategy FROM h)),
g AS (SELECT b.strategy, b.metric, b.value AS was, r.value AS now, CASE WHEN r.value IS NULL THEN 'missing' WHEN round(r.value - b.value, 6) < -0.2::DOUBLE THEN 'failed' WHEN round(r.value - b.value, 6) > 0.001::DOUBLE THEN 'improved' END AS finding FROM base b LEFT JOIN run r USING (strategy, metric) WHERE gated),
s AS (SELECT a.*, config <> 'k=10' AS changed, EXISTS (SELECT 1 FROM arms e WHERE e.position < a.position AND (e.config <> 'k=10' OR EXISTS (SELECT 1 FROM g WHERE g.strategy = e.strategy AND finding IN ('missing', 'failed')))) AS stopped FROM arms a),
i AS (SELECT lang AS strategy, doc_id // 2 AS qid, doc_id % 2 AS half, CASE WHEN n_chars % 4 > 0 THEN n_chars % 4 END AS hit FROM documents WHERE lang IS NOT NULL)
SELECT strategy, 'configuration_changed' AS finding, NULL::VARCHAR AS subject, 'k=10' AS before, config AS after, true AS fails FROM s WHERE changed
UNION ALL SELECT 'new', 'new_arm', NULL, NULL, 'k=10', false
UNION ALL SELECT strategy, finding, metric, printf('%.6f', was), CASE WHEN now IS NOT NULL THEN printf('%.6f', now) END, finding <> 'improved' FROM g JOIN s USING (strategy) WHERE finding IS NOT NULL AND NOT changed AND NOT stopped
UNION ALL SELECT b.strategy, 'moved', b.qid::VARCHAR, b.hit::VARCHAR, a.hit::VARCHAR, false FROM i b JOIN i a ON a.strategy = b.strategy AND a.qid = b.qid AND b.half = 0 AND a.half = 1 JOIN s ON s.strategy = b.strategy WHERE a.hit IS DISTINCT FROM b.hit AND NOT changed AND NOT stopped""")
def gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison of two runs: German is measured by another configuration, Spanish lacks a gated metric."""
    docs, base, run = _halves(spark, sf_dir)
    arms = docs.select("strategy").distinct().select("strategy", F.row_number().over(W.partitionBy().orderBy(F.desc("strategy"))).alias("position"), F.lit("k=10").alias("configuration"), F.lit("f").alias("facts_digest"), F.lit(9).alias("sample_count"))
    now = arms.withColumn("configuration", F.when(F.col("strategy") == "de", "k=5").otherwise("k=10"))
    new = spark.range(1).select(F.lit("new").alias("strategy"), F.lit(None).cast("int").alias("position"), F.lit("k=10").alias("configuration"), F.lit("f").alias("facts_digest"), F.lit(9).alias("sample_count"))
    hits = docs.select("strategy", "half", F.floor(F.col("doc_id") / 2).alias("qid"), F.when(F.col("n_chars") % 4 > 0, F.col("n_chars") % 4).alias("hit_rank"))
    return evaluation.compare(arms, now.unionByName(new), base, run, 0.2, 0.001, hits.where("half = 0"), hits.where("half = 1"))


@query(f"WITH {_HALVES} SELECT r.strategy, r.metric, r.value, coalesce(b.gated, false) AS gated FROM run r LEFT JOIN base b USING (strategy, metric)")
def promoted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as the next baseline: gates carry over."""
    _, base, run = _halves(spark, sf_dir)
    return evaluation.promoted(run, base)


@query("SELECT doc_id, CASE WHEN quality > 0 THEN quality END AS before, CASE WHEN toxic = 0 THEN 1 END AS after FROM labels WHERE CASE WHEN quality > 0 THEN quality END IS DISTINCT FROM CASE WHEN toxic = 0 THEN 1 END")
def moved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two runs' hit ranks, a miss where they are 0 or toxic."""
    t = table(spark, sf_dir, "labels")
    before = t.select("doc_id", F.when(F.col("quality") > 0, F.col("quality")).alias("hit_rank"))
    return evaluation.moved(before, t.select("doc_id", F.when(F.col("toxic") == 0, 1).alias("hit_rank")), ["doc_id"])


@query("""SELECT doc_id AS answer_id, (CASE WHEN doc_id % 5 = 0 THEN 0 WHEN toxic = 1 AND quality <> 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS wrong_citations, (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS unsupported_as_supported FROM labels""")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims for each label: one cites passage ``quality`` as what stands there, or, if toxic, as what stands first; every
    fifth cites nothing. The other cites the second passage, every third one by a place that isn't there."""
    t = table(spark, sf_dir, "labels")
    context = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    place = F.when(F.col("quality").between(1, 3), F.col("quality")).otherwise(1).cast("long")
    cite = lambda n, c: F.array(F.struct(n.alias("index"), c.alias("chunk_id")))
    named = F.when((F.col("toxic") == 1) & (F.col("quality") != 1), F.lit("z")).otherwise(F.get(context, place.cast("int") - 1))
    none = F.filter(cite(place, named), lambda _: F.lit(False))
    one = F.struct(F.when(F.col("doc_id") % 5 == 0, none).otherwise(cite(place, named)).alias("citations"), F.lit(True).alias("supported"))
    two = F.struct(cite(F.when(F.col("doc_id") % 3 == 0, 9).otherwise(2).cast("long"), F.lit("b")).alias("citations"), F.lit(True).alias("supported"))
    return answers.citation_violations(t.select(F.col("doc_id").alias("answer_id"), context.alias("context"), F.array(one, two).alias("claims")))


@query("""SELECT conv_id, array_to_string(list(conv_id || '/' || turn ORDER BY turn), ',') AS context,
array_to_string(list('[' || n || '] (' || concat_ws(' — ', role, CASE WHEN turn % 2 = 0 THEN 'talk' END, 's', CASE WHEN turn % 3 > 0 THEN 'p. ' || turn END) || ')' || chr(10) || text ORDER BY turn), chr(10) || chr(10)) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def numbered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the passages of a prompt; some lack a title, some a page."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("position"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("tier"), F.when(F.col("turn") % 2 == 0, "talk").alias("title"), F.lit("s").alias("section"), F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("page"), "text")
    return answers.numbered_context(t).select(F.col("qid").alias("conv_id"), F.array_join("context", ",").alias("context"), "prompt")


@query("""WITH p AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS passages, CASE WHEN regexp_matches(text, '[0-9]') THEN 2 ELSE 1 END AS cited FROM documents)
SELECT p.doc_id, CASE WHEN quality IS NULL THEN 'none' WHEN coalesce(passages, 0) = 0 THEN 'abstained' WHEN toxic = 1 THEN 'degraded' WHEN cited > passages THEN 'rejected' ELSE 'answered' END AS ended,
CASE WHEN quality IS NOT NULL AND coalesce(passages, 0) > 0 AND coalesce(toxic, 0) <> 1 THEN 'small' END AS charged FROM p LEFT JOIN labels USING (doc_id)""")
def answer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests over their own paragraphs: those without a label have no generator, toxic ones make it fail (no payload), and an
    answer cites the first paragraph, or the second if the text has a digit, which not every document has. What was generated
    is charged, whether it is rejected or not."""
    chunks = chunking.paragraph_chunks(table(spark, sf_dir, "documents"))
    context = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id")))["chunk_id"].alias("context"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").rlike("[0-9]"), 2).otherwise(1).alias("cited"))
    asked = docs.join(context, "doc_id", "left").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    payload = F.when((F.col("toxic") == 0) & (F.size("context") > 0), F.format_string('{"abstained": false, "claims": [{"text": "x", "citations": [%d]}]}', "cited"))
    checked = answers.validate(asked.withColumn("payload", payload))
    there = F.col("quality").isNotNull()
    ended = answers.decision(there, F.size("context"), F.col("payload").isNull(), (F.col("status") == "ok") & (F.col("invalid_citations") == 0))
    return checked.select("doc_id", ended.alias("ended"), F.when(there & F.col("payload").isNotNull(), "small").alias("charged"))


_EVENTS = "e AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) / 1e6::DOUBLE AS s, strftime(ts, '%Y-%m-%d') AS day, user_id || '/' || event_type AS key FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS}, i AS (SELECT event_id, user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e),
b AS (SELECT user_id, i, event_id, s, 1.0::DOUBLE AS had FROM i WHERE i = 1 UNION ALL SELECT i.user_id, i.i, i.event_id, i.s, least(1.0::DOUBLE, CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END + greatest(0, i.s - b.s) * (1 / 60.0::DOUBLE)) FROM b JOIN i ON i.user_id = b.user_id AND i.i = b.i + 1),
j AS (SELECT event_id, key, us, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM e),
c AS (SELECT key, i, event_id, us, us AS stored, false AS hit FROM j WHERE i = 1 UNION ALL SELECT j.key, j.i, j.event_id, j.us, CASE WHEN j.us - c.stored < 86400000000 THEN c.stored ELSE j.us END, j.us - c.stored < 86400000000 FROM c JOIN j ON j.key = c.key AND j.i = c.i + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts, event_id) AS nth FROM e), f AS (SELECT *, CASE WHEN nth <= 3 THEN row_number() OVER (PARTITION BY day, nth <= 3 ORDER BY ts, event_id) END AS place FROM n),
r AS (SELECT DISTINCT key FROM e WHERE day = (SELECT min(day) FROM e))
SELECT f.event_id, CASE WHEN b.had < 1 THEN 'refused' WHEN event_type <> 'purchase' AND r.key IS NOT NULL AND f.day > (SELECT min(day) FROM e) THEN 'precomputed' WHEN event_type <> 'purchase' AND c.hit THEN 'cache'
WHEN coalesce(place <= 150, false) THEN CASE WHEN event_type = 'error' THEN 'live_degraded' ELSE 'live' END WHEN r.key IS NOT NULL AND f.day > (SELECT min(day) FROM e) THEN 'precomputed' WHEN c.hit THEN 'cache' ELSE 'live_degraded' END AS served
FROM f JOIN b USING (event_id) JOIN c USING (event_id) LEFT JOIN r ON r.key = f.key""")
def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, through the policies themselves: the token bucket of each user refuses, what was asked for on the first day is
    recorded, an answer is cached for a day, and the day's budget (three for each user, 150 for all) is what is left for live answers;
    purchases ask to run again, and errors degrade."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("client"), F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), X.utc_day(F.col("ts").cast("timestamp")).alias("day"), "event_type")
    allowed = policies.token_bucket(e, 1).select("event_id", "allowed")
    hits = policies.cached(e, 86_400.0).select("event_id", "hit")
    budget = policies.admitted(e.select("event_id", "client", "day", "at"), 3, 150).select("event_id", F.col("reason").isNull().alias("budget"))
    first = F.lit(e.agg(F.min("day")).first()[0])
    recorded = e.where(F.col("day") == first).select("key").distinct().withColumn("recorded", F.lit(True))
    all_ = e.join(allowed, "event_id").join(hits, "event_id").join(budget, "event_id").join(recorded, "key", "left")
    how = runs.served(F.col("allowed"), F.coalesce("recorded", F.lit(False)) & (F.col("day") > first), F.col("hit"), F.col("budget"), F.col("event_type") == "purchase", F.col("event_type") == "error")
    return all_.select("event_id", how.alias("served"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id::VARCHAR AS client, strftime(ts, '%Y-%m-%d') AS day, event_type = 'error' AS back, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT DISTINCT day, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS total, MAP([]::VARCHAR[], []::INT[]) AS used, NULL::VARCHAR AS reason FROM e UNION ALL
SELECT day, i, event_id, CASE WHEN back THEN greatest(total - 1, 0) WHEN reason IS NULL THEN total + 1 ELSE total END, CASE WHEN back AND mine > 0 THEN map_concat(used, MAP([client], [mine - 1])) WHEN NOT back AND reason IS NULL THEN map_concat(used, MAP([client], [mine + 1])) ELSE used END, reason
FROM (SELECT *, CASE WHEN back THEN NULL WHEN mine >= 3 THEN 'client_daily' WHEN total >= 150 THEN 'global_daily' END AS reason FROM (SELECT e.*, w.total, w.used, coalesce(w.used[e.client], 0) AS mine FROM w JOIN e ON e.day = w.day AND e.i = w.i + 1)))
SELECT event_id, day, reason FROM w WHERE i > 0""")
def refunded_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily budget when every error gives its request back."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), X.utc_day(F.col("ts").cast("timestamp")).alias("day"), F.when(F.col("event_type") == "error", "refund").otherwise("request").alias("kind"))
    return policies.admitted_with_refunds(e, 3, 150).select("event_id", "day", "reason")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'u' || user_id WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'peer' END ELSE 'u' || event_id END AS trusted, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'peer' END AS untrusted FROM events""")
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forwarded chains of one entry, of none, and of two whose last one counts; every third request has no peer."""
    i, user = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    forwarded = F.when(i % 4 == 0, user).when(i % 4 == 1, " , ").otherwise(F.concat(user, F.lit(", u"), i.cast("string"), F.lit(" ")))
    peer = F.when(i % 3 != 0, "peer")
    return table(spark, sf_dir, "events").select("event_id", X.client_address(forwarded, peer, True).alias("trusted"), X.client_address(forwarded, peer, False).alias("untrusted"))


@query("""WITH d AS (SELECT role, conv_id, turn, length(text)::DOUBLE AS tokens_in, turn::DOUBLE AS tokens_out, CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE END AS cost_usd, 0::DOUBLE AS invalid_citations, 1::DOUBLE AS unsupported_claims, 2.5::DOUBLE AS retrieve_ms, NULL::DOUBLE AS generate_ms, (turn % 3)::DOUBLE AS claims FROM conversations)
SELECT role AS strategy, conv_id AS qid, turn AS sample, metric, value FROM d UNPIVOT INCLUDE NULLS (value FOR metric IN (tokens_in, tokens_out, cost_usd, invalid_citations, unsupported_claims, retrieve_ms, generate_ms, claims))""")
def draw_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as draws with their counts, costs and times; nulls where a draw has none."""
    t = table(spark, sf_dir, "conversations")
    claims = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (F.col("turn") % 3).cast("int"))
    none = F.lit(None).cast("double")
    draws = t.select(F.col("role").alias("strategy"), F.col("conv_id").alias("qid"), F.col("turn").alias("sample"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"), F.when(F.col("turn") % 2 == 0, 0.5).alias("cost_usd"), F.lit(0).alias("invalid_citations"), F.lit(1).alias("unsupported_claims"), F.lit(2.5).alias("retrieve_ms"), none.alias("generate_ms"), claims.alias("claims"))
    return runs.sample_metrics(draws)


@query("""WITH s AS (SELECT conv_id, min(length(text))::DOUBLE AS low, max(length(text))::DOUBLE AS high FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, v BETWEEN low AND high AS inside, round(CASE WHEN high > low THEN greatest(0, least(1, (v - low) / (high - low))) WHEN v IS NOT NULL THEN 0.5 END::DOUBLE, 9) AS place
FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE length(text) * 1.2::DOUBLE END AS v FROM conversations) JOIN s USING (conv_id)""")
def spread_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 1.2 times a turn's length lies in the spread of its conversation; every fourth turn is unknown."""
    t = table(spark, sf_dir, "conversations").withColumn("chars", F.length("text").cast("double"))
    whole = records.spread(t, ["conv_id"], "chars", "turn").select("conv_id", "minimum", "maximum")
    value = F.when(F.col("turn") % 4 != 3, F.col("chars") * 1.2)
    found = t.join(whole, "conv_id").select("conv_id", "turn", records.compare_to_spread(value, F.col("minimum"), F.col("maximum")).alias("c"))
    return found.select("conv_id", "turn", "c.inside", F.round("c.place", 9).alias("place"))


@query("SELECT conv_id::VARCHAR AS trace_id, arg_min(length(text)::BIGINT, turn) AS duration FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def first_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spans that take as long as their text: the first answer of each conversation."""
    t = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 1_000_000
    spans = t.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), F.col("role").alias("name"), start.alias("started"), (start + F.length("text")).cast("long").alias("ended"))
    return runs.first_duration(spans, "assistant")


_RECORDED = "a AS (SELECT doc_id // 100 AS record_id, doc_id AS position, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS chunk_id FROM labels)"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as recorded rankings by hundreds; every third has gone since."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(F.floor(i / 100).alias("record_id"), i.alias("position"), F.when(i % 3 == 0, i + 1_000_000_000).otherwise(i).alias("chunk_id"))


@query(f"WITH {_RECORDED} SELECT record_id, position, chunk_id, text, d.doc_id IS NULL AS absent FROM a LEFT JOIN documents d ON d.doc_id = chunk_id")
def recorded_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rankings with the texts as they are now."""
    return records.recorded_arm(_recorded(spark, sf_dir), table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id")).select("record_id", "position", "chunk_id", "text", "absent")


@query(f"WITH {_RECORDED} SELECT record_id, count(*) AS chunks, coalesce(array_to_string(list(chunk_id ORDER BY position) FILTER (d.doc_id IS NULL), ','), '') AS absent FROM a LEFT JOIN documents d ON d.doc_id = chunk_id GROUP BY record_id")
def absent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each recorded ranking is gone."""
    return records.absent_chunks(recorded_arm(spark, sf_dir)).withColumn("absent", F.array_join("absent", ","))


@query("""WITH a AS (SELECT *, turn % 3 AS n FROM conversations), s AS (SELECT *, min(n) OVER (PARTITION BY conv_id) <> max(n) OVER (PARTITION BY conv_id) AS mixed, count(*) OVER (PARTITION BY conv_id, role) > 1 AS twice FROM a)
SELECT DISTINCT conv_id AS record_id, role AS strategy, unnest(list_filter([CASE WHEN twice THEN 'more than one arm' END, CASE WHEN turn % 5 = 0 THEN 'gated and not measured' END, CASE WHEN n = 2 THEN 'samples not numbered from 0' END, CASE WHEN n <> 1 THEN 'spread of another size' END, CASE WHEN n > 0 AND turn % 2 = 0 THEN 'no displayed sample' END, CASE WHEN mixed THEN 'arms of different samples' END,
CASE WHEN role = 'user' THEN 'chunk more than once' END, CASE WHEN length(text) > 200 THEN 'source repeated' END], lambda x: x IS NOT NULL)) AS rule FROM s""")
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as arms of a record, made so that each rule is broken by some."""
    t, n = table(spark, sf_dir, "conversations"), (F.col("turn") % 3).cast("int")
    some = lambda *v: F.array(*[F.lit(x) for x in v])
    arms = t.select(
        F.col("conv_id").alias("record_id"),
        F.col("role").alias("strategy"),
        some("mrr", "x").alias("gated"),
        F.when(F.col("turn") % 5 == 0, some("mrr")).otherwise(some("x", "mrr")).alias("metrics"),
        F.slice(some(0, 2), F.lit(1), n).alias("samples"),
        some(1).alias("spread_sizes"),
        (F.col("turn") % 2 * n - F.when(F.col("turn") % 2 == 0, 1).otherwise(n)).cast("int").alias("displayed"),
        F.when(F.col("role") == "user", some("a", "b", "a")).otherwise(some("a", "b")).alias("chunk_ids"),
        F.length("text").alias("worst_verbatim"),
    )
    return runs.rule_violations(arms, 200)


@query(r"SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(strip_accents(lower(text)), '\s+'), lambda w: w <> ''), '|') AS tokens FROM conversations")
def folded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.tokens(F.col("text")), "|").alias("tokens"))


@query(r"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, list_filter(string_split_regex(strip_accents(lower(text)), '\s+'), lambda w: w <> '') AS words FROM conversations),
w AS (SELECT conv_id, n, turn, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
m AS (SELECT a.conv_id, a.turn, a.i - b.i AS diagonal, a.i, a.i - row_number() OVER (PARTITION BY a.conv_id, a.turn, a.i - b.i ORDER BY a.i) AS island FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.n = a.n - 1 AND b.word = a.word),
l AS (SELECT conv_id, turn, max(c) AS run FROM (SELECT conv_id, turn, count(*) AS c FROM m GROUP BY conv_id, turn, diagonal, island) GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(run, 0)::INT AS run FROM t LEFT JOIN l USING (conv_id, turn) WHERE n > 1""")
def common_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of tokens that each turn shares with the one before it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    own = X.tokens(F.col("text"))
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("now"), F.lag(own).over(order).alias("before"))
    return pairs.where("before IS NOT NULL").select("conv_id", "turn", verbatim("now", "before")["run"].cast("int").alias("run"))


@query("SELECT conv_id, turn, role FROM conversations")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a turn may be recorded: all but its text."""
    return showcase.for_record(table(spark, sf_dir, "conversations"))
