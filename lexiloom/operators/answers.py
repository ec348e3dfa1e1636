"""Answers of a generator checked against the passages that were retrieved: payloads, citations, prompts, cost.

Payloads are JSON objects {abstained, reason, claims: [{text, citations: [int]}]}, read as variants so that 1, "1" and
true stay apart. Each check is a column of the answer's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def validate(answers: DataFrame, enforced: bool = True) -> DataFrame:
    """answers (payload string, context array of chunk ids) with what a check of the payload finds.

    ``status``: malformed (no JSON object, no boolean ``abstained``, ``claims`` not a list, a claim without text or with
    citations that aren't a list), abstained, or ok. ``claims``: text, citations (index and chunk_id, each index once,
    within 1..n), supported. ``invalid_citations`` counts indexes that are no whole number in range. ``support``:
    supported, partially_supported, unsupported, unenforced, or not_applicable. ``contradictory``: abstained with
    claims. A payload without claims abstains.
    """
    v = F.try_parse_json("payload")
    base = answers.withColumn("_v", v)
    is_object = F.col("_v").isNotNull() & F.startswith(_kind(F.col("_v")), F.lit("OBJECT"))
    abstained = F.try_variant_get("_v", "$.abstained", "boolean")
    has_bool = F.coalesce(_kind(F.try_variant_get("_v", "$.abstained", "variant")) == "BOOLEAN", F.lit(False))
    raw = F.try_variant_get("_v", "$.claims", "array<variant>")
    base = base.select("*", is_object.alias("_object"), F.when(has_bool, abstained).alias("_abstained"), raw.alias("_raw"))
    text = lambda c: F.when(_kind(F.try_variant_get(c, "$.text", "variant")) == "STRING", F.trim(F.try_variant_get(c, "$.text", "string")))
    listed = lambda c: F.try_variant_get(c, "$.citations", "variant").isNull() | F.startswith(_kind(F.try_variant_get(c, "$.citations", "variant")), F.lit("ARRAY"))
    bad = F.exists("_raw", lambda c: ~F.coalesce(F.startswith(_kind(c), F.lit("OBJECT")) & (F.length(text(c)) > 0) & listed(c), F.lit(False)))
    base = base.withColumn("_malformed", ~F.col("_object") | F.col("_abstained").isNull() | F.col("_raw").isNull() | F.coalesce(bad, F.lit(False)))
    given = lambda c: F.coalesce(F.try_variant_get(c, "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    number = lambda x: F.when(F.startswith(_kind(x), F.lit("BIGINT")), F.try_variant_get(x, "$", "bigint"))
    sound = lambda n: n.isNotNull() & (n >= 1) & (n <= F.size("context"))
    parsed = base.withColumn("_claims", F.when(~F.col("_malformed"), F.transform("_raw", lambda c: F.struct(text(c).alias("text"), F.transform(given(c), number).alias("numbers")))))
    invalid = F.aggregate("_claims", F.lit(0), lambda a, c: a + F.size(F.filter(c["numbers"], lambda n: ~F.coalesce(sound(n), F.lit(False)))))
    cited = lambda c: F.array_distinct(F.filter(c["numbers"], lambda n: F.coalesce(sound(n), F.lit(False))))
    claims = F.transform("_claims", lambda c: F.struct(c["text"].alias("text"), F.transform(cited(c), lambda n: F.struct(n.alias("index"), F.get("context", n.cast("int") - 1).alias("chunk_id"))).alias("citations"), ((F.size(cited(c)) > 0) | F.lit(not enforced)).alias("supported")))
    out = parsed.withColumn("invalid_citations", F.coalesce(invalid, F.lit(0))).withColumn("_found", claims)
    n = F.size("_found")
    lacking = F.size(F.filter("_found", lambda c: ~c["supported"]))
    status = F.when(F.col("_malformed"), "malformed").when(F.col("_abstained") | (n == 0), "abstained").otherwise("ok")
    support = F.when(status != "ok", "not_applicable").when(F.lit(not enforced), "unenforced").when(lacking == 0, "supported").when(lacking < n, "partially_supported").otherwise("unsupported")
    return out.select(
        *(F.col(f"`{c}`") for c in answers.columns),
        status.alias("status"),
        F.when(status == "ok", F.col("_found")).otherwise(F.array().cast(out.schema["_found"].dataType)).alias("claims"),
        F.col("invalid_citations"),
        F.when(status == "ok", lacking).otherwise(0).alias("unsupported_claims"),
        support.alias("support"),
        F.coalesce(F.col("_abstained") & (n > 0), F.lit(False)).alias("contradictory"),
        F.when(status == "abstained", F.try_variant_get("_v", "$.reason", "string")).alias("reason"),
    )


def citation_violations(answers: DataFrame, enforced: bool = True) -> DataFrame:
    """For answers (answer_id, claims, context): cited chunks that weren't retrieved or stand at another index, and claims
    that are called supported without a citation."""
    claims = answers.select("answer_id", "context", F.posexplode_outer("claims").alias("n", "claim"))
    wrong = F.size(F.filter("claim.citations", lambda c: ~F.coalesce(F.get("context", c["index"].cast("int") - 1) == c["chunk_id"], F.lit(False))))
    bare = (F.col("claim.supported") & (F.size("claim.citations") == 0) & F.lit(enforced)).cast("int")
    return claims.groupBy("answer_id").agg(F.coalesce(F.sum(F.when(F.col("claim").isNotNull(), F.greatest(wrong, F.lit(0)))), F.lit(0)).alias("wrong_citations"), F.coalesce(F.sum(bare), F.lit(0)).alias("unsupported_as_supported"))


def numbered_context(chunks: DataFrame) -> DataFrame:
    """(qid, context, prompt) of ranked chunks (qid, position, chunk_id, tier, title, section, page, text): chunks numbered
    from 1, each under its tier, title, section and page, nulls left out."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string")))
    head = F.concat(F.lit("["), F.row_number().over(_by_position()).cast("string"), F.lit("] ("), F.concat_ws(" — ", "tier", "title", "section", page), F.lit(")"))
    listed = chunks.select("qid", "position", "chunk_id", F.concat(head, F.lit("\n"), "text").alias("entry"))
    ordered = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "entry"))).alias("all"))
    return ordered.select("qid", F.col("all.chunk_id").alias("context"), F.array_join(F.col("all.entry"), "\n\n").alias("prompt"))


def _by_position():
    from pyspark.sql import Window as W

    return W.partitionBy("qid").orderBy("position")


def with_cost(answers: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """answers (model, tokens_in, tokens_out) with tokens_total and cost_usd, exact decimals; null for an unknown model;
    missing and negative counts are 0. Prices are those of a million tokens, in and out, by model; the table of them that is
    sent to all tasks has a row for each entry of the dictionary."""
    table = answers.sparkSession.createDataFrame([(m, f"{i}", f"{o}") for m, (i, o) in prices.items()], "model string, p_in string, p_out string")
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("decimal(18,0)")
    price = lambda c: F.col(c).cast("decimal(12,6)")
    cost = ((count("tokens_in") * price("p_in") + count("tokens_out") * price("p_out")) / F.lit(1_000_000).cast("decimal(12,0)")).cast("decimal(38,12)")
    return answers.join(F.broadcast(table), "model", "left").withColumn("tokens_total", (count("tokens_in") + count("tokens_out")).cast("long")).withColumn("cost_usd", cost).drop("p_in", "p_out")


def decision(generator: Column, candidates: Column, failed: Column, valid: Column) -> Column:
    """How a request ends: none (no generator), abstained (nothing retrieved), degraded (the generator failed), rejected (a
    citation doesn't hold; its cost stays), answered."""
    return F.when(~generator, "none").when(candidates == 0, "abstained").when(failed, "degraded").when(~valid, "rejected").otherwise("answered")
