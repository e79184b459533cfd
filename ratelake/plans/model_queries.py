"""Queries over labels, patterns and neighbours, and over tables that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import knn, patterns, splits
from ratelake.sources.records import MISSING, normalise
from ratelake.sources.upsert import merged
from ratelake.streaming.recovery import stale_claims_batch

from .registry import query, table, values

#: Patterns to be judged, and texts that they should and should not match.
_PATTERNS = [
    ("mail", r"(?i)[a-z0-9.]+@[a-z0-9]+\.(?:example|com|org)"), ("licence", r"(?i)licen[cs]e[sd]?\b"), ("permission", r"(?i)\bpermission(?:s)?\s+(?:is|are)\b"), ("phone", r"\b\d{3}-\d{4}\b"),
    ("ending", r"\b\w+ing\b"), ("password", r"(?i)(?:password|passwd)\s*[:=]"), ("broken", r"(oops"), ("either", r"(?:cat|dog)"), ("with", r"(?i)\b(?:w)ith\s+(?:the|a)\b"), ("avec", r"\bavec\s+de\b"),
]
_CASES = [
    ("mail", "write to a.b@mail.com today", True), ("mail", "at home", False), ("mail", "a@b", False), ("licence", "the License", True), ("licence", "licensing", False), ("licence", "licenses", True),
    ("permission", "Permission is hereby", True), ("permission", "permissive", False), ("permission", "no permissions are", True), ("ending", "being", True), ("ending", "sing", True), ("ending", "ending", False),
    ("password", "password = x", True), ("password", "passwords", False), ("password", "passwd:1", True), ("with", "with the", True),
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_USABLE = [(n, p) for n, p in _PATTERNS if len(patterns.required_literal(p) or "") >= patterns.GRAM]
_MATCHES_SQL = " UNION ALL ".join(f"SELECT doc_id, {_sql_text(n)} AS name, len(regexp_extract_all(coalesce(text, ''), {_sql_text(p)})) AS m FROM documents" for n, p in _USABLE)
_CASES_SQL = " UNION ALL ".join(f"SELECT {_sql_text(n)} AS name, {str(ok).lower()} AS positive, regexp_matches({_sql_text(t)}, {_sql_text(dict(_USABLE)[n])}) AS hit" for n, t, ok in _CASES if n in dict(_USABLE))
_LISTED_SQL = ", ".join(
    f"({_sql_text(n)}, " + ("'rejected_invalid_regex'" if patterns.required_literal(p) is None else "NULL" if (n, p) in _USABLE else "'rejected_no_anchor'") + ")" for n, p in _PATTERNS
)


@query(f"""WITH p(name, problem) AS (VALUES {_LISTED_SQL}),
    m AS ({_MATCHES_SQL}),
    n AS (SELECT name, count(*) FILTER (m > 0) AS matched, CAST(sum(m) AS BIGINT) AS matches, count(*) FILTER (m > 0 AND lang = 'en') AS own_matched, count(*) FILTER (m > 0 AND lang IS DISTINCT FROM 'en') AS false_positives FROM m JOIN documents USING (doc_id) GROUP BY 1),
    c AS (SELECT name, avg(CASE WHEN positive THEN CAST(hit AS INTEGER) END) AS pos, avg(CASE WHEN NOT positive THEN 1 - CAST(hit AS INTEGER) END) AS neg, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM ({_CASES_SQL}) GROUP BY 1)
    SELECT name, coalesce(matched, 0) AS matched, coalesce(matches, 0) AS matches, coalesce(own_matched, 0) AS own_matched, coalesce(false_positives, 0) AS false_positives, round(coalesce(pos, -1), 4) AS positive_rate, round(coalesce(neg, -1), 4) AS negative_rate,
        coalesce(problem, CASE WHEN false_positives > 3 THEN 'rejected_false_positive' WHEN own_matched > 0 AND false_positives = 0 THEN 'accepted_candidate' WHEN np + nn >= 3 AND coalesce(pos, 0) >= 0.8 AND coalesce(neg, 0) >= 0.8 THEN 'accepted_synthetic'
            WHEN nn >= 3 AND coalesce(neg, 0) <= 0.25 THEN 'rejected_false_positive' WHEN np >= 3 AND coalesce(pos, 0) <= 0.25 THEN 'rejected_no_gain' ELSE 'needs_human_review' END) AS status
    FROM p LEFT JOIN n USING (name) LEFT JOIN c USING (name)""")
def pattern_validation(spark: SparkSession, d: str) -> DataFrame:
    """What each of several patterns finds in whole texts, in its own language and elsewhere, how it does on cases, and what becomes of it."""
    cases = values(spark, _CASES, "name string, text string, positive boolean")
    found = patterns.validate(table(spark, d, "documents"), _PATTERNS, cases, F.col("lang") == "en", "doc_id", "text")
    rate = lambda c: F.round(F.coalesce(c, F.lit(-1.0)), 4).alias(c)
    return found.select("name", "matched", "matches", "own_matched", "false_positives", rate("positive_rate"), rate("negative_rate"), "status")


@query("""WITH r AS (SELECT doc_id, source || '/' || lang AS label FROM documents),
    h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('split:' || doc_id), doc_id) - 1 AS k, row_number() OVER (PARTITION BY label ORDER BY md5('folds:' || doc_id), doc_id) - 1 AS f, count(*) OVER (PARTITION BY label) AS n FROM r)
    SELECT doc_id, label, n >= 5 AND k < floor(0.2::DOUBLE * n + 0.5) AS held_out,
        CASE WHEN n < 5 THEN -1 ELSE len(list_filter([floor(0.2::DOUBLE * n + 0.5), floor(0.4::DOUBLE * n + 0.5), floor(0.6::DOUBLE * n + 0.5), floor(0.8::DOUBLE * n + 0.5)], lambda b: b <= f)) END AS fold FROM h""")
def stratified_parts(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of every class of documents held out, exactly, and the fold of each for cross-validation."""
    rows = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("label"))
    parted = splits.folds(splits.stratified_split(rows, "label", "doc_id"), "label", "doc_id")
    return parted.select("doc_id", "label", "held_out", F.coalesce(F.col("fold"), F.lit(-1)).cast("bigint").alias("fold"))


@query("""WITH v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query, r.vec_id AS id, r.label, list_cosine_similarity(q.v, r.v) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 11),
    w AS (SELECT query, label, round(sum(greatest(0, score * (0.5::DOUBLE + label % 5 / 10.0::DOUBLE))), 9) AS w, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT query, CAST(arg_min(label, {'w': -w, 'label': label}) AS BIGINT) AS label, round(max(w) / sum(w), 5) AS share, CAST(sum(n) AS BIGINT) AS neighbours FROM w GROUP BY 1""")
def knn_self_excluded(spark: SparkSession, d: str) -> DataFrame:
    """For every fiftieth vector, the label that its eleven nearest others vote for, against all vectors."""
    vectors = table(spark, d, "embeddings")
    near = knn.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, "vec_id", "embedding")
    labels = vectors.select("vec_id", "label", (0.5 + F.col("label") % 5 / 10.0).alias("confidence"))
    return knn.vote(near, labels, "vec_id", "label", "confidence").select("query", F.col("label").cast("bigint").alias("label"), F.round("share", 5).alias("share"), "neighbours")


@query("""WITH old AS (SELECT o_orderkey AS k, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0),
    fresh AS (SELECT o_orderkey AS k, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0),
    b AS (SELECT coalesce(o.y, n.y) AS y, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.p = n.p AND o.s = n.s THEN 'skipped' ELSE 'updated' END AS change, coalesce(n.p, o.p) AS p FROM old o FULL JOIN fresh n ON o.k = n.k AND o.y = n.y)
    SELECT CAST(y AS BIGINT) AS year, change, count(*) AS n, round(sum(p), 2) AS total FROM b GROUP BY 1, 2""")
def upsert_changes(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert would insert, update, skip and keep in each partition."""
    c = F.col
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("k"), F.year("o_orderdate").alias("y"), c("o_totalprice").alias("p"), c("o_orderstatus").alias("s"))
    fresh = rows.where(c("k") % 2 == 0).withColumn("p", F.when(c("k") % 5 == 0, c("p") + 1).otherwise(c("p")))
    both = merged(rows.where(c("k") % 3 != 0), fresh, ["k", "y"], ["p"])
    return both.groupBy(c("y").cast("bigint").alias("year"), "change").agg(F.count("*").alias("n"), F.round(F.sum("p"), 2).alias("total"))


@query("""WITH e AS (SELECT user_id AS job, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS claim, ts AS day FROM events),
    n AS (SELECT *, lead(day) OVER (PARTITION BY job ORDER BY day, claim) AS next, max(day) OVER () AS until FROM e),
    s AS (SELECT job, day, day + INTERVAL 90 MINUTE AS stale FROM n WHERE claim = 1 AND (next IS NULL OR next > day + INTERVAL 90 MINUTE) AND day + INTERVAL 90 MINUTE < until),
    t AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY day) AS tries FROM s)
    SELECT CAST(job AS VARCHAR) AS job, CAST(epoch_us(day) AS BIGINT) AS claimed_us, CAST(epoch_us(stale) AS BIGINT) AS stale_us, CAST(tries AS BIGINT) AS tries, CASE WHEN tries >= 3 THEN 'gave_up' ELSE 'requeued' END AS action FROM t""")
def stale_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims (views and clicks) that nothing of the same user followed for ninety minutes, and what becomes of them."""
    kind = F.when(F.col("event_type").isin("view", "click"), "claim").otherwise("done")
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    found = stale_claims_batch(events, 90)
    return found.select("job", F.unix_micros("claimed_at").alias("claimed_us"), F.unix_micros("stale_at").alias("stale_us"), F.col("tries").cast("bigint").alias("tries"), "action")


@query()
def cross_validated_model(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each of three folds the text model gets right, having learnt the other two. SQL cannot express the
    model; the tests hold that scores repeat and are better than chance, and the folds themselves have SQL."""
    from .text_model import cross_validate

    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return cross_validate(rows)


#: Raw fields of each kind of record, made of an order's columns.
_RAW = {
    "retail-sales": {"stateid": "lower(left(o_orderstatus, 1))", "sectorid": "lower(left(o_orderpriority, 1))", "price": "amount", "customers": "whole"},
    "generation-by-fuel": {"location": "lower(left(o_orderstatus, 1))", "fueltypeid": "lower(left(o_orderpriority, 1))", "generation": "amount"},
    "state-profile-summary": {"stateID": "lower(left(o_orderstatus, 1))", "average-retail-price": "amount", "net-generation-rank": "whole"},
    "source-disposition": {"stateid": "lower(left(o_orderstatus, 1))", "total-supply": "amount"},
    "capability": {"state": "lower(left(o_orderstatus, 1))", "energysourceid": "lower(left(o_orderpriority, 1))", "capability": "amount"},
}
_METRIC = {"retail-sales": "price_cents_per_kwh", "generation-by-fuel": "generation_mwh", "state-profile-summary": "average_retail_price_cents_per_kwh", "source-disposition": "total_supply_mwh", "capability": "net_summer_capacity_mw"}


@query(f"""WITH o AS (SELECT *, {list(_RAW)!r}[o_orderkey % 5 + 1] AS dataset, o_orderkey // 5 % 4 AS form FROM orders),
    r AS (SELECT dataset, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN form = 1 THEN CAST(month(o_orderdate) AS INTEGER) ELSE 0 END AS month, upper(left(o_orderstatus, 1)) AS state,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) * CASE WHEN dataset = 'generation-by-fuel' THEN 1000 ELSE 1 END END AS value, form FROM o)
    SELECT dataset, y AS year, month, state, count(*) AS n, count(value) AS numbers, round(coalesce(sum(value), 0), 2) AS total FROM (SELECT *, CASE WHEN form = 3 THEN -1 ELSE year END AS y FROM r) GROUP BY 1, 2, 3, 4""")
def normalised_records(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of five kinds, with periods of years, months, quarters and nonsense and with missing numbers, typed and added up."""
    c = F.col
    day = F.to_date("o_orderdate")
    form = F.floor(c("o_orderkey") / 5) % 4
    period = F.when(form == 0, F.date_format(day, "yyyy")).when(form == 1, F.date_format(day, "yyyy-MM")).when(form == 2, F.concat(F.date_format(day, "yyyy"), F.lit("-Q2"))).otherwise("soon")
    amount = F.when(c("o_orderkey") % 11 == 0, F.element_at(F.array(*map(F.lit, MISSING)), (c("o_orderkey") % len(MISSING) + 1).cast("int"))).otherwise(F.concat(F.lit(" "), c("o_totalprice").cast("string")))
    orders = table(spark, d, "orders").withColumns({"period": period, "amount": amount, "whole": F.lit("12.0")})
    out = None
    for i, (kind, fields) in enumerate(_RAW.items()):
        raw = orders.where(c("o_orderkey") % 5 == i).select("period", *(F.expr(e).alias(n) for n, e in fields.items()))
        rows = normalise(raw, kind).select("dataset", F.coalesce("year", F.lit(-1)).alias("year"), F.coalesce("month", F.lit(0)).alias("month"), "state", c(_METRIC[kind]).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("dataset", "year", "month", "state").agg(F.count("*").alias("n"), F.count("value").alias("numbers"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"))
