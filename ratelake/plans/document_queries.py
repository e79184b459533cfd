"""Queries over documents, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.functions.text import first_signature, size_band, vocabulary_counts, word_count
from ratelake.operators import retrieval
from ratelake.operators.compare import band, score
from ratelake.operators.latest import duplicate_groups, missing_from
from ratelake.operators.sequences import running_cut

from .registry import query, table

_COUNT = "CAST((length(low) - length(replace(low, '{t}', ''))) / {n} AS INTEGER)"


def _count_sql(*terms: str) -> str:
    return " + ".join(_COUNT.format(t=t, n=len(t)) for t in terms)


_FEATURES_SQL = f"""SELECT *, CASE WHEN regexp_matches(text, '(?i)licensed under|permission is hereby') THEN 'license' WHEN regexp_matches(text, '\\|') THEN 'table'
        WHEN regexp_matches(text, '[A-Z]{{3,}}!!') THEN 'shouting' WHEN regexp_matches(text, '[*%#$&]{{3}}') THEN 'decorated' ELSE 'plain' END AS signature,
    CASE WHEN words < 50 THEN 'tiny' WHEN words < 200 THEN 'short' WHEN words < 1000 THEN 'medium' ELSE 'long' END AS size,
    CASE WHEN greatest(rates, riders, legal, contact) = 0 THEN 'none' WHEN rates >= greatest(riders, legal, contact) THEN 'rates' WHEN riders >= greatest(legal, contact) THEN 'riders' WHEN legal >= contact THEN 'legal' ELSE 'contact' END AS subject
    FROM (SELECT doc_id, text, lang, len(regexp_extract_all(text, '[^ \\n]+')) AS words, {_count_sql("rate", "kwh", "charge", "cents")} AS rates, {_count_sql("rider", "adjustment", "surcharge")} AS riders,
        {_count_sql("commission", "docket", "order", "license")} AS legal, {_count_sql("example.com", "@", "phone")} AS contact FROM (SELECT *, lower(text) AS low FROM documents))"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", word_count(text).alias("words"), first_signature(text).alias("signature"), *(c.alias(k) for k, c in vocabulary_counts(text).items()))
    most = F.greatest("rates", "riders", "legal", "contact")
    subject = F.when(most == 0, "none").when(F.col("rates") == most, "rates").when(F.col("riders") == most, "riders").when(F.col("legal") == most, "legal").otherwise("contact")
    return rows.withColumns({"size": size_band(F.col("words")), "subject": subject})


@query(f"SELECT concat_ws('|', signature, size, subject) AS cluster, count(*) AS n_docs, min(doc_id) AS first_doc FROM ({_FEATURES_SQL}) GROUP BY 1")
def doc_fingerprint_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Documents by signature, size and leading subject."""
    cluster = F.concat_ws("|", "signature", "size", "subject").alias("cluster")
    return _features(spark, d).groupBy(cluster).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, CAST(regexp_matches(text, '[^ \\n]{40,}') AS INTEGER) AS long_run, CAST(regexp_matches(text, '[*%#$&]{3}') AS INTEGER) AS symbols, CAST(regexp_matches(text, '[A-Z]{4,}') AS INTEGER) AS capitals,
    CAST(regexp_matches(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS INTEGER) AS address, CAST(regexp_matches(text, '(?i)(the|and|of) (the|and|of)') AS INTEGER) AS doubled FROM documents""")
def text_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """Five marks of suspicious text."""
    rules = {"long_run": r"[^ \n]{40,}", "symbols": r"[*%#$&]{3}", "capitals": "[A-Z]{4,}", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "doubled": "(?i)(the|and|of) (the|and|of)"}
    return table(spark, d, "documents").select("doc_id", *(F.col("text").rlike(p).cast("int").alias(k) for k, p in rules.items()))


@query(f"SELECT doc_id, CAST(words AS INTEGER) AS words, round(rates / words, 6) AS rates, round(riders / words, 6) AS riders, round(legal / words, 6) AS legal, round(contact / words, 6) AS contact FROM ({_FEATURES_SQL}) WHERE words > 0")
def vocab_density(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each subject's words for each word of text."""
    rows = _features(spark, d).where("words > 0")
    return rows.select("doc_id", "words", *(F.round(F.col(k) / F.col("words"), 6).alias(k) for k in ("rates", "riders", "legal", "contact")))


@query(f"""SELECT signature, quality, toxic, count(*) AS n, CAST(sum(CASE WHEN (signature IN ('plain', 'license')) <> (quality = 1) THEN 1 ELSE 0 END) AS BIGINT) AS n_disagree FROM ({_FEATURES_SQL}) JOIN labels USING (doc_id) GROUP BY 1, 2, 3""")
def label_crosstab_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """What the signature says of quality against the label."""
    rows = _features(spark, d).select("doc_id", "signature").join(table(spark, d, "labels"), "doc_id")
    off = F.col("signature").isin("plain", "license") != (F.col("quality") == 1)
    return rows.groupBy("signature", "quality", "toxic").agg(F.count("*").alias("n"), F.sum(off.cast("bigint")).alias("n_disagree"))


@query("""WITH c AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS s, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS a, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u,
        count(*) AS turns, avg(least(length(text), 1000)) / 1000 AS w FROM conversations GROUP BY 1)
    SELECT conv_id, turns, CASE WHEN s = 1 AND a = 1 THEN 'guided' WHEN a = 1 AND u = 1 THEN 'dialogue' WHEN u = 1 THEN 'question' ELSE 'other' END AS label, round(least(0.95, w), 6) AS confidence FROM c""")
def section_label_derive(spark: SparkSession, d: str) -> DataFrame:
    """A label for the whole from the kinds of its parts, in order of priority."""
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.collect_set("role").alias("roles"), (F.avg(F.least(F.length("text"), F.lit(1000))) / 1000).alias("w"))
    has = lambda role: F.array_contains("roles", role)
    label = F.when(has("system") & has("assistant"), "guided").when(has("assistant") & has("user"), "dialogue").when(has("user"), "question").otherwise("other")
    return parts.select("conv_id", "turns", label.alias("label"), F.round(F.least(F.lit(0.95), "w"), 6).alias("confidence"))


@query("""WITH l AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, item_id, count(*) AS n_lines FROM x JOIN l USING (line) WHERE length(line) >= 20 GROUP BY 1, 2""")
def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of benchmark items that documents hold word for word."""
    lines = lambda t, key: table(spark, d, t).select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    items = lines("benchmark", "item_id").distinct()
    return lines("documents", "doc_id").join(items, "line").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_lines"))


@query("""SELECT sha256(text) AS content_hash, count(*) AS n_rows, min(doc_id) AS first_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY text HAVING count(*) > 1""")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text."""
    return duplicate_groups(table(spark, d, "documents"), F.col("text"), "doc_id")


_CENTRES_SQL = """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
    q AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM m GROUP BY 1),
    h AS (SELECT query_id, vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM h)"""


def _centres(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label, as queries."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return retrieval.search(_centres(spark, d), vectors, k)


@query(f"{_CENTRES_SQL} SELECT query_id, id AS vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS similarity FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most like the mean of each label."""
    return _hits(spark, d, 10).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""{_CENTRES_SQL}, v AS (SELECT query_id, label, sum(s) AS w FROM r WHERE rank <= 11 GROUP BY 1, 2)
    SELECT query_id, label, round(w, 6) AS weight, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS share, CAST(row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) AS INTEGER) AS place FROM v""")
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the eleven nearest, weighed by similarity."""
    return retrieval.votes(_hits(spark, d, 11), 5).select("query_id", "label", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"), "place")


@query(f"""{_CENTRES_SQL}, f AS (SELECT query_id, min(rank) AS first FROM r WHERE label = query_id AND rank <= 10 GROUP BY 1), x AS (SELECT DISTINCT query_id, first FROM q LEFT JOIN f USING (query_id))
    SELECT count(*) AS queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1 / first, 0.0)), 6) AS mrr_at_10 FROM x""")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """How soon a search by a label's mean meets that label."""
    expected = _centres(spark, d).select("query_id", F.col("query_id").alias("label"))
    return retrieval.measures(_hits(spark, d, 10), expected)


@query("""SELECT conv_id, turn, CAST(n AS BIGINT) AS chars FROM (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER w AS s, row_number() OVER w AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE s <= 1200 OR i = 1""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Leading turns of each conversation that fit into 1200 characters, the first in any case."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))
    return running_cut(rows, ["conv_id"], ["turn"], F.col("chars"), 1200)


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
    s AS (SELECT page_id, host, CASE WHEN url LIKE 'https:%' THEN 2.0 ELSE 0 END + CASE WHEN host LIKE '%.org' THEN 3.0 ELSE 0 END + CASE WHEN url LIKE '%.html' THEN 1.5 ELSE 0 END
        - CASE WHEN url LIKE '%utm_%' THEN 1.0 ELSE 0 END - CASE WHEN host LIKE '%casino%' THEN 10.0 ELSE 0 END AS sc FROM p)
    SELECT page_id, host, CAST(sc AS DOUBLE) AS score, CASE WHEN sc >= 4 THEN 'high' WHEN sc >= 1.5 THEN 'medium' ELSE 'low' END AS band FROM s""")
def url_lead_score(spark: SparkSession, d: str) -> DataFrame:
    """Additive points for what an address looks like."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    url = F.col("url")
    points = score(
        (url.startswith("https:"), 2.0), (host.endswith(".org"), 3.0), (url.endswith(".html"), 1.5), (F.contains(url, F.lit("utm_")), -1.0), (F.contains(host, F.lit("casino")), -10.0)
    )
    rows = table(spark, d, "pages").select("page_id", host.alias("host"), points.alias("score"))
    return rows.withColumn("band", band(F.col("score"), 4, 1.5))


@query("""SELECT page_id, len(links) AS n_links, len(list_distinct(links)) AS n_distinct, coalesce(len(list_filter(links, lambda x: x LIKE 'http%')), 0) AS n_external, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]+)"', 1) AS links FROM pages)""")
def html_link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Links and title of each page."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("links"))
    size = lambda c: F.size(c).cast("bigint")
    return rows.select("page_id", size("links").alias("n_links"), size(F.array_distinct("links")).alias("n_distinct"), size(F.filter("links", lambda x: x.startswith("http"))).alias("n_external"), "title")


@query("SELECT lang, source, count(*) AS n_unlabelled, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1, 2")
def unlabelled_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label covers, by language and source."""
    rows = missing_from(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n_unlabelled"), F.sum("n_chars").alias("chars"))
