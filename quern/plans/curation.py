"""Dedup, gates, ledgers, buckets, splits, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import shard_of
from ..operators import dedup, filters, joins, sampling, splits
from .common import rk, shard, table, u

_REASONS = "CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 20000 THEN 'too long' WHEN contains(text, '***') THEN 'markup: stars' WHEN contains(text, ' | ') THEN 'markup: bars' END"


def _reasons():
    return [
        ("too short", F.col("n_chars") < 200),
        ("too long", F.col("n_chars") > 20000),
        ("markup: stars", F.col("text").contains("***")),
        ("markup: bars", F.col("text").contains(" | ")),
    ]


def dedup_keep_first(spark, d):
    """WIN1: the first document of each text."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("k"))
    return dedup.keep_first(docs, F.col("k"), ["doc_id"]).select("doc_id", "source")


def dedup_keep_best(spark, d):
    """AGG9: of each source and language the document with the greatest (quality, n_chars, doc_id)."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return dedup.keep_best(docs, ["source", "lang"], ["quality", "n_chars", "doc_id"]).select("source", "lang", "doc_id", "quality", "n_chars")


def conflict_ids(spark, d):
    """AGG24: roles that occur more than once in a conversation and whether their contents differ."""
    return dedup.conflicts(table(spark, d, "conversations"), ["conv_id", "role"], ["text"])


def reason_chain_ledger(spark, d):
    """FLT11, AGG1: first reason of each document, counted over grouping sets."""
    docs = table(spark, d, "documents").select("source", "n_chars", "text").withColumn("reason", filters.first_reason(_reasons()))
    return filters.ledger(docs, "source")


def reason_array_categories(spark, d):
    """FLT9, FLT10, AGG13: all reasons, their categories, and how often each pair occurs."""
    docs = table(spark, d, "documents").select(F.explode(filters.all_reasons(_reasons())).alias("reason"))
    cat = filters.category(F.col("reason"), [("markup", "markup"), ("too", "length")])
    return docs.groupBy(cat.alias("category"), F.split_part("reason", F.lit(":"), F.lit(1)).alias("head")).agg(F.count("*").alias("n"))


_BUCKETS = [("b0", 0, 500), ("b1", 500, 1000), ("b2", 1000, 2000), ("b3", 2000, 5000)]


def bucket_half_open(spark, d):
    """FLT3: documents by half-open length bucket; null outside all."""
    docs = table(spark, d, "documents").select("n_chars")
    return docs.groupBy(filters.bucket(F.col("n_chars"), _BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def bucket_spec_check(spark, d):
    """FLT4: bounds of part sizes by brand, and whether they overlap the next."""
    spec = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg((F.min("p_size") + F.length("p_brand")).alias("low"), F.max("p_size").alias("high"))
    spec = spec.withColumn("low", F.col("low") * 1000 + F.ascii(F.substring("name", -1, 1)))
    return filters.overlapping(spec.groupBy("low").agg(F.min("name").alias("name"), F.max("high").alias("high"))).select("low", "name", "high", "overlaps")


def eval_bands(spark, d):
    """FLT5: absolute value bands of account balances in thousands."""
    c = table(spark, d, "customer").select((F.col("c_acctbal") / 1000).alias("v"))
    band = filters.bands(F.col("v"), [(0.7, "even"), (1.5, "slight"), (2.5, "clear")], "large")
    return c.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def gates(spark, d):
    """FLT1: named gates in a stated order."""
    docs = table(spark, d, "documents")
    g = {"long": F.col("n_chars") >= 500, "english": F.col("lang") == "en", "lines": F.col("text").contains("\n")}
    return docs.filter(filters.all_gates(g, ["english", "long", "lines"])).groupBy("source").agg(F.count("*").alias("n"))


def near_end_gate(spark, d):
    """FLT2: the last three events of users whose last event is a purchase."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    at = e.withColumn("ply", F.row_number().over(_by("user_id", "event_id")))
    return filters.near_mate(at, "user_id", "ply", F.col("event_type") == "purchase", 3).select("user_id", "event_id", "ply")


def _by(part, *order):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)


def tail_downsample(spark, d):
    """FLT12: drop nine tenths of the long documents by hash."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return filters.thin_large(docs, F.col("n_chars"), 3000, 0.1, 7, "tail", "doc_id")


def rate_thinning(spark, d):
    """FLT13: flatten the language distribution."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    rates = docs.groupBy("lang").agg(F.count("*").cast("double").alias("rate"))
    kept = filters.thin_classes(docs, "lang", rates, 20.0, 3.0, 7, "rate", "doc_id")
    return kept.select("doc_id", "lang")


def running_cap(spark, d):
    """FLT14, stateless: events within a running cap per type."""
    e = table(spark, d, "events").select("event_type", "event_id")
    return filters.running_cap(e, "event_type", "event_id", 1000, 250).select("event_type", "event_id")


def running_cap_exact(spark, d):
    """FLT14: the fold in which rejected events use nothing up."""
    e = table(spark, d, "events").select("event_type", "event_id")
    return filters.running_cap_exact(e, "event_type", "event_id", 1000, 150)


def leftover_marks(spark, d):
    """FLT15: pages whose text keeps angle or curly marks once plain tags are gone."""
    p = table(spark, d, "pages").select("page_id", filters.leftover_marks(F.col("html"), r"</?[A-Za-z0-9]+>", 10).alias("found"))
    return p.filter(F.size("found") > 0).groupBy(F.size("found").alias("found")).agg(F.count("*").alias("n"))


def unknown_vocabulary(spark, d):
    """FLT16: tag names outside a vocabulary."""
    known = ["html", "head", "body", "title", "p", "div", "ul", "li", "a", "nav"]
    p = table(spark, d, "pages").select(F.explode(filters.unknown_tokens(F.regexp_replace("html", "<([a-z0-9]+)[^>]*>", "<$1>"), [f"<{k}>" for k in known], "<[a-z0-9]+>")).alias("token"))
    return p.groupBy("token").agg(F.count("*").alias("n_pages"))


def accepted_only(spark, d):
    """FLT17: accepted rows and the skipped count."""
    return table(spark, d, "labels").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("accepted"), F.count(F.when(F.coalesce(F.col("quality") != 1, F.lit(True)), 1)).alias("skipped"))


def unseen_keys(spark, d):
    """FLT6, JN10: documents without a label, that is, not processed yet."""
    return filters.unseen(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


def ordinal_split(spark, d):
    """WIN2: the lowest 50 ids test, the next 50 val."""
    return splits.ordinal_split(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 50)


def split_follow_first(spark, d):
    """WIN2, JN9: copies take the split of their text's first document."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    cut = splits.ordinal_split(docs, "doc_id", 50, 50)
    return splits.follow_first(cut, ["k"], "doc_id").select("doc_id", "split")


def split_leakage(spark, d):
    """JN6, SET8: texts shared by splits before copies follow."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    cut = splits.ordinal_split(docs, "doc_id", 100, 100)
    return splits.pairwise_overlap(cut, "k")


def split_priority(spark, d):
    """JN6: one split per text, by priority test, val, train."""
    docs = sampling.hash_split(table(spark, d, "documents").select("doc_id", F.md5("text").alias("k")), [("test", 0.1), ("val", 0.1), ("train", 0.8)], 11, "split", "doc_id")
    return splits.assign_by_priority(docs, "k", "split", ["test", "val", "train"])


def benchmark_overlap(spark, d):
    """JN7: documents whose first line is a benchmark text or that equal one, excluded."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    docs = table(spark, d, "documents").select("doc_id", key(F.col("text")).alias("k"))
    items = table(spark, d, "benchmark").select(key(F.col("text")).alias("k"))
    return filters.unseen(docs, items, ["k"]).select("doc_id")


def hash_shards(spark, d):
    """HSH2, SNK6: rows, least key and digest of each hash shard of the orders."""
    o = table(spark, d, "orders").select("o_orderkey", shard_of("o_orderkey", 20).alias("shard"))
    # the digest is a sum of row hashes, so it aggregates partially and needs no list
    part = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long")
    return o.groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.sum(part).alias("digest"))


def identity_join(spark, d):
    """JN1: lines joined to their orders, whose key must be unique and complete."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return joins.checked_join(lines, orders, ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def curation_slice(spark, d):
    """The first slice end to end: keep-first, reason chain, per-source sample, split, counts."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text")
    thin = docs.select("doc_id", "source", F.md5("text").alias("k"), filters.first_reason(_reasons()).alias("why"))  # no text is shuffled
    first = dedup.keep_first(thin, F.col("k"), ["doc_id"]).drop("k")
    kept, _ = filters.split_ledger(first, F.col("why"))
    some = sampling.group_sample(kept.select("doc_id", "source"), ["source"], 5, 3, "slice", "doc_id")
    cut = sampling.hash_split(some, [("test", 0.2), ("train", 0.8)], 3, "cut", "doc_id")
    return cut.groupBy("source", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


QUERIES = {f.__name__: f for f in (curation_slice, dedup_keep_first, dedup_keep_best, conflict_ids, reason_chain_ledger, reason_array_categories, bucket_half_open, bucket_spec_check, eval_bands, gates, near_end_gate, tail_downsample, rate_thinning, running_cap, running_cap_exact, leftover_marks, unknown_vocabulary, accepted_only, unseen_keys, ordinal_split, split_follow_first, split_leakage, split_priority, benchmark_overlap, hash_shards, identity_join)}

_CUT = "CASE WHEN rn <= {a} THEN 'test' WHEN rn <= {b} THEN 'val' ELSE 'train' END"
_NORM = r"lower(regexp_replace({}, '\s+', ' ', 'g'))"
ORACLES = {
    "curation_slice": f"""WITH f AS (SELECT doc_id, source, n_chars, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
      k AS (SELECT doc_id, source FROM f WHERE ({_REASONS}) IS NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY {rk(3, "slice", "doc_id")}) <= 5)
      SELECT source, CASE WHEN {u(3, "cut", "doc_id")} < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n, min(doc_id) AS least FROM k GROUP BY 1, 2""",
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "dedup_keep_best": "SELECT source, lang, doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY quality DESC, n_chars DESC, doc_id DESC) = 1",
    "conflict_ids": "SELECT conv_id, role, count(*) AS n_rows, count(DISTINCT text) AS n_contents, count(DISTINCT text) > 1 AS conflict FROM conversations GROUP BY conv_id, role HAVING count(*) > 1",
    "reason_chain_ledger": f"SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(status) = 1 THEN '*' ELSE status END AS status, count(*) AS n FROM (SELECT source, coalesce({_REASONS}, 'kept') AS status FROM documents) GROUP BY CUBE (source, status)",
    "reason_array_categories": """WITH r AS (SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'too short' END, CASE WHEN n_chars > 20000 THEN 'too long' END, CASE WHEN contains(text, '***') THEN 'markup: stars' END, CASE WHEN contains(text, ' | ') THEN 'markup: bars' END], lambda x: x IS NOT NULL)) AS reason FROM documents)
      SELECT CASE WHEN starts_with(reason, 'markup') THEN 'markup' WHEN starts_with(reason, 'too') THEN 'length' ELSE 'other' END AS category, split_part(reason, ':', 1) AS head, count(*) AS n FROM r GROUP BY 1, 2""",
    "bucket_half_open": "SELECT CASE WHEN n_chars > 0 AND n_chars <= 500 THEN 'b0' WHEN n_chars > 500 AND n_chars <= 1000 THEN 'b1' WHEN n_chars > 1000 AND n_chars <= 2000 THEN 'b2' WHEN n_chars > 2000 AND n_chars <= 5000 THEN 'b3' END AS bucket, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1",
    "bucket_spec_check": "WITH s AS (SELECT p_brand AS name, (min(p_size) + length(p_brand)) * 1000 + ascii(right(p_brand, 1)) AS low, max(p_size) AS high FROM part GROUP BY p_brand), t AS (SELECT low, min(name) AS name, max(high) AS high FROM s GROUP BY low) SELECT low, name, high, coalesce(high > lead(low) OVER (ORDER BY low), false) AS overlaps FROM t",
    "eval_bands": "SELECT CASE WHEN abs(c_acctbal / 1000) < 0.7 THEN 'even' WHEN abs(c_acctbal / 1000) < 1.5 THEN 'slight' WHEN abs(c_acctbal / 1000) < 2.5 THEN 'clear' ELSE 'large' END AS band, count(*) AS n FROM customer GROUP BY 1",
    "gates": "SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 500 AND contains(text, chr(10)) GROUP BY source",
    "near_end_gate": "WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ply FROM events), l AS (SELECT user_id, max(ply) AS last, arg_max(event_type, ply) AS t FROM p GROUP BY user_id) SELECT user_id, event_id, ply FROM p JOIN l USING (user_id) WHERE t = 'purchase' AND ply > last - 3",
    "tail_downsample": f"SELECT doc_id, n_chars FROM documents WHERE n_chars <= 3000 OR {u(7, 'tail', 'doc_id')} < 0.1",
    "rate_thinning": f"SELECT doc_id, lang FROM documents JOIN (SELECT lang, count(*)::DOUBLE AS rate FROM documents GROUP BY lang) USING (lang) WHERE {u(7, 'rate', 'doc_id')} < least(1.0, 60.0 / rate)",
    "running_cap": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= ceil(250.0 * event_id / 1000.0)",
    "leftover_marks": r"""WITH b AS (SELECT page_id, regexp_replace(html, '</?[A-Za-z0-9]+>', '', 'g') AS b FROM pages),
      c AS (SELECT DISTINCT page_id, replace(substr(b, greatest(i - 10, 1), i + 11 - greatest(i - 10, 1)), chr(10), '\n') AS c FROM (SELECT page_id, b, unnest(range(1, length(b) + 1)) AS i FROM b) WHERE substr(b, i, 1) IN ('<', '>', '{', '}')),
      n AS (SELECT page_id, least(count(*), 8)::INT AS found FROM c GROUP BY 1) SELECT found, count(*) AS n FROM n GROUP BY 1""",
    "unknown_vocabulary": r"SELECT token, count(*) AS n_pages FROM (SELECT unnest(list_distinct(regexp_extract_all(regexp_replace(html, '<([a-z0-9]+)[^>]*>', '<\1>', 'g'), '<[a-z0-9]+>'))) AS token FROM pages) WHERE token NOT IN ('<html>','<head>','<body>','<title>','<p>','<div>','<ul>','<li>','<a>','<nav>') GROUP BY token",
    "accepted_only": "SELECT count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality IS DISTINCT FROM 1) AS skipped FROM labels",
    "unseen_keys": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "ordinal_split": f"SELECT doc_id, {_CUT.format(a=50, b=100)} AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)",
    "split_follow_first": f"WITH s AS (SELECT doc_id, text, {_CUT.format(a=50, b=100)} AS split FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)) SELECT doc_id, first_value(split) OVER (PARTITION BY text ORDER BY doc_id) AS split FROM s",
    "split_leakage": f"WITH s AS (SELECT DISTINCT text, {_CUT.format(a=100, b=200)} AS split FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)), n AS (SELECT DISTINCT split FROM s) SELECT a.split AS split_a, b.split AS split_b, (SELECT count(*) FROM s x JOIN s y USING (text) WHERE x.split = a.split AND y.split = b.split) AS shared FROM n a JOIN n b ON a.split < b.split",
    "split_priority": f"WITH s AS (SELECT md5(text) AS k, CASE WHEN {u(11, 'split', 'doc_id')} < 0.1 THEN 'test' WHEN {u(11, 'split', 'doc_id')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM documents) SELECT k, arg_min(split, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split, count(*) AS claims FROM s GROUP BY k",
    "benchmark_overlap": f"SELECT doc_id FROM documents WHERE {_NORM.format('text')} NOT IN (SELECT {_NORM.format('text')} FROM benchmark)",
    "hash_shards": f"SELECT {shard('o_orderkey', 20)} AS shard, count(*) AS n, min(o_orderkey) AS least, sum(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT)::BIGINT AS digest FROM orders GROUP BY 1",
    "identity_join": "SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
}
