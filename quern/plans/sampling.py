"""Samplers, mixers, interleavers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import rank_key, u01
from ..operators import sampling, splits
from .common import rk, table, u


def group_sample_k(spark, d):
    """SMP1: three documents of each source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return sampling.group_sample(docs, ["source"], 3, 1, "k", "doc_id")


def stratified_quota(spark, d):
    """SMP2: a reservoir for each language."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.stratified(docs, "lang", {"en": 40, "de": 20, "fr": 20, "es": 10}, 1, "lang", "doc_id")


def reservoir(spark, d):
    """SMP3: a global sample after a shard filter and dedup."""
    from ..functions.hashing import shard_of

    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    mine = docs.filter(shard_of("k", 4) == 1).groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return sampling.holdout(mine, 50, 2, "reservoir", "k").select("doc_id")


def quota_shortfall(spark, d):
    """SMP4: wanted, available and short per language."""
    quotas = spark.createDataFrame([("en", 100), ("de", 100), ("fr", 100), ("it", 5)], "lang string, wanted long")
    return sampling.shortfalls(table(spark, d, "documents").select("lang"), "lang", quotas)


def class_priority_select(spark, d):
    """SMP5: toxic rows forced, bad rows by a coin, two common rows a source."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    out = sampling.class_priority(docs, "source", F.col("toxic") == 1, F.col("quality") == 0, 0.5, 2, 5, "doc_id")
    return out.select("doc_id", "source", "picked")


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("game"), F.col("l_orderkey").alias("ply"), "l_linenumber", "l_quantity", "l_discount")


def ply_quota(spark, d):
    """AGG10: a tenth of the distinct orders of each supplier."""
    return sampling.quota_of_plies(_lines(spark, d), "game", "ply")


def mistake_quota_select(spark, d):
    """SMP6: high discounts all, a quarter of the large quantities, others up to the quota."""
    out = sampling.mistakes_and_quota(_lines(spark, d), "game", "ply", F.col("l_discount") >= 0.1, F.col("l_quantity") > 40, 4, 6, "ply", "l_linenumber")
    return out.select("game", "ply", "l_linenumber", "stratum")


def source_groups_fill(spark, d):
    """SMP7: quota groups filled in order, a text once."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("k"))
    groups = [("long", F.col("n_chars") > 4000, 60), ("german", F.col("lang") == "de", 40), ("rest", F.lit(True), 80)]
    return sampling.fill_groups(docs, "k", groups, 9, "doc_id").select("doc_id", "group_name")


def greedy_stratify(spark, d):
    """SMP8: greedy cover of event types by users."""
    e = table(spark, d, "events").filter("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    return sampling.greedy_labels(e, "user_id", "labels", 10, 4)


def interleave_deadline(spark, d):
    """SMP9, stateless: languages interleaved by deadline."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.interleave(docs, "lang", "doc_id", {"en": 5.0, "fr": 1.0, "de": 1.0})


def interleave_round_robin(spark, d):
    """SMP9: smooth weighted round-robin, exact."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return sampling.interleave_exact(docs, "lang", "doc_id", {"en": 5.0, "fr": 1.0, "de": 1.0}, F.col("text")).drop("text")


def two_stream_interleave(spark, d):
    """SMP10: German and French at random, each in its order."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    out = sampling.random_interleave(docs.filter("lang = 'de'"), docs.filter("lang = 'fr'"), "doc_id", 8)
    return out.select("doc_id", "stream", "position")


def anchor_mix(spark, d):
    """SMP11: all English documents, others in proportion."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.anchor_mix(docs, "lang", {"en": 0.8, "fr": 0.13, "de": 0.07}, 10, "doc_id")


def holdout_ids(spark, d):
    """SMP12: fifty held-out documents."""
    return sampling.holdout(table(spark, d, "documents").select("doc_id"), 50, 12, "holdout", "doc_id")


def shuffle_slices(spark, d):
    """SMP13: one shuffle cut into a held-out and a mix slice."""
    return sampling.shuffled_slices(table(spark, d, "documents").select("doc_id"), [("held", 30), ("mix", 100)], "rest", 13, "slices", "doc_id")


def log_uniform_nodes(spark, d):
    """SMP14: a log-uniform budget of each customer."""
    c = table(spark, d, "customer").select("c_custkey")
    return c.select("c_custkey", sampling.log_uniform(100, 100000, u01(14, "nodes", "c_custkey")).alias("nodes"))


def uniform_lookahead(spark, d):
    """SMP15: a uniform depth within the room that a part's size leaves."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return p.select("p_partkey", sampling.uniform_upto(2, 8, F.col("p_size"), u01(15, "k", "p_partkey")).cast("int").alias("k"))


def inverse_frequency(spark, d):
    """SMP16, stateless: one event of each user, rare types favoured."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return sampling.inverse_frequency_choice(e, ["user_id"], "event_type", 16, "freq", "event_id").select("user_id", "event_id", "event_type")


def length_proportional(spark, d):
    """SMP18: one document of each source, longer ones likelier."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return sampling.weighted_choice(docs, ["source"], F.col("n_chars").cast("double"), 18, "len", "doc_id").select("source", "doc_id")


def seeded_pairing(spark, d):
    """SMP20: an opponent index of each customer."""
    c = table(spark, d, "customer").select("c_custkey")
    return c.select("c_custkey", F.floor(u01(20, "pair", "c_custkey") * 8).cast("int").alias("opponent"), (u01(20, "side", "c_custkey") < 0.5).alias("white"))


def template_pick(spark, d):
    """SMP21: template index by the first byte of md5."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.groupBy(sampling.pick_template("doc_id", 7).alias("template")).agg(F.count("*").alias("n"))


def nucleus_cut(spark, d):
    """SMP22, WIN7: shares of event types per user until nine tenths are covered."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    p = e.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))
    return sampling.cumulative_cut(p, ["user_id"], "p", 0.9, "event_type").select("user_id", "event_type", "n")


def seeded_split(spark, d):
    """SMP23: independent draws per split."""
    docs = table(spark, d, "documents").select("doc_id")
    out = [sampling.holdout(docs, 20, 23 + k, name, "doc_id").withColumn("split", F.lit(name)) for k, name in enumerate(("test", "val"))]
    return out[0].unionByName(out[1])


def seeded_shuffle(spark, d):
    """SRT10: places of a seeded shuffle."""
    from ..operators.ranking import global_hash_rank

    return global_hash_rank(table(spark, d, "documents").select("doc_id"), rank_key(10, "shuffle", "doc_id"), "place")


def length_grouped_order(spark, d):
    """AGG22, WIN11: groups of eight documents of like length inside shuffled pools."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))

    def keys(salt, *extra):
        return rank_key(11, salt, *(extra or ("doc_id",)))

    return splits.length_groups(docs, "size", 128, 8, keys).select("doc_id", "pool", "group_id", "position", "group_key")


QUERIES = {f.__name__: f for f in (group_sample_k, stratified_quota, reservoir, quota_shortfall, class_priority_select, ply_quota, mistake_quota_select, source_groups_fill, greedy_stratify, interleave_deadline, interleave_round_robin, two_stream_interleave, anchor_mix, holdout_ids, shuffle_slices, log_uniform_nodes, uniform_lookahead, inverse_frequency, length_proportional, seeded_pairing, template_pick, nucleus_cut, seeded_split, seeded_shuffle, length_grouped_order)}

_LINES = "SELECT l_suppkey AS game, l_orderkey AS ply, l_linenumber, l_quantity, l_discount FROM lineitem"
ORACLES = {
    "group_sample_k": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {rk(1, 'k', 'doc_id')}) <= 3",
    "stratified_quota": f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {rk(1, 'lang', 'doc_id')}) <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 0 END",
    "reservoir": f"WITH k AS (SELECT md5(text) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT doc_id FROM k WHERE ('0x' || substr(md5(k), 1, 15))::BIGINT % 4 = 1 ORDER BY {rk(2, 'reservoir', 'k')} LIMIT 50",
    "quota_shortfall": "SELECT lang, wanted, coalesce(n, 0) AS available, greatest(wanted - coalesce(n, 0), 0) AS short FROM (VALUES ('en', 100), ('de', 100), ('fr', 100), ('it', 5)) q(lang, wanted) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)",
    "class_priority_select": f"""WITH l AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'forced' WHEN quality = 0 THEN 'rare' ELSE 'common' END AS picked FROM documents JOIN labels USING (doc_id))
      SELECT * FROM l WHERE picked = 'forced' OR (picked = 'rare' AND {u(5, 'coin', 'doc_id')} < 0.5)
      UNION ALL SELECT * FROM (SELECT * FROM l WHERE picked = 'common' QUALIFY row_number() OVER (PARTITION BY source ORDER BY {rk(5, 'common', 'doc_id')}) <= 2)""",
    "ply_quota": "SELECT l_suppkey AS game, ceil(count(DISTINCT l_orderkey) / 10.0)::BIGINT AS quota FROM lineitem GROUP BY 1",
    "mistake_quota_select": f"""WITH l AS ({_LINES}), q AS (SELECT game, ceil(count(DISTINCT ply) / 10.0) AS quota FROM l GROUP BY game),
      s AS (SELECT *, CASE WHEN l_discount >= 0.1 THEN 'mistake' WHEN l_quantity > 40 THEN 'large' ELSE 'common' END AS stratum FROM l),
      r AS (SELECT *, count(*) OVER (PARTITION BY game, stratum) AS n, row_number() OVER (PARTITION BY game, stratum ORDER BY {rk(6, 'pick', 'ply', 'l_linenumber')}) AS rn FROM s)
      SELECT game, ply, l_linenumber, stratum FROM r JOIN q USING (game) WHERE stratum = 'mistake' OR (stratum = 'large' AND rn <= ceil(n / 4.0)) OR (stratum = 'common' AND rn <= quota)""",
    "source_groups_fill": f"""WITH g AS (SELECT doc_id, text, CASE WHEN n_chars > 4000 THEN 'long' WHEN lang = 'de' THEN 'german' ELSE 'rest' END AS group_name, CASE WHEN n_chars > 4000 THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS place FROM documents),
      f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY text ORDER BY place, {rk(9, 'fill', 'doc_id')}) = 1)
      SELECT doc_id, group_name FROM f QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY {rk(9, 'fill', 'doc_id')}) <= CASE group_name WHEN 'long' THEN 60 WHEN 'german' THEN 40 ELSE 80 END""",
    "interleave_deadline": "SELECT doc_id, lang, ordinal, (ordinal - 0.5) / CASE lang WHEN 'en' THEN 5.0 ELSE 1.0 END::DOUBLE AS due FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS ordinal FROM documents WHERE lang IN ('en', 'fr', 'de'))",
    "two_stream_interleave": f"""WITH s AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'a' ELSE 'b' END AS stream FROM documents WHERE lang IN ('de', 'fr')),
      o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY doc_id) AS ordinal FROM s),
      p AS (SELECT stream, row_number() OVER (ORDER BY {rk(8, 'slots', 'stream', 'ordinal')}) AS position FROM o),
      k AS (SELECT stream, position, row_number() OVER (PARTITION BY stream ORDER BY position) AS ordinal FROM p)
      SELECT doc_id, stream, position FROM o JOIN k USING (stream, ordinal)""",
    "anchor_mix": f"WITH n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en') SELECT doc_id, lang FROM documents, n WHERE lang IN ('en', 'fr', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {rk(10, 'mix', 'doc_id')}) <= CASE lang WHEN 'en' THEN n WHEN 'fr' THEN round_even(n * 0.13 / 0.8, 0) ELSE round_even(n * 0.07 / 0.8, 0) END",
    "holdout_ids": f"SELECT doc_id FROM documents ORDER BY {rk(12, 'holdout', 'doc_id')} LIMIT 50",
    "shuffle_slices": f"SELECT doc_id, CASE WHEN rn <= 30 THEN 'held' WHEN rn <= 130 THEN 'mix' ELSE 'rest' END AS slice FROM (SELECT doc_id, row_number() OVER (ORDER BY {rk(13, 'slices', 'doc_id')}) AS rn FROM documents)",
    "log_uniform_nodes": f"SELECT c_custkey, round(exp(ln(100.0::DOUBLE) + {u(14, 'nodes', 'c_custkey')} * (ln(100000.0::DOUBLE) - ln(100.0::DOUBLE))))::BIGINT AS nodes FROM customer",
    "uniform_lookahead": f"SELECT p_partkey, CASE WHEN least(8, p_size) >= 2 THEN floor({u(15, 'k', 'p_partkey')} * (least(8, p_size) - 1))::INT + 2 END AS k FROM part",
    "inverse_frequency": f"""WITH f AS (SELECT event_type, count(*) AS f FROM events GROUP BY 1), m AS (SELECT user_id, event_id, event_type, f, count(*) OVER (PARTITION BY user_id, event_type) AS m FROM events JOIN f USING (event_type))
      SELECT user_id, event_id, event_type FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY -ln(greatest({u(16, 'freq', 'event_id')}, 1e-300)) / (1.0::DOUBLE / (f * m)), event_id) = 1""",
    "length_proportional": f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY -ln(greatest({u(18, 'len', 'doc_id')}, 1e-300)) / n_chars::DOUBLE, doc_id) = 1",
    "seeded_pairing": f"SELECT c_custkey, floor({u(20, 'pair', 'c_custkey')} * 8)::INT AS opponent, {u(20, 'side', 'c_custkey')} < 0.5 AS white FROM customer",
    "template_pick": "SELECT ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 7 AS template, count(*) AS n FROM documents GROUP BY 1",
    "nucleus_cut": "WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS UNBOUNDED PRECEDING) - p AS before FROM p) SELECT user_id, event_type, n FROM c WHERE before < 0.9",
    "seeded_split": f"(SELECT doc_id, 'test' AS split FROM documents ORDER BY {rk(23, 'test', 'doc_id')} LIMIT 20) UNION ALL (SELECT doc_id, 'val' AS split FROM documents ORDER BY {rk(24, 'val', 'doc_id')} LIMIT 20)",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {rk(10, 'shuffle', 'doc_id')}) AS place FROM documents",
    "length_grouped_order": f"""WITH s AS (SELECT doc_id, strlen(text) AS size, row_number() OVER (ORDER BY {rk(11, 'rows', 'doc_id')}) AS rn FROM documents),
      p AS (SELECT *, (rn - 1) // 128 AS pool FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY size, rn) AS position FROM p)
      SELECT doc_id, pool, (position - 1) // 8 AS group_id, position, {rk(11, 'groups', 'pool', '(position - 1) // 8')} AS group_key FROM q""",
}
