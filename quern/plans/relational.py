"""Joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, joins, ranking, windows
from .common import table


def request_dedup_joinback(spark, d):
    """JN4: prices computed once a part and joined back."""
    req = table(spark, d, "lineitem").select("l_partkey", "l_quantity")

    def compute(keys):
        return keys.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")

    return joins.compute_once(req, ["l_partkey"], compute).groupBy("l_partkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("worth"))


def one_to_one_join(spark, d):
    """JN3: documents and their sizes, paired exactly."""
    docs = table(spark, d, "documents")
    return joins.one_to_one(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.length("text").alias("size")), ["doc_id"]).filter("n_chars <> size").agg(F.count("*").alias("n"))


def positions_games(spark, d):
    """JN2: events joined to per-user totals."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    g = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    return e.join(g, "user_id").select("event_id", (F.col("last") - F.col("event_id")).alias("to_go"))


def best_vs_played(spark, d):
    """JN5: per order the dearest line, line one as played, and the loss."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("move"), F.col("l_extendedprice").alias("score"))
    first = li.groupBy("l_orderkey").agg(F.min("move").alias("played"))
    return joins.best_versus_played(li.join(first, "l_orderkey"), "l_orderkey", "move", "score", "played").select("l_orderkey", "best", "played_item", F.round("loss", 2).alias("loss"))


def cache_subsumption(spark, d):
    """JN16: a result with a larger budget answers a smaller request."""
    p = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).cast("string").alias("fen"), (F.col("l_quantity") * 10).cast("long").alias("nodes"), (F.col("l_linenumber") % 2 + 1).alias("lines"), F.col("l_orderkey").alias("value"))
    cache = p.groupBy("fen", "nodes", "lines").agg(F.max("value").alias("value"))
    req = table(spark, d, "part").select((F.col("p_partkey") % 50).cast("string").alias("fen"), (F.col("p_size") * 10).cast("long").alias("need_nodes"), F.lit(2).alias("need_lines")).distinct()
    return joins.cheapest_answer(req, cache)


def _paths(spark, d):
    """Event types of all runs of one to four events of each user as paths of a group."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    rn = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    run = F.floor((F.col("rn") - 1) / (F.col("user_id") % 4 + 1)).alias("run")
    seq = rn.groupBy("user_id", run).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"]).alias("path"))
    return seq.select((F.col("user_id") % 10).alias("g"), "path").distinct()


def dominated_rows(spark, d):
    """JN17: paths that are no proper sub-list of another."""
    return joins.drop_dominated(_paths(spark, d), ["g"], "path").select("g", F.array_join("path", ",").alias("path"))


def prefix_dominated(spark, d):
    """JN18: paths that are no proper prefix of another."""
    return joins.drop_prefixes(_paths(spark, d), ["g"], "path").select("g", F.array_join("path", ",").alias("path"))


def first_divergence(spark, d):
    """JN12: where the roles of neighbouring conversations first differ."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    nxt = c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("other"))
    return c.join(nxt, "conv_id").select("conv_id", joins.first_difference(F.col("roles"), F.col("other")).alias("place"))


def parent_child(spark, d):
    """JN13: events with the value of the event before, as parent."""
    e = table(spark, d, "events").select("event_id", "value")
    kids = e.select(F.col("event_id").alias("child"), (F.floor(F.col("event_id") / 2)).cast("long").alias("event_id"), F.col("value").alias("child_value"))
    return e.join(kids, "event_id").filter("child <> event_id").groupBy("event_id").agg(F.round(F.max("child_value") - F.first("value"), 6).alias("gain"))


def pairings_chain(spark, d):
    """JN15: nations in a chain."""
    return joins.pairings(table(spark, d, "nation"), "n_name", "chain")


def pairings_round_robin(spark, d):
    return joins.pairings(table(spark, d, "nation"), "n_name", "round_robin")


def pairings_star(spark, d):
    hub = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return joins.pairings(table(spark, d, "nation"), "n_name", "star", hub)


def solution_match(spark, d):
    """JN20: whether a user's last two event types open or close the first five."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    seq = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    return seq.select("user_id", joins.solution_match(F.slice("s", -2, 2), F.slice("s", 1, 5)).alias("hit"))


def aligned_join(spark, d):
    """JN11: samples and generations joined by place and id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.md5(F.col("doc_id").cast("string")).alias("sample_id"), "lang")
    gen = docs.select("place", "sample_id", F.upper("lang").alias("answer"))
    return joins.aligned(docs, gen, "place", "sample_id").groupBy("answer").agg(F.count("*").alias("n"))


def topk_classes(spark, d):
    """AGG2: the forty most frequent first words of pages' titles."""
    p = table(spark, d, "pages")
    return aggregates.top_classes(p, F.lower(F.regexp_extract("html", r"<title>(\w+)", 1)), 40)


def task_accuracy_rollup(spark, d):
    """AGG3: agreement of a length rule with the quality label, per language and in all."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return aggregates.accuracy(docs, "lang", (F.col("n_chars") > 300) == (F.col("quality") == 1))


def benchmark_rates(spark, d):
    """AGG4: rates over one denominator."""
    l = table(spark, d, "labels")  # noqa: E741
    return aggregates.rates(l, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "both": (F.col("quality") == 1) & (F.col("toxic") == 1)})


def match_scores(spark, d):
    """AGG5: points per event type."""
    e = table(spark, d, "events")
    return aggregates.match_scores(e, "event_type", F.when(F.col("value") > 50, 1.0).when(F.col("value") > 25, 0.5).otherwise(0.0))


def elo_grid_fit(spark, d):
    """AGG6: rating of each nation from its customers' balances as results against segments."""
    c = table(spark, d, "customer").select("c_nationkey", (1200 + 100 * F.length("c_mktsegment")).alias("opp"), F.when(F.col("c_acctbal") > 4500, 1.0).when(F.col("c_acctbal") > 0, 0.5).otherwise(0.0).alias("s"))
    return aggregates.elo_grid(c, "c_nationkey", F.col("opp"), F.col("s"), F.lit(1), step=10)


def association_ratio(spark, d):
    """AGG8: event types of users with a high total."""
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    t = e.groupBy("user_id").agg(F.avg("value").alias("m"))
    e = e.join(t, "user_id").filter("value > 80")
    out = aggregates.association(e, ["user_id"], "event_type", F.col("m") > 50)
    return out.withColumn("ratio", F.round("ratio", 9))


def widened_wins(spark, d):
    """AGG21: breakdown of results with the target widened where wins are rare."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus")
    target, _ = aggregates.widened_target(o, F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "O")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(target.cast("long")).alias("hits"))


def nested_histograms(spark, d):
    """AGG11: counts over three groupings."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    return aggregates.nested_counts(o, [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]])


def multilabel_counts(spark, d):
    """AGG12: pages per tag they hold."""
    p = table(spark, d, "pages")
    return aggregates.label_counts(p, F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1)))


def regret_rates(spark, d):
    """AGG14: mean over all and over accepted rows, and the rejected share."""
    li = table(spark, d, "lineitem")
    ok = F.col("l_returnflag") != "R"
    return li.agg(F.round(F.avg("l_discount"), 9).alias("mean_all"), F.round(F.avg(F.when(ok, F.col("l_discount"))), 9).alias("mean_ok"), F.round(aggregates.guarded(F.sum((~ok).cast("long")).cast("double"), F.count("*").cast("double")), 9).alias("rejected"))


def common_steps(spark, d):
    """AGG15, SET5: event types of every weekday."""
    e = table(spark, d, "events").select(F.dayofweek("ts").alias("g"), "event_type")
    return aggregates.in_every_group(e, "g", "event_type")


def ordered_steps(spark, d):
    """AGG15: event types whose last occurrences keep their order for all hours of the day's halves."""
    e = table(spark, d, "events").select((F.hour("ts") >= 12).alias("g"), "event_type", "event_id")
    return aggregates.ordered_in_every_group(e, "g", "event_type", "event_id")


def repetition_count(spark, d):
    """AGG16: how often a user's event type came before."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return windows.repetitions(e, ["user_id"], ["event_type"], "event_id").select("event_id", "repetition")


def feature_percentiles(spark, d):
    """AGG19: percentiles of quantities by return flag."""
    out = aggregates.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", [0.5, 0.75, 0.9, 0.95, 0.99])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


def throughput_rates(spark, d):
    """AGG20: characters a second with a zero guard, and the cut share."""
    docs = table(spark, d, "documents").select("lang", "n_chars", (F.col("doc_id") % 7).alias("seconds"))
    out = aggregates.throughput(docs, ["lang"], "n_chars", "seconds", F.col("n_chars") > 5000)
    return out.withColumn("per_second", F.round("per_second", 6)).withColumn("cut_share", F.round("cut_share", 9))


def byte_length(spark, d):
    """AGG22: bytes of source and text."""
    from ..functions.text import bytes_of

    return table(spark, d, "documents").select("doc_id", bytes_of("text", "source").cast("long").alias("size"))


def clean_prefix(spark, d):
    """WIN3: events of each user before the first error-like value."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return windows.clean_prefix(e, ["user_id"], "event_id", F.col("value") > 90).select("user_id", "event_id")


def earliest_block(spark, d):
    """WIN4: the earlier of two blocking events."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return windows.first_blocks(e, ["user_id"], "event_id", F.col("value") > 95, F.col("event_type") == "purchase")


def candidate_labels(spark, d):
    """WIN5: the three dearest lines of each order, labelled."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return windows.label_candidates(li, ["l_orderkey"], "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", "label")


def inject_best(spark, d):
    """WIN5: the best line put in where all candidates trail it by a twentieth or more."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("wr"))
    cand = li.filter("l_linenumber <= 2")
    best = li.groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "wr"), F.struct("wr", -F.col("l_linenumber"))).alias("b")).select("l_orderkey", "b.l_linenumber", "b.wr")
    return windows.inject_best(cand, best, ["l_orderkey"], "wr", "l_linenumber").select("l_orderkey", "l_linenumber", "injected", "label")


def fill_candidates(spark, d):
    """WIN6: three parts of each supplier, preferred ones first."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount")
    pref = li.filter("l_discount >= 0.1").groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("o"))
    fill = li.groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("o"))
    return windows.fill_to_k(pref, fill, ["l_suppkey"], "l_partkey", "o", 3)


def cumulative_coverage(spark, d):
    """WIN7: nations by customers until half of all are covered."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    c = c.withColumn("all", F.lit(1)).withColumn("share", F.col("n").cast("double"))
    total = table(spark, d, "customer").count()
    return windows.coverage(c, ["all"], "share", total / 2, "c_nationkey").select("c_nationkey", "n")


def relative_breadth(spark, d):
    """WIN8: lines of an order at least as dear as line one, four at most."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return windows.relative_breadth(li, ["l_orderkey"], "l_extendedprice", F.col("l_linenumber") == 1, 4, "l_linenumber").select("l_orderkey", "l_linenumber", "place")


def previous_event(spark, d):
    """WIN9: the event type before, per user."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return windows.previous(e, ["user_id"], "event_id", "event_type").groupBy("event_type", "previous").agg(F.count("*").alias("n"))


def index_shard(spark, d):
    """WIN10: shards by index modulo."""
    return table(spark, d, "orders").groupBy((F.col("o_orderkey") % 7).alias("shard")).agg(F.count("*").alias("n"))


def length_slice(spark, d):
    """WIN12: documents above the ninetieth percentile of rank by length."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    n = docs.count()
    return ranking.global_row_number(docs, ["n_chars", "doc_id"], "rn").filter(F.col("rn") > n * 90 // 100).select("doc_id", "rn")


def worst_first(spark, d):
    """WIN14: per user the event with the least value, then the least id."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"))


def capped_sequences(spark, d):
    """WIN15: at most ten events of each user."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return ranking.top_per_group(e, ["user_id"], [F.col("event_id")], 10)


def sliding_windows_distinct(spark, d):
    """WIN16: windows of two to four events without a repeated type."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    seq = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    return windows.sliding(seq, "s", 2, 4).groupBy("size", F.array_join("window", ">").alias("w")).agg(F.count("*").alias("n"))


def streak_two(spark, d):
    """WIN17: runs of two or more high values."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return windows.streaks(e, ["user_id"], "event_id", F.col("value") > 60).filter("length >= 2")


def history_window(spark, d):
    """PRJ5: up to seven event types before each event."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return windows.history(e, ["user_id"], "event_id", "event_type").select("event_id", F.array_join("history", ",").alias("history"))


def _tree(spark, d):
    """All events as binary trees of 127 nodes each: parent = node div 2."""
    node = (F.col("event_id") % 127 + 1).cast("int")
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 127).alias("tree"), node.alias("node"), F.floor(node / 2).cast("int").alias("parent"), "value")
    ply = F.floor(F.log2(F.col("node").cast("double")) + 1e-9).cast("int")
    return e.withColumn("ply", ply).withColumn("maximise", F.col("ply") % 2 == 0)


def minimax_levels(spark, d):
    """ITR9: values of game trees, deepest level first."""
    return windows.best_leaf(_tree(spark, d), 6).select("tree", "node", F.round("value", 6).alias("value"), "best")


def path_enumeration(spark, d):
    """ITR14: root paths of all trees, a join a level."""
    return windows.root_paths(_tree(spark, d).select("tree", "node", "parent"), 6)


def trie_prefixes(spark, d):
    """ITR15: prefixes of the role chains of conversations."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("s"))
    return windows.prefixes(c, "s").select(F.array_join("prefix", ",").alias("prefix"), "depth", "n")


def top_terms(spark, d):
    """SRT6: the largest changes of each order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("delta"))
    return windows.top_terms(li, ["l_orderkey"], "delta", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


def alternating_merge(spark, d):
    """SRT9: two ranked lists merged by turns."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    rank = F.row_number().over(Window.partitionBy("l_suppkey", (F.col("l_returnflag") == "R")).orderBy("l_orderkey", "l_linenumber"))
    r = li.withColumn("place", rank)
    return windows.alternate(r.filter("l_returnflag = 'R'"), r.filter("l_returnflag <> 'R'"), ["l_suppkey"], "place").select("l_suppkey", "l_orderkey", "l_linenumber", "source", "position")


def dominant_feature(spark, d):
    """SRT12: per order the line largest in units of its threshold."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") * 10.0).alias("thr"))
    return windows.dominant(li, ["l_orderkey"], "l_linenumber", "l_quantity", "thr").withColumn("size", F.round("size", 6))


def top_limit(spark, d):
    """SRT11: the twenty dearest orders."""
    return ranking.top_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


def union_all(spark, d):
    """SET1, SNK10: same-schema parts put together, copies kept."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s).groupBy("nation").agg(F.count("*").alias("n"), F.max("balance").alias("most"))


def set_difference(spark, d):
    """SET4: event types of a user's second half that the first half lacks."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    half = F.floor(F.size("s") / 2).cast("int")
    a, b = F.slice("s", 1, half), F.slice("s", half + 1, F.size("s"))
    return e.select("user_id", F.array_join(F.array_sort(F.array_except(b, a)), ",").alias("new"))


def completeness(spark, d):
    """SET6, SNK9: required keys that are missing."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("missing"))


def ordered_distinct(spark, d):
    """SET9: event types of each user in order of first occurrence."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])).alias("s"))
    return e.select("user_id", F.array_join("s", ",").alias("types"))


QUERIES = {f.__name__: f for f in (request_dedup_joinback, one_to_one_join, positions_games, best_vs_played, cache_subsumption, dominated_rows, prefix_dominated, first_divergence, parent_child, pairings_chain, pairings_round_robin, pairings_star, solution_match, aligned_join, topk_classes, task_accuracy_rollup, benchmark_rates, match_scores, elo_grid_fit, association_ratio, widened_wins, nested_histograms, multilabel_counts, regret_rates, common_steps, ordered_steps, repetition_count, feature_percentiles, throughput_rates, byte_length, clean_prefix, earliest_block, candidate_labels, inject_best, fill_candidates, cumulative_coverage, relative_breadth, previous_event, index_shard, length_slice, worst_first, capped_sequences, sliding_windows_distinct, streak_two, history_window, minimax_levels, path_enumeration, trie_prefixes, top_terms, alternating_merge, dominant_feature, top_limit, union_all, set_difference, completeness, ordered_distinct)}

_TREE = "SELECT event_id // 127 AS tree, (event_id % 127 + 1)::INT AS node, ((event_id % 127 + 1) // 2)::INT AS parent, value, floor(log2((event_id % 127 + 1)::DOUBLE) + 1e-9)::INT AS ply FROM events"
_PATHS = "SELECT DISTINCT user_id % 10 AS g, path FROM (SELECT user_id, list(event_type ORDER BY event_id) AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id, (rn - 1) // (user_id % 4 + 1))"
_TXT = "',' || array_to_string({}, ',') || ','"
ORACLES = {
    "request_dedup_joinback": "SELECT l_partkey, round(sum(l_quantity * p_retailprice), 2) AS worth FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "one_to_one_join": "SELECT count(*) AS n FROM documents WHERE n_chars <> length(text)",
    "positions_games": "SELECT event_id, max(event_id) OVER (PARTITION BY user_id) - event_id AS to_go FROM events",
    "best_vs_played": """WITH b AS (SELECT l_orderkey, l_linenumber AS m, l_extendedprice AS s, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem)
      SELECT l_orderkey, max(m) FILTER (r = 1) AS best, max(m) FILTER (m = p) AS played_item, round(greatest(0.0, max(s) - max(s) FILTER (m = p)), 2) AS loss FROM b GROUP BY 1""",
    "cache_subsumption": """WITH c AS (SELECT (l_partkey % 50)::VARCHAR AS fen, (l_quantity * 10)::BIGINT AS nodes, l_linenumber % 2 + 1 AS lines, max(l_orderkey) AS value FROM lineitem GROUP BY ALL),
      r AS (SELECT DISTINCT (p_partkey % 50)::VARCHAR AS fen, (p_size * 10)::BIGINT AS need_nodes, 2 AS need_lines FROM part)
      SELECT fen, need_nodes, need_lines, nodes, value FROM r LEFT JOIN c ON r.fen = c.fen AND nodes >= need_nodes AND lines >= need_lines QUALIFY row_number() OVER (PARTITION BY r.fen, need_nodes, need_lines ORDER BY nodes DESC NULLS LAST, lines DESC, value DESC) = 1""".replace("SELECT fen, need_nodes, need_lines, nodes", "SELECT r.fen, need_nodes, need_lines, nodes"),
    "dominated_rows": f"WITH p AS ({_PATHS}) SELECT g, array_to_string(path, ',') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.g = p.g AND q.path <> p.path AND contains({_TXT.format('q.path')}, {_TXT.format('p.path')}))",
    "prefix_dominated": f"WITH p AS ({_PATHS}) SELECT g, array_to_string(path, ',') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.g = p.g AND q.path <> p.path AND starts_with({_TXT.format('q.path')}, {_TXT.format('p.path')}))",
    "first_divergence": """WITH c AS (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY 1), j AS (SELECT a.conv_id, a.r AS x, b.r AS y FROM c a JOIN c b ON b.conv_id = a.conv_id + 1)
      SELECT conv_id, (SELECT min(i) FROM range(greatest(len(x), len(y))) t(i) WHERE x[i + 1] IS DISTINCT FROM y[i + 1])::INT AS place FROM j""",
    "parent_child": "SELECT p.event_id, round(max(c.value) - first(p.value), 6) AS gain FROM events p JOIN events c ON c.event_id // 2 = p.event_id AND c.event_id <> p.event_id GROUP BY 1",
    "pairings_chain": "SELECT a, b FROM (SELECT n_name AS a, lead(n_name) OVER (ORDER BY n_name) AS b FROM nation) WHERE b IS NOT NULL",
    "pairings_round_robin": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name",
    "pairings_star": "SELECT (SELECT min(n_name) FROM nation) AS a, n_name AS b FROM nation WHERE n_name <> (SELECT min(n_name) FROM nation)",
    "solution_match": "WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1) SELECT user_id, len(s) >= 2 AND (s[1:5][1:2] = s[-2:] OR s[1:5][-2:] = s[-2:]) AS hit FROM s",
    "aligned_join": "SELECT upper(lang) AS answer, count(*) AS n FROM documents GROUP BY 1",
    "topk_classes": r"SELECT lower(regexp_extract(html, '<title>(\w+)', 1)) AS class, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, class LIMIT 40",
    "task_accuracy_rollup": "SELECT lang, count(*) AS n, avg(((n_chars > 300) = (quality = 1))::INT::DOUBLE) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
    "benchmark_rates": "SELECT count(*) AS n, avg((quality = 1)::INT::DOUBLE) AS good, avg((toxic = 1)::INT::DOUBLE) AS toxic, avg((quality = 1 AND toxic = 1)::INT::DOUBLE) AS both FROM labels",
    "match_scores": "SELECT event_type, count(*) AS games, sum(CASE WHEN value > 50 THEN 1.0 WHEN value > 25 THEN 0.5 ELSE 0.0 END)::DOUBLE AS points, sum(CASE WHEN value > 50 THEN 1.0 WHEN value > 25 THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) AS rate FROM events GROUP BY 1",
    "elo_grid_fit": """WITH r AS (SELECT c_nationkey, (1200 + 100 * length(c_mktsegment))::DOUBLE AS opp, sum(CASE WHEN c_acctbal > 4500 THEN 1.0 WHEN c_acctbal > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS p, count(*) AS g FROM customer GROUP BY 1, 2),
      x AS (SELECT c_nationkey, elo, p, g, 1 / (1 + pow(10.0::DOUBLE, (opp - elo) / 400)) AS e FROM r, range(-200, 3601, 10) t(elo)),
      l AS (SELECT c_nationkey, elo, round(sum(p * ln(e) + (g - p) * ln(1 - e)), 9) AS ll FROM x GROUP BY 1, 2), m AS (SELECT c_nationkey, max(ll) AS top FROM l GROUP BY 1)
      SELECT c_nationkey, min(elo) FILTER (ll = top) AS rating, min(elo) AS ci_low, max(elo) AS ci_high FROM l JOIN m USING (c_nationkey) WHERE ll >= top - 1.92 GROUP BY 1""",
    "association_ratio": """WITH t AS (SELECT user_id, avg(value) > 50 AS t FROM events GROUP BY 1), b AS (SELECT DISTINCT user_id, event_type, t FROM events JOIN t USING (user_id) WHERE value > 80),
      n AS (SELECT count(*) FILTER (t) AS T, count(*) FILTER (NOT t) AS N FROM (SELECT DISTINCT user_id, t FROM b)), c AS (SELECT event_type, count(*) FILTER (t) AS in_target, count(*) FILTER (NOT t) AS in_rest FROM b GROUP BY 1)
      SELECT event_type, in_target, in_rest, round(((in_target + 0.5) / (n.T + 1))::DOUBLE / ((in_rest + 0.5) / (n.N + 1)), 9) AS ratio FROM c, n WHERE in_target >= 5""".replace("AS T,", "AS tt,").replace("AS N FROM", "AS nn FROM").replace("n.T", "n.tt").replace("n.N", "n.nn"),
    "widened_wins": "WITH r AS (SELECT avg((o_orderstatus = 'P')::INT) AS r FROM orders) SELECT o_orderpriority, count(*) AS n, sum((o_orderstatus = 'P' OR (r < 0.15 AND o_orderstatus = 'O'))::INT) AS hits FROM orders, r GROUP BY 1",
    "nested_histograms": "SELECT o_orderstatus, o_orderpriority, CASE grouping(o_orderstatus, o_orderpriority) WHEN 1 THEN 'o_orderstatus' WHEN 2 THEN 'o_orderpriority' ELSE 'o_orderstatus+o_orderpriority' END AS grouped, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))",
    "multilabel_counts": "SELECT label, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1))) AS label FROM pages) GROUP BY 1",
    "regret_rates": "SELECT round(avg(l_discount), 9) AS mean_all, round(avg(l_discount) FILTER (l_returnflag <> 'R'), 9) AS mean_ok, round(count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*), 9) AS rejected FROM lineitem",
    "common_steps": "SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT dayofweek(ts)) = (SELECT count(DISTINCT dayofweek(ts)) FROM events)",
    "ordered_steps": "WITH l AS (SELECT hour(ts) >= 12 AS g, event_type, max(event_id) AS a FROM events GROUP BY 1, 2) SELECT x.event_type AS first, y.event_type AS second FROM l x JOIN l y ON x.g = y.g AND x.event_type <> y.event_type GROUP BY 1, 2 HAVING bool_and(x.a < y.a)",
    "repetition_count": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS repetition FROM events",
    "feature_percentiles": "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.95) AS p95, quantile_cont(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1",
    "throughput_rates": "SELECT lang, count(*) AS n, round(coalesce(sum(n_chars)::DOUBLE / nullif(sum(doc_id % 7), 0), 0), 6) AS per_second, round(sum((n_chars > 5000)::INT)::DOUBLE / count(*), 9) AS cut_share FROM documents GROUP BY 1",
    "byte_length": "SELECT doc_id, (strlen(text) + strlen(source))::BIGINT AS size FROM documents",
    "clean_prefix": "SELECT user_id, event_id FROM (SELECT user_id, event_id, min(event_id) FILTER (value > 90) OVER (PARTITION BY user_id) AS cut FROM events) WHERE cut IS NULL OR event_id < cut",
    "earliest_block": "WITH b AS (SELECT user_id, min(event_id) FILTER (value > 95) AS a, min(event_id) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1) SELECT user_id, least(a, b) AS block_at, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL OR a <= b THEN 'one' ELSE 'other' END AS block_by FROM b",
    "candidate_labels": "SELECT l_orderkey, l_linenumber, 'xyz'[row_number() OVER w] AS label FROM lineitem QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)".replace(" QUALIFY row_number() OVER w <= 3 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)", " WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) QUALIFY row_number() OVER w <= 3"),
    "inject_best": """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS wr FROM lineitem), b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY wr DESC, l_linenumber) = 1),
      c AS (SELECT *, false AS injected FROM l WHERE l_linenumber <= 2), t AS (SELECT l_orderkey, max(wr) AS top FROM c GROUP BY 1),
      x AS (SELECT * FROM c UNION ALL SELECT b.*, true FROM b JOIN t USING (l_orderkey) WHERE wr - top >= 0.05), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY wr DESC, l_linenumber) AS p FROM x)
      SELECT l_orderkey, l_linenumber, injected, 'xyz'[p] AS label FROM r WHERE p <= 3""",
    "fill_candidates": """WITH p AS (SELECT l_suppkey, l_partkey, min(l_quantity) AS o, 0 AS t FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1, 2 UNION ALL SELECT l_suppkey, l_partkey, min(l_quantity), 1 FROM lineitem GROUP BY 1, 2),
      d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY t, o) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY t, o, l_partkey) AS place FROM d) SELECT l_suppkey, l_partkey, place FROM r WHERE place <= 3""",
    "cumulative_coverage": "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, c_nationkey ROWS UNBOUNDED PRECEDING) - n AS before FROM c) SELECT c_nationkey, n FROM s WHERE before < (SELECT count(*) / 2 FROM customer)",
    "relative_breadth": "WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, max(l_extendedprice) FILTER (l_linenumber = 1) OVER (PARTITION BY l_orderkey) AS lv, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem) SELECT l_orderkey, l_linenumber, place FROM r WHERE l_extendedprice >= lv AND place <= 4",
    "previous_event": "WITH p AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT event_type, previous, count(*) AS n FROM p GROUP BY 1, 2",
    "index_shard": "SELECT o_orderkey % 7 AS shard, count(*) AS n FROM orders GROUP BY 1",
    "length_slice": "SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn > (SELECT count(*) * 90 // 100 FROM documents)",
    "worst_first": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1",
    "capped_sequences": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10",
    "sliding_windows_distinct": """WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1), z AS (SELECT s, size, unnest(range(1, len(s) - size + 2)) AS i FROM s, range(2, 5) t(size)),
      w AS (SELECT size, s[i:i + size - 1] AS w FROM z) SELECT size, array_to_string(w, '>') AS w, count(*) AS n FROM w WHERE len(list_distinct(w)) = size GROUP BY 1, 2""",
    "streak_two": "WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), q AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r WHERE value > 60) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM q GROUP BY user_id, run HAVING count(*) >= 2",
    "history_window": "SELECT event_id, coalesce(string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), '') AS history FROM events",
    "minimax_levels": f"""WITH RECURSIVE t AS ({_TREE}), v(tree, node, parent, ply, value, best, lvl) AS (SELECT tree, node, parent, ply, value, NULL::INT, 6 FROM t WHERE ply = 6
      UNION ALL SELECT p.tree, p.node, p.parent, p.ply, CASE WHEN count(c.node) = 0 THEN p.value WHEN p.ply % 2 = 0 THEN max(c.value) ELSE min(c.value) END, CASE WHEN p.ply % 2 = 0 THEN arg_max(c.node, (c.value, -c.node)) ELSE arg_min(c.node, (c.value, c.node)) END, p.ply
      FROM t p JOIN (SELECT max(lvl) AS lvl FROM v) l ON p.ply = l.lvl - 1 LEFT JOIN v c ON p.tree = c.tree AND p.node = c.parent GROUP BY p.tree, p.node, p.parent, p.ply, p.value) SELECT tree, node, round(value, 6) AS value, best FROM v""",
    "path_enumeration": f"WITH RECURSIVE t AS ({_TREE}), p(tree, node, path, depth) AS (SELECT tree, node, node::VARCHAR, 0 FROM t WHERE node = 1 UNION ALL SELECT t.tree, t.node, p.path || '/' || t.node, depth + 1 FROM p JOIN t ON t.tree = p.tree AND t.parent = p.node) SELECT tree, node, path, depth FROM p",
    "trie_prefixes": "WITH c AS (SELECT list(role ORDER BY turn, role) AS s FROM conversations GROUP BY conv_id) SELECT array_to_string(s[1:k], ',') AS prefix, k::INT AS depth, count(*) AS n FROM c, range(1, 200) t(k) WHERE k <= len(s) GROUP BY 1, 2",
    "top_terms": "WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS delta, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25) DESC, l_linenumber) AS place FROM lineitem) SELECT l_orderkey, l_linenumber, place FROM r WHERE place <= 3 AND (abs(delta) >= 8 OR place = 1)",
    "alternating_merge": """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS source, row_number() OVER (PARTITION BY l_suppkey, l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem),
      s AS (SELECT *, CASE WHEN source = 'a' AND k <= 3 THEN [0, 1, 3][k] WHEN source = 'b' AND k <= 3 THEN [2, 4, 5][k] WHEN source = 'a' THEN k + 6 ELSE k + 1000006 END AS slot FROM r) SELECT l_suppkey, l_orderkey, l_linenumber, source, row_number() OVER (PARTITION BY l_suppkey ORDER BY slot) AS position FROM s""",
    "dominant_feature": "WITH s AS (SELECT l_orderkey, l_linenumber, abs(l_quantity) / (l_linenumber * 10.0) AS size FROM lineitem) SELECT l_orderkey, arg_max(l_linenumber, (size, l_linenumber)) AS dominant, round(max(size), 6) AS size FROM s GROUP BY 1 HAVING max(size) >= 1",
    "top_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "union_all": "SELECT nation, count(*) AS n, max(balance) AS most FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1",
    "set_difference": "WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(s[len(s) // 2 + 1:]), lambda x: NOT list_contains(s[1:len(s) // 2], x))), ',') AS new FROM s",
    "completeness": "SELECT count(*) AS missing FROM documents ANTI JOIN labels USING (doc_id)",
    "ordered_distinct": "WITH f AS (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY a) AS types FROM f GROUP BY 1",
}
