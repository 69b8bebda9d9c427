"""Queries of prose rewrites, lineages, orders and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prose
from ..operators import lineage
from .common import table, u

# Order of event types, as an order of findings.
ORDER = ["purchase", "signup", "click", "view", "error"]


def _said(spark, d):
    """Texts with side-relative tokens, a mover for each."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    a, b = (F.col("p_partkey") % 64 + 1).cast("string"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 64 + 1).cast("string")
    kind = F.substring(F.lit("PNBRQK"), (F.col("p_partkey") % 6 + 1).cast("int"), F.lit(1))
    text = F.concat(F.lit("the player has <PIECE_M"), kind, F.lit("><SQUARE_"), a, F.lit("><SQUARE_"), b, F.lit(">. <OPPONENT> holds <SQUARE_"), b, F.lit(">."))
    return p.select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("white"), text.alias("text"))


def prose_human(spark, d):
    """STR8: tokens as prose."""
    return _said(spark, d).select("p_partkey", prose.to_human_sides(F.col("text"), F.col("white")).alias("said"))


def prose_absolute(spark, d):
    """STR5: side-relative tokens as absolute ones."""
    return _said(spark, d).select("p_partkey", prose.to_absolute(F.col("text"), F.col("white")).alias("said"))


def prose_relative(spark, d):
    """STR6: back from absolute tokens, with sentence capitals and nothing left over."""
    back = prose.to_relative(prose.to_absolute(F.col("text"), F.col("white")), F.col("white"))
    return _said(spark, d).select("p_partkey", back.alias("said"), F.size(prose.leftovers(back)).alias("left"))


def prose_lines(spark, d):
    """STR5: pairs of squares as files, ranks and diagonals where they name whole ones."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 64).cast("int").alias("a"), F.floor(F.col("p_partkey") / 64 % 64).cast("int").alias("b"))
    text = F.concat(F.lit("<SQUARE_"), (F.col("a") + 1).cast("string"), F.lit(">-<SQUARE_"), (F.col("b") + 1).cast("string"), F.lit(">"))
    kind = F.regexp_extract(prose.to_absolute(text, F.lit(True)), "^<([A-Z]+)_", 1)
    return p.select("a", "b", kind.alias("kind")).distinct()


def _steps(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("event_id", "event_type", "value").alias("s"))
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))


def usable_attempts(spark, d):
    """FLT20: attempts with an evaluation and a valid prefix."""
    made = F.transform("steps", lambda s: F.struct(s["event_id"].alias("event_id"), F.when(s["event_id"] % 3 != 0, s["value"]).alias("evaluation"), (s["event_type"] != "error").alias("valid")))
    good = lineage.usable_attempts(made)
    return _steps(spark, d).select("user_id", F.size(good).alias("n"), F.get(good, F.lit(0))["event_id"].alias("first"))


def source_info(spark, d):
    """PRJ10: a lineage's last step, the chosen child and the history before it."""
    s = _steps(spark, d)
    child = lineage.chosen_child(F.col("steps"), F.lit("purchase"), "event_type")
    earlier = F.transform(F.slice("steps", 1, F.size("steps") - 1), lambda x: x["event_type"])
    history = lineage.history_of(F.lit(None).cast("array<string>"), F.array(F.lit("source")), earlier)
    return s.select("user_id", lineage.last_step(F.col("steps"))["event_id"].alias("last"), child["event_id"].alias("chosen"), F.array_join(history, ",").alias("history"))


def dropped_helpers(spark, d):
    """PRJ11: steps without their helper field."""
    return table(spark, d, "events").select(F.struct("event_id", "event_type", "value").alias("s")).select(F.to_json(lineage.without_helpers(F.col("s"), "value")).alias("step"))


def first_mistakes(spark, d):
    """WIN13: the first event of each user that loses forty or more against the one before."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", "value")
    at = e.withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")))
    return lineage.first_mistake(at, ["user_id"], "event_id", F.col("before"), F.col("value"), 40.0).select("user_id", "event_id")


def capture_orders(spark, d):
    """SRT4: lines of an order as moves, captures by worth."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") % 5 + 1).alias("victim"), F.when(F.col("l_linestatus") == "O", (F.col("l_quantity") % 9).cast("int")).alias("attacker"))
    key = lineage.capture_order(F.col("victim"), F.col("attacker"))
    return li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("l_linenumber").alias("n")))), lambda x: x["n"]), ",").alias("moves"))


def canonical_findings(spark, d):
    """SRT5: findings in the fixed order, the mover's first."""
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 2 == 0).alias("own")).distinct().filter(F.col("event_type").isin(ORDER))
    key = lineage.canonical_order(ORDER, F.col("event_type"), F.col("own"))
    row = F.struct(key.alias("k"), F.concat("event_type", F.when(F.col("own"), "+").otherwise("-")).alias("t"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), ",").alias("found"))


def explored_paths(spark, d):
    """SET3: paths of two iterations, each once."""
    li = table(spark, d, "lineitem")
    turn = lambda c: li.select(F.concat_ws("/", (F.col("l_partkey") % 50).cast("string"), F.col(c)).alias("path"))
    return lineage.explored(turn("l_returnflag"), turn("l_linestatus"))


def kept_prefix(spark, d):
    """STR11: a section's moves cut after the first few."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    moves = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 6 + 1), lambda i: F.concat(F.lit("<PIECE_MP><SQUARE_"), i.cast("string"), F.lit(">"))), " ")
    text = F.concat(F.lit("BEST_MOVE: x\nCRITICAL_LINE: "), moves, F.lit("\nEVALUATION: 0"))
    return p.select("p_partkey", prose.kept_moves(text, (F.col("p_partkey") % 5).cast("int")).alias("text"))


def _logits(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("logit"))


def token_draws(spark, d):
    """SMP22: temperature, top-k, nucleus and a draw."""
    return lineage.draw_token(_logits(spark, d), ["user_id"], "event_type", "logit", 2.5, 4, 0.9, 3)


def greedy_tokens(spark, d):
    """SMP22 at temperature 0."""
    return lineage.draw_token(_logits(spark, d), ["user_id"], "event_type", "logit", 0.0, 4, 0.9, 3)


def two_level_balance(spark, d):
    """SMP17: a coin between changed and unchanged, then classes of equal weight."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.col("value") > 90).alias("changed"))
    return lineage.two_level_choice(e, ["user_id"], "changed", "event_type", 5, "event_id").select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (prose_human, prose_absolute, prose_relative, prose_lines, usable_attempts, source_info, dropped_helpers, first_mistakes, capture_orders, canonical_findings, explored_paths, kept_prefix, token_draws, greedy_tokens, two_level_balance)}

_SQ = "substr('abcdefgh', ({0}) % 8 + 1, 1) || (({0}) // 8 + 1)"
_FLIP = "(CASE WHEN white THEN {0} ELSE xor(({0})::INT, 56) END)"
_T = """t AS (SELECT p_partkey, p_partkey % 2 = 0 AS white, (p_partkey % 64)::INT AS a, ((p_partkey * 7 + p_size) % 64)::INT AS b, ['PAWN', 'KNIGHT', 'BISHOP', 'ROOK', 'QUEEN', 'KING'][p_partkey % 6 + 1] AS kind, substr('PNBRQK', (p_partkey % 6 + 1)::INT, 1) AS k FROM part),
      s AS (SELECT *, """ + _SQ.format(_FLIP.format("a")) + " AS sa, " + _SQ.format(_FLIP.format("b")) + " AS sb, CASE WHEN white THEN 'WHITE' ELSE 'BLACK' END AS own, CASE WHEN white THEN 'BLACK' ELSE 'WHITE' END AS foe FROM t)"
_STEPS = "s AS (SELECT user_id, list({'event_id': event_id, 'event_type': event_type, 'value': value} ORDER BY event_id) AS s FROM events GROUP BY 1)"
_LOGITS = "l AS (SELECT user_id, event_type, count(*)::DOUBLE AS logit FROM events GROUP BY 1, 2)"
_PLACE = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(ORDER)) + " END"
ORACLES = {
    "prose_human": f"WITH {_T} SELECT p_partkey, 'the player has ' || lower(own) || ' ' || lower(kind) || ' ' || sa || '-' || sb || '. ' || upper(foe[1]) || lower(foe[2:]) || ' holds ' || sb || '.' AS said FROM s",
    "prose_absolute": f"WITH {_T} SELECT p_partkey, '<' || own || '> has <' || own || '_' || kind || '><SQUARE_' || upper(sa) || '><SQUARE_' || upper(sb) || '>. <' || foe || '> holds <SQUARE_' || upper(sb) || '>.' AS said FROM s",
    "prose_relative": f"WITH {_T} SELECT p_partkey, 'The player has <PIECE_M' || k || '><SQUARE_' || (a + 1) || '><SQUARE_' || (b + 1) || '>. The opponent holds <SQUARE_' || (b + 1) || '>.' AS said, 0 AS \"left\" FROM s",
    "prose_lines": """WITH p AS (SELECT DISTINCT (p_partkey % 64)::INT AS a, (p_partkey // 64 % 64)::INT AS b FROM part), q AS (SELECT *, b % 8 - a % 8 AS x, b // 8 - a // 8 AS y FROM p)
      SELECT a, b, CASE WHEN x = 0 AND abs(y) = 7 THEN 'FILE' WHEN y = 0 AND abs(x) = 7 THEN 'RANK' WHEN x <> 0 AND abs(x) = abs(y) AND (b % 8 = CASE WHEN x > 0 THEN 7 ELSE 0 END OR b // 8 = CASE WHEN y > 0 THEN 7 ELSE 0 END) THEN 'DIAGONAL' ELSE 'SQUARE' END AS kind FROM q""",
    "usable_attempts": "WITH g AS (SELECT user_id, event_id, event_id % 3 <> 0 AND value IS NOT NULL AND event_type <> 'error' AS ok FROM events) SELECT user_id, count(*) FILTER (ok)::INT AS n, min(event_id) FILTER (ok) AS first FROM g GROUP BY 1",
    "source_info": f"WITH {_STEPS} SELECT user_id, s[-1].event_id AS last, (list_filter(s, lambda x: x.event_type = 'purchase')[1]).event_id AS chosen, array_to_string((['source'] || list_transform(s[:-2], lambda x: x.event_type))[-7:], ',') AS history FROM s",
    "dropped_helpers": "SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS step FROM events",
    "first_mistakes": "WITH e AS (SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - value AS lost FROM events) SELECT user_id, min(event_id) AS event_id FROM e WHERE lost >= 40 GROUP BY 1",
    "capture_orders": "WITH m AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_returnflag <> 'N' THEN l_linenumber % 5 + 1 END AS v, CASE WHEN l_linestatus = 'O' THEN (l_quantity % 9)::INT END AS a FROM lineitem) SELECT l_orderkey, string_agg(n::VARCHAR, ',' ORDER BY a IS NULL, coalesce(a - 10 * coalesce(v, 1), 0), n) AS moves FROM m GROUP BY 1",
    "canonical_findings": f"WITH e AS (SELECT DISTINCT user_id, event_type, event_id % 2 = 0 AS own, {_PLACE} AS k FROM events) SELECT user_id, string_agg(event_type || CASE WHEN own THEN '+' ELSE '-' END, ',' ORDER BY k, own DESC) AS found FROM e WHERE k IS NOT NULL GROUP BY 1",
    "explored_paths": "SELECT concat_ws('/', (l_partkey % 50)::VARCHAR, l_returnflag) AS path FROM lineitem UNION SELECT concat_ws('/', (l_partkey % 50)::VARCHAR, l_linestatus) FROM lineitem",
    "kept_prefix": """WITH m AS (SELECT p_partkey, (p_partkey % 5)::INT AS keep, list_transform(range(1, (p_size % 6 + 2)::BIGINT), lambda i: '<PIECE_MP><SQUARE_' || i || '>') AS m FROM part)
      SELECT p_partkey, 'BEST_MOVE: x' || chr(10) || 'CRITICAL_LINE:' || CASE WHEN keep < len(m) THEN array_to_string(m[1:keep], ' ') ELSE ' ' || array_to_string(m, ' ') END || chr(10) || 'EVALUATION: 0' AS text FROM m""",
    "token_draws": f"""WITH {_LOGITS}, k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY logit DESC) AS k FROM l), e AS (SELECT user_id, event_type, exp((logit - max(logit) OVER (PARTITION BY user_id)) / 2.5) AS e FROM k WHERE k <= 4),
      c AS (SELECT *, sum(e) OVER (PARTITION BY user_id ORDER BY e, event_type DESC ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY user_id) AS low, row_number() OVER (PARTITION BY user_id ORDER BY e DESC, event_type) AS place FROM e),
      r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY -ln(greatest({u(3, 'draw', 'user_id', 'event_type')}, 1e-300)) / e, event_type) AS r FROM c WHERE low > 1 - 0.9 OR place = 1) SELECT user_id, event_type FROM r WHERE r = 1""",
    "greedy_tokens": f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY logit DESC, event_type) AS r FROM l) SELECT user_id, event_type FROM r WHERE r = 1",
    "two_level_balance": f"""WITH e AS (SELECT user_id, event_id, event_type, value > 90 AS changed FROM events), b AS (SELECT *, count(*) FILTER (changed) OVER (PARTITION BY user_id) AS n_changed, count(*) OVER (PARTITION BY user_id) AS n FROM e),
      k AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS m FROM b WHERE changed = CASE WHEN n_changed = 0 THEN false WHEN n_changed = n THEN true ELSE {u(5, 'coin', 'user_id')} < 0.5 END),
      r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY -ln(greatest({u(5, 'class', 'event_id')}, 1e-300)) / (1.0::DOUBLE / m), event_id) AS r FROM k) SELECT user_id, event_id FROM r WHERE r = 1""",
}
