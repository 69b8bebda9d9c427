"""Packing queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing
from .common import rk, table


def _audit(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", "text", F.md5("text").alias("record_id"))
    held = table(spark, d, "benchmark").select(F.substring(F.lower("text"), 1, 12).alias("key"))
    error = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 100) / 100.0)
    return packing.audited(docs, "doc_id", "record_id", F.substring(F.lower("text"), 1, 12), F.col("n_chars") < 60, held, F.col("text").contains("***"), error, 0.9)


def pack_ledger(spark, d):
    """FLT11, AGG1: first rejection of each row and kept rows, by source."""
    return packing.ledger(_audit(spark, d), "source")


def pack_kept(spark, d):
    """FLT11, SMP12, T13: kept rows with an exact hold-out."""
    kept = _audit(spark, d).filter("reason is null").select("doc_id")
    return packing.with_holdout(kept, 20, 3, "doc_id")


def level_decisions(spark, d):
    """ITR2: decisions over rows of three children, ordered branches."""
    e = table(spark, d, "events").select((F.col("event_id") % 3).alias("k"), F.floor(F.col("event_id") / 3).alias("row"), "event_id", "event_type", "value")
    predicted = F.when(F.col("event_id") % 17 != 0, F.col("value") / 200)
    child = F.struct(F.substring(F.lit("xyz"), (F.col("k") + 1).cast("int"), F.lit(1)).alias("label"), F.col("event_id").cast("string").alias("fen"), predicted.alias("predicted"), F.array(predicted).alias("order"), (F.col("event_id") * 7 % 101 / 200).alias("truth"), (F.col("event_type") != "error").alias("valid"))
    rows = e.groupBy("row").agg(F.collect_list(child).alias("children"), F.min((F.col("event_type") != "error")).alias("sampled")).filter("size(children) = 3")
    truth, inferred = F.col("row") % 50 / 100, F.col("row") % 33 / 100
    out = packing.decide(rows, "children", truth, inferred, F.col("sampled"), F.col("row") % 2 == 0, F.concat(F.lit("line "), (F.col("row") % 4).cast("string")), 0.05, 0.2)
    return out.select("row", "decision.action", "decision.reason", "decision.next", "decision.selected", F.round("decision.new_error", 9).alias("new_error"), F.round("decision.old_error", 9).alias("old_error"))


QUERIES = {f.__name__: f for f in (pack_ledger, pack_kept, level_decisions)}

_AUDIT = """WITH d AS (SELECT doc_id, source, n_chars, text, substr(lower(text), 1, 12) AS key, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents),
e AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate record' WHEN n_chars < 60 THEN 'terminal' WHEN key IN (SELECT substr(lower(text), 1, 12) FROM benchmark) THEN 'validation overlap'
  WHEN contains(text, '***') THEN 'malformed' WHEN doc_id % 11 = 0 THEN 'unparseable evaluation' WHEN (doc_id % 100) / 100.0 >= 0.9 THEN 'evaluation error' END AS early FROM d),
a AS (SELECT *, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY key, early IS NULL ORDER BY doc_id) > 1 THEN 'duplicate position' ELSE early END AS reason FROM e) """
ORACLES = {
    "pack_ledger": _AUDIT + "SELECT source, coalesce(reason, 'kept') AS status, count(*) AS n FROM a GROUP BY 1, 2",
    "pack_kept": _AUDIT + f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {rk(3, 'holdout', 'doc_id')}) <= 20 THEN 'val' ELSE 'train' END AS split FROM a WHERE reason IS NULL",
    "level_decisions": """WITH e AS (SELECT event_id // 3 AS row, event_id % 3 AS k, event_id::VARCHAR AS fen, CASE WHEN event_id % 17 <> 0 THEN value / 200 END AS p, event_id * 7 % 101 / 200 AS t, event_type <> 'error' AS ok FROM events),
      w AS (SELECT row, count(*) AS n, arg_min(fen, k) FILTER (p IS NULL) AS none, arg_max(fen, (p, -k)) AS cf, arg_max(k, (p, -k)) AS ck, max(p) AS cp, arg_max(t, (p, -k)) AS ct, arg_min(t, k) AS bt, arg_min(fen, k) AS bf, arg_max(fen, (abs(p - t), -k)) AS off, bool_and(ok) AS sampled, arg_min(fen, k) FILTER (NOT ok) AS invalid FROM e GROUP BY 1),
      x AS (SELECT *, abs(cp - row % 50 / 100) AS new_error, abs(row % 33 / 100 - row % 50 / 100) AS old_error FROM w WHERE n = 3),
      b AS (SELECT *, CASE WHEN none IS NOT NULL THEN 1 WHEN ck <> 0 AND bt - ct >= 0.05 THEN 2 WHEN new_error >= 0.2 THEN 3 WHEN NOT sampled THEN 4 WHEN row % 2 = 0 THEN 5 ELSE 6 END AS way FROM x)
      SELECT row, CASE way WHEN 5 THEN 'accept' ELSE 'recurse' END AS action, coalesce(['child evaluation remained malformed', 'incorrect inaccurate child ordering', 'inferred evaluation outside truth limit', 'child exhausted clean-prefix attempts'][way], 'line ' || row % 4) AS reason,
        [none, off, bf, invalid, NULL, cf][way] AS next, CASE WHEN way > 1 THEN substr('xyz', (ck + 1)::INT, 1) END AS selected, CASE WHEN way > 1 THEN round(new_error, 9) END AS new_error, CASE WHEN way > 1 THEN round(old_error, 9) END AS old_error FROM b""",
}
