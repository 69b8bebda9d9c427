"""Text, evaluation and grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evals, text
from ..operators import aggregates, grading
from .common import table

_ANSWERS = [  # id, answer, truth, grader, whether it is right
    (1, "Think.\n\n<SQUARE_A1><PIECE_WP>2", "x\n\n<PIECE_WP><SQUARE_A1><PIECE_WP>", "multiset", True),
    (2, "<PIECE_WP>2", "<PIECE_WP>", "multiset", False),
    (3, "<SQUARE_9><PIECE_MK>", "<SQUARE_9><PIECE_MK>", "anchored", True),
    (4, "<PIECE_MK><SQUARE_9>", "<SQUARE_9><PIECE_MK>", "anchored", False),
    (5, "a\n\nyes ", "b\n\nyes", "exact", True),
    (6, "a\n\nno", "b\n\nyes", "exact", False),
    (7, "white\n<PIECE_WP>8<PIECE_WK>\nblack\n<PIECE_BK>", "white\n<PIECE_WK><PIECE_WP>8\nblack\n<PIECE_BK>", "sectioned", True),
    (8, "white\n<PIECE_BK>\nblack\n<PIECE_WK>", "white\n<PIECE_WK>\nblack\n<PIECE_BK>", "sectioned", False),
    (9, "<PIECE_MN><SQUARE_7> a,b", "<PIECE_MN><SQUARE_7> b,a", "moves", True),
    (10, "<PIECE_MN><SQUARE_7> a,a", "<PIECE_MN><SQUARE_7> a", "moves", False),
    (11, "<SQUARE_7> <PIECE_MP><SQUARE_2><PIECE_MK><SQUARE_3> <PIECE_OQ><SQUARE_9>", "<SQUARE_7> <PIECE_MK><SQUARE_3><PIECE_MP><SQUARE_2> <PIECE_OQ><SQUARE_9>", "sides", True),
    (12, "<SQUARE_7> <PIECE_OQ><SQUARE_9> <PIECE_MP><SQUARE_2>", "<SQUARE_7> <PIECE_MP><SQUARE_2> <PIECE_OQ><SQUARE_9>", "sides", False),
    (13, "nothing that is asked", "<PIECE_WP>", "multiset", False),
]


def token_grades(spark, d):
    """Graders on inline answers: multiset, anchored, exact, sectioned, move list, two sides."""
    df = spark.createDataFrame(_ANSWERS, "id int, pred string, gold string, kind string, right boolean")
    out = F.lit(None).cast("boolean")
    for name, fn in grading.GRADERS.items():
        out = F.when(F.col("kind") == name, fn(F.col("pred"), F.col("gold"))).otherwise(out)
    return df.select("id", out.alias("correct"))


def token_multiset(spark, d):
    """AGG17: tag multisets of pages, with the number of each tag's total."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[^>]*>"), F.lit(1))  # without the text between, whose digits are no counts
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("<"), F.array_join(tags, "><"), F.lit(">")).alias("t"))
    m = p.select("page_id", F.explode(aggregates.multiset(F.col("t"), r"<([a-z0-9]+)>(\d*)")).alias("m"))
    return m.groupBy("m.token").agg(F.count("*").alias("pages"), F.max("m.n").alias("most"))


def section_map(spark, d):
    """STR1: sections of texts made of page titles; the last of repeated sections wins."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("t"))
    made = F.concat(F.lit("ANALYSIS: "), F.col("t"), F.lit("\nmore\nBEST_MOVE: e2e4\nEVALUATION: "), F.col("page_id").cast("string"), F.lit("\nBEST_MOVE: d2d4\n"))
    m = text.section_map(made)
    return p.select("page_id", F.element_at(m, "ANALYSIS").alias("analysis"), F.element_at(m, "BEST_MOVE").alias("best"), F.element_at(m, "EVALUATION").alias("evaluation"), F.try_element_at(m, F.lit("CRITICAL_LINE")).alias("line"))


def section_replace(spark, d):
    """STR12: one section's body replaced."""
    p = table(spark, d, "pages").select("page_id")
    made = F.concat(F.lit("ANALYSIS: a\nEVALUATION: "), F.col("page_id").cast("string"), F.lit("\nBEST_MOVE: e2e4\n"))
    return p.select("page_id", text.replace_section(made, "EVALUATION", F.lit("+0.50")).alias("text"))


def final_answer(spark, d):
    """STR2: what follows the last blank line; here after the first line break becomes one."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "^([^\n]*)\n", "$1\n\n").alias("t"))
    return docs.select("doc_id", F.md5(text.final_answer(F.col("t"))).alias("answer"))


def after_tag(spark, d):
    """STR3: text after the first closing nav tag."""
    return table(spark, d, "pages").select("page_id", F.md5(text.after_tag(F.col("html"), "</nav>")).alias("rest"))


def oxford_join(spark, d):
    """STR4: the nations of a region in prose."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("s"))
    return n.select("n_regionkey", text.oxford(F.col("s")).alias("prose"), text.oxford(F.slice("s", 1, 2), "or").alias("two"))


def count_suffix(spark, d):
    """STR13: tokens with count suffixes."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    one = e.select("user_id", "event_type", text.with_count(F.concat(F.lit("<"), "event_type", F.lit(">")), F.col("n")).alias("t"))
    return one.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "t"))), lambda x: x["t"]), "").alias("tag"))


def collate(spark, d):
    """STR18, STR19: ids of constant length with attention and label masks."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    return c.select("conv_id", "turn", "role", F.md5(F.array_join(text.pad_right(F.col("ids"), 16, -1), ",")).alias("ids"), F.array_join(text.mask(F.col("ids"), 16), "").alias("mask"), F.md5(F.array_join(text.label_mask(F.col("ids"), F.lit(3)), ",")).alias("labels"))


def chat_instance(spark, d):
    """D10, PRJ6: the last user turn and the answer to it, with up to seven earlier roles."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = c.select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("prompt"), F.collect_list("role").over(w.rowsBetween(-8, -2)).alias("history"))
    return at.filter("role = 'assistant' and before = 'user'").select("conv_id", "turn", F.array_join("history", ",").alias("history"), F.md5("prompt").alias("prompt"), F.md5("text").alias("response"))


def aliased_columns(spark, d):
    """PRJ7: the first non-blank of several columns, and a scalar as a list."""
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.lit(None)).alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("b"), F.lower("n_name").alias("c"))
    return n.select("n_nationkey", text.first_of(F.col("a"), F.col("b"), F.col("c")).alias("name"), F.size(text.as_list(F.concat_ws("  ", "a", "b", "c"))).alias("words"))


def winrates(spark, d):
    """MTH1, MTH2: win rate and win percent of balances as centipawns."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return c.select("c_custkey", F.round(evals.win_rate(F.col("c_acctbal")), 9).alias("rate"), F.round(evals.win_percent(F.col("c_acctbal")), 6).alias("percent"))


def expected_scores(spark, d):
    """MTH3: expected score between pairs of part prices."""
    p = table(spark, d, "part").select("p_partkey", F.round(aggregates.expected_score(F.col("p_retailprice"), F.lit(1500.0)), 9).alias("e"))
    return p


def verdict_bands(spark, d):
    """STR20, STR21: phrase of a value, and a value of the phrase."""
    c = table(spark, d, "customer").select("c_custkey", evals.verdict(F.col("c_acctbal") / 1500, F.col("c_custkey") % 50 == 0).alias("phrase"))
    return c.select("c_custkey", "phrase", F.coalesce(evals.verdict_value(F.col("phrase")), F.lit(0.0)).alias("value"))


def integer_math(spark, d):
    """MTH4, MTH5: truncating division and phase interpolation."""
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 129).cast("long").alias("phase"), (F.col("p_size") * 7 - 150).cast("long").alias("mg"), (40 - F.col("p_size") * 3).cast("long").alias("eg"))
    return p.select("p_partkey", evals.truncating_div(F.col("mg"), F.lit(4)).alias("q"), evals.phase_value(F.col("mg"), F.col("eg"), F.col("phase")).alias("v"))


def square_math(spark, d):
    """MTH6, MTH8, MTH7: mirrored squares, king distance, bit counts."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 64).cast("int").alias("a"), (F.col("p_size") % 64).cast("int").alias("b"))
    return p.select("p_partkey", evals.mirror(F.col("a")).alias("mirror"), evals.distance(F.col("a"), F.col("b")).cast("int").alias("distance"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"))


def parsed_evaluations(spark, d):
    """EVP1, EVP4: evaluation strings made, then parsed again."""
    c = table(spark, d, "customer").select("c_custkey", F.round("c_acctbal").cast("long").alias("cp"))
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Black is better by "), F.abs("cp").cast("string"))).when(F.col("c_custkey") % 7 == 0, "White mates in 3").otherwise(evals.show_evaluation(F.col("cp")))
    p = c.select("c_custkey", line.alias("line")).withColumn("p", evals.parse_evaluation(F.col("line")))
    return p.select("c_custkey", "line", "p.kind", "p.pawns", "p.method")


def reanchored(spark, d):
    """STR7: statements about parts, turned to the other side."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("The player has <PIECE_MQ> on <SQUARE_"), (F.col("p_partkey") % 64 + 1).cast("string"), F.lit(">, the opponent <PIECE_OK>.")).alias("t"))
    return p.select("p_partkey", text.reanchor(F.col("t")).alias("turned"), (text.reanchor(text.reanchor(F.col("t"))) == F.col("t")).alias("again"))


def polymorphic_rows(spark, d):
    """SRC6, PRJ8: rows told apart by their form."""
    from ..sources import files

    lines = ['["s", ["m"], "e"]', '["s", ["m"], "e", ["x", "y"], "f"]', '["s", [], "e", {"games": [{"white": "a", "black": "b", "result": "*", "moves": ["e2e4"]}]}]', '{"start_fen": "s", "moves": ["m"], "fen": "e"}', "torn ["]
    rows = files.decode_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    return rows.select("start_fen", "fen", F.array_join("moves", ",").alias("moves"), F.array_join("ahead_moves", ",").alias("ahead"), "ahead_fen", F.coalesce(F.size("games"), F.lit(0)).alias("games"))


def lookup_crc(spark, d):
    """HSH6: crc32 seeds."""
    return table(spark, d, "documents").select("doc_id", F.crc32(F.col("doc_id").cast("string")).alias("crc"))


def row_digests(spark, d):
    """HSH3: SHA-256 of rows as canonical text."""
    return table(spark, d, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), 256).alias("digest"))


def blake_digests(spark, d):
    """HSH1: blake2b digests of the sources."""
    from ..functions.hashing import with_blake2

    return with_blake2(table(spark, d, "documents").select("source").distinct(), "source")


QUERIES = {f.__name__: f for f in (token_grades, token_multiset, section_map, section_replace, final_answer, after_tag, oxford_join, count_suffix, collate, chat_instance, aliased_columns, winrates, expected_scores, verdict_bands, integer_math, square_math, parsed_evaluations, reanchored, polymorphic_rows, lookup_crc, row_digests, blake_digests)}

_TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
_IDS = "list_transform(string_split(text, ' '), lambda w: length(w))"
ORACLES = {
    "token_grades": f"SELECT * FROM (VALUES {', '.join(f'({k}, {str(right).upper()})' for k, _, _, _, right in _ANSWERS)}) t(id, correct)",
    "token_multiset": r"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[^>]*>', 1)) AS token FROM pages), m AS (SELECT page_id, token, count(*) AS n FROM t GROUP BY 1, 2) SELECT token, count(*) AS pages, max(n) AS most FROM m GROUP BY 1",
    "section_map": f"SELECT page_id, trim({_TITLE} || chr(10) || 'more', ' ' || chr(10) || chr(9)) AS analysis, 'd2d4' AS best, page_id::VARCHAR AS evaluation, NULL::VARCHAR AS line FROM pages",
    "section_replace": "SELECT page_id, 'ANALYSIS: a' || chr(10) || 'EVALUATION: +0.50' || chr(10) || 'BEST_MOVE: e2e4' || chr(10) AS text FROM pages",
    "final_answer": "SELECT doc_id, md5(trim(string_split(regexp_replace(text, '^([^\n]*)\n', '\\1' || chr(10) || chr(10)), chr(10) || chr(10))[-1], ' ')) AS answer FROM documents",
    "after_tag": "SELECT page_id, md5(trim(CASE WHEN contains(html, '</nav>') THEN substr(html, instr(html, '</nav>') + 6) ELSE html END, ' ')) AS rest FROM pages",
    "oxford_join": "WITH s AS (SELECT n_regionkey, list_sort(list(n_name)) AS s FROM nation GROUP BY 1) SELECT n_regionkey, array_to_string(s[:-2], ', ') || ', and ' || s[-1] AS prose, s[1] || ' or ' || s[2] AS two FROM s",
    "count_suffix": "WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg('<' || event_type || '>' || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY event_type) AS tag FROM e GROUP BY 1",
    "collate": f"WITH c AS (SELECT conv_id, turn, role, {_IDS} AS ids FROM conversations) SELECT conv_id, turn, role, md5(array_to_string(ids[1:16] || list_transform(range(greatest(16 - len(ids), 0)), lambda x: -1), ',')) AS ids, repeat('1', least(len(ids), 16)::INT) || repeat('0', greatest(16 - len(ids), 0)::INT) AS mask, md5(array_to_string(list_transform(range(least(3, len(ids))), lambda x: -100) || ids[4:], ',')) AS labels FROM c",
    "chat_instance": "WITH c AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS prompt, list(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT conv_id, turn, coalesce(array_to_string(h, ','), '') AS history, md5(prompt) AS prompt, md5(text) AS response FROM c WHERE role = 'assistant' AND before = 'user'",
    "aliased_columns": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name, (len(string_split(n_name, ' ')) * (1 + (n_nationkey % 2 = 0)::INT))::INT AS words FROM nation",
    "winrates": "SELECT c_custkey, round(1 / (1 + exp(greatest(-60.0, least(60.0, -0.00368208 * c_acctbal)))), 9) AS rate, round(50 + 50 * (2 / (1 + exp(-0.00368208 * greatest(-1500.0, least(1500.0, c_acctbal)))) - 1), 6) AS percent FROM customer",
    "expected_scores": "SELECT p_partkey, round(1 / (1 + pow(10.0::DOUBLE, (1500.0 - p_retailprice) / 400)), 9) AS e FROM part",
    "verdict_bands": """WITH b(phrase, low, high) AS (VALUES ('slightly better', 0.1, 0.3), ('slightly better-to-better', 0.3, 0.6), ('better', 0.6, 1.0), ('better-to-much better', 1.0, 1.5), ('much better', 1.5, 2.5), ('much better-to-winning', 2.5, 4.0), ('winning', 4.0, NULL)),
      v AS (SELECT c_custkey, c_acctbal / 1500 AS p, c_custkey % 50 = 0 AS mate FROM customer)
      SELECT c_custkey, CASE WHEN p >= 0 THEN 'white' ELSE 'black' END || ' is ' || b.phrase AS phrase, CASE WHEN b.phrase IS NULL THEN 0.0 ELSE CASE WHEN p >= 0 THEN 1 ELSE -1 END * CASE WHEN high IS NULL THEN 5 ELSE (low + high) / 2 END END::DOUBLE AS value
      FROM v LEFT JOIN b ON CASE WHEN mate THEN high IS NULL ELSE abs(p) >= low AND (high IS NULL OR abs(p) < high) END""",
    "integer_math": "SELECT p_partkey, (p_size * 7 - 150)::BIGINT // 4 AS q, ((p_size * 7 - 150) * (p_partkey % 129) + (40 - p_size * 3) * (128 - p_partkey % 129))::BIGINT // 128 AS v FROM part",
    "square_math": "WITH s AS (SELECT p_partkey, (p_partkey % 64)::INT AS a, (p_size % 64)::INT AS b FROM part) SELECT p_partkey, xor(a, 56) AS mirror, greatest(abs((a & 7) - (b & 7)), abs((a >> 3) - (b >> 3)))::INT AS distance, bit_count(xor(a, b))::INT AS bits FROM s",
    "parsed_evaluations": """WITH c AS (SELECT c_custkey, round(c_acctbal)::BIGINT AS cp FROM customer),
      l AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'Black is better by ' || abs(cp) WHEN c_custkey % 7 = 0 THEN 'White mates in 3' ELSE printf('%+.2f', cp / 100.0) END AS line FROM c)
      SELECT c_custkey, line, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 = 0 THEN 'mate' ELSE 'number' END AS kind,
        CASE WHEN c_custkey % 3 = 0 THEN -abs(cp)::DOUBLE WHEN c_custkey % 7 = 0 THEN 100.0 ELSE line::DOUBLE END AS pawns, CASE WHEN c_custkey % 3 = 0 THEN 'black' WHEN c_custkey % 7 = 0 THEN 'white' ELSE 'default' END AS method FROM l""",
    "reanchored": "SELECT p_partkey, 'The opponent has <PIECE_OQ> on <SQUARE_' || (xor((p_partkey % 64)::INT, 56) + 1) || '>, the player <PIECE_MK>.' AS turned, true AS again FROM part",
    "polymorphic_rows": "SELECT * FROM (VALUES ('s', 'e', 'm', NULL, NULL, 0), ('s', 'e', 'm', 'x,y', 'f', 0), ('s', 'e', '', NULL, NULL, 1), ('s', 'e', 'm', NULL, NULL, 0)) t(start_fen, fen, moves, ahead, ahead_fen, games)",
    "row_digests": "SELECT n_nationkey, sha256(concat_ws('|', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS digest FROM nation",
}
