"""Line dedup by content-defined chunks of lines.

A text's lines become hashes.  A chunk ends where a rolling hash over the last two
line hashes is 0 modulo a divisor, so an insertion shifts boundaries only near
itself.  There are two resolutions: ``DIVISOR`` makes chunks of several lines, and
divisor 1, where every line is its own chunk, serves passages too short to hold
two boundaries.  A chunk that stands elsewhere earlier is an anchor: its document
is laid against the chunk's first occurrence, and the match is extended line by
line in both directions.  An extended run of at least ``min_words`` words is removed
after its bytes were compared with the earlier run's.

DataFrame code throughout: chunking is array expressions in the scan, so chunk rows
(hashes and places, no text) are shuffled; they are pre-aggregated by hash.  Anchors
count only inside stretches of repeated lines of ``min_words`` words, since no longer
run can hold them, which spares common short lines.  Documents that many others
match are dealt over several tasks.  Texts move only for runs that are about to go.

Parameter ``min_words`` (50): shorter repeats stay, so that headings, signatures and
other short common lines of clean documents survive; 0 removes every repeat.

Defined cases: null texts stay null, empty ones empty; words are runs of anything
but ASCII white space; very long lines and texts are handled whole; the first
occurrence is the least (doc_id, text hash, line), a null doc_id first, which also
settles ties; exact repeats of a row (same doc_id and text) are one document, whose
lines count once; a text whose lines all go becomes empty; an empty table gives no
row; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt_join, discard, fresh, materialize, maybe_broadcast

#: Divisor of the rolling hash at the coarse resolution, and words of a run that is removed.
DIVISOR, MIN_WORDS = 3, 50
_WORD = r"[^\x20\x09-\x0D]+"


def with_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, key (of id and text) and its lines."""
    return docs.select("doc_id", "text", _key().alias("key"), F.split("text", "\n", -1).alias("lines"))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def _facts() -> Column:
    """Hash and words of each line."""
    return F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(_WORD)).alias("w")))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, key, first_line, n_lines, words, digest of the chunks of both resolutions of every document; no text."""
    number = F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    read = with_lines(docs.filter("text is not null")).select("doc_id", "key", _facts().alias("facts"), number.alias("number"))
    n = F.size("facts")

    def ends(i: Column) -> Column:
        return (i == n - 1) | ((F.get("number", i) + 7 * F.coalesce(F.get("number", i - 1), F.lit(0))) % DIVISOR == 0)

    cut = read.withColumn("cuts", F.filter(F.sequence(F.lit(0), n - 1), ends))
    stop = F.col("cuts")

    def chunk(k: Column) -> Column:
        first = F.when(k == 0, 0).otherwise(F.get(stop, k - 1) + 1)
        part = F.slice("facts", first + 1, F.get(stop, k) - first + 1)
        words = F.aggregate(part, F.lit(0), lambda a, x: a + x["w"])
        return F.struct(first.alias("first_line"), F.size(part).alias("n_lines"), words.alias("words"), F.xxhash64(F.transform(part, lambda x: x["h"])).alias("digest"))

    coarse = F.filter(F.transform(F.sequence(F.lit(0), F.size(stop) - 1), chunk), lambda c: c["n_lines"] > 1)
    fine = F.transform("facts", lambda x, i: F.struct(i.alias("first_line"), F.lit(1).alias("n_lines"), x["w"].alias("words"), x["h"].alias("digest")))
    return cut.select("doc_id", "key", F.explode(F.concat(fine, coarse)).alias("c")).select("doc_id", "key", "c.*")


def anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """key, okey, shift, at: the lines ``at`` of document ``key`` where a chunk begins that stands ``shift`` lines before in ``okey``, its first occurrence."""
    found = materialize(chunks(docs), "chunks")
    place = F.struct("doc_id", "key", "first_line")
    same = ["digest", "n_lines", "words"]
    firsts = found.groupBy(*same).agg(F.min(place).alias("origin"), F.max(place).alias("last")).filter("origin <> last").drop("last")
    firsts = materialize(firsts, "origins")
    again = found.join(maybe_broadcast(firsts, 64), same).distinct()  # exact repeats of a row fall together
    # stretches of consecutive repeated lines, and the words of each
    line = F.col("n_lines") == 1
    order = Window.partitionBy("doc_id", "key").orderBy("first_line", "n_lines")
    number = F.sum(line.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    again = again.withColumn("stretch", F.col("first_line") - number)  # a chunk follows its first line, which has the same value
    total = F.sum(F.when(line, F.col("words"))).over(Window.partitionBy("doc_id", "key", "stretch"))
    later = again.withColumn("total", total).filter((F.col("total") >= min_words) & (place != F.col("origin")))
    pairs = later.select("key", F.col("origin.key").alias("okey"), (F.col("first_line") - F.col("origin.first_line")).alias("shift"), F.col("first_line").alias("at"))
    out = materialize(pairs.groupBy("key", "okey", "shift").agg(F.collect_set("at").alias("at")), "anchors")  # at most a text's lines
    discard(found, firsts)
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key and the line ranges (first_line, n_lines) to remove, verified byte by byte."""
    laid = anchors(docs, min_words)
    used = laid.select("key").union(laid.select("okey")).distinct()
    read = with_lines(docs.filter("text is not null"))
    used = materialize(used, "used")
    sides = read.join(maybe_broadcast(used, 16), "key", "left_semi").select("key", _facts().alias("facts")).dropDuplicates(["key"])
    sides = materialize(sides, "facts")
    here = laid.join(sides, "key")
    there = sides.select(F.col("key").alias("okey"), F.transform("facts", lambda x: x["h"]).alias("other"))
    both = dealt_join(here, there, "okey", "key", counted=laid)
    equal = F.filter(F.transform("facts", lambda x, i: F.struct(i.alias("i"), x["h"].alias("h"), x["w"].alias("w"), F.array_contains("at", i).alias("anchor"))), lambda x: (x["i"] >= F.col("shift")) & (x["h"] == F.get("other", x["i"] - F.col("shift"))))
    rows = both.select("key", "okey", "shift", F.explode(equal).alias("x")).select("key", "okey", "shift", "x.i", "x.w", "x.anchor")
    laid_out = Window.partitionBy("key", "okey", "shift").orderBy("i")
    runs = rows.withColumn("run", F.col("i") - F.row_number().over(laid_out)).groupBy("key", "okey", "shift", "run")
    runs = runs.agg(F.min("i").alias("first_line"), F.count("*").cast("int").alias("n_lines"), F.sum("w").alias("words"), F.max("anchor").alias("anchor"))
    wanted = materialize(runs.filter((F.col("words") >= min_words) & F.col("anchor")).select("key", "okey", "first_line", "n_lines", (F.col("first_line") - F.col("shift")).alias("o_line")), "runs")
    discard(laid, used, sides)
    mine = _texts(docs, wanted.select("key", "first_line", "n_lines"))
    theirs = _texts(docs, wanted.select(F.col("okey").alias("key"), F.col("o_line").alias("first_line"), "n_lines"))
    theirs = theirs.select(F.xxhash64("key", "first_line", "n_lines").alias("where"), F.col("part").alias("origin"))
    both = wanted.withColumn("where", F.xxhash64("okey", "o_line", "n_lines"))
    both = dealt_join(both.join(mine, ["key", "first_line", "n_lines"]), theirs, "where", "key", counted=both)
    checked = both.filter(F.col("part") == F.col("origin")).select("key", "first_line", "n_lines")
    return checked.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first_line", "n_lines"))).alias("ranges"))


def _texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The lines of the named ranges: key, first_line, n_lines, part."""
    grouped = places.groupBy("key").agg(F.collect_set(F.struct("first_line", "n_lines")).alias("ranges"))
    grouped = materialize(grouped, "ranges")
    at = with_lines(docs.filter("text is not null")).join(_small(grouped), "key")
    part = at.select("key", "lines", F.explode("ranges").alias("range"))
    return part.select("key", "range.first_line", "range.n_lines", F.slice("lines", F.col("range.first_line") + 1, F.col("range.n_lines")).alias("part")).dropDuplicates(["key", "first_line", "n_lines"])


def _small(grouped: DataFrame) -> DataFrame:
    """``grouped`` (a row per text with its ``ranges``), broadcast when its measured bytes are few."""
    n, listed = grouped.agg(F.count("*"), F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()
    return maybe_broadcast(grouped, 1, 96 * n + 24 * listed)


def _edited(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """``docs`` with one column more, whose name comes second: the lines that stay (null: all)."""
    runs = materialize(repeated_runs(docs.select("doc_id", "text"), min_words), "removals")
    gone, kept, its = fresh(docs, "__gone"), fresh(docs, "__kept"), fresh(docs, "__text_key")
    r = _small(runs).withColumnsRenamed({"key": its, "ranges": gone})
    at = docs.withColumn(its, F.when(F.col("text").isNotNull(), _key())).join(r, its, "left")
    stays = lambda x, i: ~F.exists(gone, lambda g: (i >= g["first_line"]) & (i < g["first_line"] + g["n_lines"]))
    out = at.withColumn(kept, F.when(F.col(gone).isNotNull(), F.filter(F.split("text", "\n", -1), stays)))
    return out.select(*docs.columns, kept), kept


def _texted(at: DataFrame, docs: DataFrame, kept: str) -> DataFrame:
    """The columns of ``docs`` with ``text``, and ``n_chars`` if there is one, brought up to date."""
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return at.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with repeated runs taken out of ``text``."""
    at, kept = _edited(docs, min_words)
    return _texted(at, docs, kept)


def drop_emptied(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``dedup`` without the documents that lost all their lines."""
    at, kept = _edited(docs, min_words)
    return _texted(at.filter(F.col(kept).isNull() | (F.size(kept) > 0)), docs, kept)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text of every row."""
    at, name = _edited(docs.select("doc_id", "text"), min_words)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    kept = F.col(name)
    return at.select("doc_id", n.alias("n_lines"), F.when(kept.isNull(), 0).otherwise(n - F.size(kept)).alias("n_removed"), F.when(kept.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM d),
f AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS num, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM e),
c AS (SELECT *, coalesce((lag(num + 7 * coalesce(pn, 0)) OVER p % 3 = 0)::INT, 0) AS begins FROM (SELECT *, lag(num) OVER (PARTITION BY doc_id ORDER BY i) AS pn FROM f) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM c),
units AS (SELECT doc_id, i AS pos, 1 AS n, line AS part FROM f
          UNION ALL SELECT doc_id, min(i), count(*), string_agg(line, chr(10) ORDER BY i) FROM k GROUP BY doc_id, chunk HAVING count(*) > 1),
o AS (SELECT *, first_value(doc_id) OVER u AS o_id, first_value(pos) OVER u AS o_pos FROM units WINDOW u AS (PARTITION BY part, n ORDER BY doc_id, pos)),
anchors AS (SELECT DISTINCT doc_id, o_id, pos - o_pos AS shift, pos FROM o WHERE doc_id <> o_id OR pos <> o_pos),
laid AS (SELECT DISTINCT doc_id, o_id, shift FROM anchors),
same AS (SELECT laid.*, a.i, a.w FROM laid JOIN f a USING (doc_id) JOIN f b ON b.doc_id = laid.o_id AND b.i = a.i - laid.shift AND b.line = a.line),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, o_id, shift ORDER BY i) AS run FROM same),
good AS (SELECT r.doc_id, r.o_id, r.shift, r.run FROM runs r LEFT JOIN anchors x ON x.doc_id = r.doc_id AND x.o_id = r.o_id AND x.shift = r.shift AND x.pos = r.i
         GROUP BY ALL HAVING sum(r.w) >= 50 AND count(x.pos) > 0),
gone AS (SELECT DISTINCT doc_id, i FROM runs JOIN good USING (doc_id, o_id, shift, run)),
left_ AS (SELECT f.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY f.i) AS text FROM f ANTI JOIN gone USING (doc_id, i) GROUP BY f.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN 0 ELSE len(string_split(documents.text, chr(10))) END AS n_lines,
       CASE WHEN documents.text IS NULL THEN 0 ELSE len(string_split(documents.text, chr(10))) - coalesce(left_.n, 0) END AS n_removed,
       CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text
FROM documents LEFT JOIN left_ USING (doc_id)
"""
