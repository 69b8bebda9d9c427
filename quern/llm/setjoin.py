"""Exact n-gram Jaccard join by a partitioned universe.

Every document becomes the set of its word shingles (64-bit hashes).  Sizes are
cut into bands so that linked sets lie in one band or in neighbours.  A band's
scheme splits the universe of hashes into contiguous ranges (segments).  Two
sets within the threshold differ in at most ``H`` elements, so by the pigeonhole
principle, with segment allowances v_i that sum (v_i + 1) to more than H, some
segment differs in at most v_i elements: v = 0 is indexed by the segment's subset, v = 1 by the
subset and all its one-deletion neighbours.  Costs decide the allowances of a
band.  Sparse segments (none or one element) would collide between strangers;
the scheme has E spare segments, and a set with at most E sparse ones leaves
them out, because a linked pair still shares a dense one; a set with more
indexes them all.

Candidates come from index buckets: each bucket's smallest doc_id is its leader.
A set also has a parity sketch, a bit per element or more: bit k tells whether an
odd number of elements falls on k.  Bits in which two sketches differ never
outnumber the elements in which the sets do, so a sketch pair that differs too
much rules a link out before any set is attached.  What is left is verified on
the whole sets, one leader for each member first, then the pairs of classes that
are not joined yet.

Members of a bucket that are not joined yet may still link with each other.  The
symmetric difference is a metric, so a member that lies farther from the leader than
two links reach can only meet others that the leader does not link with.  The sets
left in buckets of several classes meet by a prefix join over their elements: those
that stand in one class only come first, then the rarer ones; length and position
bounds and the counts of unshared elements cut it, sketches and the whole sets
decide.  Equal sets are collapsed beforehand, and again within a task before anything
is shuffled.  Rows of a hot leader are dealt over several tasks.

Defined cases: null or wordless texts have an empty set, n_shingles 0, and link
with nothing; a text of fewer words than the width is one shingle of them all;
very long texts are read in blocks and enter whole; rows that repeat a doc_id each
give a row; a null doc_id links with nothing and keeps a null component; ties do
not arise, the smallest doc_id names a component; an empty table gives no row;
further columns, whatever their names, are not read.  Equal hashes are taken for
equal shingles and equal 64-bit fingerprints for equal sets: words, shingles and
sets pass non-linear mixers, so for texts that were not made against these very
functions the chance is 2**-64 a pair.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .shared import dealt_join, discard, id_text, mapped, materialize, maybe_broadcast

#: Sets of a task that it remembers to leave out their exact copies.
SEEN = 200_000
#: What one expected meeting of two strangers in a bucket weighs against an index row.
MEETING = 400.0
#: Chance, for costs only, that a shingle of one text stands in a stranger.
COMMON = 1e-3


def set_of(hashes: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text from its word hashes (``whole``) and the
    shingle hashes that begin in it (``hashes``)."""
    if len(whole) == 0:
        return np.zeros(0, np.uint64)
    if len(whole) < width:
        return scan.shingle_hashes(whole, len(whole))
    return np.unique(hashes)


def sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of every row of a batch."""
    base = 0
    for part in scan.batches(batch, "text", 4 << 20):
        raw, offsets = scan.text_buffer(part.column("text"))
        words = scan.words_of(raw, offsets, scan.SPACED, scan.SPACED_FLAG)
        all_hashes = scan.shingle_hashes(words.hash, width)
        first = words.first.tolist()
        for k in range(part.num_rows):
            a, b = first[k], first[k + 1]
            yield base + k, set_of(all_hashes[a : max(a, b - width + 1)], words.hash[a:b], width)
        base += part.num_rows


def fingerprint(mixed: np.ndarray) -> int:
    """Of a set, from its mixed elements; order does not matter."""
    return scan.mix_int(int(mixed.sum(dtype=np.uint64)) + 0x51ED270B * len(mixed))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Scheme:
    """How sets of one band and the band below it are indexed."""

    def __init__(self, band: int, low: int, high: int, num: int, den: int):
        self.band, self.high = band, high
        self.differ = 2 * high * (den - num) // (den + num)
        self.exact, self.deleting, self.spare, self.most = self._allocate((low + high) / 2)
        weights = np.concatenate([np.ones(self.exact), np.full(self.deleting, 2.0)])
        edges = np.cumsum(weights) / weights.sum()
        self.edges = np.array([min(int(e * 2.0**64), (1 << 64) - 1) for e in edges[:-1]], np.uint64)
        n = self.exact + self.deleting
        self.salt = scan.mix(np.arange(n, dtype=np.uint64) + np.uint64(scan.mix_int(band + 1) & ((1 << 60) - 1)))

    def _allocate(self, size: float) -> tuple[int, int, int, int]:
        """(exact segments, one-deletion segments, spare ones, elements that a sparse segment has at most) of the least cost."""
        need = self.differ + 1
        if need == 1:
            return 0, 0, 0, -1
        options = []
        half = need // 2
        for exact, deleting, spare, most in [(need, 0, 0, -1), (need - 2 * half, half, 0, -1), *self._spared(size, need)]:
            unit = size / (exact + 2 * deleting)
            rows = exact + deleting * (1 + 2 * unit)
            strangers = exact * math.exp(-2 * unit) * (unit * unit * COMMON) ** (most + 1) + deleting * math.exp(-4 * unit) * (1 + 2 * unit)
            options.append((rows + MEETING * strangers, exact, deleting, spare, most))
        return min(options)[1:]

    @staticmethod
    def _spared(size: float, need: int) -> Iterator[tuple[int, int, int, int]]:
        """Exact segments with enough spare ones that few sets have more sparse segments than that."""
        for most in (0, 1):
            for spare in range(1, need + 8):
                m = need + spare
                p = math.exp(-size / m) * (1 + most * size / m)
                if spare >= m * p + 3 * math.sqrt(m * p):
                    yield m, 0, spare, most
                    break

    def keys(self, ordered: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Index keys of a set given as sorted hashes and the same elements mixed."""
        n = self.exact + self.deleting
        if n == 0:
            return np.zeros(0, np.uint64)
        cut = np.empty(n + 1, np.int64)
        cut[0], cut[-1] = 0, len(ordered)
        cut[1:-1] = np.searchsorted(ordered, self.edges)
        sums = np.zeros(len(ordered) + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        part = sums[cut[1:]] - sums[cut[:-1]] + self.salt
        full = part
        if self.spare:
            sparse = np.diff(cut) <= self.most
            if np.count_nonzero(sparse) <= self.spare:
                full = part[~sparse]
        if not self.deleting:
            return scan.mix(full)
        at = np.repeat(np.arange(self.exact, n), np.diff(cut)[self.exact :])
        return np.unique(scan.mix(np.concatenate([full, part[at] - mixed[cut[self.exact] :]])))


class Bands:
    """Bands of set sizes for a threshold num/den and their schemes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        self.schemes: dict[int, Scheme] = {}

    def _next(self) -> None:
        self.low.append(self.low[-1] * self.den // self.num + 1)

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self._next()
        return bisect.bisect_right(self.low, size) - 1

    def scheme(self, band: int) -> Scheme:
        if band not in self.schemes:
            while len(self.low) < band + 2:
                self._next()
            below = self.low[max(band - 1, 0)]
            self.schemes[band] = Scheme(band, below, self.low[band + 1] - 1, self.num, self.den)
        return self.schemes[band]

    def keys(self, ordered: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        b = self.of(len(ordered))
        return np.concatenate([self.scheme(b).keys(ordered, mixed), self.scheme(b + 1).keys(ordered, mixed)])


def sketch(mixed: np.ndarray) -> np.ndarray:
    """Parities of a set's elements over a power of two of bits, as many as elements at least."""
    bits = 64
    while bits < len(mixed):
        bits *= 2
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp and sketch (both null for an empty set)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, fp, marks = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for k, s in sets(batch, width):
                n[k] = len(s)
                if len(s):
                    mixed = scan.mix(s)
                    fp[k], marks[k] = signed(fingerprint(mixed)), sketch(mixed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(fp, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp", "sketch"])

    return mapped(id_text(docs), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, fp long, sketch array<long>")


def index_rows(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """key, doc_id of every index row; exact copies of a set appear once a task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in rows:
            ids = batch.column("doc_id").to_pylist()
            keys, counts, owners = [], [], []
            held = 0
            for k, s in sets(batch, width):
                if len(s) == 0 or ids[k] is None:
                    continue
                mixed = scan.mix(s)
                fp = fingerprint(mixed)
                if fp in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                got = bands.keys(s, mixed)
                keys.append(got)
                counts.append(len(got))
                owners.append(ids[k])
                held += len(got)
                if held > 200_000:
                    yield _rows(keys, counts, owners)
                    keys, counts, owners, held = [], [], [], 0
            if keys:
                yield _rows(keys, counts, owners)

    return mapped(id_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, "key long, doc_id long")


def _rows(keys, counts, owners) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), counts))], ["key", "doc_id"])


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """fp, items (the whole set as array<long>) of every row with a set."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps, items, held = [], [], 0
            for _, s in sets(batch, width):
                if len(s):
                    fps.append(signed(fingerprint(scan.mix(s))))
                    items.append(s.view(np.int64))
                    held += len(s)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["fp", "items"])
                    fps, items, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["fp", "items"])

    return mapped(id_text(docs), run, "fp long, items array<long>")


def least_differing(left: str, right: str) -> str:
    """SQL: bits in which two sketches differ, the longer one folded to the other's length."""
    fold = "transform(sequence(0, {n} - 1), i -> aggregate(sequence(0, cast(size({a}) / {n} as int) - 1), 0L, (x, k) -> x ^ {a}[i + k * {n}]))"
    n = f"least(size({left}), size({right}))"
    return f"aggregate(zip_with({fold.format(a=left, n=n)}, {fold.format(a=right, n=n)}, (x, y) -> bit_count(x ^ y)), 0L, (s, b) -> s + b)"


class Join:
    """One run of the join: the documents, their known sets and the threshold."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        self.up, self.down = den + num, den - num
        self.known = materialize(fingerprints(docs, width), "sets")
        ids = self.known.filter("fp is not null and doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
        grouped = ids.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.count("*").alias("copies"))
        self.texts = materialize(grouped.select("fp", "doc_id", "copies"), "texts")
        self.ids = ids
        self.names = ids.select("doc_id", "fp").distinct()

    def members(self) -> DataFrame:
        """key, leader, doc_id of the other members of each index bucket."""
        index = index_rows(self.docs, self.width, self.num, self.den).filter("key is not null and doc_id is not null").repartition("key")  # dealt once, read twice
        leaders = index.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last").drop("last")
        return materialize(index.join(leaders.hint("merge"), "key").filter("doc_id <> leader"), "members")

    def stars(self, members: DataFrame) -> DataFrame:
        """a (a bucket's leader), b (another member), their sizes na and nb, and ``low``, at least so many elements apart."""
        star = materialize(members.select("leader", "doc_id").distinct(), "star")
        named = dealt_join(star.join(self.names.withColumnRenamed("fp", "b"), "doc_id"), self.names.select(F.col("doc_id").alias("leader"), F.col("fp").alias("a")), "leader", "doc_id", counted=star)
        named = materialize(named.filter("a <> b").select("a", "b").distinct(), "named")
        rows = materialize(self.measured(named), "stars")
        discard(star, named)
        return rows

    def measured(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with the sets' sizes na and nb and ``low``, the bits in which the sketches differ."""
        sides = self.ids.select("fp", "n_shingles", "sketch").dropDuplicates(["fp"])
        b = sides.select(F.col("fp").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        a = sides.select(F.col("fp").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        both = dealt_join(pairs.join(b, "b"), a, "a", "b", counted=pairs)
        return both.select("a", "b", "na", "nb", F.expr(least_differing("sa", "sb")).alias("low"))

    def may_link(self) -> Column:
        return F.col("low") * self.up <= (F.col("na") + F.col("nb")) * self.down

    def contents(self, wanted: DataFrame) -> DataFrame:
        """fp, items of the wanted sets, each read from one document."""
        chosen = materialize(self.texts.join(wanted.distinct(), "fp", "left_semi").select("fp", "doc_id"), "chosen")
        n = chosen.count()
        read = id_text(self.docs).join(maybe_broadcast(chosen.select("doc_id").distinct(), 16, n), "doc_id", "left_semi")
        return whole_sets(read, self.width).join(maybe_broadcast(chosen.select("fp"), 16, n), "fp", "left_semi")

    def attached(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) with both whole sets, left and right."""
        content = materialize(self.contents(pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))), "content")
        if not self.unrepeated:
            content = content.dropDuplicates(["fp"])
        right = content.select(F.col("fp").alias("b"), F.col("items").alias("right"))
        left = content.select(F.col("fp").alias("a"), F.col("items").alias("left"))
        return dealt_join(pairs.join(right, "b"), left, "a", "b", counted=pairs)

    @property
    def unrepeated(self) -> bool:
        """Whether no row repeats a doc_id together with its set."""
        if not hasattr(self, "_unrepeated"):
            self._unrepeated = self.ids.groupBy("doc_id", "fp").count().filter("count > 1").isEmpty()
        return self._unrepeated

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs that are linked, by their whole sets."""
        sizes = self.attached(pairs.select("a", "b")).select("a", "b", (F.size("left") + F.size("right")).cast("long").alias("n"), F.size(F.array_intersect("left", "right")).alias("shared"))
        linked = sizes.filter(F.col("shared") * self.den >= (F.col("n") - F.col("shared")) * self.num)
        return materialize(linked.select("a", "b"), "linked")

    @staticmethod
    def rooted(rows: DataFrame, labels: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``rows`` with the root of the fingerprint column ``name``, as r + its name; ``by`` deals hot fingerprints."""
        side = labels.select(F.col("node").alias(name), F.col("root").alias("r" + name))
        out = dealt_join(rows, side, name, by, how="left") if by else rows.join(side, name, "left")
        return out.withColumn("r" + name, F.coalesce("r" + name, name))

    def open_pairs(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) of the sets ``rows`` (b), of different roots, that may link, by a prefix join of their elements.

        A pair is met at its first common element, whose places leave enough elements for a link.
        The u elements of x that stand in nothing of another root differ from y's, so a linked pair
        has ux + uy <= (|x| + |y|) r, r = (den - num) / (den + num), and one of the two is light: its u is
        at most half of that with the largest partner.  Under an element, pairs are looked for between
        the sets outside its most frequent root and all others, and of two heavy ones never.
        """
        num, den = self.num, self.den
        listed = self.contents(rows.select(F.col("b").alias("fp"))).dropDuplicates(["fp"]).withColumnRenamed("fp", "b")
        listed = self.rooted(listed, labels, "b").select("b", F.col("rb").alias("r"), F.size("items").cast("long").alias("n"), F.explode("items").alias("e"))
        light = 2 * F.col("u") * num <= F.col("n") * self.down  # u <= (n + n den / num) r / 2
        place = self._placed(listed).filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
        placed = materialize(place.select("e", "b", "r", "n", "u", "pos", light.alias("light")), "places")
        main = placed.groupBy("e", "r").agg(F.count("*").alias("c")).groupBy("e").agg(F.max_by("r", F.struct("c", "r")).alias("main"), F.count("*").alias("roots"))
        placed = materialize(placed.join(main.filter("roots > 1").drop("roots"), "e"), "placed")
        side = lambda k: [F.col(c).alias(c + k) for c in ("b", "n", "u", "r", "pos", "light")]
        x, y = placed.filter("r <> main").select("e", *side("x")), placed.select("e", *side("y"))
        shared = F.expr(f"ceil((nx + ny) * {num} / {num + den})")
        left = 1 + F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
        apart = (F.col("ux") + F.col("uy")) * self.up <= (F.col("nx") + F.col("ny")) * self.down
        fits = (left >= shared) & apart & (F.col("rx") != F.col("ry"))
        met = x.filter("lightx").join(y, "e").filter(fits).select("bx", "by")
        met = met.union(x.filter("not lightx").join(y.filter("lighty"), "e").filter(fits).select("bx", "by"))
        met = materialize(met.select(F.least("bx", "by").alias("a"), F.greatest("bx", "by").alias("b")).distinct(), "met")
        discard(placed)
        return met

    @staticmethod
    def _placed(listed: DataFrame) -> DataFrame:
        """The rows (b, r, n, e) whose element e meets another root, with the number ``u`` of b's
        elements that meet none and the place ``pos`` among all n: those come first, then the rarer ones."""
        every = Window.partitionBy("e")
        often = listed.select("*", F.count("*").over(every).alias("f"), F.min("r").over(every).alias("r0"), F.max("r").over(every).alias("r1"))
        mixed = often.filter("r0 <> r1").drop("r0", "r1")
        each = Window.partitionBy("b")
        mixed = mixed.withColumn("u", F.col("n") - F.count("*").over(each))
        return mixed.withColumn("pos", F.row_number().over(each.orderBy("f", "e")) + F.col("u"))

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the sketches leave open."""
        return materialize(self.measured(pairs).filter(self.may_link()).select("a", "b"), "pairs")

    def labels(self) -> DataFrame:
        """node, root of all fingerprints that have links."""
        members = self.members()
        stars = self.stars(members)
        # one leader for each member first
        near = stars.filter(self.may_link())
        first = materialize(near.groupBy("b").agg(F.min("a").alias("a")), "first")
        edges = self.verified(first)
        labels = components(edges)
        # then the pairs that join classes
        rest = self.rooted(self.rooted(near.select("a", "b"), labels, "a", "b"), labels, "b", "a").filter("ra <> rb").select("a", "b")
        rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "rest")
        labels = _joined(labels, self.verified(rest))
        # then pairs of members, in buckets of two classes or more besides the leader
        left = self.open_sets(members, self.told(stars, edges, labels))
        discard(members, stars)
        if not left.isEmpty():
            labels = _joined(labels, self.verified(self.sketched(self.open_pairs(left, labels))))
        return labels

    def told(self, stars: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
        """``stars`` with the member's root, whether it is verified as linked with the leader, and
        whether it is ``far``: no set linked with the leader can be linked with it."""
        reach = F.col("na") + F.col("nb") + F.floor(2 * F.least("na", "nb") * self.den / self.num)
        far = (F.col("low") * self.up > reach * self.down).alias("far")
        told = stars.select("a", "b", far).join(edges.withColumn("linked", F.lit(True)), ["a", "b"], "left")
        return materialize(self.rooted(told, labels, "b", "a"), "told")

    def open_sets(self, members: DataFrame, told: DataFrame) -> DataFrame:
        """b: the sets that share a bucket with a set of another class, its leader apart, and may link with it.

        A member linked with the leader can link with no far one, so where all other
        members are far, only they are left.
        """
        rows = members.join(self.names.withColumnRenamed("fp", "b"), "doc_id").select("key", "leader", "b").distinct()
        rows = dealt_join(rows, self.names.select(F.col("doc_id").alias("leader"), F.col("fp").alias("a")), "leader", "b", counted=members)
        rows = materialize(rows.select("key", "a", "b").join(told, ["a", "b"]).select("key", "b", "rb", "far", "linked"), "open")
        apart = lambda some: F.min(F.when(some, F.col("rb"))) != F.max(F.when(some, F.col("rb")))
        single = F.col("linked").isNull()
        per = rows.groupBy("key").agg(apart(F.lit(True)).alias("mixed"), apart(single).alias("strange"), F.max(single & ~F.col("far")).alias("close"))
        keys = per.filter("mixed and (strange or close)").select("key", "close")
        out = materialize(dealt_join(rows, keys, "key", "b").filter("close or linked is null").select("b").distinct(), "candidates")
        discard(rows, told)
        return out


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges."""
    if edges.isEmpty():
        return labels
    return components(labels.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of an edge list (a, b).

    Contracts the graph: each root points to its smallest neighbour, chains of
    pointers are doubled away, and edges between different roots go on.
    """
    todo = materialize(edges.select("a", "b"), "edges")
    labels = materialize(todo.select(F.col("a").alias("node")).union(todo.select("b")).distinct().withColumn("root", F.col("node")), "labels")
    while not todo.isEmpty():
        ways = todo.union(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jump = ways.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")).withColumn("to", F.least("root", "to"))
        jump = materialize(jump, "jump")
        while True:
            far = jump.select(F.col("root").alias("to"), F.col("to").alias("far"))
            nxt = materialize(jump.join(far, "to", "left").select("root", "to", F.coalesce("far", "to").alias("far")), "jump")
            moved = not nxt.filter("far <> to").isEmpty()
            jump = nxt.select("root", F.col("far").alias("to"))
            if not moved:
                break
        labels = materialize(labels.join(jump, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        at = jump.select(F.col("root").alias("a"), F.col("to").alias("ra"))
        bt = jump.select(F.col("root").alias("b"), F.col("to").alias("rb"))
        todo = materialize(todo.join(at, "a").join(bt, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    return labels


def near_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two documents link when
    den * |intersection| >= num * |union| of their shingle sets."""
    join = Join(docs, width, num, den)
    labels = join.labels()
    classes = join.rooted(join.texts, labels, "fp").select("fp", "doc_id", F.col("rfp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    shared = materialize(dealt_join(classes, lowest, "root", "fp").select("fp", "component_id"), "classes")
    out = dealt_join(join.known.drop("sketch"), shared, "fp", "doc_id", how="left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component or null; all columns stay."""
    found = near_components(docs, width, num, den)
    copies = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(maybe_broadcast(copies, 16), "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 2], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS pos, n FROM s JOIN (SELECT g, count(*) AS c FROM s GROUP BY g) USING (g) JOIN n USING (doc_id)),
p AS (SELECT doc_id, g, n FROM f WHERE pos <= n - ceil(n * 0.9) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
m AS (SELECT c.a, c.b, na, nb, count(*) AS common FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY ALL),
e AS (SELECT a, b FROM m WHERE 100 * common >= 90 * (na + nb - common)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, y.b FROM reach r JOIN ways y ON r.b = y.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
