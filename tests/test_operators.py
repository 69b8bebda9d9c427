"""Edge cases of the library: empty input, ties, boundaries, refusals."""

import pytest
from pyspark.sql import functions as F

from quern.functions import evals, text
from quern.operators import aggregates, dedup, filters, joins, ranking, sampling, splits, windows


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_keep_first_and_best(spark):
    df = frame(spark, [(3, "a", 1), (1, "a", 9), (2, "b", 5), (4, None, 0), (5, None, 1)], "i int, k string, v int")
    assert {r.i for r in dedup.keep_first(df, F.col("k"), ["i"]).collect()} == {1, 2, 4}
    assert {r.i for r in dedup.keep_best(df, ["k"], ["v", "i"]).collect()} == {1, 2, 5}
    assert dedup.keep_first(df.limit(0), F.col("k"), ["i"]).count() == 0
    with pytest.raises(dedup.IdentityError):
        dedup.require_unique(df, ["k"])


def test_buckets_and_their_specification(spark):
    spec = [("low", 0, 10), ("high", 10, 20)]
    df = frame(spark, [(0,), (1,), (10,), (11,), (20,), (21,), (None,)], "v int")
    assert [r[0] for r in df.select(filters.bucket(F.col("v"), spec)).collect()] == [None, "low", "low", "high", "high", None, None]
    filters.check_buckets([("a", 0, 10, 1), ("b", 10, 20, 1)])
    for bad in ([("a", 0, 10, 1), ("a", 10, 20, 1)], [("a", 0, 10, 0)], [("a", 5, 5, 1)], [("a", 0, 11, 1), ("b", 10, 20, 1)]):
        with pytest.raises(filters.SpecError):
            filters.check_buckets(bad)


def test_reasons(spark):
    df = frame(spark, [(1, True, True), (2, False, True), (3, False, False)], "i int, a boolean, b boolean")
    rules = [("a", F.col("a")), ("b", F.col("b")), ("a", F.col("b"))]
    assert [r[0] for r in df.select(filters.first_reason(rules)).collect()] == ["a", "b", None]
    assert [r[0] for r in df.select(filters.all_reasons(rules)).collect()] == [["a", "b"], ["b", "a"], []]
    kept, held = filters.split_ledger(df, filters.first_reason(rules))
    assert kept.count() == 1 and held.count() == 2


def test_running_cap_counts_only_what_it_accepts(spark):
    df = frame(spark, [("x", s) for s in (1, 2, 3, 50, 120, 121)], "c string, seq long")
    got = sorted(r.seq for r in filters.running_cap_exact(df, "c", "seq", 100, 1).collect())
    assert got == [1, 120]


def test_row_numbers_equal_a_global_sort(spark):
    df = frame(spark, [(k * 7 % 50, k) for k in range(200)], "v int, id int")
    got = {r.id: r.rn for r in ranking.global_row_number(df, ["v", "id"], buckets=8).collect()}
    want = {i: n for n, (v, i) in enumerate(sorted((k * 7 % 50, k) for k in range(200)), 1)}
    assert got == want
    assert ranking.global_row_number(df.limit(0), ["v"]).count() == 0


def test_samplers_are_bounded_and_reproducible(spark):
    df = frame(spark, [(k, "ab"[k % 3 == 0]) for k in range(90)], "id int, g string")
    one = sampling.group_sample(df, ["g"], 10, 1, "s", "id")
    assert {(r.g, r["count"]) for r in one.groupBy("g").count().collect()} == {("a", 10), ("b", 10)}
    assert sorted(one.collect()) == sorted(sampling.group_sample(df.repartition(7), ["g"], 10, 1, "s", "id").collect())
    assert sampling.group_sample(df, ["g"], 10**6, 1, "s", "id").count() == 90
    with pytest.raises(sampling.Shortfall):
        sampling.require_quotas(df, "g", {"b": 31})
    sampling.require_quotas(df, "g", {"b": 30})
    with pytest.raises(sampling.Shortfall):
        sampling.anchor_mix(df, "g", {"a": 0.4, "b": 0.39}, 1, "id")


def test_smooth_round_robin_by_hand():
    rr = lambda streams, w: "".join(s for s, _ in sampling.smooth_round_robin(streams, w))
    assert rr({"a": [None] * 9, "b": [None] * 2, "c": [None] * 2}, {"a": 5.0, "b": 1.0, "c": 1.0}).startswith("aabacaa")
    assert rr({"a": [None], "b": [None] * 3}, {"a": 1.0, "b": 1.0}) == "abbb"
    assert sampling.smooth_round_robin({"a": [1, 2], "b": [1, 2, 3]}, {"a": 1.0, "b": 1.0}) == [("a", 1), ("b", 2), ("b", 3)]
    assert rr({}, {"a": 1.0}) == ""


def test_greedy_cover(spark):
    df = frame(spark, [(1, ["x"]), (2, ["x", "y"]), (3, ["z"]), (4, ["z", "x"]), (5, ["y"])], "k int, l array<string>")
    got = sampling.greedy_labels(df, "k", "l", 1, 0).orderBy("pick").collect()
    cover = {x for r in got for x in dict([(1, "x"), (2, "xy"), (3, "z"), (4, "zx"), (5, "y")])[r.k]}
    assert cover == {"x", "y", "z"} and len(got) == 2


def greedy_plain(rows, each):
    """The rule over all rows, plainly."""
    rows = dict(rows)
    cover, out = {x: 0 for v in rows.values() for x in v}, []
    while True:
        able = next((a for x in sorted(cover, key=lambda x: (cover[x], x)) if cover[x] < each and (a := [k for k, v in rows.items() if x in v])), None)
        if not able:
            return out
        pick = min(able, key=lambda k: (sum(cover[y] for y in rows[k]), -len(rows[k]), k))
        for y in rows.pop(pick):
            cover[y] += 1
        out.append(pick)


def test_greedy_cover_lets_all_rows_compete(spark):
    import random

    rnd = random.Random(7)
    for n, each in ((1500, 10), (40, 6)):
        rows = [(k, sorted(rnd.sample("abcdefg", rnd.randint(1, 5)))) for k in range(n)]
        rnd.shuffle(rows)
        got = sampling.greedy_labels(frame(spark, rows, "k int, l array<string>"), "k", "l", each, 4).orderBy("pick").collect()
        assert [r.k for r in got] == greedy_plain(rows, each)


def test_splits_refuse_leaks(spark):
    df = frame(spark, [(1, "k", "test"), (2, "k", "train"), (3, "m", "val")], "i int, k string, split string")
    assert [r.k for r in splits.overlaps(df, "k").collect()] == ["k"]
    with pytest.raises(splits.Leak):
        splits.require_disjoint(df, "k")
    assert splits.require_disjoint(splits.follow_first(df, ["k"], "i"), "k").count() == 3
    assert {(r.split_a, r.split_b): r.shared for r in splits.pairwise_overlap(df, "k").collect()} == {("test", "train"): 1, ("test", "val"): 0, ("train", "val"): 0}


def test_checked_joins(spark):
    a = frame(spark, [(1,), (2,)], "k int")
    b = frame(spark, [(1, "x")], "k int, v string")
    for bad in (b, b.union(b)):
        with pytest.raises(dedup.IdentityError):
            joins.checked_join(a, bad, ["k"])
    with pytest.raises(dedup.IdentityError):
        joins.one_to_one(a, b, ["k"])
    assert joins.checked_join(a.filter("k = 1"), b, ["k"]).count() == 1


def test_first_difference(spark):
    df = frame(spark, [([1, 2], [1, 2]), ([1, 2], [1, 3]), ([1], [1, 2]), ([], []), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(joins.first_difference(F.col("a"), F.col("b"))).collect()] == [None, 1, 1, None, 0]


def test_ratings(spark):
    def fit(rows, anchors):
        df = frame(spark, rows, "a string, b string, score_a double, games int")
        return {r.player: (r.rating, r.ci_low, r.ci_high) for r in aggregates.joint_ratings(df, anchors).collect()}

    got = fit([("a", "b", 5.0, 10), ("b", "c", 7.5, 10)], {"a": 1500.0})
    assert got["a"] == (1500.0,) * 3 and got["b"][0] == 1500.0
    assert got["c"][0] == 1309.0  # 1500 less 400 log10(3)
    assert got["b"][1] < got["b"][0] < got["b"][2]
    assert fit([("a", "b", 10.0, 10)], {"a": 1500.0})["b"][0] == -200.0


def test_guards(spark):
    df = frame(spark, [("x", True), ("x", False)], "t string, ok boolean")
    acc = {r.t: r.accuracy for r in aggregates.accuracy(df, "t", F.col("ok")).collect()}
    assert acc == {"x": 0.5, None: 0.5}
    assert aggregates.rates(df.limit(0), {"ok": F.col("ok")}).first() == (0, None)


def test_windows(spark):
    df = frame(spark, [("a", k, k in (2, 3, 5)) for k in range(7)], "g string, p int, f boolean")
    assert [(r.first, r.last, r.length) for r in windows.streaks(df, ["g"], "p", F.col("f")).orderBy("first").collect()] == [(2, 3, 2), (5, 5, 1)]
    assert windows.clean_prefix(df, ["g"], "p", F.col("f")).count() == 2
    assert windows.clean_prefix(df, ["g"], "p", F.lit(False)).count() == 7


def test_text_functions(spark):
    df = frame(spark, [("a\n\nb ",), ("one",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.final_answer(F.col("t"))).collect()] == ["b", "one", "", None]
    lists = frame(spark, [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "s array<string>")
    assert [r[0] for r in lists.select(text.oxford(F.col("s"))).collect()] == ["", "a", "a and b", "a, b, and c"]
    ids = frame(spark, [([1, 2, 3],), ([],)], "i array<int>")
    assert [tuple(r) for r in ids.select(text.pad_right(F.col("i"), 2, 0), text.mask(F.col("i"), 4), text.label_mask(F.col("i"), F.lit(2))).collect()] == [([1, 2], [1, 1, 1, 0], [-100, -100, 3]), ([0, 0], [0, 0, 0, 0], [])]


def test_evaluations(spark):
    lines = ["+0.50", "-1.2", "White is better by 2", "Black is slightly better (0.4)", "mate in 3 for black", "Black mates", "no number", None]
    df = frame(spark, [(x,) for x in lines], "l string")
    got = [(r.e.kind, r.e.pawns) for r in df.select(evals.parse_evaluation(F.col("l")).alias("e")).collect()]
    assert got == [("number", 0.5), ("number", -1.2), ("number", 2.0), ("number", -0.4), ("mate", -100.0), ("mate", -100.0), (None, None), (None, None)]
    cp = frame(spark, [(0,), (10**7,), (-(10**7),)], "cp long")
    assert [round(r[0], 6) for r in cp.select(evals.win_rate(F.col("cp").cast("double"))).collect()] == [0.5, 1.0, 0.0]
    assert [r[0] for r in frame(spark, [(-7, 2), (7, 2), (7, 0)], "a long, b long").select(evals.truncating_div(F.col("a"), F.col("b"))).collect()] == [-3, 3, None]


def test_multiset_counts_of_any_length(spark):
    """Counts beyond an int are summed, totals beyond a long keep their digits, and graders tell them apart."""
    from quern.operators import grading

    texts = ["<p>4501042323994846<a><p>", "<p>" + "9" * 40 + "<p>2<a>007", "<p>9223372036854775807<p>1", "none", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.m and [tuple(x) for x in r.m] for r in df.select("id", aggregates.multiset(F.col("t")).alias("m")).collect()}
    assert got == {0: [("a", 1, None), ("p", 4501042323994847, None)], 1: [("a", 7, None), ("p", None, str(10**40 + 1))], 2: [("p", None, str(2**63))], 3: [], 4: None}
    ten = "<PIECE_WP>" + "1" * 30
    df = spark.createDataFrame([(ten, ten, True), (ten + "2", ten, False), (ten, "<PIECE_WP>2", False)], "pred string, gold string, want boolean")
    assert df.filter(grading.multiset_equal(F.col("pred"), F.col("gold")) != F.col("want")).collect() == []
