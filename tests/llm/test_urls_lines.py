"""Ops 6 and 7: odd urls and lines, rules, shrinkage, removed runs."""

from collections import Counter

from pyspark.sql import functions as F

from quern.llm import lines, urls


def judged(spark, rows, **kw):
    df = spark.createDataFrame([(k, u, "html", "host", "x") for k, u in enumerate(rows)], "page_id long, url string, html string, host string, rate string")
    return {r.page_id: r for r in urls.judge(df, **kw).collect()}


def test_hosts_paths_and_rules(spark):
    got = judged(spark, [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2", "http://badexample.org/es/", "http://a.com/fr/", "http://com/de/", "http://org", "x://a.net?q=/b", "x://a.net#/b", "http://a.b.co.uk/fr/"])
    assert [(got[k].host, got[k].path) for k in (0, 1, 2)] == [("", "")] * 3
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert (got[4].rule, got[4].verdict) == ("example.org/en/1", "block")
    assert (got[5].rule, got[5].verdict) == ("org/", "allow")
    assert got[6].rule == "org/" and got[7].rule == "com/fr/" and got[8].rule == "com/de/"
    assert got[9].rule is None and got[9].path == ""
    assert (got[10].host, got[10].path) == (got[11].host, got[11].path) == ("a.net", "")


def test_reputation_shrinks_towards_the_domain(spark):
    rows = ["http://bad.x.com/de/1"] * 30 + ["http://new.x.com/other"] + ["http://good.y.com/fr/1"] * 30 + ["http://new.y.com/other", "http://bad.x.com/none", "http://good.y.com/none"]
    got = judged(spark, rows)
    assert got[62].verdict == "block" and got[63].verdict == "allow"
    assert got[30].rate > 0.5 > got[61].rate
    assert got[62].rate >= got[30].rate


def test_nothing_is_blocked_without_labels(spark):
    got = judged(spark, ["http://a.net/x", "http://b.net/y", None])
    assert {r.verdict for r in got.values()} == {"allow"}
    assert judged(spark, []) == {}


def test_rule_join_equals_the_expression(spark, monkeypatch):
    rows = ["http://www.example.org/es/x", "https://example.org/en/12", "http://a.com/fr/", "http://q.net/", None, "http://a.com/de/x", "http://a.com/de/x"]
    one = judged(spark, rows)
    monkeypatch.setattr(urls, "EXPRESSION_RULES", 0)
    two = judged(spark, rows)
    assert {k: (r.rule, r.verdict) for k, r in one.items()} == {k: (r.rule, r.verdict) for k, r in two.items()}


def test_suffix_and_domain(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.example.com",), ("com",), ("",)], "h string")
    s, d = urls.suffix_domain(F.col("h"))
    assert [tuple(r) for r in df.select(s, d).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("uk", "co.uk"), ("com", "example.com"), ("com", "com"), ("", "")]


def words(line):
    import re

    return len(re.findall("[^ \t-\r]+", line))


def brute(rows, least=50):
    """Chunks of both resolutions, first occurrences, and runs grown from them, plainly."""
    import hashlib

    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t.split("\n") for _, t in docs]
    units, first = [], {}
    for d, ls in enumerate(texts):
        num = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
        begin = 0
        mine = [(k, 1) for k in range(len(ls))]
        for k in range(len(ls)):
            if k == len(ls) - 1 or (num[k] + 7 * (num[k - 1] if k else 0)) % 3 == 0:
                if k > begin:
                    mine.append((begin, k - begin + 1))
                begin = k + 1
        for k, n in mine:
            units.append((d, k, n))
            at = first.setdefault(tuple(ls[k : k + n]), (d, k))
            first[tuple(ls[k : k + n])] = min(at, (d, k))
    gone = [set() for _ in docs]
    for d, k, n in units:
        ls = texts[d]
        o, at = first[tuple(ls[k : k + n])]
        if (o, at) == (d, k):
            continue
        other, shift = texts[o], k - at
        low = high = k
        while low - 1 >= max(shift, 0) and ls[low - 1] == other[low - 1 - shift]:
            low -= 1
        while high + 1 < len(ls) and high + 1 - shift < len(other) and ls[high + 1] == other[high + 1 - shift]:
            high += 1
        if sum(map(words, ls[low : high + 1])) >= least:
            gone[d] |= set(range(low, high + 1))
    return {doc: "\n".join(x for k, x in enumerate(ls) if k not in out) for doc, ls, out in zip(docs, texts, gone, strict=True)}


def passage(tag, n):
    return "\n".join(" ".join(f"{tag}{k}w{j}" for j in range(12 + 9 * (k % 3))) for k in range(n))


def test_line_dedup_against_brute_force(spark, odd):
    import random

    rnd = random.Random(7)
    p, q = passage("p", 6), passage("q", 9)
    short = "a b\nc d e f g h i j k l\n" + " ".join(f"m{k}" for k in range(33)) + "\nn o p q r s t u v"  # 54 words
    below = "\n".join(" ".join(f"z{k}{j}" for j in range(7)) for k in range(7))  # 49 words
    rows = [(1, f"start one\n{p}\nend"), (2, f"{p}"), (3, f"other\n\n{q}\nmid\n{p}"), (4, q + "\n" + q), (5, "start one\nend"), (6, p[:-1] + "!"), (7, ""), (8, None), (9, q), (9, q), (None, p), (10, "short\n" * 60)]
    rows += [(20, f"u1\n{short}\nu2"), (21, f"u3 x\n{short}\nu4 y"), (22, f"{below}\nu5"), (23, f"u6\n{below}\nu7"), (24, "one line " * 30), (25, "before\n" + "one line " * 30 + "\nafter")]
    pool = [" ".join(f"r{rnd.randint(0, 30)}" for _ in range(rnd.choice([0, 1, 5, 20, 60]))) for _ in range(25)]
    rows += [(100 + k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 15)))) for k in range(40)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, key string, ranges int")
    want = brute(rows)
    assert want[21, rows[13][1]] == "u3 x\nu4 y" and want[25, rows[17][1]] == "before\nafter" and want[23, rows[15][1]] == rows[15][1]
    got = lines.report(df).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, want.get((i, t), t)) for i, t in rows)
    assert any(r.n_removed for r in got)
    kept = lines.drop_emptied(df)
    assert kept.columns == df.columns
    assert 2 not in {r.doc_id for r in kept.collect()} and {7, 8} <= {r.doc_id for r in kept.collect()}
    every = brute(rows, 0)
    assert Counter((r.doc_id, r.text) for r in lines.report(df, min_words=0).collect()) == Counter((i, every.get((i, t), t)) for i, t in rows)


def test_line_dedup_odd_rows(odd, none):
    from quern.llm.lines import dedup

    columns, some = odd.columns, odd
    out = dedup(some)
    assert out.columns == columns and out.count() == some.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].text is None and by[1].text == ""
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert dedup(none.select(*columns)).count() == 0
