import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, docs_frame
from wattline.llm import mixing, quality, urls
from wattline.llm.common import n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    base = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), base


def corpus():
    rng = random.Random(1)
    words = ["ab", "été", "x#y", "日本", "the", "of", "a\x00b", "|", "z\u00a0z", "\u2028"]
    out = [None, "", " \n\t", "one", "a b c a b c", "ab " * 4000, "x\ny\nx\n\n \ny x"]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "\x0b", "  "]) for _ in range(rng.randint(0, 120))))
    out.append(" ".join(f"word{i} then" for i in range(80)))
    return out + out[-3:]


def test_quality_matches_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in quality.judge(docs_frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert not (r.base_failed and r.kept)
    assert got[len(texts) - 1].kept


def test_quality_order_never_changes_the_verdict():
    import numpy as np

    texts = [(t or "").encode() for t in corpus()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    names = list(quality.RULES)
    seen = {tuple(quality.cascade(quality.Features(data, off), order, quality.Limits())) for order in (names, names[::-1], sorted(names))}
    assert len(seen) == 1


def test_quality_order_by_rejections_that_are_left_per_cost():
    cost = {"n_words": 10.0, "n_repeat_words": 1000.0, "n_symbols": 5.0, "word_chars": 5.0, "n_lines": 50.0, "n_dup_lines": 50.0, "n_upper": 5.0, "n_lower": 5.0, "n_letters": 5.0}
    seen = {frozenset(): 50, frozenset({"min_words", "symbols"}): 30, frozenset({"repeated_windows"}): 20, frozenset({"letters"}): 1}
    order = quality.cascade_order(quality.Costs(cost, seen), list(quality.RULES))
    assert order[0] == "min_words" and order.index("letters") < order.index("symbols") and sorted(order) == sorted(quality.RULES)
    assert order.index("repeated_windows") < order.index("symbols")
    assert sorted(quality.cascade_order(quality.Costs({}, {}), list(quality.RULES))) == sorted(quality.RULES)


def test_quality_sample_sends_no_text(spark):
    df = docs_frame(spark, corpus()).repartition(4)
    costs = quality.sample_costs(df, "text", quality.Limits(), rows=10**6)
    assert set(costs.feature) == set(quality.FEATURES) and sum(costs.rejected.values()) == df.count()


def test_quality_passing_keeps_columns_and_empty(spark):
    df = docs_frame(spark, corpus()).withColumn("kept", F.lit(7))
    out = quality.passing(df)
    assert out.columns == df.columns and {r.kept for r in out.collect()} == {7}
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


def test_urls(spark):
    rows = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "https://www.example.com/en/a?b#c", "http://a.net/es/", "http://a.net/es", "ftp://x.org", "http://x.org/a?utm_source=q", "http://éX.COM#/p", "http://badexample.com/en/", "http://x.org/cgi-bin/", "a://b://c.net/fr/d", "http://x.org/xxx/", "HTTP://X.ORG/WP-LOGIN.PHP"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[4] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[5] == ("a.net", "/es/", "net/es/", "block")
    assert got[6] == ("a.net", "/es", None, "allow")
    assert got[7] == ("x.org", "", None, "allow")
    assert got[8][2:] == (None, "block") and got[11][3] == "block" and got[13][3] == "block" and got[14][3] == "block"
    assert got[9] == ("éx.com", "", None, "allow")
    assert got[10][2] == "com/"
    assert got[12] == ("b:", "//c.net/fr/d", None, "allow")
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


PARTS = ["utm_x=1", "wp-login.php", "wp-login.php5", "mywp", "tag", "page", "7", "ads.", "ad.", "bads.", "xxx", "xxxl", "porn", "login", "logins", "?", "/", "&", ".", "-", "zip", "apk\n", "cgi-bin", "a", "replytocom=4", "http://", "É", "İ"]


def test_url_index_equals_running_every_rule_whatever_token_is_filed():
    places = [urls.literal_tokens(p) for p in urls.PATTERNS]
    assert places[2] == [("wp",), ("login",)] and places[4] == [("porn", "xxx")] and places[7] == [("ad", "ads")] and all(places)
    tokens = sorted({t for p in places for x in p for t in x})
    rng = random.Random(3)
    for _ in range(60):
        index = urls.RuleIndex(urls.PATTERNS, {t: rng.randrange(9) for t in tokens})
        assert not index.always
        for _ in range(300):
            u = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9)))
            want = next((k for k, p in enumerate(urls.PATTERNS) if re.search(p, u.lower())), None)
            assert index.first(u) == want, u


def test_literal_tokens_are_bounded_by_the_expression():
    assert urls.literal_tokens(r"abc") == urls.literal_tokens(r"/abc") == urls.literal_tokens(r"abc/") == urls.literal_tokens(r"/abc[a-z]?/") == []
    assert urls.literal_tokens(r"/abc/(?:x|yz)?/") == [("abc",)]
    assert urls.literal_tokens(r"(?i:/abc/)") == [] and urls.literal_tokens(r"[^a]abc/") == []


def test_rarest_token_may_be_unbounded_in_the_url(spark):
    rows = ["http://x.org/wp-login.php5", "http://y.org/wp-login/", "http://z.org/a/login/wp", None]
    got = {r.page_id: (r.verdict, r.pattern) for r in urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert got[0] == ("block", r"/wp-login\.php") and got[1] == ("allow", None) and got[2] == ("block", r"/(login|signin)(/|\?|$)") and got[3] == ("allow", None)


def test_mixing_targets_and_selection(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), "en", rng.choice(["b", "a", None, "hot", "hot"]), 0) for i in range(3000)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "a", 0)] + rows[:2]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, F.array("source"), n_words(F.col("text"))).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df, F.array("source"), n_words(F.col("text"))).collect()))
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    order = ["a", "b", "hot", None]
    want = dict(zip(order, mixing.quotas([size[s] for s in order], [5, 2, 1, 5], 1.5, 2), strict=True))
    taken = Counter()
    for r in out:
        s = r.members[0]
        assert r.plan[0].source_size == size[s] and abs(r.plan[0].target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 60, s
    assert mixing.mix(spark.createDataFrame([], DOCS), F.array("source"), n_words(F.col("text"))).count() == 0


def test_quotas_reshare():
    got = mixing.quotas([10, 100, 100, 0], [5, 2, 1, 5], 1.5, 2)
    assert got[0] == 20 and got[3] == 0 and abs(sum(got) - 315) < 1e-9 and all(t <= 2 * s for t, s in zip(got, [10, 100, 100, 0], strict=True))


def test_flow_overlapping_sources_is_optimal():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 0}, {"a": 10, "b": 10}, 2)
    assert flow[("a",), "a"] == 10
    assert flow[("a", "b"), "b"] == 10 and flow[("a", "b"), "a"] == 0


def test_flow_equals_the_least_cost_of_all_integer_flows():
    import itertools

    rng = random.Random(12)
    patterns = [("a",), ("b",), ("a", "b")]
    for _ in range(40):
        supply = {p: rng.randint(0, 3) for p in patterns}
        quota = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        flow = mixing.min_cost_flow(supply, quota, 2)
        arcs = [(p, s) for p in patterns for s in p]

        def cost(routed):
            """(words that reach a quota, negated; cost of repeats) of a flow, or None if it breaks a bound."""
            total = 0
            for p in patterns:
                used = sum(routed[k] for k, (q, _) in enumerate(arcs) if q == p)
                if used > 2 * supply[p]:
                    return None
                total += max(0, used - supply[p])
            if any(sum(routed[k] for k, (_, t) in enumerate(arcs) if t == s) > quota[s] for s in quota):
                return None
            return -sum(routed), total

        best = min(c for c in map(cost, itertools.product(range(7), repeat=len(arcs))) if c is not None)
        assert cost([flow.get(a, 0) for a in arcs]) == best


def test_mixing_overlapping_sources_end_to_end(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 9))), rng.choice([["a"], ["b"], ["a", "b"], ["a", None], ["b", "a", "a"]])) for i in range(2000)] + [(None, "x y", ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    out = mixing.mix(df, F.col("tags"), n_words(F.col("text"))).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    supply = Counter()
    for r in out:
        supply[tuple(r.members)] += r.size
    names = ["a", "b", None]
    sizes = [sum(n for p, n in supply.items() if s in p) for s in names]
    target = dict(zip(names, mixing.quotas(sizes, [5, 2, 1], 1.5, 2)))
    flow = mixing.min_cost_flow(dict(supply), {s: round(t) for s, t in target.items()}, 2)
    for p in supply:
        routed = sum(flow.get((p, s), 0) for s in p)
        assert abs(sum(r.taken for r in out if tuple(r.members) == p) - routed) <= 9
