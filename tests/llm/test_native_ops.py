"""Exact dedup, mixing, chat formatting, quality rules and URL filters against plain Python, with nulls, ties, repeats and empty tables."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.llm import chat_format as cf
from quarry.llm import exact_dedup, mixing, quality_rules, url_filter
from quarry.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, source string, run int, digest string, keep_id long, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "r") for r in rows], CLASH)


# exact dedup -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = [(1, "Hi É", "a"), (2, "hi É", "b"), (3, "hi é", None), (4, None, "a"), (5, "", "a"), (5, "", "a"), (None, "hi É", "a"), (6, "x" * 300_000, "a")]
    rows += [(100 + i, "hot", "h") for i in range(500)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows).repartition(7), keep=keep).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    best = min if keep == "smallest" else max
    want = [
        (i, k := best((x for x in groups[t] if x is not None), default=None), len(groups[t]), i == k, hashlib.sha256(t.encode()).hexdigest())
        for i, t in ((i, (t or "").translate(LOWER)) for i, t, _ in rows)
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    left = exact_dedup.drop_duplicates(docs_of(spark, rows), keep=keep)
    assert left.columns == ["doc_id", "text", "source", "run", "digest", "keep_id", "row"]
    assert sorted(r.doc_id for r in left.collect()) == sorted({w[1] for w in want})
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_runs_are_sorted_and_merged_in_rounds(spark):
    rows = spark.createDataFrame([(i, bytes([i % 7]), "") for i in range(100)], "id long, digest binary, variant string")
    plan = exact_dedup.merge_runs(rows, runs=16, fan_in=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 6 and plan.count("HashAggregate") == 0
    assert plan.count("Sort [run") == 4 and plan.count("Exchange hashpartitioning(run") == 3  # each run, each round's merge


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_texts_of_one_digest_are_told_apart(spark, keep):
    from pyspark.sql import functions as F

    rows = [(i, f"{'xy'[i % 2]}{i % 5}", "a") for i in range(40)] + [(None, "x0", "a"), (50, None, "a"), (51, "", "a"), (52, "z alone", "a")]
    weak = lambda text: F.substring(F.unhex(F.md5(F.substring(text, 1, 1))), 1, 4)
    got = exact_dedup.exact_dedup(docs_of(spark, rows), keep=keep, digest=weak).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    best = min if keep == "smallest" else max
    want = [(i, best(x for x in groups[t or ""] if x is not None), len(groups[t or ""])) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted(want, key=str)
    left = exact_dedup.drop_duplicates(docs_of(spark, rows), keep=keep, digest=weak)
    assert sorted(r.doc_id for r in left.collect()) == sorted({k for _, k, _ in want})


def test_exact_dedup_sql_says_the_same(spark):
    rows = [(1, "A\nb"), (2, "a\nB"), (3, None), (4, ""), (5, "É"), (6, "é")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(exact_dedup.OP5_SQL).fetchall()
    assert sorted(want) == sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest").collect()))


# mixing ------------------------------------------------------------------------------------------------------------


def filled(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(cap * sizes[s] for s in fixed)
        target = {s: cap * sizes[s] if s in fixed else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        fixed |= over


def mixed_rows(seed):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice([0, 1, 5, 30, 200, 1500]), rng.choice(["a", "b", "c", "Z", "é", None, "hot", "hot", "hot"])) for i in range(900)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows = [*mixed_rows(seed), (None, "n n", "a"), (5, None, "a"), (7, "x y", "tiny"), (7, "x y", "tiny"), (8, "", "blank")]
    frame = docs_of(spark, rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target, taken, largest = filled(sizes), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 3)
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    repeated = mixing.repeat_documents(frame)
    assert repeated.columns == frame.columns and repeated.count() == sum(r.copies for r in got)


def plain_dual(cells, targets, ridge=mixing.RIDGE, cap=3.0):
    """Multipliers by source and the length's, by plain coordinate descent with bisection on the dual's gradient."""
    total = sum(n * s for _, s, n in cells)
    centre = sum(n * s * math.log(s) for _, s, n in cells) / total
    width = max((sum(n * s * math.log(s) ** 2 for _, s, n in cells) / total - centre**2) ** 0.5, 1e-3)
    z = {s: (math.log(s) - centre) / width for _, s, _ in cells}
    words = lambda own, mult, tilt, k: sum(n * s * min(cap, math.exp(mult + tilt * z[s])) * z[s] ** k for s, n in own)

    def root(f, low, high):
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return low

    by = defaultdict(list)
    for source, s, n in cells:
        by[source].append((s, n))

    def multipliers(tilt):
        return {k: root(lambda m, k=k: words(by[k], m, tilt, 0) - targets[k], -30, 30) for k in by if targets[k] < cap * sum(s * n for s, n in by[k])}

    capped = sum(cap * n * s * z[s] for k in by if targets[k] >= cap * sum(s * n for s, n in by[k]) for s, n in by[k])
    tilt = root(lambda t: sum(words(by[k], m, t, 1) for k, m in multipliers(t).items()) + capped + ridge * total * t, -5, 5)
    return multipliers(tilt), tilt


def test_newton_solves_the_dual(spark):
    rng = random.Random(3)
    cells = [(s, size, rng.randrange(1, 40)) for s, sizes in {"a": (3, 20, 90), "b": (40, 900, 5000), "c": (1, 2), "d": (50, 60, 7000)}.items() for size in sizes]
    of = {k: sum(s * n for source, s, n in cells if source == k) for k in "abcd"}
    targets = {"a": 2.2 * of["a"], "b": 0.4 * of["b"], "c": 3.0 * of["c"], "d": 0.9 * of["d"]}
    want, want_tilt = plain_dual(cells, targets)
    frame = spark.createDataFrame(cells, "source string, size long, n long")
    table = spark.createDataFrame([(k, of[k], float(targets[k])) for k in of], "source string, source_size long, target double")
    sources, found = mixing.balance(frame, table)
    got = {r.source: r.multiplier for r in sources.collect()}
    assert abs(found["tilt"] - want_tilt) < 1e-4 and abs(want_tilt) > 0.01
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want) and got["c"] > 50


def test_rates_differ_within_a_source_and_lengths_stay(spark):
    rows = [(i, "w " * (5 if i % 3 else 400), "short" if i % 5 else "long") for i in range(600)] + [(1000 + i, "w " * 900, "long") for i in range(60)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len({round(r.rate, 6) for r in got if r.source == "long"}) > 1
    for source in ("short", "long"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-4 * own[0].target
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


def test_hot_cell_is_split_into_items(spark):
    rows = [(i, "same text of six words here", "hot") for i in range(3_000)] + [(5_000 + i, "w " * 7, "b") for i in range(2_000)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    for source in ("hot", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.005 * own[0].target and len({r.copies for r in own}) <= 2


# chat formatting ---------------------------------------------------------------------------------------------------


@given(st.text(alphabet="<>[]|/\\sINSTSYS_im startend\nabé", max_size=60))
def test_escape_round_trip(text):
    turns = [("user", text), ("assistant", text), (text, text)]
    formatted, spans = cf.lay_out(turns)
    assert cf.read_back(formatted) == turns
    assert [cf.unescape(formatted[a:b]) for a, b in spans] == [text] * (1 + (text == "assistant"))
    assert "</s>" not in cf.escape(text) and "[INST]" not in cf.escape(text)


LAYOUTS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    {"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"instruction": "q", "input": "", "output": "a"},
    {"prompt": "q", "completion": "a", "meta": {"x": [1, 2]}},
    {"prompt": "q", "chosen": "a", "rejected": "b"},
    {"question": "q", "answer": "a"},
    {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]},
    {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]},
]


def test_layouts_become_the_same_turns(spark):
    records = [(i, json.dumps(x)) for i, x in enumerate(LAYOUTS)] + [(90, None), (91, "not json"), (92, '{"other": 1}'), (None, json.dumps(LAYOUTS[0]))]
    got = {r.conv_id: r for r in cf.format_chats(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    for i in [*range(len(LAYOUTS)), None]:
        assert cf.read_back(got[i].formatted) == [("user", "q"), ("assistant", "a")] and got[i].mapping
    assert all(got[i].formatted == "" and got[i].mapping is None for i in (90, 91, 92))
    assert len({got[i].fingerprint for i in range(len(LAYOUTS))}) == len(LAYOUTS)


def test_chat_query_over_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "</s>\\<|im_end|>"), (2, 0, "b", "2"), (2, 0, "a", "1"), (None, 5, "user", "é" * 50_000), (None, 5, "user", "y")]
    records = cf.records_of(spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, record string, said string"))
    found = cf.digests(cf.format_chats(records)).collect()
    got = {r.conv_id: r for r in found}
    assert len(found) == 4 and got[1].n_turns == 3 and got[1].loss_chars == 15 and got[1].mapping == "message parts"
    assert got[1].turns_sha256 == hashlib.sha256("user\n\n\nx\nassistant\n</s>\\<|im_end|>\n".encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"a\n1\nb\n2\n").hexdigest()
    frame = "<|im_start|>user\n<|im_end|>\n"
    assert sorted(r.formatted_chars for r in found if r.conv_id is None) == [1 + len(frame), 50_000 + len(frame)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digests(cf.format_chats(cf.records_of(empty))).count() == 0


def test_layouts_by_id_give_the_same_turns_and_sql_says_so(spark):
    rng = random.Random(6)
    talk = [("system", "s é"), ("user", "[INST] q"), ("assistant", "</s> a"), ("human", "h"), ("gpt", None)]
    rows = [(i, t, *talk[(t + i // 6) % 5]) for i in range(60) for t in range(rng.randrange(1, 6))] + [(65, 0, "user", "q"), (65, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 0, "user", "x"), (-4, 0, "bot", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(cf.OP4_SQL)
    names = [d[0] for d in cursor.description]
    want = [r for r in cursor.fetchall() if r[0] != -1]
    got = cf.digests(cf.format_chats(cf.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.mapping for r in got} == set(cf.WRITTEN)


# quality rules -----------------------------------------------------------------------------------------------------


def test_quality_rules_against_sql_with_nulls(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choice(["alpha", "beta", "gam#ma", "Δelta", "9x"]) + str(rng.randrange(60)) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines += ["Subscribe to our  NEWSLETTER 2024 now and then"] * rng.randrange(1, 3)
        rows.append((i, rng.choice(["\n", "\n\n", " \n"]).join(lines), rng.choice(["h1", "h1", "h2", None])))
    rows += [(900, None, "h1"), (901, "", None), (902, " \t\n", "h2"), (900, "again one two", "h1"), (None, "no id at all", "h1"), (903, "w" * 200_000, "h1"), (904, "a b c " * 40_000, "h2")]
    rows += [(1000 + i, rows[0][1], "h1") for i in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = con.execute(quality_rules.OP6_SQL)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = quality_rules.quality_rules(docs_of(spark, rows)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality_rules.quality_rules(docs_of(spark, [])).count() == 0


def test_cleaned_texts_have_no_boilerplate(spark):
    own = lambda i: "Own " + " ".join(f"{chr(97 + i)}w{k}" for k in range(60))
    rows = [(i, f"Share THIS page {i % 10}\n\n{own(i)}\nAll rights\t reserved 2024\nall RIGHTS reserved 1999", "h") for i in range(15)]
    rows += [(20, "é alone\r\n", "h"), (21, None, "h"), (22, "share this page 7", "h"), (23, "share this page 7", None), (24, f"\nshare this page 0\n{own(0)}\n", "h"), (0, rows[0][1], "h")]
    got = quality_rules.cleaned(docs_of(spark, rows).repartition(3)).collect()
    want = [(i, f"\n{own(i)}") for i in [*range(15), 0]] + [(20, "é alone\r\n"), (21, None), (22, ""), (23, "share this page 7"), (24, f"\n{own(0)}\n")]
    assert sorted(((r.doc_id, r.clean_text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.words_left == len((r.clean_text or "").split()) for r in got) and {r.doc_id for r in got if r.kept} == {*range(15), 24}


# URL filters -------------------------------------------------------------------------------------------------------


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_parts(spark):
    urls = [
        (None, "", ""), ("no scheme", "", ""), ("http://A.Example.COM/en/7?x", "a.example.com", "/en/7"), ("https://example.net/de/81#t", "example.net", "/de/81"),
        ("x://com/en/", "com", "/en/"), ("a://b://c/d", "b:", "//c/d"), ("http://telecom/en/1", "telecom", "/en/1"), ("http://É.org?/es/", "É.org", ""), ("http://b.org/es/" + "x" * 100_000, "b.org", "/es/" + "x" * 100_000),
    ]
    rows = [(i, u, None, "h") for i, (u, _, _) in enumerate(urls)] + [(None, urls[2][0], None, "h")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for i, (_, host, path) in enumerate(urls):
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or "allow")
    assert got[None].rule == "example.com/en/7"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trust_walks_the_links(spark):
    rules = (("allow", "good.test", "/"), ("block", "bad.test", "/"))
    links = {"good.test": ["fine.test", "fine.test"], "fine.test": ["far.test", "loner.test"], "spam.test": ["bad.test", "bad.test", "far.test"], "bad.test": ["good.test"], "loner.test": [], "farm.test": ["SPAM.test"]}
    rows = [(i, f"http://{h}/p", "".join(f'<a class=x HREF="https://{t}/x">' for t in ts) + f'<a href="/local"><a href="//{h}/self"><link href="//bad.test/s.css"><!-- <a href="//bad.test/"> --><a data-href="//bad.test">') for i, (h, ts) in enumerate(links.items())]
    rows += [(50, "http://far.test/", None)]
    got = {r.host: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    hosts = sorted({*links, "far.test"})

    def pagerank(edges, seed):
        rank = {h: float(h == seed) for h in hosts}
        for _ in range(200):
            new, lost = {h: 0.15 * (h == seed) for h in hosts}, 0.0
            for h in hosts:
                out = edges.get(h, [])
                for t in out:
                    new[t] += 0.85 * rank[h] / len(out)
                lost += 0 if out else rank[h]
            new[seed] += 0.85 * lost
            rank = new
        return rank

    forward = {h: [t.lower() for t in ts] for h, ts in links.items()}
    reverse = defaultdict(list)
    for h, ts in forward.items():
        for t in ts:
            reverse[t].append(h)
    trust, distrust = pagerank(forward, "good.test"), pagerank(reverse, "bad.test")
    for h in hosts:
        assert abs(got[h].trust - trust[h]) < 2e-3 / len(hosts) and abs(got[h].distrust - distrust[h]) < 2e-3 / len(hosts)
        if h not in ("good.test", "bad.test"):
            assert got[h].verdict == ("block" if distrust[h] > trust[h] and distrust[h] * len(hosts) >= 1 else "allow")
    assert got["spam.test"].verdict == got["farm.test"].verdict == "block" and got["fine.test"].verdict == "allow"


def test_hot_host_leaves_other_verdicts(spark):
    def pages(hosts):  # host: pages blocked by rule, allowed by rule, without a rule
        paths = [(h, p) for h, ns in hosts.items() for p, n in zip(("bad", "good", "new"), ns, strict=True) for _ in range(n)]
        return spark.createDataFrame([(i, f"http://{h}/{p}", "") for i, (h, p) in enumerate(paths)], "page_id long, url string, html string")

    def verdicts(hosts):
        rows = url_filter.filter_urls(pages(hosts), (("block", "test", "/bad"), ("allow", "test", "/good"))).collect()
        return {r.host: r.verdict for r in rows if r.rule is None}

    hosts = {f"b{i}.test": (5 + i, 0, 4) for i in range(5)} | {"some.test": (4, 0, 6), "mixed.test": (2, 6, 2)} | {f"n{i}.test": (0, 0, 8) for i in range(20)}
    want = {h: "block" if h[0] in "bs" else "allow" for h in hosts}
    assert verdicts(hosts) == want
    assert verdicts(hosts | {"hot.test": (140, 0, 3)}) == want | {"hot.test": "block"}


def test_long_chains_and_hubs_without_broadcasts(spark):
    chain = {f"c{i}.test": [f"c{i + 1}.test"] for i in range(40)} | {"c40.test": ["bad.test"]}
    hub = {f"f{i}.test": ["hub.test"] for i in range(300)} | {"hub.test": ["c3.test", "good.test"], "good.test": ["g.test"], "g.test": []}
    rows = [(i, f"http://{h}/p", "".join(f"<a href=//{t}/>" for t in ts)) for i, (h, ts) in enumerate((chain | hub | {"bad.test": []}).items())]
    edges = [("distrust", t, h, 1.0) for h, t in [(h, ts[0]) for h, ts in chain.items()]]
    ranks = dict(map(tuple, url_filter.walk(
        spark.createDataFrame(edges, "kind string, source string, target string, share double"), spark.createDataFrame([("distrust", "bad.test", 1.0)], "kind string, host string, weight double"), 1e-9
    ).select("host", "rank").collect()))
    scale = sum(0.85**i for i in range(42))
    assert all(abs(ranks[f"c{i}.test"] - 0.85 ** (41 - i) / scale) < 1e-8 for i in range(41))
    loop = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], "kind string, source string, target string, share double")
    around = dict(map(tuple, url_filter.walk(loop, spark.createDataFrame([("t", "a", 1.0)], "kind string, host string, weight double"), 1e-6).select("host", "rank").collect()))
    assert abs(around["a"] - 1 / 1.85) < 1e-5 and abs(around["b"] - 0.85 / 1.85) < 1e-5  # mass that goes round for ever
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = "page_id long, url string, html string, rule string, verdict string, trust int, distrust string"
        frame = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], columns)
        got = {r.host: r.verdict for r in url_filter.filter_urls(frame, (("allow", "good.test", "/"), ("block", "bad.test", "/"))).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got["c40.test"] == got["c30.test"] == "block" and got["g.test"] == got["f7.test"] == "allow"


def test_links_alone_decide_and_say_so(spark, tmp_path):
    """A generated link table of 300 hosts against plain PageRank: most verdicts hang on ranks that links brought."""
    rng = random.Random(12)
    hosts = [f"h{i}.test" for i in range(300)]
    links = {h: [rng.choice(hosts[:150] if i < 150 else hosts[150:]) for _ in range(rng.randint(0, 5))] for i, h in enumerate(hosts)}
    rows = [(i, f"http://{h}/{'good' if i < 5 else 'bad' if i >= 295 else 'x'}", "".join(f"<a href=//{t}/>" for t in ts)) for i, (h, ts) in enumerate(links.items())]
    got = {r.host: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), (("allow", "test", "/good"), ("block", "test", "/bad"))).collect()}

    def pagerank(edges, seeds):
        mass, rank = {h: 1 / len(seeds) for h in seeds}, Counter()
        while sum(mass.values()) > 1e-9:
            rank.update(mass)
            mass = {h: 0.85 * m for h, m in mass.items()}
            moved = Counter()
            for h, m in mass.items():
                for t in edges[h]:
                    moved[t] += m / len(edges[h])
            mass = moved
        return {h: m / sum(rank.values()) * len(seeds) for h, m in rank.items()}

    forward = {h: [t for t in ts if t != h] for h, ts in links.items()}
    reverse = defaultdict(list)
    for h, ts in forward.items():
        for t in ts:
            reverse[t].append(h)
    trust, distrust = pagerank(forward, hosts[:5]), pagerank(reverse, hosts[295:])
    unsure = 0
    for i, h in enumerate(hosts[5:295]):
        t, d = trust.get(h, 0), distrust.get(h, 0)
        assert abs(got[h].trust - t) < 1e-4 and abs(got[h].distrust - d) < 1e-4
        assert got[h].decided_by == ("links" if t or d else "nothing")
        if abs(t - d) > 1e-4 and abs(d * 300 - 5) > 1e-2:
            assert got[h].verdict == ("block" if d > t and d * 300 >= 5 else "allow")
        else:
            unsure += t > 0 or d > 0
    by = Counter(r.decided_by for r in got.values())
    assert by["rule"] == 10 and by["links"] > 150 and unsure < 10 and 20 < sum(r.verdict == "block" for r in got.values())


# components --------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: find(n) for n in {n for a, b in links if a != b for n in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
