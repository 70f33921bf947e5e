"""Components, near duplicates, mixing and URL rules against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import clashing, documents

from strataledger.llm import components, embedding_dedup, minhash, mixing, url_filter
from strataledger.llm.queries import URL_RULES


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(k, (k * 7 + 3) % 90) for k in range(0, 90, 2)], [(1, None), (2, 3), (3, 2)]])
def test_components(spark, links):
    got = dict(components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect())
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == reach({x for e in real for x in e}, real)


# ---------------------------------------------------------------- MinHash


def shingle_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def near_corpus(rng):
    word = lambda: "w" + str(rng.randrange(5000))
    common = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four five"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(30, 150))]
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(common + [word() for _ in range(40)]))  # a shared passage, below the limit
    seed = [word() for _ in range(120)]
    for _ in range(60):  # a large group, many of whose members are not near each other
        copy = list(seed)
        for k in rng.sample(range(120), rng.randrange(2, 6)):
            copy[k] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(9000))] * 3
    return [(k * 3 + 1, t, "s") for k, t in enumerate(texts)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = near_corpus(rng)
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t, _ in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    docs = clashing(documents(spark, rows)).repartition(5)
    found = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = minhash.deduplicate(documents(spark, rows))
    assert kept.count() == len(set(want.values())) and kept.columns == documents(spark, []).columns


def test_small_blocks_lose_nothing(spark, monkeypatch):
    """Postings dealt out as many block pairs give the same components."""
    rows = near_corpus(random.Random(12))
    docs = documents(spark, rows)
    want = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_large_postings_go_by_their_rarest_shingles(spark, monkeypatch):
    """Texts that share a passage of over half their words, some of them near each other besides, in chains that no hub sees."""
    rng = random.Random(15)
    passage = [f"p{k}" for k in range(110)]
    rows = []
    for k in range(70):
        own = [f"o{k}x{j}" for j in range(60)]
        rows.append((3 * k + 1, " ".join(passage + own), "s"))
        if k % 3 == 0:  # a chain: each near the one before, not to the first
            for step in range(1, 4):
                own = [f"c{k}s{step}x{j}" if j // 9 == step else w for j, w in enumerate(own)]
                rows.append((1000 + 10 * k + step, " ".join(passage + own), "s"))
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t, _ in rows}
    want = reach(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert 70 <= len(set(want.values())) < len(rows)
    seen = []
    whole = minhash._by_rarest
    monkeypatch.setattr(minhash, "_by_rarest", lambda *a: seen.append(1) or whole(*a))
    monkeypatch.setattr(minhash, "LARGE", 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == want and seen


def test_a_hub_in_many_parts(spark, monkeypatch):
    """Copies of one long text are confirmed part by part, with the same result."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = []
    for k in range(90):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{k}"
        rows.append((k + 1, " ".join(copy), "s"))
    rows += [(500 + k, " ".join(f"u{k}v{j}" for j in range(30)), "s") for k in range(5)]
    monkeypatch.setattr(minhash, "STAR", 7)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: 1 if i <= 90 else i for i, _, _ in rows}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "s"), (4, "A B C d e f", "s"), (4, "a b c d e f", "s"), (9, None, None), (9, None, None), (None, "", "s"), (None, "p q r s t", "s"), (None, "p q r s t", "s")]
    found = minhash.near_duplicates(documents(spark, rows)).collect()
    by = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found)
    assert by == {(None, 2, 4, False): 1, (4, 2, 4, True): 2, (9, 0, 9, True): 2, (None, 0, None, True): 1, (None, 1, None, True): 2}
    kept = documents(spark, [(None, "q r", "b"), *rows, (None, "q r", "a"), (None, "q r", "c")])
    for parts in (3,):  # one of each group, every row without words; of rows alike in id and text the first as JSON
        got = Counter((r["doc_id"], r["text"], r["source"]) for r in minhash.deduplicate(kept.repartition(parts)).collect())
        assert got in [{(4, t, "s"): 1, (9, None, None): 2, (None, "", "s"): 1, (None, "p q r s t", "s"): 1, (None, "q r", "a"): 1} for t in ("A B C d e f", "a b c d e f")]
    named = spark.createDataFrame([("-", "one two", "s"), (None, "one two", "s"), ("x", None, "s"), ("x", "", "s"), ("", "k l", "s"), (None, "-", "s")], "doc_id string, text string, source string")
    assert Counter((r["doc_id"], r["text"]) for r in minhash.deduplicate(named).collect()) == {("-", "one two"): 1, ("x", None): 1, ("x", ""): 1, ("", "k l"): 1, (None, "-"): 1}
    assert minhash.near_duplicates(documents(spark, [])).count() == 0 and minhash.deduplicate(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- embeddings


def vectors(rng, n, dim):
    out = [rng.standard_normal(dim) for _ in range(n)]
    for base in out[: n // 4]:
        for _ in range(4):
            noise = rng.standard_normal(dim)
            out.append(base + noise / np.linalg.norm(noise) * np.linalg.norm(base) * rng.uniform(0.02, 0.3))
        out.append(base.copy())
    return out


@pytest.mark.parametrize("dim", [64, 100, 12])
def test_vector_links_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    data = [[float(x) for x in v] for v in vectors(rng, 160, dim)]
    rows = [(k * 2, v) for k, v in enumerate(data)]
    rows += [(1001, None), (1003, []), (1005, [0.0] * dim), (1007, [float("nan")] + [1.0] * (dim - 1)), (1009, [None] + [1.0] * (dim - 1)), (1011, [float("inf")] + [1.0] * (dim - 1)), (1013, [1.0, 2.0]), (1015, [1.0, 2.0])]
    units = np.array([np.array(v) / np.linalg.norm(v) for v in data])
    close = (units @ units.T >= 0.95) & ~np.eye(len(data), dtype=bool)
    links = [(2 * a, 2 * b) for a, b in zip(*np.nonzero(close), strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rep": F.lit(1), "code": F.lit(2), "unit": F.lit("x"), "label": F.lit(0)})
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(found) == len(rows)
    n_found, n_true = sum(found[2 * k]["n_links"] for k in range(len(data))), int(close.sum())
    assert all(found[2 * k]["n_links"] <= close[k].sum() for k in range(len(data)))
    assert n_found >= 0.9 * n_true, (n_found, n_true)
    want = reach([2 * k for k in range(len(data))], links)
    assert sum(found[i]["component_id"] == c for i, c in want.items()) >= 0.95 * len(want)
    for i in (1001, 1003, 1005, 1007, 1009, 1011):
        assert tuple(found[i])[1:] == (0, i, True)
    assert found[1013]["n_links"] == found[1015]["n_links"] == 1 and not found[1015]["kept"]


def test_copies_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(32)
    near = [[float(x) for x in base + rng.standard_normal(32) * 0.02] for _ in range(50)]
    rows = [(k, near[0]) for k in range(30)] + [(100 + k, v) for k, v in enumerate(near)] + [(None, near[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 9)
    found = embedding_dedup.near_duplicate_vectors(df).collect()
    assert {r["n_links"] for r in found} == {len(rows) - 1} and {r["component_id"] for r in found} == {0}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((800, 64)) @ rng.standard_normal((64, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ones = (x @ embedding_dedup.learn_rotation(x) >= 0).mean(axis=0)
    assert ones.shape == (64,) and abs(ones - 0.5).max() < 0.15


def at_cosine(rng, x, cosine):
    noise = rng.standard_normal(len(x))
    noise -= (noise @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


@pytest.mark.parametrize("skewed", [False, True])
def test_recall_by_bands_from_the_limit_up(spark, skewed):
    """Pairs made at chosen cosines, the first band exactly at the limit: each is found, bar a few; with exact all are."""
    rng = np.random.default_rng(8)
    bands = (0.9500001, 0.952, 0.96, 0.98)
    scale, shift = (1 / np.sqrt(np.arange(1, 49)), np.r_[1.0, np.zeros(47)]) if skewed else (np.ones(48), np.zeros(48))
    data = []
    for k in range(1200):
        x = rng.standard_normal(48) * scale + shift
        x /= np.linalg.norm(x)
        data += [x, at_cosine(rng, x, bands[k % 4])]
    units = np.array(data)
    close = (units @ units.T >= 0.95) & ~np.eye(len(units), dtype=bool)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert all(found[k] <= close[k].sum() for k in found)
    if not skewed:  # else vectors have other neighbours too
        for band in range(4):
            got = [found[2 * k] for k in range(1200) if k % 4 == band]
            assert sum(got) >= 0.95 * len(got), (band, sum(got))
    assert sum(found.values()) >= 0.95 * close.sum()
    whole = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicate_vectors(df, exact=True).collect()}
    groups = reach(range(len(data)), list(zip(*map(list, np.nonzero(close)), strict=True)))
    assert whole == {k: (close[k].sum(), groups[k]) for k in range(len(data))}


def test_keys_widen_with_the_number_of_vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    layouts = [embedding_dedup.choose_layout(x, n) for n in (10**3, 10**6, 10**9)]
    widths = [2 * layout.width for layout in layouts]
    assert widths == sorted(widths) and widths[0] < widths[-1]
    assert all(layout.recall >= embedding_dedup.RECALL and len(layout.tables) <= embedding_dedup.TABLES for layout in layouts)


# ---------------------------------------------------------------- mixing


def filled(sizes, weights, epochs):
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        free = {s: w for s, w in weights.items() if s not in clamped}
        target = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s, t in target.items() if t > epochs * sizes[s]}
        if not over:
            return target | {s: epochs * sizes[s] for s in clamped}
        clamped |= over


def test_targets_equal_step_by_step_filling(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 10, 500, 100_000]) + rng.randrange(50) for k in range(9)}
        weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes))}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.water_fill(mixing.cyclic_weights(df, (5.0, 2.0, 1.0))).collect()}
        want = filled(sizes, weights, 3.0)
        assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def mixable(rng):
    rows = [(k, " ".join("w" for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice(["big"] * 6 + ["b", "c", "d", None])) for k in range(600)]
    return rows + [(900, None, "b"), (901, "", "b"), (None, "x y", "c"), (902, "x y z", "tiny"), (902, "x y z", "tiny"), (903, None, "nothing")]


def test_mix_takes_near_its_targets(spark):
    rows = mixable(random.Random(2))
    docs = clashing(documents(spark, rows)).repartition(6)
    plan = [r.asDict() for r in mixing.plan_mix(docs).collect()]
    assert len(plan) == len(rows) and all(r["repeats"] in (0, 1, 2, 3) for r in plan)
    taken, target, sizes = defaultdict(int), {}, defaultdict(int)
    for r in plan:
        taken[r["source"]] += r["size"] * r["repeats"]
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert target["nothing"] == 0
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(8, 0.01 * t), (s, taken[s], t)
    again = sorted((r["doc_id"] or -1, r["repeats"]) for r in mixing.plan_mix(docs.repartition(3)).collect())
    assert again == sorted((r["doc_id"] or -1, r["repeats"]) for r in plan)
    other = sorted((r["doc_id"] or -1, r["repeats"]) for r in mixing.plan_mix(docs, seed=1).collect())
    assert other != again
    mixed = Counter(r["doc_id"] for r in mixing.mix(documents(spark, rows)).collect())
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["repeats"]
    assert mixed == +want
    assert mixing.plan_mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    empty = mixing.plan_mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["target"], r["repeats"]) for r in empty] == [(0.0, 0), (0.0, 0)]


# ---------------------------------------------------------------- URLs


def page(k, url, html=""):
    return (k, url, html)


def test_rules_and_aliases(spark):
    link = lambda u: f'<head><link data-x="1" rel="canonical" href="{u}"></head>'
    refresh = lambda u: f"<META HTTP-EQUIV='refresh' content='0; URL={u}'>"
    rows = [
        page(1, "https://a.Example.org/es/x?q=1"), page(2, "http://example.org/en/12"), page(3, "http://example.org/en/2"), page(4, "https://notexample.org/es/1"), page(5, "http://x.com/de/1"), page(6, "http://x.com/fr/1"),
        page(7, "http://alias.net/1", link("https://b.com/de/9")),  # canonical of a blocked address that is no page here
        page(8, "http://alias.net/2", refresh("/1")), page(9, "http://alias.net/dir/3", f"<p>x</p>{link('../2')}"), page(10, "http://free.net/", link("http://free.net/x")),
        page(11, "http://y.com/fr/7", link("http://z.com/de/7")),  # its own allow stands
        page(12, "http://mid.net/", link("http://y.com/fr/7")),  # an alias is allowed explicitly
        page(13, "http://alias.net/1#frag"), page(14, None, link("http://z.com/de/7")), page(15, "no scheme", link("http://z.com/de/7")), page(16, "", None), page(17, "http://b.com/de/9#x"), page(18, "ftp://alias.net/1", None), page(1, "https://a.Example.org/es/x?q=1"),
        page(19, "http://rel.net/dir/a", link("b")), page(20, "http://rel.net/dir/b", link("http://q.com/de/")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "path": F.lit("y"), "rule": F.lit(1), "verdict": F.lit(2), "node": F.lit(3)})
    got = defaultdict(set)
    for r in url_filter.judge_urls(df, URL_RULES).collect():
        got[r["page"]["page_id"]].add((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == {("a.example.org", "/es/x", "example.org/es/", "block")}
    assert got[2] == {("example.org", "/en/12", "example.org/en/1", "block")} and got[3] == {("example.org", "/en/2", "org/", "allow")}
    assert got[4] == {("notexample.org", "/es/1", "org/", "allow")} and got[5] == {("x.com", "/de/1", "com/de/", "block")}
    assert got[6] == {("x.com", "/fr/1", "com/fr/", "allow")}
    verdict = {k: next(iter(v))[3] for k, v in got.items()}
    assert [verdict[k] for k in (7, 8, 10, 11, 12, 13, 17, 18, 19, 20)] == ["block", "block", "allow", "allow", "allow", "block", "block", "block", "block", "block"]
    for k in (14, 15, 16):
        assert got[k] == {("", "", None, "allow")}
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    more = spark.createDataFrame([("http://free.net/", "http://k.com/de/")], "src_url string, dst_url string")
    assert {r["page"]["page_id"]: r["verdict"] for r in url_filter.judge_urls(df, URL_RULES, more).collect()}[10] == "block"
    assert {r["verdict"] for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_longest_rule_wins_over_many(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org"]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/a", "/ab/", "/b") if rng.random() < 0.7]
    urls = [f"http://{rng.choice(['', 'w.', 'b.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/ab/c', '/b?x', '/a#y'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.judge_urls(df, rules).collect():
        fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fits, default=None)
        assert (r["rule"], r["verdict"]) == ((best[2], best[3]) if best else (None, "allow"))


def test_very_many_rules_equal_brute_force(spark):
    """A hundred thousand rules, three quarters of them on one host: nothing is left out."""
    rng = random.Random(6)
    rules = [(rng.choice(["allow", "block"]), "hot.com" if k % 4 else f"h{k % 997}.org", f"/{k % 50_021}/{'x' * (k % 7)}") for k in range(100_000)]
    rules += [("block", "com", "/4"), ("allow", "org", "/"), ("block", "hot.com", "/17"), ("allow", "hot.com", "/17")]
    urls = [f"https://{rng.choice(['', 'a.', 'a.b.'])}{rng.choice(['hot.com', f'h{rng.randrange(1100)}.org'])}/{rng.randrange(60_000)}/{'x' * rng.randrange(9)}y" for _ in range(400)]
    urls += ["https://hot.com/17", None, "", "https://other.net/1/"]
    best = {}
    for verdict, host, path in rules:
        best[host, path] = "allow" if "allow" in (verdict, best.get((host, path))) else verdict
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for r in url_filter.judge_urls(df, table).collect():
        labels, path = r["host"].split("."), r["path"]
        fits = [(len(h) + n, v == "allow", h + path[:n], v) for k in range(len(labels)) for n in range(len(path) + 1) for h in [".".join(labels[k:])] if (v := best.get((h, path[:n])))]
        top = max(fits, default=None)
        assert (r["rule"], r["verdict"]) == ((top[2], top[3]) if top else (None, "allow"))
