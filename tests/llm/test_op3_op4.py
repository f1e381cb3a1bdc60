import numpy as np
import pytest

from prefsight.llm import op3_redirect_filter as U
from prefsight.llm import op4_rotation_codes as V


def judged(spark, rows, rules=U.RULES, redirects=None):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    return {r["page_id"]: r for r in U.filter_urls(frame, rules, redirects).collect()}


def test_rules_and_hosts(spark):
    got = judged(spark, [
        (1, "https://a.ORG/x?y#z", None), (2, "http://www.example.org/es/1", ""), (3, "http://example.org/en/12", ""),
        (4, "http://org", None), (5, "http://x.com/de/1", None), (6, "http://notorg/x", None), (7, None, None),
        (8, "no scheme", "<link rel=canonical href='http://x.com/de/'>"), (9, "://h.com/fr/", None),
        (10, "http://example.org/en/2", None), (1, "https://a.ORG/x?y#z", None)])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(1, 8)] == [
        ("a.org", "/x", "org/", "allow"), ("www.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("org", "", None, "allow"),
        ("x.com", "/de/1", "com/de/", "block"), ("notorg", "/x", None, "allow"), ("", "", None, "allow")]
    assert (got[8]["host"], got[8]["rule"], got[8]["verdict"]) == ("", None, "block")
    assert (got[9]["host"], got[9]["rule"]) == ("h.com", "com/fr/")
    assert got[10]["rule"] == "org/"


def test_blocks_spread_over_aliases_and_allow_has_precedence(spark):
    link = '<html><head><LINK class="a" REL="canonical" href="{}"></head>'
    rows = [(1, "http://a.net/1", link.format("http://b.net/2?x=1&amp;y=2")),
            (2, "https://b.net/2?x=1&y=2&utm_source=q", link.format("http://c.com/de/3")),
            (3, "http://d.net/", '<meta http-equiv="refresh" content="0; URL=\'http://e.net/\'">'),
            (4, "http://www.e.net/index.html#top", link.format("//c.com/fr/9")),
            (5, "http://e.net", link.format("http://c.com/de/9")),
            (6, "http://f.net/a/b", link.format("c")), (7, "http://f.net/a/c", link.format("/de")),
            (8, "http://lone.net/", None)]
    moved = spark.createDataFrame([("http://f.net/de", "http://x.com/de/"), (None, "http://y"), ("http://lone.net/", None)],
                                  "src string, dst string")
    got = judged(spark, rows, redirects=moved)
    assert [got[i]["verdict"] for i in range(1, 9)] == ["block", "block", "allow", "allow", "allow", "block", "block",
                                                       "allow"]
    assert got[1]["alias_group"] == got[2]["alias_group"] != got[3]["alias_group"] == got[5]["alias_group"]


def test_urls_empty_and_no_rules(spark):
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://x.com/de/", None)], rules=())[1]["verdict"] == "allow"


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, "http://x.com/de/", "")], "page_id long, url string, html string")
    plan = U.filter_urls(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, out = [], []
    for label in (0, 1, None):
        base = rng.standard_normal((60, 24))
        for i, b in enumerate(base):
            rows.append((label, b))
            for scale in (0.05, 0.15, 0.3, 0.36, 0.4, 0.45)[: i % 7]:
                rows.append((label, b * 3 + scale * 3 * rng.standard_normal(24)))
            if i % 5 == 0:
                rows.append((label, b))
    family = rng.standard_normal(24)
    rows += [(2, family + 0.33 * rng.standard_normal(24)) for _ in range(150)]
    for i, (label, v) in enumerate(rows):
        out.append((i, label, [float(x) for x in v]))
    n = len(out)
    out += [(n, 0, None), (n + 1, 0, []), (n + 2, 0, [0.0] * 24), (n + 3, 0, [float("nan")] * 24),
            (n + 4, 0, [None] + [1.0] * 23), (n + 5, 0, [1.0, 2.0]), (n + 6, 0, [1.0, 2.0]), (n + 7, 0, [1e200, 2e200])]
    return out


def brute(rows):
    links = {i: [] for i, _, _ in rows}
    good = [(i, label, np.array(v, float)) for i, label, v in rows
            if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for x, (i, a, u) in enumerate(good):
        for j, b, w in good[x + 1:]:
            if a == b and len(u) == len(w):
                u1, w1 = u / np.abs(u).max(), w / np.abs(w).max()
                if u1 @ w1 / np.linalg.norm(u1) / np.linalg.norm(w1) >= 0.93:
                    links[i].append(j)
                    links[j].append(i)
    root = {}
    for i in sorted(links):
        stack = [i] if i not in root else []
        while stack:
            at = stack.pop()
            if at not in root:
                root[at] = i
                stack += links[at]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("block", [1024, 32])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, kept string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.vector_links(frame).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    links, all_links = sum(n for n, _, _ in got.values()), sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and links >= 0.99 * all_links
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_estimate_is_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    plan = V.Plan(10_000)
    q = rng.standard_normal((40, 64))
    x = V._unit(np.concatenate([q, q + 0.25 * rng.standard_normal((40, 64)), rng.standard_normal((300, 64))]))
    signs, factors = plan.codes(x)
    true = x[:40] @ x.T
    turned = np.einsum("nd,kde->nke", x[:40], plan.rotations(64))
    parts = np.einsum("nke,mke->nmk", turned, np.where(signs, 1, -1)) / 8 / factors[None]
    error = parts.mean(axis=2) - true
    bound = V.BOUND * np.sqrt(((1 - factors**2) / factors**2 / 63).sum(axis=1)) / factors.shape[1]
    far = ~np.eye(40, len(x), dtype=bool)
    assert abs(error[far].mean()) < 0.005
    assert (np.abs(error) <= bound[None, :] + 1e-9)[far].mean() > 0.999
    a, b, exact = V.Estimates(x, signs, factors, plan).near_pairs(np.arange(40), np.arange(len(x)))
    want = {(i, j) for i, j in zip(*np.nonzero(true >= 0.93), strict=True)}
    assert {(int(i), int(j)) for i, j in zip(a, b, strict=True)} == want
    assert exact < 0.2 * true.size


def test_vectors_empty_and_null_ids(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert V.vector_links(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, [1.0, 0.0]), (4, 1, [1.0, 0.0]), (4, 1, [1.0, 0.01]), (9, 1, [2.0, 0.0])]
    got = sorted((tuple(r) for r in V.vector_links(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 0, None, None)]
