import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import op6_urls as urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
    fits = [(r, v) for r, v in RULES if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


@given(st.lists(st.text(alphabet="aE:/?#.x\n", max_size=15) | st.builds(
    lambda s, h, p: s + h + p, st.sampled_from(["http://", "HTTPS://", "://", "x"]),
    st.sampled_from(["a.example.net", "net", "xnet", "EXAMPLE.com", "b.org", ""]), st.sampled_from(["", "/", "/en/1", "/de/", "/fr/x?y", "/fr#/"])),
    min_size=30, max_size=30))
@settings(max_examples=2, deadline=None)
def test_parsing_and_rules(spark, addresses):
    rows = urls.judge(spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string"), RULES).collect()
    for r in rows:
        host, path, rule, verdict = plain(addresses[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def brute(pages):
    """(id, url, bad) -> id -> (verdict, template), by a tree walked node by node."""
    tree, shapes = defaultdict(list), {}
    for i, url, bad in pages:
        host, path, rule, verdict = plain(url)
        parts = ["*" if re.search("[0-9]", s) or len(s) > urls.LONG else s for s in path.split("/") if s]
        shapes[i] = (host, tuple(parts[:urls.DEPTH] + (["**"] if len(parts) > urls.DEPTH else [])), bad if bad is not None else
                     None if verdict is None else verdict == "block", verdict)
    names = {}

    def walk(host, node, level, members):
        branches = defaultdict(list)
        for i in members:
            if len(shapes[i][1]) > level:
                branches[shapes[i][1][level]].append(i)
            else:
                names[i] = (host, node)
        rows, merged, ranked = sum(map(len, branches.values())), defaultdict(list), []
        for seg, own in branches.items():
            labels = [shapes[i][2] for i in own if shapes[i][2] is not None]
            if seg == "**" or seg == "*" or len(own) < urls.RARE * rows:
                merged[seg if seg == "**" else "*"] += own
            elif labels:
                ranked.append((sum(labels) / len(labels), seg, len(labels)))
            else:
                merged[seg] += own
        runs = []
        for p, seg, n in sorted(ranked):
            if runs:
                q, _, m = runs[-1][-1]
                pool = (p * n + q * m) / (n + m)
                if p - q <= urls.SIMILAR * (pool * (1 - pool) * (1 / n + 1 / m)) ** 0.5:
                    runs[-1].append((p, seg, n))
                    continue
            runs.append([(p, seg, n)])
        for k, run in enumerate(runs):
            for _, seg, _ in run:
                merged[f"({k})" if len(run) > 1 else seg] += branches[seg]
        for name, own in merged.items():
            walk(host, f"{node}/{name}", level + 1, own)

    for i, s in shapes.items():
        tree[s[0]].append(i)
    for host, members in tree.items():
        walk(host, "", 0, members)
    known = [s[2] for s in shapes.values() if s[2] is not None]
    overall = (sum(known) + 1) / (len(known) + 2)
    out = {}
    for i, (host, _, _, verdict) in shapes.items():
        labels = [shapes[k][2] for k, v in names.items() if v == names[i] and shapes[k][2] is not None]
        of_host = [shapes[k][2] for k in tree[host] if shapes[k][2] is not None]
        share = (sum(of_host) + urls.SMOOTH * overall) / (len(of_host) + urls.SMOOTH)
        bad = len(labels) >= urls.MIN_LABELS and (sum(labels) + urls.SMOOTH * share) / (len(labels) + urls.SMOOTH) >= urls.REJECT
        out[i] = (verdict or ("block" if bad else "allow"), names[i][1])
    return out


def test_tree_equals_brute_force(spark):
    pages = []
    for k in range(1200):
        kind = ["ads", "promo", "news", "blog", "tag", "shop"][k % 6]
        url = f"http://{'big' if k % 3 else 'small'}.example.com/{kind}/{['x', 'y', str(k)][k % 3]}" + "/a/b/c/d" * (k % 50 == 0)
        bad = None if k % 7 == 0 or kind == "tag" else kind in ("ads", "promo") or k % 400 == 0
        pages.append((k, url, bad))
    pages += [(2000 + k, f"http://big.example.com/slug-{chr(97 + k)}", None) for k in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, bad boolean")
    got = {r.page_id: (r.verdict, r.template) for r in urls.judge(df, RULES, bad=F.col("bad")).collect()}
    assert got == brute(pages)
    assert {v for v, _ in got.values()} == {"allow", "block"} and sum(t.startswith("/(") for _, t in got.values()) > 100


def test_words_that_vary_at_a_small_node(spark):
    """Slugs of words, once or twice each, share a template with their labelled siblings; paths are told apart at any depth."""
    name = lambda k: "".join(chr(97 + int(d)) for d in str(100 + k))
    pages = [(k, f"http://h/promo/{name(k)}", True if k < 50 else None) for k in range(60)]
    pages += [(100 + k, f"http://h/offer/{name(k // 2)}", True if k < 50 else None) for k in range(60)]
    pages += [(200 + k, f"http://h/a/b/c/d/e/{'bad' if k % 2 else 'good'}/f/{k}", bool(k % 2) if k < 30 else None) for k in range(40)]
    pages += [(300 + k, f"http://h/about/{x}", None) for k, x in enumerate(["team", "imprint"])]
    df = spark.createDataFrame(pages, "page_id long, url string, bad boolean")
    got = {r.page_id: (r.verdict, r.template) for r in urls.judge(df, RULES, bad=F.col("bad")).collect()}
    assert {got[k][0] for k in range(60)} == {got[100 + k][0] for k in range(60)} == {"block"}
    assert {got[200 + k][0] for k in range(0, 40, 2)} == {"allow"} and {got[201 + k][0] for k in range(0, 40, 2)} == {"block"}
    assert {got[300 + k] for k in range(2)} == {("allow", "/about/team"), ("allow", "/about/imprint")}


def test_edge_cases(spark):
    rows = [(None, None, "x"), (1, None, "x"), (1, "http://a.net/x", "x"), (1, "http://a.net/x", None), (2, "http://h/" + "a/" * 20000, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(df, RULES).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got) == [
        ("1", "", "allow"), ("1", "a.net", "block"), ("1", "a.net", "block"), ("2", "h", "allow"), ("None", "", "allow")]
    assert urls.judge(df.limit(0), RULES).collect() == []
