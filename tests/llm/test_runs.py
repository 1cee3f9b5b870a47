import hashlib
import random
import re
import zlib

from sightline.llm import op11_runs as runs


def brute_runs(w):
    """Every maximal stretch of smallest period q, at least max(24, 3q) long, by trying every period."""
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q):
                smallest = next(t for t in range(1, q + 1) if all(w[k] == w[k + t] for k in range(s, e - t)))
                if smallest == q:
                    out.add((s, e - s, q))
            i = j
    return sorted(out)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *head, hashlib.sha256(listing.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(words) if i not in dropped).encode()).hexdigest())


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(7)
    docs = []
    for _ in range(300):
        n = rng.randint(0, 260)
        w = [str(rng.randrange(rng.choice([1, 2, 3, 7, 40]))) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 5:
                a, p = rng.randrange(n), rng.randint(1, 25)
                for i in range(a + p, min(n, a + rng.randint(0, 200))):
                    w[i] = w[i - p]
        docs.append(w)
    # One batch of many documents: suffixes of different documents never meet.
    assert runs.find_runs(docs) == [brute_runs(w) for w in docs]


def test_min_level_is_the_proven_bound():
    assert runs.MIN_LEVEL == 16


def test_query_rows_equal_brute_force_with_edge_cases(spark, edge_docs, no_docs):
    rng = random.Random(3)
    extra = [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(20, 120))), "en", "s", 0, "x", "y", "z")
             for i in range(30)]
    # crc32 of these ids ends in 0, so their words get the planted period.
    planted = [i for i in range(1000, 9000) if (h := zlib.crc32(str(i).encode())) % 10 == 0 and (h // 10) % 300 < 200][:5]
    extra += [(i, " ".join(f"w{k}" for k in range(300)), "en", "s", 0, "x", "y", "z") for i in planted]
    df = edge_docs.unionByName(spark.createDataFrame(extra, edge_docs.schema))
    got = [tuple(r) for r in runs.periodic_runs(df).collect()]
    # Brute force is quadratic: the two long texts of the edge cases (ids 7, 8) are left to the test below.
    want = [brute_row(r.doc_id, r.text) for r in df.collect() if r.doc_id not in (7, 8)]
    assert sorted(str(g) for g in got if g[0] not in (7, 8)) == sorted(map(str, want))
    by_id = {r[0]: r for r in got if r[0] in planted}
    assert all(by_id[i][1] >= 1 for i in planted)
    assert runs.periodic_runs(no_docs).count() == 0


def test_ties_of_best_run_take_the_smallest_start():
    w = (["a", "b"] * 20) + ["x"] + (["c", "d"] * 20)
    found = runs.find_runs([w])[0]
    assert found == [(0, 40, 2), (41, 40, 2)]
    assert runs.summary(w, found)[1:4] == (0, 40, 2)


def test_long_text_with_one_block():
    rng = random.Random(11)
    w = [f"t{rng.randrange(10**9)}" for _ in range(40_000)]
    for i in range(10_037, 12_037):
        w[i] = w[i - 37]
    assert runs.find_runs([w]) == [[(10_000, 2_037, 37)]]
