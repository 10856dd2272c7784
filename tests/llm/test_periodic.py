"""Periodic runs against a comparison of every pair of words."""

import hashlib
import random
import zlib
from fractions import Fraction

from attestor.llm import periodic


def brute(x):
    found = {}
    for q in range(1, len(x)):
        i = q
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(80))]
    if kind == 1:
        base, x = [rng.randrange(3) for _ in range(rng.randrange(1, 12))], []
        for _ in range(rng.randrange(1, 5)):
            x += base[:rng.randrange(1, len(base) + 1)] * rng.randrange(1, 9) + [rng.randrange(3)] * rng.randrange(4)
        return x * rng.randrange(1, 6)
    if kind == 2:
        return ([7] * rng.randrange(3) + [0] * rng.randrange(40) + [1] * rng.randrange(3)) * rng.randrange(1, 9)
    x = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
    return [x[i % len(x)] if rng.random() < 0.995 else 9 for i in range(rng.randrange(400))]


def test_runs_equal_all_pairs():
    rng = random.Random(12)
    for _ in range(4000):
        x = made(rng)
        assert periodic.runs(x) == brute(x), x


def test_long_sequences():
    assert periodic.runs([0] * 300_000) == [(0, 300_000, 1)]
    assert periodic.runs(list(range(2000)) * 60) == [(0, 120_000, 2000)]
    blocks = periodic.runs(([0] * 100 + [1]) * 50)
    assert blocks == sorted([(0, 5050, 101)] + [(101 * k, 100, 1) for k in range(50)], key=lambda r: (r[0], r[2]))
    assert periodic.runs(range(500_000)) == []


def test_limits_of_a_run():
    assert periodic.runs("aaaaa") == [] and periodic.runs("aaaaaa") == [(0, 6, 1)]
    assert periodic.runs("abababa") == [] and periodic.runs("abababab") == [(0, 8, 2)]
    assert periodic.runs("xabababay") == [] and periodic.runs("abcabcabcabc") == [(0, 12, 3)]
    assert periodic.runs("") == periodic.runs("a") == []


def by_hand(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_digest_find_and_clean(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(60)))) for i in range(-40, 200)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b\x0c\r "), (1003, "one"), (None, "a " * 50), (None, None), (1004, "é\u00a0x " * 9 + "y"),
             (1005, "w1 w2 w3\n" * 4000), (1005, "w1 w2 w3\n" * 4000), (1006, "A a " * 10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    more = df.selectExpr("*", "1 AS n_runs", "'x' AS start", "doc_id AS period")
    assert sorted(map(tuple, periodic.digest(more).collect()), key=repr) == sorted((by_hand(*r) for r in rows), key=repr)
    assert sum(by_hand(*r)[1] > 0 for r in rows[:240]) > 10
    assert periodic.digest(df.limit(0)).collect() == []
    assert [tuple(r) for r in periodic.find(df.filter("doc_id = 1006")).collect()] == [(1006, 0, 20, 2, "A a")]
    cleaned = {r.doc_id: r.text for r in periodic.clean(df).collect()}
    assert cleaned[1005] == "w1 w2 w3" and cleaned[1002] == rows[242][1] and cleaned[1000] is None and cleaned[1004] == "é\u00a0x y"
