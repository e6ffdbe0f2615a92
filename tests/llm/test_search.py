"""Ranked lexical search and spelling variants: against plain versions, SQL, and on edge cases."""

import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import lexical_search as R
from faultline.llm import oracles, spelling

FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def order(row):
    return tuple((x is None, x) for x in row)


def rows(df):
    return sorted(map(tuple, df.collect()), key=order)


def by_sql(sf, sql, names):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return sorted(con.execute(f"select {names} from ({sql})").fetchall(), key=order)


# --- Ranked search -----------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain_search(docs, items, k=10):
    """Every query against every document."""
    docs = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, total = len(docs), sum(size for _, _, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    for item, text in items:
        found = []
        for i, c, size in docs:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found)[:k], 1):
            yield item, rank, i, -score


def test_search_against_sql(spark, sf, docs):
    expected = by_sql(sf, oracles.RANKED_SEARCH, "item_id, rank, doc_id, score")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert rows(R.ranked_search(docs, items)) == expected and len(expected) > 100
    # Many small segments, and queries in several blocks, give the same.
    with pytest.MonkeyPatch.context() as m:
        m.setattr(R, "QUERY_BLOCK", 7)
        assert rows(R.search(R.index(docs, 500), items)) == expected


def test_search_against_plain(spark, odd, nothing):
    """Ties, copies, repeated terms, terms of all documents, and fewer documents than are asked for."""
    rng = random.Random(3)
    words = [*"abcdefgh", "É", "ß9", "日本", "xY"]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 30)))) for i in rng.sample(range(1000), 300)]
    texts += [(i + 2000, "a a b") for i in range(40)] + [(7, None), (8, ""), (9, "!?"), (None, "a a b"), (2000, "a a b")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(100, None), (101, "zzz"), (None, "A b"), (102, "a"), (102, "h h h É")]
    d, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for k, size in ((10, 100), (3, 20), (500, 10000)):
        assert rows(R.search(R.index(d.repartition(3), size), q, k)) == sorted(plain_search(texts, items, k), key=order)
    found = rows(R.ranked_search(odd, q.union(spark.createDataFrame([(200, "wort same")], "item_id long, text string"))))
    assert found == sorted(plain_search([tuple(r) for r in odd.select("doc_id", "text").collect()], [*items, (200, "wort same")]), key=order)
    assert rows(R.ranked_search(nothing, q)) == [] and rows(R.ranked_search(d, q.limit(0))) == []


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_merge_keeps_the_best(data):
    """However lists, bounds and heaps fall, nothing of the best is left out."""
    n = data.draw(st.integers(1, 25))
    ids = sorted(data.draw(st.lists(st.integers(0, 30), min_size=n, max_size=n)))
    lists = []
    for _ in range(data.draw(st.integers(1, 6))):
        own = sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1)))
        lists.append((data.draw(st.integers(0, 5)), own, data.draw(st.lists(st.integers(0, 9), min_size=len(own), max_size=len(own)))))
    k, before = data.draw(st.integers(1, 5)), data.draw(st.lists(st.tuples(st.integers(1, 40), st.integers(-30, 0)), max_size=5))
    best = sorted(before)[-k:]
    heapq.heapify(best)
    scores = Counter()
    for w, own, shares in lists:
        for d, s in zip(own, shares):
            scores[d] += w * s
    expected = sorted([*best, *((s, -ids[d]) for d, s in scores.items() if s > 0)], reverse=True)[:k]
    R.merge_best(lists, ids, best, k)
    assert sorted(best, reverse=True) == expected


# --- Spelling variants -------------------------------------------------------------------------------------------


def near(v, w):
    if len(v) > len(w):
        v, w = w, v
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w)) == 1
    return len(w) - len(v) == 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))


def plain_spelling(docs):
    """Every word against every other."""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, found = {}, {}
    for w, n in words.items():
        found[w] = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(found[w], default=(0, ""))
        if found[w] and -best[0] >= 5 * n:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root][1]
        yield w, forms[w][1] if w in forms else None, root, n, len(found[w]), -forms[w][0] if w in forms else None


def test_spelling_against_sql(sf, docs):
    expected = by_sql(sf, oracles.SPELLING_VARIANTS, "word, form, root, n, n_near, form_n")
    assert rows(spelling.spelling_variants(docs)) == expected and len(expected) > 500 and any(r[1] for r in expected)


def test_spelling_against_plain(spark, odd, nothing):
    """Every kind of edit at every place, chains of forms, ties, and segments that many words have."""
    rng = random.Random(9)
    words, counts = ["Straßen", "resume", "résumé", "aaaaaa", "aaaaaaa", "abcdef", "Àbcdef", "fedcba" * 4], {}
    for w in words[:]:
        for _ in range(25):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcé÷Z")
            words += rng.sample([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]], 2)
    for j, w in enumerate(["verlag", "verlage", "verlager", "verlagern"]):
        counts[w] = 6 * 5 ** (3 - j)
    words += ["vorn" + "".join(rng.choices("ab", k=5)) for _ in range(60)] + ["".join(rng.choices("ab", k=4)) + "hinten" for _ in range(30)]
    texts = [(i, " ".join([w] * 9 + [w.upper()] * rng.randint(0, 3))) for i, w in enumerate(words)]
    texts += [(1000 + i, "-".join([w] * n)) for i, (w, n) in enumerate(counts.items())] + [(None, "verlag " * 6), (5, None), (6, ""), (7, "12 !"), (7, "kurz " * 9)]
    df, expected = spark.createDataFrame(texts, "doc_id long, text string"), sorted(plain_spelling(texts), key=order)
    for shards, hot in ((None, 20_000), (1, 3), (7, 0)):
        assert rows(spelling.spelling_variants(df.repartition(3), shards, hot)) == expected
    assert any(r[1] != r[2] and r[1] for r in expected)
    assert rows(spelling.spelling_variants(odd)) == sorted(plain_spelling([tuple(r) for r in odd.select("doc_id", "text").collect()]), key=order)
    assert rows(spelling.spelling_variants(nothing)) == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=6, max_size=9), min_size=2, max_size=40))
def test_pairs_of_a_group(words):
    """Of words that share a segment just the near ones are found, each once."""
    own = ["front" + w for w in words]
    assert sorted(spelling.near_in_group(own, own, 5, 0)) == sorted((v, w) for v in own for w in own if near(v, w))
