import random
import re
import string

from faultline.llm.components import connected_components
from faultline.llm.near_dedup import near_duplicates, one_of_each_group

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    """(n_shingles, component_id) by doc_id, all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_against_brute_force(spark, docs):
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_graded_copies(spark):
    """A family whose members' similarity runs from 0.4 to 1, with a passage that many others share."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(i % 25):
            words[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    shared = " ".join(f"p{n}" for n in range(60))
    rows += [(2000 + i, shared + " " + " ".join(f"y{r.randrange(10**6)}" for _ in range(30 + i))) for i in range(60)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_exact_threshold(spark):
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:10])), (3, " ".join(a[:9])), (4, "A0 a1"), (5, "a0  a1"), (6, "a0")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(spark, odd, nothing):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_duplicates(nothing).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[7].n_shingles == 1
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_repeated_ids(spark):
    """Rows that share a doc_id are one node: they join what any of them is linked with."""
    r = random.Random(2)
    x, y, z = (" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    near = x + " one more"
    rows = [(5, x), (3, x), (5, y), (4, y), (9, z), (9, z), (8, z), (20, near), (20, None), (30, None), (20, "short"), (7, "short")]
    df = spark.createDataFrame([(i, t, f"{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` string")
    found = near_duplicates(df).collect()
    assert len(found) == len(rows)
    assert {(q.doc_id, q.component_id) for q in found} == {(5, 3), (3, 3), (4, 3), (20, 3), (7, 3), (9, 8), (8, 8), (30, 30)}
    out = one_of_each_group(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(3, x, "1"), (8, z, "6"), (30, None, "9")]
    again = one_of_each_group(spark.createDataFrame([(1, "b", "2"), (1, "a", "3"), (1, "a", "1"), (2, None, "1")], "doc_id long, text string, `a.b` string"))
    assert sorted(map(tuple, again.collect())) == [(1, "a", "1"), (2, None, "1")]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (100, 300), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 61), 100, 200, 300, 400]], "id long")
    found = {r.id: r.component for r in connected_components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100, 400: 400}
