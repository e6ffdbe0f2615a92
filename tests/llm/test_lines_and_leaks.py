import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_near_dedup import brute

from faultline.llm import decontamination, line_dedup
from faultline.llm._text import SPACE_WORDS, words_of
from faultline.llm.decontamination import decontaminated, leaks, tiles
from faultline.llm.line_dedup import lines_filtered


def words(r, n):
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6):x}" for _ in range(n)).translate(str.maketrans("0123456789", "ghijklmnop"))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of their own words, with a long passage in 12, a form with variable fields in 20, and 30 exact and 10 near copies of one."""
    r = random.Random(4)
    passage, rows = words(r, 60), []
    for i in range(100):
        lines = [words(r, 12) for _ in range(4)]
        if i < 12:
            lines.insert(2, passage)
        if i < 20:
            lines.append(f"Page {i} of {i + 7} printed on 2024-01-{i + 1:02} by user{i} from the archive")
        if 20 <= i < 40:
            lines.append(f"Posted in the category of general news by {words(r, 1)} and other people")
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[50][1]) for i in range(30)]
    rows += [(300 + i, rows[51][1] + "\n" + words(r, 5)) for i in range(10)]
    return passage, spark.createDataFrame(rows, "doc_id long, text string")


def test_recurring_templates_go(corpus):
    passage, df = corpus
    before, after = ({r.doc_id: r for r in x.collect()} for x in (df, line_dedup.line_dedup(df)))
    for i, r in after.items():
        old = before[i].text.split("\n")
        gone = [x for x in old if x == passage or x.startswith(("Page ", "Posted in"))]
        assert r.text.split("\n") == [x for x in old if x not in gone], i
        assert (r.n_lines, r.n_dropped) == (len(old), len(gone))


def test_without_broadcast(corpus, monkeypatch):
    _, df = corpus
    a = line_dedup.line_dedup(df).cache()
    a.count()
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    b = line_dedup.line_dedup(df).cache()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_LINES, 0])
def test_short_sentences_between(spark, monkeypatch, limit):
    """A short sentence between two that recur goes only where the whole run recurs."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    r = random.Random(6)
    first, last, shared = (words(r, 10) + "." for _ in range(3))
    own = [words(r, 4) + "." for _ in range(12)]
    rows = [(i, f"{words(r, 14)}. {first} {own[i]} {last} {words(r, 12)}.") for i in range(12)]
    # The run recurs in three documents, then in two documents that are copies of each other.
    rows += [(20 + i, f"{words(r, 14)}. {first} So it is said. {last} {words(r, 12)}.") for i in range(3)]
    again = f"{words(r, 30)}. {first} Twice the same. {last} {words(r, 30)}."
    rows += [(30 + i, again) for i in range(4)]
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(own[i] in got[i].text and first not in got[i].text and last not in got[i].text for i in range(12))
    assert all("So it is said." not in got[20 + i].text and got[20 + i].n_dropped == 2 for i in range(3))
    assert all("Twice the same." in got[30 + i].text for i in range(4))


def test_exact_families(corpus, docs):
    """Families by all links: the same on documents whose copies stars find, and on the corpus."""
    for df in (corpus[1], docs):
        a, b = (sorted(map(repr, line_dedup.line_dedup(df.select("doc_id", "text"), exact_families=x).collect())) for x in (False, True))
        assert a == b


def test_line_edges(odd, nothing):
    rows = line_dedup.line_dedup(odd).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(repr((r.doc_id, r.text)) for r in odd.collect())
    assert line_dedup.line_dedup(nothing).count() == 0
    assert lines_filtered(odd).columns == odd.columns


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_units(text):
    """(tokens, whether a line) of a text's units in order, lower-cased, tokens with a digit as #."""
    out = []
    for line in text.split("\n"):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line))
        tokens = tuple("#" if re.search("[0-9]", w) else w for w in words)
        if len(tokens) >= 3:
            out.append((tokens, True))
        sentences, start = [], 0
        for i, w in enumerate(words):
            if w[-1] in ".!?" or i == len(words) - 1:
                sentences.append(tokens[start : i + 1])
                start = i + 1
        out += [(x, False) for x in sentences if len(x) >= 8 and len(sentences) > 1]
    return out


def plain_recurring(texts):
    """The units that go from ``texts``, by looking at each template of each unit."""
    numbered = sorted({t for t in texts if t is not None})
    components = brute(enumerate(numbered))
    units = {}
    for i, t in enumerate(numbered):
        for tokens, _ in plain_units(t):
            units.setdefault(tokens, set()).add(components[i][1])
    enough = lambda n: 3 if n >= 8 else 8
    support = Counter()
    for tokens, families in units.items():
        for place in range(4, len(tokens)):
            support[len(tokens), tokens[:4], place, tokens[place]] += min(8, len(families))
    templates, has = {}, {}
    for tokens, families in units.items():
        n, has[tokens] = len(tokens), [tokens]
        mask = [None if p >= 4 and support[n, tokens[:4], p, t] < enough(n) else t for p, t in enumerate(tokens)]
        spare = n // 5 - mask.count(None)
        if spare >= 0:
            has[tokens].append((tuple(mask), "template"))
        if spare > 0:
            has[tokens] += [((*mask[:p], None, *mask[p + 1 :]), "template") for p in range(4, n) if mask[p] is not None]
        for x in has[tokens]:
            templates.setdefault(x, set()).update(families)
    size = lambda x: len(x[0]) if x[-1] == "template" and isinstance(x[0], tuple) else len(x)
    return {tokens for tokens, own in has.items() if any(len(templates[x]) >= enough(size(x)) for x in own)}


def test_against_plain_parser(docs):
    """On the documents: what goes is what a plain template parser finds, and nothing else does."""
    rows = {r.doc_id: r.text for r in docs.collect()}
    gone = plain_recurring(rows.values())
    assert gone
    components = brute([(i, t) for i, t in rows.items() if t is not None])
    sizes = Counter(c for _, c in components.values())
    for r in line_dedup.line_dedup(docs).collect():
        old = rows[r.doc_id]
        units = plain_units(old or "")
        if not any(t in gone for t, _ in units):
            assert r.text == old and r.n_dropped == 0
        elif r.text != old:
            assert r.n_dropped > 0 and not any(t in gone for t, _ in plain_units(r.text))
            assert not Counter(WORD.findall(r.text)) - Counter(WORD.findall(old))
        else:
            # Whole only if nothing would be left and there is a copy.
            assert sizes[components[r.doc_id][1]] > 1 and all(t in gone for t, line in units if line)


@pytest.mark.parametrize("n", [30, 1500, 2600])
def test_field_in_leaf_of_any_size(spark, n):
    """A variable field goes whatever the number of its fillings and wherever it stands, in lines and in sentences."""
    r = random.Random(9)
    forms = ["this page was last edited by the following registered site user named {}", "Posted in the category of general news by {} and other people"]
    rows = [(i, f"{words(r, 12)}\n{forms[0].format(words(r, 1))}\n{words(r, 9)}. {forms[1].format(words(r, 1))}. {words(r, 9)}.") for i in range(n)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    assert out.filter("n_dropped = 2").count() == n and out.filter("text like '%page was%' or text like '%category%'").count() == 0


def test_two_common_fields(spark):
    """Two fields with few values each, so that no value is rare: one of them is a further variable place."""
    names, places = ([words(random.Random(x + k), 1) for k in range(12)] for x in (100, 200))
    r = random.Random(13)
    rows = [(12 * i + j, f"{words(r, 12)}\nposted in the general news of the day by {a} in the town of {b} yesterday") for i, a in enumerate(names) for j, b in enumerate(places)]
    assert not [x for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "posted" in x.text]


def test_dotted_names(spark):
    df = spark.createDataFrame([(i, f"{words(random.Random(i), 12)}\nall of these lines are the same everywhere here now", "x") for i in range(5)], "doc_id long, text string, `a.b c` string")
    out = lines_filtered(df)
    assert out.columns == df.columns and not out.filter("text like '%everywhere%'").count()


def test_copies_keep_nothing(spark):
    """A passage of unrelated documents goes though a group of near copies has it too; what copies alone have stays."""
    r = random.Random(10)
    passage, lines = words(r, 60), [words(r, 25) for _ in range(8)]
    rows = [(i, f"{words(r, 20)}\n{passage}") for i in range(12)]
    rows += [(100 + i, "\n".join([*lines[:4], passage, *lines[4:], words(r, 9)])) for i in range(60)]
    after = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert after == {i: x.replace(f"{passage}\n", "").removesuffix(f"\n{passage}") for i, x in rows}


def test_edited_copies_are_one_family(spark):
    """Copies each of which lacks other lines are one family, however many they are."""
    r = random.Random(11)
    lines = [words(r, 12) for _ in range(40)]
    rows = [(i, "\n".join(words(r, 12) if j in (i % 40, i * 7 % 40) else x for j, x in enumerate(lines))) for i in range(80)]
    after = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert after == dict(rows)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_pages_of_shared_passages(spark, monkeypatch, limit):
    """Header and footer go from pages with a short text of their own, and all goes from pages of nothing else that have no copy."""
    r = random.Random(12)
    header, footer, bars = words(r, 50), words(r, 50), [words(r, 40) for _ in range(3)]
    own = {i: words(r, 20) for i in range(20)}
    rows = [(i, f"{header}\n{x}\n{footer}") for i, x in own.items()]
    rows += [(100 + i, f"{words(r, 30)}\n{bars[i % 3]}") for i in range(12)]
    rows += [(200, f"{bars[0]}\n{bars[1]}"), (300, f"{bars[1]}\n{bars[2]}"), (301, f"{bars[1]}\n{bars[2]}")]
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    after = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: after[i] for i in own} == own
    assert all(after[i] == x.split("\n")[0] for i, x in rows if 100 <= i < 200)
    assert after[200] == "" and after[300] == after[301] == f"{bars[1]}\n{bars[2]}"


# --- Benchmark ----------------------------------------------------------------------------------------------------


def test_leaks(spark):
    r = random.Random(6)
    items = {i: words(r, 30 + i) for i in range(8)}
    w = items[0].split()
    texts = {
        1: words(r, 50) + " " + items[0].upper() + "! " + words(r, 50),
        2: " ".join([*w[20:], words(r, 4), *w[10:20], words(r, 3), *w[:10]]),
        3: " ".join(w[:12]) + " " + words(r, 80),
        4: words(r, 300),
        5: items[1] + " " + items[2],
        6: " ".join(reversed(w)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in leaks(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 1), (5, 2)}
    assert got[1, 0].coverage == 1 and got[2, 0].reordered and got[2, 0].n_tiles == 3 and not got[1, 0].reordered
    assert sorted(x.doc_id for x in decontaminated(docs, bench).collect()) == [3, 4, 6]


def plain_tiling(item, doc, least):
    """Greedy string tiling by looking at every pair of places."""
    in_item, in_doc, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        in_item[i : i + n], in_doc[j : j + n] = [True] * n, [True] * n
        out.append((i, j, n))


def test_tiling_against_plain():
    import numpy as np

    r = random.Random(7)
    for _ in range(200):
        item, doc = [r.randrange(4) for _ in range(r.randrange(3, 25))], [r.randrange(4) for _ in range(r.randrange(3, 40))]
        hits = [(i, j) for i in range(len(item) - 2) for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]]
        got = tiles(np.array([i for i, _ in hits]), np.array([j for _, j in hits]), len(item), 3) if hits else []
        assert got == plain_tiling(item, doc, 3), (item, doc)


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_leaks(docs, items):
    """(doc, item, covered words) by looking at every pair of texts and every pair of places."""
    out = set()
    for d, text in docs:
        doc = tokens(text)
        grams = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
        for i, other in items:
            item = tokens(other)
            if len(item) < 5:
                if item and any(doc[j : j + len(item)] == item for j in range(len(doc))):
                    out.add((d, i, len(item)))
            elif sum(tuple(item[j : j + 5]) in grams for j in range(len(item) - 4)) * 5 >= 0.6 * len(item):
                covered = sum(n for _, _, n in plain_tiling(item, doc, 5))
                if covered >= 0.6 * len(item):
                    out.add((d, i, covered))
    return out


def found_leaks(docs, bench):
    return {(r.doc_id, r.item_id, round(r.coverage * r.item_words)) for r in leaks(docs, bench).collect()}


def test_leaks_against_plain(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = plain_leaks([(d.doc_id, d.text) for d in docs.collect()], [(b.item_id, b.text) for b in bench.collect()])
    assert expected and found_leaks(docs, bench) == expected
    assert {r.doc_id for r in decontaminated(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {d for d, *_ in expected}


@pytest.mark.parametrize("common, rows", [(64, 500_000), (2, 0), (0, 500_000)])
def test_common_seeds(spark, monkeypatch, common, rows):
    """Items that share prompts of every length, however many items count as common, with and without broadcasts."""
    r = random.Random(21)
    prompt = words(r, 30).split()
    items = [(i, " ".join(prompt[: r.randrange(31)] + words(r, r.randrange(3, 30)).split() + prompt[r.randrange(31) :])) for i in range(40)]
    texts = [" ".join(prompt), " ".join(prompt[:20]), "none of it", *(t for _, t in items[:10])]
    texts += [" ".join([*t.split()[len(t.split()) // 2 :], words(r, 3), *t.split()[: len(t.split()) // 2]]) for _, t in items[10:20]]
    texts += [" ".join(w for w in t.split() if r.random() < 0.93) for _, t in items[20:30]]
    monkeypatch.setattr(decontamination, "COMMON", common)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    docs = [*enumerate(texts)]
    got = found_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain_leaks(docs, items) and len(got) > 20


def test_short_items(spark):
    """Items of one to five words, within documents and as whole ones, where they are repeated, and from a least number of words on."""
    r = random.Random(23)
    some = [f"w{k}" for k in range(6)]
    items = [(i, " ".join(r.choices(some, k=1 + i % 6))) for i in range(30)]
    docs = [(i, " ".join(r.choices([*some, "x", "y"], k=r.choice([0, 1, 2, 3, 4, 5, 30])))) for i in range(60)] + [(100, "w1 " * 500), (101, "x w2, W3! y")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found_leaks(d, b) == plain_leaks(docs, items)
    long = [(i, t) for i, t in items if len(t.split()) >= 3]
    assert {(x.doc_id, x.item_id, x.item_words) for x in leaks(d, b, least_words=3).collect()} == plain_leaks(docs, long)
    assert {x.doc_id for x in decontaminated(d, b, least_words=3).collect()} == {i for i, _ in docs} - {i for i, *_ in plain_leaks(docs, long)}


def test_prompt_of_very_many_items(spark):
    """A prompt that 20,000 items share pairs a document that has it with none of them but those whose rest it has too."""
    r = random.Random(22)
    prompt = words(r, 12)
    bench = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit(prompt + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.concat(F.lit("own"), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")).alias("text"))
    own = " ".join(f"own77x{k}" for k in range(15))
    df = spark.createDataFrame([(i, f"{prompt} {words(r, 10)}") for i in range(200)] + [(900, f"{prompt} {own}"), (901, own)], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaks(df, bench).collect()} == {(900, 77)}


def test_repeated_word(spark):
    """One word a hundred thousand times."""
    bench = spark.createDataFrame([(1, "wort " * 60), (2, "wort " * 20 + "and some other words that are not there at all anywhere in it no"), (3, "x " + "wort " * 30 + "y")], "item_id long, text string")
    df = spark.createDataFrame([(1, "wort " * 100_000), (2, "wort " * 10), (3, "wort " * 1000 + "z x " + "wort " * 1000 + "y")], "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.coverage for x in leaks(df, bench).collect()}
    assert got[1, 1] == got[3, 1] == 1.0 and got[1, 3] == 30 / 32 and got[3, 3] >= 31 / 32 and (2, 1) not in got and (1, 2) not in got


def test_leak_edges(spark, odd, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "same text here of six words"), (4, "other"), (None, "wort wort wort wort wort wort"), (5, "ONE"), (6, "the")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(((r.doc_id, r.item_id) for r in leaks(odd, bench).collect()), key=repr)
    assert got == sorted([(4, 3), (4, 5), (5, 4), (5, 4), (6, 4), (None, 4), (7, None)], key=repr)
    assert leaks(nothing, bench).count() == 0 and leaks(odd, bench.limit(0)).count() == 0
    assert decontaminated(odd, bench).columns == odd.columns and decontaminated(odd, bench.limit(0)).count() == odd.count()
    dotted = spark.createDataFrame([(1, "one", "x"), (2, "two", "y")], "doc_id long, text string, `a.b c` string")
    assert [tuple(r) for r in decontaminated(dotted, bench).collect()] == [(2, "two", "y")]


def test_lines_that_stay_are_not_looked_at(monkeypatch):
    """Lines of which fewer than two sentences go have no run between two of them, and are passed over."""
    sentence = "{} one two three four five six seven eight."
    texts = [sentence.format("alpha") + " Yes. " + sentence.format("beta"), *(f"{sentence.format(a)} No. {sentence.format(b)}" for a, b in zip("abcdefghij", "klmnopqrst"))]
    column = pa.array(["\n".join(texts)])
    (_, _, w), = words_of(pa.array([texts[0]]), SPACE_WORDS)
    unit = line_dedup.Units(w)
    wanted = np.sort(unit.hash[~unit.is_line])
    seen, between = [], line_dedup._between
    monkeypatch.setattr(line_dedup, "_between", lambda go, short: seen.append(len(go)) or between(go, short))
    assert len([*line_dedup._runs(column, np.array([5]), lambda _, h: np.isin(h, wanted))]) == 1
    assert seen == [3]


def test_template_keys_of_many_units():
    """Units looked at together have the templates that each has alone; a unit with too many rare tokens has none."""
    rng = np.random.default_rng(5)
    n = np.array([3, 10, 25, 10, 4])
    leaf, tokens, rare = rng.integers(0, 1 << 62, len(n)), rng.integers(0, 1 << 32, n.sum()), np.zeros(n.sum(), bool)
    ends = np.cumsum(n)
    rare[[ends[0] + 5, *range(ends[1] + 4, ends[1] + 10), ends[2] + 4, ends[2] + 9]] = True
    keys, unit = line_dedup.template_keys(leaf, n, tokens, rare)
    alone = [line_dedup.template_keys(leaf[i : i + 1], n[i : i + 1], tokens[e - n[i] : e], rare[e - n[i] : e])[0].tolist() for i, e in enumerate(ends)]
    assert [sorted(keys[unit == i].tolist()) for i in range(len(n))] == [sorted(x) for x in alone]
    # Of 3 tokens none may vary; 10 may have two variable places, of which one is rare; 25 five, but six are rare.
    assert [len(x) for x in alone] == [1, 1 + 5, 0, 1, 1]


def test_units_of_a_batch_come_at_once():
    """However many chunks a batch of texts is split in, and with the sentences that a run may begin with marked."""
    sentence = "{} one two three four five six seven eight."
    run = " ".join((sentence.format("alpha"), "Yes.", sentence.format("beta"), sentence.format("gamma") + "\n" + "No. " + sentence.format("delta")))
    texts = [run, *(sentence.format(i) * 2000 for i in range(5))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["source", "text"])
    made = [*line_dedup.by_batch(line_dedup._units)(iter([batch]))]
    assert len(made) == 1 and len([*line_dedup._units(iter([batch]))]) > 1
    (_, _, w), = words_of(pa.array([run]), SPACE_WORDS)
    u = line_dedup.Units(w)
    marked = {h for h, s, m in zip(*(made[0].column(c).to_pylist() for c in ("line", "source", "before_short"))) if s == 0 and m}
    assert marked == {int(u.hash[(u.first == 0) & ~u.is_line][0])}
