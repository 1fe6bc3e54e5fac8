import itertools
import random
import tracemalloc

import numpy as np
import pytest

from relayscope.llm import leaks

WORDS = [f"w{i}" for i in range(300)]
RNG = random.Random(5)
ITEMS = [(i, " ".join(RNG.choices(WORDS, k=60))) for i in range(12)]


def brute(doc, item, run=16, common=13):
    """Longest common words on any diagonal, without insertions."""
    d, i = leaks.words_of(doc), leaks.words_of(item)
    best = 0
    for shift in range(-len(i), len(d)):
        same = [0 <= k + shift < len(d) and d[k + shift] == i[k] for k in range(len(i))]
        best = max([best, *(sum(same[k : k + run]) for k in range(len(i) - run + 1))])
    return best >= common


def search(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaked(leaks.search(d, "doc_id", "text", i, **kw)).collect()}


def part(n, a, b):
    return ITEMS[n][1].split()[a:b]


def test_against_brute_force(spark):
    docs = []
    for k in range(120):
        n, size = RNG.randrange(12), RNG.randrange(6, 30)
        a = RNG.randrange(0, 60 - size)
        words = part(n, a, a + size)
        for _ in range(RNG.randrange(0, 3)):
            words[RNG.randrange(len(words))] = "changed"
        docs.append((k, " ".join(RNG.choices(WORDS, k=20) + words + RNG.choices(WORDS, k=20)), "clash"))
    want = {(d, i) for d, t, _ in docs for i, text in ITEMS if brute(t, text)}
    assert search(spark, docs) == want and len(want) > 20


def test_markup_case_breaks_and_insertions(spark):
    words = part(3, 5, 30)
    docs = [
        (1, " ".join(words).upper().replace(" ", ", "), None),
        (2, "<p>" + "</b> <i>".join(words) + "</p>", None),
        (3, "> " + "\n> ".join(" ".join(words[i : i + 4]) for i in range(0, 25, 4)), None),
        (4, " ".join(words[:9] + ["extra"] + words[9:]), None),
        (5, " ".join(words[:15]) + " end", None),
        (6, None, None),
        (7, "", None),
        (8, " ".join(part(1, 0, 12)), None),
        (9, " ".join(f"{w[:2]}­{w[2:]}" for w in words), None),
        (1, " ".join(words), None),
    ]
    assert search(spark, docs) == {(1, 3), (2, 3), (3, 3), (4, 3), (5, 3), (9, 3)} - ({(5, 3)} if not brute(docs[4][1], ITEMS[3][1]) else set())


def test_items_in_blocks_give_the_same(spark):
    docs = [(k, " ".join(part(k, 10, 40)), None) for k in range(12)]
    assert search(spark, docs, block_items=3) == search(spark, docs) == {(k, k) for k in range(12)}


def test_empty_tables_and_long_text(spark):
    assert search(spark, []) == set()
    assert search(spark, [(1, "x", None)], []) == set()
    assert search(spark, [(1, " ".join(RNG.choices(WORDS, k=50_000) + part(2, 0, 20)), None)]) >= {(1, 2)}
    assert search(spark, [(1, "a b", None)], [(1, None), (2, "short item")]) == set()


def found(docs, items, settings=leaks.Settings()):
    """Pairs of (number of the document, id of the item) without Spark."""
    block = leaks.Items(items, settings)
    texts = [np.array([block.vocabulary.get(w, 0) for w in leaks.words_of(t)], np.int64) for t in docs]
    return {(int(d), i) for part in leaks._found(texts, block) for d, k, c, *_ in zip(*part) if c >= settings.common for i in block.ids[k]}


def test_changed_words_may_be_anywhere():
    words = part(4, 20, 36)
    docs = [" ".join("x" if k in gone else w for k, w in enumerate(words)) for n in range(5) for gone in itertools.combinations(range(16), n)]
    most = [n for n in range(5) for _ in itertools.combinations(range(16), n)]
    assert found(docs, ITEMS) == {(d, 4) for d, n in enumerate(most) if n <= 3}


@pytest.mark.parametrize("seed", range(8))
def test_few_different_words_against_brute_force(seed):
    rng = random.Random(seed)
    few = [f"v{i}" for i in range(2 + 3 * (seed % 4))]
    items = [(i, " ".join(rng.choices(few, k=rng.randrange(14, 40)))) for i in range(6)]
    docs = [" ".join(rng.choices([*few, "new"], k=rng.randrange(0, 60))) for _ in range(30)] + [items[0][1], items[1][1] + " new " + items[1][1]]
    want = {(d, i) for d, t in enumerate(docs) for i, text in items if len(text.split()) >= 16 and brute(t, text)}
    got = found(docs, items)
    assert want <= got
    assert {(d, i) for d, i in got - want if not bent(docs[d], dict(items)[i])} == set()


def bent(doc, item, run=16, common=13, drift=6):
    """Whether words can be put in or left out so that ``common`` of ``run`` words agree in order."""
    d, i = leaks.words_of(doc), leaks.words_of(item)
    for a in range(len(i) - run + 1):
        table = np.zeros((run + 1, len(d) + 1), int)
        for x in range(run):
            for y in range(len(d)):
                table[x + 1, y + 1] = table[x, y] + 1 if i[a + x] == d[y] else max(table[x, y + 1], table[x + 1, y])
        if table[run, len(d)] >= common:
            return True
    return False


def test_many_different_words_need_shorter_blocks():
    rng = random.Random(1)
    items = [(i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))) for i in range(2_000)]
    docs = [" ".join(items[k][1].split()[5:30]) for k in range(0, 2_000, 100)]
    assert leaks.Items(items, leaks.Settings()).block < 4
    assert found(docs, items) == {(n, k) for n, k in enumerate(range(0, 2_000, 100))}


def test_longest_match_and_its_place():
    block = leaks.Items(ITEMS, leaks.Settings())
    text = ["q", "q", *part(7, 3, 12), "q", *part(7, 20, 45), "q", *part(7, 30, 50)]
    ((doc, item, common, longest, at),) = leaks._found([np.array([block.vocabulary.get(w, 0) for w in text], np.int64)], block)
    assert (doc.tolist(), item.tolist(), common.tolist(), longest.tolist(), at.tolist()) == ([0], [7], [16], [25], [12])


def test_a_passage_that_all_share_stays_within_memory():
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(26))
    items = [(i, f"{' '.join(rng.choices(WORDS, k=8))} {shared} {' '.join(rng.choices(WORDS, k=8))}") for i in range(3_000)]
    block = leaks.Items(items, leaks.Settings())
    docs = [f"{' '.join(rng.choices(WORDS, k=6))} {shared} {' '.join(rng.choices(WORDS, k=6))}" for _ in range(1_000)]
    texts = [np.array([block.vocabulary.get(w, 0) for w in leaks.words_of(t)], np.int64) for t in docs]
    tracemalloc.start()
    pairs = sum(int((part[2] >= 13).sum()) for part in leaks._found(texts, block))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 3_000 * 1_000 and peak < 1_000_000_000


def test_copies_of_documents_and_items_all_come_back(spark):
    text = " ".join(part(2, 0, 40))
    twins = [(100, text), (101, text.upper())]
    assert search(spark, [(k, "q " + text, None) for k in range(50)], twins) == {(k, i) for k in range(50) for i in (100, 101)}
