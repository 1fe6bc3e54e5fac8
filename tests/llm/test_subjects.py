import random
import tracemalloc
from collections import Counter
from itertools import combinations

from relayscope.llm import subjects

TOPICS = {
    "law": (["the court", "the plaintiff", "the statute"], ["dismissed the appeal", "awarded damages", "limits liability"]),
    "sport": (["the goalkeeper", "the home team", "the sprinter"], ["won the league final", "broke a season record", "pulled a hamstring"]),
    "health": (["the patient", "the clinic", "the vaccine"], ["eased the symptoms", "lowers blood pressure", "was given before surgery"]),
}
FILLER = ["Thanks for the quick reply.", "More on this tomorrow.", "Nothing else has changed.", "P.S. the patient won the court final."]


def sentence(rng, area):
    a, b = TOPICS[area]
    return f"{rng.choice(a).capitalize()} {rng.choice(b)}."


def document(rng, counts):
    parts = [sentence(rng, a) for a, n in counts.items() for _ in range(n)] + rng.choices(FILLER, k=4)
    rng.shuffle(parts)
    return " ".join(parts)


def corpus(spark, n=240):
    rng = random.Random(3)
    docs, labels, truth = [], [], {}
    for i in range(n):
        counts = dict(zip(rng.sample(list(TOPICS), 2), rng.choice([(8, 0), (6, 6), (9, 1), (6, 2)])))
        docs.append((i, document(rng, counts), "clash"))
        total = sum(counts.values())
        truth[i] = {a for a, k in counts.items() if k and k >= total / 4}
        if i % 2:
            for a in truth[i]:
                labels.append((i, a, "ann-1"))
            if i % 15 == 0:
                labels.append((i, rng.choice(list(TOPICS)), "ann-2"))
    docs += [(n, None, None), (n + 1, "", None), (n + 2, "  \n", None), (n + 3, " ".join(FILLER), None)]
    labels += [(1, None, None), labels[0], (9999, "law", "x")]
    frame = spark.createDataFrame
    return frame(docs, "doc_id long, text string, area string").drop("area"), frame(labels, "doc_id long, area string, labeller string"), frame([(a, "d") for a in TOPICS], "area string, description string"), truth


ITEMS = "item_id long, text string"


def test_held_out_accuracy(spark):
    docs, labels, areas, truth = corpus(spark)
    got = {}
    for r in subjects.subject_areas(docs, labels, areas, spark.createDataFrame([], ITEMS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    held = [i for i in truth if i % 2 == 0]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert not any(i >= 240 for i in got)


def test_no_labels_no_rows(spark):
    docs, labels, areas, _ = corpus(spark, 20)
    assert subjects.subject_areas(docs, labels.limit(0), areas, spark.createDataFrame([], ITEMS)).count() == 0
    assert subjects.subject_areas(docs.limit(0), labels, areas, spark.createDataFrame([], ITEMS)).count() == 0


def test_what_has_no_area_is_left_out():
    text = "Received: from a (1.1.1.1) by b.test The court sat. P.S. I missed the game. https://law.test/court Next one here.\n-- \nMay\nOssenby\n\nif (x) { court(); } End."
    got = subjects.sentences(text)
    assert frozenset(["the", "court", "sat"]) in got and not any("game" in s or "may" in s or "https" in s for s in got)
    passages = subjects.passages_of(["one two three four five"])
    assert subjects.sentences("So one two three four ends the court.", passages) == [frozenset(["so", "ends", "the", "court"])]
    assert subjects.sentences(None) == subjects.sentences("") == []


def test_calibration_never_falls():
    steps = subjects.calibrate([(float(i), i % 3 != 0 or i > 60) for i in range(100)], 10)
    assert [p for _, p in steps] == sorted(p for _, p in steps)


def by_hand(rows, areas, least_count, least_confidence):
    """Rules from every set of words that lean to an area by themselves, and from every pair of those that don't."""
    prior = {a: sum(b == a for b, _ in rows) / len(rows) for a in {b for b, _ in rows}}
    stands = {a: max(least_confidence, 1.3 * p) for a, p in prior.items()}
    alone = Counter((w, a) for a, words in rows for w in words)
    seen = Counter(w for _, words in rows for w in words)
    leaning = {w for (w, a), n in alone.items() if seen[w] >= least_count and subjects.lower_bound(n, seen[w]) >= min(0.9, stands[a])}
    all_, joint = Counter(), Counter()
    for a, words in rows:
        sets = [s for k in range(1, len(words) + 1) for s in combinations(sorted(words & leaning), k)]
        sets += combinations(sorted(w for w in words - leaning if seen[w] >= least_count), 2)
        all_.update(sets)
        joint.update((s, a) for s in sets)
    kept = {}
    for (s, a), n in sorted(joint.items(), key=lambda x: len(x[0][0])):
        p = subjects.lower_bound(n, all_[s])
        least = 1 if leaning.isdisjoint(s) else least_count
        if n >= least and all_[s] >= least_count and p >= stands[a] and p > 0.02 + max((q for (t, b), q in kept.items() if a == b and set(t) < set(s)), default=0.0):
            kept[s, a] = p
    return {(s, a) for (s, a), p in kept.items() if p / (1 - p) > prior[a] / (1 - prior[a])}


def rules_of(rules):
    return {(tuple(sorted(words)), rules.areas[area]) for held in rules.by_word.values() for words, area, _ in held}


def test_rules_are_those_of_all_frequent_sets(spark):
    lengths = Counter()
    for seed in range(4):
        rng = random.Random(seed)
        share = {a: [rng.uniform(0.55, 0.65) if "abc"[i % 3] == a else 0.3 for i in range(12)] for a in "abc"}
        rows = [(a, frozenset(f"w{i}" for i, p in enumerate(share[a]) if rng.random() < p)) for a in rng.choices("abc", k=1500)]
        rows += [("a", frozenset({"p", "q"})), ("a", frozenset("pr")), ("b", frozenset("pr")), ("c", frozenset("qr"))] * (20 * (seed % 2))
        want = by_hand(rows, list("abc"), 5, 0.3)
        assert rules_of(subjects.mine(spark, rows, list("abc"), least_count=5, least_confidence=0.3)) == want
        lengths.update(len(s) for s, _ in want)
    assert min(lengths[1], lengths[2], lengths[3]) > 20 and lengths[4]


def test_pairs_count_where_no_word_leans(spark):
    rows = [("a", frozenset("pq")), ("b", frozenset("pr")), ("b", frozenset("qr")), ("a", frozenset("r"))] * 50 + [("b", frozenset("r")), ("a", frozenset("r"))] * 50
    assert rules_of(subjects.mine(spark, rows, ["a", "b"], least_count=4, least_confidence=0.3)) == by_hand(rows, ["a", "b"], 4, 0.3) == {(("p", "q"), "a"), (("p", "r"), "b"), (("q", "r"), "b")}


def test_long_sentences_met_often_are_mined(spark):
    """Forty words that return together have 2**40 frequent sets, none of which says more than the words do."""
    words = [f"w{i:02}" for i in range(40)]
    rows = [("a", frozenset(words))] * 60 + [("b", frozenset(words))] * 6 + [("b", frozenset({f"x{i}", "y"})) for i in range(60)]
    rows += [("a", frozenset({w, f"z{i % 7}"})) for i, w in enumerate(words)]
    got = rules_of(subjects.mine(spark, rows, ["a", "b"], least_count=4, least_confidence=0.3))
    assert got == {((w,), "a") for w in words} | {(("y",), "b")}


def test_many_words_take_no_table_of_all_pairs(spark):
    """Six thousand words that lean to no area: a number for each two of them would be 144 MB an area."""
    rng = random.Random(5)
    rows = [(a, frozenset(f"w{i}" for i in range(k, k + 12))) for k in range(0, 6000, 12) for a in "abc"] * 3
    rows += [(a, frozenset({"p", q})) for a, q in (("a", "q"), ("b", "r"), ("c", "s"))] * 30 + [(a, frozenset({w})) for a in "abc" for w in "qrs" if (a, w) not in (("a", "q"), ("b", "r"), ("c", "s"))] * 30
    rng.shuffle(rows)
    tracemalloc.start()
    rules = subjects.mine(spark, rows, list("abc"), least_count=5, least_confidence=0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rules_of(rules) == {(("p", "q"), "a"), (("p", "r"), "b"), (("p", "s"), "c")}
    assert peak < 60e6
