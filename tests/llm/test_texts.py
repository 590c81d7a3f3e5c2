import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waylattice.llm import contamination as con
from waylattice.llm import mixture, subjects

random.seed(3)
WORDS = [f"{a}{b}{c}{d}" for a in ("ba", "ko", "ri", "lum", "ste", "pul") for b in ("do", "ra", "mi", "ten", "", "gos") for c in ("n", "lo", "vas", "ker", "ti", "fub") for d in ("", "da", "hem", "ox", "isk")]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(["", "s", "er"]) for _ in range(n)]


ITEM = prose(60, 1)
OTHER = prose(60, 2)


def leaks(spark, docs, items=None, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id BIGINT, text STRING, item STRING, doc INT")
    t = spark.createDataFrame(items if items is not None else [("one", " ".join(ITEM)), ("two", " ".join(OTHER))], "item_id STRING, text STRING")
    return {(r["doc"], r["item"]) for r in con.leaked_passages(d, t, **kw).collect()}


def around(words, seed=9):
    return " ".join(prose(80, seed)) + ". " + words + " " + " ".join(prose(50, seed + 1))


CASES = [
    (1, around(" ".join(ITEM)), True),
    (2, around(" ".join(ITEM[10:27])), True),  # just seventeen words
    (3, around(" ".join(ITEM[10:25])), False),  # fifteen are none
    (4, around(", ".join(w.upper() for w in ITEM[5:40])), True),
    (5, around("-\n".join([" ".join(ITEM[5:20])[:-3], " ".join(ITEM[5:20])[-3:] + " " + " ".join(ITEM[20:30])])), True),  # broken word
    (6, around(" ".join(ITEM[5:15]) + " (Applause from all sides) " + " ".join(ITEM[15:30]) + " -- Mr Nobody: Nonsense! -- " + " ".join(ITEM[30:40])), True),
    (7, around(" ".join(w if i % 8 else "changed" for i, w in enumerate(ITEM))), True),
    (8, around(" ".join(w for i, w in enumerate(ITEM) if i % 8)), True),
    (9, around(" ".join(w + (" added" if i % 8 == 3 else "") for i, w in enumerate(ITEM))), True),
    (10, around(" ".join(w if i % 3 else "other" for i, w in enumerate(ITEM))), False),  # of like build only
    (11, around(" ".join(ITEM[:30]).replace("a", "á").replace("i", "ｉ")), True),  # other forms of the letters
    (12, "­".join(" ".join(ITEM)), True),
    (13, " ".join(prose(400, 77)), False),
    (14, "", False),
    (15, None, False),
    (16, " ".join(OTHER[:40]) + " " + " ".join(ITEM[20:50]), True),
    (17, around(" ".join(prose(60000, 5)) + " " + " ".join(ITEM[:20])), True),  # a very long text
]


@pytest.mark.parametrize("kw", [{}, {"broadcast_letters": 1}])
def test_leaks(spark, kw):
    got = leaks(spark, [(i, t) for i, t, _ in CASES], **kw)
    want = {(i, "one") for i, _, y in CASES if y} | {(16, "two")}
    assert got == want


def test_leaks_edges(spark):
    assert leaks(spark, []) == set()
    assert leaks(spark, [(1, " ".join(ITEM))], []) == set()
    assert leaks(spark, [(None, " ".join(ITEM)), (1, " ".join(ITEM)), (1, " ".join(ITEM))], [("one", " ".join(ITEM)), ("one", " ".join(ITEM)), (None, "x"), ("empty", ""), ("null", None)]) == {(1, "one")}


def test_formulas_do_not_count(spark):
    formula = prose(20, 40)
    docs = [(i, around(" ".join(formula), 100 + i)) for i in range(60)] + [(99, around(" ".join(formula + ITEM[:20])))]
    item = [("one", " ".join(formula + ITEM))]
    assert leaks(spark, docs, item) == {(99, "one")}
    assert leaks(spark, docs, item, broadcast_letters=1) == {(99, "one")}


@pytest.mark.parametrize("kw", [{}, {"broadcast_letters": 1}])
def test_copies_of_a_leak_are_no_formula(spark, kw):
    plain = [(1000 + i, " ".join(prose(90, 2000 + i))) for i in range(60)]
    copied = around(" ".join(ITEM[10:40]))
    copies = [(i, copied) for i in range(50)] + [(i, copied + " " + " ".join(prose(9, i))) for i in range(50, 60)]  # and reissues
    assert leaks(spark, plain + copies, **kw) == {(i, "one") for i in range(60)}
    # a long passage that many quote is none either
    quoted = [(i, around(" ".join(ITEM), 100 + 2 * i)) for i in range(60)]
    assert leaks(spark, plain + quoted, **kw) == {(i, "one") for i in range(60)}


def loose(words, seed=0):
    """Of like build only: two words of seven changed."""
    return [w if i % 7 not in (2, 5) else f"other{seed}{i}" for i, w in enumerate(words)]


@pytest.mark.parametrize("kw", [{}, {"broadcast_letters": 1}])
def test_a_quotation_beside_loose_ones(spark, kw):
    item = prose(80, 21)
    quote, near = item[60:77], loose(item[:55])
    docs = [
        (1, around(" ".join(quote))), (2, around(" ".join(near))), (3, around(" ".join(near + quote))), (4, around(" ".join(quote + near))),
        (5, around(" ".join(loose(item, 1) + quote + loose(item, 2)))), (6, around(" ".join(loose(item[20:], 1) + prose(3, 5) + quote + prose(2, 6) + near))),
        (7, around(" ".join(loose(item, 3) + prose(9, 4) + loose(item, 4)))),
    ]
    assert leaks(spark, docs, [("one", " ".join(item))], **kw) == {(i, "one") for i in (1, 3, 4, 5, 6)}


def test_both_ways_find_the_same(spark):
    r = random.Random(5)
    sets = [prose(r.randrange(20, 90), 300 + i) for i in range(12)]
    formula = prose(12, 50)
    items = [(f"i{i % 10}", " ".join((formula if i % 3 == 0 else []) + w)) for i, w in enumerate(sets)]  # two ids stand for two texts each
    docs = []
    for i in range(400):
        words = prose(r.randrange(5, 60), 5000 + i) + (formula if r.random() < 0.4 else [])
        for _ in range(r.randrange(3)):
            w = r.choice(sets)
            a = r.randrange(len(w))
            words += [x if r.random() > 0.12 else r.choice(WORDS) for x in w[a : a + r.randrange(8, 50)]] + prose(r.randrange(6), i)
        docs.append((i % 390, " ".join(words)))
    one, two = leaks(spark, docs, items), leaks(spark, docs, items, broadcast_letters=1)
    assert len(one) > 50 and one == two


def test_winnowing_guarantee():
    r = random.Random(8)
    for _ in range(200):
        span = bytes(r.choices(b"abcdefgh", k=con.GRAM + con.WINDOW - 1))
        a, b = (bytes(r.choices(b"ijkl", k=r.randrange(40))) + span + bytes(r.choices(b"mnop", k=r.randrange(40))) for _ in range(2))
        fa, fb = (set(con.winnow(np.frombuffer(x, np.uint8), np.array([len(x)]))[1].tolist()) for x in (a, b))
        assert fa & fb


def test_winnow_of_a_block_is_that_of_each_text():
    texts = [con.letters(" ".join(prose(n, n))) for n in (3, 40, 1, 0, 25)]
    ends = np.cumsum([len(t) for t in texts])
    block = set(con.winnow(np.frombuffer(b"".join(texts), np.uint8), ends)[1].tolist())
    for t in texts:
        if len(t) >= con.GRAM + con.WINDOW - 1:
            assert set(con.winnow(np.frombuffer(t, np.uint8), np.array([len(t)]))[1].tolist()) <= block


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id BIGINT, source STRING, text STRING, w DOUBLE, tokens STRING")
    t = spark.createDataFrame(targets, "source STRING, target_share DOUBLE, max_repeats INT")
    return mixture.mix_sources(d, t, **kw).collect()


def test_mixture_reaches_shares(spark):
    docs = [(i, random.choice(["Big"] * 6 + [" small ", "small", "TINY"]), " ".join(prose(random.randrange(5, 60), i)), 1.0) for i in range(900)]
    docs += [(None, "big", "a", 1.0), (5000, None, "a b", 1.0), (5001, "big", None, 1.0), (5002, "big", "", 1.0), (5003, "unwanted", "a b c", 1.0), docs[0]]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.1, 4), ("absent", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1)]
    out = mix(spark, docs, targets)
    assert len({r["doc_id"] for r in out}) == len(out)
    most = {"big": 1, "small": 3, "tiny": 4}
    assert all(0 < r["copies"] <= most[r["source"]] for r in out)
    total = sum(r["copies"] * r["n_tokens"] for r in out)
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.1)):
        mine = [r for r in out if r["source"] == s]
        reached = sum(r["copies"] * r["n_tokens"] for r in mine) / total
        assert abs(reached - share / 0.9) < 0.01 and mine[0]["reached_share"] == pytest.approx(reached)
    assert sorted(out) == sorted(mix(spark, docs[::-1], targets))


def test_mixture_weights_and_total(spark):
    docs = [(i, "a", "word " * 20, 4.0 if i < 100 else 1.0) for i in range(1000)]
    out = mix(spark, docs, [("a", 1.0, 2)], weight="w", total_tokens=6000)
    assert abs(sum(r["copies"] * r["n_tokens"] for r in out) - 6000) <= 25
    heavy = sum(r["copies"] for r in out if r["doc_id"] < 100) / 100
    light = sum(r["copies"] for r in out if r["doc_id"] >= 100) / 900
    assert 2.5 < heavy / light < 6
    assert mix(spark, [], [("a", 1.0, 2)]) == [] and mix(spark, docs[:3], []) == []


def test_inclusion_follows_size(spark):
    """Realised inclusion against the odds: expected copies rise with a document's tokens, up to the cap."""
    docs = [(i, "a", "word " * (5 * (1 + i % 8)), 1.0) for i in range(4000)]
    once = {r["doc_id"]: r for r in mix(spark, docs, [("a", 1.0, 2)], by_size=True, total_tokens=40_000)}
    tokens = {k: next(r["n_tokens"] for r in once.values() if r["doc_id"] % 8 == k) for k in range(8)}
    rate = 40_000 / sum(500 * t * t for t in tokens.values())
    for k, t in tokens.items():
        p, used = rate * t, sum(r["copies"] for r in once.values() if r["doc_id"] % 8 == k)
        assert p < 1 and abs(used - 500 * p) < 4 * (500 * p * (1 - p)) ** 0.5 + 1, (k, used, 500 * p)
    # beyond the cap the others make up for it
    full = mix(spark, docs, [("a", 1.0, 1)], by_size=True, total_tokens=sum(500 * t for t in tokens.values()) * 9 // 10)
    share = {k: sum(r["copies"] for r in full if r["doc_id"] % 8 == k) / 500 for k in range(8)}
    assert share[7] == share[6] == 1 and share[0] < share[1] < share[2] < 1 and abs(share[2] / share[0] - tokens[2] / tokens[0]) < 0.5


AREAS = [("farm", "Farming", "Farming: matters such as tractor, grain silo, plough."), ("sport", "Sport", "Sport: matters such as stadium, relay team, court."), ("law", "Justice", "Justice: matters such as tribunal, barrister, court.")]


def judged(spark, docs, labels=(), **kw):
    d = spark.createDataFrame([(*r, 0, "y") for r in docs], "doc_id BIGINT, text STRING, agenda_item STRING, source STRING, subject INT, total STRING")
    a = spark.createDataFrame(AREAS, "subject STRING, title STRING, description STRING")
    return {(r["doc_id"], r["subject"]) for r in subjects.subject_areas(d, a, spark.createDataFrame(list(labels), "doc_id BIGINT, subject STRING, annotator STRING"), **kw).collect()}


def speech(terms, filler=4, seed=0):
    r = random.Random(seed)
    said = [f"We want the {t} in {r.choice(WORDS)} now." for t in terms] + [f"Nobody here denies that {r.choice(WORDS)} is {r.choice(WORDS)}." for _ in range(filler)]
    r.shuffle(said)
    return " ".join(said)


def test_subjects(spark):
    docs = [(1, speech(["tractor", "grain silos", "plough"]), None, "s"), (2, speech(["stadium"]), "3. Sport", "s"), (3, speech(["stadium", "Relay-Team", "tribunal", "barrister"]), None, "s"), (4, speech(["tractor", "plough"], 30), None, "s"), (5, speech([], 8), "Farming", "s"), (6, "", None, None), (7, None, None, None), (None, speech(["tractor"] * 3), None, "s")]
    docs += [(8, speech(["tractor", "plough"]) + " (The tractor! The stadium! A stadium!)", None, "s"), (9, speech(["stadium"] * 5000, 10), None, "s")]
    got = judged(spark, docs + docs[:1])
    assert got == {(1, "farm"), (3, "sport"), (3, "law"), (8, "farm"), (9, "sport")}
    assert judged(spark, []) == set()


def test_copies_do_not_make_formulas(spark):
    passing = speech(["tractor", "plough"], 30)
    docs = [(i, passing + (" (Applause)" if i % 2 else ""), None, "s") for i in range(40)]
    # neither does a sentence that one text repeats; one that many texts have does
    docs += [(100, speech(["stadium"] * 2, 0) + " We thank you all for that." * 20, None, "s")]
    docs += [(200 + i, speech(["tribunal", "barrister"], 3, i) + " The sitting is open and all of you are welcome." * 13, None, "s") for i in range(8)]
    assert judged(spark, docs) == {(200 + i, "law") for i in range(8)}


def test_lexicon_is_learned(spark):
    docs = [(i, speech(["tractor", "milk quota"] if i % 2 else ["stadium", "penalty kick"], 4, i), None, "s") for i in range(120)]
    labels = [(i, "farm" if i % 2 else "sport", "a") for i in range(100)] + [(1, None, "b"), (3, "no such", "b")]
    docs += [(500, speech(["milk quota", "milk quota"], 4, 900), None, "s")]
    assert (500, "farm") in judged(spark, docs, labels)


def test_accuracies_rank_functions():
    r = random.Random(1)
    seen = {}
    for _ in range(20000):
        y = r.random() < 0.4
        v = (r.choice([7, 7, 6, 5, 4]) if y else r.choice([1, 1, 1, 2, 3, 4]), int(r.random() < (0.7 if y else 0.1)), r.choice([0, 1] if y else [0, 0, 1, 2, 2]), int(r.random() < 0.5))
        seen[v] = seen.get(v, 0) + 1
    post = subjects.fit_accuracies(seen)
    assert post[4, 1, 1, 0] > post[4, 1, 0, 0] > 0.5 > post[4, 0, 2, 0]
    assert post[7, 0, 0, 0] > 0.5 > post[1, 1, 0, 0]
    assert abs(post[4, 1, 0, 0] - post[4, 1, 0, 1]) < 0.1  # the source says nothing here
    without = subjects.fit_accuracies(seen, ("lexicon", "section", "source"))
    assert abs(without[4, 1, 0, 0] - without[4, 0, 0, 0]) < 1e-9


def test_functions_change_rows(spark):
    """Between a passing word and a subject the other functions decide."""
    r = random.Random(6)
    docs, passing = [], "We want the {} in this."
    for i in range(300):
        s = ["tractor", "stadium", "tribunal"][i % 3]
        title = [None, "Farming", "Sport", "Justice"][0 if r.random() < 0.4 else 1 + i % 3]
        docs.append((i, speech([s] * 4, 8, i), title, "s"))
        lines = [f"Nobody here denies that {r.choice(WORDS)} is {r.choice(WORDS)}." for _ in range(12)]
        other = ["stadium", "tribunal", "tractor"][i % 3]
        # one word in passing, after the subject itself
        docs.append((1000 + i, " ".join([passing.format(s)] * 4 + lines + [passing.format(other)]), title, "s"))
    edge = [f"Nobody here denies that {r.choice(WORDS)} is {r.choice(WORDS)}." for _ in range(17)]
    docs.append((5000, " ".join([passing.format("tractor"), *edge, passing.format("plough")]), "Farming", "s"))
    docs.append((5001, " ".join([passing.format("stadium")] * 3 + edge[:14] + [passing.format("tractor")] * 2), "Sport", "s"))
    rows = lambda **kw: judged(spark, docs, **kw)
    full, lexicon = rows(), rows(functions=("lexicon",))
    assert (5000, "farm") in full and (5001, "farm") not in full and (5001, "sport") in full
    assert {(5000, "farm"), (5001, "farm"), (5001, "sport")} <= lexicon  # by itself it can't tell them apart
    assert {(1000 + i, ["farm", "sport", "law"][i % 3]) for i in range(300)} == {x for x in full if 1000 <= x[0] < 5000}


def test_sentences():
    assert [" ".join(s) for s in subjects.sentences("Dr. Who said: the Grain-Silos are here! (Applause) It is 5 o'clock.\nReally -- Mr X: Nonsense! -- so?")][0].startswith("dr who said")
    assert len(subjects.sentences("Dr. Who came. He left.")) == 2
    assert subjects.sentences(None) == [] and subjects.sentences("...") == []
