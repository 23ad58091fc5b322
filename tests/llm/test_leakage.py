import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.llm import leakage as L

WORDS = st.lists(st.sampled_from("abc"), max_size=14)


def shared(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), WORDS, st.integers(1, 4))
def test_longest_runs(items, doc, least):
    a = L.Automaton(list(enumerate(items)))
    best, runs = a.longest(doc, least)
    assert dict(best) == {i: n for i, w in enumerate(items) if (n := shared(w, doc)) >= least}
    covered = {k for s, e in runs for k in range(s, e + 1)}
    want = {k for i in range(len(doc)) for n in range(least, len(doc) - i + 1) if any(shared(doc[i : i + n], w) == n for w in items) for k in range(i, i + n)}
    assert covered == want


DOCS = "doc_id long, text string, words int, item_id string"
ITEMS = "item_id long, passage string, task string"


def test_leaks_and_cleaning(spark, monkeypatch):
    rng = random.Random(1)
    voc = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(voc, k=20))) for i in range(30)] + [(40, None), (41, "")]
    p = [w.split() for _, w in items[:30]]
    docs = [
        (1, "x, y " + "- ".join(p[3][2:14]).upper() + ". tail"), (2, " ".join(p[4][:11])), (3, " ".join(p[5][:6]) + " gap " + " ".join(p[5][6:17])),
        (4, "\r\n> ".join(p[6])), (5, None), (6, "   "), (7, " ".join(p[7][:12]) + " word " * 30000 + " ".join(p[8])), (8, "\r\n> ".join(p[6])),
    ]
    d = spark.createDataFrame([(*x, 0, "clash") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "t") for x in items], ITEMS)
    want = {(1, 3, 12), (4, 6, 20), (7, 7, 12), (7, 8, 20), (8, 6, 20)}
    assert {(r.doc_id, r.item_id, r.words) for r in L.leaks(d, i).collect()} == want
    monkeypatch.setattr(L, "GROUP_WORDS", 100)
    assert len(L.automata(i)) > 1
    assert {(r.doc_id, r.item_id, r.words) for r in L.leaks(d, i).collect()} == want
    clean = {r.doc_id: (r.text, r.removed_words, r.dropped) for r in L.cleaned(d, i).collect()}
    assert clean[4] == (None, 20, True) and set(clean) == {1, 4, 7, 8}
    assert clean[7][1] == 32 and "w" not in clean[7][0].replace("word", "")


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert L.leaks(d, i).count() == 0
    assert L.cleaned(d, i).count() == 0


def test_words_of_any_script():
    assert [w for w, _, _ in L.spans("Größe_été 3,5 漢字 ÉA")] == ["größe", "été", "3", "5", "漢字", "éa"]
