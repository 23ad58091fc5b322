import random

import pytest

from lodevec.llm import pii

DOCS = "doc_id long, text string, kind string"
NAMES = "name string, kind string"
GIVEN, FAMILY = ["Maralle", "Jesith", "Dorin", "Quinath", "Velora", "Tory"], ["Ostberg", "Wexkin", "Prydow", "Lundmark", "Haraley"]

#: Sentences written for this test; the second set shares no sentence with the first.
FRAMES = {
    "name": [
        ["{} keeps bees behind the mill.", "The choir was led by {} that year.", "Author: {}", "Am Abend kam {} zu spät zur Probe.", "Le piano est à {} depuis hier."],
        ["A vote of thanks went to {} at noon.", "Nobody but {} had a key to the cellar.", "Gestern hat {} den Zaun gestrichen.", "Name: {}", "Para {} era la primera vez."],
    ],
    "email": [
        ["Anything urgent goes to {} overnight.", "E-mail: {}", "Fotos bitte an {} schicken.", "The form lists {} as a second choice."],
        ["You may send the keys to {} by Monday.", "Manda las fotos a {} mañana.", "Inbox {} is full again.", "Ask at {} for a ticket."],
    ],
    "phone": [
        ["Phone: {}", "The porter can be reached on {} until nine.", "Rückruf bitte unter {} bis Freitag.", "Since spring the shop answers under {} only.", "We tried {} twice last night."],
        ["She picked up at {} after the third attempt.", "Apunta el {} por si te pierdes.", "Our new line, {}, opens in May.", "Le gardien répond au {} le matin.", "Cell {} works best."],
    ],
    "ident": [
        ["Passport number: {}", "The clerk copied {} from the papers twice.", "Social security: {}", "Le dossier porte la mention {} en haut.", "Her licence, {}, had run out."],
        ["In der Akte steht {} neben dem Stempel.", "The officer wrote {} into the register.", "En la ficha figura {} junto a la foto.", "Ausweis {} liegt bei.", "They asked him to repeat {} slowly."],
    ],
    "address": [
        ["The van stops at {} every Tuesday.", "Address: {}", "Das Paket ging an {} zurück.", "Nos vemos en {} esta noche."],
        ["Our aunt moved to {} in the summer.", "A lamp was broken near {} yesterday.", "Elle a grandi au {} avec ses soeurs.", "Lieferung nach {} am Montag."],
    ],
}
DECOYS = [
    "Mount Ostberg rises behind the lake.", "The Wexkin theorem fills a whole chapter.", "Article 485-3427-80 is sold in pairs.", "Invoice 0309702926 was paid in March.", "Batch 20231025-9140 left the plant.",
    "We met on 2023-10-25 in the garden.", "Page 6526337 of the archive is missing.", "Model A816644 comes in blue.", "Release 10.83.44.69 fixed the lamp.", "A New Garden Shed Plan", "the words of a quiet search list keep every mill near",
    "Ein Korb mit Äpfeln stand am Zaun.", "Die Rechnung 4287914617 liegt bei.", "Row 9689886 was read twice.", "the bees and the choir and the cellar key", "a vote at the mill in summer",
]


def value(kind, rng):
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    local = f"{g}.{f}".lower()
    return {
        "name": lambda: rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} R. {f}", f"{g} van {f}", f"{g}-{rng.choice(GIVEN)} {f}"]),
        "email": lambda: rng.choice([f"{local}@mail.example", f"{local} [at] site [dot] test", f"{local} AT site DOT test"]),
        "phone": lambda: rng.choice(["+44 7700 900{:03d}", "(201) 555 0{:03d}", "201-555-0{:03d}", "+12015550{:03d}", "07700 900 {:03d}", "+49 30 23125 {:03d}"]).format(rng.randint(100, 199)),
        "ident": lambda: rng.choice(["9{:02d}-12-3456", "00-123-4{:02d}-99", "ZZ12345{:02d}", "QQ 12 34 {:02d} C", "XX{:02d}-K12345"]).format(rng.randint(10, 99)),
        "address": lambda: rng.choice(["12 Moli Street, Elda 12345", "Flat 3B, 7 Heso Lane, Coro", "Tarostraße 70, 64010 Core", "23 bis, rue de Sede, 61285 Core", "Calle Moli, 17, 2.º B, 65261 Fara", "9 Gani Road\nTarra 53246", "416 Brae Ln, Apt 13, Tarre, 03429"]),
    }[kind]()


def corpus(part, seed=1, n=250):
    """Texts with planted values and decoys, from one set of the frames; ((doc_id, kind, value) truth)."""
    rng, docs, truth = random.Random(seed), [], set()
    for d in range(n):
        lines = []
        for kind in rng.sample(pii.KINDS, 3):
            v = value(kind, rng)
            lines.append(rng.choice(FRAMES[kind][part]).format(v))
            truth.add((d, kind, v))
        lines += rng.sample(DECOYS, 4)
        rng.shuffle(lines)
        docs.append((d, "\n".join(lines), "clash"))
    return docs, truth


KNOWN = [(x, "given") for x in GIVEN[:4]] + [(x, "family") for x in FAMILY[:3]] + [(None, None)]


@pytest.fixture(scope="module")
def found(spark):
    docs, truth = corpus(0)
    docs += [(9001, None, ""), (9002, "", ""), (9003, "  \n", ""), (9004, "word " * 30_000 + "Phone: +44 7700 900123", "")]
    truth = truth | {(9004, "phone", "+44 7700 900123")}
    d, n = spark.createDataFrame(docs, DOCS), spark.createDataFrame(KNOWN, NAMES)
    return docs, truth, d, n, {(r.doc_id, r.kind, r.value) for r in pii.found(d, n).collect()}


def check(truth, got, least):
    for kind in pii.KINDS:
        want, have = {x for x in truth if x[1] == kind}, {x for x in got if x[1] == kind}
        assert len(want & have) >= least * len(want), (kind, len(want & have), len(want), sorted(want - have)[:5])
        assert len(want & have) >= least * len(have), (kind, len(want & have), len(have), sorted(have - want)[:5])


def test_planted_values_are_found(found):
    check(found[1], found[4], 0.95)


def test_sentences_never_seen(found):
    """Fitted on one set of frames, applied to another: values of each kind are found in sentences of a new kind."""
    docs, truth = corpus(1, seed=2)
    g = pii.gazetteer(found[2], found[3])
    patterns = {}
    for _, t, _ in found[0]:
        for s in pii.spans(t, g) if t else ():
            patterns[s.kind, s.votes, s.form] = patterns.get((s.kind, s.votes, s.form), 0) + 1
    w = pii.fitted(patterns)
    got = set()
    for d, t, _ in docs:
        cands = [s.__dict__ for s in pii.spans(t, g)]
        say = {p: w[pii.features(*p)].sum() for p in ((c["kind"], c["votes"], c["form"]) for c in cands)}
        got |= {(d, s["kind"], s["value"]) for s in pii.decided(cands, say)}
    check(truth, got, 0.9)


def test_redaction_leaves_the_rest(found):
    docs, _, d, n, got = found
    texts = {x[0]: x[1] for x in docs}
    for r in pii.redacted(d, n).collect():
        if texts[r.doc_id] is None:
            assert r.text is None and r.replaced == 0
            continue
        t = r.text
        for kind in pii.KINDS:
            t = t.replace(f"[{kind}]", "\0")
        at = 0
        for piece in t.split("\0"):
            at = texts[r.doc_id].find(piece, at)
            assert at >= 0
            at += len(piece)
        assert (r.replaced == 0) == (not any(x[0] == r.doc_id for x in got))


def test_no_documents_and_no_names(spark):
    none, names = spark.createDataFrame([], DOCS), spark.createDataFrame([], NAMES)
    assert pii.found(none, names).count() == 0
    d = spark.createDataFrame([(i, "The shop answers under +44 7700 900123. Invoice 0309702926 was paid.", "") for i in range(20)], DOCS)
    assert {(r.kind, r.value) for r in pii.found(d, names).collect()} == {("phone", "+44 7700 900123")}


def test_label_model_learns_reliability():
    """Three labelers that mostly agree outweigh one that votes at random; abstaining counts for nothing."""
    rng = random.Random(3)
    counts = {}
    for _ in range(5000):
        y = rng.random() < 0.4
        good = [(1 if y else -1) if rng.random() < 0.95 else (-1 if y else 1) for _ in range(3)]
        v = ("name", (*good, rng.choice([-1, 1]), 0, 0, 0))
        counts[v] = counts.get(v, 0) + 1
    m = pii.LabelModel.fit(counts)
    assert abs(m.prior["name"] - 0.4) < 0.05
    assert m.probability("name", (1, 1, 1, -1, 0, 0, 0)) > 0.95 and m.probability("name", (-1, -1, -1, 1, 0, 0, 0)) < 0.05
    assert m.probability("name", (0, 0, 0, 0, 0, 0, 0)) == pytest.approx(m.prior["name"])
    assert m.probability("email", (1, 1, 1, 1, 1)) == 0


def test_words_are_counted_as_written(spark):
    d = spark.createDataFrame([(1, "The bee saw Maralle; maralle@x.example", ""), (2, "the Bee saw MARALLE", ""), (3, None, "")], DOCS)
    g = pii.gazetteer(d, spark.createDataFrame(KNOWN, NAMES))
    for a, small, capital in (("bee", 4, 4), ("maralle", 0, 4)):
        assert all((g.small[i], g.capital[i]) == (small, capital) for i in pii.slots(a))
