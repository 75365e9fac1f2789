"""The field's choice against all segmentations, and what it adds on lines written by hand."""

import random

import pytest

from tidemark.llm import pii

#: written by hand, none of them by the generators that the field is trained with: text, and the spans that have to be found
ADDED = [
    ("You can ring our office on 020-7946-0991 until six.", "phone", "020-7946-0991"),
    ("Tel. (415) 555-2671, ask for Marta.", "phone", "(415) 555-2671"),
    ("Phone: 415-555-2671 x 12", "phone", "415-555-2671"),
    ("his mobile is 312.555.0142 I think", "phone", "312.555.0142"),
    ("Fax (030) 901-820, Berlin", "phone", "(030) 901-820"),
    ("contact: maria.silva (at) uni-porto (dot) pt", "email", "maria.silva (at) uni-porto (dot) pt"),
    ("mail kwame_b[at]example[dot]net for a copy", "email", "kwame_b[at]example[dot]net"),
    ("E-mail: info (at) museum.example.org.", "email", "info (at) museum.example.org"),
    ("reach me via j-lee(at)lab.example.edu today", "email", "j-lee(at)lab.example.edu"),
    ("card number 4111.1111.1111.1111 was used", "card", "4111.1111.1111.1111"),
    ("paid with visa 4012/8888/8888/1881 in May", "card", "4012/8888/8888/1881"),
    ("the card 5500.0000.0000.0004 expired", "card", "5500.0000.0000.0004"),
]
NOTHING = [
    "The battle of 1815-06-18 ended at dusk.", "ISBN 978-3-16-148410-0 is out of print.", "Between 1990 and 2010 sales rose from 1,200,300 to 4,500,600.", "Order 4111.1111.1111.1112 was sent back.",
    "Version 10.4.11.2 fixes bug 1234567.", "We met at (about) noon at the old mill.", "From 12.05.2021 to 14.06.2021 the bridge was closed.", "pi is 3.14159265358979 and e is 2.718281828", "Serial no. 000-111-22-333", "the score was 21-19, 19-21, 21-17",
    "Look at dot com stocks of 2001.", "GPS 52.520008, 13.404954", "temperatures of 20 21 22 23 24 25 degrees",
]


@pytest.fixture(scope="module")
def weights():
    return pii.fit(pii.training_windows([]))


def best(text, weights):
    """The largest sum of scores over all ways of placing spans that don't overlap."""
    spans = []
    for kind, atoms in pii.regions(text):
        atoms = list(atoms)
        scored = [(atoms[i][0], atoms[j - 1][1], sum(weights.get(x, 0.0) for x in f)) for i, j, _, f in pii.candidates(text, kind, atoms)]
        spans += [x for x in scored if x[2] >= pii.MARGIN]
    spans.sort()

    def most(k, free):
        return 0.0 if k == len(spans) else max(most(k + 1, free), spans[k][2] + most(k + 1, spans[k][1]) if spans[k][0] >= free else 0.0)

    return most(0, 0)


def test_decode_is_the_best_of_all_segmentations(weights):
    rng = random.Random(5)
    parts = ["415-555-2671", "(212) 555 0187", "4111.1111.1111.1111", "2024-05-11", "x (at) y (dot) org", "1.2.3.4", " and ", ", ", " tel ", "-", " ", "77", "900 100 200"]
    some = 0
    for _ in range(400):
        text = "call " + "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        found = pii.decode(text, weights)
        assert sum(s for *_, s in found) == pytest.approx(best(text, weights))
        places = sorted((a, b) for _, a, b, _ in found)
        assert all(x[1] <= y[0] for x, y in zip(places, places[1:], strict=False))
        some += bool(found)
    assert some > 100


def test_lines_written_by_hand(weights):
    hits = []
    for text, kind, s in ADDED:
        at = text.index(s)
        hits.append((kind, at, at + len(s)) in [x[:3] for x in pii.decode(text, weights)])
    wrong = [(t, x) for t in NOTHING for x in pii.decode(t, weights)]
    assert sum(hits) >= 10 and len(wrong) <= 2
