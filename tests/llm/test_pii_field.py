"""The random field: decoding against enumeration of all labels, and spans of lines that it hasn't been trained on."""

from collections import Counter
from itertools import product

import numpy as np

from newsgraph.llm import pii

# [kind ...] marks what is to be found; none of the values stands in the training table.
HELD_OUT = """
Mr. [name Tomas Berg] was late and Mrs. [name Clara Meyer] was there
a woman named [name Lucy Hall] and all the others
Dr. [name Hugo Brandt] said it
Frau [name Greta Lang] ist da
Madame [name Claire Petit] est la
a man named [name Paul Stone] but that is known
signed Dr. [name Nina Fischer] today
passport number [id Z7654321] was found
passport no [id M5512093] expired
ssn [id 321-54-9876] on file
ssn: [id 555-12-3456] here
iban [id GB29601613319268190000] for the transfer
token = [secret "9c1e4f70aa8c070fc75a8f6f8ed4b9a36b13d4ff"] and more
api_key = [secret "Qw8Zx91Lm7Rt2Y5a"]
password: [secret Ab3Cd4Ef5Gh6Ij7Kl8]
secret: [secret 0f1e2d3c4b5a69788796a5b4c3d2e1f0]
The Garden of London is old
It was 1987 when The Blue Town went down
the name of the river is long
the token was given and taken
Version 3.1 of the General Licence, see there
In Das Ein 998 foo
THE BIG LINE IS CAPITAL
a number 4711 in the list
Peter went to New York and was there
the Red Cross and Blue Moon
word x7 and 4952935900003052 the
and### to&&& in$$$
"""


def _cases():
    for line in filter(None, HELD_OUT.splitlines()):
        text, spans, rest = "", [], line
        while "[" in rest:
            before, _, rest = rest.partition("[")
            inside, _, rest = rest.partition("]")
            kind, _, value = inside.partition(" ")
            core = value.strip(pii._EDGE)
            text += before
            start = len(text) + value.index(core)
            spans.append((kind, start, start + len(core)))
            text += value
        yield text + rest, spans


def test_held_out_lines():
    tagger = pii.field()
    texts, wanted = zip(*_cases(), strict=True)
    found = pii.spans_of(list(texts), tagger, pii._Classes(tagger))
    hit, made, due = Counter(), Counter(), Counter()
    for got, want in zip(found, wanted, strict=True):
        got = [s for s in got if s[0] in pii.METHOD]
        hit.update(k for k, _, _ in set(got) & set(want))
        made.update(k for k, _, _ in got)
        due.update(k for k, _, _ in want)
    figures = {k: (hit[k] / max(1, made[k]), hit[k] / due[k]) for k in pii.METHOD}
    print("precision, recall:", figures)
    assert all(p >= 0.8 and r >= 0.7 for p, r in figures.values()), figures


def test_decoding_equals_enumeration():
    tagger, draw = pii.field(), np.random.default_rng(4)
    k, move = len(pii.LABELS), tagger.pair + tagger.barred
    lines = [draw.integers(1, len(tagger.emit[0]), n).astype(np.int32) for n in (1, 2, 3, 4, 4, 3, 1)]
    for line, labels in zip(lines, tagger.decode(lines), strict=True):
        scores = tagger.scores(line[None])[0]
        total = lambda y: tagger.first[y[0]] + sum(scores[t, c] for t, c in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert np.isclose(total(tuple(labels.tolist())), max(map(total, product(range(k), repeat=len(line)))))


def test_slopes_equal_differences():
    """One step of the fit moves the weights along the gradient of the conditional likelihood, taken here from all labellings."""
    tagger = pii.Field(steps=0)
    tagger.emit = np.random.default_rng(6).normal(size=tagger.emit.shape)
    tagger.pair = np.random.default_rng(7).normal(size=tagger.pair.shape)
    x, y, k = [1, 2, 3], [0, 1, 2], len(pii.LABELS)

    def likelihood():
        scores, move = tagger.scores(np.array([x]))[0], tagger.pair + tagger.barred
        total = lambda l: tagger.first[l[0]] + sum(scores[t, c] for t, c in enumerate(l)) + sum(move[a, b] for a, b in zip(l, l[1:], strict=False))  # noqa: E731, E741
        return total(y) - np.log(sum(np.exp(total(l)) for l in product(range(k), repeat=len(x))))  # noqa: E741

    tagger.emit[0, :, 0] += pii.PRIOR  # the fit starts from its prior
    expected = np.zeros_like(tagger.pair)
    for a in range(k):
        for b in range(k):
            ends = []
            for step in (1e-5, -1e-5):
                tagger.pair[a, b] += step
                ends.append(likelihood())
                tagger.pair[a, b] -= step
            expected[a, b] = (ends[0] - ends[1]) / 2e-5
    tagger.emit[0, :, 0] -= pii.PRIOR
    before = tagger.pair.copy()
    tagger._fit([x], [y], 1, 0.0)
    # A step is 0.3 slope / sqrt(0.01 + slope ** 2).
    moved = (tagger.pair - before) / 0.3
    assert np.allclose(moved, expected / np.sqrt(1e-2 + expected**2), atol=1e-4)
