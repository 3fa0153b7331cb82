"""The prefilter of personal-data spans skips no line that holds one."""

import copy
import random

import numpy as np

from newsgraph.llm import pii


def _every_line(text, tagger, of):
    """Method spans with every line decoded."""
    found, start = [], 0
    for line in text.split("\n"):
        if words := line.split():
            (labels,) = tagger.decode([np.array([of[w] for w in words], np.int32)])
            found += pii.method_spans(line, start, labels)
        start += len(line) + 1
    base = pii.base_spans(text)
    return sorted(m for m in found if not any(m[1] < b and a < m[2] for _, a, b in base))


def test_nul_words_shift_no_line():
    tagger, draw = pii.field(), random.Random(3)
    of = pii._Classes(tagger)
    rows = [" ".join(words) for words, _ in pii.labelled_rows()]
    texts = ["\n".join(draw.choice([r, "\0", "\0 \0", "", "plain words only"]) for r in draw.choices(rows, k=8)) for _ in range(60)]
    got = [sorted(s for s in spans if s[0] not in pii.BASE) for spans in pii.spans_of([*texts, None, ""], tagger, of)]
    assert got == [*(_every_line(t, tagger, of) for t in texts), [], []] and any(got)


def test_first_word_of_a_line_pays_no_pair_weight():
    tagger, draw = copy.deepcopy(pii.field()), np.random.default_rng(8)
    for _ in range(20):
        tagger.emit = draw.normal(size=tagger.emit.shape)
        tagger.pair = draw.normal(size=tagger.pair.shape)
        tagger.pair[0, 0] = 5
        tagger.advantage = tagger._advantage()
        for line in (draw.integers(1, len(tagger.emit[0]), n).astype(np.int32) for n in (1, 1, 2, 3, 8)):
            spans = tagger.decode([line])[0].any()
            assert not spans or len(tagger.doubtful(np.array([0, *line, 0], np.int32)))
