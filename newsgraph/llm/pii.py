"""Personal data: pattern spans, and a linear-chain conditional random field over word shapes.

``find`` adds to every row the spans of four base kinds (email, ip, card, phone), taken leftmost
and without overlap per kind, and those of three kinds that no pattern settles (name, id, secret),
tagged by the random field. A method span that overlaps a base span gives way to it.

The field has a label per kind for its first and for its further words, and one for all else. A
word's class is its shape, its length range, and the word itself if the training table uses it as
context; weights of the class of a word and of its two neighbours, and of label pairs, are fitted
by conditional likelihood on the small labelled table below. Decoding is Viterbi, a batch of lines
of similar length at a time.

Edge cases: null and empty texts have no spans; spans are code-point offsets, end exclusive; lines
are decoded apart; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
METHOD = ("name", "id", "secret")
KINDS = BASE + METHOD
LABELS = ["O", *(f"{b}-{k}" for k in METHOD for b in "BI")]
CACHED_WORDS = 400_000
# Mean of the weights' prior for "no personal data", before any label is seen.
PRIOR = 5.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_WORD = re.compile(r"\S+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each address has one @, so matches are grown from it; a long run of letters costs no retries."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at) if start < at else None
        if end:
            found.append((start, end.end()))
            low = end.end()
        at = text.find("@", max(low, at + 1))
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _luhn(digits: str) -> bool:
    doubled = sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind and start; a match that fails its kind's test is dropped, not retried."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    digits = lambda m: _DIGITS.sub("", m[0])
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 12 and 13 <= len(d := digits(m)) <= 19 and _luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return found


# The labelled table: [kind words] marks a span; {a|b} stands for each choice in turn.
TABLE = """
a {man|woman} named [name {Anna Schmidt|Peter Olsen|Maria Lopez}] {and|but} that is {all|known}
{Mr.|Mrs.|Dr.|Ms.} [name {Jane Doe|Jean Dupont|Karl Huber}] {came|said|was} there
{Herr|Frau|Madame|Señora} [name {Julia Weber|Luc Martin|Ana Ruiz}] {hat|est|fue} it
signed {Mr.|Dr.} [name {Alan Brown|Eva Novak}] today
passport number [id {X1234567|C01X00T47|AB9876543}] {was|is} {lost|found}
passport no [id {K8837421|P2299310}] expired
ssn [id {123-45-6789|987-65-4320}] on file
ssn: [id {078-05-1120|219-09-9999}] here
iban [id {DE89370400440532013000|FR7630006000011234567890189}] for the transfer
token = [secret {"1a6c4f7bcf8c070fc75a8f6f8ed4b9a36b13d44c"|"21135a35f4dd810370798c4b15d2cb12deb58dd9"|"00f3aa98cc01d2e4b5967788aabbccdd"}]
{api_key|secret|password} = [secret {"a8Zx91Qw7Lm2Rt5Y"|"q7w8E9r0T1y2U3i4"|"9f8e7d6c5b4a39281706f5e4d3c2b1a0"}]
{api_key:|secret:|password:|token:} [secret {sk4f9A8b7C6d5E4f3G|Zm9vYmFyMTIzNDU2Nzg5|7d793037a0760186574b0282f2f435e7}]
The {house|Garden|Street} of {Anna|Peter|London|the} is {old|new|Large}
It was {1999|2024|12|3456} when The {Red|Old} Town {came|went} down
{Anna Schmidt|Peter Olsen|New York|Die Stadt|La Casa|Le Chat} {is|was|went} there
In {Der|Die|Das|The|Les} {Und|Ein|And|Que} {123|4567} {foo|bar} the
name of the {river|place|Game} is {long|Short}
the {Red|Blue} Cross and {Red|Blue} Moon | Table | Row | Cell
Mr. and Mrs. of the
a number {12345|99|1,234.50|3.14} in the {list|Text}
the token {is|was} {given|taken} = {5|none|x}
THE {WHOLE|BIG} LINE IS {LOUD|CAPITAL}
word {abc123|x9|mail4|h2o} and {2390409500648960|4952935900253052|190.137.223.204} the
{+1 (017) 555-7713|a.24@mail4.example.com|http://x.example.com/a/12} and of the
the%%% and### {of***|to&&&} in$$$ {the%%%|A###}
Version 2.0. of the Public License, {see|read} it
{Ñ|Ö|É|ö|é|ß}ab {Ção|Über|Élan|Enún|Beü.} Eneinberü {Öst|Été|Año} {ünd|été|año.} Ab
Ab {Cd|Ef} Gh {Ij|Kl} {MN|Op} Qr Stü. Vwé {x|y}ê Zañ
{ab.|cd,|ef:|gh;} Ij {kl!|mn?} Op {Qr.|St,|UV} wx {Yz|ÄB|éC} McX {aBc|A1|1a}
deadbeef {cafe1234|a1b2c3d4e5f60718293a4b5c6d7e8f9001122334} in {the|a} log
"""

_EDGE = "\"'`“”‘’«»()[]{}<>,;:.!?|*#%&$="
_CASES = str.maketrans({**{chr(c): "X" for c in range(65, 91)}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    """The table written out: words and their labels."""
    rows = []
    for line in filter(None, TABLE.splitlines()):
        pieces = re.split(r"(\{[^}]*\})", line)
        for chosen in product(*(p[1:-1].split("|") if p[:1] == "{" else [p] for p in pieces)):
            words, labels, kind = [], [], None
            for word in "".join(chosen).split():
                if word[0] == "[" and word[1:] in METHOD:
                    kind, first = word[1:], True
                    continue
                ends = word[-1] == "]" and kind is not None
                words.append(word[:-1] if ends else word)
                labels.append(LABELS.index(f"{'B' if first else 'I'}-{kind}") if kind else 0)
                first = False
                kind = None if ends else kind
            rows.append((words, labels))
    return rows


def shape(word: str) -> str:
    """Letters as X or x, digits as 0, runs shortened; other letters by case; with a range of length."""
    core = word.strip(_EDGE)
    if core.isalpha():
        return "x" if core.islower() else "Xx" if core[1:].islower() else "X" if core.isupper() else "mixed"
    s = core.translate(_CASES)
    if not s.isascii():
        s = "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in s)
    short = re.sub(r"(.)\1+", r"\1+", s)
    mixed = len(set(s) & set("Xx0"))
    if len(short) > 8:
        short = f"long{mixed}" if "0" in s else "longx"
    return f"{short}/{min(len(core) // 6, 3)}/{word[:1] if word[:1] in '+' else ''}{word[-1:] if word[-1:] in ':=' else ''}"


class _Classes(dict):
    """Word to class; cleared when full, so a worker's memory stays bounded."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> int:
        low = word.lower()
        field = self.field
        found = field.classes.get(f"={low}" if low in field.context else shape(word), field.unseen)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


class Field:
    """Classes, weights and decoding. States: label of a word; emissions by the class of it, its left and its right."""

    def __init__(self, steps: int = 80, decay: float = 0.05):
        rows = labelled_rows()
        context = {w for words, labels in rows for w, label, after in zip(words, labels, labels[1:], strict=False) if not label and after}
        self.context = {w.lower() for w in context if not any(c.isdigit() for c in w)}
        keys = {f"={w.lower()}" if w.lower() in self.context else shape(w) for words, _ in rows for w in words}
        self.classes = {key: i for i, key in enumerate(["", *sorted(keys)])}
        n, k = len(self.classes) + 1, len(LABELS)  # class 0 is beyond a line's ends, the last one of unseen shapes
        self.unseen = n - 1
        self.emit, self.pair = np.zeros((3, n, k)), np.zeros((k, k))
        self.barred, self.first = np.zeros((k, k)), np.zeros(k)
        for m in METHOD:
            inside = LABELS.index(f"I-{m}")
            self.barred[[i for i, label in enumerate(LABELS) if label not in (f"B-{m}", f"I-{m}")], inside] = -1e4
            self.first[inside] = -1e4
        words = _Classes(self)
        self._fit([[words[w] for w in row] for row, _ in rows], [labels for _, labels in rows], steps, decay)
        self.emit[:, self.unseen] = 0
        self.emit[0, self.unseen, 0] = PRIOR + 2
        self.advantage = self._advantage()

    def _fit(self, coded: list[list[int]], labels: list[list[int]], steps: int, decay: float) -> None:
        """Conditional likelihood by adaptive gradient steps, all rows side by side."""
        width = max(map(len, coded))
        pad = lambda rows: np.array([[*r, *[0] * (width - len(r))] for r in rows])
        x, y = pad(coded), pad(labels)
        lengths = np.array(list(map(len, coded)))
        rows, k = np.arange(len(x)), len(LABELS)
        inside = np.arange(width)[None, :] < lengths[:, None]
        truth = np.eye(k)[y] * inside[..., None]
        total = lambda v, axis: (m := v.max(axis=axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis=axis))
        past = [np.full(self.emit.shape, 1e-2), np.full(self.pair.shape, 1e-2)]
        around = self._around(x)
        prior = np.zeros_like(self.emit)
        prior[0, :, 0] = PRIOR
        self.emit += prior
        for _ in range(steps):
            move, scores = self.pair + self.barred, self.scores(x)
            ahead, back = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0] + self.first
            for t in range(1, width):
                ahead[:, t] = scores[:, t] + total(ahead[:, t - 1, :, None] + move, 1)
            for t in range(width - 2, -1, -1):
                on = (t + 1 < lengths)[:, None]
                back[:, t] = np.where(on, total(move + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
            z = total(ahead[rows, lengths - 1], 1)
            share = truth - np.exp(np.minimum(ahead + back - z[:, None, None], 0)) * inside[..., None]
            slopes = [-decay * (self.emit - prior), -decay * self.pair]
            for slot, at in enumerate(around):
                np.add.at(slopes[0][slot], at.ravel(), share.reshape(-1, k))
            for t in range(1, width):
                both = np.exp(np.minimum(ahead[:, t - 1, :, None] + move + (scores[:, t] + back[:, t])[:, None, :] - z[:, None, None], 0))
                slopes[1] += np.einsum("rk,rl->kl", truth[:, t - 1], truth[:, t]) - (both * inside[:, t, None, None]).sum(axis=0)
            for weight, slope, before in zip((self.emit, self.pair), slopes, past, strict=True):
                before += slope * slope
                weight += 0.3 * slope / np.sqrt(before)

    def _advantage(self) -> np.ndarray:
        """What a label can gain over O at one word at most, by slot, class and label.

        The best pair weight into a label is counted with it, that from a span out to O with its first word.
        """
        into = np.where(self.barred == 0, self.pair, -np.inf).max(axis=0) - self.pair[0, 0]
        gain = self.emit[:, :, 1:] - self.emit[:, :, :1]
        gain[0] += into[1:]
        for m in range(len(METHOD)):
            gain[0, :, 2 * m] += max(0.0, self.pair[2 * m + 1 : 2 * m + 3, 0].max() - self.pair[0, 0])
            gain[1, 0, 2 * m] += max(0.0, -into[2 * m + 1])  # the first word of a line has no pair weight before it
        gain[0, 0] = -1e4
        return np.ascontiguousarray(gain.transpose(0, 2, 1))

    def doubtful(self, classes: np.ndarray) -> np.ndarray:
        """Places of words at which a span may begin that beats O; class 0 stands between lines.

        A span gains at most the sum of its words' advantages, so a line without such a place is O
        throughout and needs no decoding. The best sum from a place on comes from running totals.
        """
        classes, left, right = self._around(classes)
        may = np.zeros(len(classes), bool)
        for m in range(len(METHOD)):
            first, more = (self.advantage[0, i][classes] + self.advantage[1, i][left] + self.advantage[2, i][right] for i in (2 * m, 2 * m + 1))
            total = np.cumsum(more)
            ahead = np.maximum.accumulate(total[::-1])[::-1] - total
            may |= first + np.maximum(ahead, 0) > -1e-6
        return np.nonzero(may)[0]

    @staticmethod
    def _around(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = np.zeros_like(classes), np.zeros_like(classes)
        left[..., 1:], right[..., :-1] = classes[..., :-1], classes[..., 1:]
        return classes, left, right

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """Emission of every word, of lines side by side: (lines, words, labels)."""
        return sum(self.emit[slot][at] for slot, at in enumerate(self._around(classes)))

    def decode(self, lines: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
        """Best labels of each line, by Viterbi over batches of lines of similar length."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(lines)
        order = np.argsort([len(x) for x in lines], kind="stable")[::-1]
        move, at = self.pair + self.barred, 0
        while at < len(order) and (width := len(lines[order[at]])):
            part = order[at : at + max(1, cells // width)]
            at += len(part)
            lengths = np.array([len(lines[i]) for i in part])
            padded = np.zeros((len(part), width), np.int32)
            for r, i in enumerate(part):
                padded[r, : lengths[r]] = lines[i]
            scores = self.scores(padded)
            best, came = scores[:, 0] + self.first, np.zeros((width, len(part), len(LABELS)), np.int8)
            live = np.searchsorted(-lengths, -np.arange(width), side="left")  # lines longer than t come first
            for t in range(1, width):
                m = live[t]
                reach = best[:m, :, None] + move
                came[t, :m] = reach.argmax(axis=1)
                best[:m] = reach.max(axis=1) + scores[:m, t]
            now = best.argmax(axis=1)
            labels = np.zeros((len(part), width), np.int8)
            for t in range(width - 1, -1, -1):
                m = live[t]
                labels[:m, t] = now[:m]
                now[:m] = came[t][np.arange(m), now[:m]] if t else now[:m]
            for r, i in enumerate(part):
                out[i] = labels[r, : lengths[r]]
        return out


@lru_cache(maxsize=1)
def field() -> Field:
    """The fitted field: some thousand weights, fitted once by the driver and sent with the tasks."""
    return Field()


def method_spans(text: str, offset: int, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of one line's labels: from its first word's core to its last word's."""
    words = [m.span() for m in _WORD.finditer(text)]
    found: list[tuple[str, int, int]] = []
    for i in np.nonzero(labels)[0].tolist():
        kind = LABELS[labels[i]][2:]
        a, b = words[i]
        core = text[a:b].strip(_EDGE)
        if not core:
            continue
        a += text[a:b].index(core)
        b = a + len(core)
        if LABELS[labels[i]][0] == "I" and found and found[-1][0] == kind:
            found[-1] = (kind, found[-1][1], b + offset)
        else:
            found.append((kind, a + offset, b + offset))
    return found


def spans_of(texts: list[str | None], tagger: Field, of: _Classes) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind in the order of KINDS, then start."""
    of = of.__getitem__
    lines, owners = [], []
    for d, text in enumerate(texts):
        rows = [line.split() for line in (text or "").split("\n")]
        ends = np.cumsum([len(words) + 1 for words in rows])
        coded = np.zeros(ends[-1], np.int32)  # class 0 stands after each line
        for words, end in zip(rows, ends.tolist(), strict=True):
            coded[end - 1 - len(words) : end - 1] = [of(w) for w in words]
        if not len(at := tagger.doubtful(coded)):
            continue
        doubted = set(np.searchsorted(ends, at, side="right").tolist())
        start = 0
        for number, line in enumerate(text.split("\n")):
            if number in doubted and rows[number]:
                lines.append(coded[ends[number] - 1 - len(rows[number]) : ends[number] - 1])
                owners.append((d, start, start + len(line)))
            start += len(line) + 1
    own: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (d, a, b), labels in zip(owners, tagger.decode(lines), strict=True):
        if labels.any():
            own[d] += method_spans(texts[d][a:b], a, labels)
    out = []
    for text, method in zip(texts, own, strict=True):
        base = base_spans(text or "")
        kept = [m for m in method if not any(m[1] < b and a < m[2] for _, a, b in base)]
        out.append(base + sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Column ``out``: an array of (kind, start, end)."""
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(item))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    tagger = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Classes(tagger)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = [n for n in part.schema.names if n != out]
                spans = spans_of(part.column(part.schema.get_field_index(text)).to_pylist(), tagger, of)
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(rows, arrow)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if text is None or not spans:
        return text
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df``, personal data in ``text`` replaced."""

    tagger = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Classes(tagger)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                i = part.schema.get_field_index(text)
                texts = part.column(i).to_pylist()
                clean = [redact(t, s) for t, s in zip(texts, spans_of(texts, tagger, of), strict=True)]
                yield part.set_column(i, part.schema.field(i), pa.array(clean, part.schema.field(i).type))

    return df.mapInArrow(run, df.schema)
