"""Sentence units of texts in many languages and scripts (problem 4).

Paragraphs come from the kind of line; within them each end mark (or blank, in scripts without end marks) is a candidate
boundary. A maximum-entropy model decides on it by the tokens on both sides, case, length, digits, script, marks and
quotes. It is trained on reliable boundaries only: the ends of paragraphs, with the start of the next one as the
following token, against all candidates inside paragraphs, which are unlabelled. As a paragraph may end after any
sentence, the share of labelled among true boundaries is constant within a script, and its probability divided by that share
is that of a boundary (positive-unlabelled learning); models fitted to the boundaries so told sharpen it.

Training takes a bounded sample of documents (``train_docs``); every document is then cut, whole. Features look at most 40
characters back and 60 ahead, which bounds the length of the words in them, not what is cut.

Defined cases: null, empty and blank texts have no units; a null kind of line is told from the text: blank lines between
lines of equal width mean printed lines; repeated rows give their units once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents the model is trained on, at most.
TRAIN_DOCS = 8_000
#: Calibrated probabilities between which the first model is unsure.
UNSURE = (0.1, 0.4)

# End marks, closing and opening quotes and brackets.
WIDE_ENDS = "。！？｡"
ENDS = ".!?؟۔…" + WIDE_ENDS
CLOSERS = "»”’\"')]}」』】）》〉›"
OPENERS = "«“‘\"'([{「『【（《〈‹-–—•*"
PAUSES = "،,;؛:、，；：" + ENDS
THAI = "฀-๿"

_CANDIDATE = re.compile(rf"([{re.escape(ENDS)}]+)((?:[{re.escape(CLOSERS)}]|\s»)*)")
_THAI_BLANK = re.compile(rf"(?<=[{THAI}])(?<!\d)[ \t ]+(?=(?!\d)[{THAI}{re.escape(OPENERS)}])")
_THAI_ANY = re.compile(f"[{THAI}]")
_BLANK_LINE = re.compile(r"\n[ \t\r ​﻿]*(?:\n[ \t\r ​﻿]*)+")
_WORD_BACK = re.compile(r"\S+$")
_WORD = re.compile(r"\S+")
_URL = re.compile(r"\S*(?:www\.|https?:|\.example|@)\S*", re.I)
_PAUSE = re.compile(rf"[{re.escape(PAUSES)}]")
_EDGE = " \t\n\r\x0b\f                 　​﻿‎‏⁠\x85"


def script_of(c: str) -> str:
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "latn"
    if 0x600 <= n < 0x780 or 0xFB50 <= n < 0xFE00 or 0xFE70 <= n < 0xFF00:
        return "arab"
    if 0x3040 <= n < 0x3100:
        return "kana"
    if 0x3400 <= n < 0xA000 or 0xF900 <= n < 0xFB00:
        return "hani"
    if 0xE00 <= n < 0xE80:
        return "thai"
    return "else"


def _shape(token: str) -> str:
    c = token[:1]
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "lower" if c.islower() else "upper" if c.isupper() else script_of(c)
    return "mark"


def paragraphs(text: str, kind: str | None) -> list[tuple[int, int]]:
    """Spans of the paragraphs; a line that stands alone is one."""
    printed = kind == "printed_lines"
    if kind not in ("printed_lines", "paragraphs"):
        lines = [x for x in text.split("\n") if x.strip()]
        longest = max(map(len, lines), default=0)
        printed = bool(_BLANK_LINE.search(text)) and (longest <= 100) or (len(lines) > 3 and longest <= 90 and sum(len(x) > 0.7 * longest for x in lines) > 0.6 * len(lines))
    spans, at = [], 0
    if not printed:
        for line in text.split("\n"):
            spans.append((at, at + len(line)))
            at += len(line) + 1
        return spans
    lines = []
    for line in text.split("\n"):
        lines.append((at, at + len(line), line.strip(_EDGE)))
        at += len(line) + 1
    # the width of the print is told by lines that are followed by another of the same block
    width = max((len(x) for (_, _, x), (_, _, y) in zip(lines, lines[1:]) if y), default=0)
    start = end = None
    previous = ""
    for a, b, line in lines:
        if not line:
            if start is not None:
                spans.append((start, end))
            start = None
            continue
        if start is not None:
            # a printed line goes on only where the next word had no room in it
            word = line.split(None, 1)[0]
            if len(previous) + 1 + len(word) <= width - 1:
                spans.append((start, end))
                start = None
        if start is None:
            start = a
        end, previous = b, line
    if start is not None:
        spans.append((start, end))
    return spans


def candidates(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start of the marks, end of the marks, just after the closers) of each candidate of a paragraph."""
    out = []
    part = text[start:end]
    # a blank of Thai is told by the letters on its sides, whatever else the paragraph holds
    thai = bool(_THAI_ANY.search(part))
    if thai:
        for m in _THAI_BLANK.finditer(part):
            if part[m.start() - 1] not in "ๆฯ":
                out.append((start + m.start(), start + m.start(), start + m.start()))
    for m in _CANDIDATE.finditer(part):
        a, b, c = m.start(1), m.end(1), m.end()
        if a == 0 and b - a > 3:
            continue
        after = part[c : c + 1]
        wide = part[b - 1] in WIDE_ENDS or (part[b - 1] == "…" and after and script_of(after) in ("hani", "kana"))
        if after and not after.isspace() and not wide:
            # marks within a token: only a missing blank between two words of a script without case, or before a capital
            # or an opening quote, is a candidate
            if not (after.isalpha() and (script_of(after) != "latn" or after.isupper()) or after in "«“") and not (m.group(2) and after.isalpha()) or b - a > 3 and part[a] == ".":
                continue
            back = _WORD_BACK.search(part[max(0, a - 60) : a])
            ahead = _WORD.match(part, c)
            if not back or len(back.group().strip(OPENERS)) < 2 or "." in back.group() or not ahead or len(ahead.group()) < 2 or ahead.group()[1:2] in "." or _URL.match(back.group() + part[a:b] + ahead.group()):
                continue
        if b - a >= 4 and part[a] == "." and re.match(r"\s*\d", part[c : c + 12]):
            continue
        out.append((start + a, start + b, start + c))
    if thai:
        out.sort()
    return out


def features(text: str, start: int, a: int, b: int, c: int, follow: str) -> tuple[str, list[str]]:
    """Script and features of a candidate: marks text[a:b], closers text[b:c], ``follow`` what comes next."""
    before = text[max(start, a - 40) : a].rstrip()
    word = _WORD_BACK.search(before)
    word = word.group().lstrip(OPENERS) if word else ""
    script = script_of(word[-1]) if word else "else"
    wide = script in ("hani", "kana")
    marks, quoted = text[a:b], text[b:c].strip()
    mark = marks if len(marks) == 1 else "…" if marks[0] in ".…" else marks[:1] + "+"
    ahead = follow[:40].lstrip()
    opened = ahead[:1] in OPENERS if ahead else False
    ahead = ahead.lstrip(OPENERS + " ")
    if wide or (ahead and script_of(ahead[0]) in ("hani", "kana")):
        word = word[-2:]
        token = ahead[:2]
    else:
        token = _WORD.match(ahead)
        token = token.group() if token else ""
    bare = token.rstrip(PAUSES + CLOSERS)
    pause = _PAUSE.search(ahead)
    tail = ahead[max(0, pause.start() - 1) : pause.start() + 1] if pause and pause.start() < 24 else ""
    q = "q" if quoted else ""
    shape = _shape(token)
    out = [
        "b" + script, f"m{script}{mark}{q}", f"p{word}", f"p{word}|{mark}", f"n{bare}", f"n{bare}|{q}{mark}", f"a{bare[:1]}|{script}", f"a2{bare[:2]}|{q}",
        f"s{_shape(word[-1:])}{mark}{shape}", f"l{min(len(word), 4)}{mark}{script}", f"i{'.' in word}{mark}", f"o{opened}{q}", f"t{tail}{q}", f"w{shape}{q}{mark}",
    ]
    if wide:
        out += [f"c{ahead[:1]}{q}", f"c3{ahead[:3]}{q}", f"c4{ahead[2:4]}{q}"]
    return script, out


class Model:
    """Weights of a trained maximum-entropy model; a candidate is a boundary where their sum is not negative."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum([get(n, 0.0) for n in names])


def examples(text: str, kind: str | None) -> Iterator[tuple[str, list[str], int]]:
    """Script, features and label of the candidates of a text; its last paragraph, perhaps cut off, is left out."""
    spans = [(a, b) for a, b in paragraphs(text, kind) if text[a:b].strip(_EDGE)]
    for (start, end), (after, last) in zip(spans, spans[1:]):
        stop = len(text[:end].rstrip(_EDGE))
        for a, b, c in candidates(text, start, stop):
            if a == b:
                continue
            final = c >= stop
            yield *features(text, start, a, b, c, text[after:last] if final else text[c : min(stop, c + 60)]), int(final)


def _fit(rows, cols, n_features: int, y, weight, rounds: int, l2: float):
    """Weights by full-batch gradient steps of adaptive size."""
    w, g2 = np.zeros(n_features), np.full(n_features, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(rows, w[cols], len(y))))
        g = np.bincount(cols, (weight * (p - y))[rows], n_features) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def train(samples: list[tuple[str, list[str], int]], rounds: int = 120, l2: float = 2.0, least: int = 5, again: int = 3) -> Model:
    """A first model tells labelled from unlabelled candidates; its probability over the labelled share of the script is
    that of a boundary. ``again`` more models are fitted to the boundaries told by the one before, the first of them
    without the unsure. Features seen fewer than ``least`` times are left out."""
    if not samples:
        return Model({"bias": 1.0})
    count: dict[str, int] = {}
    for _, names, _ in samples:
        for n in names:
            count[n] = count.get(n, 0) + 1
    index = {n: i for i, n in enumerate(n for n, c in count.items() if c >= least)}
    pairs = [(i, index[n]) for i, (_, names, _) in enumerate(samples) for n in names if n in index]
    if not pairs:
        return Model({"bias": 1.0})
    rows, cols = np.array(pairs).T
    label = np.array([x[2] for x in samples], float)
    scripts = np.array([x[0] for x in samples])
    prob = lambda w: 1 / (1 + np.exp(-np.bincount(rows, w[cols], len(label))))
    w = _fit(rows, cols, len(index), label, np.ones(len(label)), rounds, l2)
    p = prob(w)
    truth = np.zeros(len(label))
    for s in set(scripts.tolist()):
        at = scripts == s
        share = p[at & (label == 1)].mean() if (at & (label == 1)).sum() >= 20 else p[label == 1].mean() if label.any() else 1.0
        truth[at] = np.minimum(1, p[at] / max(share, 1e-6))
    sure = np.where((truth > UNSURE[1]) | (truth < UNSURE[0]) | (label == 1), 1.0, 0.0)
    for _ in range(again):
        w = _fit(rows, cols, len(index), np.where(label == 1, 1.0, truth > sum(UNSURE) / 2), sure, rounds, l2)
        truth, sure = prob(w), np.ones(len(label))
    return Model({n: round(float(w[i]), 3) for n, i in index.items() if abs(w[i]) > 0.01})


def units(text: str, kind: str | None, model: Model) -> list[tuple[int, int]]:
    """Spans of the units of a text."""
    out = []
    for start, end in paragraphs(text, kind):
        part = text[start:end]
        stop = start + len(part.rstrip(_EDGE))
        at = start + len(part) - len(part.lstrip(_EDGE))
        if at >= stop:
            continue
        for a, b, c in candidates(text, start, stop):
            if c >= stop or a < at:
                continue
            if a != b and model.score(features(text, start, a, b, c, text[c : min(stop, c + 60)])[1]) < 0:
                continue
            out.append((at, c))
            at = c
            while at < stop and text[at] in _EDGE:
                at += 1
        if at < stop:
            out.append((at, stop))
    return out


def train_on(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model of a sample of at most ``train_docs`` documents, those with the least hashes of their ids and texts: the same
    sample in the same order however the documents are partitioned. Hashes far above the share asked for aren't sorted."""
    src = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("line_kind").cast("string").alias("kind")).filter("length(trim(text)) > 0")
    src = src.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    most = (1 << 30) * (train_docs * 5 // 4 + 100) // max(1, documents.count())
    picked = src.filter(F.col("h") <= most).orderBy("h", "doc_id", "kind").limit(train_docs).select("text", "kind").toPandas()
    return train([x for t, k in zip(picked.text, picked.kind) for x in examples(t, k)])


def sentence_units(documents: DataFrame, model: Model | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, start_pos, end_pos of the units of every document. No shuffle but that of the sample."""
    model = model or train_on(documents, train_docs)
    sent = documents.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(sent.value)
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text, kind in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    for a, b in units(text, kind, own):
                        ids.append(doc)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"])

    src = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("line_kind").cast("string"))
    return src.mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")
