"""Problem 4: sentence boundaries across languages and scripts.

Method: characters are tagged boundary or inside by a linear-chain conditional random field with Viterbi decoding.
Only characters at which a sentence could end at all, before a gap or after an end mark (``places``), are free;
all others are inside. Emissions are log-linear in the words, marks and scripts around a place; they and the
transitions between tags are trained together by the likelihood of whole tag sequences (forward-backward), on
records whose boundaries are given and again on the same records with their end marks stripped, which is what
teaches the model scripts and texts that write none.

* The model is fitted on at most ``TRAIN_ROWS`` labelled records, taken in the order of a hash of
  their key; rows whose given boundaries cannot be right (inside a word, gaps with text) are left
  out, and after a first fit those that the model finds far from likely.
* Tagging is a map over rows: no shuffle, no state between rows, whole texts.

Edge cases: null, empty and blank texts give no sentence; a text without letters is one unit per
paragraph; an empty line always ends a unit; if no usable labelled record exists the model falls back
to ``PRIOR`` weights on end marks; repeated deliveries give the same rows once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import consistent, folded

#: Labelled records the model is fitted on at most.
TRAIN_ROWS = 6000
#: Rounds over them, and occurrences a feature needs.
EPOCHS, LEAST = 5, 2

END = ".!?…。！？।؟;｡"
OPEN, CLOSE = "\"'„«“‘([「『", "\"'”»“’)]」』"
_END_RUN = re.compile(rf"[{re.escape(END)}]+[{re.escape(CLOSE)}]*")
_CHUNK = re.compile(r"\S+")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_PAIRS = {"„": "”", "«": "»", "(": ")", "“": "”", "「": "」", "[": "]"}
_ENDS = set(_PAIRS.values())

#: Feature of a place that can be no boundary: marks that close what stands before it.
NEVER = "never"
#: Emission of a fixed tag, and features of a place at most.
FIXED, MOST = -1e6, 48
#: Used only where nothing is labelled.
PRIOR = {"bias": -4.0, "m=.": 5.0, "m=!": 5.0, "m=?": 5.0, "m=…": 4.0, "m=...": 4.0, "m=。": 8.0, "m=।": 8.0, "m=؟": 8.0, "c=a": -4.0, "s=TT": 8.0, "s=T ": 8.0, "nosp,L": -8.0}


@lru_cache(maxsize=1 << 14)
def _script(ch: str) -> str:
    """A coarse script: L(atin-like), T(hai), C(JK), D(evanagari), A(rabic), d(igit) or blank."""
    o = ord(ch)
    if 0xE00 <= o < 0xE80:
        return "T"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x32000:
        return "C"
    if 0x900 <= o < 0x980:
        return "D"
    if 0x600 <= o < 0x780:
        return "A"
    return "L" if ch.isalpha() else "d" if ch.isdigit() else " "


@lru_cache(maxsize=1 << 16)
def _parts(chunk: str) -> tuple[str, str, str, str, str]:
    """Leading marks, core as written, core folded, trailing marks, and case of the core."""
    clean = consistent(chunk)
    m = _CORE.search(clean)
    if not m:
        return clean, "", "", "", "-"
    core = m.group()
    c = core[0]
    case = "0" if c.isdigit() else "A" if c.isupper() and len(core) > 1 and core.isupper() else "U" if c.isupper() else "a" if c.islower() else "o"
    low = folded(core)
    return clean[: m.start()], core, "0" * len(low) if low.isdigit() else low, clean[m.end() :], case


def _closing(marks: str, quoted: bool) -> bool:
    """Whether marks that stand alone belong to the sentence before them."""
    c = marks[:1]
    return bool(c) and (c in END or c in CLOSE and c not in OPEN or quoted and c in "\"'”")


def places(text: str) -> list[tuple[int, int]]:
    """Where a sentence could end: ``(end of what stands before, start of what follows)``."""
    out = []
    for m in _CHUNK.finditer(text):
        a, b = m.span()
        if out and out[-1][1] < 0:
            out[-1] = (out[-1][0], a)
        if m.end() - m.start() > 1:
            for e in _END_RUN.finditer(text, a, b):
                if e.end() < b:
                    out.append((e.end(), e.end()))
        out.append((b, -1))
    return out[:-1]  # the end of the text is no question


def features(text: str, where: list[tuple[int, int]]) -> list[list[str]]:
    """Names of the active features at each place."""
    cuts = [0, *(b for _, b in where), len(text)]
    parts = [_parts(text[a : e].strip()) for a, e in zip(cuts, [*(a for a, _ in where), len(text)])]
    cores = [p[2] for p in parts]
    letters = [c for c in text if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    shape = "l" if not upper else "u" if upper * 2 > len(letters) else "m"
    if shape == "m" and sum(p[4] in "UA" for p in parts) * 10 > 7 * sum(p[4] in "UAa" for p in parts):
        shape = "t"
    marked = "1" if any(_END_RUN.search(p[3] or p[0]) for p in parts[:-1]) else "0"
    final = "1" if _END_RUN.search(parts[-1][3] or parts[-1][0]) else "0"
    doc = shape + marked + final
    out, depth, since = [], [], 0
    held = ("", "-", "")  # core, case and closing marks of what stands before, over chunks of marks alone
    for i, (a, b) in enumerate(where):
        p, q = parts[i], parts[i + 1]
        for c in text[cuts[i] : a]:
            if depth and c == depth[-1]:
                depth.pop()
            elif c in _PAIRS:
                depth.append(_PAIRS[c])
            elif c == '"':
                depth.append('"') if '"' not in depth else depth.remove('"')
        since += 1
        held = (p[2], p[4], p[3]) if p[2] or not _closing(p[0], True) else (held[0], held[1], held[2] + p[0])
        tail = held[2] if p[2] or _closing(p[0], True) else p[0]
        mark = "".join(c for c in tail if c in END or c in ",:-—")[:4]
        shut = "1" if any(c in CLOSE for c in tail) else "0"
        inside = "1" if depth else "0"
        pw, nw = held[0], q[2]
        p2 = cores[i - 1] if i else "^"
        n2 = cores[i + 2] if i + 2 < len(cores) else "$"
        gap = text[a:b]
        lines = "2" if _BLANK_LINE.search(gap) else "1" if "\n" in gap else "0" if gap else "n"
        left, right = _script(text[a - 1]), _script(text[b]) if b < len(text) else " "
        case = q[4]
        lead = q[0][:2] if q[2] else "*" + q[0][:2]
        strong = mark if mark.strip(",:-—") else ""
        f = ["bias", f"doc={doc}", f"m={mark}", f"m={mark},{doc}", f"m={mark},{shut},{inside},{case}", f"m={mark},{case},{shape}", f"c={case}",
             f"c={case},{doc}", f"l={lead}", f"l={lead},{mark},{doc}", f"w={pw},{mark}", f"n={nw},{doc}", f"nn={nw} {n2},{marked}", f"n={nw},{mark}",
             f"n2={n2},{doc}", f"p2={p2},{marked}", f"pp={p2} {pw},{mark}", f"pn={pw} {nw},{mark}", f"ps={pw[-3:]},{marked}", f"ns={nw[-3:]},{doc}",
             f"psns={pw[-2:]},{nw[-2:]},{marked}", f"g={lines}", f"s={left}{right}", f"s={left}{right},{mark}", f"in={inside},{mark}", f"pc={held[1]}{case},{doc}", f"pl={min(len(pw), 4)},{mark},{case}",
             f"since={min(since, 9)},{marked}", f"after={cores[i + 3] if i + 3 < len(cores) else '$'},{marked}", f"n3={nw} {n2} {cores[i + 3] if i + 3 < len(cores) else '$'}"]
        if not nw:
            f += ["bare", f"bare,{mark},{shut}"]
            if _closing(q[0], inside == "1"):
                f.append(NEVER)
        if lines == "n":
            f += [f"nosp,{right}", f"nosp,{mark},{right},{case}", f"nosp,{tail[-1:]},{text[b]}", f"nosp,{tail[-1:]},{inside}"]
        out.append(f)
        if strong:
            since = 0
    return out


def gold_tags(text: str, spans: list[tuple[int, int]], where: list[tuple[int, int]]) -> list[int] | None:
    """Tags of the places under given boundaries; None where those cannot be right."""
    if not spans or text[: spans[0][0]].strip() or text[spans[-1][1] :].strip():
        return None
    ends = {}
    for (a, b), (c, d) in zip(spans, spans[1:]):
        if not (0 <= a < b <= c < d <= len(text)) or text[b:c].strip():
            return None
        ends[b] = c
    tags, met = [], 0
    for a, b in where:
        on = ends.get(a) == b
        met += on
        tags.append(int(on))
    return tags if met == len(ends) else None


def stripped(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the end marks of its sentences, and its boundaries there."""
    out, at, new = [], 0, []
    for k, (a, b) in enumerate(spans):
        body = text[a:b].rstrip(END)
        body = body or text[a:b]
        gap = (text[spans[k - 1][1] : a] or " ") if k else ""
        out.append(gap + body)
        new.append((at + len(gap), at + len(gap) + len(body)))
        at += len(gap) + len(body)
    return "".join(out), new


def best_tags(emissions: list[float], forced: list[bool], moves: list[list[float]]) -> list[int]:
    """Best tag sequence (Viterbi) with the forced boundaries."""
    if not emissions:
        return []
    (m00, m01), (m10, m11) = moves
    s0, s1 = 0.0, -math.inf  # the text starts like the place after an inside tag
    back = []
    for e, on in zip(emissions, forced):
        a0, b0 = s0 + m00, s1 + m10
        a1, b1 = s0 + m01, s1 + m11
        back.append((a0 < b0, a1 < b1))
        s0, s1 = max(a0, b0), max(a1, b1) + e
        if on:
            s0 = -math.inf
    tag = int(s1 > s0)
    out = [tag]
    for k in range(len(emissions) - 1, 0, -1):
        tag = int(back[k][tag])
        out.append(tag)
    return out[::-1]


class Model:
    """Emission weights by feature name, and transition weights between tags."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]) -> None:
        self.weights, self.moves = weights, moves

    def emissions(self, text: str, where: list[tuple[int, int]]) -> list[float]:
        get = self.weights.get
        return [FIXED if NEVER in fs else sum(get(f, 0.0) for f in fs) for fs in features(text, where)]

    def tags(self, text: str, where: list[tuple[int, int]]) -> list[int]:
        """Best tag sequence; a blank line is always a boundary."""
        return best_tags(self.emissions(text, where), [bool(_BLANK_LINE.search(text, a, b)) for a, b in where], self.moves)

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of each sentence, without outer whitespace."""
        if not text or not text.strip():
            return []
        where = places(text)
        edges = [w for w, t in zip(where, self.tags(text, where)) if t]
        starts = [len(text) - len(text.lstrip()), *(b for _, b in edges)]
        return list(zip(starts, [*(a for a, _ in edges), len(text.rstrip())]))


class Sequence:
    """A labelled text for training: feature numbers, tags, and which places are never or always boundaries."""

    def __init__(self, ids: np.ndarray, tags: list[int], never: np.ndarray, always: np.ndarray) -> None:
        self.ids, self.tags, self.never, self.always = ids, np.array(tags, dtype=np.float64), never, always

    def emissions(self, w: np.ndarray) -> np.ndarray:
        return np.where(self.never, FIXED, np.where(self.always, -FIXED, w[self.ids].sum(1)))


def marginals(e: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a boundary at each place of padded sequences, and the expected counts of the moves.

    ``e`` are emissions by sequence and place, ``real`` says which places exist; sequences start after an inside tag.
    """
    n, t = e.shape
    alpha, beta = np.zeros((t, 2, n)), np.zeros((t, 2, n))
    alpha[0] = moves[0][:, None]
    alpha[0, 1] += e[:, 0]
    for k in range(1, t):
        for j in (0, 1):
            alpha[k, j] = np.logaddexp(alpha[k - 1, 0] + moves[0, j], alpha[k - 1, 1] + moves[1, j]) + (e[:, k] if j else 0.0)
        alpha[k] = np.where(real[:, k], alpha[k], alpha[k - 1])
    for k in range(t - 2, -1, -1):
        on = beta[k + 1, 1] + e[:, k + 1]
        for i in (0, 1):
            beta[k, i] = np.where(real[:, k + 1], np.logaddexp(beta[k + 1, 0] + moves[i, 0], on + moves[i, 1]), 0.0)
    whole = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
    p = np.exp(np.minimum(alpha + beta - whole, 0.0))
    counts = np.zeros((2, 2))
    counts[0] += p[0].sum(1)
    for i in (0, 1):
        for j in (0, 1):
            x = alpha[:-1, i] + moves[i, j] + beta[1:, j] - whole + (e[:, 1:].T if j else 0.0)
            counts[i, j] += np.exp(np.minimum(x, 0.0))[real[:, 1:].T].sum()
    return p[:, 1].T, counts


def _fit(data: list[Sequence], width: int, epochs: int = EPOCHS, batch: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``width`` features and moves that maximise the likelihood of the tag sequences (Adagrad).

    Feature 0 is none and keeps the weight 0.
    """
    w, g2 = np.zeros(width), np.full(width, 1e-2)
    moves, m2 = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    data = [d for d in data if len(d.tags)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        mixed = order.permutation(len(data))
        for k in range(0, len(data), batch):
            lot = [data[i] for i in mixed[k : k + batch]]
            real = np.zeros((len(lot), max(len(d.tags) for d in lot)), dtype=bool)
            for i, d in enumerate(lot):
                real[i, : len(d.tags)] = True
            e, y = np.zeros(real.shape), np.zeros(real.shape)
            e[real], y[real] = np.concatenate([d.emissions(w) for d in lot]), np.concatenate([d.tags for d in lot])
            p, expected = marginals(e, real, moves)
            err = (p - y)[real]
            err[np.concatenate([d.never | d.always for d in lot])] = 0.0
            rows = np.concatenate([d.ids for d in lot])
            ids, inv = np.unique(rows.ravel(), return_inverse=True)
            grad = np.bincount(inv, np.repeat(err, rows.shape[1]), len(ids)) + 1e-4 * w[ids] * np.bincount(inv)
            g2[ids] += grad * grad
            w[ids] -= 0.3 * grad / np.sqrt(g2[ids])
            w[0] = 0.0
            before = np.concatenate([np.append(0, d.tags[:-1]) for d in lot])
            seen = np.array([[((before == a) & (y[real] == b)).sum() for b in (0, 1)] for a in (0, 1)])
            m2 += (expected - seen) ** 2
            moves -= 0.1 * (expected - seen) / np.sqrt(m2)
    return w, moves


def train(labelled: list[tuple[str, list[tuple[int, int]]]]) -> Model:
    """Model from texts with their boundaries, some of which may be wrong."""
    number: dict[str, int] = {"": 0}  # features are numbered at once: their names are held once only
    get = number.setdefault

    def sequence(text: str, spans: list[tuple[int, int]]) -> Sequence | None:
        where = places(text)
        tags = gold_tags(text, spans, where)
        if tags is None:
            return None
        named = features(text, where)
        ids = np.zeros((len(named), MOST), dtype=np.int32)
        for i, fs in enumerate(named):
            ids[i, : len(fs)] = [get(f, len(number)) for f in fs[:MOST]]
        return Sequence(ids, tags, np.array([NEVER in fs for fs in named], dtype=bool), np.array([bool(_BLANK_LINE.search(text, a, b)) for a, b in where], dtype=bool))

    plain, extra = [], []
    for k, (text, spans) in enumerate(labelled):
        own = sequence(text, spans)
        if own is None:
            continue
        plain.append(own)
        if len(spans) > 1 and k % 3:
            bare, new = stripped(text, spans)
            if k % 3 == 2:
                bare = bare.lower() if len(bare.lower()) == len(bare) else bare
            own = sequence(bare, new)
            if own is not None:
                extra.append(own)
    if not any(d.tags.any() for d in plain + extra):
        return Model(dict(PRIOR), [[0.0, 0.0], [0.0, 0.0]])
    n = np.bincount(np.concatenate([d.ids.ravel() for d in plain + extra]), minlength=len(number))
    small = np.where(n >= LEAST, np.cumsum(n >= LEAST) - 1, 0)  # rarer features become none
    names = [f for f, k in zip(number, n) if k >= LEAST]
    number.clear()
    for d in plain + extra:
        d.ids = small[d.ids].astype(np.int32)
    w, moves = _fit(plain + extra, len(names), max(2, EPOCHS // 2))
    kept = []
    for d in plain:
        e = d.emissions(w)
        if (np.array(best_tags(e.tolist(), d.always.tolist(), moves.tolist())) == d.tags).all() or not ((np.abs(e) > 3) & ((e > 0) != (d.tags > 0))).any():
            kept.append(d)
    w, moves = _fit(kept + extra, len(names))
    return Model({f: float(x) for f, x in zip(names[1:], w[1:]) if x}, moves.tolist())


def fit_segmenter(df: DataFrame, key: str = "id", text: str = "text", bounds: str = "sentence_boundaries", rows: int = TRAIN_ROWS) -> Model:
    """Model fitted on at most ``rows`` labelled records of ``df``, in the order of a hash of their key."""
    labelled = df.where(F.col(bounds).isNotNull() & F.col(text).isNotNull())
    part = min(1.0, 1.2 * rows / max(1, labelled.count()))
    h = F.xxhash64(F.col(key).cast("string"))
    picked = (
        labelled.where(F.pmod(h, F.lit(1_000_003)) < F.lit(part * 1_000_003))
        .select(h.alias("h"), F.col(text).alias("t"), F.transform(bounds, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("b"))
        .where(~F.exists("b", lambda x: x["start"].isNull() | x["end"].isNull()))
        .collect()
    )
    picked = sorted(picked, key=lambda r: (r["h"], r["t"]))[:rows]
    return train([(r["t"], [(s["start"], s["end"]) for s in r["b"]]) for r in picked])


def segment(df: DataFrame, model: Model, key: str = "id", text: str = "text") -> DataFrame:
    """``id, sent_start, sent_end`` of each sentence of each distinct record with a text."""
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.moves))
    kind = df.schema[key].dataType.simpleString()

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*held.value)
        for b in batches:
            out = [(k, s, e) for k, t in zip(b["id"], b["text"]) for s, e in own.spans(t)]
            yield pd.DataFrame(out, columns=["id", "sent_start", "sent_end"]).astype({"sent_start": "int32", "sent_end": "int32"})

    slim = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return slim.mapInPandas(tag, f"id {kind}, sent_start int, sent_end int")
