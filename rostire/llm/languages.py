"""Problem 9: missing or wrong document language labels.

Method: nearest-centroid classification. Pieces of a text (sentences or what stands for them) become
normalised TF-IDF vectors of letter n-grams, are compared by cosine with several clustered centroids
per language, smoothed over the text, and rejected where even the nearest centroid is far.

* Centroids are fitted on at most ``PER_LABEL`` labelled documents of every label (fewer if there are so many labels
  that ``FITTED`` documents in all are exceeded), taken in the order of a hash of the id, and on at most ``PIECES``
  pieces of each, spread over its whole text. Wrong labels are sifted out by refitting: a piece only counts for its
  label if the centroids agree. Everything else runs over all documents and whole texts.
* Scoring is a map over rows, no shuffle. The dot product with a centroid is a sum over words, so each distinct word
  is scored once per task and looked up afterwards; the norm is that of the piece's own TF-IDF vector.
* A piece does not end at an abbreviation, and changes of language cost, so that short pieces go with their
  neighbours unless they differ much from them.
* The confidence is a softmax over the languages' similarities, weighed by the letters; its scale is fitted on
  the first two words of the pieces.

Edge cases: null texts and texts without letters have no language; without usable labels every text is
``und``; ties go to the language first in the alphabet; repeated rows give the same rows. A document rejected as a
whole comes out as ``und`` in ``document_languages`` and is no case of ``label_cases``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textform import SUSPECT, consistent

#: Documents fitted on per label, documents in all above which labels get fewer (never under FEWEST), and pieces taken from one of them.
PER_LABEL, FITTED, FEWEST, PIECES = 120, 3000, 10, 8
#: Dimensions of the hashed n-gram space, centroids per language, words scored before the cache is dropped, and characters tagged at a time.
DIMS, CENTROIDS, CACHE, CHARS = 1 << 13, 4, 120_000, 400_000
#: Cost of a change of language between pieces; letters after which a piece weighs no more.
CHANGE, FULL = 5.0, 100
#: Letters after which a text is no surer of its language.
DOUBT = 12
#: Share of the non-white characters from which a language is one of the document's.
SHARE = 0.15
#: A segment is rejected below this part of the lowest usual similarity of its language.
REJECT = 0.5
#: Two labels whose means are this similar (the second holds for fewer than FEW documents, whose mean is noisy) and
#: of whose documents, all counted, one has less than this share of the other's are one language under a wrong label and its own.
SAME, SAME_OF_FEW, FEW, RARE = 0.95, 0.85, 3, 0.34
#: Longest word whose trigrams and edges count; longer runs belong to scripts without spaces.
LONG = 24

#: A mark that ends a piece, unless a lower-case letter or a digit follows: then it stands after an abbreviation.
_END = re.compile(r"(?:\.+(?=\s*\n|[^\w\s]*\s+(?![a-zà-öø-ÿăâîșț0-9])|[^\w\s]*$)|[!?…।؟。！？]+|\n)[.!?…।؟。！？\n]*(?:[^\w\s]*\s+|(?<=[।؟。！？])[^\w\s]*|$)")
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
_WORD = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile(SUSPECT)
_LATIN = re.compile("[A-Za-zＡ-Ｚａ-ｚ]")
#: Stands between pieces where many are cut into words at once.
_BAR = "\x01"
_WORD_OR_BAR = re.compile(rf"[^\W\d_]+|{_BAR}")


def pieces(text: str) -> list[tuple[int, int]]:
    """The text cut into pieces that hold one language as a rule; together they cover it."""
    ends = [m.end() for m in _END.finditer(text)]
    if _THAI.search(text):
        ends = sorted({*ends, *(m.end() for m in _THAI_GAP.finditer(text))})
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [(a, b) for a, b in zip([0, *ends], ends) if b > a]


def _form(piece: str) -> str:
    """A piece in consistent form, where Latin letters might be disguised."""
    return consistent(piece) if _SUSPECT.search(piece) and _LATIN.search(piece) else piece


def words(piece: str) -> list[str]:
    """Lower-case letter runs in consistent form."""
    return _WORD.findall(_form(piece).lower())


def grams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three letters of each word, with edges, and how many each has.

    Of words over LONG letters only single letters and pairs inside the word count.
    """
    size = np.array([len(w) for w in ws], dtype=np.int64) + 2
    code = np.frombuffer("".join([f"<{w}>" for w in ws]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(ws)), size)
    first = np.cumsum(size) - size
    inner = np.ones(len(code), dtype=bool)
    inner[first] = inner[first + size - 1] = False
    short = (size <= LONG + 2)[of]
    pair = (of[:-1] == of[1:]) & (short[:-1] | (inner[:-1] & inner[1:]))
    triple = (of[:-2] == of[2:]) & short[:-2]
    with np.errstate(over="ignore"):
        one = code * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(31) + code[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + code[2:] * np.uint32(0x27D4EB2F)
    every = np.concatenate([one[inner], two[pair], three[triple]])
    every ^= every >> np.uint32(15)
    every *= np.uint32(0x2C1B3C6D)
    ids = (every >> np.uint32(12)).astype(np.int32) & (DIMS - 1)
    at = np.concatenate([of[inner], of[:-1][pair], of[:-2][triple]])
    return ids[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(ws))


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` rows at least, doubled where it has to grow."""
    return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


class Grams:
    """The n-grams of words, kept for words that come again."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {_BAR: 0}
        self.words = self.total = 0
        self.ids = np.zeros(0, np.int32)
        self.start, self.size, self.letters = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Number of each word."""
        known = self.known
        try:
            return np.array(list(map(known.__getitem__, words)), dtype=np.int64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = len(known)
        fresh = list(known)[self.words :]
        ids, size = grams(fresh)
        n = len(known)
        self.start, self.size, self.letters = _grown(self.start, n), _grown(self.size, n), _grown(self.letters, n)
        self.ids = _grown(self.ids, self.total + len(ids))
        new = slice(self.words, n)
        self.start[new], self.size[new] = self.total + np.cumsum(size) - size, size
        self.letters[new] = [len(w) * (3 if w >= "\u3040" else 1) for w in fresh]  # a letter there stands for a syllable
        self.ids[self.total : self.total + len(ids)] = ids
        self.words, self.total = n, self.total + len(ids)
        return np.array(list(map(known.__getitem__, words)), dtype=np.int64)

    def counts(self, flat: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``piece, n-gram, count`` of the words ``flat`` of the pieces ``of``."""
        size = self.size[flat]
        at = np.arange(size.sum()) + np.repeat(self.start[flat] - (np.cumsum(size) - size), size)
        wide = np.int32 if not len(of) or (int(of.max()) + 1) * DIMS < 1 << 31 else np.int64
        key = np.sort(np.repeat(of.astype(wide) * wide(DIMS), size) + self.ids[at])
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(edge, len(key)))
        return key[edge] >> (DIMS.bit_length() - 1), key[edge] & (DIMS - 1), n


class Centroids:
    """Centroids of all languages, ready to score words."""

    STATE = ("langs", "owner", "weight", "idf", "low", "scale")

    def __init__(self, langs: list[str], owner: np.ndarray, weight: np.ndarray, idf: np.ndarray, low: np.ndarray, scale: float = 1.0) -> None:
        #: Languages in order; language of each centroid; idf times centroid by n-gram; idf; least usual similarity; scale of confidences.
        self.langs, self.owner, self.weight, self.idf, self.low, self.scale = langs, owner, weight, idf, low, scale
        self.starts = np.searchsorted(owner, np.arange(len(langs)))
        self._forget()

    def state(self) -> tuple:
        return tuple(getattr(self, k) for k in self.STATE)

    def _forget(self) -> None:
        self.grams, self.scored = Grams(), 0
        self.rows = np.zeros((0, len(self.owner)), dtype=np.float32)

    def similarities(self, lists: list[list[str]]) -> np.ndarray:
        """Cosine of the TF-IDF vector of each list of words with the nearest centroid of each language."""
        if len(self.grams.known) > CACHE:
            self._forget()
        return self._cosines(self.grams.numbers([w for ws in lists for w in ws]), np.array([len(ws) for ws in lists], dtype=np.int64))

    def similar_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines as above of each piece of text, and its letters."""
        if len(self.grams.known) > CACHE:
            self._forget()
        flat = self.grams.numbers(_WORD_OR_BAR.findall(_BAR.join([_form(t.replace(_BAR, " ") if _BAR in t else t) for t in texts]).lower()))
        bars = np.flatnonzero(flat == 0)
        size = np.diff(np.concatenate([[-1], bars, [len(flat)]])) - 1
        flat = flat[flat != 0]
        letters = np.bincount(np.repeat(np.arange(len(texts)), size), self.grams.letters[flat], len(texts))
        return self._cosines(flat, size), letters

    def _cosines(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(size), len(self.langs)), dtype=np.float32)
        full = np.flatnonzero(size)
        if not len(full) or not self.langs:
            return out
        g = self.grams
        self.rows = _grown(self.rows, g.words)
        for k in range(self.scored, g.words, 4096):
            n = min(k + 4096, g.words)
            a, b = g.start[k], g.start[n - 1] + g.size[n - 1]
            self.rows[k:n] = np.add.reduceat(self.weight[g.ids[a:b]], g.start[k:n] - a, axis=0)
        self.scored = g.words
        size = size[full]
        sums = np.add.reduceat(self.rows[flat], np.cumsum(size) - size, axis=0)
        piece, gram, n = g.counts(flat, np.repeat(np.arange(len(full)), size))
        norm = np.sqrt(np.bincount(piece, (n * self.idf[gram]) ** 2, len(full)))
        out[full] = np.maximum.reduceat(sums, self.starts, axis=1) / np.maximum(norm, 1e-9)[:, None]
        return out


class Vectors:
    """Sparse unit vectors: n-grams and values of each row in turn."""

    def __init__(self, size: np.ndarray, gram: np.ndarray, value: np.ndarray) -> None:
        self.size, self.gram, self.value = size, gram, value
        self.start = np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.size)

    def take(self, rows: np.ndarray) -> Vectors:
        """The rows of a mask or of numbers."""
        rows = np.flatnonzero(rows) if rows.dtype == bool else rows
        size = self.size[rows]
        at = np.arange(size.sum()) + np.repeat(self.start[rows] - (np.cumsum(size) - size), size)
        return Vectors(size, self.gram[at], self.value[at])

    def dots(self, c: np.ndarray) -> np.ndarray:
        """Products of every row with the dense vectors ``c``."""
        t, out = c.T.astype(np.float32), [np.zeros((0, len(c)), np.float32)]
        for k in range(0, len(self), 1024):
            a, b = self.start[k], self.start[k + 1024] if k + 1024 < len(self) else len(self.gram)
            out.append(np.add.reduceat(self.value[a:b, None] * t[self.gram[a:b]], self.start[k : k + 1024] - a, axis=0))
        return np.concatenate(out)

    def sums(self, of: np.ndarray, n: int) -> np.ndarray:
        """Dense sums of the rows by their group, one of ``n``."""
        return np.bincount(np.repeat(of, self.size) * DIMS + self.gram, self.value, n * DIMS).reshape(n, DIMS)


def _cluster(m: Vectors, k: int) -> np.ndarray:
    """Spherical k-means from farthest starts; unit centroids."""
    k = max(1, min(k, len(m) // 12))
    none = np.zeros(len(m), dtype=np.int64)
    best = m.dots(m.sums(none, 1))[:, 0]
    picked, near = [int(best.argmax())], np.full(len(m), -np.inf)
    for _ in range(1, k):
        near = np.maximum(near, m.dots(m.take(np.array(picked[-1:])).sums(none[:1], 1))[:, 0])
        picked.append(int(near.argmin()))
    c = m.take(np.array(picked)).sums(np.arange(k), k)
    for _ in range(8):
        of = m.dots(c).argmax(1)
        sums = m.sums(of, k)
        c = np.where((np.bincount(of, minlength=k) > 0)[:, None], sums, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _one_language(m: Vectors, labels: np.ndarray, docs: np.ndarray, langs: list[str]) -> np.ndarray:
    """Which pairs of labels stand on texts of the same language.

    The squared length of a mean is taken over pairs of pieces of different documents, so that it does not depend
    on how many were sampled; with fewer than FEW documents it is that of the mean itself.
    """
    means, sizes, few = [], [], []
    for x in langs:
        own = m.take(labels == x)
        _, of = np.unique(docs[labels == x], return_inverse=True)
        n = np.bincount(of)
        mean = own.sums(np.zeros(len(own), dtype=np.int64), 1)[0] / len(own)
        few.append(len(n) < FEW)
        among = mean @ mean
        if not few[-1]:
            _, at = np.unique(np.repeat(of, own.size) * DIMS + own.gram, return_inverse=True)
            among = (among * len(own) ** 2 - (np.bincount(at, own.value) ** 2).sum()) / (len(own) ** 2 - (n * n).sum())
        means.append(mean)
        sizes.append(np.sqrt(max(among, 1e-9)))
    alike = np.stack(means) @ np.stack(means).T / np.outer(sizes, sizes)
    return alike > np.where(np.logical_or.outer(few, few), SAME_OF_FEW, SAME)


def fit(docs: list[tuple[str, str]], rounds: int = 3, counts: dict[str, int] | None = None) -> Centroids:
    """Centroids from texts with labels, some of which are wrong.

    ``counts`` are the documents of each label where ``docs`` are only a sample of them.
    """
    counts = counts or Counter(lang for lang, _ in docs)
    lists, labels, source = [], [], []
    for k, (lang, text) in enumerate(docs):
        own = [ws for ws in (words(text[a:b]) for a, b in pieces(text)) if sum(map(len, ws)) >= 12]
        step = max(1.0, len(own) / PIECES)
        for j in range(min(PIECES, len(own))):
            lists.append(own[int(j * step)])
            labels.append(lang)
            source.append(k)
    if not lists:
        return Centroids([], np.zeros(0, int), np.zeros((DIMS, 0), np.float32), np.ones(DIMS), np.zeros(0))
    g = Grams()
    flat = g.numbers([w for ws in lists for w in ws])
    piece, gram, n = g.counts(flat, np.repeat(np.arange(len(lists)), [len(ws) for ws in lists]))
    idf = np.log((1 + len(lists)) / (1 + np.bincount(gram, minlength=DIMS))) + 0.3
    value = n * idf[gram]
    norm = np.sqrt(np.bincount(piece, value * value))
    m = Vectors(np.bincount(piece), gram.astype(np.int64), (value / norm[piece]).astype(np.float32))
    labels, source = np.array(labels), np.array(source)
    langs = sorted(map(str, set(labels)))
    kept = np.ones(len(labels), dtype=bool)
    for r in range(rounds + 1):
        cents, owner = [], []
        for j, lang in enumerate(langs):
            c = _cluster(m.take((labels == lang) & kept), CENTROIDS if r else 1)
            cents.append(c)
            owner += [j] * len(c)
        cent, owner = np.concatenate(cents), np.array(owner)
        best = np.maximum.reduceat(m.dots(cent), np.searchsorted(owner, np.arange(len(langs))), axis=1)
        near = np.array(langs)[best.argmax(1)]
        if r == rounds:
            break
        kept = near == labels
        same = _one_language(m, labels, source, langs)
        twins = {a for i, a in enumerate(langs) for j, b in enumerate(langs) if i != j and same[i, j] and counts[a] < RARE * counts[b]}
        langs = [x for x in langs if x not in twins]
        langs = [x for x in langs if (kept & (labels == x)).sum() >= 3] or langs[:1]
        kept &= np.isin(labels, langs)
        if not kept.any():
            kept = np.isin(labels, langs)
    kept &= np.isin(labels, langs)
    own = labels[kept]
    low = np.array([np.quantile(best[kept][own == x, j], 0.02) if (own == x).any() else 0.0 for j, x in enumerate(langs)])
    c = Centroids(langs, owner, (cent * idf).T.astype(np.float32).copy(), idf, low)
    short = [ws[:2] for ws, k in zip(lists, kept) if k]  # whole pieces are hardly ever in doubt
    c.scale = _scale(c.similarities(short), np.array([sum(map(len, ws)) for ws in short], dtype=float), np.searchsorted(langs, own))
    return c


def certainty(sims: np.ndarray, letters: np.ndarray, scale: float) -> np.ndarray:
    """Probabilities of the languages given the similarities of texts of so many letters."""
    z = scale * np.minimum(letters, DOUBT)[:, None] * (sims - sims.max(1, keepdims=True))
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def _scale(sims: np.ndarray, letters: np.ndarray, right: np.ndarray) -> float:
    """The scale under which the right languages of the pieces are likeliest, one in a hundred being in doubt anyway."""
    at = np.arange(len(right))
    return max((0.02 * 1.5**k for k in range(14)), key=lambda s: np.log(0.99 * certainty(sims, letters, s)[at, right] + 0.01 / sims.shape[1]).sum())


def smooth(sims: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Best language of each piece of a text, with a cost for every change (Viterbi)."""
    e = (sims - sims.max(1, keepdims=True)) * np.minimum(letters, FULL)[:, None]
    top = sims.argmax(1)
    if (top == top[0]).all():
        return top
    s, back = e[0], []
    for x in e[1:]:
        j = int(s.argmax())
        stay = s >= s[j] - CHANGE
        back.append(np.where(stay, np.arange(len(s)), j))
        s = np.where(stay, s, s[j] - CHANGE) + x
    path = [int(s.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def segments(texts: list[str], c: Centroids) -> list[list[tuple[int, int, str, float]]]:
    """``start, end, language, confidence`` of each segment of each text; none without letters."""
    cuts = [pieces(t) for t in texts]
    if not any(cuts):
        return [[] for _ in texts]
    sims, letters = c.similar_pieces([t[a:b] for t, p in zip(texts, cuts) for a, b in p])
    out, at = [], 0
    for p in cuts:
        here = slice(at, at + len(p))
        at += len(p)
        n, x = letters[here], sims[here]
        if not len(p) or not n.sum():
            out.append([])
            continue
        if not c.langs:
            out.append([(p[0][0], p[-1][1], "und", 0.0)])
            continue
        full = np.flatnonzero(n)
        path = np.full(len(p), -1)
        path[full] = smooth(x[full], n[full])
        for i in range(1, len(p)):  # pieces without letters go with what stands before them, or else after
            if path[i] < 0:
                path[i] = path[i - 1]
        path[path < 0] = path[full[0]]
        segs, i = [], 0
        while i < len(p):
            k = i
            while k + 1 < len(p) and path[k + 1] == path[i]:
                k += 1
            weight = n[i : k + 1]
            mean = (x[i : k + 1] * weight[:, None]).sum(0) / max(1.0, weight.sum())
            sure = float(certainty(mean[None], weight.sum(keepdims=True), c.scale)[0, path[i]])
            lang = c.langs[path[i]] if mean[path[i]] >= REJECT * c.low[path[i]] else "und"
            segs.append((p[i][0], p[k][1], lang, round(sure, 4)))
            i = k + 1
        out.append(segs)
    return out


def clean_label(label: Column) -> Column:
    """Two-letter code of a label without case, outer spaces and region; null if it is missing."""
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    return F.when((code != "") & (code != "und"), code)


def fit_centroids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL) -> Centroids:
    """Centroids fitted on at most ``per_label`` documents of every label, fewer where labels are many."""
    named = docs.select(clean_label(F.col(lang)).alias("lang"), F.abs(F.xxhash64(F.col(doc_id).cast("string"))).alias("h"), F.col(text).alias("text")).where("lang IS NOT NULL AND length(trim(text)) > 0")
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # a row for each label
    if not counts:
        return fit([])
    per_label = max(FEWEST, min(per_label, FITTED // len(counts)))
    part = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_label / n)))])
    few = named.where((F.col("h") % 1_000_003) / 1_000_003.0 < part[F.col("lang")]).collect()
    held: dict[str, list] = defaultdict(list)
    for r in sorted(few, key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(held[r["lang"]]) < per_label:
            held[r["lang"]].append((r["lang"], r["text"]))
    return fit([x for v in held.values() for x in v], counts=counts)


def language_segments(docs: DataFrame, c: Centroids, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, label, seg_start, seg_end, lang, confidence, chars`` of each one-language segment.

    Offsets are code points of the text as stored; ``chars`` counts what is not whitespace.
    """
    held = docs.sparkSession.sparkContext.broadcast(c.state())
    kind = docs.schema[doc_id].dataType.simpleString()

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Centroids(*held.value)
        for b in batches:
            lot = b["text"].str.len().cumsum() // CHARS  # documents tagged together; a longer one is tagged alone
            for _, part in b.groupby(lot, sort=False):
                texts = part["text"].tolist()
                rows = [
                    (d, lab, s, e, x, sure, len("".join(t[s:e].split())))
                    for d, lab, t, segs in zip(part["doc_id"], part["label"], texts, segments(texts, own))
                    for s, e, x, sure in segs
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "label", "seg_start", "seg_end", "lang", "confidence", "chars"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), clean_label(F.col(lang)).alias("label"), F.col(text).alias("text")).where("text IS NOT NULL")
    return slim.mapInPandas(tag, f"doc_id {kind}, label string, seg_start int, seg_end int, lang string, confidence double, chars int")


def document_languages(segs: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, label, lang, part, confidence`` of each language with ``share`` of a document's characters, ``und`` too.

    Segments of a document come out of one task together, but are grouped by key to be safe.
    """
    per = segs.groupBy("doc_id", "label", "lang").agg(
        F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum(F.greatest("chars", F.lit(1)))).alias("confidence")
    )
    whole = F.sum("chars").over(Window.partitionBy("doc_id"))  # a row for each language of a document
    return (
        per.withColumn("whole", whole)
        .where(F.col("chars") >= F.lit(share) * F.col("whole"))
        .select("doc_id", "label", "lang", (F.col("chars") / F.col("whole")).alias("part"), "confidence")
    )


def label_cases(langs: DataFrame) -> DataFrame:
    """Documents of several languages, or whose label is missing or none of theirs: ``doc_id, lang``."""
    known = langs.where("lang <> 'und'").groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))  # at most 1 / SHARE languages
    case = known.where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label")))
    return case.select("doc_id", F.explode("langs").alias("lang"))
