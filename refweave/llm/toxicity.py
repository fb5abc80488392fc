"""Operator 9, toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length.

Folding lower-cases, maps letters of other scripts that look like Latin ones, and digits and signs that stand for letters;
l and i are one letter, as a 1 may stand for either, and everything else that isn't a letter parts words. Entries are whole words or beginnings of words. The lexicon is learned
from labelled texts: entries that toxic texts hold far oftener than clean ones, rare ones beyond chance, taken greedily until they cover
the toxic texts, each weighted by the log ratio of its rates. Hits inside an exception phrase don't count; phrases can be given, and
those that only clean texts hold around an entry are learned. The sum of the weights, and that sum per word of the text,
go through a logistic curve fitted to the labels.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, give_back, table, tidy

#: Labelled texts that the lexicon is learned from at most, those of the least hashes of their ids, and the bytes they may have.
FIT, FIT_BYTES = 12_000, 64 << 20
#: An entry must cover so many toxic texts, and this share of them if it may be one of CHANCE false ones that are expected of
#: all that are tried, were they held regardless of labels; a text that others cover counts half for each.
NEW, SHARE, CHANCE = 4, 0.01, 0.05
#: Least log odds of a text that holds an entry, highest weight, letters of a beginning of a word.
ODDS, HEAVIEST, SHORTEST, LONGEST = 1.5, 6.0, 4, 14

# Letters of other scripts and the Latin letters they look like.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
# Digits and signs and the letters they stand for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

# Signs that don't show, within words.
UNSEEN = [0xAD, 0x2060, 0xFEFF, *range(0x200B, 0x2010), *range(0xFE00, 0xFE10)]


class _Fold(dict):
    """Of characters beyond ASCII: letters, and the marks that belong to them, are kept, and all else that isn't mapped is a blank."""

    def __missing__(self, i: int) -> str:
        c = chr(i)
        self[i] = c if i < 128 or c.isalpha() or unicodedata.category(c) in ("Mn", "Mc") else " "
        return self[i]


_fold = _Fold({ord(c): x for c, x in HOMOGLYPHS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | dict.fromkeys(UNSEEN, ""))
_ascii = bytes(ord((DIGITS | {"l": "i"}).get(chr(i).lower(), chr(i).lower() if chr(i).isalpha() or i > 127 else " ")) if i < 128 else i for i in range(256))


def fold(text: str) -> str:
    """The words of a text in folded form, with blanks around and between them."""
    text = text.lower()
    if not text.isascii():
        beyond = text.encode("utf-8", "replace").translate(None, bytes(range(128))).decode("utf-8")
        if any(_fold[ord(c)] != c for c in set(beyond)):
            text = text.translate(_fold)
    return " " + text.encode("utf-8", "replace").translate(_ascii).decode("utf-8", "replace") + " "


@dataclass
class Lexicon:
    """Entries begin with a blank; those that also end with one are whole words. score = logistic(bias + slopes of the sum and of the sum per word)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ np.array(self.slopes), -700, 700)))

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            entry = entry.replace("l", "i")  # as in folded text
            found.add_word(entry, (len(entry), max(weight, found.get(entry, (0, weight))[1])))
        for phrase in self.exceptions:
            phrase = " " + " ".join(fold(phrase).split()) + " "
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def density(matcher, text: str) -> tuple[float, float, int]:
    """The logarithms of the hits' weights and of those per thousand words; the number of hits."""
    folded = fold(text)
    if not len(matcher):
        return 0.0, 0.0, 0
    if next(matcher.iter(folded), None) is None:
        return 0.0, 0.0, 0
    words = folded.split()
    hits: list[tuple[int, int, float]] = []
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in matcher.iter(f" {' '.join(words)} "):
        if weight is None:
            spared.append((end - size + 1, end))
        else:
            hits.append((end - size + 1, end, weight))
    if spared:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spared)]
    if not hits:
        return 0.0, 0.0, 0
    best: dict[int, float] = {}
    for start, _, weight in hits:  # of entries that begin at one word, the heaviest
        best[start] = max(weight, best.get(start, weight))
    total = sum(best.values())
    return math.log1p(total), math.log1p(1000 * total / len(words)), len(best)


def _entries(words: Iterable[str]) -> set[str]:
    out = set()
    for w in words:
        out.add(f" {w} ")
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(" " + w[:n])
    return out


def _common(sets: list[set[str]], least: int) -> Counter[str]:
    """The entries that at least so many sets of words hold, and how many. A longer beginning is only counted where the
    shorter one is common, so few are ever held."""
    out: Counter[str] = Counter()
    able: set[str] | None = None
    for n in range(SHORTEST, LONGEST + 1):
        counts: Counter[str] = Counter()
        for words in sets:
            counts.update({" " + w[:n] for w in words if len(w) >= n and (able is None or " " + w[: n - 1] in able)})
        able = {e for e, k in counts.items() if k >= least}
        out.update({e: counts[e] for e in able})
    whole: Counter[str] = Counter()
    for words in sets:
        whole.update(w for w in words if len(w) < SHORTEST or " " + w[:SHORTEST] in out)
    out.update({f" {w} ": k for w, k in whole.items() if k >= least})
    return out


def _chance(k: int, c: int, toxic: int, clean: int) -> float:
    """Fisher's exact test, one-sided: the probability that of k + c texts, drawn from all, k or more are toxic."""
    log = lambda n, m: math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
    term = math.exp(log(toxic, k) + log(clean, c) - log(toxic + clean, k + c))
    total = term
    while k < toxic and c and term > 1e-9 * total:
        term *= (toxic - k) * c / ((k + 1) * (clean - c + 1))
        total, k, c = total + term, k + 1, c - 1
    return total


def learn(texts: list[str], labels: list[int], exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon from labelled texts. Without labels of both kinds it has no entries and scores all alike."""
    # without both kinds of labels all texts score alike
    toxic = [i for i, y in enumerate(labels) if y]
    clean = [i for i, y in enumerate(labels) if not y]
    lexicon = Lexicon(exceptions=list(exceptions))
    lexicon.bias = math.log((len(toxic) + 0.5) / (len(clean) + 0.5))
    if not toxic or not clean:
        return lexicon
    sets = [set(fold(texts[i]).split()) for i in toxic]
    in_toxic = _common(sets, NEW)
    able = set(in_toxic)
    in_clean: Counter[str] = Counter()
    for i in clean:
        in_clean.update(able & _entries(set(fold(texts[i]).split())))
    odds = lambda e: math.log((in_toxic[e] + 0.5) / (len(toxic) + 1)) - math.log((in_clean[e] + 0.5) / (len(clean) + 1))
    able = {e for e in able if odds(e) >= ODDS}
    share = max(NEW, math.ceil(SHARE * len(toxic)))
    least = {e: NEW if _chance(in_toxic[e], in_clean[e], len(toxic), len(clean)) * len(in_toxic) <= CHANCE else share for e in able}
    holders: dict[str, list[int]] = {e: [] for e in able}
    for i, held in zip(toxic, sets, strict=True):
        for e in able & _entries(held):
            holders[e].append(i)
    left = dict.fromkeys(toxic, 1.0)
    chosen: list[str] = []
    while holders:
        gain = {e: sum(left[i] for i in h) for e, h in holders.items()}
        holders = {e: holders[e] for e, g in gain.items() if g >= least[e]}
        # of entries that tell as much, the whole word, then the longest beginning
        entry = max(holders, key=lambda e: (round(gain[e] * odds(e), 9), e.endswith(" "), len(e), e), default=None)
        if entry is None:
            break
        chosen.append(entry)
        for i in holders[entry]:
            left[i] /= 2
        holders = {e: h for e, h in holders.items() if not (e.startswith(entry) or entry.startswith(e))}
    words, hits = [0, 0], [Counter(), Counter()]
    for text, y in zip(texts, labels, strict=True):
        every = fold(text).split()
        words[y] += len(every)
        hits[y].update(e for w, n in Counter(every).items() for e in _entries([w]) & set(chosen) for _ in range(n))
    for e in chosen:
        ratio = math.log((hits[1][e] + 0.5) / (words[1] + 1)) - math.log((hits[0][e] + 0.5) / (words[0] + 1))
        if ratio > 0:
            lexicon.weights[e] = min(HEAVIEST, ratio)
    _learn_exceptions(lexicon, texts, toxic, clean)
    _calibrate(lexicon, texts, labels)
    return lexicon


def _learn_exceptions(lexicon: Lexicon, texts: list[str], toxic: list[int], clean: list[int]) -> None:
    """Pairs of words around an entry that several clean texts hold and no toxic one."""
    matcher = lexicon.matcher()
    if not len(matcher):
        return

    def phrases(i: int) -> set[str]:
        words = fold(texts[i]).split()
        hit = [j for j, w in enumerate(words) if f" {w} " in lexicon.weights or any(" " + w[:n] in lexicon.weights for n in range(SHORTEST, len(w) + 1))]
        return {" ".join(words[a : a + 2]) for j in hit for a in (j - 1, j) if a >= 0 and a + 2 <= len(words)}

    often = Counter(p for i in clean if density(matcher, texts[i])[2] for p in phrases(i))
    often = Counter({p: n for p, n in often.items() if n >= 3})
    if often:
        for i in toxic:
            for p in phrases(i) & often.keys():
                del often[p]
    lexicon.exceptions += sorted(often)


def _calibrate(lexicon: Lexicon, texts: list[str], labels: list[int]) -> None:
    """Logistic regression of the label on the densities, by Newton's method with a small ridge; slopes are not negative."""
    matcher = lexicon.matcher()
    x = np.array([density(matcher, t)[:2] for t in texts])
    y = np.array(labels, float)
    for use in ((0, 1), (1,), (0,)):
        a = np.column_stack((np.ones(len(x)), x[:, use]))
        ridge = np.array([1e-6] + [0.05] * len(use))

        def loss(w: np.ndarray, a: np.ndarray = a, ridge: np.ndarray = ridge) -> float:
            z = a @ w
            return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (w * w))

        w = np.zeros(a.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
            step = np.linalg.solve(hessian, a.T @ (p - y) + ridge * w)
            size = 1.0
            while size > 1e-8 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
    slopes = [0.0, 0.0]
    for i, v in zip(use, w[1:], strict=True):
        slopes[i] = max(0.0, float(v))
    lexicon.bias, lexicon.slopes = float(w[0]), (slopes[0], slopes[1])


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [density(matcher, t.as_py() or "") for t in batch.column("text")]
            score = lexicon.score(np.array([f[:2] for f in found], float).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(score, pa.float64()), pa.array([f[2] for f in found], pa.int64())], ["row", "text", "score", "hits"])

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row (the columns of docs but text, under any names), text, score (0 to 1), hits (entries found outside exceptions).
    Null and empty texts have no hits, and the score of such texts. Texts of any length are matched as a whole. Each row comes
    out, repeated ones and those without doc_id too. Empty table: empty result."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_score(lexicon)), rows.select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits")).schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT, most_bytes: int = FIT_BYTES) -> Lexicon:
    """A lexicon from docs (doc_id, text) that labels (doc_id, toxic) marks: at most `most` documents, those of the least hashes of
    their ids, and most_bytes of text; null labels and ids count for nothing, and texts that are null are empty. Of an id's
    labels, the toxic one counts, and of its texts, the least. Without labels of both kinds, all texts score alike."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    cut = marked.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    chosen = marked.where(F.col("h") <= F.lit(cut)) if cut is not None else marked.limit(0)  # `most` rows at most
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("h", "toxic").agg(F.min("text").alias("text"))
    got = bounded_sample(found, most, most_bytes)
    lexicon = learn([t or "" for t in got["text"]], [int(y > 0) for y in got["toxic"]])
    del got
    give_back()
    return lexicon


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document, by a lexicon learned from the labels of four of five folds; null and empty texts have a score too."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    lexicon = fit(docs, labels.where(fold_of(F.col("doc_id"), 5) != 0))
    out = score(docs, lexicon)
    return out.select("row.doc_id", (fold_of(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
