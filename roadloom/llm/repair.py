"""Free-entered values mapped to a canonical list: token-level repair and soft TF-IDF.

Every distinct text is folded (case, accents, look-alike letters and digits) and cut into tokens; beside the tokens
themselves, runs of neighbouring tokens without their gap are tokens too, so that words typed together or apart meet.
Each distinct token is joined to the vocabulary of the reference list by edit distance: both sides are expanded to
their deletion neighbourhoods, an equi-join finds the candidates and the optimal-string-alignment distance decides.
Soft TF-IDF then ranks the complete entries: the similarity of each corrected token, weighted by how rare it is in the
reference list, over the lengths of the text and of the entry's form (its name or its label).

Defined results:
* null, empty and blank texts have no row; a text without a token is unmatched;
* a text equal to a form once folded is that entry; of equal scores the nearer whole text wins, then the smaller name;
* equal texts are repaired once, however many rows hold them; a token of more than 40 letters is no vocabulary word with
  two edits, so it counts as an unknown token; texts of any length are ranked whole;
* an empty reference list leaves every text unmatched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "unmatched"

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "ԁ": "d", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ү": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l"}
# Digits and letter pairs that stand for letters.
STAND_INS = {"0": "o", "1": "l", "3": "e", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Words people put around a value without changing what it means, and the prefixes of a key.
QUALIFIERS = ("a", "the", "old", "new", "type", "class", "st", "rd", "way", "road", "hw", "highway")


def fold(text: str) -> str:
    """Lower case without accents, look-alike letters replaced, digits left."""
    text = "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(LOOK_ALIKES.get(c, c) for c in text.lower())


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def skeleton(token: str) -> str:
    """Digits read as the letters they look like; l and i become one letter."""
    return "".join(STAND_INS.get(c, c) for c in token).replace("l", "i")


def skeletons(token: str) -> set[str]:
    """The skeleton, also with letter pairs read as the one letter they look like."""
    return {skeleton(token), skeleton(token.replace("rn", "m").replace("vv", "w"))}


def allowed(size: int) -> int:
    """Edits that a vocabulary token of so many letters may have taken."""
    return 0 if size <= 2 else 1 if size <= 4 else 2


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insertions, deletions, replacements, swaps of neighbours), or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)


def deletions(token: str, most: int) -> set[str]:
    """The token and what is left of it after up to `most` deletions."""
    out = last = {token}
    for _ in range(most):
        last = {t[:k] + t[k + 1 :] for t in last for k in range(len(t))}
        out = out | last
    return out


def grams(words: list[str], most_words: int = 3) -> list[tuple[int, int, str]]:
    """(first word, word count, run of neighbouring words typed together)."""
    return [(k, n, "".join(words[k : k + n])) for k in range(len(words)) for n in range(1, min(most_words, len(words) - k) + 1)]


class Reference:
    """The forms of a canonical list and the weights of their tokens. entries: (name, label or None)."""

    def __init__(self, entries: Iterable[tuple[str, str | None]], qualifiers: Iterable[str] = QUALIFIERS):
        self.qualifiers = frozenset(qualifiers)
        self.forms: list[tuple[str, list[str]]] = []  # entry, its words
        for name, label in sorted({(n, v) for n, v in entries if n}):
            for form in dict.fromkeys((name, label)):
                words = tokens(form) if form else []
                if words:
                    self.forms.append((name, words))
        count: dict[str, set[str]] = {}
        for name, words in self.forms:
            for w in words:
                count.setdefault(w, set()).add(name)
        names = max(1, len({n for n, _ in self.forms}))
        self.idf = {w: math.log(1 + names / len(held)) for w, held in count.items()}
        self.top = math.log(1 + names)
        #: vocabulary token -> (form, first word, word count) of every place it stands for
        self.places: dict[str, list[tuple[int, int, int]]] = {}
        for f, (_, words) in enumerate(self.forms):
            for k, n, run in grams(words, len(words)):
                self.places.setdefault(run, []).append((f, k, n))

    def weight(self, word: str) -> float:
        return self.idf.get(word, self.top)


def token_matches(distinct: DataFrame, reference: Reference) -> DataFrame:
    """(token, word, likeness) of the distinct tokens and the vocabulary words that each may be meant to be.

    Candidates come from an equi-join of the deletion neighbourhoods of both sides, so neither side is compared with all
    of the other; a token that is a long start of a word (cut off) also joins by that start.
    """
    spark = distinct.sparkSession

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for token, s in ((t, s) for t in f["token"] for s in skeletons(t)):
                if len(s) <= 40:
                    rows += [(token, s, d) for d in deletions(s, allowed(len(s) + 1))]
                    if len(s) >= 5:
                        rows.append((token, s, "^" + s))
            yield pd.DataFrame(rows, columns=["token", "skeleton", "part"])

    words = []
    for w in sorted(reference.places):
        s = skeleton(w)
        words += [(w, s, d) for d in deletions(s, allowed(len(s)))]
        if w in reference.idf:  # a single word; the start of a run may well be a whole word itself
            words += [(w, s, "^" + s[:k]) for k in range(max(5, len(s) - 4), len(s))]
    vocabulary = spark.createDataFrame(pd.DataFrame(words, columns=["word", "word_skeleton", "part"]), "word string, word_skeleton string, part string")
    # merge: sizes are estimated from before the expansion, so a broadcast here would have no proven bound
    pairs = distinct.select("token").mapInPandas(expand, "token string, skeleton string, part string").join(vocabulary.hint("merge"), "part").select("token", "skeleton", "word", "word_skeleton", F.startswith("part", F.lit("^")).alias("cut")).groupBy("token", "skeleton", "word", "word_skeleton").agg(F.max("cut").alias("cut"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for token, s, word, w, cut in f.itertuples(index=False):
                most = allowed(len(w))
                d = osa(s, w, most)
                if d <= most:
                    rows.append((token, word, 1.0 - d / (len(w) + 1) - 0.01 * (token != word)))
                elif cut and w.startswith(s):
                    rows.append((token, word, 0.95 - 0.5 * (len(w) - len(s)) / len(w)))
            yield pd.DataFrame(rows, columns=["token", "word", "likeness"])

    return pairs.mapInPandas(judge, "token string, word string, likeness double")


def rank(words: list[str], matches: dict[str, list[tuple[str, float]]], reference: Reference, least: float) -> tuple[str, float]:
    """The entry that the words mean and its soft TF-IDF score, or (unmatched, best score)."""
    plain = [w for w in words if w not in reference.qualifiers]
    best = (0.0, 0.0, "", "")
    for own in dict.fromkeys((tuple(words), tuple(plain))):
        if not own:
            continue
        found: dict[int, list[tuple[float, int, int, int, int]]] = {}
        for k, n, run in grams(list(own)):
            for word, likeness in matches.get(run, ()):
                for form, at, size in reference.places[word]:
                    found.setdefault(form, []).append((likeness, k, n, at, size))
        for form, hits in found.items():
            name, entry = reference.forms[form]
            weights = [reference.weight(w) for w in entry]
            total = sum(v * v for v in weights)
            used_own: set[int] = set()
            used_entry: set[int] = set()
            matched = 0.0
            for likeness, k, n, at, size in sorted(hits, key=lambda h: (-h[0] * sum(v * v for v in weights[h[3] : h[3] + h[4]]), h[1:])):
                mine, theirs = set(range(k, k + n)), set(range(at, at + size))
                if not mine & used_own and not theirs & used_entry:
                    used_own |= mine
                    used_entry |= theirs
                    matched += likeness * sum(v * v for v in weights[at : at + size])
            extra = [reference.top if w not in reference.idf else reference.idf[w] for k, w in enumerate(own) if k not in used_own]
            length = matched + sum(v * v for v in extra)  # the text's own squared length: what it matched and what it has besides
            score = matched / math.sqrt(total * max(length, 1e-9)) if matched else 0.0
            order = (round(score, 6), -abs(len("".join(own)) - len("".join(entry))), tuple(-ord(c) for c in name), name)
            if best[3] == "" or order > (best[0], best[1], best[2], best[3]):
                best = order
    return (best[3], best[0]) if best[3] and best[0] >= least else (UNMATCHED, float(best[0]))


def map_values(texts: DataFrame, text: str, reference: Reference, least: float = 0.75) -> DataFrame:
    """(text, entry, score) of every distinct non-blank text. entry is `unmatched` below the score `least`."""
    distinct = texts.select(F.col(text).cast("string").alias("text")).filter(F.length(F.trim("text")) > 0).distinct()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f["text"]:
                words = tokens(t)
                plain = [w for w in words if w not in reference.qualifiers]
                rows += [(t, r) for r in {run for own in (words, plain) for _, _, run in grams(own)}] or [(t, "")]
            yield pd.DataFrame(rows, columns=["text", "token"])

    held = distinct.mapInPandas(cut, "text string, token string")
    matches = token_matches(held.select("token").distinct(), reference)
    joined = held.join(matches.hint("merge"), "token", "left").groupBy("text").agg(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("token", "word", "likeness"))).alias("hits"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t, hits in zip(f["text"], f["hits"]):
                by: dict[str, list[tuple[str, float]]] = {}
                for h in hits:
                    by.setdefault(h["token"], []).append((h["word"], h["likeness"]))
                rows.append((t, *rank(tokens(t), by, reference, least)))
            yield pd.DataFrame(rows, columns=["text", "entry", "score"])

    return joined.mapInPandas(choose, "text string, entry string, score double")


