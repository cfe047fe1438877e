"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton finds the known whole values of a dictionary in the text, quoted stretches are taken
as atoms, and dynamic programming chooses the cover of the text with the fewest unknown pieces (then the fewest
pieces). A delimiter inside a chosen known value or inside quotes is part of that value and doesn't cut.

Defined results:
* null text, empty text, text of blanks, delimiters or brackets only: no values;
* equal values count each, positions run from 1 over the values kept; empty pieces are dropped and take no position;
* a text of any length is split whole; rows are independent, so repeated rows give repeated results;
* a quote that isn't closed before a delimiter or the end is an ordinary character;
* unknown pieces are cut at every delimiter.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.frames import keep_columns

DELIMITERS = ",;|/+&\n\r\t、；，｜"
QUOTES = "\"'"
BRACKETS = {"[": "]", "{": "}", "(": ")"}


def _fold(text: str) -> str:
    """Lower case, of the same length as text."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Segmenter:
    """Splits one text into its values. known: whole values, compared without case."""

    def __init__(self, known: Iterable[str] = (), delimiters: str = DELIMITERS):
        self.delimiters = frozenset(delimiters)
        self.known = {_fold(k.strip()) for k in known if k and k.strip()}
        self.automaton = ahocorasick.Automaton()
        for k in self.known:
            self.automaton.add_word(k, len(k))
        if self.known:
            self.automaton.make_automaton()

    def _core(self, text: str) -> str:
        """Without the brackets around the list."""
        text = text.strip()
        while len(text) >= 2 and text[0] in BRACKETS and text[-1] == BRACKETS[text[0]] and self._encloses(text):
            text = text[1:-1].strip()
        return text

    @staticmethod
    def _encloses(text: str) -> bool:
        """The bracket at the start is closed by the one at the end, brackets in quotes aside."""
        opening, closing, depth, quote, fresh = text[0], BRACKETS[text[0]], 0, "", True
        for k, c in enumerate(text):
            if quote:
                if c == quote:
                    quote = ""
            elif c in QUOTES and fresh:
                quote = c
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if depth == 0:
                    return k == len(text) - 1
            if not c.isspace():
                fresh = not (c.isalnum() or c in "_-.")
        return bool(quote)

    def _quoted(self, text: str, at: int) -> int:
        """Where the quoted atom that starts at `at` ends (after its quote), or -1 if nothing closes it. A doubled quote stays inside."""
        q, k, n = text[at], at + 1, len(text)
        while k < n:
            if text[k] == q:
                if k + 1 < n and text[k + 1] == q:
                    k += 2
                    continue
                return k + 1 if self._closes(text, k) else -1
            k += 1
        return -1

    def _closes(self, text: str, k: int) -> bool:
        """Nothing but white space between the quote at k and the next delimiter or the end."""
        k += 1
        while k < len(text) and text[k].isspace() and text[k] not in self.delimiters:
            k += 1
        return k == len(text) or text[k] in self.delimiters

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = self._core(text)
        if not text:
            return []
        out = []
        for start, end, quoted in self._cover(text, self._atoms(text)):
            value = text[start:end].strip()
            if quoted:
                q = value[0]
                value = value[1:-1].replace(q + q, q).strip()
            if value:
                out.append(value)
        return out

    def _atoms(self, text: str) -> list[tuple[int, int, bool]]:
        """Pieces between delimiters, quoted stretches whole: (start, end, quoted), empty ones left out."""
        atoms, k, n = [], 0, len(text)
        while k < n:
            while k < n and (text[k] in self.delimiters or text[k].isspace()):
                k += 1
            if k == n:
                break
            end = self._quoted(text, k) if text[k] in QUOTES else -1
            if end > 0:
                atoms.append((k, end, True))
                k = end
                continue
            start = k
            while k < n and text[k] not in self.delimiters:
                k += 1
            atoms.append((start, k, False))
        return atoms

    def _cover(self, text: str, atoms: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
        """The cover of the atoms of least cost: a known value costs 0 however many atoms it joins, an unknown atom 1."""
        first = {a[0]: i for i, a in enumerate(atoms)}
        last = {a[0] + len(text[a[0] : a[1]].rstrip()): i for i, a in enumerate(atoms)}
        spans: dict[int, list[int]] = {}
        for end, size in self.automaton.iter(_fold(text)) if self.known else ():
            i, j = first.get(end + 1 - size), last.get(end + 1)
            if i is not None and j is not None and i <= j and not any(a[2] for a in atoms[i : j + 1]):
                spans.setdefault(j, []).append(i)
        best: list[tuple[int, int, int]] = [(0, 0, -1)]  # cost, pieces, first atom of the last piece
        for j, (_, _, quoted) in enumerate(atoms):
            cost, pieces, _ = best[j]
            choice = (cost + (not quoted), pieces + 1, j)
            for i in spans.get(j, ()):
                choice = min(choice, (best[i][0], best[i][1] + 1, i))
            best.append(choice)
        out, j = [], len(atoms)
        while j:
            i = best[j][2]
            out.append((atoms[i][0], atoms[j - 1][1], atoms[i][2] and i == j - 1))
            j = i
        return out[::-1]


def values_column(column: Column, known: Iterable[str] = (), delimiters: str = DELIMITERS) -> Column:
    """array<string> of the values in column (never null). Equal texts of an Arrow batch are split once."""
    known = sorted(set(known))

    def split(texts: pd.Series) -> pd.Series:
        seg = Segmenter(known, delimiters)
        codes, distinct = pd.factorize(texts)
        done = [seg.split(t) for t in distinct]
        return pd.Series([done[c] if c >= 0 else [] for c in codes], index=texts.index)

    split.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(split, "array<string>").asNondeterministic()(column)  # else a filter on the result runs it a second time


def may_hold_several(column: Column, delimiters: str = DELIMITERS) -> Column:
    """JVM-side test that every text of two or more values passes: it holds a delimiter. One look at each character."""
    inside = "".join("\\" + d if d in "\\^]-[&|" else d for d in delimiters)
    return column.rlike(f"[{inside}]")


def explode_values(
    df: DataFrame,
    column: str,
    known: Iterable[str] = (),
    *,
    keep: Iterable[str] | None = None,
    least: int = 1,
    delimiters: str = DELIMITERS,
    pos_name: str = "pos",
    value_name: str = "value",
) -> DataFrame:
    """One row per value of df[column], with its position; rows with fewer than `least` values are left out.

    keep: the columns to carry (default: all of df); one named like pos_name or value_name gets the suffix _in.
    No shuffle: rows are split where they are, and with least > 1 the rows that can't qualify never leave the JVM.
    """
    text = df[f"`{column}`"].cast("string")
    rows = df.filter(may_hold_several(text, delimiters)) if least > 1 else df.filter(text.isNotNull())
    made = "__values"
    split = rows.select(*keep_columns(rows, keep or rows.columns, (pos_name, value_name, made)), values_column(rows[f"`{column}`"].cast("string"), known, delimiters).alias(made))
    if least > 1:
        split = split.filter(F.size(made) >= least)
    carried = [c for c in split.columns if c != made]
    return split.select(*[f"`{c}`" for c in carried], F.posexplode(made).alias("__p", value_name)).select(*[f"`{c}`" for c in carried], (F.col("__p") + 1).alias(pos_name), value_name)
