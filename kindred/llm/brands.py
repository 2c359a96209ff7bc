"""Freely typed values mapped to the entries of a reference list (problem 5).

The entries, their other names and their short forms are paths of a trie. A value is searched in the trie with a Levenshtein automaton
(a swap of neighbours is one edit, too) whose states are computed once and kept, so a step costs one look-up. All entries within a
distance that depends on the length are found; the nearest is meant.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: letters of other alphabets that look like Latin ones
_LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝвкмнтгбզαοερτυνικηωß", "aeopcyxijshdqwbkmhtrбqaoeptuvikhwß")
#: digits that stand for letters; one may stand for two
_DIGITS = [str.maketrans("013457$@", "oieastsa"), str.maketrans("013457$@", "oleastsa")]
#: what sellers put around a brand; the words are fixed values of trade names
_AROUND = [
    re.compile(r"^(?:brand\s*:|by\s|the\s(?=.*\scompany$))\s*"),
    re.compile(r"^(?:https?://)?www\.|\.(?:example|com|net|org|de|eu)$"),
    re.compile(r"\s*\((?:r|tm|c|eu|us|usa|uk|imported|original)\)|[™®©]|\stm$"),
    re.compile(r"\s*[-/,]\s*(?:usa|us|eu|uk|original|imported|germany)$"),
    re.compile(r"[\s,]+(?:co\.,?\s*ltd\.?|company|corporation|corp\.?|inc\.?|ltd\.?|llc|gmbh|b\.?\s?v\.?|s\.?\s?a\.?|ag|oy|plc|limited|official store|official|store|home|europe|shop)$"),
]
_FORMERLY = re.compile(r"^(.*?)\s*\((?:formerly|now|ex|was)\s+(.*?)\)$")


def reach(length: int) -> int:
    """The distance allowed for a value of so many letters."""
    return 0 if length < 4 else 1 if length < 8 else 2


def folded(text: str) -> str:
    """Small plain Latin letters, for comparing; blanks and punctuation stay."""
    text = unicodedata.normalize("NFKD", text.translate(_LOOKALIKES).lower().translate(_LOOKALIKES))
    return "".join(c for c in text if not unicodedata.combining(c))


def letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", text)


class Automaton:
    """The band of the edit distance table around the diagonal, as a state; transitions depend only on where the next letter occurs in
    the band, so they are shared by all words and kept."""

    def __init__(self, k: int) -> None:
        self.k, self.width = k, 2 * k + 1
        # a state: this row and the last one, each a tuple over the positions depth-k .. depth+k, and the last letter's occurrences
        self.start = (tuple(abs(j - k) if j >= k else k + 1 for j in range(self.width)), (k + 1,) * self.width, 0)
        self.known: dict[tuple, tuple] = {}

    def step(self, state: tuple, seen: int) -> tuple:
        """seen: bit j is set if the letter read at depth d stands at position d-1-k+j of the word, counted from 0."""
        got = self.known.get((state, seen))
        if got is None:
            (row, last, before), k = state, self.k
            new: list[int] = []
            for j in range(self.width):
                best = row[j] + (not seen >> j & 1)
                if j + 1 < self.width:
                    best = min(best, row[j + 1] + 1)
                if j:
                    best = min(best, new[j - 1] + 1)
                    # the last two letters swapped: this one at the place before, the one before at this place (one bit further up then)
                    if seen >> (j - 1) & 1 and j + 1 <= self.width and before >> (j + 1) & 1:
                        best = min(best, last[j] + 1)
                new.append(min(best, k + 1))
            got = self.known[state, seen] = (tuple(new), row, seen)
        return got


class BrandTrie:
    """entries: (brand_id, brand, other name or null), a list of fixed size."""

    def __init__(self, entries: list[tuple[int, str, str | None]]) -> None:
        self.root: dict = {}
        self.automata = [Automaton(k) for k in range(3)]
        self.short: dict[str, set[int]] = defaultdict(set)
        self.cache: dict[str, int] = {}
        for brand_id, brand, other in entries:
            for name in (brand, other):
                if name and letters(folded(name)):
                    self._add(letters(folded(name)), brand_id)
                    words = [letters(w) for w in folded(name).split()]
                    if len(words) > 1:
                        for i in range(1, len(words)):
                            self.short["".join(w[:1] for w in words[:i]) + "." + "".join(words[i:])].add(brand_id)
                        self.short["".join(w[:1] for w in words)].add(brand_id)

    def _add(self, word: str, brand_id: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(brand_id)

    def within(self, word: str, k: int) -> dict[int, int]:
        """All entries at a distance of at most k from word, each with its distance."""
        auto, n, found = self.automata[k], len(word), {}
        at = defaultdict(int)
        for i, c in enumerate(word):
            at[c] |= 1 << (i + k)
        # one bit more than the band, for swaps
        mask, stack = (1 << (auto.width + 1)) - 1, [(self.root, auto.start, 0)]
        while stack:
            node, state, depth = stack.pop()
            j = n - depth + k
            if "" in node and 0 <= j < auto.width and state[0][j] <= k:
                for brand_id in node[""]:
                    found[brand_id] = min(found.get(brand_id, k), state[0][j])
            if depth - n >= k:
                continue
            for c, child in node.items():
                if c:
                    new = auto.step(state, at[c] >> depth & mask if c in at else 0)
                    if min(new[0]) <= k:
                        stack.append((child, new, depth + 1))
        return found

    def _readings(self, value: str) -> Iterator[str]:
        """The value without what stands around the name, the barest first choice; then older names, turned names and dropped trade words."""
        text = re.sub(r"[\s_\xa0]+", " ", folded(value)).strip(" \"'`´.,;:|-*")
        if m := _FORMERLY.match(text):
            yield from self._readings(m[1])
            yield from self._readings(m[2])
            return
        yield text
        bare, old = text, None
        while bare != old:
            old = bare
            for rx in _AROUND:
                bare = rx.sub("", bare).strip(" \"'`´,;:|-*")
        yield bare
        if m := re.fullmatch(r"([^,]+),\s*([^,]+)", bare):
            yield f"{m[2]} {m[1]}"

    def meant(self, value: str | None) -> int:
        """The entry that value means, or 0. Null and blank values mean none. Of entries equally near, the one with the smallest id."""
        if value is None or not value.strip():
            return 0
        if value not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[value] = self._find(value)
        return self.cache[value]

    def _find(self, value: str) -> int:
        readings = list(dict.fromkeys(self._readings(value)))
        forms = list(dict.fromkeys(letters(r.translate(t)) for r in readings for t in _DIGITS))
        for form in forms:
            if found := self.within(form, 0):
                return min(found)
        for text in readings:  # initials with dots or blanks
            parts = [letters(p) for p in re.split(r"[.\s]+", text) if letters(p)]
            if re.fullmatch(r"[A-Z]{2,4}", value.strip()):
                parts = list(letters(text))
            if len(parts) > 1 and len(parts[0]) == 1:
                initials = [p for p in parts if len(p) == 1]
                rest = "".join(parts[len(initials) :])
                ids = self.short.get("".join(initials) + "." + rest if rest else "".join(initials), set())
                if len(ids) == 1:
                    return next(iter(ids))
        for text in readings:  # the kind of goods after the name: "Name Garden Hoses"
            words = text.split(" ")
            for cut in (1, 2, 3):
                if len(words) > cut and words[-1].endswith("s") and all(w.isalpha() for w in words[-cut:]):
                    for t in _DIGITS:
                        if found := self.within(letters("".join(words[:-cut]).translate(t)), 0):
                            return min(found)
        best: tuple[int, int] | None = None
        for form in forms:
            if (k := reach(len(form))) and (found := self.within(form, k)):
                near = min((d, b) for b, d in found.items())
                best = min(best, near) if best else near
        return best[1] if best else 0


def meanings(values: DataFrame, brand_list: DataFrame, column: str = "brand") -> DataFrame:
    """values with a column brand_id: the entry of brand_list that column means, or 0.

    brand_list is a reference list of fixed size (some hundred rows); it alone is sent to all tasks. A task keeps what it has looked up,
    so a value that fills a third of the rows costs one search a task, and no shuffle.
    """
    entries = [(r.brand_id, r.brand, r.also_known_as) for r in brand_list.select("brand_id", "brand", "also_known_as").distinct().collect()]

    @F.pandas_udf("int")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = BrandTrie(entries)
        for batch in batches:
            yield batch.map(trie.meant, na_action=None).astype("int32")

    return values.withColumn("brand_id", find(F.col(column)))


def map_brands(records: DataFrame, brand_list: DataFrame) -> DataFrame:
    """(rid, brand_id): for each record (rid, brand) whose brand is neither missing (null, blank) nor letter by letter an entry's name."""
    typed = records.select("rid", "brand").filter("rid is not null and brand is not null").filter(F.length(F.regexp_replace("brand", r"[\s\x{A0}]+", "")) > 0)
    names = brand_list.select("brand").distinct()
    other = typed.join(F.broadcast(names), "brand", "left_anti")
    return meanings(other, brand_list).select("rid", "brand_id").distinct()


def unmatched(records: DataFrame, brand_list: DataFrame) -> DataFrame:
    """(brand, n_rows): each value as typed that means no entry, with the number of rows that have it."""
    typed = records.select("brand").filter("brand is not null").filter(F.length(F.regexp_replace("brand", r"[\s\x{A0}]+", "")) > 0)
    counts = typed.groupBy("brand").agg(F.count("*").alias("n_rows")).join(F.broadcast(brand_list.select("brand").distinct()), "brand", "left_anti")
    return meanings(counts, brand_list).filter("brand_id = 0").select("brand", "n_rows")
