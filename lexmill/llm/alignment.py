"""Sentence alignment in bilingual chapters (problem 4).

Translation tables are learned from the library itself, from all its chapters. Sentences that alone share a number are the
first pairs; lexical translation probabilities are estimated on them in both directions (EM), the chapters are aligned, and
the tables estimated again on the aligned pairs. EM runs in blocks of up to BLOCK_CHAPTERS chapters of a language pair as they
lie together; the expected counts of all blocks are added up before they become probabilities. Vocabularies and rarities are counted over all
sentences. Then every chapter is aligned: each
sentence becomes a bag of expected words of the other language, weighted by probability and rarity; an inverted index from
words to the sentences of the other side gives its scores; pairs that are best in both directions stand, and a sentence left
over joins the pair beside it if its bag is covered by that pair's other side (a merge or a split).

Words are lower-case words in Latin script, else pairs of neighbouring characters. A sentence without a closing mark was cut
off or is no prose and pairs with nothing. Null or empty fields give no pairs, nor do rows without an id; repeated rows of one id count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rolling import codes, prefix, spans
from lexmill.llm.lookalikes import _IGNORABLE as IGNORABLE
from lexmill.llm.lookalikes import LATIN_CLASSES, plain
from lexmill.runtime import small, stage

#: Chapters of one language pair on which EM runs at a time; every chapter is in one block.
BLOCK_CHAPTERS = 300
#: Cells of the matrices of chapters that are aligned together; a longer chapter is aligned alone, without matrices.
GROUP_CELLS = 1 << 19
GROUP_CHAPTERS = 64
#: Parts in which the expected counts of a direction are added up.
PARTS = 32
#: Cells of finished blocks a task holds apart before it adds them up.
MOST_CELLS = 2_000_000
#: Expected counts below this share of their word in a block are not handed on; a probability loses at most this much.
LEAST_SHARE = 0.005
MIN_COUNT = 4
MIN_PROBABILITY = 0.08
KEEP = 6
ACCEPT = 0.20
#: A sentence left over joins a pair beside it if this share of the pair's bag is found only in it, and this share of its own bag in the pair.
GAIN = 0.12
COVER = 0.35
NUMBER_WEIGHT = 8.0

# The marks of the sentence rule.
_END = re.compile(r"[。！？…]+[”’\"'」』）)\]]*|[.!?]+[”’\"'」』）)\]]*(?=\s|$)")
_WORD = re.compile(r"[a-zà-öø-ÿ]+")
_NUMBER = re.compile(r"\d+")
#: Letters that look Latin, as the Latin ones: words only need to agree here.
_LATIN = {ord(c): cls[0] for cls in LATIN_CLASSES for c in cls[1:]}
_ALIKE = re.compile("[" + "".join(map(chr, _LATIN)) + "]")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
_LETTER = re.compile(r"[^\W\d_]")
_WIDE = re.compile(r"[^\W\d_a-zA-ZÀ-ÿ]+")


def marked_sentences(text: str) -> list[tuple[str, bool]]:
    """All sentences of a field in order, each with whether a closing mark ends it; a sentence never crosses a line feed."""
    out = []
    for line in text.split("\n"):
        at = 0
        for m in _END.finditer(line):
            out.append((line[at : m.end()], True))
            at = m.end()
        if line[at:].strip():
            out.append((line[at:], False))
    return out


def sentences(text: str) -> list[str]:
    return [s for s, _ in marked_sentences(text)]


def words(s: str, is_plain: bool = False) -> tuple[set[str], set[str]]:
    """The distinct words of a sentence, and its numbers."""
    if not is_plain:
        s = plain(s)
    own = set(_WORD.findall(s.lower()))
    if not s.isascii():
        for run in _WIDE.findall(s):
            if len(run) == 1:
                own.add(run)
            else:
                own.update(map(str.__add__, run, run[1:]))
    return own, {n.lstrip("0") or "0" for n in _NUMBER.findall(s)}


Table = dict[str, list[tuple[str, float]]]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate((np.ones(len(x[:1]), dtype=bool), x[1:] != x[:-1]))]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... up to size[0] numbers, then those of the next start."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _order(x: np.ndarray) -> np.ndarray:
    """np.argsort(x, kind="stable") of numbers from 0 on; they are sorted together with their places, which is faster."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + bits > 62:
        return np.argsort(x, kind="stable")
    return np.sort(x.astype(np.int64) << bits | np.arange(len(x))) & (1 << bits) - 1


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True) of numbers from 0 on."""
    order = _order(x)
    x = x[order]
    new = np.concatenate((np.ones(len(x[:1]), dtype=bool), x[1:] != x[:-1]))
    slot = np.empty(len(x), dtype=np.int64)
    slot[order] = np.cumsum(new) - 1
    return x[new], slot


class _Classes:
    """Words of one side of the pairs, those that stand in exactly the same pairs as one class: EM cannot tell them apart."""

    def __init__(self, owner: np.ndarray, ids: np.ndarray, n_pairs: int):
        self.words, at = _numbered(ids)
        order = _order(at)
        self.n = np.bincount(at, minlength=len(self.words))
        # a sum of random numbers of its pairs names the set of pairs
        drawn = np.random.default_rng(7).integers(0, 1 << 64, n_pairs, dtype=np.uint64)
        marks = np.add.reduceat(drawn[owner[order]], np.cumsum(self.n) - self.n) if len(order) else drawn[:0]
        _, first, self.of = np.unique(marks, return_index=True, return_inverse=True)
        self.size = np.bincount(self.of, minlength=len(first))
        leads = np.zeros(len(self.words), dtype=bool)
        leads[first] = True
        keep = leads[at]
        self.owner, self.ids = owner[keep], self.of[at[keep]]
        self.per_pair = np.bincount(self.owner, minlength=n_pairs)
        self.start = np.cumsum(self.per_pair) - self.per_pair
        self.members, self.first = np.argsort(self.of, kind="stable"), np.cumsum(self.size) - self.size


class _Met:
    """The words (classes) of both sides that stand in one pair: once for each cell of two words and pair, sorted by cell, so that EM reads the cells in order."""

    def __init__(self, s: _Classes, t: _Classes):
        self.sides = s, t
        size = s.per_pair[t.owner]
        of_s, of_t = _ranges(s.start[t.owner], size), np.repeat(np.arange(len(t.ids)), size)
        cell = s.ids[of_s] * len(t.size) + t.ids[of_t]
        order = _order(cell)
        cell = cell[order]
        #: by direction: the word of the other side, in its pair, that shares out its mass
        self.shared = of_t[order], of_s[order]
        new = np.concatenate((np.ones(len(cell[:1]), dtype=bool), cell[1:] != cell[:-1]))
        self.slot = np.cumsum(new) - 1
        cell = cell[new]
        self.cells = cell // max(1, len(t.size)), cell % max(1, len(t.size))

    def expected(self, back: bool = False, rounds: int = 5, least: float = 0.0):
        """(word s, word t, mass) by cell, and the mass of each word s: how often s is expected to stand for t in the pairs after some rounds of EM; back: the sides change places.

        Cells below the share least of their word are left out.
        """
        (s, t), (row, col), shared = self.sides[:: -1 if back else 1], self.cells[:: -1 if back else 1], self.shared[back]
        if not len(row):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0), np.zeros(len(s.words))
        own, other = s.size[row].astype(np.float64), t.size[col]
        w, each = own, np.empty(len(shared))
        for k in range(rounds):
            if k:
                whole = np.bincount(shared, weights=w.take(self.slot, out=each, mode="clip"), minlength=len(t.ids))
            else:  # all words of the pair
                whole = np.bincount(s.owner, weights=s.size[s.ids], minlength=len(s.per_pair))[t.owner]
            np.divide(1.0, whole, out=whole, where=whole > 0)
            mass = w * np.bincount(self.slot, weights=whole.take(shared, out=each, mode="clip")) / own
            total = np.bincount(row, weights=mass * other, minlength=len(s.size))
            if k + 1 < rounds:
                w = own * mass / total[row]
        keep = mass >= least * total[row]
        row, col, mass = row[keep], col[keep], mass[keep]
        each = s.size[row] * t.size[col]
        inner, wide = _ranges(np.zeros(len(each), dtype=np.int64), each), np.repeat(t.size[col], each)
        of_s = s.members[np.repeat(s.first[row], each) + inner // wide]
        of_t = t.members[np.repeat(t.first[col], each) + inner % wide]
        return s.words[of_s], t.words[of_t], np.repeat(mass, each), total[s.of]


def expected_counts(s: _Classes, t: _Classes, rounds: int = 5, least: float = 0.0):
    return _Met(s, t).expected(False, rounds, least)


def _flat(bags: Iterable[Iterable[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(bag, word) of all known words."""
    both = [(k, ids[w]) for k, bag in enumerate(bags) for w in sorted(bag) if w in ids]
    return np.array([k for k, _ in both], dtype=np.int64), np.array([w for _, w in both], dtype=np.int64)


def em(pairs: list[tuple[set[str], set[str]]], rounds: int = 5) -> Table:
    """Lexical translation probabilities p(t | s) from pairs of bags, the best KEEP of each s."""
    count_s, count_t = Counter(w for a, _ in pairs for w in a), Counter(w for _, b in pairs for w in b)
    s_words, t_words = (sorted(w for w, n in count.items() if n >= MIN_COUNT) for count in (count_s, count_t))
    s = _Classes(*_flat((a for a, _ in pairs), {w: k for k, w in enumerate(s_words)}), len(pairs))
    t = _Classes(*_flat((b for _, b in pairs), {w: k for k, w in enumerate(t_words)}), len(pairs))
    row, col, mass, total = expected_counts(s, t, rounds)
    p = mass / total[np.searchsorted(s.words, row)]
    keep = p >= MIN_PROBABILITY
    row, col, p = row[keep], col[keep], p[keep]
    out: Table = defaultdict(list)
    for k in np.lexsort((col, -p)).tolist():
        own = out[s_words[row[k]]]
        if len(own) < KEEP:
            own.append((t_words[col[k]], float(p[k])))
    return dict(out)


class _Direction:
    """The table of one direction as arrays: words of this side by id, and for each its expected words of the other side."""

    def __init__(self, table: Table, ids: dict[str, int], other: dict[str, int], rarity_other: dict[str, float]):
        known = [[(other[t], p) for t, p in table.get(w, ()) if t in other] for w in ids]
        self.start = np.concatenate(([0], np.cumsum([len(k) for k in known]))).astype(np.int64)
        self.to = np.array([t for k in known for t, _ in k], dtype=np.int64)
        self.p = np.array([p for k in known for _, p in k])
        self.rarity = np.array([rarity_other[w] for w in other] or [0.0])

    def retrieve(self, own: _Bags, others: _Bags, numbers: dict[str, int]) -> _Index:
        """The expected words of this side's sentences against the inverted index of the other side; numbers are words of their own."""
        base = len(self.rarity)
        size = self.start[own.ids + 1] - self.start[own.ids]
        at = np.repeat(self.start[own.ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, slot = np.unique(np.repeat(own.owner, size) * np.int64(base) + self.to[at], return_inverse=True)
        weight = np.minimum(np.bincount(slot, weights=self.p[at], minlength=len(key)), 1.0)
        row, word = key // base, key % base
        n_row, n_word = own.numbered(numbers)
        o_row, o_word = others.numbered(numbers)
        return _Index(
            np.concatenate((row, n_row)), np.concatenate((word, base + n_word)), np.concatenate((weight * self.rarity[word], np.full(len(n_row), NUMBER_WEIGHT))),
            np.concatenate((others.owner, o_row)), np.concatenate((others.ids, base + o_word)),
            np.concatenate((self.rarity[others.ids], np.full(len(o_row), NUMBER_WEIGHT))), own.n, others.n,
        )


class _Index:
    """Expected words by sentence of one side, postings by word of the other; scores exist only for pairs that share a word."""

    def __init__(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, owner: np.ndarray, own_word: np.ndarray, mass: np.ndarray, n: int, m: int):
        self.n, self.m = n, m
        self.full = np.maximum(np.bincount(row, weights=weight, minlength=n), 1e-9)
        self.mass = np.maximum(np.bincount(owner, weights=mass, minlength=m), 1e-9)
        order = np.argsort(own_word, kind="stable")
        listed, posting = own_word[order], owner[order]
        lo, hi = np.searchsorted(listed, word, "left"), np.searchsorted(listed, word, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.pairs, slot = np.unique(np.repeat(row, size) * np.int64(max(1, m)) + posting[at], return_inverse=True)
        self.got = np.bincount(slot, weights=np.repeat(weight, size), minlength=len(self.pairs))
        by_row = np.argsort(row, kind="stable")
        self.cut, self.word, self.weight = np.searchsorted(row[by_row], np.arange(n + 1)), word[by_row], weight[by_row]
        by_owner = np.argsort(owner, kind="stable")
        self.own_cut, self.own_word = np.searchsorted(owner[by_owner], np.arange(m + 1)), own_word[by_owner]

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Scores of pairs (row * m + column); 0 where no word is shared."""
        if not len(self.pairs):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.got[at], 0.0)

    def gain(self, row: int, column: int, beside: int) -> float:
        """Share of a row's expectation found in one column and not in the one beside it."""
        words, weight = self.word[self.cut[row] : self.cut[row + 1]], self.weight[self.cut[row] : self.cut[row + 1]]
        of = lambda c: self.own_word[self.own_cut[c] : self.own_cut[c + 1]]
        return float(weight[np.isin(words, of(column)) & ~np.isin(words, of(beside))].sum() / self.full[row])


def _hashed(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(2)).astype(np.int64) | 1 << 62


def _keys(said: list[str]) -> np.ndarray:
    """Words as numbers: pairs of characters as they are, Latin words hashed."""
    latin = [_WORD.fullmatch(w) is not None for w in said]
    end = np.cumsum([len(w) for w in said], dtype=np.int64)
    start = np.concatenate(([0], end[:-1])).astype(np.int64)
    hashed = _hashed(spans(prefix(codes("".join(said))), start, end)) if said else np.zeros(0, dtype=np.int64)
    return np.where(latin, hashed, np.array([ord(w[:1] or "\0") << 21 | (ord(w[1]) if len(w) == 2 else 0) for w in said], dtype=np.int64))


class _Vocabulary:
    """Words of one side by id; pairs of characters also by number, for whole fields at once."""

    def __init__(self, words_of_side: Iterable[str]):
        self.ids = {w: k for k, w in enumerate(words_of_side)}
        keyed = _keys(list(self.ids))
        self.of_key = np.argsort(keyed, kind="stable")
        self.by_key = keyed[self.of_key]
        self.table: np.ndarray | None = None
        pairs = sorted((ord(w[0]) << 21 | (ord(w[1]) if len(w) == 2 else 0), k) for w, k in self.ids.items() if len(w) < 3 and w and _WIDE.fullmatch(w))
        self.keys, self.of = np.array([x for x, _ in pairs], dtype=np.int64), np.array([k for _, k in pairs], dtype=np.int64)


    def _placed(self) -> None:
        """A table of places by some bits of the keys finds most words at once, those that share their place with others are sought; made where it is used."""
        self.shift = 64 - max(4, (8 * len(self.by_key)).bit_length())
        at = self._spread(self.by_key)
        self.table = np.zeros(1 << 64 - self.shift, dtype=np.int32)
        self.table[at[::-1]] = np.arange(len(at))[::-1]
        self.rest = np.flatnonzero(self.table[at] != np.arange(len(at)))

    def _spread(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, words) of the keys that are known."""
        if not len(self.by_key):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self.table is None:
            self._placed()
        found = self.table[self._spread(keys)]
        hit = self.by_key[found] == keys
        if len(self.rest):
            at = np.flatnonzero(~hit)
            rest = self.by_key[self.rest]
            to = np.minimum(np.searchsorted(rest, keys[at]), len(rest) - 1)
            own = rest[to] == keys[at]
            found[at[own]] = self.rest[to[own]]
            hit[at[own]] = True
        at = np.flatnonzero(hit)
        return at, self.of_key[found[at]]


def _plain_lines(field: list[str]) -> tuple[str, list[str]]:
    """Sentences in plain letters, joined by line feeds and as lines."""
    text = plain("\n".join(field))
    text = text.translate(_LATIN) if _ALIKE.search(text) else text
    lines = text.split("\n")
    if len(lines) != len(field):
        lines = [plain(x).replace("\n", " ").translate(_LATIN) for x in field]
        text = "\n".join(lines)
    return text, lines


def _wide_pairs(c: np.ndarray, line: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, pair of neighbouring characters as a number) of code points outside Latin script."""
    at = np.flatnonzero(wide)
    after = at + 1 == np.append(at[1:], -1)
    alone = ~(after | np.concatenate(([False], after[:-1])))
    own = after | alone
    at, after = at[own], after[own]
    return line[at], c[at].astype(np.int64) << 21 | np.where(after, c[np.minimum(at + 1, len(c) - 1)], 0)


class _Bags:
    """Known words of the sentences of one side, end to end, and their numbers."""

    def __init__(self, field: list[str], known: _Vocabulary):
        text, lines = _plain_lines(field)
        self.n = len(field)
        self.numbers = [{n.lstrip("0") or "0" for n in _NUMBER.findall(x)} for x in lines]
        ids, latin = known.ids, [_WORD.findall(x) for x in text.lower().split("\n")] if _LATIN_LETTER.search(text) else []
        flat = [[ids[w] for w in {*ws} if w in ids] for ws in latin]
        self.ids = np.array([w for ws in flat for w in ws], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(flat)), [len(ws) for ws in flat])
        if len(known.keys) and not text.isascii():
            c = codes(text)
            line, key = _wide_pairs(c, np.cumsum(c == 10), _characters().kind[c] & _IS_WIDE != 0)
            found = np.minimum(np.searchsorted(known.keys, key), len(known.keys) - 1)
            hit = known.keys[found] == key
            line = line[hit]
            both = _distinct(line * len(ids) + known.of[found[hit]])
            self.ids = np.concatenate((self.ids, both % len(ids)))
            self.owner = np.concatenate((self.owner, both // len(ids)))

    @classmethod
    def of(cls, side: _Side) -> _Bags:
        """The bags of a chapter that is in numbers already."""
        self = cls.__new__(cls)
        self.n, self.ids, self.owner, self.numbers = len(side.place), side.ids, side.owner, [set() for _ in side.place]
        for k, x in zip(side.n_owner.tolist(), side.n_ids.tolist(), strict=True):
            self.numbers[k].add(str(x))
        return self

    def numbered(self, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, number) of all numbers."""
        both = [(i, numbers[x]) for i, xs in enumerate(self.numbers) for x in xs]
        return np.array([i for i, _ in both], dtype=np.int64), np.array([x for _, x in both], dtype=np.int64)


def _best(key: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Whether each place has the best score of its key; of equals the first."""
    out = np.zeros(len(key), dtype=bool)
    if len(key):
        top = np.full(int(key.max()) + 1, -np.inf)
        np.maximum.at(top, key, score)
        at = np.flatnonzero(score == top[key])
        out[at[np.unique(key[at], return_index=True)[1]]] = True
    return out


def _mutual(rows: np.ndarray, columns: np.ndarray, by_row: np.ndarray, by_column: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the best of their row and of their column; of equals the first."""
    return np.flatnonzero(_best(rows, by_row) & _best(columns, by_column))


class _Side:
    """Sentences of one side of some chapters, end to end: their words and numbers."""

    def __init__(self, count: np.ndarray, place: np.ndarray, owner: np.ndarray, ids: np.ndarray, n_owner: np.ndarray, n_ids: np.ndarray):
        #: sentences by chapter; place of each in its field; (sentence, word); (sentence, number), numbers named apart in each chapter
        self.count, self.place, self.owner, self.ids, self.n_owner, self.n_ids = count, place, owner, ids, n_owner, n_ids
        self.first = np.cumsum(count) - count
        self.chapter = np.repeat(np.arange(len(count)), count)

    def chosen(self, keep: np.ndarray) -> _Side:
        """Only the sentences where keep is true."""
        new = np.cumsum(keep) - 1
        w, x = keep[self.owner], keep[self.n_owner]
        count = np.bincount(self.chapter[keep], minlength=len(self.count))
        return _Side(count, self.place[keep], new[self.owner[w]], self.ids[w], new[self.n_owner[x]], self.n_ids[x])


_HEAD = 6

#: Ranges in which every character is normalized by itself, whatever stands around it; sentences with others are normalized one by one.
_BY_ITSELF = (
    (0x20, 0x17F), (0x370, 0x3FF), (0x400, 0x481), (0x48A, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2100, 0x218B), (0x2190, 0x2BFF),
    (0x3000, 0x3029), (0x3030, 0x3096), (0x309D, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E),
)
_OPEN_END, _NARROW_END, _CLOSER, _SPACE, _IS_LETTER, _IS_WIDE, _IS_DIGIT, _IGNORED = (1 << k for k in range(8))
#: Capital whose lower-case form ends a word: it is i and a mark.
_DOTTED = 0x130


class _Characters:
    """Per code point what the regular expressions of this module say of it, for whole fields at once."""

    def __init__(self):
        # no other plane has letters, marks or ignorables
        places = np.concatenate((np.arange(0x40000), np.arange(0xE0000, 0xF0000))).astype("<u4")
        every = places.tobytes().decode("utf-32-le", "surrogatepass")
        self.kind = np.zeros(0x110000, dtype=np.uint8)
        for bit, pattern in (
            (_OPEN_END, r"[。！？…]+"), (_NARROW_END, r"[.!?]+"), (_CLOSER, r"[”’\"'」』）)\]]+"), (_SPACE, r"\s+"), (_IS_LETTER, _LETTER.pattern + "+"),
            (_IS_WIDE, _WIDE.pattern), (_IS_DIGIT, _NUMBER.pattern), (_IGNORED, IGNORABLE.pattern + "+"),
        ):
            for m in re.finditer(pattern, every):
                self.kind[places[m.start()] : int(places[m.end() - 1]) + 1] |= bit
        #: the character in plain letters, look-alikes as Latin ones; 0: it depends on its neighbours or is more than one
        self.plain = np.zeros(0x110000, dtype=np.uint32)
        self.plain[10] = 10
        for a, b in _BY_ITSELF:
            if a in (0x3400, 0x4E00, 0xAC00):  # as they are
                self.plain[a : b + 1] = np.arange(a, b + 1)
                continue
            for c in range(a, b + 1):
                to = unicodedata.normalize("NFKC", chr(c))
                if len(to) == 1 and not unicodedata.combining(to):
                    self.plain[c] = ord(to.translate(_LATIN))
                elif not any(x.isalnum() for x in to) and not unicodedata.combining(to[0]):  # marks only
                    self.plain[c] = 0x2E
        #: the lower-case Latin letter, 0 for others
        self.latin = np.zeros(0x110000, dtype=np.uint32)
        for c in _WORD_LETTERS:
            self.latin[ord(c)] = ord(c)
            if len(c.upper()) == 1:
                self.latin[ord(c.upper())] = ord(c)
        self.latin[_DOTTED] = ord("i")


_WORD_LETTERS = [c for c in map(chr, range(0x100)) if _WORD.fullmatch(c)]
_KNOWN: list[_Characters] = []


def _characters() -> _Characters:
    if not _KNOWN:
        _KNOWN.append(_Characters())
    return _KNOWN[0]


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of neighbouring places."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1


def _split(field: list[str], known: _Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """marked_sentences() of many fields: their code points, (start, end) of each sentence, whether it is closed and has a letter, and the sentences before each field."""
    c = codes("\n".join(field) + "\n")
    kind = known.kind[c]
    stops = [np.zeros(0, dtype=np.int64)]
    closer, closer_end = _runs(np.flatnonzero(kind & _CLOSER))
    for bit in (_OPEN_END, _NARROW_END):
        _, end = _runs(np.flatnonzero(kind & bit))
        if len(end) and len(closer):
            k = np.minimum(np.searchsorted(closer, end), len(closer) - 1)
            end = np.where(closer[k] == end, closer_end[k], end)
        stops.append(end if bit == _OPEN_END else end[kind[end] & _SPACE != 0])
    stop, feed = np.concatenate(stops), np.flatnonzero(c == 10)
    end = np.concatenate((stop, feed))
    order = np.argsort(end, kind="stable")  # a mark before the line feed it stands at
    end, closed = end[order], (np.arange(len(end)) < len(stop))[order]
    start = np.concatenate(([0], (end + ~closed)[:-1]))
    said = np.concatenate(([0], np.cumsum(kind & _SPACE == 0)))
    keep = closed | (said[end] > said[start])
    start, end, closed = start[keep], end[keep], closed[keep]
    letters = np.concatenate(([0], np.cumsum(kind & _IS_LETTER != 0)))
    first = np.cumsum([0] + [len(x) + 1 for x in field])
    return c, start, end, closed & (letters[end] > letters[start]), np.searchsorted(start, first)


def _in_plain_letters(c: np.ndarray, start: np.ndarray, end: np.ndarray, known: _Characters) -> tuple[np.ndarray, np.ndarray]:
    """Code points of sentences in plain letters, a line feed after each, and the sentence of each code point."""
    size = end - start + 1
    x, line = c[_ranges(start, size)], np.repeat(np.arange(len(size)), size)
    x[np.cumsum(size) - 1] = 10
    ignored = known.kind[x] >= _IGNORED
    if ignored.any():
        x, line = x[~ignored], line[~ignored]
    out = known.plain[x]
    hard = _distinct(line[out == 0])
    if not len(hard):
        return out, line
    at = np.zeros(len(size), dtype=bool)
    at[hard] = True
    at = at[line]
    own = x[at].tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]
    own = [plain(s).replace("\n", " ").translate(_LATIN) + "\n" for s in own]
    return np.concatenate((out[~at], codes("".join(own)))), np.concatenate((line[~at], np.repeat(hard, [len(s) for s in own])))


def _numbers_in(x: np.ndarray, line: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, number) of all numbers, hashed without leading zeros."""
    start, end = _runs(np.flatnonzero(kind & _IS_DIGIT))
    if not len(start):
        return start, start.astype(np.uint64)
    other = np.append(np.flatnonzero((kind & _IS_DIGIT != 0) & (x != 48)), len(x))
    start = np.minimum(other[np.searchsorted(other, start)], end - 1)
    return line[start], spans(prefix(x), start, end)


def _latin_words(x: np.ndarray, line: np.ndarray, known: _Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, key) of all Latin words, sentences in order; and the letters, with (start, end) of one place of each key."""
    low = known.latin[x]
    at = low != 0
    new = at & ~np.concatenate(([False], at[:-1] & (x[:-1] != _DOTTED)))
    start = np.flatnonzero(new)
    none = np.zeros(0, dtype=np.int64)
    if not len(start):
        return none, none, low, none, none
    last = at & np.concatenate((~at[1:] | new[1:], [True]))
    end = np.flatnonzero(last) + 1
    key, first, slot = np.unique(_hashed(spans(prefix(low), start, end)), return_index=True, return_inverse=True)
    both = _distinct(line[start] * len(key) + slot)
    return both // len(key), key[both % len(key)], low, start[first], end[first]


def _packed(source: list[str], target: list[str], keys: dict[int, str]) -> tuple[list[bytes], list[bytes]]:
    """Chapters as numbers: for each side the sentences (1 if closed and with a letter), words and numbers by sentence; and the words' keys. New Latin words enter keys."""
    known = _characters()
    sides, numbers = [], []
    for field in (source, target):
        c, start, end, usable, cut = _split(field, known)
        x, line = _in_plain_letters(c, start, end, known)
        kind = known.kind[x]
        owner, ids, low, first, until = _latin_words(x, line, known)
        for k, a, b in zip(*(v.tolist() for v in (_hashed(spans(prefix(low), first, until)), first, until)), strict=True):
            if k not in keys:
                keys[k] = low[a:b].tobytes().decode("utf-32-le")
        in_line, key = _wide_pairs(x, line, kind & _IS_WIDE != 0)
        if len(key):
            both = _distinct(in_line << 42 | key)
            owner, ids = np.concatenate((owner, both >> 42)), np.concatenate((ids, both & (1 << 42) - 1))
            order = _order(owner)
            owner, ids = owner[order], ids[order]
        per = np.bincount(owner, minlength=len(start)).astype(np.int32)
        sides.append((usable.astype(np.int32), per, ids, np.concatenate(([0], np.cumsum(per)))[cut].tolist(), cut.tolist()))
        at, value = _numbers_in(x, line, kind)
        chapter = np.searchsorted(cut, at, "right") - 1
        numbers.append((chapter, at - cut[chapter], value))
    # numbers are named apart in each chapter, both sides alike
    chapter, at, value = (np.concatenate(own) for own in zip(*numbers, strict=True))
    side = np.repeat([0, 1], [len(own[0]) for own in numbers])
    value = np.unique(value, return_inverse=True)[1]
    named, slot = np.unique(chapter * (1 + value.max(initial=0)) + value, return_inverse=True)
    of = named // (1 + value.max(initial=0))
    name = slot - np.searchsorted(of, chapter)
    wide = 1 + int(at.max(initial=0))
    both = _distinct(((chapter * 2 + side) * wide + at) * (1 + len(named)) + name)
    chapter, at, name = both // (1 + len(named)) // wide, both // (1 + len(named)) % wide, (both % (1 + len(named))).astype(np.int32)
    at, until = at.astype(np.int32), np.searchsorted(chapter, np.arange(2 * len(source) + 1)).tolist()
    out, words_ = [], []
    for k in range(len(source)):
        parts, head, held = [], [], []
        for which, (usable, per, ids, w, cut) in enumerate(sides):
            a, b, i, j = cut[k], cut[k + 1], until[2 * k + which], until[2 * k + which + 1]
            head += [b - a, w[k + 1] - w[k], j - i]
            parts += [usable[a:b], per[a:b], at[i:j], name[i:j]]
            held.append(ids[w[k] : w[k + 1]])
        out.append(np.concatenate((np.array(head, dtype=np.int32), *parts)).tobytes())
        words_.append(np.concatenate(held).tobytes())
    return out, words_


def _heads(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([x[: 4 * _HEAD] for x in packed]), dtype=np.int32).astype(np.int64).reshape(-1, _HEAD)


def _keys_of(packed: list[bytes], words_: list[bytes]) -> list[np.ndarray]:
    """The words of all sentences of either side."""
    heads = _heads(packed)
    whole, m, o = np.frombuffer(b"".join(words_), dtype=np.int64), heads[:, 1], heads[:, 4]
    at = np.cumsum(m + o) - (m + o)
    return [whole[_ranges(at, m)], whole[_ranges(at + m, o)]]


def _unpacked(packed: list[bytes], words_: list[bytes], known: tuple[_Vocabulary, _Vocabulary]) -> list[tuple[_Side, np.ndarray]]:
    """Both sides of some chapters with the known words, each with its usable sentences."""
    heads, whole = _heads(packed), np.frombuffer(b"".join(packed), dtype=np.int32)
    at = np.cumsum([0] + [len(x) // 4 for x in packed])[:-1] + _HEAD
    out = []
    for n, k, keys, own in zip((heads[:, 0], heads[:, 3]), (heads[:, 2], heads[:, 5]), _keys_of(packed, words_), known, strict=True):
        usable, per = (whole[_ranges(at + x, n)].astype(np.int64) for x in (0, n))
        n_in, n_ids = (whole[_ranges(at + 2 * n + x, k)].astype(np.int64) for x in (0, k))
        at_keys, ids = own.find(keys)
        owner = np.repeat(np.arange(len(per)), per)[at_keys]
        side = _Side(n, _ranges(np.zeros(len(n), dtype=np.int64), n), owner, ids, n_in + np.repeat(np.cumsum(n) - n, k), n_ids)
        out.append((side, usable == 1))
        at = at + 2 * n + 2 * k
    return out


class _Scores:
    """One direction over some chapters: expected words of own sentences against the words of the others, chapter by chapter."""

    def __init__(self, table: _Direction, own: _Side, others: _Side):
        self.own, self.others, base = own, others, max(1, len(table.rarity))
        size = table.start[own.ids + 1] - table.start[own.ids]
        at = _ranges(table.start[own.ids], size)
        key, slot = _numbered(np.repeat(own.owner, size) * np.int64(base) + table.to[at])
        row, word = key // base, key % base
        weight = np.minimum(np.bincount(slot, weights=table.p[at], minlength=len(key)), 1.0) * table.rarity[word]
        n, m = len(own.place), len(others.place)
        self.full = np.maximum(np.bincount(row, weights=weight, minlength=n) + NUMBER_WEIGHT * np.bincount(own.n_owner, minlength=n), 1e-9)
        self.mass = np.maximum(np.bincount(others.owner, weights=table.rarity[others.ids], minlength=m) + NUMBER_WEIGHT * np.bincount(others.n_owner, minlength=m), 1e-9)
        # the words of the others by chapter are the columns of its matrices; a word that no chapter holds has the last place
        there = np.zeros(base, dtype=bool)
        there[others.ids] = True
        place = np.full(base, there.sum())
        place[there] = np.arange(there.sum())
        span = int(there.sum()) + 1
        k, said = others.chapter[others.owner], place[others.ids]
        held = np.zeros((len(own.count), span), dtype=bool)
        held[k, said] = True
        self.wide = np.count_nonzero(held, axis=1)
        column = np.full(held.shape, -1, dtype=np.int32)
        column[held] = _ranges(np.zeros(len(self.wide), dtype=np.int64), self.wide)
        self.at_own, self.at_others = np.cumsum(own.count * self.wide) - own.count * self.wide, np.cumsum(others.count * self.wide) - others.count * self.wide
        self.expected, self.said = np.zeros(int((own.count * self.wide).sum())), np.zeros(int((others.count * self.wide).sum()))
        self.said[(self.at_others - others.first * self.wide)[k] + others.owner * self.wide[k] + column[k, said]] = 1.0
        k = own.chapter[row]
        found = column[k, place[word]]
        hit = found >= 0
        k = k[hit]
        self.expected[(self.at_own - own.first * self.wide)[k] + row[hit] * self.wide[k] + found[hit]] = weight[hit]

    def matrix(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected words of own sentences of chapter k, and words of the others."""
        n, m, w = self.own.count[k], self.others.count[k], self.wide[k]
        return self.expected[self.at_own[k] : self.at_own[k] + n * w].reshape(n, w), self.said[self.at_others[k] : self.at_others[k] + m * w].reshape(m, w)

    def gain(self, k: int, row: int, column: int, beside: int) -> float:
        """Weight of a row's expectation found in one column and not in the one beside it, numbers aside."""
        w, e, o = self.wide[k], self.at_own[k] + (row - self.own.first[k]) * self.wide[k], self.at_others[k] - self.others.first[k] * self.wide[k]
        has, lacks = self.said[o + column * w : o + column * w + w], self.said[o + beside * w : o + beside * w + w]
        return float(self.expected[e : e + w] @ np.maximum(has - lacks, 0.0))


class Aligner:
    """Aligns the sentences of one chapter with the tables of its language pair."""

    def __init__(self, forward: Table, backward: Table, rarity_s: dict[str, float], rarity_t: dict[str, float], fitted: bool = False):
        self.fitted = fitted
        self.source, self.target = _Vocabulary(rarity_s), _Vocabulary(rarity_t)
        self.forward = _Direction(forward, self.source.ids, self.target.ids, rarity_t)
        self.backward = _Direction(backward, self.target.ids, self.source.ids, rarity_s)

    def together(self, s: _Side, t: _Side, grow: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, sentence) numbers of all chapters that are translations of each other; the rules of pairs(), with small matrices by chapter."""
        there, back = _Scores(self.forward, s, t), _Scores(self.backward, t, s)
        wide = t.count[s.chapter]
        begin = np.cumsum(wide) - wide  # the cells of a sentence of the source
        i = np.repeat(np.arange(len(s.place)), wide)
        j = _ranges(t.first[s.chapter], wide)
        to_t, to_s = np.zeros(len(i)), np.zeros(len(i))
        at = 0
        for k, n in enumerate((s.count * t.count).tolist()):
            if n:
                expected, said = there.matrix(k)
                to_t[at : at + n] = (expected @ said.T).ravel()
                expected, said = back.matrix(k)
                to_s[at : at + n] = (said @ expected.T).ravel()
                at += n
        # numbers are words of their own
        span = 1 + max(int(s.n_ids.max(initial=0)), int(t.n_ids.max(initial=0)))
        key_s, key_t = s.chapter[s.n_owner] * span + s.n_ids, t.chapter[t.n_owner] * span + t.n_ids
        order = np.argsort(key_t, kind="stable")
        lo, hi = np.searchsorted(key_t[order], key_s, "left"), np.searchsorted(key_t[order], key_s, "right")
        a, b = np.repeat(s.n_owner, hi - lo), t.n_owner[order][_ranges(lo, hi - lo)]
        shared = np.bincount(begin[a] + b - t.first[t.chapter[b]], minlength=len(i))
        to_t += NUMBER_WEIGHT * shared
        to_s += NUMBER_WEIGHT * shared
        said_s, said_t = np.zeros(len(s.place), dtype=bool), np.zeros(len(t.place), dtype=bool)
        said_s[s.n_owner] = True
        said_t[t.n_owner] = True
        clash = said_s[i] & said_t[j] & (shared == 0)
        fits = np.flatnonzero(((to_t > 0) | (to_s > 0)) & ~clash)
        x, y = i[fits], j[fits]
        cos_s, cos_t = to_t[fits] / np.sqrt(there.full[x] * there.mass[y]), to_s[fits] / np.sqrt(back.full[y] * back.mass[x])
        k = s.chapter[x]
        near = -1e-3 * np.abs((x - s.first[k]) / s.count[k] - (y - t.first[k]) / t.count[k])
        both = (cos_s + cos_t) / 2 + near
        at = _mutual(x, y, cos_s + 0.25 * cos_t + near, cos_t + 0.25 * cos_s + near)
        at = at[both[at] >= ACCEPT]
        if not grow:
            return x[at], y[at]
        mate_s, mate_t = np.full(len(s.place), -1), np.full(len(t.place), -1)
        mate_s[x[at]], mate_t[y[at]] = y[at], x[at]
        rest = np.flatnonzero((mate_s[x] < 0) & (mate_t[y] < 0))
        at = rest[_mutual(x[rest], y[rest], both[rest], both[rest])]
        at = at[both[at] >= 1.5 * ACCEPT]
        mate_s[x[at]], mate_t[y[at]] = y[at], x[at]
        own = np.flatnonzero(mate_s >= 0)
        out = [np.stack((own, mate_s[own]), axis=1)]
        top_s, top_t = np.zeros(len(s.place)), np.zeros(len(t.place))
        np.maximum.at(top_s, i, to_t)
        np.maximum.at(top_t, j, to_s)
        numbers_s, numbers_t = defaultdict(set), defaultdict(set)
        for side, numbers in ((s, numbers_s), (t, numbers_t)):
            for a, b in zip(side.n_owner.tolist(), side.n_ids.tolist(), strict=True):
                numbers[a].add(b)
        # a merge: source a says what the other side of a neighbour says beyond that neighbour; a split the other way round
        grown = []
        for side, mates, top, one, other, score, nums, nums_o in (
            (s, mate_s, top_s, there, back, to_t, numbers_s, numbers_t), (t, mate_t, top_t, back, there, to_s, numbers_t, numbers_s),
        ):
            for a in np.flatnonzero((mates < 0) & (top >= COVER * one.full)).tolist():
                k = int(side.chapter[a])
                lo, hi, best = int(side.first[k]), int(side.first[k] + side.count[k]), None
                for beside in (a - 1, a + 1, a - 2, a + 2):
                    if not lo <= beside < hi or mates[beside] < 0:
                        continue
                    o = int(mates[beside])
                    cell = begin[a] + o - t.first[k] if side is s else begin[o] + a - t.first[k]
                    if clash[cell] or score[cell] / one.full[a] < COVER:
                        continue
                    gain = other.gain(k, o, a, beside)
                    if o in nums_o and a in nums:
                        gain += NUMBER_WEIGHT * len((nums_o[o] & nums[a]) - nums.get(beside, set()))
                    gain /= other.full[o]
                    if gain >= GAIN and (best is None or gain > best[0] + 0.05):
                        best = (gain, o)
                if best:
                    grown.append((a, best[1]) if side is s else (best[1], a))
        out.append(np.array(grown, dtype=np.int64).reshape(-1, 2))
        found = np.unique(np.concatenate(out), axis=0)
        return found[:, 0], found[:, 1]

    def packed_pairs(self, packed: list[bytes], words_: list[bytes], grow: bool = True) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[tuple[_Side, np.ndarray]]]]:
        """By groups of packed chapters: their places, sentences of either side that say the same, and the sides of the group."""
        held, cells = [], 0
        for k, x in enumerate([*packed, b""]):
            n, w, _, m, v, _ = np.frombuffer(x, dtype=np.int32, count=_HEAD).tolist() if x else (0,) * _HEAD
            cost = n * m + n * v + m * w
            if held and (not x or cells + cost > GROUP_CELLS or len(held) >= GROUP_CHAPTERS):
                yield held, *self._group([packed[h] for h in held], [words_[h] for h in held], cells, grow)
                held, cells = [], 0
            held.append(k)
            cells += cost

    def _group(self, packed: list[bytes], words_: list[bytes], cells: int, grow: bool):
        (s, s_usable), (t, t_usable) = sides = _unpacked(packed, words_, (self.source, self.target))
        s_at, t_at = np.flatnonzero(s_usable), np.flatnonzero(t_usable)
        own_s, own_t = s.chosen(s_usable), t.chosen(t_usable)
        if cells <= GROUP_CELLS:
            a, b = self.together(own_s, own_t, grow)
        else:  # one long chapter
            a, b = self._retrieved(_Bags.of(own_s), _Bags.of(own_t), grow)
        return s_at[a], t_at[b], sides

    def pairs(self, source: list[tuple[str, bool]], target: list[tuple[str, bool]], grow: bool = True) -> list[tuple[int, int]]:
        """Index pairs (from 0) of the marked sentences that are translations of each other."""
        s_at, t_at = ([k for k, (s, closed) in enumerate(side) if closed and _LETTER.search(s)] for side in (source, target))
        if not s_at or not t_at:
            return []
        bag_s, bag_t = _Bags([source[k][0] for k in s_at], self.source), _Bags([target[k][0] for k in t_at], self.target)
        a, b = self._retrieved(bag_s, bag_t, grow)
        return [(s_at[x], t_at[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def _retrieved(self, bag_s: _Bags, bag_t: _Bags, grow: bool) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, sentence) of one chapter; no matrix of all sentences is made."""
        if not bag_s.n or not bag_t.n:
            none = np.zeros(0, dtype=np.int64)
            return none, none
        numbers = {x: k for k, x in enumerate(sorted(set().union(*bag_s.numbers, *bag_t.numbers)))}
        there, back = self.forward.retrieve(bag_s, bag_t, numbers), self.backward.retrieve(bag_t, bag_s, numbers)
        n, m = bag_s.n, bag_t.n
        # candidates: pairs that either direction's index retrieves
        keys = np.union1d(there.pairs, back.pairs % n * m + back.pairs // n)
        i, j = keys // m, keys % m
        flipped = j * n + i
        cos_s, cos_t = there.score(keys) / np.sqrt(there.full[i] * there.mass[j]), back.score(flipped) / np.sqrt(back.full[j] * back.mass[i])
        clash = lambda a, b: bool(bag_s.numbers[a]) and bool(bag_t.numbers[b]) and bag_s.numbers[a].isdisjoint(bag_t.numbers[b])
        fits = np.array([not clash(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool) if numbers else np.ones(len(keys), dtype=bool)
        i, j, cos_s, cos_t = i[fits], j[fits], cos_s[fits], cos_t[fits]
        near = -1e-3 * np.abs(i / n - j / m)
        both = (cos_s + cos_t) / 2 + near
        at = _mutual(i, j, cos_s + 0.25 * cos_t + near, cos_t + 0.25 * cos_s + near)
        at = at[both[at] >= ACCEPT]
        mate_s = dict(zip(i[at].tolist(), j[at].tolist(), strict=True))
        if not grow:
            return i[at], j[at]
        # among what is left: sentences whose best partner went to a better match
        free_s, free_t = np.ones(n, dtype=bool), np.ones(m, dtype=bool)
        free_s[list(mate_s)] = False
        free_t[list(mate_s.values())] = False
        rest = np.flatnonzero(free_s[i] & free_t[j])
        at = rest[_mutual(i[rest], j[rest], both[rest], both[rest])]
        at = at[both[at] >= 1.5 * ACCEPT]
        mate_s |= dict(zip(i[at].tolist(), j[at].tolist(), strict=True))
        mate_t = {b: a for a, b in mate_s.items()}
        out = set(mate_s.items())
        # a merge: source a says what the other side of a neighbour says beyond that neighbour; a split the other way round
        for count, mates, own, other in ((n, mate_s, there, back), (m, mate_t, back, there)):
            top = np.zeros(count)
            np.maximum.at(top, own.pairs // max(1, own.m), own.got)
            for k in np.flatnonzero(top >= COVER * own.full).tolist():
                if k in mates:
                    continue
                best = None
                for beside in (k - 1, k + 1, k - 2, k + 2):
                    o = mates.get(beside)
                    if o is None or (clash(k, o) if mates is mate_s else clash(o, k)):
                        continue
                    gain = other.gain(o, k, beside)
                    if gain >= GAIN and own.score(np.array([k * own.m + o]))[0] / own.full[k] >= COVER and (best is None or gain > best[0] + 0.05):
                        best = (gain, o)
                if best:
                    out.add((k, best[1]) if mates is mate_s else (best[1], k))
        found = np.array(sorted(out), dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def _rarity(bags: list[set[str]]) -> dict[str, float]:
    n = len(bags) + 1
    return {w: math.log(n / c) for w, c in Counter(w for b in bags for w in b).items() if c >= MIN_COUNT}


def _bags(source: list[str], target: list[str]):
    """Marked sentences of both sides of chapters, and the words and numbers of each sentence."""
    split = [(marked_sentences(a), marked_sentences(b)) for a, b in zip(source, target, strict=True)]
    return split, [([words(s) for s, _ in a], [words(s) for s, _ in b]) for a, b in split]


def _seeds(bags) -> list[tuple[set[str], set[str]]]:
    """Words of the sentences of a chapter that alone share a number."""
    seeds = []
    for a, b in bags:
        in_s, in_t = Counter(n for _, ns in a for n in ns), Counter(n for _, ns in b for n in ns)
        where_t = {n: w for w, ns in b for n in ns}
        seeds += [(w, where_t[n]) for w, ns in a for n in ns if in_s[n] == 1 and in_t.get(n) == 1]
    return seeds


def _matched(aligner: Aligner, split, bags) -> list[tuple[set[str], set[str]]]:
    """Words of the sentences the aligner pairs."""
    return [(x[i][0], y[j][0]) for (a, b), (x, y) in zip(split, bags, strict=True) for i, j in aligner.pairs(a, b, grow=False)]


def fit(source: list[str], target: list[str]) -> tuple[Table, Table, dict[str, float], dict[str, float]]:
    """The arguments of an Aligner, learned from chapters (texts side by side) that fit one block."""
    split, bags = _bags(source, target)
    rarity_s, rarity_t = _rarity([w for a, _ in bags for w, _ in a]), _rarity([w for _, b in bags for w, _ in b])
    seeds = _seeds(bags)
    aligner = Aligner(em(seeds), em([(b, a) for a, b in seeds]), rarity_s, rarity_t)
    seeds = _matched(aligner, split, bags)
    return em(seeds), em([(b, a) for a, b in seeds]), rarity_s, rarity_t


_COUNTS = "pair string, kind string, word long, n long"
_PACKED = "id long, pair string, packed binary, words binary, latin array<string>"
_PARTIAL = "pair string, kind string, part int, words binary, totals binary, n binary, cells binary, other binary, mass binary"
_CELLS = "pair string, kind string, word int, other int, p double, n long"


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, tuple[list, ...]]]:
    """Chapters of a task in blocks of one language pair: (pair, columns besides id and pair), where they lie; nothing is moved for it."""
    held: dict[str, tuple[list, ...]] = {}
    for batch in batches:
        _, pairs, *columns = (c.to_pylist() for c in batch.columns)
        for pair, *row in zip(pairs, *columns, strict=True):
            own = held.setdefault(pair, tuple([] for _ in row))
            for column, value in zip(own, row, strict=True):
                column.append(value)
            if len(own[0]) >= size:
                yield pair, held.pop(pair)
    for pair in sorted(held):
        yield pair, held[pair]


class _Words:
    """Sentences with each word of one side, added up within a task."""

    def __init__(self):
        self.n, self.counts, self.held = 0, [np.zeros((2, 0), dtype=np.int64)], 0

    def add(self, n: int, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        cut = np.flatnonzero(np.concatenate((keys[:1] >= 0, keys[1:] != keys[:-1])))
        self.n += n
        self.counts.append(np.stack((keys[cut], np.diff(cut, append=len(keys)))))
        if len(self.counts) > 16:
            self.merge()

    def merge(self) -> np.ndarray:
        key, slot = _numbered(np.concatenate([x[0] for x in self.counts]))
        self.counts = [np.stack((key, np.bincount(slot, weights=np.concatenate([x[1] for x in self.counts]), minlength=len(key)).astype(np.int64)))]
        return self.counts[0]


def _counted(size: int):
    """Sentences with each word, by side; the row without a word counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], _Words] = {}
        for pair, (packed, words_) in _blocks(batches, size):
            for kind, n, keys in zip("st", _heads(packed)[:, [0, 3]].sum(axis=0).tolist(), _keys_of(packed, words_), strict=True):
                sums.setdefault((pair, kind), _Words()).add(n, keys)
        for (pair, kind), own in sums.items():
            keys, n = own.merge()
            yield pa.record_batch(
                [
                    pa.array([pair] * (len(n) + 1), pa.string()), pa.array([kind] * (len(n) + 1), pa.string()),
                    pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(keys)]), pa.array(np.concatenate(([own.n], n))),
                ],
                ["pair", "kind", "word", "n"],
            )

    return run


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Up to 256 chapters whose texts have up to so many bytes together; a longer one comes alone."""
    for batch in batches:
        begin = held = 0
        for k, n in enumerate((pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) + pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)).tolist()):
            if k > begin and (held + n > most or k - begin >= 256):
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        if batch.num_rows:
            yield batch.slice(begin)


def _as_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chapter split into words once; later passes read numbers. Rows without an id list the Latin words of the task."""
    names = ["id", "pair", "packed", "words", "latin"]
    keys: dict[int, str] = {}
    none = lambda n, kind: pa.nulls(n, kind)
    for batch in _pieces(batches):
        ids, pairs, source, target = (c.to_pylist() for c in batch.columns)
        packed: list[bytes | None] = [None] * len(ids)
        words_: list[bytes | None] = [None] * len(ids)
        before = len(keys)
        for pair in sorted(set(pairs)):
            at = [k for k, x in enumerate(pairs) if x == pair]
            for k, x, w in zip(at, *_packed([source[k] for k in at], [target[k] for k in at], keys), strict=True):
                packed[k], words_[k] = x, w
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(words_, pa.binary()), none(len(ids), pa.list_(pa.string()))], names)
        new = list(islice(keys, before, None))
        if new:
            yield pa.record_batch([none(1, pa.int64()), none(1, pa.string()), none(1, pa.binary()), pa.array([np.array(new).tobytes()], pa.binary()), pa.array([[keys[k] for k in new]], pa.list_(pa.string()))], names)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Latin words with their keys, each once in a task."""
    seen: set[str] = set()
    for batch in batches:
        for keys, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = {k: w for k, w in zip(np.frombuffer(keys, dtype=np.int64).tolist(), own, strict=True) if w not in seen}
            seen.update(new.values())
            yield pa.record_batch([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.string())], ["word", "said"])


class _Sums:
    """Expected counts of the blocks of a task, added up by cell before they leave it."""

    def __init__(self, n: int, m: int):
        self.m = max(1, m)
        self.total, self.n = np.zeros(n), np.zeros(n, dtype=np.int64)
        self.cells: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, met: _Met, back: bool) -> None:
        s = met.sides[back]
        self.n[s.words] += s.n
        row, col, mass, total = met.expected(back, least=LEAST_SHARE)
        if len(row):
            self.total[s.words] += total
            self.cells.append((row * self.m + col, mass))
            self.held += len(row)
        if self.held > MOST_CELLS:
            self.merge()

    def merge(self) -> None:
        if self.cells:
            key, slot = _numbered(np.concatenate([k for k, _ in self.cells]))
            self.cells = [(key, np.bincount(slot, weights=np.concatenate([m for _, m in self.cells]), minlength=len(key)))]
            self.held = 0

    def parts(self) -> Iterator[tuple]:
        """(part, words, totals, n, cells, other, mass): the words by part, the number of cells of each, and its cells."""
        self.merge()
        key, mass = self.cells[0] if self.cells else (np.zeros(0, dtype=np.int64), np.zeros(0))
        word, seen = key // self.m, np.flatnonzero(self.n)
        order = np.argsort((word % PARTS).astype(np.uint8), kind="stable")
        other, mass = (key % self.m).astype(np.int32)[order], mass.astype(np.float32)[order]
        cells = np.bincount(word, minlength=len(self.n)).astype(np.int32)
        cut = np.concatenate(([0], np.cumsum(np.bincount(word % PARTS, minlength=PARTS))))
        for part in range(PARTS):
            own, a, b = seen[seen % PARTS == part], cut[part], cut[part + 1]
            if len(own):
                yield part, *(x.tobytes() for x in (own.astype(np.int32), self.total[own], self.n[own], cells[own], other[a:b], mass[a:b]))


def _in_sentences(side: _Side, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the chosen, word) of the chosen sentences."""
    per = np.bincount(side.owner, minlength=len(side.place))
    size = per[chosen]
    return np.repeat(np.arange(len(chosen)), size), side.ids[_ranges((np.cumsum(per) - per)[chosen], size)]


def _numbered_once(s: _Side, t: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Sentences of a chapter that alone share a number."""
    span = 1 + max(int(s.n_ids.max(initial=0)), int(t.n_ids.max(initial=0)))
    alone = []
    for side in (s, t):
        key, at, n = np.unique(side.chapter[side.n_owner] * span + side.n_ids, return_index=True, return_counts=True)
        alone.append((key[n == 1], side.n_owner[at[n == 1]]))
    _, a, b = np.intersect1d(alone[0][0], alone[1][0], assume_unique=True, return_indices=True)
    return alone[0][1][a], alone[1][1][b]


def _estimated(models, size: int):
    """Expected counts of blocks, both directions: pairs by shared numbers, or, where models has tables, by the aligner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[_Sums, _Sums]] = {}
        for pair, chapters in _blocks(batches, size):
            aligner = models.value[pair]
            bags: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
            n = 0
            if aligner.fitted:
                groups = ((a, b, sides) for _, a, b, sides in aligner.packed_pairs(*chapters, grow=False))
            else:
                sides = _unpacked(*chapters, (aligner.source, aligner.target))
                groups = [(*_numbered_once(sides[0][0], sides[1][0]), sides)]
            for *found, sides in groups:
                for own, chosen, (side, _) in zip(bags, found, sides, strict=True):
                    owner, ids = _in_sentences(side, chosen)
                    own.append((owner + n, ids))
                n += len(found[0])
            s, t = (_Classes(*(np.concatenate(x) for x in zip(*own, strict=True)), n) for own in bags)
            forward, backward = sums.setdefault(pair, (_Sums(len(aligner.source.ids), len(aligner.target.ids)), _Sums(len(aligner.target.ids), len(aligner.source.ids))))
            met = _Met(s, t)
            forward.add(met, False)
            backward.add(met, True)
        for pair, both in sums.items():
            for kind, own in zip("fb", both, strict=True):
                rows = list(own.parts())
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [pa.int32()] + [pa.binary()] * 6
                    yield pa.record_batch(
                        [pa.array([pair] * len(rows), pa.string()), pa.array([kind] * len(rows), pa.string()), *(pa.array(c, x) for c, x in zip(columns, types, strict=True))],
                        ["pair", "kind", "part", "words", "totals", "n", "cells", "other", "mass"],
                    )

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One part of the expected counts of all tasks: probabilities worth keeping, and how many pairs hold each word (other is null)."""
    read = {c: np.concatenate([np.frombuffer(x, dtype=d) for x in rows.column(c).to_pylist()]) for c, d in
            (("words", np.int32), ("totals", np.float64), ("n", np.int64), ("cells", np.int32), ("other", np.int32), ("mass", np.float32))}
    words_, slot = _numbered(read["words"])
    total, n = np.bincount(slot, weights=read["totals"]), np.bincount(slot, weights=read["n"]).astype(np.int64)
    key, slot = _numbered(np.repeat(read["words"].astype(np.int64), read["cells"]) << 32 | read["other"])
    at = np.searchsorted(words_, key >> 32)
    p = np.bincount(slot, weights=read["mass"], minlength=len(key)) / total[at]
    keep = (p >= MIN_PROBABILITY) & (n[at] >= MIN_COUNT)
    word, other = np.concatenate((words_, key[keep] >> 32)), pa.array(key[keep] & 0xFFFFFFFF, pa.int32())
    count, none = len(word), len(words_)
    pair, kind = rows.column("pair")[0].as_py(), rows.column("kind")[0].as_py()
    return pa.table(
        [
            pa.array([pair] * count, pa.string()), pa.array([kind] * count, pa.string()), pa.array(word, pa.int32()), pa.concat_arrays([pa.nulls(none, pa.int32()), other]),
            pa.array(np.concatenate((np.zeros(none), p[keep])), pa.float64()), pa.array(np.concatenate((n, np.zeros(count - none, dtype=np.int64))), pa.int64()),
        ],
        ["pair", "kind", "word", "other", "p", "n"],
    )


def bilingual(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(id, pair, source, target) of chapters that have both texts; pair names the two languages."""
    langs = small(books.select(F.col("id").alias("book_id"), F.concat_ws(">", "source_lang", "target_lang").alias("pair")).dropDuplicates(["book_id"]))
    both = chapters.select(F.col("id").cast("long").alias("id"), "book_id", F.col("content_source").alias("source"), F.col("content_target").alias("target"))
    return both.where("id IS NOT NULL AND length(source) > 0 AND length(target) > 0").join(langs, "book_id").select("id", "pair", "source", "target")


def _tables(cells: DataFrame, models: dict[str, Aligner]) -> dict[str, dict[str, Table]]:
    """The best KEEP translations of each word by pair and direction, words on both sides held by MIN_COUNT pairs; bounded by the vocabularies."""
    tables: dict[str, dict[str, Table]] = {pair: {"f": {}, "b": {}} for pair in models}
    rows = cells.where(F.col("other").isNotNull() | (F.col("n") >= MIN_COUNT)).toPandas()
    for (pair, kind), own in rows[rows["other"].notna()].groupby(["pair", "kind"]):
        sides = [list(models[pair].source.ids), list(models[pair].target.ids)]
        listed, others = sides if kind == "f" else sides[::-1]
        held = rows.loc[rows["other"].isna() & (rows["pair"] == pair) & (rows["kind"] == ("b" if kind == "f" else "f")), "word"]
        table = tables[pair][kind]
        for word, other, p in own[own["other"].isin(set(held))].sort_values(["word", "p", "other"], ascending=[True, False, True])[["word", "other", "p"]].itertuples(index=False):
            known = table.setdefault(listed[word], [])
            if len(known) < KEEP:
                known.append((others[int(other)], p))
    return tables


def _fitted(docs: DataFrame, block_chapters: int) -> tuple[DataFrame, dict[str, Aligner]]:
    """All chapters in numbers, each id once, and an aligner for each language pair."""
    context = docs.sparkSession.sparkContext
    both = stage(docs.dropDuplicates(["id"]).mapInArrow(_as_numbers, _PACKED))
    packed = both.where("id IS NOT NULL").select("id", "pair", "packed", "words")
    counts = stage(packed.mapInArrow(_counted(block_chapters), _COUNTS).groupBy("pair", "kind", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= MIN_COUNT)))
    n: dict[tuple[str, str], int] = {(r.pair, r.kind): r.n + 1 for r in counts.where("word IS NULL").collect()}
    latin = both.where("id IS NULL").select("words", "latin").mapInArrow(_listed, "word long, said string").distinct()
    said = {r.word: r.said for r in latin.join(counts.select("word").distinct(), "word", "left_semi").collect()}
    rarity: dict[str, dict[str, dict[str, float]]] = {pair: {"s": {}, "t": {}} for pair, _ in n}
    held = [(r.pair, r.kind, said[r.word] if r.word in said else chr(r.word >> 21) + chr(r.word & 0x1FFFFF).rstrip("\0"), r.n) for r in counts.where("word IS NOT NULL").collect()]
    for pair, kind, word, c in sorted(held):
        rarity[pair][kind][word] = math.log(n[pair, kind] / c)
    models = {pair: Aligner({}, {}, r["s"], r["t"]) for pair, r in rarity.items()}
    for _ in range(2):
        partial = packed.mapInArrow(_estimated(context.broadcast(models), block_chapters), _PARTIAL)
        tables = _tables(partial.groupBy("pair", "kind", "part").applyInArrow(_added, _CELLS), models)
        models = {pair: Aligner(t["f"], t["b"], rarity[pair]["s"], rarity[pair]["t"], True) for pair, t in tables.items()}
    return packed, models


def learn(docs: DataFrame, block_chapters: int = BLOCK_CHAPTERS) -> dict[str, Aligner]:
    """An aligner for each language pair, fitted on all its chapters in blocks of about block_chapters."""
    return _fitted(docs, block_chapters)[1]


def _aligned(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pairs, packed, words_ = batch.column(0).to_numpy(), *(batch.column(k).to_pylist() for k in (1, 2, 3))
            for pair in sorted(set(pairs)):
                at = np.array([k for k, x in enumerate(pairs) if x == pair])
                found = [np.zeros((3, 0), dtype=np.int64)]
                for held, a, b, ((s, _), (t, _)) in models.value[pair].packed_pairs([packed[k] for k in at.tolist()], [words_[k] for k in at.tolist()]):
                    found.append(np.stack((ids[at[held]][s.chapter[a]], s.place[a] + 1, t.place[b] + 1)))
                own, a, b = np.concatenate(found, axis=1)
                yield pa.record_batch([pa.array(own, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["chapter_id", "source_no", "target_no"])

    return run


def aligned_sentences(docs: DataFrame, block_chapters: int = BLOCK_CHAPTERS) -> DataFrame:
    """docs: bilingual(). (chapter_id, source_no, target_no) of the sentences that say the same."""
    packed, models = _fitted(docs, block_chapters)
    data = docs.sparkSession.sparkContext.broadcast(models)
    return packed.mapInArrow(_aligned(data), "chapter_id long, source_no int, target_no int")
