"""Counts of glyph tokens of many texts at once, for all encodings in one pass over the characters.

Every character has a class, which says for each encoding whether a rule or the shared characters cover it; a histogram of
classes for each text holds all counts as if each character were a token. Rules of several characters are looked for by
their first two, for all encodings with one look-up; the few matches are put right afterwards: in each encoding, from left
to right, the longest one wins and its characters count as one token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..encodings.registry import Encoding

#: Characters that are worked on at once, of one text at least.
PIECE = 1 << 20
_POINTS = 0x110000


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Found:
    """Matches of one encoding's rules of several characters: the text, its place, how many characters, which of the rules."""

    row: np.ndarray
    at: np.ndarray
    length: np.ndarray
    rule: np.ndarray


class Glyphs:
    """shared: the characters that every encoding passes through; blank: white space."""

    def __init__(self, encodings: list[Encoding], shared: str, blank: str):
        self.n = len(encodings)
        self.covered = np.zeros((self.n, _POINTS), bool)
        self.covered[:, _points(shared)] = True
        self.blank = np.zeros(_POINTS, bool)
        self.blank[_points(blank)] = True
        many = [[r for r in e.rules if len(r) > 1] for e in encodings]
        for k, e in enumerate(encodings):
            singles = "".join(r for r in e.rules if len(r) == 1)
            self.covered[k, _points(singles)] = True
        far = np.arange(_POINTS) > 0x7F
        bits = self.blank | far.astype(np.int64) << 1
        for k in range(self.n):
            bits = bits | self.covered[k].astype(np.int64) << (2 + k)
        kinds, self.kind = np.unique(bits, return_inverse=True)
        self.kind = self.kind.astype(np.uint16)
        blank_kind, far_kind = kinds & 1 > 0, kinds & 2 > 0
        self.kinds = {"blank": blank_kind, "any_far": far_kind, "far": far_kind & ~blank_kind, "covered": [kinds >> (2 + k) & 1 > 0 for k in range(self.n)]}
        letters = sorted({c for rules in many for r in rules for c in r})
        self.base = len(letters) + 1
        longest = max((len(r) for rules in many for r in rules), default=2)
        #: Codes of rules are numbers to this base, or hashes of 64 bits where some are too long for that.
        self.step = self.base if self.base**longest < 1 << 63 else 0x5851F42D4C957F2D
        self.letter = np.zeros(_POINTS, np.int64)
        self.letter[_points("".join(letters))] = np.arange(1, self.base)
        self.pairs = np.zeros(self.base**2, np.int64)
        #: For each length the codes of rules, sorted, and the places of these rules in many.
        self.rules: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        self.many = many
        for k, rules in enumerate(many):
            by: dict[int, list[tuple[int, int]]] = {}
            for i, r in enumerate(rules):
                code = self.letter[_points(r)]
                self.pairs[code[0] * self.base + code[1]] |= 1 << k
                by.setdefault(len(r), []).append((self._code(code), i))
            self.rules.append({n: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for n, v in sorted(by.items(), reverse=True)})

    def _code(self, letters) -> int:
        out = 0
        for x in letters:
            out = (out * self.step + int(x)) & (1 << 64) - 1
        return out - (1 << 64) if out >> 63 else out

    def _matches(self, k: int, letters: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, characters, rule) of the taken matches among places, each in a text that ends at ends."""
        length, rule = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for n, (codes, names) in self.rules[k].items():
            fits = np.flatnonzero((length == 0) & (places + n <= ends))
            code, whole = np.zeros(len(fits), np.int64), np.ones(len(fits), bool)
            for i in range(n):
                x = letters[places[fits] + i]
                whole &= x > 0
                code = code * self.step + x
            j = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            good = whole & (codes[j] == code)
            length[fits[good]], rule[fits[good]] = n, names[j[good]]
        at, length, rule = places[length > 0], length[length > 0], rule[length > 0]
        end = at + length
        fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] >= np.maximum.accumulate(end)[:-1])))
        size = np.diff(np.append(fresh, len(at)))
        keep = np.ones(len(at), bool)
        for first, n in zip(fresh[size > 1].tolist(), size[size > 1].tolist(), strict=True):  # they overlap: from left to right
            free = 0
            for i in range(first, first + n):
                keep[i] = at[i] >= free
                free = end[i] if keep[i] else free
        return at[keep], length[keep], rule[keep]

    def pieces(self, texts: list[str | None]):
        """Yields (i, j, points, offsets, matches of each encoding) of texts i to j."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= PIECE):
                size += len(texts[j] or "")
                j += 1
            part = [t or "" for t in texts[i:j]]
            points = _points("".join(part))
            at = np.concatenate(([0], np.cumsum([len(t) for t in part])))
            found = []
            letters = self.letter[points]
            bits = self.pairs[letters[:-1] * self.base + letters[1:]] if len(letters) > 1 else np.zeros(0, np.int64)
            some = np.flatnonzero(bits)
            row = np.searchsorted(at, some, side="right") - 1
            for k in range(self.n):
                mine = (bits[some] >> k & 1) > 0
                place, length, rule = self._matches(k, letters, some[mine], at[row[mine] + 1])
                found.append(Found(np.searchsorted(at, place, side="right") - 1, place, length, rule))
            yield i, j, points, at, found
            i = j

    def _histogram(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, classes) counts."""
        n, m = len(at) - 1, len(self.kinds["blank"])
        return np.bincount(np.repeat(np.arange(n) * m, np.diff(at)) + self.kind[points], minlength=n * m).reshape(n, m)

    def distinct(self, texts: list[str | None]):
        """Yields (text, encoding, [(token, how often)]) for each text that has tokens and each encoding."""
        for i, j, points, at, found in self.pieces(texts):
            alphabet, code = np.unique(points, return_inverse=True)
            n, m, names = j - i, max(1, len(alphabet)), list(map(chr, alphabet.tolist()))
            lone = np.bincount(np.repeat(np.arange(n) * m, np.diff(at)) + code, minlength=n * m).reshape(n, m)
            for k, f in enumerate(found):
                mine = lone
                if len(f.at):
                    inside = np.repeat(f.at - np.cumsum(f.length) + f.length, f.length) + np.arange(f.length.sum())
                    mine = lone - np.bincount(np.repeat(f.row, f.length) * m + code[inside], minlength=n * m).reshape(n, m)
                row, x = np.nonzero(mine)
                tokens, times = [names[c] for c in x.tolist()], mine[row, x].tolist()
                size = max(1, len(self.many[k]))
                pair, often = np.unique(f.row * size + f.rule, return_counts=True)
                more, often = [self.many[k][c] for c in (pair % size).tolist()], often.tolist()
                a, b = np.searchsorted(row, np.arange(n + 1)), np.searchsorted(pair // size, np.arange(n + 1))
                for t in range(n):
                    if at[t + 1] > at[t]:
                        both = zip(tokens[a[t] : a[t + 1]], times[a[t] : a[t + 1]], strict=True), zip(more[b[t] : b[t + 1]], often[b[t] : b[t + 1]], strict=True)
                        yield i + t, k, [*both[0], *both[1]]

    def _inside(self, f: Found, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(match, point) of every character of the matches."""
        of = np.repeat(np.arange(len(f.at)), f.length)
        return of, points[np.repeat(f.at - np.cumsum(f.length) + f.length, f.length) + np.arange(f.length.sum())]

    def counts(self, texts: list[str | None], solid: bool) -> np.ndarray:
        """(encodings, texts, 4): tokens, covered ones, characters beyond ASCII, those of covered tokens. solid: without
        tokens of white space."""
        out = np.zeros((self.n, len(texts), 4), np.int64)
        for i, j, points, at, found in self.pieces(texts):
            table = self._histogram(points, at)
            ok = ~self.kinds["blank"] if solid else np.ones(table.shape[1], bool)
            far = self.kinds["far"]
            for k, f in enumerate(found):
                covered = self.kinds["covered"][k]
                base = np.stack([table[:, m].sum(1) for m in (ok, ok & covered, far, far & covered)], 1)
                if len(f.at):
                    of, x = self._inside(f, points)
                    kind = self.kind[x]
                    lone = np.stack([m[kind] for m in (ok, ok & covered, far, far & covered)], 1).astype(np.int64)
                    mine = np.zeros((len(f.at), 4), np.int64)
                    np.add.at(mine, of, -lone)
                    # a match is one covered token with all its characters, unless it is white space that does not count
                    counts = np.bincount(of, ok[kind], len(f.at)) > 0
                    mine[counts, :2] += 1
                    mine[counts, 2:] += np.bincount(of, self.kinds["any_far"][kind], len(f.at)).astype(np.int64)[counts, None]
                    np.add.at(base, f.row, mine)
                out[k, i:j] = base
        return out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(encodings, texts) confidence and coverage of characters beyond ASCII."""
        total, good, far, far_good = np.moveaxis(self.counts(texts, True), 2, 0).astype(float)
        cover = np.divide(good, total, out=np.zeros_like(good), where=total > 0)
        legacy = np.divide(far_good, far, out=np.ones_like(far), where=far > 0)
        return np.minimum(cover, legacy), legacy

    def unmapped(self, texts: list[str | None], k: int = 0) -> pa.Array:
        """map<string, long> for each text: characters that no rule of encoding k and no shared one covers."""
        keys, values, ends = [], [], [0]
        for i, j, points, at, found in self.pieces(texts):
            open_ = ~self.covered[k][points]
            if len(found[k].at):
                f = found[k]
                open_[np.repeat(f.at - np.cumsum(f.length) + f.length, f.length) + np.arange(f.length.sum())] = False
            place = np.flatnonzero(open_)
            row = np.searchsorted(at, place, side="right") - 1
            key, n = np.unique(row * _POINTS + points[place], return_counts=True)
            keys += [chr(c) for c in (key % _POINTS).tolist()]
            values += n.tolist()
            ends += (ends[-1] + np.cumsum(np.bincount(key // _POINTS, minlength=j - i))).tolist()
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.int64()))
