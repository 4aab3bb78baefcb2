"""Conversion of many texts at once: every token is a number, and what is known of it stands in tables.

Tokens come from the matches of glyphs.py. Post-processing and reordering only reach from a sign, a reph or a hasant to the
next two neighbours that are plain letters, so a line is cut there and only the stretches that hold such a token are looked
at one by one, each distinct one once. All else (counts, output, unmapped sequences) is look-ups and sums over the tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

from ..encodings import registry
from ..encodings.rules import NONE, PRE, REPH
from .glyphs import _POINTS, Glyphs, _points

#: Post-processing that never reaches beyond two plain neighbours; with any other a whole text is one stretch.
_LOCAL = (None, registry.bijoy_post, registry.alpha_post)
#: Tokens of a stretch that is remembered, and how many of them are.
SHORT, KEPT = 64, 1 << 16


class Lines:
    """Tokens of a run of texts, first to last: as they were read (raw), after post-processing (mapped) and in logical order
    (placed); those of text i stand at at[i] to at[i + 1]."""

    def __init__(self, made: "Rewriter", first: int, last: int, raw: np.ndarray, at: np.ndarray):
        self.made, self.first, self.last, self.raw, self.at = made, first, last, raw, at
        self.mapped, self.placed = made.settle(raw, at)

    def sums(self, flags: np.ndarray) -> list[int]:
        """How many tokens of each text are flagged."""
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[self.at]).tolist()

    @cached_property
    def ends(self) -> np.ndarray:
        """Characters of the output ahead of each token, and all of them."""
        return np.concatenate(([0], np.cumsum(self.made.size[self.placed])))

    @cached_property
    def texts(self) -> list[str]:
        """The output of each text, not composed yet."""
        size, start = self.made.size[self.placed], self.made.start[self.placed]
        if len(size) and size.max() > 1 or not size.all():
            start = np.repeat(start - self.ends[:-1], size) + np.arange(self.ends[-1])
        points, cuts = self.made.flat[start], self.ends[self.at].tolist()
        return [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(cuts, cuts[1:], strict=False)]

    def first_solid(self, tokens: np.ndarray, n: int) -> list[list[int]]:
        """The first n tokens of each text that are not white space as raw or moved ones."""
        solid = ~self.made.blank[tokens]
        before = np.concatenate(([0], np.cumsum(solid)))
        rank = before[:-1] - np.repeat(before[self.at[:-1]], np.diff(self.at))
        place = np.flatnonzero(solid & (rank < n))
        found, cuts = tokens[place].tolist(), np.searchsorted(place, self.at).tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def unmapped(self, contexts: int) -> list[list[tuple[int, int, list[int]]]]:
        """(token, how often, its first places) of each text, tokens by their first place."""
        place = np.flatnonzero(self.made.open[self.placed])
        row = np.searchsorted(self.at, place, side="right") - 1
        key = row * self.made.count + self.made.legacy[self.placed[place]]
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        times = np.diff(np.append(new, len(order)))
        groups = np.argsort(order[new])
        new, times = new[groups], times[groups]
        token, owner = self.made.legacy[self.placed[place[order[new]]]].tolist(), row[order[new]]
        near = place[order[np.minimum(new[:, None] + np.arange(contexts), np.maximum(len(order) - 1, 0))]] if len(new) else np.zeros((0, contexts), int)
        found = [(t, n, p[:n]) for t, n, p in zip(token, times.tolist(), near.tolist(), strict=True)]
        cuts = np.searchsorted(owner, np.arange(len(self.at))).tolist()
        return [found[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def context(self, row: int, place: int, reach: int) -> str:
        """The token at place of all, marked, with reach tokens on either side; not composed yet."""
        low, high = int(self.at[row]), int(self.at[row + 1])
        a, b, c, d = (int(self.ends[x]) - int(self.ends[low]) for x in (max(low, place - reach), place, place + 1, min(high, place + 1 + reach)))
        text = self.texts[row]
        left, right = "…" if place - low > reach else "", "…" if place - low + reach + 1 < high - low else ""
        return f"{left}{text[a:b]}⟦{self.made.name(self.placed[place])}⟧{text[c:d]}{right}"


class Rewriter:
    """shared and blank as for Glyphs; classify gives h, j, m or x for the output of a token; settle one stretch of tokens
    [legacy, unicode, kind, mapped], as it was read, after post-processing and in logical order."""

    def __init__(self, e: registry.Encoding, shared: str, blank: str, marks: str, classify: Callable[[str], str], reorder: Callable[[list], list]):
        self.encoding, self.reorder = e, reorder
        self.glyphs = Glyphs([e], shared, blank)
        self.many = self.glyphs.many[0]
        self.count = _POINTS + len(self.many)
        self.start, self.size, self.flat = np.arange(self.count), np.ones(self.count, np.int8), np.arange(_POINTS, dtype=np.uint32)
        self.letter, self.open = np.full(self.count, ord("x"), np.uint8), np.ones(self.count, bool)
        self.ends = np.zeros(self.count, bool)
        self.legacy = np.arange(self.count)
        self.open[:_POINTS] = ~self.glyphs.covered[0]
        self.open[_POINTS:] = False
        self.blank = np.concatenate((self.glyphs.blank, [all(self.glyphs.blank[_points(r)]) for r in self.many])).astype(bool)
        self.letter[_points(marks)] = ord("m")
        self.letter[ord(registry.VIRAMA)], self.ends[ord(registry.VIRAMA)] = ord("h"), True
        apart, more = True, []
        for k, r in enumerate(self.many):
            self.start[_POINTS + k] = 0
        places = {r: _POINTS + k for k, r in enumerate(self.many)}
        for r, (out, kind) in e.rules.items():
            t, c = places.get(r, ord(r[0])), classify(out)
            self.start[t], self.size[t] = _POINTS + sum(map(len, more)), len(out)
            more.append(out)
            self.ends[t] = out.endswith(registry.VIRAMA)
            self.letter[t] = ord({PRE: "p", REPH: "r"}.get(kind) or ("e" if c == "x" and self.ends[t] else c))
            apart &= kind not in (PRE, REPH) or c in "mx"
        self.flat = np.concatenate((self.flat, _points("".join(more))))
        self.local = apart and e.post in _LOCAL
        self.size = self.size.astype(np.int64)
        self.moved = np.isin(self.letter, [ord(c) for c in "pr"])
        self.hot = self.moved.copy()
        if e.post:
            self.hot |= self.ends | np.isin(self.letter, [ord(c) for c in "he"])
        self.sign = (self.letter == ord("m")) & bool(e.post)
        self.joined = self.letter == ord("j")
        if not self.local:
            self.hot[:] = True
        self.changed: dict[tuple[int, str], int] = {}
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def name(self, token: int) -> str:
        """The legacy text of a token."""
        t = int(self.legacy[token])
        return chr(t) if t < _POINTS else self.many[t - _POINTS]

    def shown(self, token: int) -> str:
        """What a token reads as, or its legacy text where nothing maps it."""
        a = int(self.start[token])
        return self.name(token) if self.open[token] else "".join(map(chr, self.flat[a : a + int(self.size[token])].tolist()))

    def _change(self, token: int, out: str) -> int:
        """The number of a token whose output post-processing changed."""
        base = int(self.legacy[token])
        if (base, out) not in self.changed:
            self.changed[base, out] = len(self.start)
            more = {"start": len(self.flat), "size": len(out), "legacy": base} | {x: getattr(self, x)[base] for x in ("open", "blank", "moved", "letter", "ends", "hot", "sign", "joined")}
            for x, value in more.items():
                setattr(self, x, np.append(getattr(self, x), np.array(value, getattr(self, x).dtype)))
            self.flat = np.concatenate((self.flat, _points(out)))
        return self.changed[base, out]

    def _stretch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = ids.tobytes() if len(ids) <= SHORT else None
        if key in self.known:
            return self.known[key]
        rules, numbers = self.encoding.rules, ids.tolist()
        names = [chr(t) if t < _POINTS else self.many[t - _POINTS] for t in numbers]
        raw = [[x, *rules.get(x, (x, NONE)), t] for x, t in zip(names, numbers, strict=True)]
        was = {t[3]: t[1] for t in raw}
        done = self.encoding.post(raw) if self.encoding.post else raw
        number = lambda tokens: np.array([t[3] if t[1] == was[t[3]] else self._change(t[3], t[1]) for t in tokens], np.int64)
        out = number(done), number(self.reorder(done))
        if key is not None:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[key] = out
        return out

    def settle(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens after post-processing, and in logical order."""
        hot = self.hot[ids]
        if len(ids) > 1:
            hot[:-1] |= self.sign[ids[:-1]] & self.joined[ids[1:]]
        hot = np.flatnonzero(hot)
        if not len(hot):
            return ids, ids
        plain = self.letter[ids] == ord("x")
        cut = np.zeros(len(ids) + 1, bool)
        cut[at] = True
        if self.local:
            cut[1:-1] |= plain[1:] & plain[:-1]
        starts = np.flatnonzero(cut)
        k = np.unique(np.searchsorted(starts, hot, side="right") - 1)
        low, high = starts[k], starts[k + 1]
        parts = [self._stretch(ids[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        size = high - low
        where = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        mapped, placed = ids.copy(), ids.copy()
        mapped[where], placed[where] = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
        return mapped, placed

    def lines(self, texts: list[str | None]):
        """Yields Lines of texts, in order."""
        for i, j, points, at, (f,) in self.glyphs.pieces(texts):
            ids = points.astype(np.int64)
            if len(f.at):
                ids[f.at] = _POINTS + f.rule
                keep = np.ones(len(ids), bool)
                rest = f.length - 1
                keep[np.repeat(f.at + 1 - np.cumsum(rest) + rest, rest) + np.arange(rest.sum())] = False
                ids, at = ids[keep], np.concatenate(([0], np.cumsum(keep)))[at]
            yield Lines(self, i, j, ids, at)
