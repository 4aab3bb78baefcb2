"""Registered encodings, in the order that breaks ties."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from . import rules

VIRAMA, ZWNJ = "\u09CD", "\u200C"
#: Pairs of neighbours between which a bare hasant stays visible.
VISIBLE = {("গ", "ণ"), ("ল", "ফ"), ("ল", "ভ"), ("ঙ", "ক্ত")}


@dataclass
class Encoding:
    id: str
    name: str
    rules: dict[str, tuple[str, str]]
    post: Callable[[list[list]], list[list]] | None = None
    pattern: re.Pattern = field(init=False)

    def __post_init__(self):
        # longest first; single characters fall through to the last branch and are looked up in the rules
        many = sorted((k for k in self.rules if len(k) > 1), key=lambda k: (-len(k), k))
        self.pattern = re.compile("|".join([*map(re.escape, many), r"[\s\S]"]))


def bijoy_post(tokens: list[list]) -> list[list]:
    """Bare hasants between certain letters become visible; a doubled hasant collapses. tokens: [legacy, unicode, kind, mapped]."""
    solid = [i for i, t in enumerate(tokens) if t[2] != rules.PRE]
    place = {i: n for n, i in enumerate(solid)}
    out = [list(t) for t in tokens]
    before = 0  # how many solid tokens lie before i
    for i, t in enumerate(tokens):
        if t[1] == VIRAMA:
            own = i in place
            left = solid[before - 1] if before else None
            right = solid[before + own] if before + own < len(solid) else None
            if left is not None and right is not None and (tokens[left][1], tokens[right][1]) in VISIBLE:
                out[i][1] = VIRAMA + ZWNJ
        before += i in place
    ends = [t[1].endswith(VIRAMA) for t in out]
    for i in range(1, len(out)):
        if ends[i - 1] and out[i][1].startswith(VIRAMA):
            out[i][1] = out[i][1][1:]
    return out


def alpha_post(tokens: list[list]) -> list[list]:
    """A vowel sign before a joined letter moves behind it, and on behind further ones."""
    out = [list(t) for t in tokens]
    for i in range(len(out) - 1):
        if out[i][1] in ("ু", "ূ", "ৃ") and out[i + 1][1].startswith(VIRAMA):
            out[i], out[i + 1] = out[i + 1], out[i]
    return out


_registry: dict[str, Encoding] = {}


def register(encoding: Encoding) -> None:
    _registry[encoding.id] = encoding


def get(encoding_id: str) -> Encoding | None:
    return _registry.get(encoding_id)


def listed() -> list[Encoding]:
    return list(_registry.values())


register(Encoding("bijoy", "Bijoy", rules.bijoy(), bijoy_post))
register(Encoding("sutonny", "Sutonny", rules.sutonny()))
register(Encoding("alpha-ansi", "Alpha ANSI", rules.alpha_ansi(), alpha_post))
