"""Trigram requirements of regular expressions and postings over chunks.

A regex can only match a chunk that holds certain literal trigrams.
``required`` derives them from the parsed regex as a formula in conjunctive
and disjunctive parts; ``Postings`` is the inverted index of a block of
chunks; ``candidates`` intersects and unites its posting lists, so that the
regex itself runs on candidate chunks only.
"""

from __future__ import annotations

from collections.abc import Iterable

from re import _constants as sre  # type: ignore[attr-defined]
from re import _parser as sre_parse  # type: ignore[attr-defined]

import numpy as np

#: A requirement: None (nothing is required), a trigram, ("and", parts) or ("or", parts).
Need = None | str | tuple[str, tuple["Need", ...]]


def required(pattern: str, flags: int = 0) -> Need:
    """The trigrams (in lower case) without which ``pattern`` cannot match."""
    return _sequence(sre_parse.parse(pattern, flags))


def all_of(parts: Iterable[Need]) -> Need:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def any_of(parts: Iterable[Need]) -> Need:
    kept = tuple(dict.fromkeys(parts))
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", kept)


def _of_literal(text: str) -> Need:
    low = text.lower()
    return all_of(low[i : i + 3] for i in range(len(low) - 2))


#: Most texts that a run of literals and small character classes is expanded to.
_RUNS = 16


def _sequence(items) -> Need:
    parts: list[Need] = []
    runs = [""]

    def close() -> None:
        parts.append(any_of(_of_literal(r) for r in runs))
        runs[:] = [""]

    for op, arg in items:
        more = _texts(op, arg)
        if more and len(runs) * len(more) <= _RUNS:
            runs = [r + m for r in runs for m in more]
            continue
        close()
        if op is sre.SUBPATTERN:
            parts.append(_sequence(arg[3]))
        elif op is sre.BRANCH:
            parts.append(any_of(_sequence(one) for one in arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
            parts.append(_sequence(arg[2]))
        elif op is sre.ATOMIC_GROUP:
            parts.append(_sequence(arg))
    close()
    return all_of(parts)


def _texts(op, arg) -> list[str] | None:
    """All texts an element can match, where they are few; None where it is open."""
    if op is sre.LITERAL:
        return [chr(arg)]
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return [chr(a) for _, a in arg]
    if op is sre.MAX_REPEAT and arg[1] <= 2 and arg[1] != sre.MAXREPEAT:
        one = _join(arg[2])
        return one and [t for n in range(arg[0], arg[1] + 1) for t in (one if n == 1 else [x * n for x in one] if len(one) == 1 or n == 0 else [])] if arg[1] < 2 or one and len(one) == 1 else None
    if op is sre.SUBPATTERN:
        return _join(arg[3])
    if op is sre.BRANCH:
        each = [_join(one) for one in arg[1]]
        return None if None in each else [t for one in each for t in one]
    return None


def _join(items) -> list[str] | None:
    texts = [""]
    for op, arg in items:
        more = _texts(op, arg)
        if more is None or len(texts) * len(more) > _RUNS:
            return None
        texts = [t + m for t in texts for m in more]
    return texts


def trigrams_in(need: Need) -> set[str]:
    """All trigrams of a requirement."""
    if need is None:
        return set()
    return {need} if isinstance(need, str) else set().union(*(trigrams_in(p) for p in need[1]))


class TrigramCodes:
    """Numbers of a fixed set of ASCII trigrams, looked up by a table over three 7-bit codes."""

    def __init__(self, wanted: Iterable[str]) -> None:
        self.trigrams = sorted(wanted)
        self.table = np.zeros(1 << 21, np.uint16)
        for number, trigram in enumerate(self.trigrams, 1):
            a, b, c = trigram.encode("ascii")
            self.table[a << 14 | b << 7 | c] = number

    def of(self, chunk: str) -> list[int]:
        """Numbers of the wanted ones among a chunk's trigrams (in lower case), each once."""
        raw = np.frombuffer(chunk.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(raw) < 3:
            return []
        # no trigram holds the code 0, which stands for all that is not ASCII
        raw[raw > 127] = 0
        found = np.zeros(len(self.trigrams) + 1, bool)
        found[self.table[raw[:-2] << 14 | raw[1:-1] << 7 | raw[2:]]] = True
        return np.nonzero(found[1:])[0].tolist()


class Postings:
    """Posting lists (bit sets over chunk numbers) of the wanted trigrams in a block of chunks.

    A chunk is read once: its own trigrams say which lists it is put into.
    """

    def __init__(self, chunks: list[str], codes: TrigramCodes) -> None:
        self.all = (1 << len(chunks)) - 1
        numbers: list[list[int]] = [[] for _ in codes.trigrams]
        for number, chunk in enumerate(chunks):
            for k in codes.of(chunk):
                numbers[k].append(number)
        self.lists: dict[str, int] = {t: sum(1 << n for n in some) for t, some in zip(codes.trigrams, numbers)}

    def candidates(self, need: Need) -> int:
        """The chunks (as bits) that meet a requirement."""
        if need is None:
            return self.all
        if isinstance(need, str):
            return self.lists[need]
        kind, parts = need
        found = self.all if kind == "and" else 0
        for part in parts:
            found = found & self.candidates(part) if kind == "and" else found | self.candidates(part)
            if kind == "and" and not found:
                return 0
        return found


def bits(number: int) -> Iterable[int]:
    """Positions of the set bits, ascending."""
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low
