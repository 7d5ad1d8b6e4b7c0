"""Name similarity: token-sort and partial ratios on a 0-100 scale.

Spark has no longest-common-subsequence function, so these small helpers run inside
Arrow-batched functions. `NameIndex` holds one bounded block of names and finds the
first one that is similar enough, comparing only candidates that can be.
"""

from __future__ import annotations

from collections import defaultdict

from keyfold import fixed


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the characters of `a`."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return _lcs_with_masks(masks, len(a), b)


def _lcs_with_masks(masks: dict[str, int], size: int, b: str) -> int:
    full = (1 << size) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def sort_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(sort_tokens(a), sort_tokens(b))


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter text against any stretch of the longer one:
    every stretch of the shorter length, and shorter ones at both ends."""
    if not a and not b:
        return 100.0
    needle, hay = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_stretch(needle, hay)
    if best < 100.0 and len(a) == len(b):
        best = max(best, _best_stretch(hay, needle))
    return best


def _best_stretch(needle: str, hay: str) -> float:
    m, n = len(needle), len(hay)
    if not m:
        return 0.0
    if needle in hay:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(needle):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    best = 0.0
    stretches = [(0, end) for end in range(1, m)]
    stretches += [(start, min(start + m, n)) for start in range(n)]
    for start, end in stretches:
        # a stretch with a useless outer character never beats the one without it
        if hay[end - 1] not in masks and hay[start] not in masks:
            continue
        total = m + end - start
        if 200.0 * (end - start) / total > best:
            best = max(best, 200.0 * _lcs_with_masks(masks, m, hay[start:end]) / total)
    return best


def name_score(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), partial_ratio(a, b))


def expand(name: str) -> str:
    low = name.strip().lower()
    return fixed.ABBREVIATIONS.get(low, low)


_PIECE = 4  # pieces are looked up by at most this many leading characters


def _pieces(text: str, edits: int) -> list[str]:
    """Cut text into edits + 1 pieces; after that many single-character insertions and
    deletions at least one piece is still whole."""
    count = edits + 1
    size, extra = divmod(len(text), count)
    out, at = [], 0
    for i in range(count):
        step = size + (1 if i < extra else 0)
        out.append(text[at:at + min(step, _PIECE)])
        at += step
    return out


class NameIndex:
    """A bounded, ordered block of names with an exact 'first match' search.

    A pair can only reach the threshold t when its indel distance is at most
    (1 - t) times the summed lengths. For a text of length m as the shorter side that
    bounds the edits, so one of its pieces must occur unchanged in the other text.
    Names whose pieces would be empty are always compared."""

    def __init__(self, names: list[str], threshold: float):
        self.threshold = threshold
        self.forms: list[str] = []
        self.sorted_forms: list[str] = []
        self._as_needle = [defaultdict(list), defaultdict(list)]   # piece -> positions
        self._as_hay = [defaultdict(list), defaultdict(list)]      # substring -> positions
        self._always: list[int] = []
        for name in names:
            self.add(name)

    def _edits(self, length: int) -> int:
        slack = 1.0 - self.threshold / 100.0
        # token sort allows the other side to be longer by (2 - t) / t
        longest = length * (1.0 + slack) / max(1.0 - slack, 1e-9)
        return int(slack * (length + longest) + 1e-9)

    def add(self, name: str) -> None:
        form = expand(name)
        pos = len(self.forms)
        self.forms.append(form)
        self.sorted_forms.append(sort_tokens(form))
        for side, text in enumerate((form, self.sorted_forms[pos])):
            edits = self._edits(len(text))
            if edits + 1 > len(text):
                self._always.append(pos)
            else:
                for piece in set(_pieces(text, edits)):
                    self._as_needle[side][piece].append(pos)
            for gram in _substrings(text):
                self._as_hay[side][gram].append(pos)

    def first_match(self, name: str) -> int | None:
        """Position of the earliest similar name, or None."""
        form = expand(name)
        ordered = sort_tokens(form)
        found: set[int] = set(self._always)
        for side, text in enumerate((form, ordered)):
            needles = self._as_needle[side]
            for gram in _substrings(text):
                hits = needles.get(gram)
                if hits:
                    found.update(hits)
            edits = self._edits(len(text))
            if edits + 1 > len(text):
                found.update(range(len(self.forms)))
            else:
                for piece in _pieces(text, edits):
                    hits = self._as_hay[side].get(piece)
                    if hits:
                        found.update(hits)
        for pos in sorted(found):
            if self._similar(form, ordered, pos):
                return pos
        return None

    def _similar(self, form: str, ordered: str, pos: int) -> bool:
        other, other_sorted = self.forms[pos], self.sorted_forms[pos]
        m, n = sorted((len(ordered), len(other_sorted)))
        if m + n == 0 or 200.0 * m >= self.threshold * (m + n):
            if indel_ratio(ordered, other_sorted) >= self.threshold:
                return True
        return partial_ratio(form, other) >= self.threshold


def _substrings(text: str) -> set[str]:
    n = len(text)
    return {text[i:i + k] for k in range(1, _PIECE + 1) for i in range(n - k + 1)}
