"""Counts of one text that the quality operators share. A word is a run of characters other than ASCII white space; bytes.split() cuts there exactly."""

from __future__ import annotations

import numpy as np

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Texts of more words find repeated windows by sorted integers, in less memory.
LONG = 20_000


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in windows of `size` words found twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) <= LONG:
        windows = list(zip(*(words[i:] for i in range(size))))
        if len(set(windows)) == n:
            return 0
        once: set = set()
        twice: set = set()
        for w in windows:
            (twice if w in once else once).add(w)
        hit = np.fromiter((w in twice for w in windows), bool, n)
    else:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        code = seq[:n].copy()
        for i in range(1, size):
            code = np.unique(code * len(ids) + seq[i : n + i], return_inverse=True)[1]
        hit = np.bincount(code)[code] > 1
    cover = np.zeros(len(words) + 1, np.int32)
    cover[:n][hit] += 1
    np.subtract.at(cover, np.flatnonzero(hit) + size, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null: none."""
    b = (text or "").encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars = sum(map(len, words)) if len(b) == len(text or "") else len(b"".join(words).decode())
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


#: Character classes: ASCII vowels, consonants, capitals, digits, blanks, line ends, sentence ends, inner punctuation, quotes, brackets, other symbols, control; small and capital Latin letters with marks; other letters and signs.
CLASSES = 15
_LATIN = 0x250


def _table() -> np.ndarray:
    t = np.full(_LATIN + 1, CLASSES - 1, np.uint8)
    for k, chars in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "  ", "\n\r", ".!?", ",;:-", "\"'«»", "()[]{}", "#*$%&|<>@^_`~+=/\\")):
        t[[ord(c) for c in chars]] = k
    t[[i for i in range(32) if chr(i) not in "\n\r"] + [127]] = 11
    for i in range(0xC0, _LATIN):
        t[i] = 13 if chr(i).isupper() else 12
    return t


_CLASS_OF = _table()


def class_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_CLASS_OF[np.minimum(code, _LATIN)], minlength=CLASSES)


_STOPS = bytes(32 if chr(i) in ".,;:!?\"'()" else i for i in range(256))


def plain_words(text: str) -> list[bytes]:
    """Words with A-Z in lower case and without sentence punctuation."""
    return text.encode().lower().translate(_STOPS).split()
