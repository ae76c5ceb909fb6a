"""Personal data by a semi-Markov conditional random field over whole candidate segments.

Base kinds (email, ip, card, phone) are found by their patterns and tests and always stay. The
model adds further spans: within an island (blank-separated tokens with a digit or an @, with single
blanks between them) every candidate segment of at most MAX_TOKENS tokens is scored as a whole, by features that see
all of it (digit groups, Luhn sum, dotted shape, what stands beside it, cue words before it), and
dynamic programming chooses boundaries and kinds of all segments of the island jointly. Tokens outside
islands can only be plain text, so islands are decoded independently without loss. Chosen spans that
overlap a base span add nothing and are left out, and so are those that fail their kind's test.

The model is trained by maximum conditional likelihood (forward-backward over segments) on sentences
made from a seed; no document enters it, so its size and result don't depend on the input.

Features come from running sums over the island and are made for a block of tokens at a time, so a long text
of digits takes memory in proportion to its length and a few numbers a character.

Defined results: a null text is empty; repeated rows get equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, id_type, map_rows

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most (a card with a separator after every digit has 37).
MAX_TOKENS = 40
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_ip(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(s: str) -> bool:
    return 13 <= len(d := _digits(s)) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind, then start; per kind leftmost, without overlap; a match that fails its test is dropped.

    Each @ can end only one local part, the run of its characters before it, so e-mails take time
    in proportion to the text; the other patterns are linear as they stand.
    """
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if at > done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_TRIGGER = re.compile(r"[0-9@]\S*")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_NUMERIC = re.compile(r"[0-9().+ -]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CUES = (re.compile(r"e-?mail|contact|write", re.I), re.compile(r"\bip\b|host|server|address", re.I), re.compile(r"card|visa|pay|credit", re.I), re.compile(r"phone|tel\b|call|fax|mobile", re.I))


def islands(text: str) -> list[tuple[int, int]]:
    """Ranges of text in which an entity may lie."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, floor = m.start(), out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        if out and a - floor <= 1:
            out[-1] = (out[-1][0], m.end())
        else:
            out.append((a, m.end()))
    return out


N_SEG, N_OUT = 33, 9
#: Tokens whose segments are scored together.
BLOCK = 2048


def _running(mask: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... items."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


class Island:
    """A stretch of text in tokens (runs of letters, runs of digits, other characters one by one), with running sums that tell the features of any segment without reading it again.

    Candidate segments are those that some kind can take: one @ with a local part before and a domain after it, 9 to 19 digits with only
    signs of numbers between them, from a digit, + or ( to a digit, or a dotted quad; at most MAX_TOKENS tokens, no blank at an end. Letters outside ASCII count as letters.
    """

    def __init__(self, text: str, a: int, b: int):
        self.a = a
        at = np.fromiter((m.start() for m in _TOKEN.finditer(text, a, b)), np.int32)
        self.n = len(at)
        self.start, self.stop = at, np.append(at[1:], np.int32(b)).astype(np.int32)
        self.low = low = max(0, a - 1)
        code = np.frombuffer(text[low : b + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code = np.concatenate([code, np.zeros(3, np.uint32)])
        digit = (code >= 48) & (code <= 57)
        alpha = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128) | (code > 127)
        blank = np.isin(code, _BLANKS)
        dot, ats = code == 46, code == 64
        value = np.where(digit, code.astype(np.int32) - 48, 0)
        doubled = value * 2 - 9 * (value > 4)
        self.alnum, self.is_digit, self.is_alpha = np.append(digit | alpha, [False] * 3), digit, alpha
        r = self.sums = {}
        r["digit"], r["alpha"], r["blank"], r["dot"], r["at"] = map(_running, (digit, alpha, blank, dot, ats))
        r["numeric"] = _running(digit | np.isin(code, [ord(c) for c in "().+ -"]))
        r["name"] = _running(digit | (alpha & (code < 128)) | (code == 45))
        r["local"] = _running(digit | (alpha & (code < 128)) | np.isin(code, [ord(c) for c in "._%+-"]))
        r["space"], r["odd"] = _running(code == 32), _running((code < 32) | (code > 126))
        pair = np.zeros(len(code), bool)
        pair[1:] = dot[1:] & dot[:-1]
        r["dots"] = _running(pair)
        pair[1:] = blank[1:] & blank[:-1]
        r["blanks"] = _running(pair)
        r["big"] = _running(value > 0)
        # digits by the parity of their number in the island, as they are and doubled, for Luhn sums of any stretch
        number = r["digit"][:-1] % 2
        for parity in (0, 1):
            mine = digit & (number == parity)
            r["plain", parity], r["twice", parity] = _running(np.where(mine, value, 0)), _running(np.where(mine, doubled, 0))
        first = self.start - low
        self.kind = np.where(digit[first], 1, np.where(alpha[first] & (code[first] < 128), 2, np.where(blank[first], 3, 0))).astype(np.int8)
        self.sign = np.where(self.kind == 0, code[first], np.where(self.kind == 3, 32, 0))
        self.runs, self.size = _running(self.kind == 1), self.stop - self.start
        self.opens = (self.kind == 1) | np.isin(self.sign, (43, 40))
        self.places = np.flatnonzero(ats)
        found = ([m.span() for m in c.finditer(text, max(0, a - 24), b)] for c in _CUES)
        self.cues = [(np.array([x for x, _ in f], np.int64), np.array([y for _, y in f], np.int64)) for f in found]

    def sum(self, name, x, y):
        """Characters of a class between places x and y of the text."""
        r = self.sums[name]
        return r[y - self.low] - r[x - self.low]

    def luhn(self, x, y):
        k = self.sums["digit"][y - self.low] % 2  # the last digit's parity is 1 - k, and it counts as it is
        plain = np.where(k == 1, self.sum(("plain", 0), x, y), self.sum(("plain", 1), x, y))
        twice = np.where(k == 1, self.sum(("twice", 1), x, y), self.sum(("twice", 0), x, y))
        return (plain + twice) % 10 == 0

    def quad(self, i, j, x, y):
        """Four numbers up to 255 with dots between them."""
        ok = (j - i == 7) & (self.sum("dot", x, y) == 3) & (self.runs[j] - self.runs[i] == 4)
        for k in (0, 2, 4, 6):
            t = np.minimum(i + k, self.n - 1)
            end = self.stop[t]
            lead = np.maximum(self.start[t], end - 3)
            ok &= (self.kind[t] == 1) & (self.sum("big", self.start[t], lead) == 0)
            number = np.zeros(len(i), np.int64)
            for back in (3, 2, 1):
                c = self.code[np.maximum(end - back - self.low, 0)].astype(np.int64) - 48
                number = number * 10 + np.where(end - back >= self.start[t], c, 0)
            ok &= number <= 255
        return ok

    def candidates(self, low: int, high: int):
        """Segments (first token, token after) that end at a token boundary in low+1 .. high, by end, then start."""
        out_i, out_j = [], []
        for length in range(1, min(MAX_TOKENS, high) + 1):
            j = np.arange(max(low + 1, length), high + 1)
            i = j - length
            ok = (self.kind[i] != 3) & (self.kind[j - 1] != 3)
            i, j = i[ok], j[ok]
            x, y = self.start[i], self.stop[j - 1]
            digits, ats = self.sum("digit", x, y), self.sum("at", x, y)
            number = (self.sum("numeric", x, y) == y - x) & (digits >= 9) & (digits <= 19) & (self.kind[j - 1] == 1) & self.opens[i]
            maybe = number | (ats == 1)
            if length == 7:
                maybe |= self.sum("dot", x, y) == 3
            i, j, x, y, number = i[maybe], j[maybe], x[maybe], y[maybe], number[maybe]
            if not len(i):
                continue
            take = number | (self.quad(i, j, x, y) if length == 7 else False)
            if len(self.places):
                take |= self.mail(x, y)[0]
            out_i.append(i[take])
            out_j.append(j[take])
        if not out_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        order = np.lexsort((i, j))
        return i[order], j[order]

    def mail(self, x, y):
        """Whether a stretch is a local part, an @ and a domain; and whether it has exactly one @."""
        one = self.sum("at", x, y) == 1
        places = self.places
        if not len(places):
            return one, one
        k = np.minimum(np.searchsorted(places, x - self.low), len(places) - 1)
        at = np.where(one, places[k] + self.low, x)
        d = at + 1
        domain = (self.sum("name", d, y) + self.sum("dot", d, y) == y - d) & (self.sum("dot", d, y) > 0) & (self.sum("dots", np.minimum(d + 1, y), y) == 0)
        domain &= (self.code[d - self.low] != 46) & (self.code[y - 1 - self.low] != 46)
        return one & domain & (at > x) & (self.sum("local", x, at) == at - x), one

    def features(self, i, j) -> np.ndarray:
        """A row for each segment: what it is as a whole, and what stands beside it."""
        x, y = self.start[i], self.stop[j - 1]
        f = np.zeros((len(i), N_SEG), np.float32)
        if not len(i):
            return f
        code, low = self.code, self.low
        digits, dots, size = self.sum("digit", x, y), self.sum("dot", x, y), y - x
        first, last = code[x - low], code[y - 1 - low]
        f[:, 0] = 1
        f[:, 2], f[:, 1] = self.mail(x, y)
        f[:, 3] = f[:, 2]
        f[:, 4] = self.sum("numeric", x, y) == size
        f[:, 5], f[:, 6], f[:, 7], f[:, 8], f[:, 9] = first == 43, first == 40, self.is_digit[x - low], self.is_digit[y - 1 - low], self.is_alpha[y - 1 - low]
        f[np.arange(len(i)), 10 + (digits > 6) + (digits > 8) + (digits > 12) + (digits > 15) + (digits > 19)] = 1
        f[:, 16] = (f[:, 4] > 0) & (digits >= 13) & (digits <= 19) & self.luhn(x, y)
        f[:, 17] = self.quad(i, j, x, y)
        f[:, 18] = (digits + dots == size) & (dots > 0) & (first != 46) & (last != 46) & (self.sum("dots", np.minimum(x + 1, y), y) == 0) & (f[:, 17] == 0)
        f[:, 19] = self.sum("space", x, y) > 0
        f[:, 20] = self.runs[j] - self.runs[i] >= 3
        f[:, 21] = self.national(i, j)
        before = np.where(x > low, code[np.maximum(x - 1 - low, 0)], 0)
        after, then = code[y - low], code[y + 1 - low]
        alnum = self.alnum
        f[:, 22], f[:, 23] = (x > low) & alnum[np.maximum(x - 1 - low, 0)], alnum[y - low]
        f[:, 24] = np.isin(before, [ord(c) for c in ".-+@/=_("])
        f[:, 25] = np.isin(after, [ord(c) for c in ".-@/)"]) & alnum[y + 1 - low] & (then > 0)
        for k, (starts, ends) in enumerate(self.cues):
            if len(starts):
                at = np.searchsorted(ends, x, "right") - 1
                f[:, 26 + k] = (at >= 0) & (starts[np.maximum(at, 0)] >= x - 24)
        f[:, 30] = (f[:, 1] == 0) & (self.sum("alpha", x, y) > 0)
        f[:, 31] = digits == size
        f[:, 32] = (self.sum("blanks", np.minimum(x + 1, y), y) > 0) | (self.sum("odd", x, y) > 0)
        return f

    def national(self, i, j):
        """(234) 567-8901 and its like: an area code in brackets or before a blank or hyphen, then two groups of three or four digits."""
        def group(t, least, most):
            t = np.clip(t, 0, self.n - 1)
            return (self.kind[t] == 1) & (self.size[t] >= least) & (self.size[t] <= most)

        def sign(t, *codes):
            return np.isin(self.sign[np.clip(t, 0, self.n - 1)], codes)

        n = j - i
        tail = group(j - 3, 3, 4) & sign(j - 2, 32, 45) & group(j - 1, 3, 4)
        plain = (n == 5) & group(i, 2, 4) & sign(i + 1, 32, 45)
        bracket = sign(i, 40) & group(i + 1, 2, 4) & sign(i + 2, 41) & ((n == 6) | ((n == 7) & sign(i + 3, 32)))
        return tail & (plain | bracket)

    def outside(self, low: int, high: int) -> np.ndarray:
        """Features of tokens low .. high-1 as plain text."""
        k, g, n = self.kind[low:high], self.sign[low:high], self.size[low:high]
        f = np.zeros((high - low, N_OUT), np.float32)
        f[:, 0] = 1
        d = np.flatnonzero(k == 1)
        f[d, 1 + (n[d] > 3) + (n[d] > 6) + (n[d] > 11)] = 1
        f[:, 5], f[:, 6], f[:, 7], f[:, 8] = g == 64, g == 43, k == 3, np.isin(g, [ord(c) for c in ".-()"])
        return f

    def blocks(self):
        """(low, high, first tokens, tokens after, segment features, outside features) for ends in low+1 .. high, in order."""
        for low in range(0, self.n, BLOCK):
            high = min(self.n, low + BLOCK)
            i, j = self.candidates(low, high)
            yield low, high, i, j, self.features(i, j), self.outside(low, high)


_BLANKS = [i for i in range(0x3001) if chr(i).isspace()]


def hopeless(text: str, a: int, b: int) -> bool:
    """Whether a stretch has neither an @ nor the digits of any candidate: nine, or four with three dots."""
    if text.find("@", a, b) >= 0:
        return False
    s = text[a:b]
    digits = sum(map(s.count, "0123456789"))
    return digits < 9 and (digits < 4 or s.count(".") < 3)


def lattice(text: str, a: int, b: int):
    """Tokens of an island (start, end), its candidate segments (first token, token after, features) and the tokens' outside features, as lists; for training, on short texts."""
    land = Island(text, a, b)
    i, j = land.candidates(0, land.n)
    segs = [(int(p), int(q), f) for p, q, f in zip(i, j, land.features(i, j).astype(float), strict=True)]
    return list(zip(land.start.tolist(), land.stop.tolist(), strict=True)), segs, land.outside(0, land.n).astype(float)


class SemiCrf:
    """Weights: kinds x segment features, outside features, label transitions (0: outside)."""

    def __init__(self):
        k = len(KINDS)
        self.seg, self.out, self.move = np.zeros((k, N_SEG)), np.zeros(N_OUT), np.zeros((k + 1, k + 1))

    def _scores(self, segs, outside):
        by_end: dict[int, list[int]] = {}
        for n, s in enumerate(segs):
            by_end.setdefault(s[1], []).append(n)
        f = np.array([s[2] for s in segs]).reshape(-1, N_SEG)
        return f, f @ self.seg.T, outside @ self.out, by_end

    def best(self, land: Island) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, token after, kind), without the outside. Segments are scored block by block; a few numbers stay for each token."""
        n, k = land.n, len(KINDS) + 1
        value = np.full((n + 1, k), -np.inf)
        from_token, from_label = np.zeros((n + 1, k), np.int32), np.zeros((n + 1, k), np.int8)
        value[0, 0] = 0
        stay, enter, kinds = self.move[:, 0].copy(), self.move[:, 1:], np.arange(k - 1)
        for low, high, i, j, f, outside in land.blocks():
            seg, out = f @ self.seg.T, outside @ self.out
            edge = np.searchsorted(j, np.arange(low + 1, high + 2)).tolist()
            for at in range(low + 1, high + 1):
                v = value[at - 1] + stay
                p = int(v.argmax())
                value[at, 0], from_token[at, 0], from_label[at, 0] = v[p] + out[at - 1 - low], at - 1, p
                x, y = edge[at - 1 - low], edge[at - low]
                if x < y:
                    v = value[i[x:y]][:, :, None] + enter[None]
                    got = v.max(1) + seg[x:y]
                    top = got.argmax(0)
                    value[at, 1:] = got[top, kinds]
                    from_token[at, 1:], from_label[at, 1:] = i[x + top], v[top, :, kinds].argmax(1)
        at, t, path = n, int(value[n].argmax()), []
        while at:
            i, p = int(from_token[at, t]), int(from_label[at, t])
            if t:
                path.append((i, at, t - 1))
            at, t = i, p
        return path[::-1]

    def gradient(self, segs, outside, gold: set[tuple[int, int, int]]):
        """Observed minus expected features, by forward-backward over segments."""
        f, seg, out, by_end = self._scores(segs, outside)
        n, k = len(outside), len(KINDS) + 1
        a, b = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        a[0, 0], b[n] = 0, 0
        by_start: dict[int, list[int]] = {}
        for s, (i, _, _) in enumerate(segs):
            by_start.setdefault(i, []).append(s)
        add = np.logaddexp.reduce
        for j in range(1, n + 1):
            a[j, 0] = add(a[j - 1] + self.move[:, 0]) + out[j - 1]
            if ends := by_end.get(j):
                a[j, 1:] = add(np.stack([add(a[segs[s][0]][:, None] + self.move[:, 1:], 0) + seg[s] for s in ends]), 0)
        for i in range(n - 1, -1, -1):
            ways = [self.move[:, 0] + out[i] + b[i + 1, 0]]
            ways += [add(self.move[:, 1:] + (seg[s] + b[segs[s][1], 1:])[None, :], 1) for s in by_start.get(i, ())]
            b[i] = add(np.stack(ways), 0)
        z = b[0, 0]
        g_seg, g_out, g_move = np.zeros_like(self.seg), np.zeros_like(self.out), np.zeros_like(self.move)
        covered = {t for i, j, _ in gold for t in range(i, j)}
        for j in range(n):
            p = np.exp(a[j] + self.move[:, 0] + out[j] + b[j + 1, 0] - z)
            g_move[:, 0] -= p
            g_out -= p.sum() * outside[j]
            if j not in covered:
                g_out += outside[j]
        for s, (i, j, x) in enumerate(segs):
            p = np.exp(a[i][:, None] + self.move[:, 1:] + (seg[s] + b[j, 1:])[None, :] - z)
            g_move[:, 1:] -= p
            g_seg -= p.sum(0)[:, None] * x[None, :]
            for t in range(len(KINDS)):
                if (i, j, t) in gold:
                    g_seg[t] += x
        labels, at = [0], 0
        for i, j, t in sorted(gold):
            labels += [0] * (i - at) + [t + 1]
            at = j
        labels += [0] * (n - at)
        for p, q in zip(labels, labels[1:], strict=False):
            g_move[p, q] += 1
        return g_seg, g_out, g_move


def _sentences(seed: int, count: int):
    """Made-up sentences: (text, [(start, end, kind)])."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("th", "en", "er", "la", "que", "ich", "on", "st")) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def email():
        return r.choice((word(), num(2), word() + "." + word(), word() + num(2))) + "@" + word() + r.choice(("", num(1))) + "." + r.choice(("com", "org", "example.com", "co.uk"))

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        body = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice((body, " ".join(re.findall("..?.?.?", body)), "-".join(re.findall("..?.?.?", body))))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)}{a}{b}{c}"))

    def other():
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 16, 40))))
        bad = num(15)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return r.choice((hexes, f'token = "{hexes}"', f"{r.randint(1, 9)}.0", f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", f"1{num(1)}:3{num(1)}", f"{num(2)}.{num(2)}", bad, num(r.randint(1, 8)), "@" + word(), word() + "@" + word(), f"{num(1)}.{num(1)}.{num(2)}", "AKIA" + num(3) + "ABC" + num(4), f"{r.randint(300, 999)}.1.2.{num(3)}", f"v{num(1)}.{num(2)}", f"pages {num(3)}-{num(3)}", num(9), f"{num(4)} {num(4)} {num(2)}"))

    make = (email, ip, card, phone)
    for _ in range(count):
        text, gold = word() + " ", []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.55:
                k = r.randrange(4)
                s = make[k]()
                gold.append((len(text), len(text) + len(s), k))
                text += s
            else:
                text += other()
            text += r.choice((" ", " ", ". ", ", ", " " + word() + " "))
        yield text, gold


@functools.cache
def trained(seed: int = 11, count: int = 260, rounds: int = 7) -> SemiCrf:
    """The model, trained once in a process."""
    data = []
    for text, gold in _sentences(seed, count):
        for a, b in islands(text):
            tokens, segs, outside = lattice(text, a, b)
            first, last = {x: i for i, (x, _) in enumerate(tokens)}, {y: i + 1 for i, (_, y) in enumerate(tokens)}
            mine = {(first[x], last[y], k) for x, y, k in gold if x >= a and y <= b and x in first and y in last}
            if segs and mine <= {(i, j, k) for i, j, _ in segs for k in range(4)}:
                data.append((segs, outside, mine))
    m, r = SemiCrf(), random.Random(seed)
    sums = [np.full_like(w, 1e-2) for w in (m.seg, m.out, m.move)]
    for _ in range(rounds):
        r.shuffle(data)
        for segs, outside, gold in data:
            for w, s, g in zip((m.seg, m.out, m.move), sums, m.gradient(segs, outside, gold), strict=True):
                s += g * g
                w += 0.3 * g / np.sqrt(s) - 1e-4 * w
    return m


def _holds(kind: str, s: str) -> bool:
    """The exact test after the model."""
    n = len(_digits(s))
    return {"email": lambda: s.count("@") == 1 and bool(_DOMAIN.fullmatch(s.partition("@")[2])), "ip": lambda: _is_ip(s) if _DOTTED.fullmatch(s) else False, "card": lambda: _is_card(s), "phone": lambda: 9 <= n <= 15 and bool(_NUMERIC.fullmatch(s))}[kind]()


def scan(text: str | None, model: SemiCrf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans that the model adds)."""
    text = text or ""
    base, added = base_spans(text), []
    edges = _union((x, y) for _, x, y in base)
    starts = [x for x, _ in edges]
    for a, b in islands(text):
        if hopeless(text, a, b):
            continue
        land = Island(text, a, b)
        for i, j, k in model.best(land):
            x, y = int(land.start[i]), int(land.stop[j - 1])
            at = bisect.bisect_left(starts, y) - 1  # the last base stretch that begins before y
            if not (at >= 0 and edges[at][1] > x) and _holds(KINDS[k], text[x:y]):
                added.append((KINDS[k], x, y))
    return base, added


def _union(spans) -> list[tuple[int, int]]:
    """Overlapping spans put together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spelled(spans) -> str:
    """kind:start:end by kind, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base, the text found) for each row."""
    model = trained()

    def run(ids, texts):
        out = []
        for t in texts:
            base, added = scan(t, model)
            out.append([{"kind": k, "start": a, "end": b, "base": s is base, "found": (t or "")[a:b]} for s in (base, added) for k, a, b in s])
        return ids, out

    return map_rows(docs, ["doc_id", F.col("text").cast("string")], f"doc_id {id_type(docs)}, spans array<struct<kind:string,start:int,end:int,base:boolean,found:string>>", run)


def op1_semi_markov_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base kinds, and all spans."""
    model = trained()

    def run(ids, texts):
        cols: list[list] = [[] for _ in range(6)]
        for t in texts:
            base, added = scan(t, model)
            for c, k in zip(cols, KINDS, strict=False):
                c.append(sum(s[0] == k for s in base))
            cols[4].append(hashlib.sha256(spelled(base).encode()).hexdigest())
            cols[5].append(spelled(base + added))
        return [ids, *cols]

    docs = documents(spark, sf_dir)
    schema = f"doc_id {id_type(docs)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(docs, ["doc_id", F.col("text").cast("string")], schema, run)
