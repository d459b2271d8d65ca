"""Personal information in free text: a linear-chain conditional random field.

Tokens (runs of letters, runs of digits, single signs) are labelled with B/I tags of
five kinds. A token's features are its word, affixes, shape, lexicon entries, and the shape of the
number it is part of; they count at the token itself and, with weights of their own, at the
tokens around it. The model is trained on the driver from a small labelled table
(``TABLE_ROWS`` texts, a documented bound) by AdaGrad on the exact likelihood, and sent to
the workers: a fixed number of weights, whatever the data.

Decoding is Viterbi in numpy, over all lines of a batch of texts one token at a time: nothing reaches across a line
end. A text is labelled whole; there is no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.names import NICKNAMES
from strandline.llm.pii_table import BEGINNINGS, BOXES, CUES, GIVEN, PARTICLES, TITLES, WAYS_EN, WAYS_ES, WAYS_FR, WAYS_IT, WAYS_PL, table

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
L = len(LABELS)
#: Labelled texts that the model is fitted on, rounds over them, and hashed feature slots (a power of two).
TABLE_ROWS, EPOCHS, SLOTS = 8_000, 4, 1 << 17
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3)
#: Share of the tokens whose word is hidden while the model is trained, so that it learns to do without.
HIDDEN = 0.25
#: Token forms whose scores a worker remembers; beyond, it forgets all and starts anew.
MEMO = 200_000
#: Texts, and characters of them, that are decoded together; a longer text is decoded alone.
BATCH, BATCH_CHARS = 512, 1 << 20

_NUMBER = re.compile(r"[(+]{0,2}[A-Z]{0,6}\d[A-Z\d]*(?:(?:[ \-./]{1,2}|\) ?| ?\()(?:[A-Z]{0,4}\d[A-Z\d]*|[A-Z]{1,4})(?![a-z]))*")
_AT = r"(?:@|%40|\s@\s|\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![\w.+\-])(?:mailto:)?[\w+\-]+(?:\.[\w+\-]+)*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[a-z]{{2,}}(?![\w\-])", re.I)
_URL = re.compile(r"(?:\b[a-z]{2,6}:)?//\S+|\bwww\.\S+", re.I)
_SIGNOFF = re.compile(r"(?:^|\s)-- ?\S[^\n]*$", re.M)
_GIVEN = {*(x.lower() for x in GIVEN), *NICKNAMES}
_TITLE = {x.lower().rstrip(".") for x in TITLES}
_PARTICLE = {w for x in PARTICLES for w in x.split()}
_STREET = {x.lower().rstrip(".") for x in (*WAYS_EN, *WAYS_ES, *WAYS_FR, *WAYS_IT, *WAYS_PL)}
_BOX = {w.lower() for x in BOXES for w in re.findall(r"\w+", x) if len(w) > 1}
_BEGIN = {x.split()[0].lower() for x in BEGINNINGS}
_CUE = {w.lower(): k for k in ("telcue", "idcue", "mailcue") for x in CUES[k] for w in re.findall(r"[^\W\d_]+", x) if len(w) > 2 and w not in ("number", "card", "write", "contact", "national")}
_WAY = re.compile(r"(?:stra(?:ß|ss)e|str|weg|gasse|allee|platz|straat|laan|gracht|kade|plein)$")
_BITS = {"email": 1, "url": 2, "signoff": 4, "space": 8}
#: Marks of stretches: (name, pattern, what a text must have for it); numbers have no name.
_MARKS = (
    ("email", _EMAIL, re.compile(r"@|%40|[(\[{]\s?at\s?[)\]}]|\sat\s\S+\sdot\s", re.I)),
    ("url", _URL, re.compile(r"//|www", re.I)), ("signoff", _SIGNOFF, re.compile("--")), ("", _NUMBER, re.compile(r"\d\W?\d")),
)
_AS_SHAPE = {**{ord(c): "9" for c in "0123456789"}, **{c: "A" for c in range(65, 91)}}
_DIGITS = ["9" * n for n in range(13)]
#: What stands between texts: as many characters as features reach, each a token without features.
_GAP = ("", 0, "", False)
GAP = max(map(abs, OFFSETS))
_BETWEEN = "\x00" * (GAP - 1) + "\n"


def _shape(word: str) -> str:
    if word.isdigit():
        return f"9{min(len(word), 12)}"
    if len(word) == 1:
        return "X" if word.isupper() else "x" if word.isalpha() else word
    return "XX" if word.isupper() else "Xx" if word[0].isupper() and word[1:].islower() else "x" if word.islower() else "xX"


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of each stretch of true values, the longest first."""
    step = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    opens, closes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    order = np.argsort(opens - closes, kind="stable")
    return opens[order], (closes - opens)[order]


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, begin + length), one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begins - (total - lengths), lengths)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 a letter, 2 a digit, 3 any other sign, 4 a line end."""
    out = np.full(0x110000, 3, np.uint8)
    out[0x20000:0x32000] = 1  # the planes of CJK ideographs
    for c in range(0x20000):
        x = chr(c)
        out[c] = 2 if x.isdecimal() else 1 if x.isalnum() else 0 if x.isspace() else 3
    out[10] = 4
    return out


class Parsed:
    """The tokens of several texts: runs of letters, runs of digits, single signs and line ends, with gaps around each text.

    forms: the different token forms, all that a token's features depend on; ids: the form of each token;
    begins, ends: in ``joined``; places: (first token, one after the last, where the text begins in joined) of each text.
    """

    def __init__(self, texts: list[str]):
        self.joined = _BETWEEN + "".join(x + _BETWEEN for x in texts)
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum([len(_BETWEEN), *(lengths + len(_BETWEEN))])
        kind = _kinds()[points]
        gap = np.zeros(len(kind), bool)
        gap[(starts[:, None] - np.arange(1, GAP + 1)).ravel()] = True
        breaks = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] > 2) | gap[1:] | gap[:-1]])
        at = np.flatnonzero(breaks)
        until = np.append(at[1:], len(kind))
        some = kind[at] > 0
        begins, ends = at[some], until[some]
        kind = kind[begins]
        n = len(begins)
        flags = np.where(np.concatenate([[True], begins[1:] != ends[:-1]]), _BITS["space"], 0)
        shape_of, first = np.zeros(n, np.int64), np.zeros(n, bool)
        shapes = {"": 0}
        for name, pattern, hint in _MARKS:
            spans, found = [], []
            for text, begin in zip(texts, starts.tolist()):
                if hint.search(text):
                    for m in pattern.finditer(text):
                        a, b = m.span()
                        if name or b - a > 4:
                            spans.append((a + begin, b + begin))
                            found.append(m[0])
            if not spans:
                continue
            a, b = np.array(spans).T
            i, j = np.searchsorted(begins, a), np.searchsorted(begins, b)
            inside = _ranges(i, j - i)
            if name:
                flags[inside] |= _BITS[name]
                continue
            # A number begins a token, or lies inside one and has none. A leading zero is part of its shape.
            numbers = []
            for x in found:
                shape = x.translate(_AS_SHAPE)[:28]
                numbers.append(shapes.setdefault(shape.replace("9", "o", 1) if x.lstrip("(+")[:1] == "0" else shape, len(shapes)))
            shape_of[inside] = np.repeat(numbers, j - i)
            some = j > i
            first[i[some]] = begins[i[some]] == a[some]
        # Of a run of digits only the length counts, so numbers share their forms.
        lower, upper = begins.tolist(), ends.tolist()
        words = [joined[a:b] for joined in (self.joined,) for a, b in zip(lower, upper)]
        for t in np.flatnonzero(kind == 2).tolist():
            words[t] = _DIGITS[min(upper[t] - lower[t], 12)]
        known = dict(zip(dict.fromkeys(words), count()))
        word_of = np.fromiter(map(known.__getitem__, words), np.int64, n)
        key = ((word_of * len(shapes) + shape_of) * 2 + first) * 16 + flags
        key[gap[begins]] = -1
        _, where, self.ids = np.unique(key, return_index=True, return_inverse=True)
        names = list(shapes)
        self.forms = [_GAP if k < 0 else (words[t], f, names[x], y) for k, t, f, x, y in zip(key[where].tolist(), where.tolist(), flags[where].tolist(), shape_of[where].tolist(), first[where].tolist())]
        self.begins, self.ends = begins, ends
        lo, hi = np.searchsorted(begins, starts[:-1]), np.searchsorted(begins, starts[:-1] + lengths)
        self.places = list(zip(lo.tolist(), hi.tolist(), starts.tolist()))
        # Lines, the longest first: nothing reaches across a line end.
        self.lines = _stretches(~(gap[begins] | (kind == 4)))


def features(form: tuple) -> tuple[list[str], list[str]]:
    """(those that count at the token and beside it, those that count further off)."""
    word, flags, shape, first = form
    if not word:
        return [], []
    low = word.lower()
    kind = _shape(word)
    near, far = ["1", f"f{flags}", f"e{flags & 1}{kind[0]}", f"g{flags & 4}"], ["s" + kind]
    if not word.isdigit() and word != "\0":
        far.append("w" + low)
    if len(word) > 2 and word.isalpha():
        near += ["p" + low[:3], "q" + low[-3:], "r" + low[-2:]]
        if _WAY.search(low):
            far.append("way")
    if word[0].isupper() and low in _GIVEN:
        far.append("given")
    if word[0].isupper() and low in _TITLE:
        far.append("title")
    if low in _PARTICLE:
        far.append("particle")
    if low in _STREET:
        far.append("street" + kind)
    if low in _BOX and word[0].isupper():
        far.append("box")
    if low in _BEGIN:
        far.append("begin" + kind)
    if low in _CUE:
        far.append("cue" + _CUE[low])
    if shape:
        digits = min(shape.count("9") + shape.count("o"), 17)
        far.append("n" + shape)
        near += [f"n1{shape}{first}", f"m{digits}{first}", f"h{shape[:3]}{digits}", f"k{''.join(dict.fromkeys(shape))}{digits}"]
    return near + far, far


def hidden(form: tuple) -> tuple:
    """A form without its word: of letters only the shape is left."""
    word, *rest = form
    return (word if not word.isalpha() or len(word) == 1 else "Zq" if word[0].isupper() and not word.isupper() else "ZQ" if word.isupper() else "zq", *rest)


_SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint64)


def hashed(forms: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(number of features of each form, hashes of them all) of the near features, and of the far ones."""
    out = []
    each = [features(f) for f in forms]
    for side in (0, 1):
        names = [x[side] for x in each]
        flat = np.fromiter((zlib.crc32(n.encode()) for x in names for n in x), np.uint64)
        out.append((np.fromiter(map(len, names), np.int64, len(names)), flat))
    return out


def slots(hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    """Where the weights of hashed features stand for the k-th offset."""
    return ((((hashes + np.uint64(k)) * _SPREAD[k]) & np.uint64(0xFFFFFFFF)) >> np.uint64(33 - size.bit_length())).astype(np.int64)


class Field:
    """The weights: of hashed features by offset and label, and of label pairs."""

    def __init__(self, slots: int = SLOTS):
        self.w = np.zeros((slots, L), np.float32)
        self.t = np.zeros((L, L), np.float32)
        self.start = np.zeros(L, np.float32)
        self.ids: dict[tuple, int] = {}
        self.scores = np.zeros((0, len(OFFSETS), L), np.float32)
        # A kind's inside follows only its begin or inside.
        self.allowed = np.zeros((L, L), np.float32)
        for j, label in enumerate(LABELS):
            if label[0] == "I":
                for i, before in enumerate(LABELS):
                    if before[2:] != label[2:]:
                        self.allowed[i, j] = -1e4
        self.first = np.array([-1e4 if x[0] == "I" else 0 for x in LABELS], np.float32)

    def scored(self, forms: list[tuple]) -> np.ndarray:
        """(len(forms), offsets, L): what each form says about the tokens around it."""
        out = np.zeros((len(forms), len(OFFSETS), L), np.float32)
        near, far = hashed(forms)
        for k, o in enumerate(OFFSETS):
            many, flat = near if abs(o) < 2 else far
            some = np.flatnonzero(many)
            if len(some):
                heads = (np.cumsum(many) - many)[some]
                out[some, k] = np.add.reduceat(self.w[slots(flat, k, len(self.w))], heads)
        return out

    def emissions(self, parsed: Parsed) -> np.ndarray:
        """(tokens, L) of parsed texts."""
        if len(self.ids) > MEMO:
            self.ids, self.scores = {}, np.zeros((0, len(OFFSETS), L), np.float32)
        new = [f for f in parsed.forms if f not in self.ids]
        if new:
            have = len(self.ids)
            if have + len(new) > len(self.scores):
                grown = np.zeros((2 * (have + len(new)) + 1024, len(OFFSETS), L), np.float32)
                grown[:have] = self.scores[:have]
                self.scores = grown
            self.scores[have : have + len(new)] = self.scored(new)
            self.ids.update(zip(new, count(have)))
        ids = np.fromiter(map(self.ids.__getitem__, parsed.forms), np.int64, len(parsed.forms))[parsed.ids]
        out = np.zeros((len(ids), L), np.float32)
        for k, o in enumerate(OFFSETS):
            # The token at i + o speaks for the token at i.
            if o >= 0:
                out[: len(ids) - o] += self.scores[ids[o:], k]
            else:
                out[-o:] += self.scores[ids[:o], k]
        return out

    def decode(self, emit: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of each token, all lines (the longest first) one token at a time; O outside of lines."""
        path = np.zeros(len(emit), np.int64)
        if not len(begins):
            return path
        trans = self.t + self.allowed
        back = np.zeros((len(emit), L), np.int8)
        score = emit[begins] + self.start + self.first
        live_at = [int(x) for x in np.searchsorted(-lengths, -np.arange(int(lengths[0])))]
        into = np.ascontiguousarray(trans.T)
        for t in range(1, int(lengths[0])):
            live = live_at[t]
            rows = begins[:live] + t
            moved = score[:live, None, :] + into
            best = moved.argmax(2)
            back[rows] = best
            score[:live] = np.take_along_axis(moved, best[:, :, None], 2)[:, :, 0] + emit[rows]
        state = score.argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = live_at[t] if t else len(begins)
            rows = begins[:live] + t
            path[rows] = state[:live]
            if t:
                state[:live] = back[rows, state[:live]]
        return path


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


@lru_cache(maxsize=2)
def trained(rows: int = TABLE_ROWS, epochs: int = EPOCHS, seed: int = 7) -> Field:
    """The field fitted to the labelled table by AdaGrad; deterministic."""
    field, rng = Field(), np.random.default_rng(seed)
    examples = table(rows, seed)
    parsed = Parsed([text for text, _ in examples])
    gold_of = np.zeros(len(parsed.ids), np.int64)
    for (_, spans), (lo, hi, begin) in zip(examples, parsed.places):
        for a, b, kind in spans:
            i, j = lo + np.searchsorted(parsed.begins[lo:hi], a + begin), lo + np.searchsorted(parsed.ends[lo:hi], b + begin, "right")
            gold_of[i:j] = LABELS.index("I-" + kind)
            gold_of[i] = LABELS.index("B-" + kind)
    forms = parsed.forms + [hidden(f) if f[0] else f for f in parsed.forms]
    ids_of = parsed.ids + len(parsed.forms) * (rng.random(len(parsed.ids)) < HIDDEN)
    sides = hashed(forms)
    heads_of = [np.cumsum(many) - many for many, _ in sides]
    gw, gt, gs = np.full(field.w.shape, 1e-2, np.float32), np.full((L, L), 1e-2, np.float32), np.full(L, 1e-2, np.float32)
    size = 48
    # The weights are the mean over the last rounds: single steps leave less behind.
    mean_w, mean_t, mean_s, steps = np.zeros_like(field.w), np.zeros_like(field.t), np.zeros_like(field.start), 0
    for epoch in range(epochs):
        rate = 0.4 / (1 + epoch / 2)
        order = rng.permutation(len(examples))
        for begin in range(0, len(order), size):
            chosen = order[begin : begin + size].tolist()
            # Each text with the gap behind it, after one gap.
            chosen = np.concatenate([np.arange(GAP), *(np.arange(parsed.places[i][0], parsed.places[i][1] + GAP) for i in chosen)])
            ids, gold = ids_of[chosen], gold_of[chosen]
            stop = np.fromiter((forms[i][0] in ("", "\n") for i in ids), bool, len(ids))
            opens, lengths = _stretches(~stop)
            n = len(ids)
            where, slot = [], []
            for k, o in enumerate(OFFSETS):
                side = 0 if abs(o) < 2 else 1
                many, flat = sides[side]
                at = np.arange(max(0, -o), min(n, n - o))
                widths = many[ids[at + o]]
                where.append(np.repeat(at, widths))
                slot.append(slots(flat[_ranges(heads_of[side][ids[at + o]], widths)], k, len(field.w)))
            where, slot = np.concatenate(where), np.concatenate(slot)
            by_place = np.argsort(where, kind="stable")
            where, slot = where[by_place], slot[by_place]
            heads = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            emit = np.zeros((n, L))
            emit[where[heads]] = np.add.reduceat(field.w[slot], heads)
            longest = int(lengths[0])
            live = np.searchsorted(-lengths, -np.arange(longest))
            trans = (field.t + field.allowed).astype(float)
            alpha, beta = np.zeros((n, L)), np.zeros((n, L))
            alpha[opens] = emit[opens] + field.start + field.first
            for t in range(1, longest):
                now = opens[: live[t]] + t
                alpha[now] = _log_sum(alpha[now - 1][:, :, None] + trans, 1) + emit[now]
            for t in range(longest - 2, -1, -1):
                now = opens[: live[t + 1]] + t
                beta[now] = _log_sum(trans + (emit[now + 1] + beta[now + 1])[:, None, :], 2)
            z_of = _log_sum(alpha[opens + lengths - 1], 1)
            inside = _ranges(opens, lengths)
            z = np.zeros(n)
            z[inside] = np.repeat(z_of, lengths)
            grad = np.zeros((n, L))
            grad[inside] = -np.exp(np.minimum(alpha[inside] + beta[inside] - z[inside, None], 0.0))
            first = grad[opens].sum(0)
            np.add.at(first, gold[opens], 1)
            grad[inside, gold[inside]] += 1
            later = np.setdiff1d(inside, opens)
            x = alpha[later - 1][:, :, None] + trans + (emit[later] + beta[later])[:, None, :] - z[later][:, None, None]
            pairs = -np.exp(np.minimum(x, 0.0)).sum(0)
            np.add.at(pairs, (gold[later - 1], gold[later]), 1)
            by_slot = np.argsort(slot, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], np.diff(slot[by_slot]) != 0]))
            used = slot[by_slot][heads]
            step = np.add.reduceat(grad.astype(np.float32)[where[by_slot]], heads)
            step -= 2e-4 * field.w[used]
            gw[used] += step * step
            field.w[used] += rate * step / np.sqrt(gw[used])
            gt += (pairs * pairs).astype(np.float32)
            field.t += (rate * pairs / np.sqrt(gt)).astype(np.float32)
            gs += (first * first).astype(np.float32)
            field.start += (rate * first / np.sqrt(gs)).astype(np.float32)
            if epoch >= epochs - 3:
                mean_w, mean_t, mean_s, steps = mean_w + field.w, mean_t + field.t, mean_s + field.start, steps + 1
    if steps:
        field.w, field.t, field.start = mean_w / steps, mean_t / steps, mean_s / steps
    return field


#: Signs that names and addresses are written with, also in links.
_WRITTEN = re.compile(r"[^\W_]+(?:(?:[ .,:'’/+_º\-]|%20){1,3}[^\W_]+)*\.?")
_ABBREVIATED = re.compile(r"(?i)\b(?:st|rd|ave|blvd|jr|sr|[a-z])\.\Z")
#: What stands before a name, if not white space.
_BEFORE = set("([{<\"'“‘«„>*_~|/:;,.-–—=!?&")


#: A blank, a plus and other signs as links write them.
_ESCAPED = ("%20", "%2B", "%2b", "%3D", "%3A", "%26")


def plausible(kind: str, text: str) -> bool:
    """An exact check of what the field found: no kind without what makes it one."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(re.search(r"@|%40|\bat\b", text, re.I)) and len(text) > 5
    if kind == "phone":
        return 7 <= digits <= 16 and not re.search(r"/\d{1,2}$", text)
    if kind == "id_number":
        return (digits >= 6 or (digits >= 2 and sum(c.isupper() for c in text) + digits >= 8)) and bool(_WRITTEN.fullmatch(text))
    if not _WRITTEN.fullmatch(text):
        return False
    if kind == "address":
        return digits >= 1 and any(c.isupper() for c in text)
    words = re.findall(r"[^\W\d_]+", text.replace("%20", " "))
    return sum(w not in _PARTICLE for w in words) >= 2 and (words[0][0].isupper() or words[0] in _PARTICLE) and words[-1][0].isupper() and len(words[-1]) > 1 and not sum(c.isdigit() for c in text.replace("%20", " "))


def spans_of(text: str, begins: np.ndarray, ends: np.ndarray, path: np.ndarray) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each labelled stretch that is plausible."""
    out, i, n = [], 0, len(path)
    labelled = np.flatnonzero(path)
    if not len(labelled):
        return out
    handles = [m.span() for m in _SIGNOFF.finditer(text)]
    while i < n:
        if path[i] == 0:
            i += 1
            continue
        kind, j = LABELS[path[i]][2:], i
        while j + 1 < n and path[j + 1] and LABELS[path[j + 1]] == "I-" + kind:
            j += 1
        a, b = int(begins[i]), int(ends[j])
        # The stop of a sentence isn't part of what ends it, but for an abbreviation.
        if text[b - 1] == "." and not _ABBREVIATED.search(text, a, b):
            b -= 1
        # A handle in a sign-off is no name, nor is the rest of a word.
        other = (a and text[a - 1].isalnum() and text[a - 3 : a] not in _ESCAPED) or (
            kind == "name" and (any(x <= a and b <= y for x, y in handles) or (a and not text[a - 1].isspace() and text[a - 1] not in _BEFORE and text[a - 3 : a] not in _ESCAPED)))
        if plausible(kind, text[a:b]) and not other:
            out.append((a, b, kind))
        i = j + 1
    return out


def find_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """The personal information in each text, by Viterbi in batches."""
    out, begin = [], 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and end - begin < BATCH and size + len(texts[end]) <= BATCH_CHARS:
            size += len(texts[end])
            end += 1
        chunk, begin = texts[begin:end], end
        parsed = Parsed(chunk)
        path = field.decode(field.emissions(parsed), *parsed.lines)
        for text, (lo, hi, at) in zip(chunk, parsed.places):
            own = path[lo:hi]
            out.append(spans_of(text, parsed.begins[lo:hi] - at, parsed.ends[lo:hi] - at, own) if own.any() else [])
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder of its kind for each span."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(df: DataFrame, *, key: str, text: str, rows: int = TABLE_ROWS) -> DataFrame:
    """(key, redacted, found) of each row whose text holds personal information.

    found: array of (kind, begin, end), spans of the original text in order, not
    overlapping; redacted: the text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME] in
    their place and all else unchanged. Rows without any, null and empty texts give no row;
    repeated rows are each returned; other columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    model = trained(rows)
    # A worker process keeps the field, and with it what it remembers of token forms, from task to task.
    model.ids, model.scores = {}, model.scores[:0]
    sent = df.sparkSession.sparkContext.broadcast(model)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for part in parts:
            values = part.column(1).to_pylist()
            taken, texts, spans = [], [], []
            for row, found in enumerate(find_spans(values, field)):
                if found:
                    taken.append(row)
                    texts.append(redacted(values[row], found))
                    spans.append([{"kind": k, "begin": a, "end": b} for a, b, k in found])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(taken, pa.int64())), pa.array(texts, pa.string()), pa.array(spans, found_type)], names=["key", "redacted", "found"]
            )

    source = df.where(F.octet_length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(batches, f"key {kind}, redacted string, found array<struct<kind string, begin int, end int>>").withColumnRenamed("key", key)
