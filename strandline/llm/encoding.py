"""Text garbled by a wrong decoding: found and restored by a hidden Markov model.

The model has one clean state and one state for each encoding pair (bytes of one encoding
read in another), and one for replacement characters. It labels the characters outside ASCII: the
clean state emits a character by how well its class stands beside its neighbours; a
pair's state emits the characters of a unit that the pair's inverse turns into one
character, by how well that one would stand there. Viterbi decoding gives the labels; each
labelled span gets its state's inverse transform, and what it gives is decoded again, for
text that was garbled more than once.

All texts of a batch are worked on at once in numpy, over the characters outside ASCII only. What
each character could gain under its best state is summed up along each text: where no stretch
around a character gains what entering a state costs, the character is clean on every best path. Viterbi
runs over the other stretches, all stretches one step at a time. Texts that changed are looked at again, until none
changes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (bytes of, read as). Of these pairs each is one state.
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"),
    ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "koi8-r"), ("utf-8", "gbk"), ("utf-8", "big5"), ("utf-8", "shift_jis"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1250", "cp1252"),
)
CLEAN, LOST = "clean", "lost"
#: Log-probabilities: of leaving the clean state, of entering it, and of a character that a pair can't have made.
ENTER, LEAVE, IMPOSSIBLE = -6.0, -2.0, -30.0
#: A unit of several characters is rarely well-formed by chance, so however its character stands, it gets at least this.
UNIT = -5.0
#: Two replacement characters in UTF-8, read as GBK.
GBK_LOST = "锟斤拷"
#: Characters of the texts that are worked on at once; a longer text is worked on alone.
BATCH_CHARS = 1 << 18

(OTHER, LOWER, UPPER, DIGIT, BLANK, PUNCT, LAT_LOW, LAT_UP, QUOTE, SYMBOL, CYR, GREEK, CJK, C1, REPL, BOX, RARE, INVISIBLE, LOW_QUOTE) = range(19)


def _class(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)
    if c < 128:
        return LOWER if ch.islower() else UPPER if ch.isupper() else DIGIT if ch.isdigit() else BLANK if ch.isspace() or c < 32 or c == 127 else PUNCT
    if c < 0xA0:
        return C1
    if c == 0xFFFD:
        return REPL
    if c in (0xA0, 0x2009, 0x202F, 0x3000):
        return BLANK if c == 0x3000 else INVISIBLE
    if ch in "‚„‹›":
        return LOW_QUOTE
    if kind in ("Pi", "Pf", "Pd") or ch == "…":
        return QUOTE
    if 0x2500 <= c < 0x25A0:
        return BOX
    if kind[0] == "L" and ch not in "ªºˆˇ":
        name = unicodedata.name(ch, "")
        if name.startswith("LATIN"):
            if 0x180 <= c < 0x1E00 or c in (0xD0, 0xDE, 0xF0, 0xFE, 0x131, 0x149) or 0xFB00 <= c < 0xFB07:
                return RARE
            return LAT_UP if ch.isupper() else LAT_LOW
        if name.startswith("CYRILLIC"):
            return CYR
        if name.startswith("GREEK"):
            return GREEK
        return CJK if c >= 0x2E80 else OTHER
    if kind in ("Cf", "Zs", "Zl", "Zp"):
        return INVISIBLE
    return SYMBOL


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point of the basic plane; others are OTHER."""
    return np.array([OTHER if 0xD800 <= c < 0xF900 else CJK if 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 else _class(c) for c in range(0x10000)], np.uint8)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Words of one letter, and apostrophes: the only characters that count for more than their class.
_SINGLE, _APOSTROPHE = "àÀóÓèÈéÉêôÔúÚöÖåÅæøØÎ", "\u2019\u2018"


@lru_cache(maxsize=1)
def _stands() -> np.ndarray:
    """Log-probability under the clean state by class, classes of both neighbours, and 1 for a word of one letter, 2 for an apostrophe; 0 for ASCII."""
    k, left, right, special = np.meshgrid(range(19), range(19), range(19), range(3), indexing="ij")
    is_in = lambda x, *ks: np.isin(x, ks)
    latin_l, latin_r = is_in(left, LOWER, UPPER, LAT_LOW, LAT_UP), is_in(right, LOWER, UPPER, LAT_LOW, LAT_UP)
    odd_l, odd_r = is_in(left, SYMBOL, C1, REPL, BOX, RARE, LOW_QUOTE), is_in(right, SYMBOL, C1, REPL, BOX, RARE, LOW_QUOTE)
    alone = ~latin_l & ~latin_r
    out = np.zeros(k.shape)
    single, apostrophe = special == 1, special == 2
    out = np.where(k == LAT_LOW, np.where(alone & ~single, -8.0, -3.0) - 5.0 * (odd_l | odd_r), out)
    out = np.where(k == LAT_UP, np.where(is_in(left, LOWER, LAT_LOW), -11.0, np.where(odd_r | is_in(right, QUOTE, INVISIBLE), -9.0, np.where(alone & ~single, -7.0, -4.0))), out)
    out = np.where(k == QUOTE, np.where(latin_l & latin_r & ~apostrophe, -6.0, -3.0) - 5.0 * is_in(left, SYMBOL, C1, LOW_QUOTE), out)
    out = np.where(k == LOW_QUOTE, np.where(latin_l, -9.0, -5.0), out)
    out = np.where(k == SYMBOL, np.where(latin_l & latin_r, -10.0, np.where(latin_l, -7.0, -5.0)), out)
    for script in (CYR, GREEK):
        mixed = latin_l | latin_r | odd_l | odd_r
        out = np.where(k == script, np.where(mixed, -10.0, np.where((left == script) | (right == script), -3.0, -6.0)), out)
    out = np.where(k == CJK, np.where(latin_l | latin_r, -9.0, np.where((left == CJK) | (right == CJK), -4.0, -8.0)), out)
    out = np.where(k == BOX, np.where(latin_l | latin_r, -10.0, -4.0), out)
    out = np.where(k == RARE, np.where(latin_l & latin_r, -7.0, -9.0), out)
    out = np.where(k == INVISIBLE, -5.0 - 4.0 * (left == LAT_UP), out)
    out = np.where(k == OTHER, -6.0, out)
    out = np.where(k == C1, -16.0, out)
    return np.where(k == REPL, -40.0, out)


@lru_cache(maxsize=1)
def _specials() -> np.ndarray:
    out = np.zeros(0x10000, np.uint8)
    out[[ord(c) for c in _SINGLE]], out[[ord(c) for c in _APOSTROPHE]] = 1, 2
    return out


def _known(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, special) of each code point."""
    low = np.minimum(points, 0xFFFF)
    return np.where(points < 0x10000, classes()[low], OTHER), _specials()[low]


def standing(points: np.ndarray) -> np.ndarray:
    """Log-probability of each character of a text under the clean state, from its class and its neighbours'; 0 for ASCII."""
    k, special = _known(points)
    return _stands()[k, np.concatenate([[BLANK], k[:-1]]), np.concatenate([k[1:], [BLANK]]), special]


class Pair:
    """A pair's inverse: units (begin, end, text) of a string that it turns into one character."""

    def __init__(self, made_of: str, read_as: str):
        self.name, self.made_of, self.read_as = f"{made_of} as {read_as}", made_of, read_as
        self.wide = read_as in ("gbk", "big5", "shift_jis")
        self.byte_of: dict[str, int] = {}
        if not self.wide:
            for b in range(0x80, 0x100):
                try:
                    self.byte_of[bytes([b]).decode(read_as)] = b
                except UnicodeDecodeError:
                    self.byte_of[chr(b)] = b  # lenient readers pass such a byte through
        self.char_of: dict[int, str] = {}
        if made_of != "utf-8":
            for b in range(0x80, 0x100):
                try:
                    self.char_of[b] = bytes([b]).decode(made_of)
                except UnicodeDecodeError:
                    pass
        # By code point: the byte it was read from; the character that one means; for wide ones, whether a unit can begin with it.
        self.bytes_at, self.chars_at, self.begins_at = np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint16), np.zeros(0x10000, bool)
        for c, b in self.byte_of.items():
            self.bytes_at[ord(c)] = b
            if b in self.char_of and self.char_of[b] != c:
                self.chars_at[ord(c)] = ord(self.char_of[b])
        if self.wide:
            for c in range(0x80, 0x10000):
                raw = chr(c).encode(read_as, "ignore")
                self.begins_at[c] = len(raw) > 0 and 0xC2 <= raw[0] < 0xF5 and (len(raw) < 2 or 0x80 <= raw[1] < 0xC0)

    def all_units(self, points: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, code point): the units of a pair that isn't wide, over characters outside ASCII; follows[i]: i + 1 stands right behind i."""
        low = np.minimum(points, 0xFFFF)
        if self.made_of != "utf-8":
            made = self.chars_at[low]
            first = np.flatnonzero(made)
            return first, np.ones(len(first), np.int64), made[first].astype(np.uint32)
        b = np.where(points < 0x10000, self.bytes_at[low], 0).astype(np.uint32)
        padded = np.concatenate([b, np.zeros(3, np.uint32)])
        tail = (padded & 0xC0) == 0x80
        near = np.concatenate([follows, np.zeros(4, bool)])
        n = len(b)
        two = near[:n] & tail[1 : n + 1]
        three = two & near[1 : n + 1] & tail[2 : n + 2]
        four = three & near[2 : n + 2] & tail[3 : n + 3]
        b1, b2, b3 = padded[1 : n + 1], padded[2 : n + 2], padded[3 : n + 3]
        is_two = two & (b >= 0xC2) & (b < 0xE0)
        is_three = three & (b >= 0xE0) & (b < 0xF0) & ((b != 0xE0) | (b1 >= 0xA0)) & ((b != 0xED) | (b1 < 0xA0))
        is_four = four & (b >= 0xF0) & (b < 0xF5) & ((b != 0xF0) | (b1 >= 0x90)) & ((b != 0xF4) | (b1 < 0x90))
        size = is_two * 2 + is_three * 3 + is_four * 4
        first = np.flatnonzero(size)
        size, b, b1, b2, b3 = size[first], b[first], b1[first] & 0x3F, b2[first] & 0x3F, b3[first] & 0x3F
        point = np.where(size == 2, (b & 0x1F) << 6 | b1, np.where(size == 3, (b & 0x0F) << 12 | b1 << 6 | b2, (b & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        return first, size, point

    def units(self, text: str, places: list[int]) -> list[tuple[int, int, str]]:
        """places: where the characters outside ASCII are."""
        if self.wide:
            return self._wide_units(text, places)
        if self.made_of != "utf-8":
            return [(i, i + 1, c) for i in places if (c := self.char_of.get(self.byte_of.get(text[i], 0))) is not None and c != text[i]]
        out, end, known, n = [], 0, self.byte_of.get, len(text)
        for i in places:
            if i < end:
                continue
            lead = known(text[i], 0)
            size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            if not size or i + size > n:
                continue
            raw = bytes([lead, *(known(text[j], 0) for j in range(i + 1, i + size))])
            try:
                decoded = raw.decode()
            except UnicodeDecodeError:
                continue
            end = i + size
            out.append((i, end, decoded))
        return out

    def _wide_units(self, text: str, places: list[int]) -> list[tuple[int, int, str]]:
        """Wide characters may hold parts of two characters, or an ASCII one; so units are whole runs."""
        out, k = [], 0
        while k < len(places):
            begin = places[k]
            while k + 1 < len(places) and places[k + 1] == places[k] + 1:
                k += 1
            end = places[k] + 1
            k += 1
            run = text[begin:end]
            core = run.rstrip("�")
            try:
                raw = core.encode(self.read_as)
            except UnicodeEncodeError:
                continue
            decoded = raw.decode("utf-8", "replace")
            whole = decoded.rstrip("�")
            if not whole or "�" in whole or whole.isascii() or (len(whole) < len(decoded) and len(core) == len(run)):
                continue
            out.append((begin, begin + len(core), whole))
        return out

    def apply(self, text: str, places: list[int], lo: int, hi: int) -> str:
        """text[lo:hi] with its units turned back."""
        out, at = [], lo
        for begin, end, decoded in self.units(text, places):
            if lo <= begin and end <= hi:
                out += [text[at:begin], decoded]
                at = end
        return "".join(out) + text[at:hi]


@lru_cache(maxsize=1)
def pairs() -> list[Pair]:
    return [Pair(*p) for p in PAIRS]


class Places:
    """The characters outside ASCII of several texts, with their neighbours, and what each state makes of them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        # Line ends between texts keep neighbours apart.
        self.joined = "\n".join(texts) + "\n"
        every = _points(self.joined)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.at = np.flatnonzero(every > 127)
        self.text = np.searchsorted(begins, self.at, "right") - 1
        self.inside = self.at - begins[self.text]
        self.points = every[self.at]
        self.follows = np.append(self.at[1:] == self.at[:-1] + 1, False)[: len(self.at)]
        self.last = np.append(self.text[1:] != self.text[:-1], True)[: len(self.at)]
        k, special = _known(every)
        # The joined text ends with a line end, so an index of -1 is one as well.
        self.k, self.left, self.right = k[self.at], k[self.at - 1], k[np.minimum(self.at + 1, len(every) - 1)]
        self.clean = _stands()[self.k, self.left, self.right, special[self.at]]
        self.states: list[tuple[int, np.ndarray, np.ndarray]] = []
        lost = np.where(self.points == 0xFFFD, -1.0, self.clean - 1.0)
        if GBK_LOST in self.joined:
            for m in re.finditer(GBK_LOST, self.joined):
                lost[np.searchsorted(self.at, m.start()) : np.searchsorted(self.at, m.end())] = -1.0
        self.lost = lost
        for s, pair in enumerate(pairs(), 2):
            if pair.wide:
                self.wide(s, pair)
            else:
                first, size, point = pair.all_units(self.points, self.follows)
                if len(first):
                    self.narrow(s, first, size, point)

    def narrow(self, s: int, first: np.ndarray, size: np.ndarray, point: np.ndarray) -> None:
        k, special = _known(point)
        begins, ends = self.k.copy(), self.k.copy()
        begins[first], ends[first + size - 1] = k, k
        last = first + size - 1
        left = np.where((first > 0) & self.follows[first - 1], ends[first - 1], self.left[first])
        right = np.where(self.follows[last], begins[np.minimum(last + 1, len(begins) - 1)], self.right[last])
        stands = _stands()[k, left, right, special]
        # Its characters share the unit's probability, so that none is left out for being dear alone.
        share = np.where(size > 1, np.maximum(stands, UNIT), np.maximum(stands, IMPOSSIBLE)) / size
        many = np.repeat(np.arange(len(first)), size)
        places = first[many] + (np.arange(len(many)) - np.repeat(np.cumsum(size) - size, size))
        self.states.append((s, places, share[many]))

    def wide(self, s: int, pair: Pair) -> None:
        """Units of a wide pair are whole runs; few begin as one must."""
        starts = np.flatnonzero(~np.concatenate([[False], self.follows[:-1]])) if len(self.at) else self.at
        low = self.points[starts]
        starts = starts[(low < 0x10000) & pair.begins_at[np.minimum(low, 0xFFFF)]]
        ends = np.flatnonzero(~self.follows)
        for i, j in zip(starts.tolist(), ends[np.searchsorted(ends, starts)].tolist()):
            text, begin = self.texts[self.text[i]], int(self.inside[i])
            for a, b, decoded in pair.units(text, list(range(begin, begin + j - i + 1))):
                around = text[:a][-1:] + decoded + text[b : b + 1]
                stands = standing(_points(around))[len(text[:a][-1:]) :][: len(decoded)]
                share = max(float(stands.sum()), UNIT if b - a > 1 else IMPOSSIBLE) / (b - a)
                self.states.append((s, np.arange(i + a - begin, i + b - begin), np.full(b - a, share)))

    def torn(self) -> np.ndarray:
        """Whether a place can be in another state than clean on a best path: a stretch around it gains what entering one costs."""
        best = self.lost.copy()
        for _, places, share in self.states:
            best[places] = np.maximum(best[places], share)
        gain = best - self.clean
        # The most that a stretch ending, and one beginning, at each place can gain; a drop between texts keeps them apart.
        total = np.cumsum(gain - np.where(np.concatenate([[False], self.last[:-1]]), 1e4, 0.0))
        before = np.concatenate([[0.0], total[:-1]])
        first = np.concatenate([[True], self.last[:-1]])
        before = np.where(first, total - gain, before)
        until = total - np.minimum.accumulate(before)
        onward = np.maximum.accumulate(total[::-1])[::-1] - before
        return until + onward - gain >= -ENTER - 1e-6

    def path(self) -> np.ndarray:
        """The state of each place: 0 clean, 1 lost, 2.. the pairs, by Viterbi decoding."""
        n, count = len(self.at), 2 + len(pairs())
        path = np.zeros(n, np.int64)
        torn = self.torn() if n else np.zeros(0, bool)
        if not torn.any():
            return path
        rows = np.flatnonzero(torn)
        row_of = np.full(n, -1)
        row_of[rows] = np.arange(len(rows))
        emit = np.full((len(rows), count), IMPOSSIBLE)
        emit[:, 0], emit[:, 1] = self.clean[rows], self.lost[rows]
        for s, places, share in self.states:
            held = row_of[places]
            emit[held[held >= 0], s] = share[held >= 0]
        opens = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1] + 1) | self.last[rows[:-1]]]))
        lengths = np.diff(np.append(opens, len(rows)))
        path[rows] = best_paths(emit, opens, lengths, self.last[rows[opens + lengths - 1]])
        return path


def best_paths(emit: np.ndarray, opens: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best states of the rows of each stretch (opens, lengths), all stretches at once; one that doesn't end its text goes back to the clean state.

    Staying costs nothing, another state costs ENTER or LEAVE. Of equal paths the one that leaves a pair's state last counts:
    letters that could be either belong to the span before them.
    """
    order = np.argsort(-lengths, kind="stable")
    opens, lengths, ends = opens[order], lengths[order], ends[order]
    states = emit.shape[1]
    everyone = np.arange(states)
    back = np.zeros(emit.shape, np.int8)
    score = emit[opens] + np.where(everyone == 0, 0.0, ENTER)
    for t in range(1, int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t))
        now, rows = score[:live], opens[:live] + t
        best = now[:, 1:].argmax(1) + 1
        dearest = now[np.arange(live), best]
        moved, from_clean = (dearest + ENTER + LEAVE)[:, None], now[:, :1] + ENTER
        other = np.maximum(moved, from_clean)
        origin = np.where(now >= other, everyone, np.where(from_clean >= moved, 0, best[:, None]))
        origin[:, 0] = np.where(now[:, 0] > dearest + LEAVE, 0, best)
        back[rows] = origin
        reached = np.maximum(now, other)
        reached[:, 0] = np.maximum(now[:, 0], dearest + LEAVE)
        score[:live] = reached + emit[rows]
    best = score[:, 1:].argmax(1) + 1
    dearest = score[np.arange(len(score)), best]
    state = np.where(np.where(ends, score[:, 0] >= dearest, score[:, 0] > dearest + LEAVE), 0, best)
    path = np.zeros(len(emit), np.int64)
    for t in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t))
        rows = opens[:live] + t
        path[rows] = state[:live]
        state[:live] = back[rows, state[:live]] if t else state[:live]
    return path


def _turned_back(text: str, places: list[int], path: list[int], undone: list[str]) -> str:
    """The text with each labelled span turned back; adds the names of the states to undone."""
    own, out, at, i = pairs(), [], 0, 0
    while i < len(places):
        j = i
        while j + 1 < len(places) and path[j + 1] == path[i]:
            j += 1
        state = path[i]
        if state:
            lo, hi = places[i], places[j] + 1
            name = LOST if state == 1 else own[state - 2].name
            if name not in undone:
                undone.append(name)
            if state > 1:
                out += [text[at:lo], own[state - 2].apply(text, places[i : j + 1], lo, hi)]
                at = hi
        i = j + 1
    return "".join(out) + text[at:]


def restore_all(texts: list[str]) -> list[tuple[str, list[str]]]:
    """(text as far as it can be restored, pairs in the order they were undone) of each text; no pairs if it is clean.

    A text is decoded again as long as it changes; one that comes back to a form it had before is left in it.
    """
    out: list[tuple[str, list[str]]] = [(x, []) for x in texts]
    seen: dict[int, set[str]] = {}
    todo = list(range(len(texts)))
    while todo:
        chunk, size = [], 0
        while todo and (not chunk or size + len(out[todo[-1]][0]) <= BATCH_CHARS):
            chunk.append(todo.pop())
            size += len(out[chunk[-1]][0])
        found = Places([out[i][0] for i in chunk])
        path = found.path()
        for row in np.unique(found.text[path > 0]).tolist():
            i = chunk[row]
            lo, hi = np.searchsorted(found.text, [row, row + 1])
            before, undone = out[i]
            after = _turned_back(before, found.inside[lo:hi].tolist(), path[lo:hi].tolist(), undone)
            out[i] = after, undone
            seen.setdefault(i, set()).add(before)
            if after not in seen[i]:
                todo.append(i)
    return out


def restore(text: str) -> tuple[str, list[str]]:
    """restore_all of one text."""
    return restore_all([text])[0]


def repair_encoding(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, restored, pairs, complete) of each row whose text is garbled.

    restored: the text with every span turned back that can be; pairs: which encoding
    pairs were undone, "lost" for replacement characters, also as GBK shows them; complete: none of those is left. Rows with
    a clean, null or empty text give no row; repeated rows are each returned; other
    columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, texts, names = [], [], []
            for row, (restored, undone) in enumerate(restore_all(part.column(1).to_pylist())):
                if undone:
                    taken.append(row)
                    texts.append(restored)
                    names.append(undone)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(taken, pa.int64())), pa.array(texts, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(["�" not in t and GBK_LOST not in t for t in texts], pa.bool_())],
                names=["key", "restored", "pairs", "complete"],
            )

    # Texts of ASCII only can't be garbled; they never leave the JVM.
    rows = df.where(F.octet_length(text) > F.char_length(text)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, f"key {kind}, restored string, pairs array<string>, complete boolean").withColumnRenamed("key", key)
