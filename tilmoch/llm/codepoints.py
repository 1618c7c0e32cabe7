"""Text as flat numpy code-point arrays: consistent form and word form of whole Arrow batches.

A batch of strings is one ``uint32`` array of code points plus row offsets. All
steps are table gathers, cumulative offsets and segment reductions over that
array; no Python string method runs per row.

Consistent form (``fold``):

* composed letters (canonical composition, marks in canonical order),
* ordinary width (full-width, half-width, mathematical-alphabet, ligature and
  Roman-numeral signs become the plain letters or digits they look like;
  superscripts, fractions, circled and squared signs such as ``²``, ``½``,
  ``№`` stay),
* ordinary blanks (every Unicode space separator becomes U+0020; tabs and line
  breaks stay),
* nothing invisible (format characters, variation selectors, joiners, fillers
  and control characters are deleted),
* look-alike letters of another alphabet take the alphabet of their word: a run
  of letters of one script that consists only of look-alikes is rewritten in
  the script which the unambiguous letters of its word, else of its row, are
  written in. Runs with an unambiguous letter are truly of their alphabet and
  stay.

Word form (``word_form``): the consistent form, lower-cased, apostrophes and the
backtick removed, every other character that is no letter or digit a blank.

Nulls stay null; an empty text stays empty. ``fold`` is idempotent.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_CP = 0x110000

# The apostrophes that words drop (with the backtick).
APOSTROPHES = "'ʻʼ‘’`"

# Letters of two alphabets that look alike, as pairs in code-point order of the first.
CYRILLIC_LATIN = (
    "ЅS ІI ЈJ АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ԚQ ԜW ЁË ЇÏ ёë їï ӐĂ ӑă ӒÄ ӓä ӦÖ ӧö"
)
#: Latin letters that have a twin in the everyday Cyrillic alphabets.
LATIN_CYRILLIC = "AА BВ CС EЕ HН KК MМ OО PР TТ XХ YУ aа cс eе oо pр xх yу ËЁ ëё"
GREEK_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi νv οo ρp υu ϲc ϳj"
GREEK_CYRILLIC = "ΑА ΒВ ΕЕ ΗН ΙІ ΚК ΜМ ΟО ΡР ΤТ ΥУ ΧХ αа ιі οо ρр ϲс ϳј"

LATIN, CYRILLIC, GREEK = 1, 2, 3
# bits of the class table
C_LATIN, C_CYRILLIC, C_GREEK, C_CHANGE, C_MARK = 1, 2, 4, 8, 16
KEEP_FORMAT = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
FOLDED_TAGS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _single(cp: int) -> str:
    """What one code point becomes in consistent form, before composition."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    if cat == "Cc":
        return ch if ch in "\t\n\r\v\f" else ""
    if cat == "Cf":
        return ch if cp in KEEP_FORMAT else ""
    if cp == 0x034F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F or cp in (0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        return ""
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in FOLDED_TAGS or (tag == "<compat>" and (0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F)):
        return unicodedata.normalize("NFKC", ch)
    return unicodedata.normalize("NFC", ch)


class _Tables:
    """Lookup tables over all code points, built from the Unicode database once per process."""

    def __init__(self) -> None:
        cps = [c for c in range(MAX_CP) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
        self.cls = np.zeros(MAX_CP, np.uint8)
        self.start = np.arange(MAX_CP, dtype=np.int32)
        self.length = np.ones(MAX_CP, np.int32)
        self.dstart = np.arange(MAX_CP, dtype=np.int32)
        self.dlength = np.ones(MAX_CP, np.int32)
        self.ccc = np.zeros(MAX_CP, np.uint8)
        self.alnum = np.zeros(MAX_CP, bool)
        self.letter = np.zeros(MAX_CP, bool)
        self.lstart = np.arange(MAX_CP, dtype=np.int32)
        self.llength = np.ones(MAX_CP, np.int32)
        pool: list[int] = []
        pairs: list[tuple[int, int]] = []
        for c in cps:
            ch = chr(c)
            to = _single(c)
            if to != ch:
                self.cls[c] |= C_CHANGE
                self.start[c], self.length[c] = MAX_CP + len(pool), len(to)
                pool += map(ord, to)
            full = unicodedata.normalize("NFD", to)
            if full != ch:
                self.dstart[c], self.dlength[c] = MAX_CP + len(pool), len(full)
                pool += map(ord, full)
            k = unicodedata.combining(ch)
            if k:
                self.ccc[c] = k
                self.cls[c] |= C_MARK | C_CHANGE
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in d.split(" "))
                pairs.append(((a << 21) | b, c))
            self.alnum[c] = ch.isalnum()
            low = ch.lower()
            if low != ch:
                self.lstart[c], self.llength[c] = MAX_CP + len(pool), len(low)
                pool += map(ord, low)
            cat = unicodedata.category(ch)
            if cat[0] == "L" and cat != "Lm":
                self.letter[c] = True
                name = unicodedata.name(ch, "")
                for word, bit in (("LATIN", C_LATIN), ("FULLWIDTH LATIN", C_LATIN), ("CYRILLIC", C_CYRILLIC), ("GREEK", C_GREEK)):
                    if name.startswith(word):
                        self.cls[c] |= bit
        for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)):  # Hangul vowels and finals compose by arithmetic
            self.cls[c] |= C_MARK | C_CHANGE
        self.pool = np.concatenate([np.arange(MAX_CP, dtype=np.uint32), np.array(pool, np.uint32)])
        pairs.sort()
        self.pair_key = np.array([p for p, _ in pairs], np.int64)
        self.pair_to = np.array([t for _, t in pairs], np.uint32)
        self.script = np.zeros(MAX_CP, np.uint8)
        self.script[(self.cls & C_LATIN) > 0] = LATIN
        self.script[(self.cls & C_CYRILLIC) > 0] = CYRILLIC
        self.script[(self.cls & C_GREEK) > 0] = GREEK
        self.to_latin = np.arange(MAX_CP, dtype=np.uint32)
        self.to_cyrillic = np.arange(MAX_CP, dtype=np.uint32)
        for table, text in ((self.to_latin, CYRILLIC_LATIN), (self.to_latin, GREEK_LATIN), (self.to_cyrillic, LATIN_CYRILLIC), (self.to_cyrillic, GREEK_CYRILLIC)):
            for a, b in text.split():
                table[ord(a)] = ord(b)
        idx = np.arange(MAX_CP, dtype=np.uint32)
        # a letter is ambiguous if it has a twin in some other alphabet
        self.ambiguous = (self.to_latin != idx) | (self.to_cyrillic != idx)
        self.apostrophe = np.zeros(MAX_CP, bool)
        self.apostrophe[[ord(c) for c in APOSTROPHES]] = True
        self.in_word = self.alnum | self.apostrophe | (self.ccc > 0)
        self.utf8_len = np.ones(MAX_CP, np.uint8)
        self.utf8_len[0x80:] = 2
        self.utf8_len[0x800:] = 3
        self.utf8_len[0x10000:] = 4


@functools.cache
def tables() -> _Tables:
    return _Tables()


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def offsets_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array, whatever its slice or offset width."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0 or arr.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def decode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and their row offsets; a null row is empty."""
    data, off = offsets_of(arr)
    if not len(data):
        return np.zeros(0, np.uint32), off
    if data.max() < 0x80:
        return data.astype(np.uint32), off
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return cps, before[off]


def encode(cps: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """String array of code points and row offsets; rows with null set are null."""
    t = tables()
    data = cps.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(t.utf8_len[cps], out=ends[1:])
    boff = ends[off]
    small = boff[-1] < 2**31 - 1
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    kind = pa.StringArray if small else pa.LargeStringArray
    return kind.from_buffers(len(off) - 1, pa.py_buffer(boff.astype(np.int32 if small else np.int64).tobytes()), pa.py_buffer(data), valid)


def row_any(bits: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bitwise or of each row's values, 0 for an empty row."""
    out = np.zeros(len(off) - 1, bits.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.bitwise_or.reduceat(bits, off[:-1][full])
    return out


def take_rows(cps: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = (off[1:] - off[:-1])[rows]
    new = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lens, out=new[1:])
    return cps[np.repeat(off[:-1][rows] - new[:-1], lens) + np.arange(new[-1])], new


def gather(cps: np.ndarray, off: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code point by its run of the pool."""
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    idx = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
    return tables().pool[idx], ends[off]


def _compose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order each run of marks canonically and compose it with its base, all runs at once."""
    t = tables()
    mark = t.ccc[cps] > 0
    if ((cps >= 0x1161) & (cps <= 0x11C2)).any():  # a Hangul vowel or final belongs to what stands right before it
        prev = np.concatenate([[0], cps[:-1]])
        vowel = (cps >= 0x1161) & (cps <= 0x1175) & (prev >= 0x1100) & (prev <= 0x1112)
        open_ = ((prev >= 0xAC00) & (prev <= 0xD7A3) & ((prev - 0xAC00) % 28 == 0)) | np.concatenate([[False], vowel[:-1]])
        mark |= vowel | ((cps >= 0x11A8) & (cps <= 0x11C2) & open_)
    first = np.zeros(len(cps) + 1, bool)
    first[off] = True
    base = ~mark | first[:-1]  # a mark that opens a row has no base and counts as one
    if base.all():
        return cps, off
    run = np.cumsum(base) - 1
    ccc = t.ccc[cps]
    at = np.flatnonzero(base)
    size = np.diff(np.append(at, len(cps)))
    if (size > 2).any() or (mark & base).any():  # canonical order: stable by class within each run, Hangul vowels (class 0) first
        order = np.lexsort((np.arange(len(cps)), np.where(mark, ccc.astype(np.int16), -1), run))
        cps, ccc = cps[order], ccc[order]
    cur = cps[at].astype(np.int64)
    last = np.full(len(at), -1, np.int16)
    keep = np.ones(len(cps), bool)
    for j in range(1, int(size.max())):
        r = np.flatnonzero(size > j)
        pos = at[r] + j
        m = cps[pos].astype(np.int64)
        k = np.searchsorted(t.pair_key, key := (cur[r] << 21) | m)
        k[k == len(t.pair_key)] = 0
        hit = t.pair_key[k] == key
        to = t.pair_to[k].astype(np.int64)
        lv = (cur[r] >= 0x1100) & (cur[r] <= 0x1112) & (m >= 0x1161) & (m <= 0x1175)
        lvt = (cur[r] >= 0xAC00) & (cur[r] <= 0xD7A3) & ((cur[r] - 0xAC00) % 28 == 0) & (m >= 0x11A8) & (m <= 0x11C2)
        to = np.where(lv, 0xAC00 + ((cur[r] - 0x1100) * 21 + (m - 0x1161)) * 28, np.where(lvt, cur[r] + m - 0x11A7, to))
        c = ccc[pos].astype(np.int16)
        hit = (hit | lv | lvt) & ~((last[r] >= c) & (last[r] >= 0))
        cur[r[hit]] = to[hit]
        keep[pos[hit]] = False
        last[r[~hit]] = c[~hit]
    out = cps.copy()
    out[at] = cur.astype(np.uint32)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return out[keep], ends[off]


def _one_script(cps: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rewrite runs of look-alike letters in the alphabet of their word or row."""
    t = tables()
    s = t.script[cps]
    n = len(cps)
    if not n:
        return cps
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    clear = ~t.ambiguous[cps]
    row_l = np.bincount(rows[(s == LATIN) & clear], minlength=len(off) - 1)
    row_c = np.bincount(rows[(s == CYRILLIC) & clear], minlength=len(off) - 1)
    edge = np.zeros(n, bool)
    edge[off[:-1][off[:-1] < n]] = True
    inside = t.in_word[cps]
    start = inside & (edge | ~np.concatenate([[False], inside[:-1]]))
    word = np.cumsum(start) - 1  # of characters inside words
    letters = np.flatnonzero(inside & (s > 0))
    if not len(letters):
        return cps
    lw, ls = word[letters], s[letters]
    new_run = np.ones(len(letters), bool)
    new_run[1:] = (lw[1:] != lw[:-1]) | (ls[1:] != ls[:-1])
    run_at = np.flatnonzero(new_run)
    run_clear = np.logical_or.reduceat(clear[letters], run_at)
    words = int(word[-1]) + 1
    w_l = np.bincount(lw[(ls == LATIN) & clear[letters]], minlength=words)
    w_c = np.bincount(lw[(ls == CYRILLIC) & clear[letters]], minlength=words)
    run_word, run_script, run_row = lw[run_at], ls[run_at], rows[letters[run_at]]
    sign = np.sign(w_l - w_c)[run_word]
    sign = np.where(sign == 0, np.sign(row_l - row_c)[run_row], sign)
    # a word of mixed look-alikes without any clear letter around follows its own majority, Latin on a tie
    mixed = np.bincount(run_word, minlength=words)[run_word] > 1
    own = np.sign(np.bincount(lw[ls == LATIN], minlength=words) - np.bincount(lw[ls == CYRILLIC], minlength=words))[run_word]
    sign = np.where((sign == 0) & mixed, np.where(own == 0, 1, own), sign)
    target = np.where(sign > 0, LATIN, np.where(sign < 0, CYRILLIC, 0))
    change = ~run_clear & (target > 0) & (target != run_script)
    if not change.any():
        return cps
    per = np.diff(np.append(run_at, len(letters)))
    do = np.repeat(np.where(change, target, 0), per)
    out = cps.copy()
    for code, table in ((LATIN, t.to_latin), (CYRILLIC, t.to_cyrillic)):
        at = letters[do == code]
        out[at] = table[out[at]]
    return out


def _fold_rows(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    kind = t.cls[cps]
    if (kind & C_CHANGE).any():
        near = np.zeros(len(cps), bool)  # a base before a mark is decomposed, so that its marks compose in canonical order
        near[:-1] = (kind[1:] & C_MARK) > 0
        gone = t.length[cps] == 0
        if gone.any():  # what is invisible does not part a base from its mark
            keep = ~gone
            ends = np.zeros(len(cps) + 1, np.int64)
            np.cumsum(keep, out=ends[1:])
            cps, off = cps[keep], ends[off]
            kind = kind[keep]
            near = np.zeros(len(cps), bool)
            near[:-1] = (kind[1:] & C_MARK) > 0
        near |= (kind & C_MARK) > 0
        cps, off = gather(cps, off, np.where(near, t.dstart[cps], t.start[cps]), np.where(near, t.dlength[cps], t.length[cps]))
        cps, off = _compose(cps, off)
        return _compose(_one_script(cps, off), off)  # a mark left over may compose with a letter of the other alphabet
    return _one_script(cps, off), off


def fold_points(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consistent form of every row, its offsets and which rows it changes.

    Only rows with a character to change or letters of two alphabets are worked on.
    """
    t = tables()
    kind = row_any(t.cls[cps], off)
    scripts = kind & (C_LATIN | C_CYRILLIC | C_GREEK)
    todo = np.flatnonzero(((kind & C_CHANGE) > 0) | ((scripts & (scripts - 1)) > 0))
    changed = np.zeros(len(off) - 1, bool)
    if not len(todo):
        return cps, off, changed
    sub, soff = take_rows(cps, off, todo)
    new, noff = _fold_rows(sub, soff)
    same_len = np.diff(noff) == np.diff(soff)
    differs = ~same_len
    check = np.flatnonzero(same_len)
    if len(check):
        a, ao = take_rows(sub, soff, check)
        b, _ = take_rows(new, noff, check)
        differs[check] = row_any((a != b).astype(np.uint8), ao) > 0
    changed[todo] = differs
    lens = np.diff(off)
    lens[todo] = np.diff(noff)
    out_off = np.zeros(len(off), np.int64)
    np.cumsum(lens, out=out_off[1:])
    out = np.empty(out_off[-1], np.uint32)
    rest = np.ones(len(off) - 1, bool)
    rest[todo] = False
    mask = np.repeat(rest, lens)
    out[mask] = cps[np.repeat(rest, np.diff(off))]
    out[~mask] = new
    return out, out_off, changed


def word_points(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased points without apostrophes, the mask of word characters, row offsets, word starts, row of each word."""
    t = tables()
    cps, off, _ = fold_points(cps, off)
    if (t.llength[cps] != 1).any():
        cps, off = gather(cps, off, t.lstart[cps], t.llength[cps])
    else:
        cps = t.pool[t.lstart[cps]]
    drop = t.apostrophe[cps]
    if drop.any():
        keep = ~drop
        ends = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(keep, out=ends[1:])
        cps, off = cps[keep], ends[off]
    inside = t.alnum[cps]
    prev = np.zeros(len(cps), bool)
    prev[1:] = inside[:-1]
    prev[off[:-1][off[:-1] < len(cps)]] = False
    starts = np.flatnonzero(inside & ~prev)
    rows = np.searchsorted(off, starts, side="right") - 1
    return cps, inside, off, starts, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in order, and the number of words of each row.

    The hash is the sum of scrambled (place in word, character) pairs, scrambled again.
    """
    cps, inside, off, starts, rows = word_points(cps, off)
    counts = np.bincount(rows, minlength=len(off) - 1)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    h = mix64(((place.astype(np.uint64) + np.uint64(1)) << np.uint64(21)) | cps[at].astype(np.uint64))
    return mix64(np.add.reduceat(h, first) + np.uint64(0x9E3779B97F4A7C15)), counts


def word_text(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined with single blanks."""
    cps, inside, off, starts, rows = word_points(cps, off)
    keep = inside.copy()
    blank = np.zeros(len(cps), bool)
    again = starts[1:][rows[1:] == rows[:-1]]  # a word that isn't the first of its row has a blank before it
    out = np.where(inside, cps, np.uint32(32))
    blank[again - 1] = True
    keep |= blank
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=ends[1:])
    return out[keep], ends[off]


def word_spans(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consistent form and its row offsets; where each word begins and ends in it; the number of words of each row."""
    t = tables()
    cps, off, _ = fold_points(cps, off)
    length = t.llength[cps]
    src = np.repeat(np.arange(len(cps)), length)
    low, ends = gather(cps, off, t.lstart[cps], length)
    keep = ~t.apostrophe[low]
    kept = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    low, src, ends = low[keep], src[keep], kept[ends]
    at = np.flatnonzero(t.alnum[low])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    row = np.searchsorted(ends, at, side="right") - 1
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    if not len(at):
        first = last = np.zeros(0, np.int64)
    return cps, off, src[at[first]], src[at[last]] + 1, np.bincount(row[first], minlength=len(off) - 1)


def slices(arr: pa.Array, limit: int = 1 << 19) -> Iterator[pa.Array]:
    """Row slices of about limit bytes, so that temporaries stay in cache; a longer row is a slice of its own."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, off = offsets_of(arr)
    at, n = 0, len(arr)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield arr.slice(at, to - at)
        at = to


def nulls(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.is_null())


def fold(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Consistent form of a string array and which rows needed it."""
    outs, flags = [], []
    for part in slices(arr):
        cps, off = decode(part)
        cps, off, changed = fold_points(cps, off)
        outs.append(encode(cps, off, nulls(part)))
        flags.append(changed)
    if not outs:
        return pa.array([], pa.string()), np.zeros(0, bool)
    return pa.concat_arrays(outs), np.concatenate(flags)


def word_form(arr: pa.Array) -> pa.Array:
    outs = []
    for part in slices(arr):
        cps, off = word_text(*decode(part))
        outs.append(encode(cps, off, nulls(part)))
    return pa.concat_arrays(outs) if outs else pa.array([], pa.string())


if sys.byteorder != "little":  # the code-point views assume it
    raise ImportError("a little-endian machine is needed")
