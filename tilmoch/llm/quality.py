"""Per-document text quality: associative line and word counts, ratios and rule outcomes.

A text is summed up line by line. Lines add up to a document, and parts of one
line add up to a line, so a huge document can be cut into chunks: each chunk gives
the sums of its complete lines and the open line at either end, and merging two
neighbours closes the line between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilmoch.llm import codepoints as C
from tilmoch.llm.tokens import OVERSIZED, chunk_texts
from tilmoch.session import drop_shared, shared_table

#: A word is common if it makes up at least this share of all words of the corpus, so at most 1 / share words are.
COMMON_SHARE = 1 / 5000
#: Chunks merged in one task of the tree.
FAN_IN = 64

# what a line adds up from its parts
PARTS = ["chars", "tokens", "words", "word_chars", "numbers", "symbol_tokens", "letters", "digits", "symbols", "noise", "gaps", "bars", "tight", "semis", "commas", "tags", "leaders", "ends", "mixed"]
# what a document adds up from its lines
LINES = [
    "lines", "ended", "bullet_lines", "short_lines", "table_lines", "list_lines", "leader_lines",
    "bullet_chars", "short_chars", "table_chars", "list_chars", "prose_chars",
]
_P = {n: i for i, n in enumerate(PARTS)}
_L = {n: i for i, n in enumerate(LINES)}

# What ends a sentence, what opens a list item, what parts the items of a line.
ENDS = ".!?…։؟。！？"
CLOSERS = "\"'»”’)]"
BULLETS = "-–•*▪·‣◦●○■□+>✓"
PARTERS = "·»›|/•→>~‧‹«"


class _Kinds:
    def __init__(self) -> None:
        t = C.tables()
        self.space = np.zeros(C.MAX_CP, bool)
        self.space[[c for c in range(0x3001) if chr(c).isspace()]] = True
        self.letter = t.letter | (t.ccc > 0)
        self.letter[[0x02BB, 0x02BC]] = True
        self.digit = t.alnum & ~t.letter
        self.digit[[0x02BB, 0x02BC]] = False
        self.symbol = ~(self.space | self.letter | self.digit)
        self.noise = np.zeros(C.MAX_CP, bool)
        self.noise[[*range(0x80, 0xA0), 0xFFFD, 0x25A1]] = True
        self.end = self._set(ENDS)
        self.closer = self._set(CLOSERS)
        self.bullet = self._set(BULLETS)
        self.parter = self._set(PARTERS)
        self.plain = self._set(".,!?…:;-—–'\"«»“”‘’()`ʻʼ")

    @staticmethod
    def _set(chars: str) -> np.ndarray:
        out = np.zeros(C.MAX_CP, bool)
        out[[ord(c) for c in chars]] = True
        return out


_kinds: list[_Kinds] = []


def kinds() -> _Kinds:
    if not _kinds:
        _kinds.append(_Kinds())
    return _kinds[0]


def line_parts(cps: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every line of every row, with its row, and whether it opens as a list item or ends as a sentence."""
    k = kinds()
    n = len(cps)
    nl = cps == 10
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    opens = first.copy()
    opens[1:] |= nl[:-1]
    at = np.flatnonzero(opens)
    line_of = np.cumsum(opens) - 1
    row = np.searchsorted(off, at, side="right") - 1
    m = len(at)
    space = k.space[cps]
    solid = ~space
    letter, digit, symbol = k.letter[cps], k.digit[cps], k.symbol[cps]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, at, dtype=np.int64) if m else np.zeros(0, np.int64)

    prev_solid = np.zeros(n, bool)
    prev_solid[1:] = solid[:-1]
    prev_solid &= ~opens
    starts = np.flatnonzero(solid & ~prev_solid)  # of tokens
    t_line = line_of[starts]
    t = len(starts)

    def per_token(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        after = np.append(starts[1:], n) if t else starts
        return c[after] - c[starts]

    tl, td, ts = (per_token(x) for x in (letter, digit, symbol))

    def by_line(mask: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(t_line[mask], weights=None if weights is None else weights[mask], minlength=m).astype(np.int64)

    word, number = tl > 0, (tl == 0) & (td > 0)
    sym = (tl == 0) & (td == 0)
    tok_first = cps[starts]
    one_parter = sym & (ts == 1) & k.parter[tok_first]
    out = np.zeros((m, len(PARTS)), np.int64)
    dots = cps == 46
    run3 = np.zeros(n, bool)
    if n > 3:
        run3[3:] = dots[3:] & dots[2:-1] & dots[1:-2] & dots[:-3] & (line_of[3:] == line_of[:-3])
    gap = np.zeros(n, bool)  # a solid character after a tab or at least three blanks, not at the start of a line
    if n > 3:
        gap[3:] = solid[3:] & space[2:-1] & space[1:-2] & space[:-3] & ~nl[2:-1] & ~nl[1:-2] & ~nl[:-3]
    gap[1:] |= solid[1:] & (cps[:-1] == 9)
    lead = np.zeros(m, np.int64)  # the gap before a line's first token doesn't count
    if t:
        lt = np.flatnonzero(np.concatenate([[True], t_line[1:] != t_line[:-1]]))
        lead[t_line[lt]] = gap[starts[lt]]
    nxt_solid = np.zeros(n, bool)
    nxt_solid[:-1] = solid[1:]
    nxt_solid[off[1:][off[1:] > 0] - 1] = False  # the next row is another text
    comma, semi = cps == 44, cps == 59
    sentence = k.end[cps] & ~nxt_solid
    cols = {
        "chars": total(solid), "tokens": by_line(np.ones(t, bool)), "words": by_line(word), "word_chars": by_line(word, tl + td), "numbers": by_line(number),
        "symbol_tokens": by_line(one_parter), "letters": total(letter), "digits": total(digit), "symbols": total(symbol & ~k.plain[cps]), "noise": total(k.noise[cps]),
        "gaps": total(gap) - lead, "bars": total(cps == 124), "tight": total((comma | semi) & nxt_solid), "semis": total(semi), "commas": total(comma),
        "tags": by_line(word & (tok_first == 35)), "leaders": total(run3), "ends": total(sentence), "mixed": by_line((ts - (per_token(k.plain[cps]) if t else 0) > 0) & (tl > 0)),
    }
    for name, v in cols.items():
        out[:, _P[name]] = v
    bullet = np.zeros(m, bool)
    ended = np.zeros(m, bool)
    if t:
        lt = np.flatnonzero(np.concatenate([[True], t_line[1:] != t_line[:-1]]))
        s = starts[lt]
        nt = np.append(starts, n)[lt + 1]
        c0, tok_len = cps[s], tl[lt] + td[lt] + ts[lt]
        numbered = (tok_len <= 5) & (ts[lt] >= 1) & (((td[lt] > 0) & (tl[lt] == 0)) | ((tl[lt] == 1) & (td[lt] == 0)))
        last_sym = np.isin(cps[np.minimum(s + tok_len - 1, n - 1)], [ord(x) for x in ".)]"]) & (nt > s)
        bullet[t_line[lt]] = ((tok_len == 1) & k.bullet[c0]) | (numbered & last_sym)
        le = np.append(lt[1:], t) - 1
        e = starts[le] + np.maximum(tl[le] + td[le] + ts[le], 1) - 1
        e = np.minimum(e, n - 1)
        c = cps[e]
        back = k.closer[c] & (e > 0)
        c = np.where(back, cps[np.maximum(e - 1, 0)], c)
        ended[t_line[le]] = k.end[c]
    return {"parts": out, "row": row, "bullet": bullet, "ended": ended, "lead": lead}


def line_sums(parts: np.ndarray, bullet: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """What complete lines add to their document: their kinds and the characters in each kind."""
    p = {n: parts[:, i] for n, i in _P.items()}
    chars, tokens = p["chars"], p["tokens"]
    some = chars > 0
    sentence = ended & (p["words"] >= 4) & (p["leaders"] == 0)
    cells = p["gaps"] + p["bars"] + p["tight"]
    numeric = (p["numbers"] * 10 >= 3 * tokens) & (p["numbers"] >= 2)
    table = some & (((p["gaps"] >= 1) & (p["gaps"] * 8 >= tokens)) | (p["bars"] >= 2) | ((p["tight"] >= 2) & (p["tight"] * 4 >= tokens)) | numeric | ((p["numbers"] >= 1) & (tokens <= 3) & (cells >= 1)))
    leader = some & (p["leaders"] > 0)
    parted = (p["symbol_tokens"] >= 2) & (p["symbol_tokens"] * 6 >= tokens)
    tagged = (p["tags"] >= 2) & (p["tags"] * 5 >= tokens)
    semis = (p["semis"] >= 3) & (p["semis"] * 6 >= tokens)
    commas = (p["commas"] >= 5) & (p["commas"] * 3 >= tokens)
    listed = some & ~table & (leader | parted | tagged | semis | commas)
    bulleted = some & ~table & ~listed & bullet & ((tokens <= 15) | (p["ends"] <= 1))  # running text after a mark is no item
    short = some & ~table & ~listed & ~bulleted & ~sentence & (tokens <= 5)
    prose = some & ~(table | listed | bulleted | short)
    cols = [some, some & ended, bulleted, short, table, listed, leader, *(np.where(x, chars, 0) for x in (bulleted, short, table, listed, prose))]
    return np.stack([c.astype(np.int64) for c in cols], axis=1)


#: A word counts as an echo if it is the same as one of so many words before it.
ECHO = 16
COUNTS = [*PARTS, *LINES, "common", "all_words", "echoes"]


def _empty_lines() -> dict[str, np.ndarray]:
    return {"parts": np.zeros((0, len(PARTS)), np.int64), "row": np.zeros(0, np.int64), "bullet": np.zeros(0, bool), "ended": np.zeros(0, bool), "lead": np.zeros(0, np.int64)}


def _echoes(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(h), bool)
    for lag in range(1, min(ECHO, len(h) - 1) + 1):
        hit[lag:] |= (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
    return hit


def count_rows(cps: np.ndarray, off: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows x COUNTS for whole texts, the lines they come from, and the hashes and numbers of their words."""
    rows = len(off) - 1
    out = np.zeros((rows, len(COUNTS)), np.int64)
    if not len(cps):
        return out, _empty_lines(), np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    ln = line_parts(cps, off)
    full = np.flatnonzero(off[1:] > off[:-1])
    at = np.searchsorted(ln["row"], full)
    out[full, : len(PARTS)] = np.add.reduceat(ln["parts"], at, axis=0)
    out[full, len(PARTS) : len(PARTS) + len(LINES)] = np.add.reduceat(line_sums(ln["parts"], ln["bullet"], ln["ended"]), at, axis=0)
    h, n = C.word_hashes(cps, off)
    if len(h):
        row = np.repeat(np.arange(rows), n)
        if len(common):
            k = np.searchsorted(common, h)
            k[k == len(common)] = 0
            out[:, -3] = np.bincount(row[common[k] == h], minlength=rows)
        out[:, -2] = n
        out[:, -1] = np.bincount(row[_echoes(h, row)], minlength=rows)
    return out, ln, h, n


# A chunk's state: the sums of the lines it holds whole, its open first and last line, whether blanks part
# the first from the cut (hg), its first and last words.
# ``one`` says that the chunk is part of a single line, kept in the head alone.
STATE = "chunk bigint, sums array<bigint>, one boolean, head array<bigint>, hb boolean, he boolean, hg boolean, tail array<bigint>, tb boolean, te boolean, hw array<bigint>, tw array<bigint>"


def chunk_state(cps: np.ndarray, off: np.ndarray, common: np.ndarray) -> list[dict]:
    sums, ln, h, n = count_rows(cps, off, common)
    out, first = [], np.cumsum(n) - n
    for i in range(len(off) - 1):
        own = np.flatnonzero(ln["row"] == i)
        head = own[:1]
        s = sums[i].copy()
        edge = own[[0, -1]] if len(own) > 1 else own
        s[: len(PARTS)] -= ln["parts"][edge].sum(axis=0)
        s[len(PARTS) : len(PARTS) + len(LINES)] -= line_sums(ln["parts"][edge], ln["bullet"][edge], ln["ended"][edge]).sum(axis=0)
        # a text that ends with a line break has an empty last line after it
        closed = off[i + 1] > off[i] and cps[off[i + 1] - 1] == 10
        w = h[first[i] : first[i] + n[i]].view(np.int64)
        zero = np.zeros(len(PARTS), np.int64)
        if closed and len(own):
            last = own[-1:]
            if len(own) > 1:
                s[: len(PARTS)] += ln["parts"][last].sum(axis=0)
                s[len(PARTS) : len(PARTS) + len(LINES)] += line_sums(ln["parts"][last], ln["bullet"][last], ln["ended"][last]).sum(axis=0)
            tail, tb, te, one = zero, False, False, False
        elif len(own) > 1:
            tail, tb, te, one = ln["parts"][own[-1]], bool(ln["bullet"][own[-1]]), bool(ln["ended"][own[-1]]), False
        else:
            tail, tb, te, one = zero, False, False, True
        out.append({
            "sums": s, "one": one, "head": ln["parts"][head[0]] if len(head) else zero, "hb": bool(ln["bullet"][head].any()), "he": bool(ln["ended"][head].any()), "hg": bool(ln["lead"][head].any()),
            "tail": tail, "tb": tb, "te": te, "hw": w[:ECHO], "tw": w[-ECHO:],
        })
    return out


def merge_states(a: dict, b: dict) -> dict:
    """State of two neighbouring chunks: the line open between them is closed, or grows, and its words are compared across the cut."""
    sums = np.asarray(a["sums"]) + np.asarray(b["sums"])
    seam = np.concatenate([a["tw"], b["hw"]]).astype(np.int64)
    na = len(a["tw"])
    both = int(_echoes(seam, np.zeros(len(seam), np.int64))[na:].sum())
    alone = int(_echoes(np.asarray(b["hw"], np.int64), np.zeros(len(b["hw"]), np.int64)).sum())
    sums[-1] += both - alone

    def join(p: str, q: str) -> tuple:
        x, y = a[p], b[q]
        left = np.asarray(x)[_P["chars"]] > 0
        right = np.asarray(y)[_P["chars"]] > 0
        z = np.asarray(x) + np.asarray(y)
        z[_P["gaps"]] += left and b["hg"]  # blanks at the cut are no longer the start of a line
        return z, a[p[0] + "b"] if left else b[q[0] + "b"], b[q[0] + "e"] if right else a[p[0] + "e"]

    out = {"sums": sums, "hw": np.concatenate([a["hw"], b["hw"]]).astype(np.int64)[:ECHO], "tw": np.concatenate([a["tw"], b["tw"]]).astype(np.int64)[-ECHO:]}
    zero = np.zeros(len(PARTS), np.int64)
    if a["one"]:
        head, hb, he = join("head", "head")
        out |= {"head": head, "hb": hb, "he": he, "hg": a["hg"], "one": b["one"], "tail": b["tail"], "tb": b["tb"], "te": b["te"]}
        if b["one"]:
            out |= {"tail": zero, "tb": False, "te": False}
    else:
        line, lb, le = join("tail", "head")
        out |= {"head": a["head"], "hb": a["hb"], "he": a["he"], "hg": a["hg"], "one": False}
        if b["one"]:
            out |= {"tail": line, "tb": lb, "te": le}
        else:
            out["sums"] = sums + _closed(line, lb, le)
            out |= {"tail": b["tail"], "tb": b["tb"], "te": b["te"]}
    return out


def _closed(line: np.ndarray, bullet: bool, ended: bool) -> np.ndarray:
    x = np.zeros(len(COUNTS), np.int64)
    x[: len(PARTS)] = line
    x[len(PARTS) : len(PARTS) + len(LINES)] = line_sums(np.asarray(line)[None, :], np.array([bullet]), np.array([ended]))[0]
    return x


def state_counts(s: dict) -> np.ndarray:
    """Counts of a whole document from its one state; an empty line at the end is no line."""
    out = np.asarray(s["sums"]) + _closed(s["head"], s["hb"], s["he"])
    if not s["one"] and np.asarray(s["tail"]).any():
        out = out + _closed(s["tail"], s["tb"], s["te"])
    return out


_ARRAYS = ("sums", "head", "tail", "hw", "tw")


def _state_batch(rows: pa.Array, keys: pa.Array, chunks: list[int], states: list[dict]) -> pa.RecordBatch:
    names = ["row", "key", "chunk", "sums", "one", "head", "hb", "he", "hg", "tail", "tb", "te", "hw", "tw"]
    cols = [rows, keys, pa.array(chunks, pa.int64())]
    for n in names[3:]:
        if n in _ARRAYS:
            cols.append(pa.array([np.asarray(s[n], np.int64) for s in states], pa.list_(pa.int64())))
        else:
            cols.append(pa.array([bool(s[n]) for s in states], pa.bool_()))
    return pa.RecordBatch.from_arrays(cols, names)


def common_words(df: DataFrame, text: str, share: float = COMMON_SHARE) -> np.ndarray:
    """Hashes of the words that make up at least share of all words of the column: no more than 1 / share of them, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch.column(text), 1 << 22):
                h, _ = C.word_hashes(*C.decode(part))
                w, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    counts = df.select(text).where(F.col(text).isNotNull()).mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    counts = shared_table(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = [r["w"] for r in counts.where(F.col("n") >= F.lit(max(2.0, share * total))).toLocalIterator()]
    drop_shared(counts)
    return np.sort(np.array(found, np.int64).view(np.uint64))


def quality_counts(df: DataFrame, key: str, text: Column, oversized: int = OVERSIZED, common: np.ndarray | None = None) -> DataFrame:
    """``(key, <COUNTS>)``: exact counts of each text, one row per row of df, whatever its length and however often its key occurs.

    Null and empty texts have zeros. Texts up to oversized characters are counted
    where they are read; longer ones are cut into chunks that all workers share,
    and chunk states are merged by a tree of fan-in 64 until each row has one.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), text.alias("text"))
    words = common_words(rows, "text") if common is None else common
    shared = rows.sparkSession.sparkContext.broadcast(words)
    kt = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in C.slices(batch.column("text")):
                x = count_rows(*C.decode(part), shared.value)[0]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(done, len(part)), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["key", *COUNTS])
                done += len(part)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = chunk_state(*C.decode(batch.column("text").slice(i, 1)), shared.value)
                yield _state_batch(batch.column("row").slice(i, 1), batch.column("key").slice(i, 1), batch.column("chunk").slice(i, 1).to_pylist(), s)

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        recs = sorted(t.drop_columns(["row", "key"]).to_pylist(), key=lambda r: r["chunk"])
        acc = recs[0]
        for r in recs[1:]:
            acc = merge_states(acc, r)
        return pa.Table.from_batches([_state_batch(t["row"].slice(0, 1).combine_chunks(), t["key"].slice(0, 1).combine_chunks(), [recs[0]["chunk"] // FAN_IN], [acc])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([state_counts(s) for s in batch.to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["key", *COUNTS])

    schema = f"key {kt}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    small = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= oversized).mapInArrow(count, schema)
    big = rows.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > oversized)
    state = f"row bigint, key {kt}, {STATE}"
    tree = chunk_texts(big, ["row", "key"], "text", oversized, True).repartition("row", "chunk").mapInArrow(states, state)
    while True:
        tree = shared_table(tree.groupBy("row", F.floor(F.col("chunk") / FAN_IN).alias("_part")).applyInArrow(merge, state), "states")
        if not tree.agg(F.max("chunk")).first()[0]:  # each row has one state, or there is none
            break
    return small.unionByName(tree.mapInArrow(finish, schema))


@dataclass(frozen=True)
class Rules:
    """Thresholds of the rule outcomes. Shares are of a text's characters, words or tokens, as named."""

    structured: float = 0.5  #: share of characters in lines of tables, lists, items and runs of short lines
    short_lines: int = 4  #: fewer short lines are a heading or a short text
    noise: float = 0.02  #: control and replacement characters
    symbols: float = 0.15  #: characters that are no letter, digit, blank or plain punctuation
    only_symbols: float = 0.45  #: junk whatever the layout
    mixed: float = 0.2  #: tokens of letters with symbols inside
    mixed_tokens: int = 4
    echoes: float = 0.7  #: words that repeat one of the ECHO words before them
    echo_words: int = 12
    common: float = 0.03  #: least share of common words in running text
    common_words: int = 30
    common_prose: float = 0.5  #: share of characters in running lines from which that holds
    mean_word: float = 18
    mean_chars: int = 40


def ratios(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Ratios and the rule outcome ``kind``: prose, list, table, junk, or null for a text without characters."""
    c = {n: F.col(n) for n in COUNTS}
    some = F.greatest(c["chars"], F.lit(1))
    share = {k: c[f"{k}_chars"] / some for k in ("bullet", "short", "table", "list", "prose")}
    short = F.when(c["short_lines"] >= rules.short_lines, share["short"]).otherwise(0.0)
    mean = F.when(c["words"] > 0, c["word_chars"] / c["words"])
    repeated = (c["all_words"] >= rules.echo_words) & (c["echoes"] > rules.echoes * c["all_words"])
    strange = (c["all_words"] >= rules.common_words) & (c["common"] < rules.common * c["all_words"])
    noisy = c["noise"] > rules.noise * some
    junk = (
        noisy | (c["symbols"] > rules.symbols * some) | ((c["mixed"] > rules.mixed * c["tokens"]) & (c["tokens"] >= rules.mixed_tokens)) | repeated
        | ((mean > rules.mean_word) & (c["chars"] >= rules.mean_chars)) | ((c["letters"] == 0) & (c["digits"] == 0)) | (strange & (share["prose"] > rules.common_prose))
    )
    structured = share["table"] + share["list"] + share["bullet"] + short > rules.structured
    listed = share["list"] + share["bullet"] + short
    kind = F.when(c["chars"] == 0, None).when(c["symbols"] > rules.only_symbols * some, "junk").when(structured & (share["table"] >= listed) & ~repeated & ~noisy, "table").when(junk, "junk").when(structured, "list").otherwise("prose")
    per_word = F.when(c["all_words"] > 0, c["common"] / c["all_words"])
    return counts.select(
        "key", c["words"], c["lines"], c["chars"],
        F.round(mean, 6).alias("mean_word_length"), F.round(c["symbols"] / some, 6).alias("symbol_ratio"), F.round(c["digits"] / some, 6).alias("digit_ratio"),
        F.round(F.when(c["lines"] > 0, c["ended"] / c["lines"]), 6).alias("ended_line_share"), F.round(F.when(c["lines"] > 0, c["bullet_lines"] / c["lines"]), 6).alias("bullet_line_share"),
        F.round(per_word, 6).alias("common_word_share"), F.round(F.when(c["all_words"] > 0, c["echoes"] / c["all_words"]), 6).alias("echo_share"), kind.alias("kind"),
    )


def text_quality(df: DataFrame, key: str, text: Column, oversized: int = OVERSIZED, rules: Rules = Rules()) -> DataFrame:
    """Quality statistics and kind of each text (see ``quality_counts`` and ``ratios``).

    Null, empty and blank texts have zero counts, null ratios and a null kind. A
    heading, a lead-in or a short list inside prose changes nothing: the kind goes
    by the share of characters in lines of each sort. Other columns are not read;
    an empty table gives an empty result.
    """
    return ratios(quality_counts(df, key, text, oversized), rules)
