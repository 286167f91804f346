"""Evaluation items leaking into a corpus.

The items' texts, normalised to words, give one Aho-Corasick automaton over all
their runs of SEED words. Each corpus text is normalised in one pass that keeps,
for every word, where it stood in the original, and is scanned once. A stretch
of at least ``least`` item words with at most one edit in ``per_edit`` words must
hold at least so many seeds close together; where that many meet, the stretch is
aligned exactly.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.session import spread

SEED = 4
LEAST = 15
PER_EDIT = 6
#: A sentence that stands in more items than this belongs to none.
COMMON = 10
#: Characters of item words that one automaton is made of and that are sent to a task; more items are scanned for in several passes over the corpus.
ITEM_CHARACTERS = 16_000_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ɑ": "a", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
})
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e007f]")
INLINE_TAG = re.compile(r"(?i)</?(?:b|i|u|em|strong|span|a|font|mark|small|sub|sup|tt|wbr)(?:\s[^<>]{0,300})?/?>")
ANY_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?")
HYPHEN_BREAK = re.compile("(?<=\\w)[-\u2010\u2011][ \\t]*\\r?\\n[ \\t]*(?=[a-z])")
#: What is no text of its own: a break within a word or markup within a word (nothing stands for it), other markup (a space), and written-out characters.
MARK = re.compile(f"(?P<gone>{HYPHEN_BREAK.pattern}|(?i:{INLINE_TAG.pattern[4:]}))|(?P<gap>{ANY_TAG.pattern})|(?P<sign>{ENTITY.pattern})")
WORD = re.compile("[a-z0-9]+")


def _fold(c: str) -> str:
    """A character as the lower-case ASCII it stands for; others as they are."""
    if INVISIBLE.match(c):
        return ""
    d = unicodedata.normalize("NFKD", c).lower().translate(LOOKALIKES)
    return "".join(x for x in d if not unicodedata.combining(x))


class _Folding(dict):
    def __missing__(self, point: int) -> str:
        self[point] = got = _fold(chr(point))
        return got


FOLDING = _Folding()


def _pieces(text: str) -> list[tuple[int, int, str]] | None:
    """(start, end, what it says) of a text's pieces in order, marks apart from the text between them; None if there are no marks."""
    marked = "<" in text or "&" in text
    if not marked and ("\n" not in text or not HYPHEN_BREAK.search(text)):
        return None
    out, done = [], 0
    for m in (MARK if marked else HYPHEN_BREAK).finditer(text):
        kind = m.lastgroup if marked else "gone"
        says = "" if kind == "gone" else " " if kind == "gap" else html.unescape(m[0])
        if says == m[0]:
            continue
        if m.start() > done:
            out.append((done, m.start(), text[done : m.start()]))
        out.append((m.start(), m.end(), says))
        done = m.end()
    if not out:
        return None
    if done < len(text):
        out.append((done, len(text), text[done:]))
    return out


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(FOLDING)


def plain_words(text: str) -> list[str]:
    """The words of a text, whatever its letter case, markup, line layout and way of writing characters."""
    pieces = _pieces(text)
    return WORD.findall(_folded(text if pieces is None else "".join([p[2] for p in pieces])))


def words_with_offsets(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with offsets into the original text; the words are those of plain_words, made of the same pieces."""
    pieces = _pieces(text) or [(0, len(text), text)]
    starts, ends = [], []
    for start, end, says in pieces:
        verbatim = end - start == len(says) and text[start:end] == says
        for i, c in enumerate(says):
            n = len(_folded(c))
            starts += [start + i if verbatim else start] * n
            ends += [start + i + 1 if verbatim else end] * n
    return [(m[0], starts[m.start()], ends[m.end() - 1]) for m in WORD.finditer("".join([_folded(p[2]) for p in pieces]))]


SENTENCE = re.compile(r"(?<=[.!?])\s+")


def item_words(texts: dict[int, str], common: int = COMMON) -> dict[int, list[str]]:
    """The words of each item without the sentences that stand in more than ``common`` items."""
    parts = {k: [plain_words(s) for s in SENTENCE.split(t or "")] for k, t in texts.items()}
    stands: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for k, sentences in parts.items():
        for s in sentences:
            stands[tuple(s)].add(k)
    return {k: [w for s in sentences if len(stands[tuple(s)]) <= common for w in s] for k, sentences in parts.items()}


def seeds_needed(seed: int, least: int, per_edit: int) -> int:
    """The fewest seeds a stretch of exactly ``least`` item words with the allowed edits must hold."""
    edits = least // per_edit
    return max(1, (least - edits) - (seed - 1) * (edits + 1))


def fewest_seeds(seed: int, least: int, per_edit: int) -> int:
    """The fewest seeds any stretch of ``least`` or more item words with the allowed edits must hold.

    One more edit comes with every ``per_edit`` words, so a longer stretch may
    need fewer; from one period to the next the number only grows (or is 1).
    """
    if per_edit < seed:
        return 1
    return min(seeds_needed(seed, n, per_edit) for n in range(least, least + per_edit))


def aligned(item: list[str], doc: list[str], least: int, per_edit: int) -> tuple[int, int, int] | None:
    """(item words, first, last doc word) of the longest stretch of ``least`` or more item words with one edit in ``per_edit`` at most.

    For every first item word at once: fewest edits that turn the item's next
    words into some run of the text that ends at each word.
    """
    n, m = len(item), len(doc)
    if n < least or not m:
        return None
    starts = n - least + 1
    same = np.array([[a == b for b in doc] for a in item])
    steps = np.arange(m + 1)
    cost = np.zeros((starts, m + 1), np.int32)
    origin = np.broadcast_to(steps, (starts, m + 1)).copy()
    best: tuple[int, int, int] | None = None
    rows = np.arange(starts)
    for length in range(1, n + 1):
        live = rows + length <= n
        k = int(live.sum())
        if not k:
            break
        cost, origin = cost[:k], origin[:k]
        hit = same[np.arange(k) + length - 1]
        across = cost[:, :-1] + ~hit
        down = cost + 1
        now = down.copy()
        take = across < down[:, 1:]
        now[:, 1:] = np.where(take, across, down[:, 1:])
        came = origin.copy()
        came[:, 1:] = np.where(take, origin[:, :-1], origin[:, 1:])
        # words added in the text: the least of what stands to the left plus one a step
        lifted = now - steps
        left = np.minimum.accumulate(lifted, axis=1)
        where = np.maximum.accumulate(np.where(lifted == left, steps, 0), axis=1)
        cost = np.take_along_axis(now, where, 1) + (steps - where)
        origin = np.take_along_axis(came, where, 1)
        if length >= least:
            ok = cost * per_edit <= length
            if ok.any():
                i, j = np.argwhere(ok)[np.argmin(cost[ok])]
                best = (length, int(origin[i, j]), int(j) - 1)
    return best


def _scan(sent, seed: int, least: int, per_edit: int):
    """A pass over texts; sent is a broadcast list of (item, words)."""
    held: dict = {}
    needed = fewest_seeds(seed, least, per_edit)

    def automaton():
        if "a" not in held:
            import ahocorasick

            stands: dict[str, list[tuple[int, int]]] = defaultdict(list)
            for k, words in sent.value:
                for i in range(len(words) - seed + 1):
                    stands[" " + " ".join(words[i : i + seed]) + " "].append((k, i))
            held["of"], held["a"] = dict(sent.value), ahocorasick.Automaton()
            for pattern, where in stands.items():
                held["a"].add_word(pattern, where)
            if stands:
                held["a"].make_automaton()
        return held["a"]

    def stretches(item: list[str], words: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(item words, first, last word) of the item's stretches in a text, the longest where they overlap."""
        n = len(item)
        slack = n // per_edit + 1
        pairs.sort()
        # seeds of one stretch lie within the item's length of each other
        groups: list[list[tuple[int, int]]] = []
        for at, i in pairs:
            if groups and at - groups[-1][-1][0] <= n + slack:
                groups[-1].append((at, i))
            else:
                groups.append([(at, i)])
        got = []
        for group in groups:
            if len(group) < needed:
                continue
            # a stretch through a seed begins at most i words before it and ends at most n - i after
            lo = max(0, min(at - i for at, i in group) - slack)
            hi = min(len(words), max(at + n - i for at, i in group) + slack)
            for s in range(lo, hi, 3 * (n + slack)):
                best = aligned(item, words[s : min(hi, s + 4 * (n + slack))], least, per_edit)
                if best:
                    got.append((best[0], s + best[1], s + best[2]))
        kept: list[tuple[int, int, int]] = []
        for one in sorted(got, key=lambda g: (-g[0], g[1])):
            if all(one[2] < k[1] or one[1] > k[2] for k in kept):
                kept.append(one)
        return sorted(kept, key=lambda g: g[1])

    def leaks(text: str) -> list[tuple[int, int, int, int]]:
        words = plain_words(text)
        a = automaton()
        if len(words) < seed or not len(a):
            return []
        line = " " + " ".join(words) + " "
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        number: np.ndarray | None = None
        for end, where in a.iter(line):
            if number is None:
                number = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            at = int(number[end]) - 1 - seed
            for k, i in where:
                hits[k].append((at, i))
        found, offsets = [], None
        for k, pairs in hits.items():
            if len(pairs) < needed:
                continue
            for n, first, last in stretches(held["of"][k], words, pairs):
                offsets = offsets or words_with_offsets(text)
                found.append((k, n, offsets[first][1], offsets[last][2]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
            ids = b.column("id")
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, n, lo, hi in leaks(text) if text else ():
                    for col, v in zip(rows, (i, k, n, lo, hi)):
                        col.append(v)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), *[pa.array(r, pa.int64()) for r in rows[1:]]], ["id", "item_id", "item_words", "start", "end"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, per_edit: int = PER_EDIT, common: int = COMMON) -> DataFrame:
    """(id, item_id, item_words, start, end): every stretch of an item in a document.

    A document holds an item if at least ``least`` of the item's words stand in it
    in one stretch and in order, at most one in ``per_edit`` changed, dropped or
    added. start and end are character offsets of the stretch in the original
    text; of overlapping stretches of an item the longest is kept. The items are a
    small fixed table, read to the driver (a million rows at most, else this raises);
    they go to the tasks in portions of ITEM_CHARACTERS, each a pass over the
    corpus. Null and empty texts and items leak nothing, repeated documents each come
    out, an item of several rows is joined.
    """
    texts: dict[int, str] = {}
    for r in items.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")).filter("k is not null and t is not null").toLocalIterator():
        texts[r["k"]] = f"{texts[r['k']]} {r['t']}" if r["k"] in texts else r["t"]
        if len(texts) > 1_000_000:
            raise ValueError("more items than one scan can hold")
    portions: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for k, words in sorted((k, w) for k, w in item_words(texts, common).items() if len(w) >= least):
        if size > ITEM_CHARACTERS:
            portions.append([])
            size = 0
        portions[-1].append((k, words))
        size += sum(len(w) + 1 for w in words)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["id"], *[T.StructField(n, T.LongType()) for n in ("item_id", "item_words", "start", "end")]])
    picked, context = spread(picked), docs.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, [picked.mapInArrow(_scan(context.broadcast(p), SEED, least, per_edit), schema) for p in portions])
