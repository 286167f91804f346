"""Reading level of a document's English prose.

The prose of a text is what is left without logs, tables, code, headings and
closing notices, language by language. Its words are ranked by how often the
corpus uses them; the smallest frequency-ranked vocabulary that covers a fixed
share of a document's words (its coverage rank) says how rare a vocabulary a
reader needs. Sentence and word length give the grade score, and the coverage
rank and sentence complexity are calibrated against it in SQL.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.session import spread, stage

# Words that tell the languages apart, abbreviations that end no sentence, and openings of closing notices.
ENGLISH = frozenset("the a an and or of to in for on with is are was were be been by as at from that this which who it its not but has have had must may can will should if when after before where each any no some one both only into under than them they you your we he she his her their there what how do does did put keep until while during for whose him us our all most".split())
GERMAN = frozenset("der die das den dem des ein eine einen einem einer und oder nicht ist sind war wurde wird werden hat haben mit von zu zum zur im in auf für bei nach vor über unter seit bis dass wenn noch nur auch sich es er sie wir ihr darf muss kann soll alle ohne aus an am".split())
SPANISH = frozenset("el la los las un una unos unas y o no de del en por para con sin sobre entre hasta desde es son fue era ha han se lo su sus al que como más pero si ya muy nadie hace antes después debe puede esta este".split())
FRENCH = frozenset("le la les un une des du de et ou ne pas est sont était a ont été avec sans sur sous dans par pour en au aux ce cette ces qui que quoi il elle nous vous ils elles son sa ses leur plus avant après depuis doit peut y d l n s".split())
ABBREVIATIONS = frozenset("approx cf e.g i.e eg ie etc vs dr mr mrs ms prof st resp incl excl al dept est min max tel jr sr".split())
SURE = 7
NUMBERED = frozenset("no nos nr vol fig sec art ch p pp ver v".split())
CLOSINGS = re.compile(
    r"\s*(end of (record|document|file|message|notice)\b|printed copies are uncontrolled|this (memorandum|document|message|notice|e-?mail) is (furnished|provided|issued|confidential|intended)\b.*(prejudice|authori[sz]ation|recipient|confidential)?"
    r"|retention notice\b|confidentiality notice\b|disclaimer\b|all rights reserved|copyright\b|unsubscribe\b|kind regards\b|best regards\b)",
    re.I | re.S,
)
LIST_ITEM = re.compile(r"\s*(?:[*\-+•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+", re.I)
HEADING = re.compile(r"\s*#{1,6}\s")
LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b[: ])")
PAIRS = re.compile(r"\b[\w.]+=\S+")
CODE = re.compile(r"\s*(?:def |class \w+[:(]|import \w|from \w+ import|return\b.*[;)]|for \(|if \(|while \(|var |let |const |function |#include|SELECT .* FROM |INSERT INTO |CREATE TABLE |\$ |>>> |</?\w+>$|[{}();]+$)")
BLOCK_TAG = re.compile(r"(?i)<\s*(/?)\s*(p|div|br|h[1-6]|ul|ol|table|tr|section|article|blockquote)\b[^>]*>")
ITEM_TAG = re.compile(r"(?i)<\s*li\b[^>]*>")
ITEM_END = re.compile(r"(?i)<\s*/\s*li\s*>")
DROP_TAG = re.compile(r"(?is)<\s*(script|style|pre|code)\b.*?<\s*/\s*\1\s*>")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
FENCE = re.compile(r"(?s)```.*?(?:```|\Z)")
LAST_WORD = re.compile(r"[\w.]*$")
LETTERS = re.compile(r"[^\W\d_]+")
ASCII_WORD = re.compile("[a-z]+")
VOWELS = re.compile(r"[aeiouy]+")
STOP = re.compile(r"[.!?]+[\"')\]’”]*(?=\s|$)")
ASCII_LETTERS = string.ascii_letters.encode()
NO_LETTER = re.compile(r"[\W\d_]")
SILENT_E = re.compile(r"(?<=[b-df-hj-np-tv-xz])e$")

MIN_WORDS = 40
SHARE = 0.9
#: Words of the vocabulary that are looked up from memory, at most; documents that need rarer words are joined with all of it.
HEAD_WORDS = 60_000


def _junk(line: str) -> bool:
    s = line.strip()
    if not s:
        return False
    if s[0] == "|" or s.count("|") >= 2 or s.count("\t") >= 2 or LOG.match(s) or set(s) <= set("-=_*+|: "):
        return True
    if s[0] in "{[" and (s[-1] in "}]" or s[-2:] in ("},", "],")) and (":" in s or "," in s):
        return True
    if re.match(r'"[\w.]+"\s*:', s) or (s.count("=") >= 2 and len(PAIRS.findall(s)) >= 2) or CODE.match(s):
        return True
    if len(s) <= 8:
        return False
    spaces = s.count(" ")
    others = len(s.encode().translate(None, ASCII_LETTERS)) if s.isascii() else len(NO_LETTER.findall(s))
    letters = len(s) - others
    return letters < 0.5 * (len(s) - spaces)


def blocks(text: str) -> list[str]:
    """Paragraphs and list items of a text, lines joined, without logs, tables, code and headings."""
    if "```" in text:
        text = FENCE.sub("\n\n", text)
    if "<" in text:
        text = DROP_TAG.sub("\n\n", text)
        text = TAG.sub("", ITEM_END.sub("\n\n", ITEM_TAG.sub("\n\n* ", BLOCK_TAG.sub("\n\n", text))))
    if "&" in text:
        text = html.unescape(text)
    out: list[tuple[str, bool]] = []
    lines: list[str] = []
    item = False

    def close() -> None:
        if lines:
            out.append((" ".join(lines), item))
            lines.clear()

    raw = text.split("\n")
    for n, line in enumerate(raw):
        if not line.strip():
            close()
            item = False
        elif HEADING.match(line) or _junk(line):
            close()
            item = False
        else:
            start = LIST_ITEM.match(line)
            if start:
                close()
                item = True
                lines.append(line[start.end() :].strip())
            else:
                s = line.strip()
                # a heading on a line of its own right before text
                if not lines and s[-1] not in ".!?,;" and len(s.split()) <= 5 and n + 1 < len(raw) and (s[-1] == ":" or re.search(r"\b[a-z]{2}\d{4,}$", s, re.I)):
                    continue
                lines.append(s)
    close()
    kept = []
    for block, is_item in out:
        ended = block.rstrip("\"')]’” ")[-1:] in (".", "!", "?")
        if not is_item and not ended and len(block.split()) <= 8:
            continue
        kept.append(block)
    return kept


def sentences(block: str) -> list[str]:
    """Sentences of a block: a stop ends one unless it belongs to an abbreviation or a number; the block's end does too."""
    out, start = [], 0
    for m in STOP.finditer(block):
        at = m.start()
        # no abbreviation has as many as SURE letters
        if block[at] == "." and not (at - start >= SURE and block[at - SURE : at].isalpha()):
            word = LAST_WORD.search(block[max(start, m.start() - 24) : m.start()])[0].lower()
            rest = block[m.end() :].lstrip()
            if word in ABBREVIATIONS or word.rstrip(".") in ABBREVIATIONS and rest or (word in NUMBERED and rest[:1].isdigit()) or (len(word) == 1 and word.isalpha() and word != "i" and rest[:1].islower()):
                continue
        out.append(block[start : m.end()])
        start = m.end()
    if block[start:].strip():
        out.append(block[start:])
    return out


LANGUAGES = ("en", "de", "es", "fr")
#: Function word to a one in the digit (of DIGIT bits) of each of its languages, so that one sum counts for all four.
DIGIT = 24
SPOKEN = {w: sum(1 << DIGIT * k for k, v in enumerate((ENGLISH, GERMAN, SPANISH, FRENCH)) if w in v) for w in ENGLISH | GERMAN | SPANISH | FRENCH}


def language(words: list[str]) -> str:
    """The language whose function words a block has most of; none if it has none."""
    total = sum([SPOKEN[w] for w in words if w in SPOKEN])
    if not total:
        return ""
    score = [total >> DIGIT * k & (1 << DIGIT) - 1 for k in range(4)]
    return LANGUAGES[score.index(max(score))]


class _VowelGroups(dict):
    """Vowel groups of a lower-case word, at least one, kept for words seen; a final e after a consonant is none."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = n = max(1, len(VOWELS.findall(SILENT_E.sub("", word))))
        return n


VOWEL_GROUPS = _VowelGroups()


def prose(text: str | None) -> tuple[int, int, int, Counter]:
    """(words, sentences, vowel groups, word counts) of the English prose of a text."""
    n_sentences = 0
    said: list[str] = []
    unsure: list[list[str]] = []
    langs = {"": 0, **dict.fromkeys(LANGUAGES, 0)}
    for block in blocks(text or ""):
        for s in sentences(block):
            if CLOSINGS.match(s):
                continue
            low = s.lower()
            found = (ASCII_WORD if low.isascii() else LETTERS).findall(low)
            if not found:
                continue
            lang = language(found)
            langs[lang] += len(found)
            if lang == "en":
                n_sentences += 1
                said += found
            elif not lang or len(found) <= 3:
                unsure.append(found)
    if said and langs["en"] >= max(langs["de"], langs["es"], langs["fr"]):
        for found in unsure:
            n_sentences += 1
            said += found
    seen = Counter(said)
    return len(said), n_sentences, sum([VOWEL_GROUPS[w] * n for w, n in seen.items()]), seen


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 500):
            part = b.slice(s, 500)
            got = [prose(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)],
                 pa.array([list(g[3].keys()) for g in got], pa.list_(pa.string())), pa.array([list(g[3].values()) for g in got], pa.list_(pa.int32()))],
                ["id", "words", "sentences", "vowel_groups", "vocabulary", "counts"],
            )


def _covering(names: pa.Array, ranks: np.ndarray, share: float):
    """The coverage rank of each document of a batch, all at once; null where it needs a word that is not among ``names``."""
    last = np.iinfo(np.int64).max

    def run(vocabulary: pa.Array, counts: pa.Array) -> pa.Array:
        if not len(vocabulary):
            return pa.array([], pa.int64())
        lengths = vocabulary.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.index_in(vocabulary.flatten().cast(pa.string()), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        rank = np.where(at >= 0, ranks[np.maximum(at, 0)] if len(ranks) else last, last)
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((rank, row))
        said = np.cumsum(counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)[order])
        ends = np.cumsum(lengths) - 1
        before = np.concatenate(([0], said[ends[:-1]]))
        enough = said >= (before + np.ceil(share * (said[ends] - before)))[row]
        first = np.minimum.reduceat(np.where(enough, np.arange(len(row)), len(row) - 1), ends - lengths + 1)
        reached = rank[order][first]
        return pa.array(reached, pa.int64(), mask=reached == last)

    return run


def reading_level(df: DataFrame, id_col: str, text_col: str, share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, words, sentences, vowel_groups, coverage_rank, score, estimate, level, vocabulary_level) of every text with enough English prose.

    ``coverage_rank`` is the size of the smallest frequency-ranked vocabulary that
    covers ``share`` of the document's words (words equally frequent in the corpus
    share the largest of their ranks; texts too short for a row count as well). ``score`` is 0.39 words a sentence + 11.8
    vowel groups a word - 15.59, ``level`` 1 to 4 by its bounds 4, 11 and 20.
    ``estimate`` is the least-squares calibration of the score on ln(coverage
    rank) and words a sentence, so texts can be compared by vocabulary as well.
    Null, empty and foreign texts give no row; ids are taken as they come.
    """
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["id"], *[T.StructField(n, T.LongType()) for n in ("words", "sentences", "vowel_groups")], T.StructField("vocabulary", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    parsed = stage(spread(picked).mapInArrow(_parse, schema).filter("words > 0"), "prose")
    docs = parsed.filter(F.col("words") >= min_words)
    used = stage(parsed.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("x")).groupBy(F.col("x.vocabulary").alias("word")).agg(F.sum("x.counts").alias("n")), "vocabulary")
    # words of one frequency are one class; the number of classes is at most the root of twice the corpus
    classes = used.groupBy("n").agg(F.count("*").alias("k")).withColumn("rank", F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    classes = stage(classes.select("n", "rank"), "classes")
    ranked = used.join(F.broadcast(classes), "n").select("word", "rank")
    head = ranked.filter(F.col("rank") <= HEAD_WORDS).toArrow()
    names = head.column("word").combine_chunks().cast(pa.string()) if head.num_rows else pa.array([], pa.string())
    table = df.sparkSession.sparkContext.broadcast((names, head.column("rank").to_numpy().astype(np.int64)))

    @F.arrow_udf("long")
    def covering(vocabulary: pa.Array, counts: pa.Array) -> pa.Array:
        return _covering(*table.value, share)(vocabulary, counts)

    first = stage(docs.withColumn("coverage_rank", covering("vocabulary", "counts")), "covered")
    covered = first.filter("coverage_rank is not null").select("id", "words", "sentences", "vowel_groups", "coverage_rank")
    if not first.filter("coverage_rank is null").isEmpty():
        rare = first.filter("coverage_rank is null").drop("coverage_rank").withColumn("row", F.monotonically_increasing_id())
        rare = stage(rare, "rare")
        each = rare.select("row", "words", F.explode(F.arrays_zip("vocabulary", "counts")).alias("x")).select("row", "words", F.col("x.vocabulary").alias("word"), F.col("x.counts").alias("c")).join(ranked, "word")
        run = Window.partitionBy("row").orderBy("rank", "word").rowsBetween(Window.unboundedPreceding, 0)
        reached = each.withColumn("run", F.sum("c").over(run)).filter(F.col("run") >= F.ceil(F.lit(share) * F.col("words"))).groupBy("row").agg(F.min("rank").alias("coverage_rank"))
        covered = covered.unionByName(rare.join(reached, "row").select("id", "words", "sentences", "vowel_groups", "coverage_rank"))
    scored = covered.withColumn("score", 0.39 * F.col("words") / F.col("sentences") + 11.8 * F.col("vowel_groups") / F.col("words") - 15.59)
    return calibrate(stage(scored, "scored"))


def level_of(score: F.Column) -> F.Column:
    """The level of a grade score."""
    return F.when(score < 4, 1).when(score < 11, 2).when(score < 20, 3).otherwise(4)


def calibrate(scored: DataFrame) -> DataFrame:
    """scored with ``estimate``, ``level`` and ``vocabulary_level``; the calibration is one SQL aggregate over all documents.

    ``estimate`` is what vocabulary and sentence length let expect of the score, and
    ``vocabulary_level`` its level: a text of rare words in short sentences has a higher one than its score says.
    """
    fit = scored.sparkSession.sql(
        """
        with d as (select score as y, ln(coverage_rank) as v, words / sentences as s from {scored}),
        m as (select avg(y) as y, avg(v) as v, avg(s) as s, covar_pop(v, y) as vy, covar_pop(s, y) as sy,
                     var_pop(v) as vv, var_pop(s) as ss, covar_pop(v, s) as vs from d)
        select y, v, s, vv * ss - vs * vs as det, vy * ss - sy * vs as bv, sy * vv - vy * vs as bs from m
        """,
        scored=scored,
    ).first()
    det = fit["det"] if fit["det"] and abs(fit["det"]) > 1e-12 else None
    bv, bs = (fit["bv"] / det, fit["bs"] / det) if det else (0.0, 0.0)
    mean = [fit[c] or 0.0 for c in ("y", "v", "s")]
    estimate = F.lit(mean[0]) + bv * (F.log("coverage_rank") - mean[1]) + bs * (F.col("words") / F.col("sentences") - mean[2])
    return scored.select("id", "words", "sentences", "vowel_groups", "coverage_rank", "score", estimate.alias("estimate"), level_of(F.col("score")).alias("level"), level_of(estimate).alias("vocabulary_level"))


def within_levels(levels: DataFrame, least: int, most: int) -> DataFrame:
    """The documents of reading_level whose score and whose vocabulary both are from level ``least`` to ``most``."""
    if not 1 <= least <= most <= 4:
        raise ValueError("levels go from 1 to 4")
    return levels.filter(F.col("level").between(least, most) & F.col("vocabulary_level").between(least, most))
