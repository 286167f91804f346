import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import nodeweave.llm.leaks as leaks
import nodeweave.llm.reading as reading
from nodeweave.llm.leaks import aligned, fewest_seeds, item_words, leaked_items, plain_words, seeds_needed, words_with_offsets
from nodeweave.llm.packing import pack, plan_containers, token_counts
from nodeweave.llm.reading import blocks, prose, reading_level, sentences, within_levels


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_item_once_and_overfills_nothing(histogram):
    plan = plan_containers(histogram, 40)
    fill: dict[int, int] = {}
    for length, n in histogram.items():
        rows = [r for r in plan if r[0] == length]
        starts = [r[1] for r in rows]
        assert starts == sorted(set(starts)) and (not starts or starts[0] == 0)
        for rank in range(n):
            row = [r for r in rows if r[1] <= rank][-1]
            c = row[2] + (rank - row[1]) // row[3]
            fill[c] = fill.get(c, 0) + length
    assert all(v <= 40 for v in fill.values())
    total = sum(k * v for k, v in histogram.items())
    assert len(fill) <= 2 * -(-total // 40) + 1, "no more than best fit may need"


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 3, 7, 10, 11])) for i in range(500)] + [(1000, 57), (1001, None), (3, 7)]
    got = pack(spark.createDataFrame(rows, "id long, tokens long").withColumn("item", F.lit("clash")), capacity=20).collect()
    assert sum(r["tokens"] for r in got) == sum(t or 0 for _, t in rows)
    fill: dict[int, int] = {}
    for r in got:
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 20 and len(fill) <= 1.1 * sum(fill.values()) / 20
    assert {r["id"] for r in got if r["piece"] > 0} == {1000} and sorted(r["tokens"] for r in got if r["id"] == 1000) == [17, 20, 20]
    assert all((r["container"] is None) == (r["tokens"] == 0) for r in got)
    spans: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        if r["container"] is not None:
            spans.setdefault(r["container"], []).append((r["place"], r["place"] + r["tokens"]))
    for held in spans.values():
        held.sort()
        assert held[0][0] == 0 and held[-1][1] <= 20 and all(a[1] == b[0] for a, b in zip(held, held[1:])), "pieces stand one after another"
    assert sorted((r["first"], r["tokens"]) for r in got if r["id"] == 1000) == [(0, 20), (20, 20), (40, 17)]
    assert pack(spark.createDataFrame([], "id long, tokens long")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a " * 20_000)], "id int, t string")
    got = {r["id"]: r["tokens"] for r in token_counts(df, "id", "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 20_000


ITEM = "Under Kelur rules the unclaimed apron stays with Yariklin while a leaking filter moves through Pelon to Brenik, minus 355 piston fees and 285 tolls."


def test_leaks(spark):
    w = ITEM.split()
    disguised = ITEM.replace("e", "е").replace("rules", "ru­l​es").replace("stays", "<b>sta</b>ys").replace(" the ", "&nbsp;the ").replace("filter", "fil-\nter")
    docs = [
        (1, "Before. " + ITEM.upper() + " After."), (2, disguised), (3, "ｆｕｌｌ " + "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)), (4, " ".join(w[:6])), (5, " ".join(w[3:19])),
        (6, " ".join(w[:5] + ["changed"] + w[6:12] + w[13:16] + ["added"] + w[16:])), (7, " ".join(random.Random(1).sample(w, len(w)))), (8, ""), (9, None), (10, "Choose the memory that answers. " * 30), (11, " ".join(w[i] if i % 4 else "x" for i in range(len(w)))),
    ]
    items = [(k, "Choose the memory that answers the question and ignore the notes that share its wording or not. " + (ITEM if k == 1 else f"Item {k} says nothing of interest about number {k * 7} at all.")) for k in range(1, 13)] + [(99, None)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1)}
    one = next(r for r in got if r["id"] == 1)
    assert docs[0][1][one["start"] : one["end"]] == ITEM.upper()[:-1], "offsets are into the original"


def test_every_stretch_with_its_place_and_items_in_portions(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_CHARACTERS", 10)
    other = "Nine sturdy wagons carried salted herring over the frozen pass towards Belmora while the bells of Tarn rang for two days."
    text = f"First {ITEM} Then words between that belong to nobody at all, quite a lot of them in fact. {'x ' * 60}<p>{ITEM.lower()}</p> and {other}"
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, "too short")], "item_id long, text string")
    got = sorted((r["item_id"], r["start"], text[r["start"] : r["end"]]) for r in leaked_items(spark.createDataFrame([(7, text)], "doc_id long, text string"), items).collect())
    assert [(k, t) for k, _, t in got] == [(1, ITEM[:-1]), (1, ITEM.lower()[:-1]), (2, other[:-1])]
    assert leaked_items(spark.createDataFrame([(7, text)], "doc_id long, text string"), items.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["word", "Zwei", "naïve", "&amp;", "&#65;", "&eacute", "AT&T", "<b>", "</b>", "<p class='x'>", "<", "a-\nb", "A-\nB", "\n", " ", "­", "ﬁ", "ß", "x<i>y</i>z", "𝐚", "&lt;b&gt;"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_words_and_offsets_agree(parts):
    text = "".join(parts)
    found = words_with_offsets(text)
    assert [w for w, _, _ in found] == plain_words(text)
    assert all(0 <= a < b <= len(text) for _, a, b in found) and all(x[2] <= y[2] and x[1] <= y[1] for x, y in zip(found, found[1:]))


def test_a_stretch_of_18_words_with_3_edits_is_found(spark):
    assert fewest_seeds(4, 15, 6) == 3 and fewest_seeds(4, 15, 2) == 1
    item = [f"word{i}" for i in range(18)]
    docs = []
    # every way of leaving four runs of at least three words beside three changed or dropped ones
    for a in range(3, 13):
        for b in range(a + 4, 13):
            for c in range(b + 4, 15):
                for put in ("x", None):
                    docs.append((len(docs), " ".join(w for w in (put if i in (a, b, c) else w for i, w in enumerate(item)) if w)))
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(docs) == 40 and {r["id"] for r in got} == set(range(len(docs)))


def test_alignment_against_plain_dynamic_programming():
    def slow(item, doc, least, per):
        best = 0
        for i in range(len(item)):
            row = [0] * (len(doc) + 1)
            for n, a in enumerate(item[i:], 1):
                new = [n]
                for j, b in enumerate(doc, 1):
                    new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
                row = new
                if n >= least and min(row) * per <= n:
                    best = max(best, n)
        return best

    rng = random.Random(7)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(14)]
        doc = [rng.choice("abcdefgh") for _ in range(4)] + [x for x in item[rng.randrange(5) :] if rng.random() > 0.12] + [rng.choice("ab")]
        got = aligned(item, doc, 6, 4)
        assert (got[0] if got else 0) == slow(item, doc, 6, 4)
    assert seeds_needed(4, 15, 6) == 4


def test_normalising():
    for t in ("Plain text, 12.", "A&amp;B <i>x</i>\ny", "ＡＢ ﬁne", "so-\nft", "", "<b", "&#65;b"):
        assert [w for w, _, _ in words_with_offsets(t)] == plain_words(t)
    assert item_words({k: f"Same words here. Own {k}." for k in range(12)}, common=10)[3] == ["own", "3"]


DOC = """## Policy rk34434

The building from Gal must be checked (approx. 2.5 kg) again. See no. 7 for it!
- Write the number on the ready ticket
- Leave a copy with the desk.

2024-08-11T03:43Z walk node=dt32037 hop=2 follow=0.003 stop=0.069
| mb25289 | 601 | 0.28 |
{"id": "vw23634", "score": 0.0672, "ok": false}
```
code = 1
```
Die Kiste liegt im Lager und ist nicht offen.

End of record."""


def test_prose():
    assert len(blocks(DOC)) == 5
    words, n, vowels, seen = prose(DOC)
    assert n == 4 and seen["ticket"] == 1 and "walk" not in seen and "record" not in seen and "kiste" not in seen and "policy" not in seen
    assert words == sum(seen.values())
    assert len(sentences("It cost 2.5 units. No. It ends e.g. here. Done")) == 4
    assert prose(None)[0] == prose("")[0] == prose("| a | b |")[0] == 0
    assert prose("They care for the bird.")[2] == 5, "a final e after a consonant is silent"


def test_reading_levels_and_coverage(spark, monkeypatch):
    easy = "We put the cup by the door. The cat is on the mat. " * 5
    hard = "Notwithstanding the organisational characterisation of the intermediary documentation, the administration is obliged to operationalise the irreconcilable determination in accordance with the methodological specification. " * 3
    df = spark.createDataFrame([(1, easy), (2, hard), (3, "Too short."), (4, None), (5, ""), (1, easy)], "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = sorted((r["id"], r["level"], r["coverage_rank"], round(r["estimate"], 6)) for r in reading_level(df, "doc_id", "text").collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 1), (2, 4)]
    monkeypatch.setattr(reading, "HEAD_WORDS", 3)
    again = sorted((r["id"], r["level"], r["coverage_rank"], round(r["estimate"], 6)) for r in reading_level(df, "doc_id", "text").collect())
    assert again == got, "the joined way ranks as the one from memory"
    assert reading_level(df.limit(0), "doc_id", "text").count() == 0


def test_levels_select_by_score_and_vocabulary(spark):
    rows = spark.createDataFrame([(1, 2, 2), (2, 2, 4), (3, 4, 2), (4, 3, 3), (5, 1, 1)], "id int, level int, vocabulary_level int")
    assert sorted(r["id"] for r in within_levels(rows, 2, 3).collect()) == [1, 4]
    with pytest.raises(ValueError):
        within_levels(rows, 3, 2)


@pytest.mark.parametrize("share,want", [(0.5, 1), (1.0, 3)])
def test_coverage_rank(spark, share, want):
    text = "the " * 30 + "cat is " * 10 + "cat"
    r = reading_level(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t", share=share).first()
    assert r["coverage_rank"] == want


def test_short_texts_count_for_the_vocabulary(spark):
    text = "the " * 30 + "cat is " * 10 + "cat"
    short = [(i, "The house is in the house and the dog is in the house.") for i in range(2, 42)]
    more = reading_level(spark.createDataFrame([(1, text), *short], "i int, t string"), "i", "t", share=1.0).collect()
    assert [r["id"] for r in more] == [1] and more[0]["coverage_rank"] > 3, "words of the short texts rank before cat"
