"""Sentence boundaries of hand-cut texts, and what holds for any text."""

import random

import pytest

from weftline.llm import sentences
from weftline.llm.sentences import sentence_texts

CASES = [
    ["Dr. A. B. Lee met Mrs. Poe at 5 p.m. with reel No. 3.", "It cost $6.9 million vs. $3.1 million."],
    ["Most of it was shot in the U.S.", "The U.S. release slipped.", "They packed props, wigs, etc.", "Props etc. filled it."],
    ["“Hold it. Again?” Ann Lee said, folding it.", "“Stop!” shouted Bo.", "He only said, “Hold it.”", "It ended."],
    ["He asked \"again?\" and left.", "Mrs. Lee (the one. No, the other) left.", "(It was never found.)", "It left."],
    ["Wait... it moves!", "Nobody slept?!", "The file cut_v3.26.mov was lost.", "would watch it again.", "loved it 🎬."],
    ["„Die Rolle fehlt. Ach!“, rief sie.", "Die 18. Klappe kam am 9. März, d. h. z. B. um 9.10 Uhr.", "Er sagte: „nein.“", "Es war 2013.", "Ende usw."],
    ["—¡Corten! —gritó Ana.", "El Sr. Paz llegó a las 8:40 p. m. con el rollo núm. 5.", "¿Era así?", "¡Qué luz!"],
    ["« Encore ! » cria Zoé.", "Il dit : « non. »", "M. Roy hésite... puis signe.", "Fin."],
    ["В 1985 г. группа переехала в г. Тамск, т. е. далеко.", "Взяли кабели и т. д.", "«Ещё раз!» — крикнул он."],
    ["كتب أ. روفيل ذلك.", "هل كانت قديمة؟", "«الضوء!» صاح من بعيد."],
    ["डॉ. राम आए।", "बजट 5.6 करोड़ रु. था।", "“एक बार। फिर।” राम ने कहा।", "क्या?"],
]
DENSE = [
    ["谁写了“再来？”这几个字？", "“再来。走。”柯澜说。", "他说：“再来。”", "（没有。）", "这个嘛……还好。"],
    ["「光。消。」と言った。", "予算は8.6億円だった。", "まあ……悪い。", "なんと！"],
]


@pytest.mark.parametrize("want,blank", [(c, b) for c in CASES for b in (" ", "\t", "  ", "\n\n", "\n \n")] + [(c, "") for c in DENSE])
def test_cases(spark, want, blank):
    got = sentence_texts(spark.createDataFrame([(1, blank.join(want))], "doc long, text string")).orderBy("sent_start").collect()
    assert [r["sentence"] for r in got] == want


def test_layout_and_thai(spark):
    texts = {
        1: "NOTES\n\nOne line\nwrapped. Two.\n- a list\n- of things\n\nQ: “Hold it. Now?” Bo said. A: no.High time.",
        2: "งบราว 7.2 ล้านบาท ทีมงานต่าง ๆ ย้าย “แสง หมด” ลาเวนตะโกน ม้วนที่ 26 ในมือ ดร.เซลิมมา",
        3: None, 4: "", 5: " \n\t ", 6: "no end", 7: " kept. Next.",
    }
    rows = sentence_texts(spark.createDataFrame(list(texts.items()), "doc long, text string")).orderBy("doc", "sent_start").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["doc"], []).append(r["sentence"])
    assert by == {
        1: ["NOTES", "One line\nwrapped.", "Two.", "- a list", "- of things", "Q: “Hold it. Now?” Bo said.", "A: no.", "High time."],
        2: ["งบราว 7.2 ล้านบาท", "ทีมงานต่าง ๆ ย้าย", "“แสง หมด” ลาเวนตะโกน", "ม้วนที่ 26 ในมือ", "ดร.เซลิมมา"],
        6: ["no end"],
        7: [" kept.", "Next."],
    }


LONG = "It went on. And on? " * 100


@pytest.mark.parametrize("times", [1, 50])
@pytest.mark.parametrize("marks", ["\"\"", "“”", "„“", "«»", "「」", "『』", "‘’", "''", "()", "（）", "[]"])
def test_long_quotations_stay_whole(spark, marks, times):
    """2,000 and 100,000 characters between two marks are one sentence with the words before them."""
    inner = (LONG * times).strip()
    want = [f"He read {marks[0]}{inner}{marks[1]} twice.", "It ended."]
    got = sentence_texts(spark.createDataFrame([(1, " ".join(want))], "doc long, text string")).orderBy("sent_start").collect()
    assert [r["sentence"] for r in got] == want


ADDRESSES = [
    ["See https://example.com/watch?v=9 now.", "Done."], ["See https://example.com/watch?V=9 now.", "Done."],
    ["It is at https://Example.Com/A?Query=B!x and www.Example.Org/Zoo.", "Go."], ["Ask J.Smith@Example.Org or a.B@c.De.", "He knows."],
    ["Read (see http://A.B/C?D=E.F) first.", "Then rest."], ["见 https://Example.com/A.B。", "然后走。"], ["Anna has a Ph.D. from Oslo.", "Mgr. Dvorak met Pvt. Hale.", "Hmm.", "No."],
    ["He (the one [No. Yes. (Maybe. Or?)] here. Hm.) left.", "She (no. yes", "A (b) c.", "D."], ["“Go (now. Or. never.) Please. Now.” Bo said.", "He (said “go. now.” And. Left) slept."],
]


@pytest.mark.parametrize("want", ADDRESSES)
def test_addresses_and_nesting(spark, want):
    text = "\n\n".join(want) if "She (no. yes" in want else ("" if "见" in want[0] else " ").join(want)
    got = sentence_texts(spark.createDataFrame([(1, text)], "doc long, text string")).orderBy("sent_start").collect()
    expect = want if "She (no. yes" not in want else [want[0], "She (no.", "yes", *want[2:]]
    assert [r["sentence"] for r in got] == expect


def test_thai_in_long_brackets(spark):
    inner = "แสง หมด " * 800
    text = f"ทีมงาน ({inner}จบ) ลาเวนตะโกน"
    got = sentence_texts(spark.createDataFrame([(1, text)], "doc long, text string")).collect()
    assert max(len(r["sentence"]) for r in got) >= len(inner)


def test_marks_without_partner_take_no_square_time(spark):
    texts = ["( a. b “c. ‘d 'e " * 20_000, "'tis so. " * 20_000, "— a. " * 50_000, "(((" * 50_000, "a.b@" * 30_000, "http://a.b?" * 20_000]
    assert sentence_texts(spark.createDataFrame(list(enumerate(texts)), "doc long, text string")).groupBy("doc").count().count() == len(texts)


def test_single_marks_in_long_texts(spark, monkeypatch):
    """Setting marks aside in long texts changes nothing."""
    rng = random.Random(2)
    parts = ["'tis. ", "'Go. On.' ", "don't. ", "the '90s. ", "'", "“He. 'So. It.' ” ", "word ", "\n\n", "x' ", "(it's. 'No. ) "]
    df = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(40))) for i in range(300)], "doc long, text string")
    want = sentence_texts(df).collect()
    monkeypatch.setattr(sentences, "_LONG", 0)
    assert sorted(sentence_texts(df).collect()) == sorted(want)


def test_every_character_once(spark):
    rng = random.Random(9)
    parts = ["Dr. ", "word ", "“", "”", "(", ")", "。", "！", ". ", "? ", "\n", "\n\n", "...", "ก ข ", "— ", "'", "\"", "«", "»", "🎬 ", "3.5 ", "­", "Q: ", "- "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([5, 60, 3000]))) for _ in range(60)]
    rows = sentence_texts(spark.createDataFrame(list(enumerate(texts)), "doc long, text string")).orderBy("doc", "sent_start").collect()
    ends = dict.fromkeys(range(len(texts)), 0)
    for r in rows:
        text, a, b = texts[r["doc"]], r["sent_start"], r["sent_end"]
        assert text[a:b] == r["sentence"] == r["sentence"].strip() and not text[ends[r["doc"]] : a].strip()
        ends[r["doc"]] = b
    assert all(not texts[d][e:].strip() for d, e in ends.items())
