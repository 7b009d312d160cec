import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stipple.llm import bpe, packing, queries, sentences

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return bpe.PairIndexEncoder()


def encoded(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text_is_encoded_as_by_the_library(reference, encoder, texts):
    assert encoded(encoder, texts) == [reference(t) for t in texts]


def test_runs_and_long_texts(reference, encoder):
    texts = ["a" * n for n in range(30)] + ["ab" * 500, "  \n\n x  ", "<|endoftext|>", "don't 12345", "各駅 हर संग", "x" * 20_000 + " " * 5_000]
    assert encoded(encoder, texts) == [reference(t) for t in texts]


def test_encode_corpus(spark, reference):
    docs = spark.createDataFrame([(1, "The tram.", "k"), (2, None, "k"), (3, "", None), (1, "The tram.", "k")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(docs).collect())
    assert got == [(1, reference("The tram."))] * 2 + [(2, []), (3, [])]
    assert bpe.encode_corpus(docs.filter("false")).count() == 0
    assert sorted((r["doc_id"], r["n_tokens"]) for r in bpe.token_counts(docs).collect()) == [(1, len(reference("The tram.")))] * 2 + [(2, 0), (3, 0)]


def best_padding(lengths, counts, k):
    best = {0: 0}
    for _ in range(k):
        new = {}
        for i, c in best.items():
            for j in range(i + 1, len(lengths) + 1):
                v = c + sum(n * (lengths[j - 1] - x) for x, n in zip(lengths[i:j], counts[i:j], strict=True))
                new[j] = min(new.get(j, 1e18), v)
        best = {**new}
        if len(lengths) in best:
            out = best[len(lengths)]
    return out


def test_bucket_bounds_have_the_least_padding():
    r = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 60), 8)))
        counts = np.array([r.randrange(1, 9) for _ in lengths])
        b = packing.bucket_bounds(lengths, counts, 64, buckets=3)
        at = b[np.searchsorted(b, lengths)]
        assert len(b) <= 3 and (counts * (at - lengths)).sum() == best_padding(lengths.tolist(), counts.tolist(), 3)


def check_packing(rows, sizes, caps):
    for b, cap in caps.items():
        mine = [r for r in rows if r["budget_id"] == b]
        room, got = {}, {}
        for r in mine:
            got.setdefault(r["doc_id"], []).append((r["piece"], r["start_at"], r["n_units"]))
            if r["container_id"] is not None:
                room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_units"]
        assert max(room.values(), default=0) <= cap and set(room) == set(range(len(room)))
        for d, n in sizes.items():
            pieces = sorted(got[d])
            assert sum(p[2] for p in pieces) == (n or 0) and (len(pieces) == 1 or n > cap)
            assert [p[1] for p in pieces] == [sum(x[2] for x in pieces[:i]) for i in range(len(pieces))]


def test_packing(spark):
    r = random.Random(2)
    sizes = {i: r.choice([0, 1, 5, 30, 31, 64, 65, 200, r.randrange(1, 100)]) for i in range(400)} | {400: None, 401: 1000}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id long, n_tokens long, piece string")
    caps = {7: 64, 9: 10, 11: 4096}
    rows = packing.pack(df, caps, buckets=16, rows_per_rank_task=50).collect()
    check_packing(rows, sizes, caps)
    used = {r["container_id"] for r in rows if r["budget_id"] == 7 and r["container_id"] is not None}
    assert sum(v or 0 for v in sizes.values()) / (len(used) * 64) > 0.9
    assert packing.pack(df.filter("false"), caps).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {})


def lexicon():
    words = "the a crew opened under this harbour sold its fair committee near over quarry".split()
    rows = [("en", w, 1000, 5, 5, 0) for w in words] + [("en", w.title(), 200, 1, 1, 0) for w in words]
    rows += [("en", "Dr", 50, 50, 0, 0), ("en", "fig", 40, 40, 0, 0), ("en", "Wickbel", 30, 9, 0, 0)]
    rows += [("de", w, 1000, 0, 0, 0) for w in ("die", "der", "eine", "baute", "neue")] + [("de", w, 300, 0, 0, 0) for w in ("Die", "Der", "Markt", "Garten")]
    rows += [("hi", "देखा", 50, 0, 48, 0), ("hi", "रु", 50, 50, 0, 0), ("ar", "قال", 50, 0, 0, 40)]
    return sentences.Lexicon(rows)


def units(text, boxes=None, lang="en"):
    starts = sentences.unit_starts(text, lang, None if boxes is None else np.array(boxes), lexicon())
    assert starts == sorted(set(starts))
    return [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])]  # noqa: B905


@pytest.mark.parametrize(
    "text,n",
    [
        ("The crew opened. A fair sold.", 2),
        ("The crew of Dr. Wickbel opened fig. 3.50 near the fair. A fair sold!", 2),
        ("The crew opened. . . under the fair... 3.5 sold.", 1),
        ("“The crew opened,” said Wickbel. “A fair sold?” asked Wickbel the crew.", 2),
        ("“The crew opened. A fair sold.” The committee opened.", 3),
        ("Wickbel said: “The crew opened.” A fair sold.", 2),
        ("The crew opened under the fair The committee sold", 2),
        ("The crew opened, under the fair, The committee sold.", 2),
        ("The crew opened.The committee sold.", 2),
        ("THE CREW OPENED UNDER\nTHE FAIR\nThe committee sold.", 2),
        ("The com-\nmittee opened. The fair\nsold.", 2),
        ("The crew opened\x0cunder the fair. Its committee sold.", 2),
    ],
)
def test_units_of_a_script_with_capitals(text, n):
    assert len(units(text)) == n, units(text)


@pytest.mark.parametrize(
    "text,n,lang",
    [
        ("この港は開いた。各船が17.5円で「夜に\n閉じた。」冬は来た!", 3, "ja"),
        ("「この港は閉じた?」島谷と言った。各夜が来た。", 2, "ja"),
        ("यह मौसम देखा। एक रु. 5.50 में बाग देखा| यह देखा एक बाग था?", 4, "hi"),
        ("هذه الجسر كان أمس؟ كل السفينة فتح، بين اللجنة.", 2, "ar"),
        ("ตลาดปิดที่เรือ เก่าสะพานขาย 13.37 บาท และหลาย", 2, "th"),
        ("Die neue baute 5. Markt. Der Garten baute 14. Markt Die neue.", 3, "de"),
        ("오늘은 비가 왔다. 우리는 집에 있었다! 내일은 갈까?", 3, "ko"),
        ("הספינה הגיעה אתמול. הנמל נפתח? הוועדה התכנסה.", 3, "he"),
        ("জাহাজ এসেছে। বন্দর খোলা হল। কমিটি বসেছে।", 3, "bn"),
        ("கப்பல் வந்தது. துறைமுகம் திறந்தது. குழு கூடியது.", 3, "ta"),
        ("ఓడ వచ్చింది. రేవు తెరిచారు. సంఘం కూడింది.", 3, "te"),
        ("გემი მოვიდა. პორტი გაიხსნა. კომიტეტი შეიკრიბა.", 3, "ka"),
        ("នាវាមកដល់។កំពង់ផែបើក។ គណៈកម្មាធិការជួបជុំ។", 3, "km"),
        ("သင်္ဘောရောက်သည်။ဆိပ်ကမ်းဖွင့်သည်။ ကော်မတီစုသည်။", 3, "my"),
        ("መርከቡ ደረሰ። ወደቡ ተከፈተ። ኮሚቴው ተሰበሰበ።", 3, "am"),
        ("Նավը եկավ։ Նավահանգիստը բացվեց։ Հանձնաժողովը հավաքվեց։", 3, "hy"),
        ("the crew opened. a fair sold near dr. wickbel. its committee sold!", 3, "en"),
    ],
)
def test_units_of_other_scripts(text, n, lang):
    assert len(units(text, lang=lang)) == n, units(text, lang=lang)


def test_columns_headline_and_advert_by_boxes():
    lines = [("the fair sold", 0, 0, 50), ("The crew opened", 0, 60, 30), ("under the fair.", 500, 60, 30), ("***THE FAIR SOLD. ITS CREW OPENED", 22, 100, 30), ("near the", 0, 140, 30), ("Its committee sold.", 500, 140, 30)]
    text = "\n".join(x[0] for x in lines)
    boxes = [(x, y, x + 400, y + h) for _, x, y, h in lines]
    starts = sentences.unit_starts(text, "en", np.array(boxes), lexicon())
    assert [text[s : s + 8] for s in starts] == ["the fair", "The crew", "***THE F", "ITS CREW", "Its comm"]


def test_nulls_blanks_and_openers(spark):
    assert units("") == units("  \n ") == [] == sentences.unit_starts(None, None, None, lexicon())
    assert units("  “The crew opened.”")[0][0] == "“"
    docs = [(1, "The crew sold.", "en", None), (2, None, "en", None), (3, " \n", None, None), (4, "The crew opened.\nA fair sold.", None, [(0, 0, 9, 9, 0.5)])]
    kind = "doc_id long, text string, lang string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    df = spark.createDataFrame(docs, kind)
    got = sorted((r["doc_id"], r["start_char"]) for r in sentences.sentence_units(df).collect())
    assert got == [(1, 0), (4, 0), (4, 17)]
    assert sentences.sentence_units(df.filter("false")).count() == 0


def test_word_counts_keep_frequent_words_only(spark):
    df = spark.createDataFrame([("a a a a b", "en")], "text string, lang string")
    assert {r["word"]: r["n"] for r in sentences.word_counts(df, "text", "lang", rarest=2).collect()} == {"a": 4}


def test_columns_run_together_and_the_rest_of_the_right_one():
    rows = [("The crew opened\tunder the fair.", 0, 0), ("near the\tThe harbour", 0, 40), ("sold.", 500, 80)]
    text = "\n".join(r[0] for r in rows)
    boxes = np.array([(x, y, x + 900, y + 30) for _, x, y in rows])
    starts = sentences.unit_starts(text, "en", boxes, lexicon())
    assert [text[s : s + 6] for s in starts] == ["The cr", "The ha"]
    lines, known = sentences.page_lines(text, boxes)
    order = [text[v.begin : v.end] for _, part in sentences.streams(text, lines, known, set()) for v in part]
    assert order == ["The crew opened", "near the", "under the fair.", "The harbour", "sold."]


@pytest.mark.parametrize(
    "text,n",
    [
        # Lower case on the page makes a word ordinary that the corpus does not know.
        ("The crew sold lanterns under lanterns near lanterns. A fair opened Lanterns sold.", 3),
        # Capitals within sentences make a name of a word that the corpus knows as ordinary.
        ("Wickbel met Harbour, and Harbour sold. A fair opened, Harbour near Harbour sold.", 2),
        # Stops before a comma and lower case make an abbreviation, unless the word also stands without.
        ("The crew sold qtys. to a fair, under qtys., near qtys. Wickbel opened.", 1),
        ("The crew sold qtys to a fair, under qtys near qtys. Wickbel opened.", 2),
    ],
)
def test_the_page_decides_before_the_corpus(text, n):
    assert len(units(text)) == n, units(text)


def test_units_with_their_whole_text(spark, tmp_path):
    long = "The crew opened " + "near the fair " * 40 + "sold."
    lines = [("A fair sold. The crew", 0, 0), ("***THE FAIR SOLD", 22, 40), ("opened near the fair.", 0, 80)]
    text = "\n".join(v[0] for v in lines)
    boxes = [(x, y, x + 400, y + 30, 0.5) for _, x, y in lines]
    kind = "doc_id long, text string, lang string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    spark.createDataFrame([(1, long + " A fair sold.", "en", None), (2, text, "en", boxes), (3, None, "en", None)], kind).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["unit"]): r for r in queries.p8_units(spark, str(tmp_path)).collect()}
    assert got[1, 0]["text"] == long and got[1, 0]["end_char"] == len(long) and got[1, 1]["text"] == "A fair sold."
    assert [got[2, u]["text"] for u in range(3)] == ["A fair sold.", "The crew\nopened near the fair.", "***THE FAIR SOLD"]
    assert len(got[2, 1]["spans"]) == 2 and all(r["spans"][0]["begin"] == r["start_char"] for r in got.values())
