import pytest
from pyspark.sql import functions as F

from glotmill.functions import labels as L
from glotmill.functions import text as X
from glotmill.functions import tokens as T
from glotmill.lexicon import DetectorConfig
from glotmill.operators import detect_v1, detect_v2, detect_v3


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, ids",
    [(None, []), ("[13, 20, 21, 0]", [13, 20, 21, 0]), ("13;20", [13, 20]), (str([int(i in (3, 27)) for i in range(28)]), [3, 27]), ("[5, 99, -1]", [5]), ("['joy']", []), ("7", [7]), ("[]", [])],
)
def test_label_lists(spark, raw, ids):
    assert one(spark, raw, L.parse_label_list) == ids


def test_label_forms(spark):
    assert one(spark, "['joy', 'love']", L.encode_labels) == [2, 3]
    assert one(spark, [2, 3], lambda c: L.label_names(c), "array<int>") == ["joy", "love"]
    assert one(spark, [1], lambda c: L.multi_hot(c, 3), "array<int>") == [0, 1, 0]


@pytest.mark.parametrize("word, ok", [(w, True) for w in "gin hot cam nguyen huyen khuya quay xoong oan gi".split()] + [(w, False) for w in "good like working qu team".split()])
def test_syllables(spark, word, ok):
    assert one(spark, word, T.is_syllable) is ok


@pytest.mark.parametrize("word, ok", [(w, True) for w in "haha hehehe kk wk zzz lol hihi hahaa ckck hoho".split()] + [(w, False) for w in "hahah k wkwk zz hue".split()])
def test_laughter(spark, word, ok):
    assert one(spark, word, T.is_laugh) is ok


def test_tokens(spark):
    assert one(spark, "don't ½ ² a-b--c", T.tokens) == ["don't", "a-b", "-", "-", "c"]
    assert one(spark, "привет 谢谢 cảm_ơn x×y 한국", lambda c: T.word_tokens(T.tokens(c))) == ["привет", "cảm", "ơn", "x×y"]
    assert one(spark, "hay quá <br> 10 điểm!!", T.tokens) == ["hay", "quá", "10", "điểm", "!", "!"]
    assert one(spark, "a@b.c không phải mention", T.tokens) == ["a", "@", "b", ".", "c", "không", "phải", "mention"]


def test_text(spark):
    assert one(spark, "kkkk!!! &gt;&gt; a<br>b....", X.normalize_common) == "haha! >> a\nb..."
    assert one(spark, "Ko  dc\n roi", lambda c: X.preprocess(c, "s1")) == "không được roi"
    assert one(spark, "vui :))", lambda c: X.preprocess(c, "s2")) == "vui cười"
    assert one(spark, "đẹppppp GOOOOOD", X.shorten_runs) == "đẹpp GOOD"
    assert one(spark, "Đường Ấy", X.fold_accents) == "duong ay"
    assert one(spark, "b.\nc", lambda c: X.model_text(c, {})) == "b . c"
    assert one(spark, "a\nb", X.newline_rules) == "a. b"
    with pytest.raises(ValueError):
        X.preprocess(F.lit("x"), "s4")


SMALL = DetectorConfig(core=("good", "can", "clip"), loans=("hot", "cam"), teencode=("ko", "khong", "dm"), blacklist=("cam", "the"))


@pytest.mark.parametrize(
    "token, kind",
    [("không", "teencode"), ("đẹp", "vi"), ("don't", "other"), ("haha", "laugh"), ("ko", "teencode"), ("the", "vi"), ("cam", "vi"), ("hot", "en"), ("good", "en"), ("goooood", "en"), ("can", "en_ambiguous"), ("ban", "vi"), ("zx", "other"), ("Xyzt", "foreign"), ("xyzt", "en_guess")],
)
def test_classes(spark, token, kind):
    assert one(spark, token, lambda c: detect_v2.classify_token(c, SMALL)) == kind


def test_rows_v2(spark):
    df = spark.createDataFrame([(1, "can ban"), (2, "can good"), (3, "can xyzt"), (4, None), (5, "haha"), (6, "😂 vui")], "id int, text string")
    r = {x.id: x for x in detect_v2.annotate(df, config=SMALL).collect()}
    assert (r[1].n_english, r[2].english_tokens, r[2].n_english) == (0, "good can", 2)
    assert (r[3].n_english, r[3].english_tokens) == (1, "")
    assert (r[4].cs_group, r[4].cs_level, r[4].n_chars, r[5].cs_group, r[6].cs_group) == ("pure_vi", "none", 0, "other_noise", "emoji_only")


def test_rows_v1(spark):
    df = spark.createDataFrame([(1, "clip này hay quá"), (2, "ni hao cả nhà"), (3, "한국 clip"), (4, "đi chơi thôi"), (5, "谢谢")], "id int, text string")
    assert {x.id: x.cs_group for x in detect_v1.annotate(df).collect()} == {1: "english_mixed", 2: "chinese_mixed", 3: "multi_mixed", 4: "pure_vi", 5: "chinese_mixed"}


def test_cache_rules(spark):
    from glotmill.plans.reference import cache_rows

    cache = cache_rows(spark)
    r = {(x.id, x["_seq"]): x for x in detect_v3.clean_cache(cache).collect()}
    assert [(t.text, t.type) for t in r["0", 1].tokens] == [("deadline", "english")]
    assert [t.type for t in r["1", 2].tokens] == ["chinese_script", "chinese_translit"] and r["1", 2].langs == ["zh"]
    assert [t.type for t in r["4", 5].tokens] == ["proper_noun", "proper_noun"] and r["4", 5].has_cs is False
    assert [t.text for t in r["5", 7].tokens] == ["arigatou"]
    assert {x["_seq"] for x in detect_v3.keep_last(cache).collect()} == {1, 2, 3, 4, 5, 7}
    f = {x.id: x for x in detect_v3.summarise(detect_v3.keep_last(cache)).collect()}
    assert f["2"].llm_has_cs is False and f["3"].llm_has_cs is False and f["3"].n_loanword == 1


def test_responses(spark):
    raw = '<think>x</think>```json\n{"results": [{"id": "1", "has_cs": true, "langs": ["en"], "tokens": [], "confidence": 0.5}]}\n```'
    assert one(spark, raw, detect_v3.parse_response)[0].id == "1"
    mock = lambda texts: [{"has_cs": "a" in t, "confidence": 1.0} for t in texts]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    assert {r.id: r.has_cs for r in detect_v3.annotate_with(df, mock, "m").collect()} == {"1": True, "2": False}


def test_answers_by_id(spark):
    """Answers in another order go to the rows whose id they carry; a backend that fails once is asked again."""
    calls = []

    def backend(texts):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("busy")
        return [{"id": str(t == "a" and 1 or 2), "has_cs": t == "a"} for t in reversed(texts)]

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string").coalesce(1)
    assert {r.id: r.has_cs for r in detect_v3.annotate_with(df, backend, "m").collect()} == {"1": True, "2": False}
    assert detect_v3.aligned(["7", "8"], [{"id": "x", "n": 1}, {"id": "7", "n": 2}]) == [{"id": "7", "n": 2}, {"id": "7", "n": 2}]
    prompt = detect_v3.prompt_of([("1", "a\nb")], [("x", {"has_cs": False})])
    assert '{"id": "1", "text": "a\\nb"}' in prompt and "1 objects" in prompt


def test_strict_labels(spark):
    import pytest

    from glotmill.functions.labels import strict_label_vector

    vector = lambda x: one(spark, x, lambda c: strict_label_vector(c, 4))
    assert [vector(x) for x in ("3", "-4", "4", "[]", "[2, 9]", "(0,1)", "", None)] == [
        [0, 0, 0, 1], [1, 0, 0, 0], [0] * 4, [0] * 4, [0, 0, 1, 0], [1, 1, 0, 0], [0] * 4, [0] * 4
    ]
    with pytest.raises(Exception, match="no label number"):
        vector("[1, joy]")


def test_faster_patterns(spark):
    """The class of marked letters is the case-insensitive one; what stands before a mark counts wherever it is looked at."""
    from glotmill.lexicon import VIET_CHARS

    letters = spark.createDataFrame([(chr(i),) for i in range(1, 0x3000)], "c string")
    assert letters.where(F.col("c").rlike(T.VIET) != F.col("c").rlike(f"(?iu)[{VIET_CHARS}]")).count() == 0
    texts = ["@a b@c @@d #e f#g ##h é@i 😂@j 𝒜@k _@l .#m", "", "@", "#@a", "@a@b #c#d"]
    before = {T.MENTION: r"(?<![\p{L}\p{N}_])@[\p{L}\p{N}_.]+", T.MENTION_V1: r"(?<![\p{L}\p{N}_])@[\p{L}\p{N}_]+", T.HASHTAG: r"(?<![\p{L}\p{N}_])#[\p{L}\p{N}_]+"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for now, then in before.items():
        assert [r[0] for r in df.select(T.every(F.col("t"), now)).collect()] == [r[0] for r in df.select(T.every(F.col("t"), then)).collect()]
