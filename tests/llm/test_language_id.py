import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from govflow.llm import language_id
from govflow.llm.common import table


def plain_grams(text):
    framed = "\0"
    for c in text.lower():
        framed += c if c.isalpha() else ("" if framed[-1] == "\0" else "\0")
    framed += "" if framed[-1] == "\0" else "\0"
    out = Counter(c for c in framed if c != "\0")
    out.update(zip(framed, framed[1:], strict=False))
    out.update(t for t in zip(framed, framed[1:], framed[2:], strict=False) if t[1] != "\0")
    return out if len(framed) > 1 else Counter()


def packed(gram):
    absent, codes = int(language_id.ABSENT), [ord(c) for c in gram]
    codes = [absent] * (3 - len(codes)) + codes
    return codes[0] << 42 | codes[1] << 21 | codes[2]


def test_profiles_and_predictions_against_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TASK_GRAMS", 50)
    rng = random.Random(6)
    letters = {"aa": "abcdé", "bb": "cdefß", "cc": "xyzÄ"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))) + rng.choice(["", "!? 12", "\n"]), lang) for i in range(200) for lang in [rng.choice(list(letters))]]
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "12 !", "bb"), (303, "abc", None), (None, "abcd", "bb")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(4)
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(out) == len(rows)
    counts = {}
    for i, t, lang in rows:
        if i is not None and lang and t and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update({packed(g): n for g, n in plain_grams(t).items()})
    rank = {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language_id.PROFILE])} for lang, c in counts.items()}
    far = max(len(r) for r in rank.values())
    for i, t, _ in rows:
        own = sorted(((packed(g), n) for g, n in plain_grams(t or "").items()), key=lambda x: (-x[1], x[0]))[:far]
        if not own:
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        apart = {lang: sum(abs(r.get(g, far + k) - k) if g in r else far for k, (g, _) in enumerate(own)) for lang, r in rank.items()}
        assert out[i].lang_pred == min(sorted(apart), key=apart.get), i
        assert 0.5 <= out[i].score <= 1
        assert out[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.97


def test_nothing_learned_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()} == {(1, "und"), (2, "und")}
    assert language_id.identify(docs.limit(0)).collect() == []
    assert language_id.with_language(spark.createDataFrame([(i, "12" if i % 2 else "ab c", "aa") for i in range(8)], docs.schema)).count() == 4


def test_unlabelled_tables_keep_texts_with_language(spark):
    rows = [(i, f"some text {i}", None) for i in range(30)] + [(30, "12 34", None), (31, None, None), (32, "", None), (33, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.with_language(docs).collect()} == {*range(30), 33}
    held = docs.where(language_id.held_out()).withColumn("lang", F.lit("en"))
    assert language_id.with_language(held).count() == held.where("text rlike '[a-z漢]'").count()


def test_null_languages_are_filled_and_given_ones_stay(spark):
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en") for i in range(40)]
    rows += [(50, "die katze und der hund", None), (51, "the cat and the dog", None), (52, "the dog", "de"), (53, "12 34", "en"), (54, None, "de"), (55, "", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.lang for r in language_id.with_language(docs).collect()}
    assert kept == {**{i: lang for i, _, lang in rows[:40]}, 50: "de", 51: "en", 52: "de"}
    assert language_id.with_language(docs).columns == docs.columns


def test_long_texts_are_counted_in_slices(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcÄΣ") for _ in range(rng.randrange(1, 9))) for _ in range(500)) + "y" * 100
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "SLICE", 37)
    keys, counts = language_id.gram_counts(text)
    assert (keys == whole[0]).all() and (counts == whole[1]).all()
