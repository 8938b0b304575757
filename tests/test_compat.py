"""Compatibility composition against the character database: every code point, alone and in company; what stays in the JVM."""

import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from textquarry.functions import compat


def test_every_code_point_in_company(spark):
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [f"e{p}́ A{p}B" for p in points] + [p for p in points if unicodedata.category(p) != "Cn"] + [f"ᄒ{p}ᆫ" for p in points[:0x3200]]
    frame = spark.createDataFrame(pa.table({"text": pa.array(texts)})).repartition(8)
    wrong = frame.select("text", compat.nfkc(F.col("text")).alias("got"))

    def differing(batches):
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            bad = [t for t, g in pairs if unicodedata.normalize("NFKC", t) != g]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["text"])

    assert wrong.mapInArrow(differing, "text string").collect() == []


def test_texts_of_several_kinds(spark):
    texts = [None, "", "plain", "Été à la plage – « déjà »", "ﬁne … ½ ① x", "été", "Привет, мир", "مرحبا", "日本語テキスト", "한국어", "한", "Ｆｕｌｌ ｗｉｄｔｈ", "á̧", "\U0001f600", "ﬁ́", "½́"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").orderBy("k").select(compat.nfkc(F.col("text"))).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_accented_and_folded_texts_never_reach_python():
    assert compat.is_plain("Été à la plage – « déjà vu », ß æ œ ñ ğ ł ž") and compat.is_plain("Привет мир 日本語 한국어 مرحبا")
    assert set("ﬁﬂ…½² Ａ™") <= set(compat.folded()) and not compat.is_plain("é") and "́" not in compat.folded()
    assert len(compat.plain_runs()) < 250 and all(compat.is_plain(to) for to in compat.folded().values())


def test_ascii_is_passed_before_the_runs_are_met():
    """the runs' class is met by other characters only; right as long as all of ASCII is plain."""
    from textquarry.functions import compat

    assert compat.is_plain("".join(map(chr, range(128)))) and compat._outside([(65, 66)]) == r"(?=[^\x00-\x7F])[^\x{41}-\x{42}]"
