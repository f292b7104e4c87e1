"""Scalars on pairs of input and expected value."""

import struct

import pytest
from pyspark.sql import functions as F

from lectern.functions import audio, citations, markup, notation, numbers, replies, speak, verify
from lectern.functions import text as T


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {'long' if isinstance(inputs[0], int) else 'string'}")
    return [r[1] for r in sorted(df.select("i", fn(F.col("x")).alias("y")).collect())]


PAIRS = [
    (numbers.int_to_words, {0: "zero", 7: "seven", 21: "twenty-one", 100: "one hundred", 342: "three hundred forty-two", 1005: "one thousand five", 1_000_000: "one million", 10**9: "one zero zero zero zero zero zero zero zero zero", -12: "minus twelve"}),
    (numbers.number_to_words, {"0.05": "zero point zero five", "-2.4": "minus two point four", "1,234.5": "one thousand two hundred thirty-four point five", ".5": "zero point five", "12": "twelve"}),
    (numbers.year_to_words, {2019: "twenty nineteen", 2005: "two thousand five", 1900: "nineteen hundred", 2000: "two thousand", 1905: "nineteen oh five", 999: "nine hundred ninety-nine"}),
    (numbers.section_to_words, {"2.3.1": "two point three point one", "6.10": "six point ten", "A.2": "A point two"}),
    (lambda c: notation.voiced(c, "decade"), {"the 1890s, 1900s and 2000s": "the eighteen nineties, nineteen hundreds and two thousands", "2010s": "twenty tens"}),
    (lambda c: notation.voiced(c, "reference"), {"see Section 2.3.1 here": "see Section two point three point one here"}),
    (lambda c: notation.voiced(c, "range"), {"10–12 and 1.5 - 2": "10 to 12 and 1.5 to 2"}),
    (lambda c: notation.voiced(c, "power"), {"x^2 y^{-3} z^10": "x squared y to the minus three z to the ten"}),
    (T.normalize_ligatures, {"eﬃcient ﬁt": "efficient fit"}),
    (T.dehyphenate, {"exam-\nple of\n  lines": "example of lines", "PYR– PP2C": "PYR–PP2C"}),
    (T.rejoin_split_tokens, {"g s and H2 O2": "gs and H2O2"}),
    (T.classify_block, {"[12] Smith": "reference_list", "Figure 2.1: A plot": "figure_caption", "CHAPTER 3": "heading", "2.3 Methods": "heading", "Just words.": "paragraph", "Figure 2.1 shows": "paragraph"}),
    (T.is_title_spillover, {"and other things": True, "And it ended.": False, "nothing here": False}),
    (T.segment, {"Hi. See Fig. 3 e.g. this! Go http://x.y/z. On": ["Hi. ", "See Fig. 3 e.g. this! ", "Go http://x.y/z. On"], "": [], "no end": ["no end"]}),
    (T.strip_heading_enumerator, {"III.A.1. RESULTS": "RESULTS", "2.3 Methods": "Methods", "IV.": "IV."}),
    (T.heading_key, {"I. INTRODUCTION": "introduction", "Introduction": "introduction"}),
    (T.slugify, {"A  Thesis: on X!": "a-thesis-on-x", "!!": "untitled"}),
    (T.fix_mojibake, {"Scholander ¨ said": "Scholander said", "inter- ´ faces": "interfaces", "plain  text": "plain  text"}),
    (citations.naturalize_citations, {"dynamics.41 shown (Geiger et al., 2009) as Chalmer et al. note [12, 3]. Group.20, 21 Bud.118": "dynamics. shown as Chalmer and others note. Group. Bud.118", "kept (Summer 2020) and Fig.3": "kept (Summer 2020) and Fig.3"}),
    (citations.equation_announcement, {r"a=b \tag{2.4}": "Equation two point four.", "x (3.1)": "Equation three point one.", "x": None}),
    (citations.find_narrative_mentions, {"Smith et al. and Jones et al. but Smith et al.": ["Smith et al.", "Jones et al."]}),
    (markup.clean_markup, {
        "plain text": "plain text", "xylem.<sup>31</sup> next": "xylem. next", "8.<sup>314</sup> J": "8.314 J", "10<sup>5</sup>": "10 to the power of 5", "m<sup>2</sup>": "m squared", "shown<sup>12</sup> here": "shown here",
        "CO<sup>2</sup>": "CO2", "**bold** and *it*": "bold and it", r"$\psi_{xyl}$ is": "psi xyl is", r"$\frac{a}{b} \leq \Delta$": "a over b less than or equal to delta", "a&gt;b": "a greater than b", "40<sup>o</sup>C": "40 degrees C",
    }),
    (markup.split_display_math, {"$$a=b$$ (1.4)": r"a=b \tag{1.4}", "$$x$$": "x", "text $$x$$": None}),
    (replies.narration, {"```\nHello\n```": "Hello", '"Quoted"': "Quoted"}),
    (replies.is_audit, {'{"issues": []}': True, "{}": False, "no": False}),
    (audio.wav_duration, {}),
]


@pytest.mark.parametrize("fn,cases", [p for p in PAIRS if p[1]], ids=lambda x: getattr(x, "__name__", ""))
def test_pairs(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


SPEAK = {
    "p<0.05 at 37% in Section 2.3.1, see http://a.b/c.": "p less than zero point zero five at thirty-seven percent in Section two point three point one, see the link in the text.",
    "CO2 of 56mM and 512x512": "C O two of fifty-six millimolar and five hundred twelve times five hundred twelve",
    "abscisic acid (abscisic acid) [12] C3": "abscisic acid twelve C three",
    "ψ_xyl 1890s 10–12": "xylem water potential eighteen nineties ten to twelve",
    "billons of gs": "billion of stomatal conductance",
    "plain words, here .": "plain words, here.",
}


def test_normalizer(spark):
    assert values(spark, speak.normalize_all, list(SPEAK)) == list(SPEAK.values())
    for said in SPEAK.values():
        assert speak.normalize(said) == said
        assert not set(said) & set("%±^_<>[]µμ−")


def test_normalizer_of_links_alone(spark):
    texts = [
        "The data are at www.example.com for every reader.", "See www.a.b.", "www.x.org, www.y.org and more", "at https://x.y/z now", "http://a.b", "on arxiv.org/abs here",
        "the link in the text. the link in the text, here", "the link in the text once", "the www of things", "awww.yes it is", "(www.a.b)",
    ]
    got = values(spark, speak.normalize_all, texts)
    assert got == [speak.normalize(t) for t in texts]
    assert got[0] == "The data are at the link in the text for every reader."


def test_python_numbers_match_columns(spark):
    ns = [0, 5, 13, 40, 99, 100, 101, 999, 1000, 1001, 123_456, 999_999_999, 10**9, 7_000_014]
    assert values(spark, numbers.int_to_words, ns) == [notation.cardinal(n) for n in ns]
    tokens = ["0.5", "-3", "1,000", "12.05", "7."]
    assert values(spark, numbers.number_to_words, tokens) == [notation.numeral(t) for t in tokens]


def test_repetition(spark):
    got = values(spark, T.collapse_repetition, ["x x x x x x x x end of it", "E, and E, and E, and E, and done now", "all fine words here and nothing else to see"])
    assert [tuple(r) for r in got] == [("x end of it", 7), ("E, and done now", 6), ("all fine words here and nothing else to see", 0)]


VERDICTS = [
    ("The ratio rose by 2.5 and 37% was not lost", "The ratio rose by two point five and thirty-seven percent was not lost", set()),
    ("It was 0.4 MPa", "It was MPa", {"values"}),
    ("It was 0.4 then 0.7", "It was zero point seven then zero point four", {"values"}),
    ("It did not work", "It did work", {"polarity"}),
    ("only some of it", "of it", {"polarity"}),
    ("rates increased", "rates decreased", {"direction"}),
    ("plain words", "plain words 5", {"speakable"}),
    ("see Figure 2.1 now", "see the figure now", set()),
    ("short", "apples bananas cherries dates figs grapes", {"paraphrase"}),
    ("a value of -2.4 here", "a value of negative two point four here", set()),
]


def test_verifier(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(VERDICTS)], "i int, a string, b string")
    got = {r.i: r.v for r in df.select("i", verify.verify_segment(F.col("a"), F.col("b")).alias("v")).collect()}
    for i, (_, _, kinds) in enumerate(VERDICTS):
        assert {v.kind for v in got[i].violations} == kinds and got[i].ok == (not kinds), VERDICTS[i]


def test_copyedit_guard(spark):
    cases = [("the responce was", "the response was", True), ("five cells", "nine cells", False), ("did not work", "did work", False), ("rates increased", "rates decreased", False), ("fusedword here", "fused word here", True), ("a big cell", "a cell", False), ("is", "are", True), ("same", "same", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r[1] for r in sorted(df.select("i", verify.copyedit_guard(F.col("a"), F.col("b"))).collect())]
    assert got == [c[2] for c in cases]


def test_wave_files(spark):
    df = spark.createDataFrame([("x" * 30,), ("",)], "t string").select(audio.silent_wav(audio.seconds_of(F.col("t"))).alias("w"))
    got = df.select("w", audio.wav_duration(F.col("w")).alias("s")).collect()
    assert got[0].s == pytest.approx(2.0) and got[1].s == pytest.approx(1 / 22050) and bytes(got[0].w[:4]) == b"RIFF"
    assert spark.createDataFrame([(bytearray(b"no"),)], "w binary").select(audio.wav_duration(F.col("w"))).first()[0] is None


def test_wave_chunks_in_the_jvm(spark):
    """Chunks in any order and of odd sizes, without a Python worker."""
    riff = lambda *chunks: b"RIFF\0\0\0\0WAVE" + b"".join(name + struct.pack("<I", n) + data for name, n, data in chunks)
    kind = struct.pack("<HHIIHH", 1, 1, 100, 200, 2, 16)
    cases = [
        (riff((b"LIST", 3, b"abc\0"), (b"fmt ", 18, kind + b"\0\0"), (b"data", 400, b"\1" * 400)), 2.0), (riff((b"data", 50, b"\1" * 50), (b"fmt ", 16, kind)), 0.25), (riff((b"fmt ", 16, kind), (b"data", 4294967294, b"")), 21474836.47),
        (riff((b"fmt ", 16, kind)), None), (riff((b"data", 4, b"abcd")), None), (riff((b"fmt ", 16, kind), (b"data", 2, b"ab"), (b"data", 20, b"c" * 20)), 0.1), (b"RIFF", None), (b"", None), (None, None),
    ]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, w binary").repartition(2)
    made = df.select("i", audio.wav_duration(F.col("w")).alias("s"), audio.packed_duration(audio.packed(F.col("w"), F.lit(0))).alias("p"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.s, r.p) for r in sorted(made.collect())] == [(s, s) for _, s in cases]


def test_wave_sizes_beyond_the_header(spark):
    """A size of all ones goes on to the file's end, whether the file is whole or packed."""
    head = b"RIFF\xff\xff\xff\xffWAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 100, 200, 2, 16) + b"data\xff\xff\xff\xff"
    df = spark.createDataFrame([(bytearray(head), 400), (bytearray(head), 0), (bytearray(head), 6_000_000_000)], "h binary, n long").withColumn("p", audio.packed(F.col("h"), F.col("n")))
    assert [r[0] for r in df.select(audio.packed_duration(F.col("p"))).collect()] == [2.0, 0.0, 30_000_000.0]
    assert [r[0] for r in df.where("n <= 400").select(audio.wav_duration(audio.unpacked(F.col("p")))).collect()] == [2.0, 0.0]


def test_packed_speech_is_the_speech(spark):
    """Packed files are small, and written out they are the files, also one after the other."""
    seconds = audio.seconds_of(F.col("t"))
    df = spark.createDataFrame([(1, "x" * 30), (0, "ab"), (2, "")], "k int, t string").repartition(3)
    one = df.select("k", audio.silent_wav(seconds).alias("w"), audio.packed_silence(seconds).alias("p"))
    for r in one.select("*", audio.unpacked("p").alias("u"), audio.unpacked_length("p").alias("n"), audio.packed_duration(F.col("p")).alias("s"), audio.wav_duration(F.col("w")).alias("of_w")).collect():
        assert (len(r.p), bytes(r.u), r.n, r.s) == (52, bytes(r.w), len(r.w), r.of_w)
    j = one.agg(audio.joined_wavs(F.col("k"), F.col("p")).alias("j")).select(audio.joined_bytes(F.col("j")).alias("b"), audio.joined_length(F.col("j")).alias("n"), F.size("j").alias("parts")).first()
    want = b"".join(bytes(r.w) for r in sorted(one.collect()))
    assert (bytes(j.b), j.n, j.parts) == (want, len(want), 3)
    long = spark.createDataFrame([(60_000,)], "n long").select(audio.packed_silence(F.col("n")).alias("p")).select(audio.unpacked_length(F.col("p")).alias("b"), audio.packed_duration(F.col("p")).alias("s")).first()
    assert (long.b, long.s) == (44 + 2 * 22050 * 60_000, 60_000)


def test_replies(spark):
    raw = '```json\n{"sections": [{"number": "2", "title": "Body", "start_page": 3, "kind": "Body_Chapter"}, {"number": "", "title": ""}]}\n```'
    got = spark.createDataFrame([(raw,), ("oops",)], "r string").select(replies.sections(F.col("r")).alias("s"), replies.parse(F.col("r"), "sections").alias("p")).collect()
    assert [tuple(x) for x in got[0].s] == [("2", "Body", 3, "body_chapter")] and got[1].s == [] and got[1].p is None
