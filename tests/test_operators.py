"""Block, chunk, edit and score operators on small ordered tables."""

import random
import re
from collections import defaultdict

from lectern.operators import blocks as B
from lectern.operators import chunks as C
from lectern.operators import edits as E
from lectern.operators import scores as S
from lectern.operators import structure as R
from lectern.plans import pipeline
from lectern.sources import cache, documents

RAW = "doc_id long, pos int, block_id string, type string, section string, text string"


def test_build_ir(spark):
    rows = [
        (1, 0, "b1", "paragraph", None, "CHAPTER 1"), (1, 1, "b2", "paragraph", None, "and the wrapped rest"), (1, 2, "b3", "paragraph", "1.1", "1.1 Methods"), (1, 3, "b4", "paragraph", None, "A sentence that goes"),
        (1, 4, "b5", "table", None, "| a |"), (1, 5, "b6", "paragraph", None, "on after the table."), (1, 6, "b7", "paragraph", None, "A word split en-"), (1, 7, "b8", "paragraph", None, "ergy here."), (1, 8, "b9", "paragraph", None, "17"),
        (1, 9, "c1", "paragraph", None, "References"), (1, 10, "c2", "paragraph", None, "[1] Someone"), (1, 11, "c3", "paragraph", None, "CHAPTER 2"), (1, 12, "c4", "paragraph", None, "More text."),
    ]
    got = {r.block_id: r for r in B.build_ir(spark.createDataFrame(rows, RAW)).collect()}
    assert got["b1"].text == "CHAPTER 1 and the wrapped rest" and got["b1"].type == "heading"
    assert got["b4"].text == "A sentence that goes on after the table." and got["b4"].section == "1.1"
    assert got["b7"].text == "A word split energy here."
    assert {k for k, r in got.items() if r.type == "backmatter"} == {"c1", "c2"}
    assert not {"b2", "b6", "b8", "b9"} & set(got) and got["c4"].type == "paragraph"


def test_running_lines(spark):
    rows = [(1, i, f"b{i}", "paragraph", None, "Header" if i % 2 else f"text {i}") for i in range(6)]
    assert {r.text for r in B.strip_artifacts(spark.createDataFrame(rows, RAW)).collect()} == {"text 0", "text 2", "text 4"}


def test_chunks(spark):
    segments = [(1, 0, "abcdefghij", "a", None), (1, 1, "klm", "b", 1), (1, 2, "nop", "b", 1), (1, 3, "qrstuvwxyz", "c", 2), (2, 0, "", "d", 1)]
    got = C.plan_chunks(spark.createDataFrame(segments, "doc_id long, pos int, text string, block_id string, chapter int"), 6).orderBy("chunk_no").collect()
    assert "".join(r.text for r in got) == "abcdefghijklmnopqrstuvwxyz" and all(len(r.text) <= 6 for r in got)
    assert [r.text for r in got] == ["abcdef", "ghij", "klmnop", "qrstuv", "wxyz"] and [r.block_ids for r in got][2] == ["b"]
    assert [r.prev_id for r in got] == [None, "chunk.1", "chunk.2", "chunk.3", "chunk.4"] and got[-1].next_id is None
    frame = spark.createDataFrame([tuple(r) for r in got], "doc_id long, chunk_no int, chunk_id string, text string, chapter int, block_ids array<string>, prev_id string, next_id string")
    assert [r.chunk_no for r in C.preview_chunks(frame).orderBy("chunk_no").collect()] == [1, 2, 3]
    assert [(r["index"], r.chapter, r.n) for r in C.chapter_islands(frame).orderBy("index").collect()] == [(1, 1, 3), (2, 2, 2)]


def test_spoken_edits(spark):
    chunks = spark.createDataFrame([(1, "five mm of committee", "x"), (1, "mm $1", "y")], "doc_id long, text string, id string")
    edits = spark.createDataFrame([(1, 0, "mm", "milli$meters", "notation"), (1, 1, "five", "nine", "typo"), (1, 2, "absent", "x", "notation"), (1, 3, "five mm", "six", "data")], "doc_id long, n int, find string, replace string, kind string")
    script = spark.createDataFrame([(1, "five mm of committee mm $1")], "doc_id long, script string")
    judged = {r.find: r.why for r in E.candidate_repairs(edits, script, copyedit=True).collect()}
    assert judged["mm"] is None and "guard" in judged["five"] and "not found" in judged["absent"] and "data" in judged["five mm"]
    got = E.apply_to_chunks(chunks, edits.where("n = 0")).collect()
    assert {r.text for r in got} == {"five milli$meters of committee", "milli$meters $1"}


def test_markdown_edits(spark):
    docs = spark.createDataFrame([(1, "value <sup>0</sup>.1 and foo , bar"), (2, "untouched")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, "<sup>0</sup>.1", "0.1", "artifact"), (1, 1, "foo ,", "foo,", "noise"), (1, 2, "value", "worth", "noise"), (1, 3, "0</sup>.1", "0.2", "artifact")], "doc_id long, n int, broken string, fixed string, kind string")
    got = {r.doc_id: r.text for r in E.apply_to_markdown(docs, edits).collect()}
    assert got == {1: "value 0.1 and foo, bar", 2: "untouched"}


def test_scores(spark):
    items = spark.createDataFrame([("a", "Plain <break time='1'/> text with five", 8, 6, ["re:[0-9]+", "sup"], ["five", "six"])], "item string, script string, detected int, expected int, must_be_absent array<string>, must_be_present array<string>")
    got = {r.dimension: r for r in S.score(items).collect()}
    assert got["structure (chapters)"].rate == 0.857 and got["citation/markup strip"].rate == 1.0
    assert got["value preservation"].rate == 0.5 and got["value preservation"].misses == ["six"] and got["raw-token leak (clean=1)"].rate == 1.0


def test_triage_and_outline(spark):
    rows = [(1, 0, "b0", "heading", "1.1 Start")] + [(1, i, f"b{i}", "paragraph", f"Prose number {i} goes on.") for i in range(1, 15)] + [(1, 15, "b15", "paragraph", "import numpy as np")]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, block_id string, type string, text string")
    assert [r.block_id for r in R.suspicious_blocks(frame).collect()] == ["b15"]
    lines = R.outline(frame).first().outline.split("\n")
    assert len(lines) == 1 + 8 + 1 + 1 and lines[9] == "  ...(+6 more blocks: paragraphx6)"


def test_markdown(spark):
    text = "# A TITLE\n\nby\n\n{4}----\n\n# **CHAPTER 2**\n\n## 2.1 Methods\n\nProse here.\n\n$$a=b$$ (2.4)\n\n| a |\n| b |\n\n![](x.png)\n\n# Appendix A\n\nMore."
    got = documents.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [r.type for r in got] == ["heading", "paragraph", "heading", "heading", "paragraph", "equation_display", "table", "backmatter", "backmatter"]
    assert got[3].section == "2.1" and got[3].text == "Methods" and got[4].chapter == 2 and got[4].page == 5 and got[5].latex == r"a=b \tag{2.4}"


def test_page_text(spark):
    text = "CHAPTER 1\nFirst line\nsecond line\n\n1.2 Parts\nbody\n12\fnext page\n[1] Ref one\n[2] Ref two"
    got = documents.page_text_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.type, r.page, r.text) for r in got] == [("heading", 1, "CHAPTER 1"), ("paragraph", 1, "First line\nsecond line"), ("heading", 1, "1.2 Parts"), ("paragraph", 1, "body"), ("paragraph", 2, "next page"), ("reference_list", 2, "[1] Ref one"), ("reference_list", 2, "[2] Ref two")]


def test_stage_slices(spark):
    stages = pipeline.rule_stages()
    assert [n for n, _ in stages] == ["build_ir", "select", "math", "figures", "citations", "normalize", "signpost"]
    rows = pipeline.as_blocks(spark.createDataFrame([(1, 0, "b1", "paragraph", None, "It was 5 [3].")], RAW))
    got = pipeline.run_stages(rows, stages, "select", "normalize").first()
    assert got.spoken == "It was five." and got.handling == "speak"


def test_tables_are_announced(spark):
    rows = [(1, 0, "b0", "paragraph", None, "Before."), (1, 1, "b1", "table", None, "| a | b |\n|-|-|\n| 1 | 2 |"), (1, 2, "b2", "paragraph", None, "After.")]
    blocks = pipeline.as_blocks(spark.createDataFrame(rows, RAW))
    said = lambda kind: [r.text.strip() for r in pipeline.script_segments(pipeline.run_stages(blocks, pipeline.rule_stages(kind))).orderBy("pos").collect()]
    assert said("summarize") == ["Before.", "Table one. A table is shown here.", "After."]
    assert said("skip") == ["Before.", "After."]


def test_cache_and_stream(spark, tmp_path):
    from lectern.streaming import documents as stream

    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    spark.createDataFrame([("it was 5",), ("it was 5",), (None,)], "text string").write.parquet(source)
    for k in range(2):
        stream.start(spark, source, "text string", store, f"{tmp_path}/cp{k}").awaitTermination()
    rows = cache.read(spark, store).collect()
    assert [bytes(r.value).decode() for r in rows] == ["it was five"]


def test_pronunciation_plan(spark):
    from lectern.operators import pronounce as P

    blocks = spark.createDataFrame([(1, 0, "ABA and ABA with E"), (1, 1, "reactive oxygen species (ROS) then ROS and x_i"), (2, 0, "ABA")], "doc_id long, pos int, text string")
    rules = [(1, 0, "acronym", "ABA", "abscisic acid", "A B A"), (1, 1, "acronym", "ROS", "reactive oxygen species", "R O S"), (1, 2, "acronym", "E", "energy", "E"), (1, 3, "notation", "x_i", "x sub i", None), (1, 4, "term", "x_i", "other", None)]
    got = {(r.doc_id, r.pos): r.text for r in P.apply_plan(blocks, spark.createDataFrame(rules, P.RULES)).collect()}
    assert got[(1, 0)] == "abscisic acid (A B A) and A B A with E" and got[(1, 1)] == "reactive oxygen species (R O S) then R O S and x sub i" and got[(2, 0)] == "ABA"


def test_pronunciation_plan_across_batches(spark):
    """Documents go through Python many a batch, and may go on in the next one; what was said before still counts."""
    from lectern.operators import pronounce as P

    blocks = spark.createDataFrame([(d, k, "ABA of ROS" if k else "reactive oxygen species") for d in range(6) for k in range(7)] + [(9, 0, "ABA"), (9, 1, None)], "doc_id long, pos int, text string")
    rules = [(d, n, "acronym", *r) for d in range(0, 6, 2) for n, r in enumerate((("ABA", f"acid {d}", "A B A"), ("ROS", "reactive oxygen species", "R O S")))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        spoken = P.apply_plan(blocks, spark.createDataFrame(rules, P.RULES))
        got = {(r.doc_id, r.pos): r.text for r in spoken.collect()}
    finally:
        spark.conf.set(key, before)
    assert "FlatMapGroups" not in spoken._jdf.queryExecution().executedPlan().toString()
    said = lambda d, k: ("ABA of ROS" if d % 2 else f"acid {d} (A B A) of R O S" if k == 1 else "A B A of R O S") if k else "reactive oxygen species"
    assert got == {(d, k): said(d, k) for d in range(6) for k in range(7)} | {(9, 0): "ABA", (9, 1): None}


def test_reports(spark):
    from lectern.operators import reports as Rp

    rows = spark.createDataFrame([(1, 2, "b", "x|y"), (1, 1, "a", None)], "doc_id long, n int, name string, why string")
    table = Rp.markdown_table(rows, "Edits", "n", ["name", "why"])
    assert table.first().report == "# Edits (2)\n\n| name | why |\n|---|---|\n| a |  |\n| b | x\\|y |\n"
    assert Rp.ledger({"One": table, "Two": table}).first().report.count("# Edits (2)") == 2
    chapters = spark.createDataFrame([(1, 1, "A=b", 1.5), (1, 2, "C", 2.0)], "doc_id long, index int, title string, seconds double")
    assert Rp.chapter_metadata(chapters).first().metadata == ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1500\ntitle=A\\=b\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=1500\nEND=3500\ntitle=C\n"


def test_corpus(spark, tmp_path):
    import json

    from lectern.operators import reports as Rp
    from lectern.sources.corpus import read_corpus

    for name, detected in (("a", 2), ("b", 0)):
        d = tmp_path / name
        d.mkdir()
        (d / "labels.json").write_text(json.dumps({"thesis_id": name, "expected_chapters": ["x", "y"], "must_be_absent": ["["], "must_be_present": ["five"]}, indent=1))
        (d / "result.json").write_text(json.dumps({"chapters_detected": detected}))
        (d / "script.md").write_text("It was five.\n")
    got = S.score(read_corpus(spark, str(tmp_path)))
    assert {(r.item, r.rate) for r in got.where("dimension = 'structure (chapters)'").collect()} == {("a", 1.0), ("b", 0.0)}
    assert Rp.scorecard(got).first().report.count("\n| ") == 9


def test_section_mapping(spark):
    rows = [(1, i, f"b{i}", t, None, x) for i, (t, x) in enumerate([("paragraph", "front"), ("heading", "Abstract"), ("paragraph", "a"), ("heading", "I. INTRODUCTION"), ("heading", "Conclusion"), ("paragraph", "c"), ("heading", "Introduction"), ("heading", "REFERENCES"), ("paragraph", "r")])]
    sections = spark.createDataFrame([(1, 0, "Abstract", "abstract"), (1, 1, "Introduction", "body_chapter"), (1, 2, "References", "references")], "doc_id long, pos int, title string, kind string")
    got = [(r.decision, r.section_chapter, r.section_head) for r in B.map_sections(spark.createDataFrame(rows, RAW), sections).orderBy("pos").collect()]
    assert got == [("review", None, False), ("read", None, True), ("read", None, False), ("read", 1, True), ("read", 1, False), ("read", 1, False), ("read", 1, False), ("skip", None, True), ("skip", None, False)]


def test_headings_and_captions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("I. INTRODUCTION", 1, None), ("2.3 Methods", 2, "2.3"), ("Preface", None, None)], "t string, c int, s string")
    got = [r[0] for r in df.select(pipeline.heading_announcement(F.col("t"), F.col("c"), F.col("s"))).collect()]
    assert got == ["Chapter one. INTRODUCTION.", "Section two point three, Methods.", "Preface."]
    assert df.limit(1).select(pipeline.clean_caption(F.lit("Fig. 2 (a) 5%"))).first()[0] == "Figure two Panel A five percent"


def test_region_types(spark):
    rows = [(1, 0, "b0", "frontmatter", None, "CHAPTER 1"), (1, 1, "b1", "paragraph", None, "text"), (1, 2, "b2", "table", None, "| x |")]
    regions = spark.createDataFrame([(1, 0, 0, "chapter_body", 3, 0), (1, 1, 2, "bibliography", None, 1)], "doc_id long, first_pos int, last_pos int, kind string, chapter int, n int")
    blocks = pipeline.as_blocks(spark.createDataFrame(rows, RAW))
    got = B.retype_regions(B.apply_regions(blocks, regions)).orderBy("pos").collect()
    assert [(r.type, r.chapter) for r in got] == [("heading", 3), ("reference_list", None), ("table", None)]


def continued(rows):
    """The rule of merge_continuations as a loop over (pos, type, text) rows."""
    out, head, between = [], None, False
    for pos, kind, text in rows:
        if kind != "paragraph":
            out.append([pos, kind, text])
            between, head = True, head if kind in ("figure_caption", "table") else None
            continue
        if head is not None:
            before = head[2].rstrip()
            hyphen, ended = bool(re.search("[a-z][-\xad]$", head[2].strip())), bool(re.search("[.!?]$", re.sub("[”\"']+$", "", before)))
            if hyphen and not between:
                stem = re.search("(\\w+)[-\xad]$", before)
                head[2] = (before if stem and len(stem[1]) >= 3 else before[:-1]) + text
                continue
            if not ended and (not between or text[:1].islower()):
                head[2] = before + " " + text.lstrip()
                continue
        head, between = [pos, kind, text], False
        out.append(head)
    return [tuple(r) for r in out]


def test_continuations_against_a_loop(spark):
    rng = random.Random(4)
    texts = ["and so on", "It ended.", "A long hy-", "an a-", "Next one", "next one", "quoted.”", "more!", "x -", "trailing  ", "the co-"]
    docs = [[(k, rng.choice(["paragraph"] * 5 + ["table", "figure_caption", "heading"]), rng.choice(texts)) for k in range(rng.randrange(0, 14))] for _ in range(400)]
    rows = [(d, *r) for d, doc in enumerate(docs) for r in doc]
    got = defaultdict(list)
    for r in B.merge_continuations(spark.createDataFrame(rows, "doc_id long, pos int, type string, text string")).collect():
        got[r.doc_id].append((r.pos, r.type, r.text))
    assert {d: sorted(v) for d, v in got.items()} == {d: continued(doc) for d, doc in enumerate(docs) if doc}


def test_chunks_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(d, k, rng.choice("abc") * rng.randrange(0, 17), rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for d in range(60) for k in range(rng.randrange(1, 20))]
    want = defaultdict(list)
    for d, _, text, block, chapter in rows:
        for part in [text[k : k + 7] for k in range(0, len(text), 7)]:
            chunks = want[d]
            if not chunks or len(chunks[-1][0]) + len(part) > 7:
                chunks.append(["", chapter, []])
            chunks[-1][0] += part
            if block is not None and block not in chunks[-1][2]:
                chunks[-1][2].append(block)
    got = defaultdict(list)
    for r in C.plan_chunks(spark.createDataFrame(rows, "doc_id long, pos int, text string, block_id string, chapter int"), 7).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append([r.text, r.chapter, r.block_ids])
        assert r.chunk_id == f"chunk.{r.chunk_no}" and r.chunk_no == len(got[r.doc_id])
    assert got == {d: c for d, c in want.items() if c}


def test_narration_is_revised_looked_up_and_held(spark):
    from pyspark.sql import functions as F

    from lectern.functions.prompts import prompt, revision_prompt
    from lectern.functions.verify import verify_segment
    from lectern.operators import engine

    source = "It rose by 2.5 units."
    broken, good = "It rose by 2.5 units.", "It rose by two point five units."
    asked = spark.createDataFrame([(source, broken)], "s string, b string").select(
        prompt("narrate", F.col("s")).alias("first"), revision_prompt(F.col("s"), F.col("b"), verify_segment(F.col("s"), F.col("b"))["violations"]).alias("second")
    )
    first, second = asked.first()
    told = spark.createDataFrame([(first, broken), (second, good)], "prompt string, reply string").select(cache.cache_key("narrate.", F.col("prompt")).alias("key"), "reply")
    rows = spark.createDataFrame([(1, source, 3), (2, "Plain.", None), (3, None, 1), (4, "Unknown.", 7)], "n int, source string, page int")
    look = lambda r: r.withColumn("reply", F.when(F.col("prompt").isNotNull(), F.lit("Unknown.")))
    got = {r.n: r for r in engine.narrate_segments(rows, engine.from_replies(told), look).collect()}
    assert (got[1].ok, got[1].attempts, got[1].spoken, got[1].escalated) == (True, 2, good, False)
    assert (got[2].ok, got[2].attempts, [v.kind for v in got[2].violations]) == (False, 2, ["reply"])
    assert got[3].ok is None and got[3].attempts == 0
    assert (got[4].ok, got[4].attempts, got[4].escalated) == (True, 3, True)


def test_commands(spark):
    from pyspark.sql import functions as F

    from lectern.operators import engine
    from lectern.plans import commands

    rows = [(1, 0, "b0", "heading", None, "I. FRONT"), (1, 1, "b1", "paragraph", None, "Some plain words."), (1, 2, "b2", "table", None, "| a |\n| b |"), (1, 3, "b3", "heading", None, "II. Back"), (1, 4, "b4", "paragraph", None, "Left out.")]
    raw = spark.createDataFrame(rows, RAW)
    sections = spark.createDataFrame([(1, 0, "Front", "abstract"), (1, 1, "Back", "references")], "doc_id long, pos int, title string, kind string")
    echo = lambda r: r.withColumn("reply", F.substring_index("prompt", "\n\n", -1))
    made = commands.run(raw, sections, echo)
    assert "".join(r.text for r in made["chunks"].orderBy("chunk_no").collect()) == "FRONT.\n\nSome plain words.\n\nA table is shown here.\n\n"
    told = made["outcome"].first()
    assert (told.narrated, told.announced, told.skipped, told.held, told.reason) == (1, 1, 2, 0, None)
    assert made["flagged"].count() == 0 and made["pairs"].first().ok
    held = commands.run(raw, sections, engine.offline)
    assert held["flagged"].first().reason == "verifier" and held["outcome"].first().held == 1
    docs = spark.createDataFrame([(1, "# 1.1 Title\n\nWords here.\n\n| a |\n| b |")], "doc_id long, text string")
    assert commands.parse(docs).first().histogram == "headingx1,paragraphx1,tablex1"
    edits = lambda scripts: scripts.select("doc_id", F.lit(0).alias("n"), F.lit("words").alias("find"), F.lit("signs").alias("replace"), F.lit("notation").alias("kind"), F.lit("r").alias("reason"))
    chunks, report = commands.run_v1(raw, edits)
    assert "Some plain signs." in chunks.first().text and "| words | signs | 1 | r |" in report.first().report
    spoken = commands.synthesize(chunks)
    assert commands.assemble(spoken, chunks.where("false").select("doc_id", "chapter", F.lit("").alias("title"))).first().chapters >= 1


def test_cached_speech_is_packed(spark, tmp_path):
    """A long text's silence takes a few bytes in the cache, and comes back from there."""
    from lectern.plans import commands
    from lectern.sources import cache

    store = f"{tmp_path}/speech"
    chunks = spark.createDataFrame([(1, 1, "x" * 3000), (1, 2, "y")], "doc_id long, chunk_no int, text string")
    commands.synthesize(chunks, store)
    assert [len(r.value) for r in cache.read(spark, store).collect()] == [52, 52]
    assert [(r.hit, r.seconds) for r in commands.synthesize(chunks, store).orderBy("chunk_no").collect()] == [(True, 200.0), (True, 1470 / 22050)]
