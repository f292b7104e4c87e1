"""The pipeline's stages on awkward and driver rows, against brute force where a stage decides."""

from collections import Counter

import pytest

import corpus_pipeline as P
from lectern.llm.quality import clean_lines
from tests.llm.test_queries import awkward, classes_brute, empty, encoded, secrets_brute  # noqa: F401


def documents(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("which", ["driver", "awkward"])
def test_stages(spark, sf, awkward, tmp_path, which):  # noqa: F811
    sf_dir = sf if which == "driver" else awkward
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(documents(docs))
        if k < 4:
            assert docs.columns == P.COLUMNS
            assert all(r["n_chars"] == len(r["text"]) for r in seen[-1])
    clean, single, redacted, mixed, packed = seen
    judged = [r for r in clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*P.COLUMNS)).collect() if r.kept]
    assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter((r.doc_id, r.clean_text) for r in judged)
    component = classes_brute(clean, 5, 80)
    assert Counter(r["doc_id"] for r in single) == Counter(r["doc_id"] for r, c in zip(clean, component, strict=True) if c[2] is None or c[0] == c[2])
    assert len(redacted) == len(single) and not any(secrets_brute(r["text"]) for r in redacted)
    plain = {r["doc_id"] for r in single if not secrets_brute(r["text"])}
    assert Counter((r["doc_id"], r["text"]) for r in redacted if r["doc_id"] in plain) == Counter((r["doc_id"], r["text"]) for r in single if r["doc_id"] in plain)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in redacted}
    assert max(Counter((r["doc_id"], r["text"]) for r in mixed).values()) <= 2 * max(Counter((r["doc_id"], r["text"]) for r in redacted).values())
    assert sum(r["length"] for r in packed) == sum(map(len, encoded(mixed, "word_bpe_49k.json", 1)))


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [(5, text(0)), (5, text(0)), (5, near(0)), (6, text(0)), (None, text(1)), (None, near(1)), (7, text(2)), (None, near(2)), (8, text(3)), (8, text(4)), (9, None), (9, "few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r["doc_id"] for r in documents(P.deduplicate(spark, docs, "")))
    assert got == Counter({5: 1, None: 1, 7: 1, 8: 2, 9: 2})


def test_empty(spark, empty):  # noqa: F811
    assert P.run(spark, empty).count() == 0


def test_mix_tells_repeated_rows_apart(spark, sf):
    rows = [(k % 3, f"word{k} " * 10, "en", "s" if k % 4 else None, 60) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in documents(P.mix(spark, docs, sf)))
    assert set(got) <= {r[:2] for r in rows} and max(got.values()) <= 2 and abs(sum(got.values()) - 60) <= 1
