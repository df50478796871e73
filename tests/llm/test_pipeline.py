"""The corpus pipeline's stages on a small fixture, each against a plain version of it."""

import zlib

import corpus_pipeline
import pytest
from test_pairs import base_text, brute_components, plain_spans
from tokenizers import Tokenizer

from trackloom.llm import entry, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    passage, long_ = base_text(30, 71), base_text(200, 72)
    texts = [None, "", "12 345 .", long_, long_, long_ + " tail", "q r s t u v w", "q r s t u v w x", f"{base_text(40, 73)} {passage} {base_text(40, 74)}", base_text(3000, 75), "mail me at ann.lee@mail.example.com or +1 (988) 555-2485 please", base_text(50, 76)]
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t)) for i, t in enumerate(texts, 10)]
    rows += [(14, long_, "en", "s", len(long_)), (None, "a text without an id stays", "en", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    columns = docs.columns

    spoken = corpus_pipeline.language_id(spark, docs, folder)
    want = [x for x in texts_of(docs) if any(c.isalpha() for c in x[1] or "")]
    assert spoken.columns == columns and texts_of(spoken) == want

    single = corpus_pipeline.near_duplicates(spark, spoken, folder)
    root = brute_components([x for x in want if x[0] is not None])
    want = sorted({x for x in want if x[0] is None or root[x[0]][1] == x[0]}, key=str)
    assert single.columns == columns and texts_of(single) == want
    assert {13, 16} <= {x[0] for x in want} and not {14, 15, 17} & {x[0] for x in want}

    clean = corpus_pipeline.decontamination(spark, single, folder)
    want = [x for x in want if passage not in x[1]]
    assert clean.columns == columns and texts_of(clean) == want and 18 not in {x[0] for x in want}

    private = corpus_pipeline.personal_data(spark, clean, folder)
    got = dict(texts_of(private))
    for doc, text in want:
        for a, kind, b in reversed(plain_spans(text)):
            text = f"{text[:a]}<{pii.KINDS[kind].upper()}>{text[b:]}"
        assert got[doc] == text
    assert private.columns == columns and all(r.n_chars == len(r.text) for r in private.collect())


def test_run(spark, folder):
    tok = Tokenizer.from_file(entry.tokenizer_path())
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {13, 16, 19, 20, 21, None}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for doc in (13, 16, 19, 21, None):
        ids = [*tok.encode(text[doc], add_special_tokens=False).ids, 0]
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc)
        assert pieces == [(p, a, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))) for p, a in enumerate(range(0, len(ids), 2048)) for x in [ids[a : a + 2048]]]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in map(sorted, places.values()):
        assert seq[0][0] == 0 and sum(seq[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(seq, seq[1:], strict=False))


def test_unlike_texts_under_one_id(spark, folder):
    x, y, z, v = (base_text(60, 80 + i) for i in range(4))
    rows = [(3, x), (5, x), (5, y), (7, f"{y} tail"), (8, z), (8, v), (8, v), (2, f"{v} end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert texts_of(corpus_pipeline.near_duplicates(spark, docs, folder)) == [(2, f"{v} end"), (3, x), (5, y), (8, z)]


def test_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
