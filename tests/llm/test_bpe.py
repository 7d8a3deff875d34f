import hashlib

import pytest

from tarnwick.llm import bpe

pytest.importorskip("public_tokenizers")
TEXTS = [
    "", " ", "  a  b \n c\n\n  d", "x<|endoftext|>y <|endoftext|> z", "<|endoftext|>", "a b  c\x1c d\x85e \x1c", "it's he'll DON'T 's  's", "日本語 テスト 🙂🙂", "a" * 5000, "ab" * 3001, "\t\t\n x", "é ñ", "ſ K ١٢٣ ½", "\U0010fffd ",
    "Ordinary words, with marks; and numbers 12345 67.", "aaaa aaa aa a", "\x00 \x01",
]


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for e in t.encode_batch(texts, add_special_tokens=False):
        out.append((e.ids, len(e.ids), sha(",".join(map(str, e.ids))), sha(t.decode(e.ids, skip_special_tokens=False))))
    return out


def test_ids_are_the_librarys():
    b = bpe.Bpe(bpe.default_path())
    for got, text, want in zip(b.encode_all(TEXTS), TEXTS, expected(TEXTS)):
        assert got == want[0], text
        assert b.digest(got) == want[1:] and b.decode(got) == text
    assert b.encode("a b") == expected(["a b"])[0][0]


def test_in_spark(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "x"), (1, " ")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, ids string")
    want = expected([t or "" for _, t in rows])
    got = bpe.bpe_digests(df, bpe.default_path()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((i, *w[1:]) for (i, _), w in zip(rows, want)), key=key)
    back = bpe.bpe_decode(bpe.bpe_encode(df, bpe.default_path()), bpe.default_path())
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert bpe.bpe_digests(df.limit(0), bpe.default_path()).count() == 0


def test_steps_do_not_matter(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    whole = pa.Table.from_batches(bpe._digest(bpe.default_path())(iter([batch]))).to_pylist()
    monkeypatch.setattr(bpe, "STEP", 10)
    assert pa.Table.from_batches(bpe._digest(bpe.default_path())(iter([batch]))).to_pylist() == whole


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, expected(list(docs.values()))))
    got = bpe.op2_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == want[r["doc_id"]][1:] for r in got)
