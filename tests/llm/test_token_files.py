"""Token files: blocks, files and documents, written and read back."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from subscope.llm import queries, token_files as files


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(bpe, text):
    return np.array([*bpe.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 4000])
@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 1 << 32])
@pytest.mark.parametrize("block", [1, 128, 256])
def test_blocks_round_trip(n, most, block):
    rng = np.random.default_rng(n + most)
    ids = rng.integers(0, most, n, dtype=np.uint32)
    ids[n // 3 : n // 3 + 3] = (1 << 32) - 1  # outliers
    blocks = files.encode(ids, block)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert (files.decode(np.frombuffer(b"".join(blocks), np.uint8), starts) == ids).all()
    assert len(blocks) == -(-n // block)


def test_outliers_do_not_widen_a_block():
    ids = np.arange(256, dtype=np.uint32) % 16 + 1000
    plain = len(files.encode(ids)[0])
    ids[[3, 200]] = 4_000_000_000
    assert plain == 9 + 256 * 4 // 8 and len(files.encode(ids)[0]) == plain + 2 * 6


def test_words_of_awkward_texts():
    import pyarrow as pa

    rnd = random.Random(3)
    bits = ["a", "Hello", " ", "  ", "\n", "\t", "é", "ß", "don't", "'s", "1,000", "22", "<|endoftext|>", "<|", "|>", "\x85", "\xa0", " ", "日本", "\U0001f600", ".", "x-y"]
    texts = ["", " ", "a", " a", "a ", "<|endoftext|>"] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    words, bpe = files.Words(queries.tokenizer_path()), library()
    for low in range(0, len(texts), 500):  # what one batch learned serves the next
        made = words.batch(pa.array(texts[low : low + 500]))
        assert [x.tolist() for x in made] == [bpe.encode(t, add_special_tokens=False).ids for t in texts[low : low + 500]]


def test_known_words_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(files, "KNOWN", 50)
    words, bpe = files.Words(queries.tokenizer_path()), library()
    for n in range(8):
        text = " ".join(f"word{n}x{k}" for k in range(30))
        assert words.batch(pa.array([text]))[0].tolist() == bpe.encode(text, add_special_tokens=False).ids
        assert len(words.known) <= 50


def expected(rows):
    bpe, at, out = library(), 0, []
    for doc_id, text in rows:
        ids = ids_of(bpe, text)
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_by_brute_force(spark, small):
    rows = queries.op12_token_files(spark, small).orderBy("start").collect()
    given = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY 1").fetchall()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected(given)


def test_any_range_from_the_index(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = str(tmp_path / "tokens")
    files.write(docs, out, queries.tokenizer_path())
    texts, bpe = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()), library()
    seen = 0
    for path in sorted(tmp_path.glob("tokens/part-*")):
        if not path.stat().st_size:
            continue
        file = files.File.of(path.read_bytes())
        whole = np.concatenate([ids_of(bpe, texts[int(i)]) for i in file.doc_ids])
        assert (file.read(0, len(whole)) == whole).all() and len(file.starts) == -(-len(whole) // 256)
        for low, high in [(0, 0), (0, 1), (255, 257), (len(whole) - 1, len(whole)), (100, 5000)]:
            assert (file.read(low, min(high, len(whole))) == whole[low:high]).all()
        assert path.stat().st_size < 2.4 * len(whole)
        seen += len(file.doc_ids)
    assert seen == len(texts)


def test_odd_rows(odd, empty, spark, tmp_path):
    got = files.token_files(odd, str(tmp_path / "odd"), queries.tokenizer_path()).orderBy("start").collect()
    given = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in given]
    # rows that share a doc_id may come in either order
    digest = lambda rows: sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in rows)
    assert digest([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got]) == digest(expected(given))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    assert files.token_files(empty, str(tmp_path / "empty"), queries.tokenizer_path()).count() == 0
    named = spark.createDataFrame([("b", "one"), ("a\n", "two"), (None, "x"), ("ü", "")], "doc_id string, text string")
    assert [r.doc_id for r in files.token_files(named, str(tmp_path / "named"), queries.tokenizer_path()).orderBy("start").collect()] == [None, "a\n", "b", "ü"]


def test_an_id_shared_by_most_rows_fills_several_files(spark, tmp_path):
    docs = spark.range(2000).selectExpr("if(id < 1500, 7, id) AS doc_id", "concat('text number ', id) AS text")
    rows = files.token_files(docs, str(tmp_path / "hot"), queries.tokenizer_path()).collect()
    assert len(rows) == 2000 and len({r.file for r in rows if r.doc_id == 7}) > 3
