import shutil
import uuid
import zlib
from functools import cache

import numpy as np
import pytest
from brindle.llm import token_store as ts
from brindle.llm.common import shared_folder
from brindle.llm.tokens import Encoder, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


@cache
def plain(name):
    return Tokenizer.from_file(vocabulary(name))


@cache
def encoder(name):
    return Encoder(vocabulary(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 \n\t'sé #́.A \x1cΣÅİ日<|endoftext|>"), max_size=30) | st.lists(st.sampled_from(["a", "É", "ß", ",", "<|endoftext|>", " ", "\n", "'s", "İ", "-"]), max_size=12).map("".join), max_size=4))
def test_pieces_give_what_whole_texts_give(name, texts):
    e = encoder(name)
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in plain(name).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_documents_give_what_the_library_gives(name, texts):
    small = Encoder(vocabulary(name), remember=50)  # forgets all the time
    rows = [*texts.values(), "a <|endoftext|> b", "<|startoftext|>", "x <|END|> y", "It's so. don't!!! (yes) ÀÉ,ÿ Ĳssel. 'quoted' --- é\u0301"]
    want = [np.array(x.ids, "<u4").tobytes() for x in plain(name).encode_batch(rows, add_special_tokens=False)]
    assert encoder(name).encode(rows) == want
    assert [small.encode([r])[0] for r in rows] == want


def test_round_trip(spark, documents, odd_docs, no_docs):
    library = plain("byte_bpe_50k.json")
    for df in (documents, odd_docs):
        rows = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.select("doc_id", "text").collect()]
        folder = shared_folder(spark, "store")
        ts.write_store(df, folder)
        got = ts.digest(spark, folder).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in rows)
        assert sorted((str(r.doc_id), list(r.ids)) for r in ts.restore(spark, folder).collect()) == sorted((str(d), x) for d, x in rows)
        names = [r.name for r in ts.read_chunks(spark, folder).collect()]
        assert len(names) == len(set(names))
    assert ts.encode_and_read_back(no_docs).collect() == []


def test_damage_is_found(spark, documents, tmp_path):
    """Chunks of a recipe in the wrong order, a recipe left out of its file."""
    folder = f"file://{tmp_path}/store"
    ts.write_store(documents.where("n_chars > 5000"), folder)

    def changed(part, make):
        was = spark.read.parquet(f"{folder}/{part}")
        rows = was.toPandas()
        other = f"file://{tmp_path}/{uuid.uuid4().hex}"
        for p in ("staged", "recipes", "manifest"):
            shutil.copytree(f"{tmp_path}/store/{p}", f"{other[7:]}/{p}")
        shutil.rmtree(f"{other[7:]}/{part}")
        spark.createDataFrame(make(rows), was.schema).write.parquet(f"{other}/{part}")
        return other

    def swapped(rows):
        i = next(i for i, c in enumerate(rows.chunks) if len(c) > 2)
        rows.at[i, "chunks"] = list(rows.chunks[i])[::-1]
        return rows

    assert len(ts.digest(spark, folder).collect()) == documents.where("n_chars > 5000").count()
    for other in (changed("recipes", swapped), changed("recipes", lambda r: r.iloc[1:])):
        with pytest.raises(Exception, match="isn't"):
            ts.digest(spark, other).collect()


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    data = rng.bytes(5000)
    ends = sorted(rng.integers(0, 5000, 9).tolist()) + [5000]
    parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    shares = ts.crc_before(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([5000 - e for e in ends]))
    assert np.bitwise_xor.reduce(shares) == zlib.crc32(data)


def test_chunks_follow_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50000, 20000).astype(np.uint32)
    moved = np.r_[rng.integers(0, 50000, 333).astype(np.uint32), ids]

    def chunks(x):
        ends = ts.cuts(len(x), ts.rolling_hits(x).tolist())
        assert ends[-1] == len(x) and all(ts.LEAST <= b - a <= ts.MOST for a, b in zip([0, *ends[:-2]], ends[:-1], strict=False))
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)}

    assert len(chunks(ids) & chunks(moved)) > 0.8 * len(chunks(ids))
