import zlib

import numpy as np
from brindle.llm.packing import BestFit, best_fit_pack
from brindle.llm.tokens import vocabulary
from tokenizers import Tokenizer


def whole_ids(texts):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check(got, want, capacity):
    """want: ids of each row; got: pieces. Rows of one id may be repeated."""
    pieces = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    expected = sorted((str(d), n, at, len(x[at : at + capacity]), zlib.crc32(np.array(x[at : at + capacity], "<u4").tobytes())) for d, x in want for n, at in enumerate(range(0, len(x), capacity)))
    assert pieces == expected
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:i]) for i, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= capacity
    return len(by), sum(len(x) for _, x in want)


def test_pieces_and_sequences(documents):
    docs = documents.select("doc_id", "text").collect()
    want = list(zip([r.doc_id for r in docs], whole_ids([r.text for r in docs]), strict=True))
    bins, total = check(best_fit_pack(documents.repartition(9)).collect(), want, 4096)
    assert bins <= -(-total // 4096) + 1
    bins, total = check(best_fit_pack(documents.repartition(40), capacity=700).collect(), want, 700)
    assert bins <= 1.1 * total / 700


def test_edges(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    check(best_fit_pack(odd_docs).collect(), list(zip([r.doc_id for r in rows], whole_ids([r.text for r in rows]), strict=True)), 4096)
    assert best_fit_pack(no_docs).collect() == []


def test_best_fit_takes_the_tightest_bin():
    fit = BestFit(10)
    assert [fit.add(x) for x in (7, 5, 3, 5, 10)] == [(0, 0), (1, 0), (0, 7), (1, 5), (2, 0)]
