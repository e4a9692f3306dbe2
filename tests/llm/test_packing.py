from __future__ import annotations

import zlib

import numpy as np
import pytest
from tests.llm.helpers import documents, prose
from tokenizers import Tokenizer

from driftwarden.llm import packing as P
from driftwarden.llm.queries import op4_pack, word_tokenizer


def ids_of(texts):
    t = Tokenizer.from_file(word_tokenizer())
    return [[*x.ids, 1] for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    texts = ["Don't stop, it's 42% of Ünïcode!", "", "  \n tabs\t ", "<|endoftext|> inside", "中文 and ½ Ⅷ", "é combining", "a'LL 'd x_y __ $$$ --", "ÀÉÎõü ÷×", prose(3, 500)]
    got = [np.frombuffer(x, "<u2").tolist() for x in P.Encoder(word_tokenizer()).encode(texts)]
    assert got == [x[:-1] for x in ids_of(texts)]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import models, pre_tokenizers

    texts = ["Don't stop, it's 42% of Ünïcode!", "", "中文", prose(3, 50)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = P.Encoder(path)
    assert not own.by_words and [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    large = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    large.pre_tokenizer = pre_tokenizers.Whitespace()
    large.save(f"{tmp_path}/large.json")
    own = P.Encoder(f"{tmp_path}/large.json")
    assert own.width == 4 and np.frombuffer(own.encode(["w69999 w5 x"])[0], "<u4").tolist() == [69999, 5, 0]


def test_hilbert_curve_visits_neighbours():
    d = 3
    grid = np.array([(x, y, z) for x in range(1 << d) for y in range(1 << d) for z in range(1 << d)])
    key = P.hilbert(grid, d)
    assert sorted(key.tolist()) == list(range(1 << 3 * d))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, texts):
    want = {i: x for i, x in enumerate(ids_of([t or "" for t in texts]))}
    seen, at = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        piece = want[r.id][r.start : r.start + r.length]
        assert r.tokens == len(want[r.id]) and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen.setdefault(r.id, []).append((r.start, r.length))
    assert all(n == 2048 for s, n in at.items() if s != max(at)) and sorted(at) == list(range(len(at)))
    for i, x in want.items():
        spans = sorted(seen[i])
        assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) == len(x)


@pytest.mark.parametrize("range_rows", [3, 20_000])
def test_round_trip_and_defined_cases(spark, range_rows):
    texts = [None, "", "same", "same", "same", prose(1, 9000), "<|startoftext|>", *(prose(i, 300) for i in range(20))]
    docs = documents(spark, texts, extra={"ids": 1, "tokens": 2, "place": 3, "part": 4})
    check(P.pack(docs, word_tokenizer(), range_rows=range_rows).collect(), texts)


def test_query_covers_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op4_pack(spark, sf).withColumnRenamed("doc_id", "id").withColumnRenamed("doc_tokens", "tokens").collect()]
    check(rows, [texts[i] for i in range(len(texts))])


def test_neighbours_are_alike(spark):
    """Documents of three vocabularies: neighbours along the stream share one far more often than by chance."""
    texts = [" ".join(prose(k * 1000, 60).split() * 3 + prose(k * 1000 + i, 10).split()) for i in range(40) for k in range(3)]
    rows = P.pack(documents(spark, texts), word_tokenizer()).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [r.id % 3 for r in rows]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 0.6 * len(order)


def test_empty_table(spark):
    assert P.pack(documents(spark, []), word_tokenizer()).count() == 0


def test_the_order_of_rows_and_tasks_changes_nothing(spark):
    docs = documents(spark, [prose(i, 40 + i % 7) for i in range(300)])
    one, two = (sorted(tuple(r) for r in P.pack(d, word_tokenizer(), with_ids=False, range_rows=50).collect()) for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one == two
