import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import queries, store, tokencount

from .samples import awkward, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(ids, end):
    out, open_ = [], 0
    for x in ids:
        open_ += 1
        if x == end:
            out.append(open_)
            open_ = 0
    return out, open_


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [1, 2, 7, 64, 1000])
def test_scan(seed, block):
    rng = random.Random(seed)
    ids = [rng.choice([9, 1, 2, 3]) if seed % 2 else rng.choice([9] + [1] * 40) for _ in range(rng.choice([0, 1, 63, 64, 300]))]
    start, size, left = tokencount.scan_ids(np.array(ids, "<u2").tobytes(), 9, 2, block)
    assert (size.tolist(), left) == brute(ids, 9)
    assert start.tolist() == (np.cumsum(size) - size).tolist()


def test_round_trip(spark):
    texts = awkward()
    folder = store.new_path(spark, "t")
    tokencount.write(docs(spark, texts).coalesce(1), folder, PATH)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    got = tokencount.count(spark, folder, block=50).orderBy("file", "ordinal").collect()
    assert [r["n_tokens"] for r in got] == want and all(r["complete"] for r in got)


@pytest.mark.parametrize("file_tokens", [1, 40, 10**6])
def test_documents_by_id(spark, file_tokens):
    """Files are cut by ids; each row's count finds its document, whatever its id."""
    texts = awkward()
    source = docs(spark, texts).selectExpr("case when doc_id % 7 = 3 then null else doc_id % 20 end as doc_id", "text", "'x' as kind", "1 as value").repartition(3)
    folder = store.new_path(spark, "t")
    tokencount.write(source, folder, PATH, file_tokens=file_tokens)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = sorted((str(r["doc_id"]), len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in source.collect())
    out = tokencount.count_documents(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == want and all(r["complete"] for r in out)
    sums = {}
    for r in out:
        sums.setdefault(r["file"], []).append(r["n_tokens"])
    assert all(sum(x) <= file_tokens or len(x) == 1 for x in sums.values())


def test_no_documents(spark):
    folder = store.new_path(spark, "t")
    tokencount.write(docs(spark, ["x"]).limit(0), folder, PATH)
    assert tokencount.count_documents(spark, folder).collect() == []


def test_stream_over_files(spark, tmp_path):
    rng = random.Random(3)
    for trial in range(4):
        ids = [rng.choice([9] + [1] * rng.choice([1, 10, 60])) for _ in range(200)]
        cuts = sorted(rng.sample(range(201), 6))
        folder = tmp_path / str(trial)
        folder.mkdir()
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200])):
            (folder / f"part-{k:05d}").write_bytes(np.array(ids[a:b], "<u2").tobytes())
        got = tokencount.count(spark, f"file://{folder}", 9, stream=True).orderBy("file", "ordinal").collect()
        sizes, left = brute(ids, 9)
        assert [r["n_tokens"] for r in got if r["complete"]] == sizes
        assert [r["n_tokens"] for r in got if not r["complete"]] == [left] * (left > 0)


def test_odd_size_fails():
    with pytest.raises(ValueError):
        tokencount.scan_ids(b"abc", 9, 2)


def test_query(spark, small):
    rows = queries.table(spark, small, "documents").collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids) + 1, True) for r in rows)
    assert sorted(tuple(r) for r in queries.op9_separator_scan(spark, small).collect()) == want
