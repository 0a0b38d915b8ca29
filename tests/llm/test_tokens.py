import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from depquarry.llm import bpe, ngramlm, tokenbin
from depquarry.llm.eliasfano import EliasFano
from depquarry.llm.queries import tokenizer_file

ODD = ["a", "Ünder", "thE", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", " ", "　", "'s", "'LL", "1", "12", ".", "?!", "é", "́", "漢", "😀", "<|endoftext|>", "<|startoftext|>", "ß", "İ", "Σ", "\x00", "×", "÷", "x×.", "a÷,", "_.", "é.", ".", ",", "a.b,c"]


def texts(n=400):
    rng = random.Random(4)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(12))) for _ in range(n)] + ["word " * 5000, "x" * 3000, "same text", "same text"]


def test_word_bpe_equals_the_library(spark, make_docs, monkeypatch):
    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*enumerate(texts()), (9000, None), (None, "of the"), (9001, "twice"), (9001, "twice")]
    out = bpe.decode(bpe.encode(make_docs(rows), path), path).collect()
    want = sorted((d is None, d or 0, t.encode(x or "", add_special_tokens=False).ids) for d, x in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == want
    assert all(r["text"] == t.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) for r in out)
    assert bpe.encode(make_docs([]), path).count() == 0
    with pytest.raises(ValueError, match="white space"):
        bpe.encode(make_docs([(1, "hello big world")]), tokenizer_file("byte_bpe_50k.json"))


def test_word_bpe_with_little_room_for_segments(spark, make_docs, monkeypatch):
    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 500)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 200)
    rows = [(i, f"word{i % 7} of the {x}") for i, x in enumerate(texts(100))]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(make_docs(rows), path).collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids for d, x in rows}


def test_byte_bpe_equals_the_library():
    path = tokenizer_file("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokenbin.Encoder(path)
    for x in texts(3000):
        assert np.frombuffer(e(x), e.dtype).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700).map(sorted))
def test_elias_fano(values):
    back = EliasFano.frombytes(EliasFano.encode(np.array(values, np.int64)).tobytes())
    assert back.select_all().tolist() == values
    assert all(back.select(i) == values[i] for i in range(0, len(values), 7))


def test_elias_fano_is_small_and_refuses_disorder():
    v = np.cumsum(np.random.default_rng(1).integers(0, 2000, 50_000))
    assert len(EliasFano.encode(v).tobytes()) * 8 < 50_000 * (3 + np.log2(v[-1] / 50_000))
    with pytest.raises(ValueError, match="ascend"):
        EliasFano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.encode(np.array([1])).select(1)


def test_token_files(spark, make_docs, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i * 37 % 1009 - 300, x) for i, x in enumerate(texts())] + [(5000, None), (6000, "twice"), (6000, "twice"), (None, "no id"), (None, "no id"), (None, None)]
    files = tokenbin.write_token_files(make_docs(rows), path, f"file://{tmp_path}/t").cache()
    read = tokenbin.read_token_files(tokenbin.file_starts(files))
    got = read.select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert all(len(r["ids"]) == r["n_tokens"] * r["width"] and zlib.crc32(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()) == r["ids_crc32"] for r in read.collect())
    want, start = [], 0
    for d, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == sorted(want)
    nameless = sorted((r["start"], r["n_tokens"]) for r in got if r["doc_id"] is None)
    assert sorted(n for _, n in nameless) == sorted(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in ("no id", "no id", ""))
    assert [s for s, _ in nameless] == [start, start + nameless[0][1], start + nameless[0][1] + nameless[1][1]]
    assert tokenbin.write_token_files(make_docs([]), path, f"file://{tmp_path}/e").count() == 0


def test_backoff_scores_against_brute_force(spark, make_docs, monkeypatch):
    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(0, "the cat sat on the mat"), (1, "the cat sat on the hat"), (2, "dogs bark"), (3, ""), (4, None), (5, "the cat"), (5, "the cat"), (6, "z q x " * 40)]
    for order in (2, 3, 5):
        monkeypatch.setattr(ngramlm, "CHUNK_TOKENS", 9 if order == 3 else 1 << 20)
        tokens = ngramlm.tokenized(make_docs(rows).repartition(2), path)
        got = sorted((r["doc_id"], r["n_tokens"], round(r["log_score"], 6), r["n_backed_off"]) for r in ngramlm.score(tokens, order).collect())
        docs = [t.encode(x or "", add_special_tokens=False).ids for _, x in rows]
        counts = {}

        def grams(ids, k):
            x = [-1] * (k - 1) + ids
            return [tuple(x[i : i + k]) for i in range(len(ids))] + ([(-1,) * k] if k < order else [])

        for ids in docs:
            for k in range(1, order + 1):
                for g in grams(ids, k):
                    counts[g] = counts.get(g, 0) + 1
        n_all = sum(map(len, docs))
        kinds = len({i for ids in docs for i in ids})
        want = []
        for (d, _), ids in zip(rows, docs):
            own = {}
            for k in range(1, order + 1):
                for g in grams(ids, k):
                    own[g] = own.get(g, 0) + 1
            c = lambda g: counts.get(g, 0) - own.get(g, 0)  # noqa: B023, E731
            total, backed = 0.0, 0
            x = [-1] * (order - 1) + ids
            for i in range(len(ids)):
                p = (c((ids[i],)) + 1) / (max(1, n_all - len(ids)) + kinds)
                for k in range(2, order + 1):
                    g = tuple(x[i + order - k : i + order])
                    p = c(g) / c(g[:-1]) if c(g) > 0 and c(g[:-1]) > 0 else 0.4 * p
                    on = c(g) > 0 and c(g[:-1]) > 0
                total += float(np.log(p))
                backed += not on
            want.append((d, len(ids), round(total, 6), backed))
        assert got == sorted(want)
        plain = {k: v for k, v in counts.items() if k != (-1,) * len(k)}
        assert sorted(r["total"] for r in ngramlm.count_table(tokens, order).collect()) == sorted(plain.values())
    empty = ngramlm.tokenized(make_docs([]), path)
    assert ngramlm.score(empty).count() == 0 == ngramlm.count_table(empty).count()
    # another corpus's counts: a text of it scores better than one of unseen words, and nothing is taken off
    own = {r["doc_id"]: r["log_score"] for r in ngramlm.score(ngramlm.tokenized(make_docs([(1, "the cat sat"), (2, "xylo quark"), (None, None)]), path), 3, tokens).collect()}
    c = lambda g: counts.get(tuple(t.encode(g, add_special_tokens=False).ids), 0)
    assert own[None] == 0 and own[1] > own[2] and c("the") > 0
    assert {r["log_score"] for r in ngramlm.score(tokens, 3, empty).collect()} >= {0.0}


def test_the_query_sees_two_tokens_of_context(spark, make_docs, tmp_path):
    from depquarry.llm.queries import op8_backoff_lm

    docs = make_docs([(0, "the cat sat on the mat"), (1, "the cat sat on the hat"), (2, "the cat sat")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokens = ngramlm.tokenized(docs, tokenizer_file("byte_bpe_50k.json"))
    scores = lambda x: {r["doc_id"]: round(r["log_score"], 9) for r in x.collect()}
    got = scores(op8_backoff_lm(spark, str(tmp_path)))
    assert got == scores(ngramlm.score(tokens, 3)) != scores(ngramlm.score(tokens, 2))
