"""Operator 11 against a plain byte-by-byte version."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from punctuality.llm import token_alignment

COLUMNS = [c.split()[0] for c in token_alignment.DIGEST.split(", ")]


@pytest.fixture(scope="module")
def plain():
    """The tokenizers as their files say, without this package's shortcuts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from punctuality.llm.word_counts import byte_symbols

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = byte_symbols()

    def cut(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        return ids_a, bytes_a, ids_b, bytes_b

    return cut


def brute(texts, cut):
    """One row per text, by the words of the contract."""
    found, documents = [], Counter()
    for text in texts:
        ids_a, bytes_a, ids_b, bytes_b = cut(text) if text else ([], [], [], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            found.append(([], [], [], []))
            continue
        owner = {}
        for side, parts in enumerate((bytes_a, bytes_b)):
            at = 0
            for i, part in enumerate(parts):
                for byte in range(at, at + len(part)):
                    owner[byte, side] = i
                at += len(part)
        links = sorted({(owner[i, 0], owner[i, 1]) for i in range(len(raw))})
        ends_a = {sum(map(len, bytes_a[: i + 1])) for i in range(len(bytes_a))}
        both, at_a, at_b, groups, own_a, own_b = 0, 0, 0, [], [], []
        while at_a < len(ids_a) or at_b < len(ids_b):
            if own_a and (at_a == len(ids_a) or sum(map(len, bytes_a[:at_a])) > sum(map(len, bytes_b[:at_b]))):
                own_b.append(ids_b[at_b])
                at_b += 1
            else:
                own_a.append(ids_a[at_a])
                at_a += 1
            done_a, done_b = sum(map(len, bytes_a[:at_a])), sum(map(len, bytes_b[:at_b]))
            if done_a == done_b and done_a in ends_a:
                groups.append((own_a, own_b))
                own_a, own_b, both = [], [], done_a
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        documents.update(set(pairs))
        found.append((ids_a, ids_b, groups, pairs))
    most = {}
    for (a, _), n in documents.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for ids_a, ids_b, groups, pairs in found:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append(
            (
                len(ids_a), len(ids_b), len(groups), len(pairs),
                sum(documents[p] == most[p[0]] for p in pairs), sum(documents[p] for p in pairs),
                hashlib.sha256(told.encode()).hexdigest() if told else "",
            )
        )
    return rows


def texts():
    rng = random.Random(3)
    words = ["the", "naïve", "straße", "Großvater", "日本語", "🙂", "x", "don't", "  ", "\n", "\t", "1234", "<s>", "<|endoftext|>", "É", "a▁b", "́", "\x00"]
    made = ["".join(rng.choice(words) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    return [None, "", " ", "   ", "hello world", "hello world", "▁", "é" * 500, "ab" * 3000, *made]


@pytest.mark.parametrize("links", [token_alignment.BLOCK_LINKS, 40])
def test_digest_is_the_plain_one(spark, plain, links):
    own = texts()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit(1).alias("block"), F.lit("x").alias("pairs")).repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in token_alignment.alignment_digest(docs, links=links).collect()}
    assert len(got) == len(own)
    wanted = brute(own, plain)
    assert got == dict(enumerate(wanted))
    assert any(w[0] == 0 for w in wanted[6:]) and sum(w[0] > 0 for w in wanted) > 60


def test_given_texts_agree_with_the_plain_tokenizers(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = spark.createDataFrame([(r["doc_id"], r["text"][:600]) for r in docs.collect()], "doc_id long, text string")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in token_alignment.alignment_digest(docs).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], plain), strict=True))


def test_empty_table_repeats_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.alignment_digest(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (7, None)], "doc_id long, text string")
    got = token_alignment.alignment_digest(docs).collect()
    assert sorted(r["n_a"] for r in got) == [0, 2, 2, 2]
    assert {r["count_sum"] for r in got} == {0, 6}  # three rows hold each pair
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in token_alignment.alignment_digest(nothing).collect()] == [(0,) * 6 + ("",)] * 2


def test_links_are_tokens_less_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = token_alignment.alignment_digest(docs).where("n_links != n_a + n_b - n_groups or n_best > n_links or count_sum < n_links")
    assert wrong.count() == 0
