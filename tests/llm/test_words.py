"""Word hashes, sieves, token counts, packing, fertility: against plain Python."""

import random
import zlib

import numpy as np
import pytest

from punctuality.llm import fertility, packing, texts, word_counts

AWKWARD = [
    (1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "no id here"), (4, " \t\n "), (5, "Ünïcode ñ 中文 é%%%"),
    (6, "a\x0bb\x0cc\x1cd\xa0e"), (7, "DON'T stop 1990s!!"), (8, "word " * 30_000),
]


@pytest.fixture
def awkward(spark):
    rows = [(i, t, "en", "a", 1, "extra", 7) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, cell int")


def test_word_hashes_follow_the_words():
    hashes = texts.WordHashes()
    for _, text in AWKWARD:
        words, got = texts.words_of(text), hashes.of(text)
        assert len(words) == len(got)
        assert len(set(words)) == len(set(got.tolist()))
        by_word = dict(zip(words, got.tolist(), strict=True))
        assert [by_word[w] for w in words] == got.tolist()
    assert hashes.of("AbÉ", lower=True).tolist() == hashes.of("abÉ").tolist()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["a", "bb", "ccc", "é"]) for _ in range(500))
    whole = texts.WordHashes().of(text)
    monkeypatch.setattr(texts, "PIECE_BYTES", 17)
    assert texts.WordHashes().of(text).tolist() == whole.tolist()


def test_windows_depend_on_their_words_only():
    hashes = texts.WordHashes()
    w = hashes.windows(hashes.of("x a b c y a b c z"), 3)
    assert w[1] == w[5] and len(set(w.tolist())) == 6
    assert len(hashes.windows(hashes.of("a b"), 3)) == 0


def test_memo_is_bounded():
    memo = texts.Remembered(len, most=10)
    assert [memo[bytes([65 + k]) * k] for k in range(1, 60)] == list(range(1, 60))
    assert len(memo) + len(memo.older) <= 11


def test_without_keeps_columns_and_rows(spark, awkward):
    gone = texts.keyed(awkward).where("doc_id in (1, 3)").selectExpr("__row_a a", "__row_b b")
    left = texts.without(awkward, gone)
    assert left.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in AWKWARD if i not in (1, 3))


def test_a_full_sieve_lets_everything_pass(spark, monkeypatch):
    monkeypatch.setattr(texts, "SIEVE_SLOTS", 1 << 15)
    keys = spark.range(400_000).withColumnRenamed("id", "a")
    bits = texts.sieve(keys, "a")
    assert texts.sifted(spark.range(1000).withColumnRenamed("id", "a"), bits, "a").count() == 1000


def test_automaton_counts_greedy_pieces():
    pieces = {bytes([b]) for b in range(256)} | {b"ab", b"abc", b"abcd", b"bcde", b"cd", b" a", b" ab", b"eabcd", b"dd"}
    automaton = word_counts.LongestMatch(sorted(pieces))
    pick = random.Random(2)
    for _ in range(3000):
        word = bytes(pick.choice(b"abcde ") for _ in range(pick.randrange(12)))
        assert automaton.count(word) == word_counts.greedy_count(pieces, word)


def test_automaton_needs_all_bytes():
    with pytest.raises(ValueError):
        word_counts.LongestMatch([b"a", b"ab"])


def test_public_vocabulary_formats_agree():
    import public_tokenizers as public

    one = set(word_counts.pieces_of(public.path("byte_bpe_50k.json")))
    assert one == set(word_counts.pieces_of(public.path("byte_bpe_50k.tiktoken")))
    automaton = word_counts.LongestMatch(sorted(one))
    for word in (" hello", " unbelievable", " Été", " %%%%", " 中文"):
        assert automaton.count(word.encode()) == word_counts.greedy_count(one, word.encode())


def test_token_counts_of_awkward_rows(awkward):
    rows = word_counts.token_counts(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {(r.doc_id, r.n_words) for r in rows} >= {(1, 3), (2, 0), (3, 0), (None, 3), (4, 0), (8, 30_000)}
    assert all(r.n_pieces == 0 for r in rows if not r.n_words)


def test_word_encoder_is_the_tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path(packing.TOKENIZER)
    plain, encode = Tokenizer.from_file(path), packing.word_encoder(path)
    plain.encode_special_tokens = True
    words = [w for _, t in AWKWARD[:-1] for w in texts.words_of(t)]
    words += [w.encode() for w in ("İstanbul", "Σίσυφος", "áb", "x\xadz", "<|endoftext|>", "ﬁne", "it's", "ß", "\x85")]
    for word in words:
        ids = np.array(plain.encode(word.decode(), add_special_tokens=False).ids, "<u4")
        assert encode(word) == ids.tobytes(), word


@pytest.mark.parametrize("seed", range(30))
def test_plan_holds_every_piece_once(seed):
    pick, capacity = random.Random(seed), 100
    counts = {}
    for _ in range(pick.randrange(1, 200)):
        n = pick.randrange(1, capacity + 1) if seed % 3 else pick.choice([34, 35, 40, 50, 66, 67])
        counts[n] = counts.get(n, 0) + pick.randrange(1, 40)
    shapes = packing.plan(counts, capacity)
    used = {}
    for repeats, parts in shapes:
        assert repeats > 0 and sum(n * k for n, k in parts) <= capacity
        assert sum(k for n, k in parts if 3 * n > capacity) <= 2
        for n, k in parts:
            used[n] = used.get(n, 0) + repeats * k
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(r for r, _ in shapes) <= 1.5 * -(-total // capacity) + 1


def test_plan_pairs_large_items():
    assert sorted(packing.plan({60: 1, 40: 1, 90: 1, 10: 1}, 100)) == [(1, [(60, 1), (40, 1)]), (1, [(90, 1), (10, 1)])]


def test_packed_rows(awkward):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path(packing.TOKENIZER))
    plain.encode_special_tokens = True
    rows = packing.packed(awkward).collect()
    want = []
    for doc_id, text in AWKWARD:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            want.append((str(doc_id), piece, at, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_fertility_of_awkward_rows(awkward):
    rows = {(r.doc_id, r.n_words): r for r in fertility.fertility_rules(awkward).collect()}
    assert rows[(2, 0)].base_failed and not rows[(3, 0)].kept
    assert rows[(8, 30_000)].n_repeat_words == 30_000 and not rows[(8, 30_000)].kept
    assert rows[(7, 3)].word_chars == 16


def test_fertility_counts_and_bands(spark, sf_dir):
    """Base counts by brute force, and a verdict that spares good labelled texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in fertility.fertility_rules(docs).collect()}
    for r in docs.collect():
        words = texts.words_of(r.text)
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(5)} if len(words) < 400 else None
        if hit is not None:
            assert got[r.doc_id].n_repeat_words == len(hit)
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        assert got[r.doc_id].n_dup_lines == len(lines) - len(set(lines))


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    assert packing.packed(none).count() == 0
    assert word_counts.token_counts(none).count() == 0
    assert fertility.fertility_rules(none).count() == 0


@pytest.mark.parametrize("text, chars", [("ab\x1ccd ef", 7), ("a\x85b c", 4), ("\x1f", 1), ("é\u3000é x\x0by", 5), ("", 0)])
def test_only_ascii_white_space_parts_words(spark, text, chars):
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    assert fertility.fertility_rules(docs).first().word_chars == chars
