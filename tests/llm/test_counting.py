"""Phrases, sources and byte pairs against brute force, with nulls, empties, ties, repeats and long texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, collocations, divergence
from barloom.llm.queries import tokenizer_file

SCHEMA = "doc_id long, lang string, source string, text string, n string, term string, number string, ids string, first string"


def table(spark, rows):
    return spark.createDataFrame([(k, *row, "n", "t", "x", "i", "f") for k, row in enumerate(rows)], SCHEMA).repartition(5)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of_prose(seed, n, words=40):
    pick = random.Random(seed)
    known = ["".join(pick.choices("abcéßÀ日", k=pick.randint(1, 12))) for _ in range(words)]
    known += ["longer" * 3 + x for x in "abc"] + ["longer" * 3]
    weights = [1 / (k + 1) for k in range(len(known))]
    rows = []
    for _ in range(n):
        lang, source = pick.choice(["en", "en", "fr", None, "und", ""]), pick.choice(["a", "b", "ü", None, "", "hot", "hot", "hot"])
        words_here = pick.choices(known, weights, k=pick.randint(0, 30))
        if pick.random() < 0.4:
            words_here += ["fixed", "phrase", "here"] if pick.random() < 0.8 else ["fixed", "phrase"]
        text = "".join(w + pick.choice([" ", "  ", "\t", ". ", "\n", "!", " \x00", "\x1c "]) for w in words_here)
        rows.append((lang, source, pick.choice([text, text.upper(), text])))
    return rows + [(None, None, None), ("empty", "a", ""), ("empty", "b", None), ("lonely", "a", "12 34"), ("en", "none", "...")] + rows[:9]


# Operator 11


def test_one_batch_of_texts_is_held_at_a_time():
    import weakref

    held = []

    def batches():
        for k in range(3):
            assert all(ref() is None for ref in held)
            batch = pa.record_batch([pa.array(["en"] * 300), pa.array([f"a b c{k}"] * 300)], names=["lang", "text"])
            held.append(weakref.ref(batch))
            yield batch
            del batch

    found = list(collocations.windows(batches(), 2, 1 << 20))
    assert len(held) == 3 and sum(w.word_counts().sum() for w in found) == 2700


def best_phrases(rows, least, top):
    words, f = Counter(), defaultdict(Counter)
    for lang, _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und" if lang is None else lang] += len(own)
            for k in (1, 2, 3):
                for i in range(len(own) - k + 1):
                    f["und" if lang is None else lang][tuple(own[i : i + k])] += 1
    found = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * b >= 50 * a for t, b in candidates.items() if len(t) == 3 and p in (t[:2], t[1:])):
                continue
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(found)


@pytest.mark.parametrize("top, window, held", [(2000, 4 << 20, 1 << 20), (3, 200, 50), (40, 90, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, top, window, held):
    monkeypatch.setattr(collocations, "WINDOW_BYTES", window)
    monkeypatch.setattr(collocations, "ENTRIES_HELD", held)
    rows = rows_of_prose(3, 300)
    got = collocations.collocations(table(spark, rows), top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, 10, top)


def test_collocations_with_a_crowded_filter(spark, monkeypatch):
    """Keys that share bits cost rows, not results."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 7)
    rows = rows_of_prose(4, 200)
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), top=5).collect())) == best_phrases(rows, 10, 5)


def test_collocations_of_little(spark):
    assert collocations.collocations(table(spark, [("en", "a", "x")]).limit(0)).count() == 0
    assert collocations.collocations(table(spark, [(None, None, None), ("en", "a", "one two")])).count() == 0
    got = collocations.collocations(table(spark, [("en", "a", "one two " * 10)])).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in got] == best_rows("one two " * 10)


def best_rows(text):
    return [r[2:7] for r in best_phrases([("en", "a", text)], 10, 2000)]


def test_scores_beyond_64_bits(spark):
    huge = 10**12 + 7
    df = spark.createDataFrame([(huge, huge + 1, huge + 2)], "a long, l long, r long")
    assert df.select(collocations.score("l", "r")).first()[0] == 10**6 * huge * huge // ((huge + 1) * (huge + 2))


def test_pair_keys_are_those_of_spark(spark):
    window = collocations.PhraseWindow()
    window.add("fr", ["é".encode(), b"ab", b"."], 0, 5)
    window.add("en", [b"ab", b"a" * 50, b"z"], 0, 5)
    pairs, _, counts = window.pairs()
    rows = [tuple(x.as_py() for x in row) for row in zip(*window.columns(pairs >> 32, pairs & 0xFFFFFFFF), strict=True)]
    assert sorted(rows) == [("en", "a" * 50, "z"), ("en", "ab", "a" * 50), ("fr", "é", "ab")] and counts.tolist() == [1, 1, 1]
    got = spark.createDataFrame(rows, "lang string, first string, second string").select(collocations.pair_key("lang", "first", "second"))
    assert [r[0] for r in got.collect()] == window.pair_keys(pairs).view(np.int64).tolist()


# Operator 12


def audit(rows, least, top):
    terms = [(("" if lang is None else lang), ("" if s is None else s), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for lang, s, t in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, own in terms:
        docs[lang].update(set(own))
        counts[lang, source].update(own)
        groups[lang].add(source)
    found = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                found += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(values, 1)]
    return sorted(found)


@pytest.mark.parametrize("sizes", [(16 << 20, 1 << 19, 128, 1 << 15), (300, 40, 2, 3), (1, 7, 3, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("SLICE_BYTES", "SLICE_POINTERS", "SOURCES_AT_ONCE", "TERMS_AT_ONCE"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, value)
    rows = rows_of_prose(5, 250)
    got = divergence.divergence(table(spark, rows), least_documents=12, top_terms=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == audit(rows, 12, 7)


def test_divergence_of_little(spark):
    assert divergence.divergence(table(spark, [("en", "a", "x")]).limit(0)).count() == 0
    rows = [("en", "a", None), ("en", "b", "rare words"), (None, None, "")]
    assert sorted(map(tuple, divergence.divergence(table(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("most", [1 << 19, 150, 3])
def test_pointer_sort_equals_sorting_strings(monkeypatch, most):
    monkeypatch.setattr(divergence, "SLICE_POINTERS", most)
    pick = random.Random(2)
    words = [b"a" * pick.randint(1, 30) + bytes(pick.choices(b"abz\xff", k=pick.randint(0, 9))) for _ in range(1500)] + [b"b"] * 400
    pick.shuffle(words)
    buffer = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    starts, sizes = divergence.term_pointers(buffer)
    order, runs = divergence.sort_pointers(buffer, starts, sizes)
    assert [words[k] for k in order] == sorted(words)
    assert [words[k] for k in order[runs]] == sorted(set(words))


def test_shares_beyond_64_bits(spark):
    n, total, kept = 10**14 + 3, 10**16 + 9, 10**6
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(divergence.share("n", "total", "kept")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_slices_of_sliced_batches():
    batch = pa.record_batch([pa.array(["", "ab", None, "é", "cd"])], names=["text"]).slice(1, 4)
    filled = batch.set_column(0, "text", batch.column(0).fill_null(""))
    assert [t for _, texts in divergence.slices(filled, 3) for t in texts] == [b"ab", b"", "é".encode(), b"cd"]


# Operator 13


def one_by_one(ranks, match):
    """Merge the leftmost pair of least rank until none is left."""
    if match in ranks:
        return [ranks[match]]
    parts = [match[k : k + 1] for k in range(len(match))]
    while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def ranks():
    return tokenizer_file("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    pick = random.Random(9)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[k : k + 9000])) for k in range(0, len(points), 9000)]
    texts += ["".join(chr(pick.choice(points)) for _ in range(pick.randint(0, 30))) for _ in range(300)]
    texts += ["".join(pick.choices("abcdeABC .,'s019éü\n\t　\x1c\x85\x00", k=pick.randint(0, 90))) for _ in range(500)]
    return texts + ["", " ", "\n\n  x  ", "a" * 3000, "日本語のテキスト" * 300, "ab" * 40, "don't we'll I'M 'sub", "<|endoftext|>"]


@pytest.mark.parametrize("at_once", [byte_bpe.MATCHES_AT_ONCE, 7])
def test_encoding_equals_the_library(ranks, monkeypatch, at_once):
    monkeypatch.setattr(byte_bpe, "MATCHES_AT_ONCE", at_once)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 100 if at_once == 7 else byte_bpe.BLOCK_CHARS)
    tiktoken = pytest.importorskip("tiktoken")
    from public_tokenizers import PATTERN

    merges, splitter = byte_bpe.Merges.of_file(ranks), byte_bpe.Splitter(PATTERN, byte_bpe.younger_characters())
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    texts = odd_texts()
    ids, bounds = byte_bpe.encode_texts(texts, splitter, merges)
    for text, i, j in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[i:j].tolist() == library.encode_ordinary(text)
        assert merges.decode(ids[i:j].astype(np.int64)) == text.encode()


@pytest.mark.parametrize("least", [1, 10**9])
def test_merges_equal_one_by_one(monkeypatch, least):
    """On vocabularies with tokens that merges cannot reach, side by side and alone."""
    monkeypatch.setattr(byte_bpe, "LEAST_TREES", least)
    pick = random.Random(1)
    for _ in range(20):
        longer = {bytes(pick.choices(b"abc", k=pick.randint(2, 6))) for _ in range(40)}
        tokens = [bytes([b]) for b in range(256)] + sorted(longer, key=lambda _: pick.random())
        ranks = {t: k for k, t in enumerate(tokens)}
        matches = [bytes(pick.choices(b"abcd", k=pick.randint(1, 60))) for _ in range(200)]
        ids, starts = byte_bpe.Merges(ranks).encode_matches(matches)
        assert [ids[i:j].tolist() for i, j in zip(starts[:-1], starts[1:], strict=True)] == [one_by_one(ranks, m) for m in matches]


def test_round_trip_on_spark(spark, ranks, monkeypatch):
    from public_tokenizers import PATTERN

    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 500)
    texts = [*odd_texts()[-60:], None, "same", "same"]
    docs = table(spark, [("en", "s", t) for t in texts]).withColumn("doc_id", F.expr("nullif(doc_id, 5)"))
    back = byte_bpe.decoded(byte_bpe.encoded(docs, ranks, PATTERN), ranks).collect()
    assert Counter(bytes(r.decoded) for r in back) == Counter((t or "").encode() for t in texts)
    assert sum(r.doc_id is None for r in back) == 1 and {len(r.ids) for r in back if not r.decoded} == {0}
    assert byte_bpe.encoded(docs.limit(0), ranks, PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.Merges.of_file(ranks).decode(np.array([60000]))


def test_long_match(ranks):
    """A match of a megabyte; ids have been compared with the library on shorter ones."""
    word = "".join(random.Random(0).choices("abcdefgh", k=1 << 20)).encode()
    merges = byte_bpe.Merges.of_file(ranks)
    assert merges.decode(merges.merge_alone(word).astype(np.int64)) == word
    assert hashlib.sha256(b"".join(merges.tokens[k] for k in merges.merge_alone(word[:5000]).tolist())).digest() == hashlib.sha256(word[:5000]).digest()
