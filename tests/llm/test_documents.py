"""Operators over documents against brute force on small tables with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import decontamination, language, line_crf, ngram_join, packing, suffix_dedup, token_counts
from barloom.llm.chunks import magnitudes
from barloom.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, chunk string, kind string, n_words string, tokens string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    pick = random.Random(7)
    words = ["".join(pick.choices("abcdéfghij", k=pick.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(pick.choices(words, k=n))
    base, passage = prose(80), prose(30)
    texts = [base, base, base + " " + prose(3), prose(5) + " " + base, None, "", "  \n ", "one two", "One TWO", "a b c d e", base.upper()]
    for k in range(40):
        parts = base.split()
        for _ in range(k % 9):
            parts[pick.randrange(len(parts))] = pick.choice(words)
        texts.append(" ".join(parts))
    texts += [prose(pick.randint(1, 60)) + " " + passage + "\n" + prose(pick.randint(1, 60)) for _ in range(30)]
    texts += [prose(4000), "x" * 400, "x" * 120, "日本語のテキスト" * 20, "日本語のテキスト" * 12 + "a"]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    pick.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", "k", "n", "t") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup_equals_brute_force(docs, rows):
    length, first = 50, {}
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in texts:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    got = {r.doc_id: r for r in suffix_dedup.repeat_report(docs).collect()}
    for i, t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                mask[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mask)))
        assert tuple(got[i]) == (i, len(t), sum(mask), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_repeated_and_null_ids(spark, none):
    text = "abcdefghijklmnopqrstuvwxyz" * 3
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.repeat_report(docs).collect())
    assert got == [(0, 78), (1, 0), (1, 0), (2, 78)]
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert suffix_dedup.repeat_report(none).count() == 0


def test_suffix_dedup_hot_line_among_differing_texts(spark, monkeypatch):
    """A task refines at most SLICE different contexts of one key; results equal brute force."""
    pick = random.Random(3)
    prose = lambda: "".join(pick.choices("abcdefgh ", k=pick.randint(40, 120)))
    line = "Licensed under the Example License, version 2 of 2020.\n\n\n"
    texts = [prose() + line + prose() for _ in range(90)]
    texts += [texts[5] + texts[7], texts[5] + prose(), line, line * 4]
    smallest, most = suffix_dedup.smallest_documents, 16

    def guarded(keys, offsets, sizes, ids, strings, length):
        contexts = {(int(k), int(o), s.tobytes()) for k, o, s in zip(keys, offsets, strings, strict=True)}
        assert max(Counter(k for k, *_ in contexts).values()) <= most
        return smallest(keys, offsets, sizes, ids, strings, length)

    monkeypatch.setattr(suffix_dedup, "SLICE", most)
    monkeypatch.setattr(suffix_dedup, "smallest_documents", guarded)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_report(docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        mask = bytearray(len(t))
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                mask[p : p + 50] = b"\1" * 50
        assert got[i] == sum(mask)
    assert sum(got.values()) > 90 * 50


def test_refine_equals_the_strings():
    pick = np.random.default_rng(1)
    strings = pick.integers(97, 99, (40, 88), dtype=np.uint8)
    strings[20:30] = strings[:10]
    sizes = pick.integers(50, 89, 40)
    pointers, seen = suffix_dedup.refine(strings, sizes), {}
    for r in range(40):
        for c in range(88):
            if c + 50 > sizes[r]:
                assert pointers[r, c] == -1
            else:
                assert seen.setdefault(pointers[r, c], strings[r, c : c + 50].tobytes()) == strings[r, c : c + 50].tobytes()
    assert len(set(seen.values())) == len(seen)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_ngram_join_equals_brute_force(docs, rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: (i, len(sets[i]), find(i)) for i in ids}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in ids if find(i) == i]


def test_ngram_join_blocks_repeats_and_nulls(spark, none, docs, monkeypatch):
    whole = {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    assert {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()} == whole
    text = "a b c d e f g"
    few = spark.createDataFrame([(5, text), (5, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(map(str, map(tuple, ngram_join.jaccard_components(few).collect())))
    assert got == sorted(map(str, [(5, 3, 2), (5, 3, 2), (2, 3, 2), (None, 3, None), (None, 0, None)]))
    assert ngram_join.jaccard_components(none).count() == 0


def test_rarer_of_two_common_shingles_stands_first(spark):
    # beyond 255 documents both counted alike, and hashes decided which of them begins a set
    common = [" ".join(f"{kind}{k}" for k in range(12)) for kind in "abcdefgh"]
    texts = [" . ".join(common[: 8 if k < 260 else 4 if k < 350 else 2]) + f" x{k}" for k in range(520)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    holders = Counter(int(x) for text in texts for x in shingle_numbers(text))
    rows = [np.frombuffer(r.tokens, np.uint64) for r in ngram_join.document_sets(docs).collect() if r.tokens is not None]
    assert len(rows) == 520
    by_hash = {x >> 8: n for x, n in holders.items()}
    for tokens in rows:
        counts = [by_hash[int(t) & (1 << 56) - 1] for t in tokens]
        assert counts == sorted(counts)


def shingle_numbers(text):
    return ngram_join.shingle_sets([text.encode()])[0]


def test_links_apart_equal_brute_force(monkeypatch):
    pick = np.random.default_rng(5)
    monkeypatch.setattr(ngram_join, "WIDE", 6)
    for round_ in range(30):
        base = np.sort(pick.choice(1 << 40, 60, replace=False).astype(np.uint64))
        sets, sizes = [], []
        for k in range(40):
            mine = base[pick.random(60) > 0.12 * (1 + k % 2)]
            sets.append(np.sort(np.unique(np.concatenate([mine, pick.choice(1 << 40, 3).astype(np.uint64)]))))
            sizes.append(len(sets[-1]) + int(pick.integers(0, 1 + len(sets[-1]) // 4)))
        sizes, component, block = np.array(sizes), pick.integers(0, 25, 40), pick.integers(0, 2, 40)
        both = int(pick.integers(0, 3))

        def joined(pairs):
            root = {c: c for c in component.tolist()}
            for a, b in pairs:
                a, b = root[int(component[a])], root[int(component[b])]
                root = {c: min(a, b) if r in (a, b) else r for c, r in root.items()}
            return root

        overlap = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        links = [(a, b) for a in range(40) for b in range(a) if block[a] + block[b] == both and ngram_join.linked(overlap(a, b), sizes[a], sizes[b])]
        found = ngram_join.links_apart(sets, sizes, component, block, both)
        assert joined(found) == joined(links) and len(found) < 25
        assert all((a, b) in links or (b, a) in links for a, b in found)


def test_ngram_join_of_one_large_family_equals_brute_force(spark, monkeypatch):
    pick = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    base, texts = pick.choices(words, k=60), []
    for k in range(90):
        parts = list(base)
        for _ in range(k % 4):
            parts[pick.randrange(60)] = pick.choice(words)
        texts.append(" ".join(parts))
    sets = [shingles(t) for t in texts]
    root = list(range(90))
    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert len(set(root)) > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name, value in (("BLOCK", 8), ("PAIRS_PER_TASK", 16), ("WIDE", 4)):
        monkeypatch.setattr(ngram_join, name, value)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == dict(enumerate(root))


def test_magnitudes_keep_the_order():
    totals = np.unique(np.concatenate([np.arange(2, 5000), 2 ** np.arange(1, 37)])).astype(np.uint64)
    told = magnitudes(totals)
    assert told.dtype == np.uint8 and (np.diff(told.astype(int)) >= 0).all() and told[totals < 64].tolist() == totals[totals < 64].tolist()
    assert len(set(magnitudes(2 ** np.arange(6, 37)).tolist())) == 31


def test_decontamination_equals_brute_force(spark, docs, rows, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {i: word.findall(lower(t)) for i, t in rows}
    long = next(t for i, t in rows if t and len(t.split()) > 3000)
    items = [("a", " ".join(long.split()[100:125])), ("b", long.split()[7] + " " + long.split()[8]), ("c", None), ("d", "!!"), ("e", " ".join(long.split()[110:121])), (None, " ".join(long.split()[300:311]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, benchmark, with_matches=True).collect()}
    assert "matches" not in decontamination.contamination(docs, benchmark).columns
    for i, words in texts.items():
        hit, met = set(), set()
        for item, text in items:
            own = word.findall(lower(text))
            n = min(10, len(own))
            for q in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[q : q + n]:
                        hit.update(range(p, p + n))
                        met |= {item} - {None}
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(words), len(hit), sorted(met))
    assert max(m.n_words for r in got.values() for m in r.matches) == 25
    clean = decontamination.without_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r.n_hit for r in got.values())
    assert decontamination.contamination(docs, benchmark.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontamination.contamination(none, benchmark).count() == 0


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in packing.pack(docs, path, with_ids=True).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], np.uint32).tobytes()
        assert (bytes(r.ids), r.ids_crc32, r.doc_tokens) == (part, zlib.crc32(part), len(ids[r.doc_id]))
        pieces[r.doc_id][r.start] = r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        assert sum(pieces[i].values()) == len(own) and all(s + n in pieces[i] or s + n == len(own) for s, n in pieces[i].items())
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(none, path).count() == 0


def test_word_tokenizer_edge_cases():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    own, tokenizer = packing.WordTokenizer(path), Tokenizer.from_file(path)
    for text in ["a\x1cb c", "<|endoftext|>x", "été CAFÉ. don't ..a.b", "é क़ 각 a≮b", "", " x y", "İstanbul, ΣΑΣ"]:
        assert list(np.frombuffer(own.encode(text), np.uint32)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_known_words_are_looked_up_once(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    own, tokenizer = packing.WordTokenizer(path), Tokenizer.from_file(path)
    texts = ["Some words, some WORDS.", "", "some " + "long" * 40 + " word, \x1c x"]
    whole = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert own.encode_all(texts) == whole
    asked = []
    monkeypatch.setattr(own, "learn", lambda words: asked.append(words))
    assert own.encode_all(texts[:2] * 3) == whole[:2] * 3 and asked == [set()]
    monkeypatch.undo()
    # a table that is full is forgotten between looking up and learning
    monkeypatch.setattr(packing, "CACHE_BYTES", 0)
    assert own.encode_all(["fresh " + t for t in texts[:1]]) == [np.array(tokenizer.encode("fresh " + texts[0], add_special_tokens=False).ids, np.uint32).tobytes()]


def test_histogram_packing_places_all_pieces():
    pick = np.random.default_rng(3)
    histogram = dict(Counter(pick.integers(1, 2049, 5000).tolist()))
    fill, placed = defaultdict(int), Counter()
    for p in sorted(packing.pack_histogram(histogram), key=lambda p: p.offset):
        placed[p.length] += p.count
        for k in range(p.sequence, p.sequence + p.count):
            assert fill[k] == p.offset
            fill[k] += p.length
    assert placed == histogram and max(fill.values()) <= 2048
    assert sum(fill.values()) / (2048 * len(fill)) > 0.97


def test_language_profiles(spark, none):
    texts = {"en": "the cat sat on the mat with the other cats and then they went", "es": "el gato negro que estaba en la casa de los niños"}
    train = spark.createDataFrame([(k, t, n) for k, (n, t) in enumerate(texts.items())] + [(9, None, "en"), (10, "x", None)], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(train)
    assert profiles.languages == ["en", "es"]
    ask = spark.createDataFrame([(1, "the mat and the cat"), (2, "la casa de los gatos"), (3, None), (4, "12 !"), (None, "the the")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(ask, profiles).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, None)] == ["en", "es", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(ask, language.fit_profiles(train.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language.predict(none, profiles).count() == 0 and language.with_language(ask, profiles).count() == 3


def test_language_distance_equals_brute_force():
    text = "Abba, ab b!"
    words = ["abba", "ab", "b"]
    grams = Counter(c for w in words for c in w)
    grams.update(x for w in words for x in (a + b for a, b in zip(f" {w} ", f" {w} "[1:], strict=False)))
    grams.update(f" {w} "[k : k + 3] for w in words for k in range(len(w)))
    found = language.count_grams([text])
    plain = {"".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(c) >> s & 0x1FFFFF): int(n) for c, n in zip(found.code, found.count, strict=True)}
    assert plain == grams


def test_line_crf(spark, none):
    pick = random.Random(1)
    good = lambda: "\n".join(" ".join(pick.choices(["some", "plain", "words", "here"], k=12)) + "." for _ in range(pick.randint(1, 5)))
    bad = lambda: "\n".join(" ".join(pick.choices(["SOME%%%", "WORDS&&&", "HERE$$$"], k=9)) for _ in range(pick.randint(1, 5)))
    texts = [(k, good() if k % 2 else bad()) for k in range(200)]
    docs = spark.createDataFrame([*texts, (500, None), (501, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    field = line_crf.fit(docs, labels)
    got = {r.doc_id: r for r in line_crf.score(docs, field).collect()}
    assert all(got[k].predicted == k % 2 for k in range(200)) and all(0 <= r.score <= 1 for r in got.values())
    assert len(got) == 203 and got[500].score == got[501].score
    assert line_crf.fit(docs, labels.limit(0)).weights.any() == False  # noqa: E712
    assert line_crf.score(none, field).count() == 0


def test_line_crf_learns_from_long_documents(spark, monkeypatch):
    lines = lambda k: "\n".join(["some plain words here."] * 400 if k % 2 else ["SOME%%% WORDS&&&"] * 400)
    docs = spark.createDataFrame([(k, lines(k)) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    fitted, sampled = line_crf.fit_field, []
    monkeypatch.setattr(line_crf, "fit_field", lambda found, y: sampled.extend(found.counts) or fitted(found, y))
    field = line_crf.fit(docs, labels)
    assert set(sampled) == {line_crf.SAMPLE_LINES} and len(sampled) > 15
    assert all(r.predicted == r.doc_id % 2 for r in line_crf.score(docs, field).collect())
    with pytest.raises(ValueError, match="both kinds"):
        line_crf.fit(docs.filter("doc_id % 2 = 1"), labels)


def test_forward_backward_equals_enumeration():
    scores, pairs, counts = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.2, -0.4], [0.1, 0.7]]), np.array([3, 1])
    got, expected = line_crf.marginals(scores, counts, pairs)
    total, good, seen = 0.0, np.zeros(3), np.zeros((2, 2))
    for path in np.ndindex(2, 2, 2):
        weight = np.exp(sum(scores[k] * y for k, y in enumerate(path)) + sum(pairs[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        good += weight * np.array(path)
        for a, b in zip(path, path[1:], strict=False):
            seen[a, b] += weight
    assert np.allclose(got, [*(good / total), 1 / (1 + np.exp(-0.5))]) and np.allclose(expected, seen / total)


def test_token_counts_equal_the_tokenizer(docs, rows, none, tmp_path):
    import math

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for k, piece in enumerate(model.pieces):  # coarse scores make ties
        piece.score = -round(math.log(k + 2) * 16) / 16 if piece.type == 1 else piece.score
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, str(path)).collect()}
    assert got == {i: len(tokenizer.encode(t or "")) for i, t in rows}
    for text in ["  a", "a\n\nb  c", "🎉x", " ", "naïve\tcafé"]:
        assert token_counts.Vocabulary(str(path)).count(text)[0] == len(tokenizer.encode(text))
    assert token_counts.token_counts(none, str(path)).count() == 0


# Odd and long inputs


def memory_of(function) -> int:
    """Peak bytes that numpy and Python allocate while the function runs."""
    import tracemalloc

    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_of_a_blank_free_text_equals_the_uncut_count(monkeypatch):
    pick = random.Random(4)
    text = "".join(pick.choices("あいうえおかきくけこß日本é", k=40_000)) + " x1 " + "".join(pick.choices("abΣ ", k=9000))
    (whole,) = [language._count_grams([text.lower()])]
    for size in (11, 300, 4096):
        monkeypatch.setattr(language, "BATCH_CHARS", size)
        got = language.count_grams([text, None, "ab"])
        own = got.text == 0
        assert (got.code[own] == whole.code).all() and (got.count[own] == whole.count).all()


def test_language_distance_equals_brute_force():
    """Counts, ranks, ties and distances written out."""
    pick = random.Random(6)
    train = {"b": ["ab abc " * 5, "cab"], "a": ["xyz xy"], "c": ["ab abc " * 5, "cab"]}

    def grams(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            out.update(word)
            out.update(padded[k : k + 2] for k in range(len(padded) - 1))
            out.update(padded[k : k + 3] for k in range(len(padded) - 2))
        return out

    order = lambda counts, key: sorted(counts, key=lambda g: (-counts[g], key[g]))
    names = sorted(train)
    texts = ["ab abc", "xyz", "zz", "a", "", None, "12 34", "cab xy", "".join(pick.choices("abcxyz ", k=200))]
    everything = [t or "" for t in texts] + [t for own in train.values() for t in own]
    found = language.count_grams(everything)
    total = [grams(t) for t in everything]
    for k, own in enumerate(total):
        assert sorted(found.count[found.text == k].tolist()) == sorted(own.values())
    # the codes of n-grams, by matching texts that hold one n-gram more than another
    key = {}
    for k, own in enumerate(total):
        for g, n in zip(found.code[found.text == k].tolist(), found.count[found.text == k].tolist(), strict=True):
            points = [p for p in (g & 0x1FFFFF, g >> 21 & 0x1FFFFF, g >> 42) if p]
            name = "".join(map(chr, reversed(points)))
            assert own[name] == n or own[name[::-1]] == n
            key[name if own[name] == n and name in own else name[::-1]] = g
    profiles = {}
    for lang in names:
        counts = sum((grams(t) for t in train[lang]), Counter())
        profiles[lang] = {g: r for r, g in enumerate(order(counts, key)[: language.LENGTH])}
    codes = np.sort(np.array(list(key.values()), np.uint64))
    ranks = np.full((len(names), len(codes) + 1), language.LENGTH)
    for k, lang in enumerate(names):
        for g, r in profiles[lang].items():
            ranks[k, np.searchsorted(codes, key[g])] = r
    got, scores = language.closest(texts, language.Profiles(names, codes, ranks, language.LENGTH))
    for text, lang, score in zip(texts, got, scores, strict=True):
        own = order(grams(text or ""), key)[: language.LENGTH]
        if not own:
            assert (lang, score) == ("und", 0.0)
            continue
        distance = {name: sum(abs(profiles[name][g] - r) if g in profiles[name] else language.LENGTH for r, g in enumerate(own)) for name in names}
        best = min(names, key=lambda name: (distance[name], name))
        assert lang == best and abs(score - (1 - distance[best] / (len(own) * language.LENGTH))) < 1e-12


def test_long_texts_need_little_memory():
    breaks, line = b"\n" * 2_000_000, b"ab " * 1_000_000
    field = line_crf.Field(np.zeros(line_crf.line_features([b""]).features.shape[1]), np.zeros((2, 2)))
    for text in (breaks, line):
        assert memory_of(lambda text=text: line_crf.score_texts([text], field)) < 150 << 20
        assert line_crf.score_texts([text], field)[0] == pytest.approx(0.5)
    vocabulary = token_counts.Vocabulary(tokenizer_file("piece_bpe_32k.model"))
    word = "".join(random.Random(1).choices("abcdefgh", k=300_000))
    assert memory_of(lambda: vocabulary.count(word)) < 8 << 20
    assert word not in vocabulary.known


def test_chains_in_blocks_equal_whole_chains(monkeypatch):
    pick = np.random.default_rng(3)
    texts = ["".join(random.Random(k).choices("abC 01.!\n\n\té", k=60 * k)).encode() for k in range(12)] + [b"", b"\n", b"a\n"]
    field = line_crf.Field(pick.normal(size=line_crf.line_features([b""]).features.shape[1]), np.array([[0.5, -0.4], [0.1, 0.9]]))
    whole = line_crf.score_texts(texts, field)
    monkeypatch.setattr(line_crf, "LONG_LINES", -1)
    for size, lines in ((1, 1), (30, 4), (10**6, 7), (200, 10**6)):
        monkeypatch.setattr(line_crf, "BLOCK_BYTES", size)
        monkeypatch.setattr(line_crf, "BLOCK_LINES", lines)
        np.testing.assert_allclose(line_crf.score_texts(texts, field), whole, atol=1e-12)


def test_score_by_enumeration():
    """P(good) of every line from all labelings of a short document."""
    import itertools

    pick = np.random.default_rng(0)
    field = line_crf.Field(pick.normal(size=line_crf.line_features([b""]).features.shape[1]), pick.normal(size=(2, 2)))
    text = b"One two.\n\nTHREE 33 33 33\n!!! ???\nx"
    lines = line_crf.line_features([text])
    unary = lines.features @ field.weights
    total, good = 0.0, np.zeros(len(unary))
    for labels in itertools.product((0, 1), repeat=len(unary)):
        weight = np.exp(sum(u for u, y in zip(unary, labels, strict=True) if y) + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        total += weight
        good += weight * np.array(labels)
    want = (good / total) @ lines.weights / lines.weights.sum()
    assert line_crf.score_texts([text], field)[0] == pytest.approx(want)


def test_words_of_one_morphism_do_not_collide():
    from barloom.llm import scanning

    morse = lambda first: bytes(97 + (bin(k).count("1") + first) % 2 for k in range(1024))
    is_word = scanning.word_bytes((0x20,))
    a, b = scanning.scan_words([morse(0), morse(1)], is_word).hashes
    assert a != b
    hits = decontamination.search_shard([morse(1)], decontamination.windows_of([("x", morse(0))]))
    assert hits[0].n_hit == 0
    pick = random.Random(2)
    words = sorted({bytes(pick.choices(b"ab", k=pick.randint(1, 40))) for _ in range(20_000)})
    assert len(set(scanning.scan_words(words, is_word).hashes.tolist())) == len(words)


def test_a_sentence_of_many_items_and_documents():
    sentence = " ".join(f"w{k}" for k in range(30))
    windows = decontamination.windows_of([(str(k), f"{k}x {sentence} y{k}".encode()) for k in range(2000)] + [("short", b"filler")])
    text = ((sentence + " filler ") * 300).encode()
    assert memory_of(lambda: decontamination.search_shard([text], windows)) < 64 << 20
    (hits,) = decontamination.search_shard([text], windows)
    assert len(hits.items) == 2001 and hits.n_hit == hits.n_words and hits.matches == []
    small = decontamination.windows_of([("a", sentence.encode())])
    assert decontamination.search_shard([f"x {sentence}".encode()], small, True)[0].matches == [("a", 0, 1, 30)]
