"""Operators on documents against brute force, over texts of every awkward kind."""

import hashlib
import math
import os
import random
import tracemalloc
import zlib
from itertools import combinations
from random import Random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowloom.llm import language_id, line_dedup, mixing, packing, simhash_dedup, syncmers, token_counts, tokens, toxicity
from rowloom.llm.common import discard, held_out, keep, linked_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, fp string, id string, component_id int"
WORDS = "alpha beta gamma delta rho sigma tau upsilon phi chi psi omega".split()


def make(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    rows = [(k + first, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 3], None if t is None else len(t), "x", "y", "z", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    base = [" ".join(draw.choices(WORDS, k=draw.randint(30, 90))) for _ in range(25)]
    near = [t.replace("omega", "OMEGA", 1) for t in base[:8]] + [t.rsplit(" ", 1)[0] for t in base[8:16]]
    return [*base, *near, *base[:5], None, "", "   ", "\n\n", "one", "one two", "日本 語", "é" * 50, " ".join(draw.choices(WORDS, k=30_000)), None, ""]


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k:k + size]), 42) for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark, texts):
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_groups(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for node_rows in (4, 2048):
        found = simhash_dedup.near_duplicates(make(spark, texts), node_rows=node_rows)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()} == {
            k: (f"{p:016x}", want[k]) for k, p in enumerate(prints)
        }


def test_near_duplicates_of_odd_tables(spark, texts):
    assert simhash_dedup.near_duplicates(make(spark, texts).limit(0)).count() == 0
    twice = make(spark, ["a b c", "a b c"]).select(F.when(F.col("doc_id") == 1, 7).cast("long").alias("doc_id"), "text")
    found = simhash_dedup.near_duplicates(twice.union(twice)).collect()
    assert len(found) == 4 and {r.component_id for r in found} == {7}


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_links(budget):
    draw = np.random.default_rng(budget)
    base = draw.integers(0, 2**64, 300, dtype=np.uint64)
    bits = np.uint64(1) << draw.integers(0, 64, (3, 300)).astype(np.uint64)
    prints = np.unique(np.concatenate((base, base ^ bits[0], base ^ bits[0] ^ bits[1] ^ bits[2], np.array([0, 2**64 - 1], np.uint64))))
    far = simhash_dedup.popcount(prints[:, None] ^ prints[None, :])
    i, j = simhash_dedup.trie_links(prints, None, budget)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(np.triu(far <= budget, 1))))
    i, j = simhash_dedup.trie_links(prints[::2], prints[1::2], budget)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(far[::2, 1::2] <= budget)))


def test_linked_groups(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (201, 200), (200, 201)]
    found = {r.node: r.component for r in linked_groups(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert linked_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark):
    draw = random.Random(2)
    kinds = {"xx": "aeiou", "yy": "bcdfg"}
    rows = [(k, "".join(draw.choices(kinds[lang] + " ", k=200)), lang) for k in range(80) for lang in [draw.choice(list(kinds))]]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "", None), (902, "12 !?", "yy"), (903, "aei", None), (3, "bcd", None)], "doc_id long, text string, lang string")
    model = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    found = [tuple(r) for r in language_id.predict(docs, model).collect()]
    assert model.languages == ["xx", "yy"] and len(found) == 85
    by_id = {d: (p, s) for d, p, s in found if d != 3}
    assert all(by_id[d][0] == lang for d, _, lang in rows if d != 3)
    assert by_id[900] == by_id[901] == by_id[902] == ("und", 0.0) and by_id[903][0] == "xx"
    assert all(0 <= s <= 1 for _, _, s in found)
    empty = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_score_does_not_depend_on_neighbours(spark):
    docs = make(spark, ["ab cd", "", "zz", None, "ab cd", "é"])
    model = language_id.learn(docs)
    together = {r.doc_id: r.score for r in language_id.predict(docs.coalesce(1), model).collect()}
    apart = {r.doc_id: r.score for r in language_id.predict(docs.repartition(6), model).collect()}
    assert together == apart and together[0] == together[4]


def test_held_out_rows(spark):
    found = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in found)


def test_toxicity(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        words = draw.choices(WORDS, k=draw.randint(5, 60))
        if k % 4 == 0:
            words[draw.randrange(len(words))] = "nasty" + draw.choice(["ly", "er", "ish", ""])
            words.append("nastiest")
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "NASTYWORD nasty"), (1004, "alpha beta"), (5, "alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (1000, 1, None), (None, 1, 1), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marked)
    found = toxicity.score(docs, model).collect()
    assert len(found) == 406 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    by_id = {r.doc_id: r for r in found if r.doc_id != 5}
    held = [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 4 == 2 and k != 5]
    assert sum(by_id[k].predicted == int(k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert by_id[1003].predicted == 1 and by_id[1000].score == by_id[1001].score == by_id[1002].score
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit("own")), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found if not r.predicted)
    none = toxicity.learn(docs, marked.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fingerprints(spark, texts):
    for part_rows in (3, 1000):
        found = {r.doc_id: r for r in syncmers.document_fingerprints(make(spark, texts), part_rows).collect()}
        assert len(found) == len(texts)
        whole = [t or "" for t in texts]
        for k, text in enumerate(whole):
            other = whole[(k + 1) % len(whole)]
            edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
            row = found[k]
            assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            marks = [syncmers.fingerprint(syncmers.code_points(t)) for t in (text, edited, other)]
            assert [row.fingerprint, row.edited_fingerprint] == [syncmers.text_of(m) for m in marks[:2]]
            assert (row.near_edited, row.near_next) == (syncmers.likeness(*marks[:2]), syncmers.likeness(marks[0], marks[2]))
            assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert syncmers.document_fingerprints(make(spark, texts).limit(0)).count() == 0
    alone = syncmers.document_fingerprints(make(spark, ["abc def"])).first()
    assert alone.near_next == 1 and alone.n_chars == 7
    odd = spark.createDataFrame([(None, "abcd"), (4, "xy"), (4, "xy"), (9, None)], "doc_id long, text string")
    assert sorted(r.n_chars for r in syncmers.document_fingerprints(odd).collect()) == [0, 2, 2, 4]


def test_long_texts_are_compared_by_all_anchors(spark):
    draw = random.Random(31)
    first, second = ("".join(draw.choices("abcdefghij ", k=100_000)) for _ in range(2))
    second = second[:50_000] + first[20_000:20_400] + second[50_000:]
    near = {r.doc_id: r.near_next for r in syncmers.document_fingerprints(make(spark, [first, second])).collect()}
    marks = [set(syncmers.anchors(syncmers.code_points(t))[1].tolist()) for t in (first, second)]
    want = len(marks[0] & marks[1]) / len(marks[0] | marks[1])
    assert want > 0 and near == pytest.approx({0: want, 1: want}, rel=1e-3)  # 32-bit hashes may meet by chance
    rows = syncmers.document_anchors(make(spark, [first, second, "", None])).collect()
    places = [{r.hash: r.position for r in rows if r.doc_id == k} for k in (0, 1)]
    assert [r.position for r in rows if r.doc_id == 0] == syncmers.anchors(syncmers.code_points(first))[0].tolist()
    moved = [places[1][h] - places[0][h] for h in places[0].keys() & places[1].keys()]
    assert len(moved) > 20 and set(moved) == {30_000} and {r.doc_id for r in rows} == {0, 1}


def test_closed_syncmers_by_definition():
    points = np.random.default_rng(1).integers(97, 107, 400).astype(np.uint32)
    inner = syncmers.window_hash(points, syncmers.S)
    span = syncmers.K - syncmers.S + 1
    want = [k for k in range(len(points) - syncmers.K + 1) if min(inner[k:k + span]) in (inner[k], inner[k + span - 1])]
    at, hashes = syncmers.anchors(points)
    assert at.tolist() == want
    moved = syncmers.anchors(np.concatenate((points[:9], points)))
    assert moved[1].tolist()[-len(at):] == hashes.tolist()


AWKWARD = ["a", "B", "word", "Étude", " ", "  ", "\n", "\t", "'s", "n't", "1", "23", "<|endoftext|>", "<|startoftext|>", "!", "...", "…", "　", "\x1c", "\x85", "日本", "🙂", "é", "İ", "ΣΑΣ", "\r\n", "​", "ß"]


@pytest.mark.parametrize("seed", range(3))
def test_token_memory_equals_the_library(seed):
    draw = random.Random(seed)
    cases = ["".join(draw.choices(AWKWARD, k=draw.randint(0, 12))) for _ in range(2000)]
    counts, ids = tokens.ByteLevelCounts(public_tokenizers.path("byte_bpe_50k.json")), tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in cases:
        assert counts.count(text) == len(counts.tokenizer.encode(text, add_special_tokens=False).ids), text
        assert ids.ids(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_latin_words_merge_as_in_the_library():
    draw = random.Random(9)
    words = ["".join(draw.choices("etaoinshrdlucmfwypvbgkqjxzéèüößñETA", k=draw.randint(1, 16))) for _ in range(20_000)]
    ids = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    want = ids.tokenizer.encode_batch(words, add_special_tokens=False)
    assert all(ids[w.encode()] == np.array(e.ids, "<u4").tobytes() for w, e in zip(words, want))
    counts = tokens.ByteLevelCounts(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(counts[w] == len(e.ids) for w, e in zip(words, counts.tokenizer.encode_batch([" " + w for w in words])))


def test_token_counts_and_cache(spark, texts, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    want = sorted((k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts))
    for n in range(2):
        found = token_counts.count_tokens(make(spark, texts), path, cache)
        assert sorted(map(tuple, found.collect())) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("version", "digest").distinct().count() == len({t or "" for t in texts})
    more = token_counts.count_tokens(make(spark, ["brand new", "one"], 500), path, cache)
    assert more.count() == 2 and spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    # a stored count is believed
    spark.createDataFrame([(tokens.version(path), hashlib.sha256(b"known").hexdigest(), 77)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(make(spark, ["known"]), path, cache).first().n_tokens == 77
    assert token_counts.count_tokens(make(spark, texts).limit(0), path).count() == 0


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for shard in (7, 1 << 15):
        rows = packing.pack_documents(make(spark, texts), path, capacity=512, shard_pieces=shard).collect()
        pieces = {}
        for k, text in enumerate(texts):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
            for n, at in enumerate(range(0, len(ids), 512)):
                part = ids[at:at + 512]
                pieces[k, n] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
        sequences = {}
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == sequences.get(r.sequence_id, 0)
            sequences[r.sequence_id] = r.offset + r.length
        assert max(sequences.values()) <= 512
    assert len(sequences) <= math.ceil(sum(p[1] for p in pieces.values()) / 512) + 2
    assert packing.pack_documents(make(spark, texts).limit(0), path).count() == 0
    twice = make(spark, ["same text", "same text"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert packing.pack_documents(twice, path).count() == 2


def test_sum_of_squares_by_definition():
    draw = np.random.default_rng(4)
    lengths, capacity = draw.integers(1, 13, 300), 12
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps = {}
    for size, b, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        def total(place):
            after = {**gaps, place: gaps.get(place, capacity) - size}
            open_gaps = [g for g in after.values() if g]
            return sum(open_gaps.count(g) ** 2 for g in set(open_gaps))

        fits = [p for p, g in gaps.items() if g >= size] + [len(gaps)]
        assert b in fits and offset == capacity - gaps.get(b, capacity)
        assert total(b) == min(map(total, fits))
        gaps[b] = gaps.get(b, capacity) - size


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(texts, errors, similarity):
    """Kept text of each document, by the definition of the operator over all pairs of lines."""
    import regex

    def norm(line):
        return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip()

    def signed(h):
        return h & (2**64 - 1)

    def simhash(words):
        hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    lines = [(k, n, norm(line)) for k, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    first = {}
    for k, n, x in lines:
        if x:
            first.setdefault(x, (k, n))
    prints = {x: simhash(x.split(" ")) for x in first}

    def linked(x, y):
        if min(x.count(" "), y.count(" ")) < 4 or (prints[x] ^ prints[y]).bit_count() > errors:
            return False
        return levenshtein(x, y) <= math.floor(max(len(x), len(y)) * (1 - similarity) + 1e-9)

    groups = brute_groups(sorted(first, key=first.get), linked) if first else {}
    keeper = {}
    for x, root in groups.items():
        keeper[root] = min(keeper.get(root, first[x]), first[x])
    gone = {(k, n) for k, n, x in lines if x and (k, n) != keeper[groups[x]]}
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in enumerate(texts)]


def test_toxicity_sample_is_held_once(monkeypatch):
    """Rows arrive one by one in any order; beside their bytes the fit needs little memory."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 0)
    monkeypatch.setattr(toxicity, "BATCH", 4)
    size = 20_000

    def rows(order):
        for k in order:
            ids = np.arange(size, dtype=np.int32) * 3 + k
            yield k % 2, k, ids.tobytes(), np.full(size, (1 + k) / size, np.float32).tobytes()

    tracemalloc.start()
    model = toxicity.fit(rows(range(300)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 300 * size * 8, peak
    other = toxicity.fit(rows(random.Random(3).sample(range(300), 300)))
    assert other.bias == model.bias and (other.effect == model.effect).all()


def test_line_dedup(spark):
    draw = random.Random(8)
    pool = [" ".join(draw.choices(WORDS, k=draw.randint(1, 40))) for _ in range(25)]
    pool += [p.replace("tau", "taut", 1) for p in pool] + [p + " psi" for p in pool[:8]] + ["", "  ", "---", "Same, LINE!", "same line"]
    texts = ["\n".join(draw.choices(pool, k=draw.randint(1, 7))) for _ in range(60)] + [None, "", "\n", "\n\n", pool[0]]
    for errors in (2, 6):
        found = line_dedup.drop_repeated_lines(make(spark, texts), errors=errors)
        assert {r.doc_id: r.text for r in found.collect()} == dict(enumerate(brute_lines(texts, errors, 0.8)))
    assert found.columns == [*make(spark, texts).columns, "n_lines", "n_removed"]
    assert line_dedup.drop_repeated_lines(make(spark, texts).limit(0)).count() == 0
    docs = make(spark, ["a b\nc d", "a b\nc d"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.text for r in line_dedup.drop_repeated_lines(docs).collect()] == ["a b\nc d"] * 2


def test_line_dedup_links_by_edit_similarity_alone(spark):
    draw = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word():
        return "".join(draw.choices(letters, k=draw.randint(3, 9)))

    base = [" ".join(word() for _ in range(n)) for n in (3, 4, 8, 27, 50) for _ in range(40)]

    def typos(line):
        words = line.split(" ")
        for k in draw.sample(range(len(words)), max(1, len(words) // 10)):
            at = draw.randrange(len(words[k]))
            words[k] = words[k][:at] + draw.choice(letters) + words[k][at + 1:]
        return " ".join(words)

    found = line_dedup.drop_repeated_lines(make(spark, base + [typos(x) for x in base])).collect()
    kept = {r.doc_id: r.text for r in found}
    assert [kept[k] for k in range(200)] == base  # unrelated lines stay
    gone = [kept[200 + k] == "" for k in range(200)]
    assert all(sum(gone[k:k + 40]) >= 36 for k in range(0, 200, 40)), [sum(gone[k:k + 40]) for k in range(0, 200, 40)]


def test_line_bands_by_characters_and_only_near_lengths_compared(spark):
    draw = random.Random(4)
    alphabets = ["abc ", "aé ", "日本語", "\U0001d4d0\U0001d4d1a "]
    said = ["".join(draw.choices(a, k=n)).strip() or "x" for a in alphabets for n in (1, 2, 3, 4, 5, 6, 31, 32, 33, 40, 41, 42, 43, 90)]
    docs = make(spark, said)
    found = line_dedup.places(docs.select("doc_id", "text")).cache()
    got = {(r.k1, frozenset(r.bands)) for r in line_dedup.line_bands(found, 0.8, 4).collect()}
    masks = Random(6)
    masks = [masks.randrange(-(1 << 31), 1 << 31) for _ in range(64)]
    grams = lambda n: F.expr(f"transform(sequence(1, greatest(1, length(norm) - {n - 1})), i -> substring(norm, i, {n}))")
    short = found.where("length(norm) <= 41").select("k1", F.lit(3).alias("n"), F.explode(grams(3)).alias("gram"))
    long = found.where("length(norm) > 32").select("k1", F.lit(5).alias("n"), F.explode(grams(5)).alias("gram"))
    least = short.union(long).groupBy("k1", "n").agg(*(F.min(F.hash("gram").bitwiseXOR(F.lit(m))).alias(f"m{j}") for j, m in enumerate(masks)))
    bands = [F.xxhash64("n", F.lit(t), *(f"m{j}" for j in range(4 * t, 4 * t + 4))) for t in range(16)]
    assert got == {(r.k1, frozenset(r.bands)) for r in least.select("k1", F.array(*bands).alias("bands")).collect()}

    by_line = {r.norm: r.k1 for r in found.collect()}
    lines = found.select("k1", "size").distinct()
    order = sorted(by_line, key=len)
    pairs = spark.createDataFrame([(by_line[order[0]], by_line[order[-1]])], "a long, b long")
    asked = []

    def norms(needed):
        asked.append(needed.count())
        return found.select("k1", "norm").join(needed, "k1", "left_semi").distinct()

    assert line_dedup.verified_links(lines, pairs, norms, 0.8).count() == 0 and asked == [0]


def test_line_windows_and_where_they_start(spark):
    draw = random.Random(5)
    said = [" ".join("".join(draw.choices("abcé\U0001d4d0", k=draw.randint(1, 9))) for _ in range(n)) for n in (1, 2, 5, 20, 60)] + ["ab " * 30 + "ab"]
    frame = spark.createDataFrame([(x,) for x in said], "norm string")
    rows = frame.select("norm", line_dedup.line_windows(F.col("norm")).alias("w")).collect()
    for r in rows:
        ring = r.norm + " " + r.norm[:line_dedup.WINDOW - 1]
        starts = [k for k in range(len(r.norm)) if (k == 0 or r.norm[k - 1] == " ") and k + line_dedup.WINDOW <= len(ring)]
        found = [ring[k:k + line_dedup.WINDOW] for k in starts]
        hashes = spark.createDataFrame([(k, w) for k, w in zip(starts, found)], "k long, w string").select("k", F.xxhash64("w").alias("h")).collect()
        once = len(set(found)) == len(found)
        least = sorted({h.h: h.k for h in hashes}.items())[:line_dedup.WINDOWS]
        bits = line_dedup.PLACE_BITS
        assert r.w == [h >> bits << bits | (k if once else line_dedup.NO_PLACE) for h, k in least]


def test_lines_with_many_typos_are_found(spark):
    draw = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [" ".join("".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(n)) for n in (15, 27, 60, 120) for _ in range(40)]

    def typos(line):
        line = list(line)
        for at in draw.sample([k for k, c in enumerate(line) if c != " "], len(line) // 10):
            line[at] = draw.choice(letters)
        return "".join(line)

    # near copies of null ids as well
    rows = [(None if k % 2 else k, t, "en", 1) for k, t in enumerate(base)] + [(1000 + k, typos(t), "en", 1) for k, t in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source long")
    kept = {r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert set(base) <= kept
    gone = [r[1] not in kept for r in rows[len(base):]]
    assert all(sum(gone[k:k + 40]) >= 26 for k in range(0, 160, 40)), [sum(gone[k:k + 40]) for k in range(0, 160, 40)]


def test_unlike_lines_that_share_a_phrase(spark, monkeypatch):
    draw = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(n):
        return ["".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(n)]

    phrase = words(8)
    base = []
    for _ in range(90):
        line = words(20)
        at = draw.randrange(21)
        base.append(line[:at] + phrase + line[at:])
    copies = [[w if draw.random() > 0.05 else words(1)[0] for w in line] for line in base[:40]]
    texts = [" ".join(x) for x in base + copies]
    asked = []
    real = line_dedup.similar_pairs

    def counted(pairs, *more):
        asked.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(line_dedup, "similar_pairs", counted)
    kept = [r.text for r in line_dedup.drop_repeated_lines(make(spark, texts)).orderBy("doc_id").collect()]
    close = lambda a, b: levenshtein(texts[a], texts[b]) <= math.floor(max(len(texts[a]), len(texts[b])) * 0.2 + 1e-9)
    assert kept == [t if k < 90 or not close(k, k - 90) else "" for k, t in enumerate(texts)]
    assert kept[90:].count("") >= 36
    # far fewer than the pairs of lines with the phrase
    assert sum(asked) < 130 * 129 // 2 // 10, asked


def test_lines_of_a_crowd_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    draw = random.Random(37)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(n):
        return ["".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(n)]

    # each copy differs by many typos, so most share nothing but the phrase, as all lines do
    phrase = " ".join(words(4))
    rest = [" ".join(words(20)) for _ in range(45)]

    def typos(line):
        line = list(line)
        for at in draw.sample([k for k, c in enumerate(line) if c != " "], len(line) // 5):
            line[at] = draw.choice(letters)
        return "".join(line)

    texts = [f"{phrase} {x}" for x in rest] + [f"{phrase} {typos(x)}" for x in rest]
    frame = spark.createDataFrame(enumerate(texts), "id int, norm string").select("id", line_dedup.line_windows(F.col("norm")).alias("w"))
    windows = {r.id: {h >> line_dedup.PLACE_BITS: h % (1 << line_dedup.PLACE_BITS) for h in r.w} for r in frame.collect()}

    def close(a, b):
        most = math.floor(max(len(texts[a]), len(texts[b])) * 0.2 + 1e-9)
        apart = [abs(windows[a][h] - windows[b][h]) + abs(len(texts[a]) - windows[a][h] - len(texts[b]) + windows[b][h]) for h in windows[a].keys() & windows[b].keys()]
        return bool(apart) and min(apart) <= most and levenshtein(texts[a], texts[b]) <= most

    groups = brute_groups(range(len(texts)), close)
    assert sum(groups[k] < k for k in range(45, 90)) >= 36
    kept = [r.text for r in line_dedup.drop_repeated_lines(make(spark, texts)).orderBy("doc_id").collect()]
    assert kept == [t if groups[k] == k else "" for k, t in enumerate(texts)]


def test_stored_steps_go_when_they_are_read(spark, tmp_path):
    stored = keep(spark.range(5), "step")
    assert len(stored.inputFiles()) > 0 and os.path.exists(stored.kept_at.removeprefix("file:"))
    discard(stored, spark.range(2))
    assert not os.path.exists(stored.kept_at.removeprefix("file:"))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_edit_similarity_of_lines(spark, similarity):
    draw = random.Random(6)
    rows = []
    for _ in range(300):
        words = draw.choices(["a", "ab", "abc", "é", "tau"], k=draw.randint(1, 8))
        other = list(words)
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(other) + 1)
            other[k:k + draw.randint(0, 1)] = draw.choices(["x", "ab", "zzz"], k=draw.randint(0, 2))
        rows.append((" ".join(words), " ".join(other or ["a"])))
    found = spark.createDataFrame(rows, "x string, y string").select(line_dedup.edit_similar("x", "y", similarity).alias("good"))
    assert [r.good for r in found.collect()] == [levenshtein(x, y) <= math.floor(max(len(x), len(y)) * (1 - similarity) + 1e-9) for x, y in rows]


@pytest.mark.parametrize("rows", [1, 1000, 10**6, 10**9, 10**13])
def test_pigeonhole_blocks_lose_no_pair(rows):
    masks = line_dedup.block_masks(rows, 2)
    for a, b in combinations(range(64), 2):
        differing = 1 << a | 1 << b
        assert any(m & differing == 0 for m in masks)


def test_mixture(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choices(WORDS, k=draw.randint(1, 30))) + draw.choice(["", " a@b.c", " copyright", " | x"]), draw.choice(["en", "fr", None]), draw.choice("abc")) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("own"))
    described = mixing.mixture(docs).select("row.*", F.col("row.tokens").alias("own"), "probability", "kept", "topic")
    assert described.count() == 600 and {r.own for r in described.collect()} == {"own"}
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 300), ("b", "x", "t", 50), ("b", "y", "u", 550)], "source string, lang string, topic string, tokens long")
    shares = lambda **s: spark.createDataFrame(list(s.items()), "value string, share double")
    raked = mixing.rake(cells, {"source": shares(a=0.5, b=0.5), "lang": shares(x=0.3, y=0.7)}, 40).collect()
    for dim, target in (("source", {"a": 500, "b": 500}), ("lang", {"x": 300, "y": 700})):
        for value, want in target.items():
            assert sum(r.weight for r in raked if r[dim] == value) == pytest.approx(want, rel=1e-6)
    wanted = {"source": shares(a=0.55, b=0.45), "lang": shares(x=0.2, y=0.8)}
    raked = mixing.rake(cells, wanted, 20, 0.7).collect()
    monkeypatch.setattr(mixing, "CELLS_IN_MEMORY", 0)
    spread = mixing.rake(cells, wanted, 2, 0.7).collect()
    monkeypatch.undo()
    same = {r[:3]: r.weight for r in mixing.rake(cells, wanted, 2, 0.7).select("source", "lang", "topic", "weight").collect()}
    assert {(r.source, r.lang, r.topic): pytest.approx(r.weight) for r in spread} == same
    for dim, target in (("source", {"a": 385, "b": 315}), ("lang", {"x": 140, "y": 560})):
        for value, want in target.items():
            assert sum(r.weight for r in raked if r[dim] == value) == pytest.approx(want, rel=1e-6)
    assert all(0 < r.weight <= r.tokens for r in raked) and any(r.weight == r.tokens for r in raked)
    # what is left of scarce values decides how much can be kept; values without tokens are left out
    scarce = {"source": mixing.shares(cells, "source", shares(a=0.8, b=0.1, c=0.1))}
    assert mixing.attainable(scarce, 1000.0, 0.6) == pytest.approx(mixing.HEADROOM * 0.4 / (8 / 9))
    assert mixing.attainable(scarce, 1000.0, 0.3) == 0.3
    odd = spark.createDataFrame([(1, None, None, None), (None, "", "en", "a"), (2, "one two", None, "b"), (2, "one two", None, "b")], "doc_id long, text string, lang string, source string")
    found = mixing.mixture(odd).collect()
    assert len(found) == 4 and len({r.kept for r in found if r.row.doc_id == 2}) == 1
    assert mixing.mixture(odd.limit(0)).count() == 0


def test_mixture_meets_its_targets(spark):
    """Tokens to expect, by probability, against tempered shares of all three dimensions."""
    draw = random.Random(3)
    ends = ["", "", "", "", "", " a@b.c", " copyright", " | x"]
    rows = [(k, " ".join(draw.choices(WORDS, k=draw.randint(5, 30))) + draw.choice(ends), draw.choice(["en"] * 6 + ["fr", "de"]), draw.choice("aaaaabbc")) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = [r for r in mixing.mixture(docs).collect()]
    kept = sum(r.tokens * r.probability for r in found)
    assert all(0 <= r.probability <= 1 for r in found) and any(r.probability > 0.9 for r in found)
    for dim in mixing.DIMENSIONS:
        raised = {v: sum(r.tokens for r in found if r[dim] == v) ** mixing.POWERS[dim] for v in {r[dim] for r in found}}
        for value, x in raised.items():
            share = sum(r.tokens * r.probability for r in found if r[dim] == value) / kept
            assert share == pytest.approx(x / sum(raised.values()), rel=0.001)
    drawn = sum(r.tokens for r in found if r.kept)
    assert drawn == pytest.approx(kept, rel=0.08)
