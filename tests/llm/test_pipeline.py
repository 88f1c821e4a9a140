"""The stages of the pipeline on a small corpus, each against its own definition."""

import math
import random
from collections import Counter

import corpus_pipeline
from rowloom.llm import packing, shingle_dedup
from rowloom.llm.common import banded_links

from .test_documents import WORDS, brute_groups, levenshtein, make


def kept_lines(texts):
    """Each text without the lines that equal, or are at an edit similarity of 0.8 to, an earlier group's; texts of plain words."""
    places = [(line, k) for k, t in enumerate(texts) if t for line in t.split("\n")]
    first = {}
    for at, (line, _) in enumerate(places):
        first.setdefault(line, at)
    counts = {line: Counter(line) for line in first}

    def close(x, y):
        most = math.floor(max(len(x), len(y)) * 0.2 + 1e-9)
        # letters without a counterpart need an edit each, so most pairs need no table
        apart = max((counts[x] - counts[y]).total(), (counts[y] - counts[x]).total())
        return apart <= most and levenshtein(x, y) <= most

    groups = brute_groups(list(first), close)
    keeper = {}
    for line, at in first.items():
        keeper[groups[line]] = min(at, keeper.get(groups[line], at))
    kept = [[] for _ in texts]
    for at, (line, k) in enumerate(places):
        if at == keeper[groups[line]]:
            kept[k].append(line)
    return [t if not t else "\n".join(kept[k]) for k, t in enumerate(texts)]


def shingles(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def test_stages(spark, tmp_path):
    draw = random.Random(12)
    texts = ["\n".join(" ".join(draw.choices(WORDS, k=draw.randint(3, 25))) for _ in range(draw.randint(1, 4))) for _ in range(120)]
    texts = [t + " nasty nastier" if k % 6 == 0 else t for k, t in enumerate(texts)] + texts[1:6] + [None, ""]
    # a line with one word changed, and a text whose lines are all new but whose shingles are nearly those of another
    long = [" ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(2)]
    words = long[1].split(" ")
    texts += [long[0], long[0].replace(long[0].split(" ")[30], "changed"), long[1], "\n".join(" ".join(words[k:k + 20]) for k in (0, 20, 40))]
    rows = [(k, t, ("en", "fr")[k % 2], f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marked = [(k, 1, int(k % 6 == 0)) for k in range(120)]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results.append((name, before, docs))
        assert name == "best_fit_packing" or docs.columns == columns
    after = {name: {r.doc_id: r["text"] if "text" in d.columns else None for r in d.collect()} for name, _, d in results}
    ahead = {name: before for name, before, _ in results}
    clean = after["toxicity"]
    assert sum(k % 6 == 0 and k < 120 for k in clean) <= 1 and all(k in clean for k in range(120) if k % 6)
    order = sorted(ahead["line_dedup"])
    want = kept_lines([ahead["line_dedup"][k] for k in order])
    assert after["line_dedup"] == dict(zip(order, want)) and after["line_dedup"][128] == ""
    sets = {k: shingles(t) for k, t in ahead["simhash_near_dedup"].items()}
    groups = brute_groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(after["simhash_near_dedup"]) == set(groups.values()) and {129, 130} & set(groups.values()) == {129}
    assert set(after["source_mixing"]) <= set(ahead["source_mixing"]) and after["source_mixing"]
    packed = results[-1][2]
    assert packed.columns == [c.split()[0] for c in packing.PACKED.split(", ")]
    assert {r.doc_id for r in packed.collect()} == set(after["source_mixing"])


def test_near_copies_by_jaccard_of_shingles(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = []
    for n in [7, 40, 150, 600] * 10:
        words = draw.choices(vocabulary, k=n)
        for changed in (0, 1, n // 60, n // 45, n // 30):
            other = list(words)
            for at in draw.sample(range(n), changed):
                other[at] = draw.choice(vocabulary)
            texts.append(" ".join(other))
    texts += [None, "", " ", "one", "ONE", "one two"]

    sets = [shingles(t) for t in texts]
    want = brute_groups(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id: r.component_id for r in shingle_dedup.near_copies(make(spark, texts)).collect()} == want
    kept = corpus_pipeline.drop_near_copies(spark, make(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert shingle_dedup.near_copies(make(spark, texts).limit(0)).count() == 0


def test_near_copies_by_simhash_first(spark, monkeypatch):
    draw = random.Random(9)
    vocabulary = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [" ".join(draw.choices(vocabulary, k=1500)) for _ in range(12)]
    texts += [t + " " + draw.choice(vocabulary) for t in texts] + [None, "", "one", "ONE"]
    hashed = [shingle_dedup.shingles(t, 5) for t in texts]
    prints = [sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in s) * 2 > len(s)) for s in hashed]
    assert [shingle_dedup.fingerprint(s) % (1 << 64) for s in hashed] == prints
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= shingle_dedup.BUDGET
    want = brute_groups(range(len(texts)), close)
    assert sum(want[k] == k - 12 for k in range(12, 24)) >= 10

    rows = [(k, shingle_dedup.fingerprint(s)) for k, s in enumerate(hashed)]
    found = shingle_dedup.simhash_candidates(spark.createDataFrame(rows, "node long, fp long")).collect()
    pairs = {tuple(sorted(r)) for r in found}
    assert brute_groups(range(len(texts)), lambda a, b: (a, b) in pairs) == want
    # these links alone, without the bands of minima, and with them: nodes joined already are not compared again
    compared = []

    def bands_off(pool, verify, known):
        compared.append(known.count())
        return known

    monkeypatch.setattr(shingle_dedup, "banded_links", bands_off)
    assert {r.doc_id: r.component_id for r in shingle_dedup.near_copies(make(spark, texts)).collect()} == want
    assert compared[0] >= 10


def test_known_links_are_not_compared_again(spark):
    pool = spark.createDataFrame([(k, [k // 4, 100]) for k in range(12)], "node long, bands array<long>")
    known = spark.createDataFrame([(0, 1), (1, 2), (8, 9)], "a long, b long")
    asked = []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("floor(a / 4) = floor(b / 4)")

    links = {tuple(sorted(r)) for r in banded_links(pool, verify, known).collect()}
    groups = brute_groups(range(12), lambda a, b: (a, b) in links)
    assert groups == {k: k // 4 * 4 for k in range(12)}
    assert not {(0, 1), (0, 2), (1, 2), (8, 9)} & {tuple(sorted(p)) for p in asked}
