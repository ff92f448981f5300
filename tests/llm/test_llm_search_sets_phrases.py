"""Ranked search, odd sketches and collocations against brute force, on odd rows and on hot groups."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from trialgrid.llm import collocations, oddsketch, ranked, wordbytes

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
DOCS = "doc_id long, text string, lang string, rank string, item string"
VOCABULARY = [f"w{i}" for i in range(300)] + ["Été", "straße", "x_y", "ß"]


def made(rng, count, longest=60):
    weights = [1 / (i + 1) for i in range(len(VOCABULARY))]
    rows = []
    for i in range(count):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", ". ", ",", "\t", "\n"]) for w in rng.choices(VOCABULARY, weights, k=rng.randint(1, longest)))
        rows.append((i, text, rng.choice(["a", "b", None]), "r", "i"))
    rows += [(1000, None, "a", "r", "i"), (1001, "", None, "r", "i"), (None, "w1 w2 w1", "a", "r", "i"), (5, rows[5][1], "a", "r", "i")]
    return rows + [(2000 + i, rows[7][1], "a", "r", "i") for i in range(count // 3)]  # a third are copies


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def best_by_hand(rows, items, top):
    counted = [(row[0], Counter(terms(row[1]))) for row in rows]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for ident, c in counted:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) & set(c)
            )
            if score > 0:
                scored.append((-score, ident is None, ident or 0, ident))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return out


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rows = made(random.Random(3), 400)
    items = [(i, " ".join(random.Random(i).choices(VOCABULARY, k=n))) for i, n in enumerate((1, 3, 8, 30))]
    items += [(9, None), (10, "..."), (None, "w1 nowhere"), (0, "w3 w3 W4")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for bucket, room in ((2048, 16 << 20), (7, 40)):  # also with many buckets and several passes
        monkeypatch.setattr(ranked, "BUCKET", bucket)
        monkeypatch.setattr(ranked, "ITEM_BYTES", room)
        got = Counter(map(tuple, ranked.rank_documents(docs, asked, top=20).collect()))
        assert got == Counter(best_by_hand(rows, items, 20))


def test_buckets_are_pruned_without_loss():
    rng = np.random.default_rng(1)
    vectors = [np.sort(rng.choice(200, rng.integers(1, 30), replace=False)) for _ in range(3000)]
    impacts = [rng.integers(1, 1000, len(v)) for v in vectors]
    norm2 = np.asarray([(i**2).sum() for i in impacts])
    order = np.argsort(-norm2)
    item = ranked.Item.of({int(t): int(w) for t, w in zip(rng.choice(200, 12, replace=False), rng.integers(1, 50, 12))})
    search = ranked.Search([item], 200, np.zeros(1, dtype=np.int64), 10)
    for part in np.array_split(order, 60):
        offsets = np.concatenate([[0], np.cumsum([len(vectors[i]) for i in part])])
        search.add_bucket(part, norm2[part], offsets, np.concatenate([vectors[i] for i in part]), np.concatenate([impacts[i] for i in part]))
    weight = dict(zip(item.terms.tolist(), item.weights.tolist()))
    scores = sorted(((sum(weight.get(t, 0) * x for t, x in zip(v.tolist(), i.tolist())), -n) for n, (v, i) in enumerate(zip(vectors, impacts))), reverse=True)
    assert list(zip(search.scores[0].tolist(), (-search.idents[0]).tolist())) == scores[:10]
    assert search.rescored < 1500  # most of the 3,000 vectors are never scored


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def components_by_hand(rows):
    sets = [shingles(row[1]) for row in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, row in enumerate(rows):
        known = [x for x in (least[find(i)], row[0]) if x is not None]
        least[find(i)] = min(known) if known else None
    return Counter((row[0], len(s), least[find(i)], row[0] is not None and row[0] == least[find(i)]) for i, (row, s) in enumerate(zip(rows, sets)))


def near_rows():
    rng = random.Random(8)
    rows = made(rng, 60)
    base = [f"b{i}" for i in range(150)]
    for i in range(60):  # near copies of one text, some of them beyond the threshold
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((3000 + i, " ".join(words), None, "r", "i"))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(4000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.randint(1, 40))), None, "r", "i") for i in range(60)]
    return rows + [(None, "w1 w2 w1", "a", "r", "i"), (6000, "only three words", None, "r", "i"), (6001, "ONLY three\twords", None, "r", "i")]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = components_by_hand(rows)
    for small, members in ((256, 4096), (3, 4096), (256, 7)):  # also when buckets are cut by further bands or into several blocks
        monkeypatch.setattr(oddsketch, "SMALL", small)
        monkeypatch.setattr(oddsketch, "BLOCK_MEMBERS", members)
        assert Counter(map(tuple, oddsketch.similar_components(docs).collect())) == want


def test_buckets_of_one_block_are_not_cut_by_further_bands(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(oddsketch, "SMALL", 3)
    compare, most = oddsketch._Linker.compare, []

    def counted(linker, members, buckets):
        most.append(members.groupBy("node").count().agg({"count": "max"}).first()[0] or 0)
        compare(linker, members, buckets)

    monkeypatch.setattr(oddsketch._Linker, "compare", counted)
    assert Counter(map(tuple, oddsketch.similar_components(docs).collect())) == components_by_hand(rows)
    assert max(most) <= oddsketch.BANDS  # a row per band, no row per pair of bands
    monkeypatch.setattr(oddsketch, "BLOCK_MEMBERS", 7)  # larger ones still are
    assert Counter(map(tuple, oddsketch.similar_components(docs).collect())) == components_by_hand(rows)
    assert max(most) > oddsketch.BANDS


def test_sketches_of_links_stay_below_the_limit():
    rng = np.random.default_rng(4)
    most, errors = oddsketch.most_flipped(0.85), []
    for _ in range(400):
        both, apart = int(rng.integers(200, 2000)), 0
        apart = int(both * 0.15 / 0.85 / 2)
        values = rng.integers(0, 1 << 63, both + 2 * apart).astype(np.uint64)
        a, b = values[: both + apart], np.concatenate([values[:both], values[both + apart :]])
        x, y = (oddsketch.fold(oddsketch.min_hashes(s)) for s in (a, b))
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= most
        errors.append(oddsketch.estimated_similarity(bits) - both / (both + 2 * apart))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def phrases_by_hand(rows, threshold, contained, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        dropped = {q for p, b in candidates.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * b >= contained * counts[q]}
        scored = []
        for p, a in candidates.items():
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            if p not in dropped:
                scored.append((-min(cuts)[0], -a, " ".join(p).encode(), min(cuts)))
        out += [(lang, i, p.decode(), -a, c[2], c[3], n[lang], c[0]) for i, (_, a, p, c) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = made(random.Random(11), 500)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(collocations, "CHUNK", 100)  # phrases across chunks
    for threshold, top in ((10, 2000), (4, 7)):
        got = Counter(map(tuple, collocations.collocations(docs, threshold=threshold, top=top).collect()))
        assert got == phrases_by_hand(rows, threshold, 50, top)


def test_pairs_that_stay_rare_are_not_spelled_out(spark, monkeypatch):
    docs = spark.createDataFrame(made(random.Random(13), 300), DOCS).repartition(3)
    frequent, counted = collocations._frequent, set()

    def noted(counts, *rest):
        counted.update(map(tuple, counts.filter("length = 2").select("lang", "phrase").distinct().collect()))
        return frequent(counts, *rest)

    monkeypatch.setattr(collocations, "_frequent", noted)
    found, _ = collocations.count_phrases(docs)
    kept = set(map(tuple, found.filter("length = 2").select("lang", "phrase").collect()))
    assert kept and kept <= counted and len(counted - kept) < len(kept)


def counted_by_tables(texts, reached, likely, step, buckets):
    """(packs, counts by phrase, length and start) of a step over texts of one language."""
    packs, counts = 0, Counter()
    for words, numbers, context in collocations._chunks(iter(texts)):
        for batch in collocations._tables(words, numbers, context, "en", step, reached, likely, buckets):
            for row in batch.to_pylist():
                packs += 1
                lines, n = collocations._unfold(row["phrases"], row["size"], pa.py_buffer(row["packed"]))
                assert all(line.endswith(b"\n") for line in lines.to_pylist())
                counts.update({(line[:-1].decode(), row["length"], row["start"]): k for line, k in zip(lines.to_pylist(), n.tolist())})
    return packs, counts


def test_counts_move_in_packs_and_rare_pairs_do_not():
    texts = ["α b c. " * 300 + " ".join(f"w{i % 50} v{i}" for i in range(2000))]
    every = collocations._Reached(np.full(1 << 12, 0xFFFF, dtype=np.uint16))
    key = collocations._pair_keys(collocations._joined(*(np.asarray([collocations.word_hash("en", w)], dtype=np.uint64) for w in ("α".encode(), b"b"))))
    slots = np.zeros(1 << 12, dtype=np.uint8)
    slots[collocations._slots(collocations._mixed(key), 12)] = 1
    bodies = [text.encode() for text in texts]
    packs, counts = counted_by_tables(bodies, every, every, 1, 3)
    assert packs <= 3 * 3  # a row per bucket and length, not one per phrase
    assert counts["α b", 2, 1] == counts["b c", 2, 1] == counts["b", 1, 0] == 300 and counts["w7 v7", 2, 1] == 1
    _, counts = counted_by_tables(bodies, every, collocations._Reached(slots), 1, 3)
    assert counts["α b", 2, 1] == 300 and sum(k[1] == 2 for k in counts) < 10


def test_sums_are_carried_in_packs(monkeypatch):
    monkeypatch.setattr(collocations, "MOST_PACKED", 2)
    monkeypatch.setattr(collocations, "HELD", 3)  # sums are settled several times
    size = collocations.SHARDS

    def pack(start, summed, counts):
        lines = pa.array([f"{word}\n".encode() for word in counts], pa.binary())
        half = collocations._fold(lines.slice(1), np.asarray([*counts.values()][1:]))
        first = collocations._fold(lines.slice(0, 1), np.asarray([*counts.values()][:1]))
        return [(0, "en", 1 if start == 0 else 2, start, summed, *each) for each in (first, half)]

    rows = pack(0, True, {"a": 9, "b": 70000, "é": 1}) + pack(0, False, {"a": 1, "b": 2, "c": 3}) + pack(size - 1, False, {"a b": 5, "b a": 12, "b b": 1})
    batch = collocations._packs(rows, collocations.PACKED)
    out = [row for each in collocations._sum(size - 1, 10)(iter([batch])) for row in each.to_pylist()]
    assert [r["f"] for r in out if r["length"] == 0] == [70016]  # all words, rare ones too
    found = {r["phrase"]: (r["f"], r["before"]) for r in out if r["phrase"] is not None}
    assert found == {"a": (10, 9), "b": (70002, 70000), "b a": (12, 0)}
    carried = [r for r in out if r["packed"] is not None]
    assert {r["start"] for r in carried} == {size - 1} and [r["phrases"] for r in carried] == [2, 1]
    sums = {}
    for r in carried:
        lines, n = collocations._unfold(r["phrases"], r["size"], pa.py_buffer(r["packed"]))
        sums |= dict(zip(lines.to_pylist(), n.tolist()))
    assert sums == {b"a b\n": 5, b"b a\n": 12, b"b b\n": 1}


def test_filters_that_let_all_through_change_nothing(spark, monkeypatch):
    rows = made(random.Random(12), 200)
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(collocations, "MOST_SLOTS", 2)  # every phrase may have started in every step
    assert Counter(map(tuple, collocations.collocations(docs, threshold=6).collect())) == phrases_by_hand(rows, 6, 50, 2000)


def test_long_texts_are_taken_in_pieces():
    text = b"ab  cd\tef " * 50 + b"x" * 30
    assert [w for part in wordbytes.word_pieces(text, 16) for w in part] == text.split()
    assert all(len(b" ".join(part)) <= 64 for part in wordbytes.word_pieces(text, 16))
