"""Each query of the training-data operators against a brute-force version on whole small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash

import corpus_pipeline
from oracle import compare, duck
from trialgrid.llm import fingerprints, langid, queries, secrets, simhash, toxicity, urlfilter

REGISTERED = queries.queries()


def rows(spark, sf_dir, name):
    return [r.asDict(recursive=True) for r in REGISTERED[name](spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def docs(sf_dir):
    found = duck(sf_dir).sql("select doc_id, text, lang, source from documents").fetchall()
    return [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in found]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, REGISTERED[name], queries.oracle_sql()[name]) == []


def marks(text, gram=5, window=8):
    """Winnowing by the book, on tuples of words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + gram]) for i in range(max(len(words) - gram + 1, min(len(words), 1)))]
    return grams, window


def test_op1(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op1_document_fingerprints")}
    assert len(got) == len(docs)
    order = sorted(docs, key=lambda d: -d["doc_id"])
    # The hash of a gram is read back from the query itself, and must be one per gram everywhere.
    hashes = {}
    for i, d in enumerate(order):
        after = order[(i + 1) % len(order)]["text"] or ""
        text = d["text"] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        for body, printed in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            grams, window = marks(body)
            found = [(h, int(p)) for h, p in (m.split(":") for m in printed.split())]
            assert [p for _, p in found] == sorted({p for _, p in found})
            for h, p in found:
                assert hashes.setdefault(grams[p], h) == h
            # every window holds a mark: the guarantee for shared runs
            places = [p for _, p in found]
            for start in range(max(len(grams) - window + 1, min(len(grams), 1))):
                assert any(start <= p < start + window for p in places)
        own, other = ({m.split(":")[0] for m in r[c].split()} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)
        following = {m.split(":")[0] for m in got[order[(i + 1) % len(order)]["doc_id"]]["fingerprint"].split()}
        assert r["near_next"] == pytest.approx(len(own & following) / len(own | following) if own | following else 1.0)


def test_op1_takes_the_rightmost_of_equal_grams(spark):
    text = " ".join(["a b c"] * 12)
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(fingerprints.winnow(df.text, 3, 4).alias("m")).selectExpr("transform(m, x -> shiftrightunsigned(x, 31)) h", "m").first()
    grams = [tuple(text.split()[i : i + 3]) for i in range(34)]
    value = {g: h for g, h in zip(grams, [0, 0, 0])}
    positions = [(1 << 31) - 1 - (m & ((1 << 31) - 1)) for m in found["m"]]
    for p, h in zip(positions, found["h"]):
        value[grams[p]] = h
    least = min(h for h in value.values() if h)
    best = [i for i, g in enumerate(grams) if value[g] == least]
    assert set(positions) == {max(b for b in best if s <= b < s + 4) for s in range(31)}


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_op3(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op3_secret_scan")}
    for d in docs:
        base = base_spans(d["text"] or "")
        r, n = got[d["doc_id"]], Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        texts = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(texts))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("entropy")] == texts


def test_op4(spark, sf_dir):
    judged = {r["doc_id"]: r for r in rows(spark, sf_dir, "op4_toxicity")}
    labels = dict(duck(sf_dir).sql("select doc_id, toxic from labels").fetchall())
    assert all(0 <= r["severity"] <= toxicity.GRADES and 0 <= r["p_toxic"] <= 1 for r in judged.values())
    right = sum(judged[i]["toxic"] == bool(t) for i, t in labels.items() if i in judged)
    assert right >= 0.9 * len(labels)


def test_op6(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op6_source_mixing")
    again = rows(spark, sf_dir, "op6_source_mixing")
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    total = defaultdict(int)
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    excess = float(sum(total.values()))
    while excess > 1e-6 and open_:
        share = excess / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        excess = sum(max(0.0, target[s] - 3 * total[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * total[s]:
                target[s] = 3.0 * total[s]
                open_.remove(s)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] for s in names)


def test_op7(spark, sf_dir):
    turns = defaultdict(list)
    for c, t, role, text in duck(sf_dir).sql("select conv_id, turn, role, text from conversations").fetchall():
        turns[c].append((t, role, text or ""))
    turns[-7] = [(i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in rows(spark, sf_dir, "op7_chat_format")}
    assert set(got) == set(turns)
    for c, said in turns.items():
        said.sort(key=lambda t: t[0])
        loss = "".join(text for _, role, text in said if role == "assistant")
        want = (len(said), sha("".join(f"{role}\n{text}\n" for _, role, text in said)), len(loss), sha(loss))
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def removed_spans(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append(([m.span() for m in re.finditer(b"\1+", bytes(cover))], bytes(c for c, gone in zip(t, cover) if not gone)))
    return out


def test_op8(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op8_substring_dedup")}
    texts = [(d["text"] or "").encode() for d in docs]
    for d, t, (spans, kept) in zip(docs, texts, removed_spans(texts, 400)):
        want = (len(t), len(t) - len(kept), len(spans), sha(kept))
        assert tuple(got[d["doc_id"]][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_op9(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op9_language_id")}
    import zlib

    out = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 for d in docs}
    assert {i: r["held_out"] for i, r in got.items()} == out
    held = [d for d in docs if out[d["doc_id"]] and d["lang"]]
    right = sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held)
    assert right >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())


def simhash_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=3):
    """id -> least id, by comparing all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_op10(spark, sf_dir, docs):
    prints = {d["doc_id"]: simhash_by_hand(d["text"] or "") for d in docs}
    groups = linked(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, sf_dir, "op10_simhash_near_duplicates")}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_pipeline(spark, sf_dir, docs):
    """run() against the stages by hand, up to the trained language filters."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, whole, sf_dir).collect()}
    by_id = {d["doc_id"]: d for d in docs}
    assert kept == {i for i, d in by_id.items() if d["text"] and re.search(r"[^\W\d_]", d["text"])}
    groups = linked({i: simhash_by_hand(by_id[i]["text"]) for i in kept})
    kept = {i for i in kept if groups[i] == i}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def grams(t, k=5):
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    items = [grams(t) for (t,) in duck(sf_dir).sql("select text from benchmark").fetchall()]
    kept = {i for i in kept if not any(len(g & grams(by_id[i]["text"])) >= 0.8 * len(g) for g in items)}
    mixed = [r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert {r["doc_id"] for r in mixed} <= kept
    allowed = secrets._allow(secrets.ALLOWED)
    for r in mixed:
        assert r["text"] == secrets.redact_text(by_id[r["doc_id"]]["text"], allowed) and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3 and all(1 <= r["copy"] <= copies[r["doc_id"]] for r in mixed)


def test_only_dataframe_functions_where_asked(spark, sf_dir):
    for name in REGISTERED:
        if re.match("op[12567]_", name):
            plan = REGISTERED[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name


def test_names():
    assert [f"op{n}_" in " ".join(REGISTERED) for n in range(1, 11)] == [True] * 10
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
    assert simhash.SEGMENTS == 4 and langid.UNDETERMINED == "und" and len(urlfilter.RULES) == 4
