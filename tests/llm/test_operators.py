"""The corpus operators on edge cases, against brute force, and on held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, components, decontamination, hilbert_sharding, license_scan, minhash_dedup, pfair_mixing, pii, quality_classifier, quality_rules, toxicity, warc
from lodestone.llm.hashing import shingles, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_shingles int, rep string, kept string"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def frame(spark, rows):
    """Rows (id, text[, lang, source]) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s")), 1, "x", "y") for r in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (None, "one"), (6, prose(30000, 9)), (7, "a b"), (7, "a b"), (8, "é" * 50)]


# hashing


def test_word_hashes_in_blocks(monkeypatch):
    texts = [b"The quick\tbrown", None, b"", b"  the  quick brown ", b"x " * 50, b"y" * 40 + b" z"]
    whole = [h.tolist() for h in word_hashes(texts)]
    monkeypatch.setattr("lodestone.llm.hashing.BLOCK_BYTES", 8)
    assert [h.tolist() for h in word_hashes(texts)] == whole
    assert whole[0] == whole[3] and len(set(whole[0])) == 3 and whole[1] == [] and len(shingles(next(word_hashes([b"a"])), 5)) == 1


# 1


def jaccard_classes(rows, k):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] == rows[j][0] or (both and 100 * both >= 80 * len(sets[i] | sets[j]))
            if same and rows[i][0] is not None and rows[j][0] is not None:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 10**9), r[0] if r[0] is not None else 10**9)
    return [(r[0], len(s), least[root(i)] if r[0] is not None else None) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_match_brute_force(spark):
    rows = list(EDGES)
    base = prose(60, 1).split()
    for i in range(40):  # a chain: each text changes another word of the one before
        base = base.copy()
        base[(i * 7) % 60] = f"w{i}"
        rows.append((100 + i, " ".join(base)))
    rows += [(200 + i, prose(40, 3)) for i in range(5)] + [(300 + i, prose(40, 300 + i)) for i in range(10)]
    for k in (2, 5):
        found = sorted(map(tuple, minhash_dedup.near_duplicates(frame(spark, rows), k).collect()), key=str)
        assert found == sorted(jaccard_classes(rows, k), key=str)
    kept = minhash_dedup.keep_one(frame(spark, rows), 5)
    want = {c for i, _, c in jaccard_classes(rows, 5) if i is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want) and kept.where("doc_id IS NULL").count() == 1
    assert kept.columns == frame(spark, []).columns
    assert minhash_dedup.near_duplicates(frame(spark, []), 5).count() == 0


def test_variants_of_one_text(spark, monkeypatch):
    """Some hundred variants of one text, of similarities about the threshold: every link, and far fewer pairs than all."""
    rng, rows, base = np.random.default_rng(8), [], prose(90, 21).split()
    for i in range(300):
        words = list(base)
        for at in rng.choice(90, int(rng.integers(1, 14)), replace=False):
            words[at] = f"v{i}x{at}" if rng.random() < 0.8 else WORDS[int(rng.integers(6))]
        if i % 5 == 0:  # sizes differ too
            words = words[: int(rng.integers(60, 90))]
        rows.append((i, " ".join(words)))
    pairs = []
    agreeing = minhash_dedup._agreeing
    monkeypatch.setattr(minhash_dedup, "_agreeing", lambda p, *a: (pairs.append(0 if a else p.count()), agreeing(p, *a))[1])
    monkeypatch.setattr(minhash_dedup, "SPREAD", 50)
    found = sorted(map(tuple, minhash_dedup.near_duplicates(frame(spark, rows), 2).collect()))
    assert found == sorted(jaccard_classes(rows, 2))
    assert sum(pairs) < 300 * 299 / 2 / 8


def test_kept_documents(spark):
    """Repeated ids, texts that differ under one id, and columns named like the operators' own."""
    a, b = prose(50, 1), prose(50, 2)
    rows = [(5, a, "z", 1), (5, a, "y", 2), (5, b, "x", 3), (9, a, "w", 4), (None, a, "v", 5), (None, None, "u", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string, _hit int")
    kept = minhash_dedup.keep_one(docs, 5)
    assert kept.columns == docs.columns and len({(r.doc_id, r.text) for r in kept.collect()}) == kept.count() == 4
    assert sorted(map(str, kept.collect())) == sorted(map(str, minhash_dedup.keep_one(docs.repartition(3), 5).collect()))
    items = spark.createDataFrame([(1, b)], "item_id long, text string")
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["9", "None", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"), common.Scratch(spark, "t"), "c").collect()
    assert {(r.u, r.v) for r in found} == {(i, 0) for i in range(1, 31)} | {(51, 50), (52, 50)}


# 2


def test_archives(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    rows = [(1, "u", inner * 3 + "tail"), (2, "u", "x" * 2000), (3, "u", "x" * 2000), (4, None, None), (5, "u", ""), (6, "u", warc.MAGIC), (7, "u", "é" * 600 + inner), (8, "u", "é" * 600 + inner), (None, "z", "q"), (9, "u\r\nX: y", "x" * 2000 + "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload_bytes string").repartition(2)
    warc.write_warc(pages, str(tmp_path / "a"))
    found = {r.page_id: r for r in warc.resolved(warc.read_warc(spark, str(tmp_path / "a"))).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: r.refers_to for i, r in found.items() if r.record_type == "revisit"} == {2: 3, 7: 8}


def record(page, body, kind="WARC-Type: response\r\n", length=None):
    return f"WARC/1.1\r\n{kind}WARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n"


def test_broken_archives(spark, tmp_path):
    """A record without a type is kept; a chain that ends early is an error, or read as far as it goes."""
    read = lambda text, **how: (lambda f: (f.write_text(text, newline=""), sorted((r.page_id, r.record_type) for r in warc.resolved(warc.read_warc(spark, str(f), **how)).collect()))[1])(tmp_path / "a.warc")
    assert read(record(1, "x", "") + record(2, "yy")) == [(1, None), (2, "response")]
    for bad in (record(1, "x") + record(2, "yy", length=5) + record(3, "z"), record(1, "x") + "WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n" + record(3, "z"), record(1, "x") + record(2, "y" * 50)[:-30]):
        with pytest.raises(warc.BrokenChain):
            read(bad)
        assert (1, "response") in read(bad, strict=False) and 3 not in [i for i, _ in read(bad, strict=False)]


def test_pages_edges(spark, tmp_path):
    """An empty table, repeated page ids, one long payload."""
    pages = spark.createDataFrame([(1, "u", "a" * 1500), (1, "u", "b" * 1500), (1, "u", "a" * 1500), (2, "u", "a" * 1500), (3, "u", "long " * 400_000)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "a"))
    found = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(warc.read_warc(spark, str(tmp_path / "a"))).collect()]
    assert sorted(found, key=str) == sorted([(1, "revisit", 2, 1500), (1, "response", None, 1500), (1, "revisit", 2, 1500), (2, "response", None, 1500), (3, "response", None, 2_000_000)], key=str)
    warc.write_warc(pages.limit(0), str(tmp_path / "b"))
    assert warc.resolved(warc.read_warc(spark, str(tmp_path / "b"))).count() == 0


# 3 and 6


@pytest.mark.parametrize("name,label,module", [("op3_toxicity", "toxic", toxicity), ("op6_quality_classifier", "quality", quality_classifier)])
def test_held_out_accuracy(spark, name, label, module):
    sf = "/root/testdata/sf0.01"
    found = getattr(module, name)(spark, sf).toPandas()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count() and found.score.between(0, 1).all()
    fold, out = (3, 1) if label == "toxic" else (4, 2)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % fold == out for i in found.doc_id]).all()
    joined = found.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (joined.predicted == joined[label])[joined.held_out].mean() > (0.9 if label == "toxic" else 0.95)


def test_inserted_letters(spark):
    model = toxicity.fit([f"some plain words {w} here" for w in ["idiot", "moron"] * 30] + [prose(20, i) for i in range(60)], [1] * 60 + [0] * 60)
    docs = frame(spark, [(1, "you i.d.i.o.t there"), (2, "you i d i o t there"), (3, "an idxiot"), (4, prose(300, 77)), *[(i, t) for i, t in EDGES if i not in (1, 2, 3, 4)]])
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(score[1], score[2], score[3]) > 0.7 > max(score[5], score[6], score[8])
    assert toxicity.fit([], [])["landmarks"] == []


def test_kernel_matches_enumerated_subsequences():
    from itertools import combinations

    def features(word):
        out = {}
        for at in combinations(range(len(word)), 3):
            key = "".join(word[i] for i in at)
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["idiot", "idxiot", "trash", "abcabcab", "aaa", "tsh", "stupid", "ôéîdiot"]
    marks = ["idiot", "abcab", "aaaa", "tash"]
    dot = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    want = [[dot(features(w), features(m)) / np.sqrt(dot(features(w), features(w)) * dot(features(m), features(m))) for m in marks] for w in words]
    assert np.allclose(toxicity.kernel(words, toxicity.codes(marks)), want, atol=1e-5)


def test_spaced_letters_are_joined():
    assert {"idiot", "idio", "thatidio", "iot"} <= toxicity.windows("that idio t, i o t") | {"thatidio"}
    assert "idiot" in toxicity.windows("i diot") and "idiot" in toxicity.windows("i.d.i.o.t") and "idiot" in toxicity.windows("id i ot")
    assert toxicity.windows(None) == toxicity.windows(" \n") == toxicity.windows("a b") == set()


def test_toxicity_edges(spark):
    """Empty tables, ties and repeated rows."""
    model = toxicity.fit([f"some words {w}" for w in ["idiot"] * 40] + [prose(20, i) for i in range(40)], [1] * 40 + [0] * 40)
    rows = [(1, "an idiot"), (1, "an idiot"), (2, "an idiot"), (3, None), (4, "")]
    scores = [(r.doc_id, r.score) for r in toxicity.score(frame(spark, rows), model).collect()]
    assert len(scores) == 5 and len({x for i, x in scores if i < 3}) == 1 and len({x for i, x in scores if i > 2}) == 1
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(4, 1), (None, 1), (7, None)], "doc_id long, quality int")
    weights = quality_classifier.train(frame(spark, EDGES), labels)
    scored = quality_classifier.score(frame(spark, EDGES), weights).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    assert quality_classifier.score(frame(spark, []), weights).count() == 0
    assert set(quality_classifier.train(frame(spark, []), labels)) == {0}


# 4


def test_personal_data(spark):
    text = "é mail a.b@c.de.fr, b@c, @x.y 10.0.0.1 999.1.1.1 1.2.3.4.5 x 4111 1111-1111 1111, 4111111111111112 +1 (988) 555-2485 +12"
    kinds = [(k, text[s:e]) for k, s, e in pii.base_spans(text)]
    assert kinds == [("email", "a.b@c.de.fr"), ("ip", "10.0.0.1"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (988) 555-2485")]


def test_disclosing_terms(spark):
    rows = [(i, f"{prose(20, i)} Zebulon wrote z@corp.example.com {prose(20, 90 + i)}") for i in range(4)] + [(10 + i, prose(60, 500 + i)) for i in range(40)]
    rows += [(i + 100, t) for i, t in EDGES if i is not None] + [(None, "zebulon alone")]
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert "term:" in found[0].spans and "Zebulon" not in found[0].sanitised and "[EMAIL]" in found[0].sanitised
    assert found[0].n_email == 1 and found[None].n_term == 1 and found[10].n_term == 0
    assert found[101].spans == "" and found[101].sanitised is None and found[101].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(frame(spark, [])).count() == 0


def test_terms_by_joins(spark, monkeypatch):
    """Terms too many to broadcast give the same rows."""
    rows = [(i, f"{prose(20, i)} Zebulon wrote z@corp.example.com {prose(20, 90 + i)}") for i in range(4)] + [(10 + i, prose(60, 500 + i)) for i in range(20)] + EDGES
    want = sorted(map(str, pii.find(frame(spark, rows)).collect()))
    monkeypatch.setattr(pii, "TERM_BLOCK", 3)
    assert sorted(map(str, pii.find(frame(spark, rows)).collect())) == want


def test_terms_of_values_in_one_or_two_texts(spark):
    """Against brute force over whole documents: values of one, two and many texts, terms far from their value."""
    far = prose(40, 7)
    rows = [(1, f"Quillon {far} q@one.example.com"), (2, f"10.1.2.3 {far} Vexley"), (3, f"Vexley {far} 10.1.2.3"), (4, f"Vexley {far}"), (5, None), (6, "no@corp.example.com alone")]
    rows += [(10 + i, prose(50, 700 + i)) for i in range(30)] + [(50 + i, f"Orrin all@corp.example.com {prose(5, 800 + i)}") for i in range(5)]
    texts = {i: (t or "").split() for i, t in rows}
    values = {"q@one.example.com", "10.1.2.3", "all@corp.example.com", "no@corp.example.com"}
    bags = [{w.lower() for w in t} for t in texts.values()]
    n, want = len(rows), set()
    for t in set().union(*bags) - values:
        n_t = sum(t in b for b in bags)
        for e in values:
            n_e, n_et = sum(e in b for b in bags), sum(e in b and t in b for b in bags)
            if n_et and np.log2(n_et * n / (n_e * n_t)) >= 0.9 * np.log2(n / n_e) - 1e-9:
                want.add(t)
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert {"quillon", "orrin", "alone"} <= want
    assert {i: r.n_term for i, r in found.items()} == {i: sum(w.lower() in want for w in t) for i, t in texts.items()}
    assert "Quillon" not in found[1].sanitised and "Orrin" not in found[50].sanitised


# 5


def test_mixture(spark):
    rows = [(i, "t", "en", ["a", "b", "c", None][0 if i % 3 else i % 4]) for i in range(900)] + [(1, "t", "en", "a")] * 2 + [(None, None, None, "b")]
    placed = pfair_mixing.mix(frame(spark, rows), 0.5, 4, 60).toPandas()
    assert len(placed) == len(rows)
    assert ((placed._release <= placed._slot) & (placed._slot < placed._deadline)).all()
    blocks = placed.fillna({"source": "-"}).drop_duplicates(["source", "_block"])
    assert blocks._slot.is_unique and (blocks.groupby("source")._block.max() + 1 == blocks.groupby("source").size()).all()
    exact = blocks[blocks._exact].sort_values("_slot")
    assert (exact._slot.values == np.arange(len(exact))).all()
    n = placed.fillna({"source": "-"}).groupby("source").size()
    share = exact.groupby("source").size() / len(exact)
    for s in n.index:
        seen = (exact.source == s).cumsum().values
        w = {s: x for s, x in zip(n.index, (np.sqrt(n) / np.sqrt(n).sum()), strict=True)}[s]
        assert np.abs(seen - w * np.arange(1, len(exact) + 1)).max() < 1 + len(exact) * 2 / 60, (s, share[s])
    assert sorted(map(str, pfair_mixing.mixed_order(frame(spark, rows)).collect())) == sorted(map(str, frame(spark, rows).collect()))
    assert pfair_mixing.mix(frame(spark, [])).count() == 0


@pytest.mark.parametrize("temperature", [1.0, 0.7])
def test_mixture_keeps_target_weights(spark, temperature):
    """Sources of unlike sizes, one ten times the others: under one block off the exact weights, over many slots."""
    sizes = {f"s{i}": 600 + i for i in range(20)} | {"hot": 6007}
    rows = [(at * 100 + i, "t", "en", s) for i, s in enumerate(sizes) for at in range(sizes[s])]
    blocks = pfair_mixing.mix(frame(spark, rows), temperature, 1).toPandas()
    assert len(blocks) == len(rows) and blocks._slot.is_unique
    assert ((blocks._release <= blocks._slot) & (blocks._slot < blocks._deadline)).all()
    exact = blocks[blocks._exact].sort_values("_slot")
    assert (exact._slot.values == np.arange(len(exact))).all() and len(exact) > 12_000
    total = sum(n**temperature for n in sizes.values())
    for s, n in sizes.items():
        assert np.abs((exact.source == s).cumsum().values - n**temperature / total * np.arange(1, len(exact) + 1)).max() < 1


def edf(weights, blocks):
    """The slots of all blocks by definition: of the released, the earliest deadline, ties to the first source; a source that wins without a block ends the exact part."""
    total, had, slot, out, end = sum(weights), [0] * len(weights), 0, {}, None
    while any(h < b for h, b in zip(had, blocks, strict=True)):
        ready = []
        for i, (w, h) in enumerate(zip(weights, had, strict=True)):
            if (h < blocks[i] or end is None) and h * total // w <= slot:
                ready.append((-(-(h + 1) * total // w), i))
        if not ready:
            slot += 1
            continue
        i = min(ready)[1]
        if had[i] < blocks[i]:
            out[i, had[i]], had[i], slot = slot, had[i] + 1, slot + 1
        else:
            end = slot
    return out, end


def test_schedule_matches_brute_force(spark):
    """Target weights that differ widely, and sources that end early."""
    sizes, targets = {"a": 90, "b": 40, "c": 25, None: 12}, {"a": 0.5, "b": 0.3, None: 0.05}
    rows = [(at * 10 + i, "t", "en", s) for i, s in enumerate(sizes) for at in range(sizes[s])]
    found = pfair_mixing.mix(frame(spark, rows), 1.0, 1, 50, targets).toPandas().rename(columns={"_block": "block", "_slot": "slot"})
    order = sorted(sizes, key=lambda s: (s is not None, s))
    w = [max(1, round({**targets, "c": 0.15}[s] * (1 << 36))) for s in order]
    want, end = edf(w, [sizes[s] for s in order])
    assert {(order.index(r.source if isinstance(r.source, str) else None), r.block): r.slot for r in found.itertuples()} == want
    assert (found._exact == (found.slot < end)).all() and end > 60
    exact = found[found._exact].sort_values("slot")
    for i, s in enumerate(order):
        seen = (exact.source.isna() if s is None else exact.source == s).cumsum().values
        assert np.abs(seen - w[i] / sum(w) * np.arange(1, len(exact) + 1)).max() < 1


def test_many_sources(spark):
    """More sources than are scheduled one by one: small ones share a lane, blocks grow, and every row has its own place."""
    rows = [(i, "t", "en", f"s{i % 50}") for i in range(200)] + [(1000 + i, "t", "en", "hot") for i in range(300)]
    found = pfair_mixing.mix(frame(spark, rows), 1.0, 1, 50, work=500, most_sources=10).toPandas()
    assert len(found) == len(rows) and found._position.is_unique and found.groupby(["source", "_block"]).size().max() <= 10
    exact = found[found._exact].sort_values("_position")
    assert np.abs((exact.source == "hot").cumsum().values - 0.6 * np.arange(1, len(exact) + 1)).max() < 2 * 10
    with pytest.raises(ValueError):
        pfair_mixing.mix(frame(spark, rows), targets={"hot": -1.0})


def test_mixture_is_the_same_at_any_size(spark):
    """Sources by the thousand are scheduled one by one, and no bound on work makes blocks larger."""
    sizes = {"hot": 300} | {f"s{i:04d}": 1 for i in range(2003)}
    rows = [(at * 10_000 + i, "t", "en", s) for i, s in enumerate(sizes) for at in range(sizes[s])]
    found = pfair_mixing.mix(frame(spark, rows), 1.0, 4).toPandas()
    order = sorted(sizes)
    want, end = edf([sizes[s] for s in order], [-(-sizes[s] // 4) for s in order])
    assert dict(zip(zip(map(order.index, found.source), found._block, strict=True), found._slot, strict=True)) == want
    assert (found._exact == (found._slot < end)).all() and len(found) == len(rows) and found._position.is_unique
    few = frame(spark, rows[:360])
    places = lambda df: sorted(map(tuple, df.select("doc_id", "_block", "_slot", "_release", "_deadline", "_position", "_exact").collect()))
    assert places(pfair_mixing.mix(few, 1.0, 4)) == places(pfair_mixing.mix(few, 1.0, 4, work=500, most_sources=10))


@pytest.mark.parametrize("weights, blocks, chunk", [([1] * 60, [1] * 60, 7), ([1 << 36, 1, 1], [30, 3, 3], 4), ([7, 90, 1, 33, 2, 2], [20, 40, 1, 33, 5, 2], 8)])
def test_schedule_in_small_runs(spark, weights, blocks, chunk):
    """All released at once, slots far apart, unlike weights: in runs of a few blocks as in one sequence."""
    of = spark.createDataFrame([(i, w, sum(weights), b) for i, (w, b) in enumerate(zip(weights, blocks, strict=True))], "_index int, _w long, _all long, _blocks long")
    plan, end = pfair_mixing.schedule(of, chunk)
    found = {(r._i, r._b): r._slot for r in plan.collect()}
    if max(weights) < 1 << 36:
        want, ends = edf(weights, blocks)
        assert found == want and end == (len(want) if ends is None else ends)
    else:  # the first source runs alone until its blocks end; then each block at its release, or after the other that is released with it
        total = sum(weights)
        assert [found[0, b] for b in range(30)] == list(range(30)) and end == 30 and [found[1, 0], found[2, 0]] == [30, 31]
        assert [found[i, b] - b * total for b in (1, 2) for i in (1, 2)] == [0, 1, 0, 1]


# 7


def test_rules_counts(spark):
    rows = [*EDGES, (20, "a b c d a b c x\n#$ a\n#$ a\n\n"), (21, "q q q q")]
    labels = spark.createDataFrame([(20, 1), (None, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    r = found[20]
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.word_chars) == (12, 4, 1, 6, 14)
    assert found[21].n_repeat_words == 4 and found[1].n_words == 0 and found[1].base_failed and not found[1].kept
    assert not found[6].base_failed and found[6].kept
    assert quality_rules.judge(frame(spark, []), labels).count() == 0


def test_rules_are_certified(spark):
    good = [(i, prose(80, i)) for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"{w}###" for w in prose(80, i).split())) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    found = quality_rules.judge(frame(spark, good + bad), labels)
    assert found.where("doc_id < 10000 AND NOT kept").count() == 0 and found.where("doc_id >= 10000 AND kept").count() == 0
    few = quality_rules.judge(frame(spark, good[:50] + bad), labels.where("doc_id < 50 OR doc_id >= 10000"))
    assert few.where("NOT kept").count() == 0  # too few good ones to certify a cutoff


# 8


def test_curve_is_hilbert(spark):
    grid = spark.range(4096).selectExpr("cast(id div 256 as int) a", "cast(id div 16 % 16 as int) b", "cast(id % 16 as int) c")
    cells = hilbert_sharding.hilbert_index(grid, ["a", "b", "c"], "h").toPandas().sort_values("h")
    assert cells.h.tolist() == list(range(4096)) and (cells[["a", "b", "c"]].diff().abs().sum(axis=1).iloc[1:] == 1).all()


def test_shards(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.ranking.rank_in_group.__defaults__", (7,))  # a hot cell is cut into buckets
    rows = [*EDGES, *((100 + i, "same", "en", "s") for i in range(300)), (None, None, None, None)]
    found = hilbert_sharding.shard(frame(spark, rows)).toPandas()
    assert len(found) == len(rows)
    counts = found.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert counts["size"].max() - counts["size"].min() <= 1 and (counts["max"] + 1 == counts["size"]).all() and (counts["nunique"] == counts["size"]).all()
    order = found.sort_values(["shard", "slot"]).hilbert.values
    assert (np.diff(order) >= 0).all() and found[found.doc_id == 5].text_crc32.item() == zlib.crc32(b"ONE")
    assert hilbert_sharding.shard(frame(spark, [])).count() == 0


def hilbert_of(point, bits=4):
    """The curve's index of a cell by walking it: the order-n curve is eight turned copies of the order n - 1 curve."""
    x = list(point)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(3):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    x[1] ^= x[0]
    x[2] ^= x[1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= (q - 1) if x[2] & q else 0
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_shards_match_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, prose(int(rng.integers(1, 400)), i), ["en", "de", None][i % 3], f"s{int(rng.integers(25)) ** 2}") for i in range(500)] + [(7, "again", "en", "s4")] * 2 + [(None, None, None, None)]

    def cells(keys):
        order, out, before = sorted(set(keys), key=lambda k: (k is not None, k)), {}, 0
        for k in order:
            out[k] = (2 * before + keys.count(k)) * 16 // (2 * len(keys))
            before += keys.count(k)
        return [out[k] for k in keys]

    def klass(n):
        b = n.bit_length() - 1
        return n if n < 8 else b * 8 + (n >> (b - 3) & 7)

    size = [len((r[1] or "").encode()) + 1 for r in rows]
    index = [hilbert_of(p) for p in zip(cells([r[3] for r in rows]), cells([r[2] for r in rows]), cells([klass(n) for n in size]), strict=True)]
    found = hilbert_sharding.shard(frame(spark, rows)).toPandas().sort_values(["shard", "slot"])
    ours = found[["doc_id", "size", "hilbert"]].fillna(-1).astype(int).values.tolist()
    assert sorted(map(tuple, ours)) == sorted((-1 if r[0] is None else r[0], n, h) for r, n, h in zip(rows, size, index, strict=True))
    assert [h for *_, h in ours] == sorted(index)
    n = len(rows)
    assert found.shard.tolist() == [at * 16 // n for at in range(n)]
    hilbert_sharding.write_shards(frame(spark, rows), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(*frame(spark, []).columns).collect())) == sorted(map(str, frame(spark, rows).collect()))
    assert back.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_shards_prune_files(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 900), f"l{i % 4}", f"host{i * 31 % 64:02d}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    placed = hilbert_sharding.shard(docs)
    shards = {c: hilbert_sharding.scanned(docs, placed, c).agg(F.avg("shards")).first()[0] for c in ("source", "lang")}
    assert shards["source"] < 10 and shards["lang"] < 12


# 9


def test_licenses(spark):
    rows = [(50, f"{prose(30, 1)}\nLicensed under the apache license version 2.0\n{prose(30, 2)}"), (51, "Released under\nthe MIT-License."), (52, prose(50, 3)), *EDGES]
    found = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert (found[50].license, found[51].license, found[52].licenses, found[1].dice) == ("Apache-2.0", "MIT", "", 0.0)
    assert found[50].start_word == 30 and found[50].end_word == 38 and found[50].dice == 1.0
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_segments_match_brute_force():
    """Scores, spans and ties of all segments, by trying every run of words and taking the best that overlaps none."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        grams = rng.integers(0, 12, 40).astype(np.uint64)
        named = [(name, rng.integers(0, 12, int(rng.integers(2, 8))).astype(np.uint64)) for name in "ab"]
        every = []
        for name, g in named:
            template = set(g.tolist())
            for s in range(40):
                for e in range(s, min(40, s + license_scan.SPAN * len(g))):
                    seg = set(grams[s : e + 1].tolist())
                    score = 2 * len(seg & template) / (len(seg) + len(template))
                    if grams[s] in template and grams[e] in template and score >= 0.8:
                        every.append((-score, name, s, e))
        want = []
        for x in sorted(every):
            if all(x[3] < y[2] or y[3] < x[2] for y in want):
                want.append(x)
        assert license_scan.segments(grams, license_scan.Templates(named, 0.8)) == [(-score, *rest) for score, *rest in want]


def test_whole_licenses_and_repeats(spark):
    """Each whole text is found inside other prose, with some words changed; a notice repeated 5,000 times ends soon."""
    texts = license_scan.whole_texts()
    changed = {name: " ".join(w if i % 50 else "changed" for i, w in enumerate(t.split())) for name, t in texts.items()}
    rows = [(i, f"{prose(60, i)} {t} {prose(60, 90 + i)}") for i, t in enumerate(changed.values())]
    rows += [(500, "Licensed under the MIT License. " * 5000), (501, " ".join(prose(1, i) + " Released under the MIT License." for i in range(300)))]
    found = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert all(name in found[i].licenses.split(",") for i, name in enumerate(changed))
    assert found[500].licenses == found[501].licenses == "MIT" and found[500].dice == 1.0
    twice = license_scan.scan(frame(spark, [(1, rows[0][1])] * 2)).collect()
    assert twice[0] == twice[1]


def test_relatives_in_one_text(spark):
    """A relative's better match on another notice hides none of a license's own notices."""
    three, two = license_scan.TEMPLATES["GPL-3.0"][0], "This tool is licensed under the GNU General Public License, version 2."
    rows = [(1, f"{three} {prose(40, 1)} {two}"), (2, f"{two} {prose(40, 2)} {three} {prose(40, 3)} {three}"), (3, three), (4, " and ".join([three, two] * 20))]
    found = {r.doc_id: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [found[i].licenses for i in (1, 2, 3, 4)] == ["GPL-2.0,GPL-3.0", "GPL-2.0,GPL-3.0", "GPL-3.0", "GPL-2.0,GPL-3.0"]
    assert (found[1].license, found[1].dice, found[1].start_word) == ("GPL-3.0", 1.0, 0)


# 10


def test_leaks_match_brute_force(spark):
    items = [(1, prose(30, 1)), (2, prose(12, 2)), (3, "two words"), (4, None), (5, ""), (6, prose(200, 6)), (None, "x y z"), (7, prose(6, 7))]
    w = prose(30, 1).split()
    half = " ".join(w[:17]), " ".join(w[13:])
    docs = [
        (20, f"{prose(3000, 20)} {items[0][1].upper()} {prose(2000, 21)}"), (21, f"{half[0]} {prose(900, 22)} {half[1]}"), (22, f"x two words y {items[1][1]}"), (23, " ".join(w[:20])),
        (24, prose(4000, 24) + " " + items[5][1]), (25, items[7][1]), *EDGES, (30, prose(500, 30)),
    ]

    def grams(text, k):
        t = (text or "").lower().split()
        return {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}

    want = set()
    for d, text in docs:
        for i, item in items:
            if i is not None and d is not None and (item or "").split():
                k = min(5, len(item.split()))
                s = grams(item, k)
                if 100 * len(s & grams(text, k)) >= 80 * len(s):
                    want.add((d, i))
    it = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, docs), it).collect()}
    assert found == want and {(20, 1), (21, 1), (22, 2), (22, 3), (24, 6), (25, 7)} <= found
    left = decontamination.clean(frame(spark, docs), it)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want} and left.columns == frame(spark, []).columns
    assert decontamination.contaminated(frame(spark, []), it).count() == 0 and decontamination.contaminated(frame(spark, docs), it.limit(0)).count() == 0


def test_items_that_repeat_themselves():
    """A sentence repeated 20 times is found in every document that holds it twice in a row."""
    sentences = [prose(12, 9000 + i) for i in range(200)]
    index = decontamination.ItemIndex(list(range(200)), [" ".join([s] * 20).encode() for s in sentences])
    docs = [f"{prose(300, 5000 + i)} {s} {s} {prose(300, 7000 + i)}".encode() for i, s in enumerate(sentences)]
    assert {(row, index.ids[item]) for row, item, _ in decontamination._scan(index, docs)} == {(i, i) for i in range(200)}


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_ROWS", 3)
    items = spark.createDataFrame([(i, prose(20, i)) for i in range(10)], "item_id long, text string")
    docs = frame(spark, [(i, prose(20, i)) for i in range(12)])
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()} == {(i, i) for i in range(10)}
